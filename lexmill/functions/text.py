"""Text kernels as Column expressions: all run inside the JVM, none needs a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of news agencies that give a text's class away. Written for lower-cased text, without inline modes,
# so that Java and RE2 read them alike.
LEAKS = "|".join(
    [
        r"\(reuters\)",
        r"\(ap\)",
        r"\(afp\)",
        r"\(ups\)",
        r"—\s*reuters",
        r"-\s*reuters",
        r"reuters\s*\.com",
        r"apnews\s*\.com",
        r"afp\s*\.com",
        r"\bby\s+[a-z0-9_][a-z0-9_\s]{0,40}reuters\b",
        r"[a-z][a-z ,]+\(reuters\)\s*[-–]",
        r"[a-z][a-z ,]+\(ap\)\s*[-–]",
        r"[a-z][a-z ,]+\(afp\)\s*[-–]",
    ]
)
URL = r"http\S+|www\.\S+"
WORD = "[a-z]{2,}"
MODALS = ["can", "could", "may", "might", "must", "will"]


# The English stopwords of Spark's StopWordsRemover, in its order.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
    can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
    we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
    cannot could here's how's let's ought that's there's what's when's where's who's why's would
    """.split()
)


def stopwords() -> tuple[str, ...]:
    return STOPWORDS


def not_stopword(token: Column) -> Column:
    return ~token.isin(*stopwords())


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Every marker holds one of these; texts without any skip the patterns, whose letter runs cost the square of their length.
LEAK_HINTS = ("reuters", "apnews", "afp", "(ap)", "(ups)")


def remove_leaks(text: Column) -> Column:
    hint = text.contains(LEAK_HINTS[0])
    for h in LEAK_HINTS[1:]:
        hint = hint | text.contains(h)
    return F.when(hint, F.regexp_replace(text, LEAKS, " ")).otherwise(text)


def normalise(text: Column, *, remove_digits: bool = False) -> Column:
    """Lower case, without agency markers, URLs and all but a-z; one space between words. Null gives ''."""
    out = F.regexp_replace(remove_leaks(F.lower(F.coalesce(text, F.lit("")))), URL, " ")
    if remove_digits:
        out = F.regexp_replace(out, r"\d+", " ")
    return collapse(F.regexp_replace(out, r"[^a-z\s]", " "))


def split_words(text: Column) -> Column:
    """White space split; '' gives no word."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def clean_text(text: Column, *, remove_digits: bool = False, min_len: int = 2, lemmatise: Callable[[Column], Column] | None = None) -> Column:
    """``normalise`` without stopwords and words under ``min_len`` letters; ``lemmatise`` (a function of a column of words
    parted by spaces, such as ``stem.text_udf(stem.lemma)``) has the rest."""
    kept = F.filter(F.split(normalise(text, remove_digits=remove_digits), " "), lambda t: (F.length(t) >= min_len) & not_stopword(t))
    out = F.array_join(kept, " ")
    return lemmatise(out) if lemmatise else out


def join_columns(*columns: str) -> Column:
    """Null as '' and a space between."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def words(text: Column) -> Column:
    """Runs of two or more a-z of the lower-cased text: the index's analyser, for documents and queries alike."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip_punctuation(token: Column) -> Column:
    """ASCII punctuation and the typographic apostrophe removed; the token may become empty."""
    return F.regexp_replace(token, r"[!-/:-@\[-`{-~’]", "")


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def is_lower(token: Column) -> Column:
    """Has letters of case, and all of them are small."""
    return (F.lower(token) == token) & (F.upper(token) != token)


def aligned(text: Column, width: Column, how: str) -> Column:
    """Padded with spaces to ``width``, left, right or centred (the odd space at the right); longer texts stay whole."""
    room = F.greatest(width - F.length(text), F.lit(0)).cast("int")
    before = {"left": F.lit(0), "right": room, "centre": F.floor(room / 2).cast("int")}[how]
    return F.concat(F.repeat(F.lit(" "), before), text, F.repeat(F.lit(" "), room - before))


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and white space, trimmed, those over 20 characters."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def overlap_words(text: Column) -> Column:
    """Distinct words of three or more word characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def short_title(text: Column, size: int = 50) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def snippet(text: Column, size: int = 240) -> Column:
    return F.concat(F.trim(F.substring(text, 1, size)), F.lit("…"))


def find(text: Column, part: str) -> Column:
    """0-based place of the first ``part``, -1 if absent."""
    return F.instr(text, part) - 1


def rfind(text: Column, part: str) -> Column:
    """0-based place of the last ``part``, -1 if absent."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - len(part) - back + 1)


def between(text: Column, first: str, last: str) -> Column:
    """The text from the first ``first`` up to the last ``last``; whole if either is absent."""
    a, b = find(text, first), rfind(text, last)
    return F.when((a >= 0) & (b >= a), F.substring(text, a + 1, b - a)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; the common entities resolved; white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def regex_stem(token: Column) -> Column:
    """The shortest head before one of nine suffixes."""
    return F.regexp_extract(token, r"^(.*?)(ing|ly|ed|ious|ies|ive|es|s|ment)?$", 1)


def compress_vowels(token: Column) -> Column:
    """Without inner vowels."""
    return F.array_join(F.regexp_extract_all(token, F.lit("^[AEIOUaeiou]+|[AEIOUaeiou]+$|[^AEIOUaeiou]"), F.lit(0)), "")


def segment(text: Column, mask: Column) -> Column:
    """Words of ``text`` cut after each 1 of the mask (one digit per character but the last)."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(mask)), lambda i: F.substring(mask, i, F.lit(1)) == "1")
    ends = F.concat(cuts, F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), cuts)
    return F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))


def segment_cost(text: Column, mask: Column) -> Column:
    """Words, plus length and one for each distinct word."""
    found = segment(text, mask)
    return F.size(found) + F.aggregate(F.array_distinct(found), F.lit(0), lambda s, w: s + F.length(w) + 1)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
