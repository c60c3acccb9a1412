"""Plans of projections, filters, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import stem as S
from lexmill.functions import text as T
from lexmill.functions import tokenize as K
from lexmill.operators import index as I
from lexmill.sources import readers, writers
from lexmill.tables import table

from . import sql


def news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).select("rec_id", T.clean_text(F.col("text")).alias("clean_text"))


def clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Title and text joined, cleaned, empty ones left out."""
    out = news(spark, d).select("rec_id", F.coalesce("title", F.lit("")).alias("title"), "label", T.clean_text(T.join_columns("title", "text")).alias("clean_text"))
    return out.where(F.length("clean_text") > 0)


def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "liar").select("rec_id", T.normalise(F.col("statement")).alias("normalised"))


STAGES = ("tokens", "stripped", "lowercase", "no_numbers", "no_stopwords")


def _stages(df: DataFrame, key: str, text: str, tokens: F.Column | None = None) -> DataFrame:
    """(key, tokens, stripped, lowercase, no_numbers, no_stopwords) as arrays; a null text counts as ''."""
    marks = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" ")), F.lit(r"[A-Za-z0-9_'’]+|[^A-Za-z0-9_\s]"), F.lit(0))
    out = df.select(key, (marks if tokens is None else tokens).alias("tokens"))
    out = out.withColumn("stripped", F.transform("tokens", T.strip_punctuation))
    out = out.withColumn("lowercase", F.filter(F.transform("stripped", F.lower), lambda t: t != ""))
    out = out.withColumn("no_numbers", F.filter("lowercase", lambda t: ~T.has_digit(t)))
    return out.withColumn("no_stopwords", F.filter("no_numbers", T.not_stopword))


def preprocess_stages(spark: SparkSession, d: str) -> DataFrame:
    return _stages(table(spark, d, "queries").where("query_text is not null"), "qid", "query_text").select("qid", *[F.array_join(n, " ").alias(n) for n in STAGES])


def preprocess_records(spark: SparkSession, d: str) -> DataFrame:
    """The stages of titles and texts, a row a record and field; an empty field has empty stages."""
    out = None
    for field in ("title", "text"):
        rows = _stages(news(spark, d), "rec_id", field).select("rec_id", F.lit(field).alias("field"), *[F.array_join(n, " ").alias(n) for n in STAGES])
        out = rows if out is None else out.unionAll(rows)
    return out


def _all_stages(df: DataFrame, key: str, text: str) -> DataFrame:
    """All eight stages, with the Treebank-like tokeniser, stems and lemmas."""
    split = K.treebank_words(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" ")))
    base = _stages(df, key, text, split).select(key, *[F.array_join(c, " ").alias(c) for c in STAGES])
    return base.select("*", S.text_udf(S.porter)("no_stopwords").alias("porter"), S.text_udf(S.snowball)("no_stopwords").alias("snowball"), S.text_udf(S.verb_lemma)("no_stopwords").alias("lemmatized"))


def preprocess_full(spark: SparkSession, d: str) -> DataFrame:
    return _all_stages(table(spark, d, "queries").where("query_text is not null"), "qid", "query_text")


def preprocess_full_records(spark: SparkSession, d: str) -> DataFrame:
    """The eight stages of titles and texts apart."""
    title, text = (_all_stages(news(spark, d), "rec_id", f) for f in ("title", "text"))
    return title.withColumn("field", F.lit("title")).unionByName(text.withColumn("field", F.lit("text")))


def clean_lemmatised(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts with lemmas in place of the words."""
    return news(spark, d).select("rec_id", T.clean_text(F.col("text"), lemmatise=S.text_udf(S.lemma)).alias("clean_text"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return I.analysed(news(spark, d).select(F.col("rec_id").alias("doc_id"), "text"), stop=False).select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()


def porter_stem(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", S.word_udf(S.porter)("term").alias("stem"))


def snowball_stem(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", S.word_udf(S.snowball)("term").alias("stem"))


def lancaster_stem(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", S.word_udf(S.lancaster)("term").alias("stem"))


def lemma_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", S.word_udf(S.lemma)("term").alias("noun"), S.word_udf(S.verb_lemma)("term").alias("verb"))


def stemmer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of distinct terms on which two normalisers agree."""
    t = _terms(spark, d).select(S.word_udf(S.porter)("term").alias("p"), S.word_udf(S.lancaster)("term").alias("l"), S.word_udf(S.lemma)("term").alias("n"))
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))
    return t.agg(same("p", "l").alias("porter_lancaster"), same("p", "n").alias("porter_lemma"), F.count("*").alias("terms"))


def stem_table(spark: SparkSession, d: str) -> DataFrame:
    """The normalisers side by side."""
    kinds = {"porter": S.porter, "snowball": S.snowball, "lancaster": S.lancaster, "noun": S.lemma, "verb": S.verb_lemma}
    return _terms(spark, d).select("term", *[S.word_udf(f)("term").alias(n) for n, f in kinds.items()])


def regex_stem(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", T.regex_stem(F.col("term")).alias("stem"))


def compress_vowels(spark: SparkSession, d: str) -> DataFrame:
    vowels = F.regexp_extract_all("term", F.lit("[aeiou]"), F.lit(0))
    return _terms(spark, d).select("term", T.compress_vowels(F.col("term")).alias("compressed"), F.array_join(F.array_sort(F.array_distinct(vowels)), "").alias("vowels"), F.size(vowels).alias("n_vowels"))


# Search patterns (anywhere in a token) and full-match patterns.
SEARCH = {
    "ends_ed": "ed$", "j_t": "^..j..t..$", "email": "^e-?mail$", "keys_4653": "^[ghi][mno][jlk][def]$", "mine": "^m+i+n+e+$",
    "decimal": r"^[0-9]+\.[0-9]+$", "currency": r"^[A-Z]+\$$", "year": "^[0-9]{4}$", "cat": "cat",
}
FULL = {"letters": "[a-zA-Z]+", "capital": "[A-Z][a-z]*", "p_t": "p[aeiou]{0,2}t", "number": r"[0-9]+(\.[0-9]+)?", "cvc": "[^aeiouAEIOU][aeiouAEIOU][^aeiouAEIOU]*", "word_or_marks": r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+"}


def _raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where("text is not null").select(F.explode(F.split("text", r"[ \t\n]+")).alias("token"))


def regex_filters(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that each pattern finds: one pass, one row per pattern."""
    hits = _raw_tokens(spark, d).agg(*[F.sum(F.col("token").rlike(p).cast("long")).alias(n) for n, p in SEARCH.items()])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).alias("tokens")) for n in SEARCH])).alias("x")).select("x.*")


def regex_battery(spark: SparkSession, d: str) -> DataFrame:
    hits = _raw_tokens(spark, d).agg(*[F.sum(F.col("token").rlike(f"^(?:{p})$").cast("long")).alias(n) for n, p in FULL.items()])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).alias("tokens")) for n in FULL])).alias("x")).select("x.*")


def regex_matches(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, token, n): the tokens that each search pattern finds."""
    counted = _raw_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    found = F.filter(F.array(*[F.when(F.col("token").rlike(p), F.lit(n)) for n, p in SEARCH.items()]), lambda x: x.isNotNull())
    return counted.select(F.explode(found).alias("pattern"), "token", "n")


def regex_full_matches(spark: SparkSession, d: str) -> DataFrame:
    """(token, a column per full-match pattern): the battery over every distinct token."""
    return _raw_tokens(spark, d).distinct().select("token", *[F.col("token").rlike(f"^(?:{p})$").alias(n) for n, p in FULL.items()])


def token_filters(spark: SparkSession, d: str) -> DataFrame:
    """Per record: letters-only tokens, tokens without digits, tokens of two or more characters, lower-case tokens."""
    t = F.split("text", r"[ \t\n]+")
    n = lambda f: F.size(F.filter(t, f))
    return news(spark, d).where("text is not null").select(
        "rec_id", n(lambda x: x.rlike(r"^\p{L}+$")).alias("alpha"), n(lambda x: ~T.has_digit(x)).alias("no_digit"), n(lambda x: F.length(x) >= 2).alias("long_enough"), n(T.is_lower).alias("lower_case"),
    )


def tokenizer_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "liar").where("statement is not null").select("rec_id", *[c.cast("int").alias(n) for n, c in K.token_counts(F.col("statement")).items()])


def treebank_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "liar").where("statement is not null").select("rec_id", K.treebank_words("statement").alias("tokens"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where("text is not null").select("rec_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.html_to_text(F.col("text")).alias("plain"))


def html_parsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", K.parsed_html("text").alias("plain"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).select("rec_id", T.html_escape(F.col("title")).alias("escaped"))


def nonascii_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters beyond ASCII with their counts and code points."""
    chars = news(spark, d).where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n")).withColumn("code_point", F.ascii("ch"))


def char_names(spark: SparkSession, d: str) -> DataFrame:
    chars = nonascii_chars(spark, d)
    return chars.select("ch", "n", F.hex("code_point").alias("hex"), K.char_name("ch").alias("name"))


def string_operations(spark: SparkSession, d: str) -> DataFrame:
    """Index, slice, negative index, find, rfind, case, repeat, replace, pads and membership over titles."""
    t = F.col("title")
    return news(spark, d).where("title is not null").select(
        "rec_id", F.substring(t, 1, 1).alias("first_char"), F.substring(t, 4, 5).alias("slice_3_8"), F.substring(t, -1, 1).alias("last_char"), T.find(t, "the").alias("found"), T.rfind(t, "the").alias("found_last"),
        F.upper(t).alias("upper_case"), F.repeat(F.substring(t, 1, 2), 3).alias("repeated"), F.replace(t, F.lit(" "), F.lit("_")).alias("replaced"), F.lpad(F.substring(t, 1, 8), 10, "*").alias("padded"),
        F.concat(F.substring(t, 1, 3), F.lit("-"), F.substring(t, 1, 3)).alias("joined"), t.contains("the").alias("has_the"), F.length(t).alias("chars"), F.size(T.split_words(t)).alias("n_words"),
    )


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Subjects at the left, right and centre of a width that each row sets."""
    t, width = F.col("subject"), (F.col("rec_id") % 30).cast("int")
    return news(spark, d).where("subject is not null").select("rec_id", *[T.aligned(t, width, h).alias(f"at_{h}") for h in ("left", "right", "centre")])


def truncations(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where("text is not null").select("rec_id", T.short_title(F.col("text")).alias("short_title"), F.substring("title", 1, 120).alias("title_120"), T.snippet(F.col("text")).alias("snippet"), F.substring("text", 1, 300).alias("text_300"))


def body_between(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where("text is not null").select("rec_id", T.between(F.col("text"), "The", ".").alias("body"))


def highlighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("query_text is not null").select("qid", F.regexp_replace("query_text", "([aeiou]+)", "{$1}").alias("shown"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where("text is not null").select("rec_id", K.wrap("text").alias("wrapped"))


def pipe_records(spark: SparkSession, d: str) -> DataFrame:
    """Pipe lines written and parsed again, with the three acceptance rules."""
    line = writers.pipe_line(F.col("qid"), T.short_title(F.col("query_text")), F.col("query_text"))
    parts = table(spark, d, "queries").select("qid", readers.pipe_parts(F.rtrim(line)).alias("p"))
    size = F.size("p")
    return parts.select("qid", size.alias("parts"), (size >= 1).alias("loose"), (size >= 2).alias("middle"), (size == 3).alias("strict"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("title"))


def segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Words and cost of every title without spaces, cut where the words ended."""
    t = F.col("title")
    letters = F.replace(t, F.lit(" "), F.lit(""))
    marks = F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), r"[^ ]", "0"), " 0", "1")
    # words with one space between; a repeated group overflows the stack at thousands of words
    plain = t.rlike("^[A-Za-z][A-Za-z ]*[A-Za-z]$") & t.contains(" ") & ~t.contains("  ")
    rows = news(spark, d).where(plain).select("rec_id", letters.alias("letters"), marks.alias("mask"))
    return rows.select("rec_id", F.array_join(T.segment(F.col("letters"), F.col("mask")), " ").alias("words"), T.segment_cost(F.col("letters"), F.col("mask")).alias("cost"))


def term_slices(spark: SparkSession, d: str) -> DataFrame:
    """Token slices, and an edit of a token list by slices."""
    t = T.words(F.col("text"))
    edit = F.concat(F.slice("w", 1, 2), F.array(F.lit("first"), F.lit("second")), F.slice("w", 5, 4))
    return news(spark, d).where("text is not null").select("rec_id", t.alias("w")).select("rec_id", F.array_join(F.slice("w", 3, 5), " ").alias("sliced"), F.array_join(edit, " ").alias("edited"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, clean_corpus, clean_lemmatised, normalise_text, preprocess_stages, preprocess_records, preprocess_full, preprocess_full_records, porter_stem, snowball_stem, lancaster_stem, lemma_lookup, stemmer_agreement, stem_table, regex_stem, compress_vowels, regex_filters, regex_matches, regex_full_matches,
        regex_battery, token_filters, tokenizer_counts, treebank_tokens, sentence_split, html_to_text, html_parsed, html_escape, nonascii_chars, char_names, string_operations, aligned, truncations, body_between, highlighted,
        wrapped, pipe_records, segmentation, term_slices,
    )
}

_TERMS = f"(SELECT DISTINCT unnest({sql.words('text')}) AS term FROM news)"


def _stage_sql(source: str, key: str, text: str, more: str = "") -> str:
    return rf"""
        WITH a AS (SELECT {key}, regexp_extract_all(replace(coalesce({text}, ''), '-', ' '), '[A-Za-z0-9_''’]+|[^A-Za-z0-9_\s]') AS tokens FROM {source}),
        b AS (SELECT *, list_transform(tokens, lambda t: regexp_replace(t, '[!-/:-@\[-`{{-~’]', '', 'g')) AS stripped FROM a),
        c AS (SELECT *, list_filter(list_transform(stripped, lambda t: lower(t)), lambda t: t <> '') AS lowercase FROM b),
        e AS (SELECT *, list_filter(lowercase, lambda t: NOT regexp_matches(t, '\p{{Nd}}')) AS no_numbers FROM c),
        f AS (SELECT *, list_filter(no_numbers, lambda t: t NOT IN {sql.STOP}) AS no_stopwords FROM e)
        SELECT {key}, {more} array_to_string(tokens, ' ') AS tokens, array_to_string(stripped, ' ') AS stripped, array_to_string(lowercase, ' ') AS lowercase,
          array_to_string(no_numbers, ' ') AS no_numbers, array_to_string(no_stopwords, ' ') AS no_stopwords FROM f"""


_TOKENS = r"(SELECT unnest(string_split_regex(text, '[ \t\n]+')) AS token FROM news WHERE text IS NOT NULL)"


def _pattern_rows(patterns: dict[str, str], full: bool) -> str:
    one = lambda n, p: f"SELECT '{n}' AS pattern, coalesce(CAST(sum(CASE WHEN regexp_matches(token, '{'^(?:' + p + ')$' if full else p}') THEN 1 ELSE 0 END) AS BIGINT), 0) AS tokens FROM {_TOKENS}"
    return " UNION ALL ".join(one(n, p) for n, p in patterns.items())


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
_plain = r"regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^<>]*>', ' ', 'g')"
for _e, _c in _ENTITIES:
    _plain = f"replace({_plain}, '{_e}', '{_c}')"
_escaped = "title"
for _c, _e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _escaped = f"replace({_escaped}, '{_c}', '{_e}')"

ORACLE = {
    "clean_text": f"SELECT rec_id, {sql.clean('text')} AS clean_text FROM news",
    "clean_corpus": f"SELECT * FROM (SELECT rec_id, coalesce(title, '') AS title, label, {sql.clean(chr(40) + 'coalesce(title, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(text, ' + chr(39) * 2 + '))')} AS clean_text FROM news) WHERE length(clean_text) > 0",
    "normalise_text": f"SELECT rec_id, {sql.normalise('statement')} AS normalised FROM liar",
    "preprocess_stages": _stage_sql("queries WHERE query_text IS NOT NULL", "qid", "query_text"),
    "preprocess_records": " UNION ALL ".join(f"SELECT * FROM ({_stage_sql('news', 'rec_id', f, f'{chr(39)}{f}{chr(39)} AS field,')})" for f in ("title", "text")),
    "regex_matches": " UNION ALL ".join(f"SELECT '{n}' AS pattern, token, count(*) AS n FROM {_TOKENS} WHERE regexp_matches(token, '{p}') GROUP BY token" for n, p in SEARCH.items()),
    "regex_full_matches": f"SELECT token, {', '.join(f'regexp_matches(token, {chr(39)}^(?:{p})${chr(39)}) AS {n}' for n, p in FULL.items())} FROM (SELECT DISTINCT token FROM {_TOKENS})",
    "aligned": """WITH a AS (SELECT rec_id, subject, greatest(rec_id % 30 - length(subject), 0)::INT AS room FROM news WHERE subject IS NOT NULL)
        SELECT rec_id, subject || repeat(' ', room) AS at_left, repeat(' ', room) || subject AS at_right, repeat(' ', room // 2) || subject || repeat(' ', room - room // 2) AS at_centre FROM a""",
    "regex_stem": f"SELECT term, regexp_extract(term, '^(.*?)(ing|ly|ed|ious|ies|ive|es|s|ment)?$', 1) AS stem FROM {_TERMS}",
    "compress_vowels": f"""SELECT term, array_to_string(regexp_extract_all(term, '^[AEIOUaeiou]+|[AEIOUaeiou]+$|[^AEIOUaeiou]'), '') AS compressed,
        array_to_string(list_sort(list_distinct(regexp_extract_all(term, '[aeiou]'))), '') AS vowels, CAST(len(regexp_extract_all(term, '[aeiou]')) AS INT) AS n_vowels FROM {_TERMS}""",
    "regex_filters": _pattern_rows(SEARCH, False),
    "regex_battery": _pattern_rows(FULL, True),
    "token_filters": r"""
        WITH a AS (SELECT rec_id, string_split_regex(text, '[ \t\n]+') AS t FROM news WHERE text IS NOT NULL)
        SELECT rec_id, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^\p{L}+$'))) AS INT) AS alpha, CAST(len(list_filter(t, lambda x: NOT regexp_matches(x, '\p{Nd}'))) AS INT) AS no_digit,
          CAST(len(list_filter(t, lambda x: length(x) >= 2)) AS INT) AS long_enough, CAST(len(list_filter(t, lambda x: lower(x) = x AND upper(x) <> x)) AS INT) AS lower_case FROM a""",
    "tokenizer_counts": rf"""SELECT rec_id, CAST(len(list_filter(string_split_regex(trim(statement), '\s+'), lambda t: t <> '')) AS INT) AS n_split, CAST(len(string_split_regex(statement, '[ \t\n]+')) AS INT) AS n_resplit,
        CAST(len(regexp_extract_all(statement, '{K.WORD_RUN}')) AS INT) AS n_words, CAST(len(regexp_extract_all(statement, '{K.HYPHENATED.replace("'", "''")}')) AS INT) AS n_hyphenated,
        CAST(len(regexp_extract_all(statement, '{K.VERBOSE.replace("'", "''")}')) AS INT) AS n_verbose FROM liar WHERE statement IS NOT NULL""",
    "sentence_split": f"""
        WITH a AS (SELECT rec_id, {sql.sentences('text')} AS s FROM news WHERE text IS NOT NULL)
        SELECT rec_id, CAST(i - 1 AS INT) AS pos, s[i] AS sentence FROM (SELECT rec_id, s, unnest(range(1, len(s) + 1)) AS i FROM a)""",
    "html_to_text": rf"SELECT doc_id, trim(regexp_replace({_plain}, '\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL",
    "html_escape": f"SELECT rec_id, {_escaped} AS escaped FROM news",
    "nonascii_chars": r"SELECT ch, count(*) AS n, CAST(unicode(ch) AS INT) AS code_point FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM news WHERE text IS NOT NULL) GROUP BY ch",
    "string_operations": r"""
        SELECT rec_id, substring(title, 1, 1) AS first_char, substring(title, 4, 5) AS slice_3_8, CASE WHEN length(title) = 0 THEN '' ELSE substring(title, -1, 1) END AS last_char, CAST(instr(title, 'the') - 1 AS INT) AS found,
          CAST(CASE WHEN instr(title, 'the') = 0 THEN -1 ELSE length(title) - 3 - instr(array_to_string(list_reverse(string_split(title, '')), ''), 'eht') + 1 END AS INT) AS found_last,
          upper(replace(title, 'ß', 'SS')) AS upper_case, repeat(substring(title, 1, 2), 3) AS repeated, replace(title, ' ', '_') AS replaced, lpad(substring(title, 1, 8), 10, '*') AS padded,
          substring(title, 1, 3) || '-' || substring(title, 1, 3) AS joined, contains(title, 'the') AS has_the, CAST(length(title) AS INT) AS chars,
          CAST(len(list_filter(string_split_regex(trim(title), '\s+'), lambda t: t <> '')) AS INT) AS n_words FROM news WHERE title IS NOT NULL""",
    "truncations": """SELECT rec_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS short_title, substring(title, 1, 120) AS title_120, trim(substring(text, 1, 240)) || '…' AS snippet,
        substring(text, 1, 300) AS text_300 FROM news WHERE text IS NOT NULL""",
    "body_between": """
        WITH a AS (SELECT rec_id, text, instr(text, 'The') - 1 AS x, CASE WHEN instr(text, '.') = 0 THEN -1 ELSE length(text) - instr(array_to_string(list_reverse(string_split(text, '')), ''), '.') END AS y FROM news WHERE text IS NOT NULL)
        SELECT rec_id, CASE WHEN x >= 0 AND y >= x THEN substring(text, x + 1, y - x) ELSE text END AS body FROM a""",
    "highlighted": r"SELECT qid, regexp_replace(query_text, '([aeiou]+)', '{\1}', 'g') AS shown FROM queries WHERE query_text IS NOT NULL",
    "pipe_records": r"""
        WITH a AS (SELECT qid, rtrim(qid || ' | ' || coalesce(CASE WHEN length(query_text) > 50 THEN substring(query_text, 1, 50) || '...' ELSE query_text END, '') || ' | ' || coalesce(query_text, '')) AS line FROM queries),
        b AS (SELECT qid, string_split(line, ' | ') AS p FROM a)
        SELECT qid, CAST(least(len(p), 3) AS INT) AS parts, len(p) >= 1 AS loose, len(p) >= 2 AS middle, least(len(p), 3) = 3 AS strict, coalesce(p[2], '') AS title FROM b""",
    "segmentation": r"""
        WITH a AS (SELECT rec_id, string_split(title, ' ') AS w FROM news WHERE regexp_matches(title, '^[A-Za-z]+( [A-Za-z]+)+$'))
        SELECT rec_id, array_to_string(w, ' ') AS words, CAST(len(w) + list_sum(list_transform(list_distinct(w), lambda x: length(x) + 1)) AS INT) AS cost FROM a""",
    "term_slices": f"""
        WITH a AS (SELECT rec_id, {sql.words('text')} AS w FROM news WHERE text IS NOT NULL)
        SELECT rec_id, array_to_string(w[3:7], ' ') AS sliced, array_to_string(list_concat(list_concat(w[1:2], ['first', 'second']), w[5:8]), ' ') AS edited FROM a""",
}
