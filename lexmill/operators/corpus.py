"""Corpus linguistics over (doc_id, text): positions, contexts, bigrams, patterns and frequency distributions.

Neighbours of a word are read from the document's own token array (higher-order functions), so no operator here sorts or
shuffles positions; only the final counts are shuffled, pre-aggregated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I


def positions(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, term): pos from 0."""
    return I.analysed(corpus, stop=False).select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def token(i: Column, shift: int = 0) -> Column:
    """The token ``shift`` places from place i, null outside the document."""
    return F.get("tokens", i + shift)


def places(corpus: DataFrame, wanted: Callable[[Column], Column], given: dict[str, Column] | None = None, **build: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, build...) of the places i of each document for which ``wanted(i)`` holds. The document's token array is read
    by place, never copied to each of its rows. ``given`` names values that are the same for all rows."""
    all_places = F.transform("tokens", lambda t, i: i)
    found = F.transform(F.filter(all_places, wanted), lambda i: F.struct(*[f(i).alias(n) for n, f in build.items()]))
    tokens = I.analysed(corpus, stop=False)
    for name, value in (given or {}).items():
        tokens = tokens.select("*", I.fixed(value).alias(name))
    return tokens.select("doc_id", F.explode(found).alias("h")).select("doc_id", "h.*")


def concordance(corpus: DataFrame, word: str, *, width: int = 4, lines: int | None = None) -> DataFrame:
    """(doc_id, pos, left_words, word, right_words): ``width`` tokens at either side; with ``lines`` so many first places."""
    out = places(
        corpus.where(F.lower("text").contains(word)),
        lambda i: token(i) == word,
        pos=lambda i: i,
        left_words=lambda i: F.array_join(F.slice("tokens", F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width))), " "),
        word=token,
        right_words=lambda i: F.array_join(F.slice("tokens", i + 2, F.lit(width)), " "),
    )
    return out.orderBy("doc_id", "pos").limit(lines) if lines else out


def dispersion(corpus: DataFrame, words: list[str]) -> DataFrame:
    return positions(corpus).where(F.col("term").isin(words)).select("doc_id", "pos", F.col("term").alias("word"))


def contexts(corpus: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(term, left_word, right_word, n) of terms with a neighbour at both sides."""

    def inner(i: Column) -> Column:
        both = (i > 0) & token(i, 1).isNotNull()
        return both & token(i).isin(words) if words else both

    rows = places(corpus, inner, term=token, left_word=lambda i: token(i, -1), right_word=lambda i: token(i, 1))
    return rows.groupBy("term", "left_word", "right_word").agg(F.count("*").alias("n"))


def similar(corpus: DataFrame, word: str, *, k: int = 20) -> DataFrame:
    """The k words that share most distinct contexts with ``word``."""
    all_contexts = contexts(corpus)
    own = all_contexts.where(F.col("term") == word).select("left_word", "right_word")
    shared = all_contexts.where(F.col("term") != word).join(own, ["left_word", "right_word"]).groupBy("term").agg(F.count("*").alias("shared"))
    return shared.orderBy(F.col("shared").desc(), "term").limit(k)


def common_contexts(corpus: DataFrame, words: list[str]) -> DataFrame:
    """(left_word, right_word) in which all of the words occur."""
    return contexts(corpus, words).groupBy("left_word", "right_word").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len(set(words))).select("left_word", "right_word")


def bigrams(corpus: DataFrame) -> DataFrame:
    """(a, b, n)."""
    rows = places(corpus, lambda i: token(i, 1).isNotNull(), a=token, b=lambda i: token(i, 1))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


def collocations(corpus: DataFrame, *, min_count: int = 2, min_len: int = 3, k: int = 20) -> DataFrame:
    """The k pairs of the highest log-likelihood ratio, of words of three letters or more that are no stopwords."""
    pairs = bigrams(corpus)
    left = pairs.groupBy(F.col("a").alias("a")).agg(F.sum("n").alias("na"))
    right = pairs.groupBy(F.col("b").alias("b")).agg(F.sum("n").alias("nb"))
    total = pairs.agg(F.sum("n").cast("double").alias("t")).scalar()
    ok = (F.length("a") >= min_len) & (F.length("b") >= min_len) & T.not_stopword(F.col("a")) & T.not_stopword(F.col("b"))
    rows = pairs.where(ok & (F.col("n") >= min_count)).join(left, "a").join(right, "b")
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")

    def cell(observed: Column, expected: Column) -> Column:
        return F.when(observed <= 0, 0.0).otherwise(observed * F.log(observed / expected))

    ratio = cell(n, na * nb / total) + cell(na - n, na * (total - nb) / total) + cell(nb - n, (total - na) * nb / total) + cell(total - na - nb + n, (total - na) * (total - nb) / total)
    scored = rows.select("a", "b", "n", F.round(2 * ratio, 4).alias("llr"))
    return scored.orderBy(F.col("llr").desc(), "a", "b").limit(k)


def token_pattern(corpus: DataFrame, pattern: list[str]) -> DataFrame:
    """(doc_id, pos, found): runs of tokens that match the pattern's regular expressions one by one."""

    def matches(i: Column) -> Column:
        ok = F.lit(True)
        for shift, p in enumerate(pattern):
            ok = ok & F.coalesce(token(i, shift).rlike(f"^(?:{p})$"), F.lit(False))
        return ok

    return places(corpus, matches, pos=lambda i: i, found=lambda i: F.array_join(F.slice("tokens", i + 1, F.lit(len(pattern))), " "))


def hypernyms(corpus: DataFrame) -> DataFrame:
    """(hyponym, hypernym, n) from 'X and other Y'."""
    wanted = lambda i: (token(i) == "and") & (token(i, 1) == "other") & (i > 0) & token(i, 2).isNotNull()
    pair = places(corpus, wanted, hyponym=lambda i: token(i, -1), hypernym=lambda i: token(i, 2))
    return pair.groupBy("hyponym", "hypernym").agg(F.count("*").alias("n"))


def frequency(terms: DataFrame, *by: str) -> DataFrame:
    return terms.groupBy(*by, "term").agg(F.count("*").alias("n"))


def conditional_frequency(corpus: DataFrame, condition: str, words: list[str]) -> DataFrame:
    """One row per value of ``condition``, one column per word, 0 where it doesn't occur: counted within the row, then one
    aggregation by condition."""
    tokens = T.words(F.col("text"))

    def occurrences(word: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t == word)).alias(word)

    counts = corpus.select(condition, *[occurrences(w) for w in words])
    return counts.groupBy(condition).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in words])


def diversity(corpus: DataFrame) -> DataFrame:
    """(tokens, types, diversity) of the whole corpus; the types are counted from term statistics, not by one distinct."""
    freq = I.analysed(corpus, stop=False).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return freq.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).withColumn("diversity", F.round(F.col("types") / F.col("tokens"), 8))


def vowel_sequences(corpus: DataFrame) -> DataFrame:
    """(seq, n): runs of two or more vowels over the distinct words."""
    words = I.analysed(corpus, stop=False).select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    return words.select(F.explode(F.regexp_extract_all("term", F.lit("[aeiou]{2,}"), F.lit(0))).alias("seq")).groupBy("seq").agg(F.count("*").alias("n"))


def inverted_positions(corpus: DataFrame, stemmer=None) -> DataFrame:
    """(stem, doc_id, places): positional inverted index; ``stemmer`` is a Column function (for instance a Pandas UDF)."""
    rows = positions(corpus)
    stem = stemmer(F.col("term")) if stemmer else F.col("term")
    return rows.select("doc_id", "pos", stem.alias("stem")).groupBy("stem", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))


def ngram_model(corpus: DataFrame) -> DataFrame:
    """(a, b, n, p): bigram counts and P(b | a)."""
    pairs = bigrams(corpus)
    return pairs.join(pairs.groupBy("a").agg(F.sum("n").alias("na")), "a").select("a", "b", "n", (F.col("n") / F.col("na")).alias("p"))


def generate(model: DataFrame, start: str, length: int = 20, *, seed: int | None = None) -> list[str]:
    """A continuation of ``start``: the likeliest, or with a ``seed`` one drawn by the model's probabilities (the least of
    -ln(u) / p over the followers, u from a hash). Each step is one lookup that gives one row."""
    model = model.cache()
    out = [start]
    while len(out) < length:
        if seed is None:
            order = [F.col("p").desc(), F.col("b")]
        else:
            u = (F.pmod(F.xxhash64("b", F.lit(len(out)), F.lit(seed)), F.lit(1_000_000_007)) + 0.5) / 1_000_000_007.0
            order = [-F.log(u) / F.col("p"), F.col("b")]
        row = model.where(F.col("a") == out[-1]).orderBy(*order).select("b").first()
        if row is None:
            break
        out.append(row["b"])
    model.unpersist()
    return out


def stem_lines(corpus: DataFrame, word: str, stemmer: Callable[[Column], Column], *, width: int = 40, lines: int | None = 5) -> DataFrame:
    """(doc_id, pos, left_side, right_side): the words with the stem of ``word`` and their surroundings, a quarter of
    ``width`` words at either side, the left one cut and padded to its last ``width`` characters, the right one (from the
    word on) to its first; with ``lines`` so many first places. The forms of the stem are one array of a subquery."""
    spark = corpus.sparkSession
    key = spark.createDataFrame([(word,)], "w string").select(F.lower(stemmer(F.col("w"))).alias("key"))
    terms = I.analysed(corpus, stop=False).select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    forms = terms.withColumn("key", F.lower(stemmer(F.col("term")))).join(F.broadcast(key), "key").agg(F.collect_set("term").alias("f")).scalar()
    n = max(1, width // 4)
    out = places(
        corpus,
        lambda i: F.array_contains("forms", token(i)),
        {"forms": forms},
        pos=lambda i: i,
        before=lambda i: F.array_join(F.slice("tokens", F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))), " "),
        after=lambda i: F.array_join(F.slice("tokens", i + 1, F.lit(n)), " "),
    )
    left = F.lpad(F.right("before", F.lit(width)), width, " ")
    out = out.select("doc_id", "pos", left.alias("left_side"), F.rpad("after", width, " ").alias("right_side"))
    return out.orderBy("doc_id", "pos").limit(lines) if lines else out
