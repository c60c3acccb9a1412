"""Plans of corpus linguistics over the news texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import stem as S
from lexmill.functions import text as T
from lexmill.operators import corpus as C
from lexmill.operators import index as I
from lexmill.operators import sampling
from lexmill.tables import table

from . import sql


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news").where("text is not null").select(F.col("rec_id").alias("doc_id"), "text", "source")


def freqdist_topn(spark: SparkSession, d: str) -> DataFrame:
    return C.frequency(I.analysed(texts(spark, d)).select(F.explode("tokens").alias("term"))).orderBy(F.col("n").desc(), "term").limit(50)


def cond_freqdist(spark: SparkSession, d: str) -> DataFrame:
    """Modal verbs by source, one column each."""
    return C.conditional_frequency(texts(spark, d), "source", T.MODALS)


def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    return C.diversity(texts(spark, d))


def word_share(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of 'the' and their percentage, by source."""
    w = T.words(F.col("text"))
    rows = texts(spark, d).select("source", F.size(F.filter(w, lambda t: t == "the")).alias("hits"), F.size(w).alias("tokens"))
    return rows.groupBy("source").agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens")).withColumn("percent", F.round(100.0 * F.col("hits") / F.col("tokens"), 6))


def words_per_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("source", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("source").agg(F.count("*").alias("sentences"), F.round(F.avg(F.size(T.split_words(F.col("s")))), 6).alias("words_per_sentence"))


def concordance(spark: SparkSession, d: str) -> DataFrame:
    return C.concordance(texts(spark, d), "budget")


def stem_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Places of every stem in every record."""
    return C.inverted_positions(texts(spark, d), S.word_udf(S.porter))


def stem_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines around the words with the stem of 'closed'."""
    return C.stem_lines(texts(spark, d), "closed", S.word_udf(S.porter), lines=None)


def positional_index(spark: SparkSession, d: str) -> DataFrame:
    return C.inverted_positions(texts(spark, d)).select("stem", "doc_id", F.array_join(F.transform("places", lambda p: p.cast("string")), " ").alias("places"))


def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return C.dispersion(texts(spark, d), ["budget", "council", "lawyer"])


def similar_words(spark: SparkSession, d: str) -> DataFrame:
    return C.similar(texts(spark, d), "budget")


def common_contexts(spark: SparkSession, d: str) -> DataFrame:
    return C.common_contexts(texts(spark, d), ["budget", "council"])


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return C.bigrams(texts(spark, d))


def collocations(spark: SparkSession, d: str) -> DataFrame:
    return C.collocations(texts(spark, d))


def ngram_model(spark: SparkSession, d: str) -> DataFrame:
    return C.ngram_model(texts(spark, d)).withColumn("p", F.round("p", 6))


def token_pattern_search(spark: SparkSession, d: str) -> DataFrame:
    return C.token_pattern(texts(spark, d), ["the", "[a-z]{3,}", "of"])


def hypernym_pairs(spark: SparkSession, d: str) -> DataFrame:
    """'X and the Y' stands for the pattern that the texts have; 'and other' too."""
    return C.hypernyms(texts(spark, d))


def phrase_count(spark: SparkSession, d: str) -> DataFrame:
    """'of the' in each text."""
    return texts(spark, d).select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\bof\s+the\b")).alias("n")).where("n > 0")


def vowel_sequences(spark: SparkSession, d: str) -> DataFrame:
    return C.vowel_sequences(texts(spark, d))


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """60 bins of characters by label."""
    rows = table(spark, d, "news").where("text is not null and label is not null")
    return sampling.histogram(rows, F.length("text").cast("double"), 0.0, 6000.0, 60, "label")


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "news").where("text is not null and label is not null").select("label", F.length("text").alias("chars"), F.size(T.split_words(F.col("text"))).alias("n_words"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.max("chars").alias("max_chars"), F.round(F.avg("n_words"), 6).alias("mean_words"))


QUERIES = {
    f.__name__: f
    for f in (
        freqdist_topn, cond_freqdist, lexical_diversity, word_share, words_per_sentence, concordance, stem_concordance, stem_lines, positional_index, dispersion, similar_words, common_contexts, bigrams, collocations, ngram_model,
        token_pattern_search, hypernym_pairs, phrase_count, vowel_sequences, length_histogram, text_lengths,
    )
}

_W = f"(SELECT rec_id AS doc_id, source, text, {sql.words('text')} AS w FROM news WHERE text IS NOT NULL)"
_POS = f"(SELECT doc_id, i - 1 AS pos, w[i] AS term, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {_W}))"
_BIGRAMS = f"(SELECT term AS a, w[i + 1] AS b, count(*) AS n FROM {_POS} WHERE i < len(w) GROUP BY ALL)"
_CONTEXTS = f"(SELECT term, w[i - 1] AS left_word, w[i + 1] AS right_word, count(*) AS n FROM {_POS} WHERE i > 1 AND i < len(w) GROUP BY ALL)"
_cell = lambda o, e: f"CASE WHEN {o} <= 0 THEN 0.0 ELSE ({o}) * ln(({o}) / ({e})) END"

ORACLE = {
    "freqdist_topn": f"SELECT term, count(*) AS n FROM (SELECT unnest({sql.index_words('text')}) AS term FROM news) GROUP BY term ORDER BY n DESC, term LIMIT 50",
    "cond_freqdist": f"SELECT source, {', '.join(f'CAST(sum(len(list_filter(w, lambda t: t = {chr(39)}{m}{chr(39)}))) AS BIGINT) AS {m}' for m in T.MODALS)} FROM {_W} GROUP BY source",
    "lexical_diversity": f"SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, round(count(*) / CAST(sum(n) AS DOUBLE), 8) AS diversity FROM (SELECT term, count(*) AS n FROM {_POS} GROUP BY term)",
    "word_share": f"SELECT source, CAST(sum(len(list_filter(w, lambda t: t = 'the'))) AS BIGINT) AS hits, CAST(sum(len(w)) AS BIGINT) AS tokens, round(100.0 * sum(len(list_filter(w, lambda t: t = 'the'))) / CAST(sum(len(w)) AS DOUBLE), 6) AS percent FROM {_W} GROUP BY source",
    "words_per_sentence": rf"SELECT source, count(*) AS sentences, round(avg(len(list_filter(string_split_regex(trim(s), '\s+'), lambda t: t <> ''))), 6) AS words_per_sentence FROM (SELECT source, unnest({sql.sentences('text')}) AS s FROM news WHERE text IS NOT NULL) GROUP BY source",
    "concordance": f"SELECT doc_id, CAST(pos AS INT) AS pos, array_to_string(w[greatest(i - 4, 1):i - 1], ' ') AS left_words, term AS word, array_to_string(w[i + 1:i + 4], ' ') AS right_words FROM {_POS} WHERE term = 'budget'",
    "positional_index": f"SELECT term AS stem, doc_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS places FROM {_POS} GROUP BY ALL",
    "dispersion": f"SELECT doc_id, CAST(pos AS INT) AS pos, term AS word FROM {_POS} WHERE term IN ('budget', 'council', 'lawyer')",
    "similar_words": f"WITH c AS {_CONTEXTS} SELECT c.term, count(*) AS shared FROM c JOIN (SELECT left_word, right_word FROM c WHERE term = 'budget') o USING (left_word, right_word) WHERE c.term <> 'budget' GROUP BY c.term ORDER BY shared DESC, c.term LIMIT 20",
    "common_contexts": f"SELECT left_word, right_word FROM {_CONTEXTS} WHERE term IN ('budget', 'council') GROUP BY ALL HAVING count(DISTINCT term) = 2",
    "bigrams": f"SELECT * FROM {_BIGRAMS}",
    "collocations": f"""
      WITH p AS {_BIGRAMS}, t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM p), l AS (SELECT a, sum(n)::BIGINT AS na FROM p GROUP BY a), r AS (SELECT b, sum(n)::BIGINT AS nb FROM p GROUP BY b)
      SELECT a, b, n, round(2 * ({_cell('n', 'na * nb / t')} + {_cell('na - n', 'na * (t - nb) / t')} + {_cell('nb - n', '(t - na) * nb / t')} + {_cell('t - na - nb + n', '(t - na) * (t - nb) / t')}), 4) AS llr
      FROM p JOIN l USING (a) JOIN r USING (b) CROSS JOIN t WHERE n >= 2 AND length(a) >= 3 AND length(b) >= 3 AND a NOT IN {sql.STOP} AND b NOT IN {sql.STOP} ORDER BY llr DESC, a, b LIMIT 20""",
    "ngram_model": f"SELECT a, b, n, round(n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE), 6) AS p FROM {_BIGRAMS}",
    "token_pattern_search": f"SELECT doc_id, CAST(pos AS INT) AS pos, array_to_string(w[i:i + 2], ' ') AS found FROM {_POS} WHERE term = 'the' AND i + 2 <= len(w) AND length(w[i + 1]) >= 3 AND w[i + 2] = 'of'",
    "hypernym_pairs": f"SELECT w[i - 1] AS hyponym, w[i + 2] AS hypernym, count(*) AS n FROM {_POS} WHERE term = 'and' AND w[i + 1] = 'other' AND i > 1 AND i + 2 <= len(w) GROUP BY ALL",
    "phrase_count": rf"SELECT * FROM (SELECT rec_id AS doc_id, CAST(len(regexp_extract_all(lower(text), '\bof\s+the\b')) AS INT) AS n FROM news WHERE text IS NOT NULL) WHERE n > 0",
    "vowel_sequences": f"SELECT seq, count(*) AS n FROM (SELECT unnest(regexp_extract_all(term, '[aeiou]{{2,}}')) AS seq FROM (SELECT DISTINCT term FROM {_POS})) GROUP BY seq",
    "length_histogram": "SELECT label, CAST(CASE WHEN length(text) >= 6000 THEN 61 ELSE floor(length(text) / 100.0) + 1 END AS INT) AS bin, count(*) AS n FROM news WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY ALL",
    "text_lengths": r"""SELECT label, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, CAST(max(length(text)) AS INT) AS max_chars, round(avg(len(list_filter(string_split_regex(trim(text), '\s+'), lambda t: t <> ''))), 6) AS mean_words
      FROM news WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY label""",
}
