"""The plans of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.tables import table

from . import language, leaks, mixing, near_duplicates, proportions, sentences, split_overlap, term_counts, top_items


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(near_duplicates.news_rows(table(spark, folder, "news")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(near_duplicates.news_rows(table(spark, folder, "news")))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(near_duplicates.news_rows(table(spark, folder, "news")), short=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, folder, "news"), table(spark, folder, "liar"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.classes(table(spark, folder, "news"), table(spark, folder, "liar"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.overlapping(table(spark, folder, "news"), table(spark, folder, "liar"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.report(table(spark, folder, "news"), table(spark, folder, "liar"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("distance").alias("least_distance"), F.max("shared").alias("most_shared"), F.sum(F.col("moved").cast("int")).alias("moved"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    news = sentences.sentence_units(table(spark, folder, "news"), "news", "rec_id", "text")
    return news.unionAll(sentences.sentence_units(table(spark, folder, "evidence"), "evidence", "evid_id", "evidence_sentence"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_terms(spark, folder).where("band <> 'kept'").select("term", "band")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.marked(table(spark, folder, "news"), table(spark, folder, "vocabulario"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items.top_items(top_items.clean_runs(table(spark, folder, "similitudes"))).select("scheme", "qid", "pos", "doc_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_report(spark, folder).where("short").select("subject", "label")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.report(table(spark, folder, "news"), table(spark, folder, "sample_targets"))


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.sample(table(spark, folder, "news"), table(spark, folder, "sample_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p8_margins(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.margins(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.cases(language.segments(table(spark, folder, "documents")))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return language.segments(table(spark, folder, "documents")).select("doc_id", "seg_no", "lang", "confidence", "start", "words")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_classes, p1_groups, p2_found, p3_found, p3_terms, p4_found, p5_found, p5_classes, p5_records, p5_report, p6_found, p6_report, p6_sample, p7_found, p7_leaked_items, p8_found, p8_mix, p8_report, p8_margins, p9_found, p9_documents)
}

P3_TERMS = r"""
WITH found AS (
  SELECT rec_id, unnest(regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '\p{Cf}+', '', 'g')), '[\p{L}\p{M}]+')) AS term FROM news
), counted AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT rec_id) AS records FROM found GROUP BY term
), wanted AS (
  SELECT DISTINCT lower(trim(term)) AS term FROM vocabulario WHERE length(trim(term)) > 0
), total AS (
  SELECT count(text) AS n FROM news
)
SELECT coalesce(c.term, w.term) AS term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
  CASE WHEN records IS NULL THEN 'unused' WHEN records <= 2 THEN 'rare' WHEN records > 0.5 * n THEN 'common' ELSE 'kept' END AS band
FROM counted c FULL JOIN wanted w ON c.term = w.term CROSS JOIN total
"""

P4 = r"""
WITH usable AS (
  SELECT scheme, try_cast(regexp_extract(qid, '(\d+)', 1) AS BIGINT) AS qid, doc_id, max(similitud) AS s
  FROM similitudes WHERE similitud > 0 AND similitud <= 1 AND NOT isnan(similitud) AND doc_id IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT scheme, qid, CAST(row_number() OVER (PARTITION BY scheme, qid ORDER BY s DESC, doc_id) AS INT) AS pos, doc_id FROM usable WHERE qid IS NOT NULL
)
SELECT * FROM ranked WHERE pos <= 5
"""

P6 = r"""
WITH usable AS (
  SELECT id, lower(regexp_replace(subject, '[^\p{L}]', '', 'g')) AS s, label,
    row_number() OVER (PARTITION BY coalesce(id, chr(1) || rec_id) ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS r
  FROM news WHERE regexp_matches(text, '[^\s\x{200B}\x{A0}]') AND regexp_matches(subject, '\S') AND label IS NOT NULL
), have AS (
  SELECT s, label, count(*) AS n FROM usable WHERE r = 1 GROUP BY ALL
), size AS (
  SELECT floor(sum(n) / 5) AS n FROM have
)
SELECT t.subject, t.label FROM sample_targets t CROSS JOIN size
LEFT JOIN have h ON h.s = lower(regexp_replace(t.subject, '[^\p{L}]', '', 'g')) AND h.label = t.label
WHERE coalesce(h.n, 0) < t.target_share * size.n OR coalesce(h.n, 0) < t.min_rows
"""

# Words of problems 1, 5 and 7. NFKC by NFC and, as DuckDB has no more, the compatibility characters of these tables.
_SPACE = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"


def _words(x: str) -> str:
    folded = f"translate(replace(replace(nfc_normalize({x}), '№', 'No'), 'ำ', 'ํา'), '０１２３４５６７８９º', '0123456789o')"
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({folded}), '[^\p{{L}}\p{{M}}\p{{N}}{_SPACE}]+', '', 'g'), '[{_SPACE}]+'), lambda w: w <> '')"


def _grams(k: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"list_sort(list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {joined})))"


def _overlaps(sets: str, which: str) -> str:
    """Pairs (a, b) of ``sets`` (key, side, tbl, g) whose overlap is a half or more."""
    one = f"(SELECT key, side, tbl, len(g) AS n, unnest(g) AS t FROM {sets})"
    return f"""SELECT a, b FROM (SELECT x.key AS a, y.key AS b, x.n AS na, y.n AS nb, count(*) AS c FROM {one} x JOIN {one} y ON x.t = y.t AND x.tbl = y.tbl AND x.key < y.key AND {which} GROUP BY ALL) WHERE 2 * c >= na + nb - c"""


_TITLE_AND_TEXT = "coalesce(title, '') || ' ' || text"
_SIDE = "CASE lower(trim(split)) WHEN 'train' THEN 0 WHEN 'valid' THEN 1 WHEN 'test' THEN 1 END"
P1_SETS = rf"""SELECT rec_id AS key, 0 AS side, 0 AS tbl, {_grams(3)} AS g FROM (SELECT rec_id, {_words(_TITLE_AND_TEXT)} AS w FROM news WHERE regexp_matches(text, '[^{_SPACE}]')) WHERE len(w) >= 20"""
P5_SETS = f"""SELECT rec_id AS key, side, tbl, {_grams(3)} AS g FROM (SELECT rec_id, 0 AS tbl, {_SIDE} AS side, {_words('text')} AS w FROM news
  UNION ALL SELECT rec_id, 1, {_SIDE}, {_words('statement')} FROM liar) WHERE len(w) >= 10 AND side IS NOT NULL"""


def _classes(sets: str, which: str) -> str:
    return f"""WITH s AS MATERIALIZED ({sets}), c AS MATERIALIZED (SELECT min(key) AS key, side, tbl, g, count(*) AS copies FROM s GROUP BY side, tbl, g),
  p AS ({_overlaps("c", which)}), l AS (SELECT key, count(*) AS links FROM (SELECT a AS key FROM p UNION ALL SELECT b FROM p) GROUP BY key)
SELECT s.key AS rec_id, c.key AS class_id, copies, coalesce(links, 0)::BIGINT AS links FROM s JOIN c ON s.side = c.side AND s.tbl = c.tbl AND s.g = c.g LEFT JOIN l ON l.key = c.key"""


P7 = f"""
WITH p AS (SELECT item_id, len(g) AS n, unnest(g) AS t FROM (SELECT item_id, {_grams(4)} AS g FROM (SELECT item_id, {_words('text')} AS w FROM eval_items) WHERE len(w) >= 4)),
d AS (SELECT doc_id, unnest({_grams(4)}) AS t FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) >= 4)
SELECT item_id, doc_id FROM p JOIN d USING (t) GROUP BY item_id, doc_id, n HAVING 2 * count(*) >= n
"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH s AS MATERIALIZED ({P1_SETS}) SELECT a AS rec_a, b AS rec_b FROM ({_overlaps('s', 'true')})",
    "p1_classes": _classes(P1_SETS, "true"),
    "p5_found": f"WITH s AS MATERIALIZED ({P5_SETS}) SELECT a AS rec_a, b AS rec_b FROM ({_overlaps('s', 'x.side <> y.side')})",
    "p5_classes": _classes(P5_SETS, "x.side <> y.side"),
    "p7_found": P7,
    "p3_terms": P3_TERMS,
    "p3_found": f"SELECT term, band FROM ({P3_TERMS}) WHERE band <> 'kept'",
    "p4_found": P4,
    "p6_found": P6,
}
