"""Queries pN_ of the text problems, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import canon, packing, readability, tokenizer
from pagelens.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.equal_in_print(canon.printed_values(table(spark, d, "files"), table(spark, d, "public_checks")))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every document_code, location and pd_value; a record delivered twice counts once."""
    rows = canon.printed_values(table(spark, d, "files"), table(spark, d, "public_checks")).where("key is not null")
    return canon.canonicalize(rows.select("field", "key", "value")).select("field", "key", "canonical").distinct()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of equal print that have several strings, each with its numbers of strings and records."""
    return canon.print_classes(canon.printed_values(table(spark, d, "files"), table(spark, d, "public_checks"))).select("field", "canonical", "n_strings", "n_records")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "byte_bpe_50k")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per document the number of ids and whether they decode to the text; null counts as empty."""
    docs = table(spark, d, "documents")
    ids = tokenizer.encode(docs.select("doc_id", "text"), "byte_bpe_50k")
    back = tokenizer.decode(ids, "byte_bpe_50k").withColumnRenamed("text", "back")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    names = [r[0] for r in targets.where("tokenizer is not null").select("tokenizer").distinct().orderBy("tokenizer").collect()]
    return packing.pack(packing.items(tokenizer.count_tokens(table(spark, d, "documents"), names), targets))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("target_id", "container_id", "doc_id", "piece", "n_tokens")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_packed(spark, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return readability.reading_level(docs, readability.train(docs, table(spark, d, "graded_passages")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("demanding").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by source and level."""
    levels = _levels(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return levels.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("words_per_sentence").alias("words_per_sentence"), F.avg("unfamiliar_share").alias("unfamiliar_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_canonical, p2_classes, p6_ids, p6_round_trip, p7_packing, p7_report, p8_found, p8_levels, p8_profile)}

# Written from the statement of the problem, by Unicode's categories and one letter table, not by the operator's own steps.
_P2 = r"""
WITH vals AS (
  SELECT 'document_code' AS field, object_id || chr(31) || doc_stage AS grp, id AS key, document_code AS value FROM files
  UNION SELECT 'location', finding_group_id, check_id, location FROM public_checks
  UNION SELECT 'pd_value', finding_group_id, check_id, pd_value FROM public_checks),
w AS (SELECT field, grp, key, value, nfc_normalize(array_to_string(list_transform(string_split(value, ''), lambda c: CASE
    WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
    WHEN regexp_matches(c, '^[\p{Cf}\x{34f}\x{fe00}-\x{fe0f}]$') THEN ''
    WHEN regexp_matches(c, '^[\p{Zs}\p{Zl}\p{Zp}\t\n\v\f\r]$') THEN ' '
    WHEN c IN ('‐', '‑', '－', '﹣') THEN '-' ELSE c END), '')) AS x FROM vals),
l AS (SELECT *, translate(x, 'АВЕКМНОРСТХЅІЈасеорхуѕіјЁёЇїΑΒΕΖΗΙΚΜΝΟΡΤΧο', 'ABEKMHOPCTXSIJaceopxysijËëÏïABEZHIKMNOPTXo') AS y FROM w),
forms AS (SELECT field, grp, key, value, trim(CASE WHEN regexp_matches(y, '\p{Cyrillic}') THEN translate(y, 'ABEKMHOPCTXSIJaceopxysijËëÏï', 'АВЕКМНОРСТХЅІЈасеорхуѕіјЁёЇї') ELSE y END, ' ') AS canonical FROM l)
"""

SQL = {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p2_found": _P2
    + "SELECT DISTINCT a.field, least(a.key, b.key) AS key_a, greatest(a.key, b.key) AS key_b FROM forms a JOIN forms b ON a.field = b.field AND a.grp = b.grp AND a.canonical = b.canonical AND a.value < b.value AND a.key <> b.key",
    "p2_canonical": _P2 + "SELECT DISTINCT field, key, canonical FROM forms WHERE key IS NOT NULL",
    "p2_classes": _P2 + "SELECT field, canonical, count(DISTINCT value) AS n_strings, count(DISTINCT (value, key)) AS n_records FROM forms WHERE grp IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL GROUP BY field, grp, canonical HAVING count(DISTINCT value) > 1",
}
