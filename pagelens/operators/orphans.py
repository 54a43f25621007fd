"""References to records that do not exist, are gone, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import nonblank, skew_join


def file_times(files: DataFrame) -> DataFrame:
    """id, first uploaded_at, and the distinct non-blank links of all deliveries of a file."""
    return files.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min("uploaded_at").alias("at"),
        F.collect_set(nonblank(F.col("predecessor_id"))).alias("predecessors"),
        F.collect_set(nonblank(F.col("successor_id"))).alias("successors"),
    )


def file_references(once: DataFrame, checks: DataFrame) -> DataFrame:
    """src_table, rec_id, ref_field, ref_id, at: one row per record, field and file id referred to.  once: as file_times gives it."""
    links = [once.select(F.lit("files").alias("src_table"), F.col("id").alias("rec_id"), F.lit(field).alias("ref_field"), F.explode(column).alias("ref_id"), "at") for field, column in (("predecessor_id", "predecessors"), ("successor_id", "successors"))]
    named = checks.where(F.col("check_id").isNotNull()).select("check_id", "recorded_at", F.explode("evidence.file_id").alias("ref_id")).where(nonblank(F.col("ref_id")).isNotNull())
    named = named.groupBy("check_id", "ref_id").agg(F.min("recorded_at").alias("at"))
    named = named.select(F.lit("public_checks").alias("src_table"), F.col("check_id").alias("rec_id"), F.lit("evidence.file_id").alias("ref_field"), "ref_id", "at")
    return links[0].unionByName(links[1]).unionByName(named)


def orphan_references(refs: DataFrame, parents: DataFrame, removed: DataFrame, timeless: tuple[str, ...] = ("successor_id",), hot_rows: int = 100_000) -> DataFrame:
    """src_table, rec_id, ref_field, ref_id, kind, period of every reference that fails.

    refs: src_table, rec_id, ref_field, ref_id, at; parents: id, at (one row per id);
    removed: id.  The distinct keys are anti-joined against the parents, the orphans split
    into deleted and missing by the removals, and the verdict of each key joined back to the
    rows that name it; a key named by a large share of the rows is salted in that join.

    kind is `late` for a parent later than the record (never for fields in timeless); a null
    time on either side is not late.  A null time of the record gives a null period.  Null and
    blank keys are no references.  Repeated rows give one row; empty tables give none.
    """
    refs = refs.where(nonblank(F.col("ref_id")).isNotNull())
    keys = refs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("named"))
    parent = parents.select(F.col("id").alias("ref_id"), F.col("at").alias("parent_at"))
    gone = removed.select(F.col("id").alias("ref_id")).where(F.col("ref_id").isNotNull()).distinct().withColumn("gone", F.lit(True))
    orphans = keys.join(parent, "ref_id", "left_anti").join(gone, "ref_id", "left").select("ref_id", "named", F.when(F.col("gone"), "deleted").otherwise("missing").alias("verdict"), F.lit(None).cast("timestamp_ntz").alias("parent_at"))
    found = keys.join(parent, "ref_id").select("ref_id", "named", F.lit(None).cast("string").alias("verdict"), F.col("parent_at").cast("timestamp_ntz").alias("parent_at"))
    rows = skew_join(refs, orphans.unionByName(found), "ref_id", "rec_id", "named", hot_rows)
    late = (F.col("parent_at") > F.col("at").cast("timestamp_ntz")) & ~F.col("ref_field").isin(*timeless)
    kind = F.coalesce("verdict", F.when(late, "late"))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("src_table", "rec_id", "ref_field", "ref_id", "kind", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Failing references and distinct missing keys per table, field, kind and period."""
    return found.groupBy("src_table", "ref_field", "kind", "period").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_keys"), F.countDistinct("rec_id").alias("n_records"))
