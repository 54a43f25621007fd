"""Sinks (SNK-01 to SNK-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(checks: DataFrame) -> DataFrame:
    """SNK-01, AGG-14: object_id, submission: JSON with the distinct checks of each object in order of code and location.

    An object's checks come together in its one document, which is what the format asks for.
    """
    cols = [c for c in checks.columns if c != "object_id"]
    order = [c for c in ("parameter_code", "location") if c in cols]
    row = F.struct(*order, *[c for c in cols if c not in order])
    g = checks.distinct().groupBy("object_id").agg(F.array_sort(F.collect_list(row)).alias("checks"))
    return g.select("object_id", F.to_json(F.struct("object_id", "checks")).alias("submission"))


def write_submissions(checks: DataFrame, path: str) -> None:
    submission(checks).write.mode("overwrite").partitionBy("object_id").text(path)


def protocol_json(rows: DataFrame, id_: str) -> DataFrame:
    return rows.select(F.col(id_), F.to_json(F.struct(*[c for c in sorted(rows.columns)])).alias("json"))


def protocol_xml(rows: DataFrame, id_: str, tag: str = "finding") -> DataFrame:
    """SNK-02: one element per row, from the same columns as the JSON; null fields are left out."""

    def escape(c):
        return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    fields = [F.coalesce(F.concat(F.lit(f"<{c}>"), escape(F.col(c)), F.lit(f"</{c}>")), F.lit("")) for c in sorted(rows.columns)]
    return rows.select(F.col(id_), F.concat(F.lit(f"<{tag}>"), *fields, F.lit(f"</{tag}>")).alias("xml"))


def by_object(rows: DataFrame, path: str) -> None:
    """SNK-03: a folder of JSON lines for each object; an object of many rows is split over several files and tasks, by adaptive execution."""
    rows.hint("rebalance", "object_id").write.mode("overwrite").partitionBy("object_id").json(path)


def run_manifest(index: DataFrame, errors: DataFrame) -> DataFrame:
    """SNK-03: one JSON text: files read, those skipped by reason, and failures by error, of a run.

    index: reason (null for files read); errors: error.  Only their counts are brought together.
    """
    tally = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias("m")).withColumn("_one", F.lit(1))
    read = index.where("reason is null").agg(F.count(F.lit(1)).alias("read")).withColumn("_one", F.lit(1))
    skipped, failed = tally(index.where("reason is not null"), "reason").withColumnRenamed("m", "skipped"), tally(errors.where("error is not null"), "error").withColumnRenamed("m", "failed")
    return read.join(skipped, "_one").join(failed, "_one").select(F.to_json(F.struct("read", "skipped", "failed")).alias("json"))


def params_csv(params: DataFrame, path: str) -> None:
    """SNK-05."""
    params.write.mode("overwrite").option("header", True).csv(path)


def publish(stream: DataFrame, send, checkpoint: str):
    """SNK-04: hand each micro-batch to `send(rows, batch_id)`; a batch that raises is handed over again."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-06: one JSON text per row of an aggregate, under its keys."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in sorted(rows.columns) if c not in keys])).alias("json"))
