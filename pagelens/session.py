"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side counts as small enough to be sent to every executor.
BROADCAST_ROWS = 20_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGELENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_pagelens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pagelens-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, "pagelens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._pagelens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; a file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It lies in the folder that the cluster names in spark.checkpoint.dir, so that what is written
    there survives lost executors.  Where none is named, a local session gets a folder of its own,
    removed at its end; on a cluster, whose executors could not share it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="pagelens-checkpoint-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """A table that grows by a part each round, in the shared folder; every round is cut off from the ones before it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.last = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4()}", -1

    def add(self, df: DataFrame) -> None:
        self.last += 1
        self.schema = df.schema
        df.write.parquet(f"{self.folder}/round={self.last}")

    def read(self) -> DataFrame:
        """All rows so far, with the number of their `round`."""
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("round", T.IntegerType())])).parquet(self.folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it is counted to have at most `rows` rows; else leave the join to the planner.

    The count stops at rows + 1, so a large side costs no full pass.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nonblank(col) -> F.Column:
    """The value, or null where it is empty or only blanks of any kind."""
    return F.when(col.rlike(r"(?U)\S"), col)


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, weight: str, hot_rows: int = 100_000, most: int = 1000) -> DataFrame:
    """Inner join of left with right, which has in `weight` the number of the key's rows on the left.

    A key with hot_rows rows or more is split by the hash of `spread` over as many tasks as it
    fills.  The broadcast list holds the `most` heaviest of them, so its size is fixed; a key
    beyond the list has at most 1 / most of all rows, and is joined in one task.
    """
    keys = [key] if isinstance(key, str) else key
    tasks = F.ceil(F.col(weight) / hot_rows).cast("int")
    hot = right.where(F.col(weight) >= hot_rows).groupBy(*keys).agg(F.max(weight).alias(weight))
    hot = hot.orderBy(F.col(weight).desc(), *keys).limit(most).select(*keys, tasks.alias("_tasks"))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_tasks")).cast("int"), F.lit(0))).drop("_tasks")
    copies = right.withColumn("_salt", F.explode(F.when(F.col(weight) >= hot_rows, F.sequence(F.lit(0), tasks - 1)).otherwise(F.array(F.lit(0)))))
    return salted.join(copies.drop(weight), [*keys, "_salt"]).drop("_salt")
