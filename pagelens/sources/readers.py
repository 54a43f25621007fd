"""Sources (SRC-01 to SRC-15)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.text import rule_code, stage_token
from pagelens.operators.intake import RATIO, UNPACKED_BYTES
from pagelens.session import small

RULE = "code string, title string, section string, unit string, matrix_version string, coverage string, stages_required array<string>, extractor struct<type: string, regex: string, anchors: array<string>, normalization: array<string>, dual_read_required: boolean>, comparator struct<operator: string, value: string, min_value: double, max_value: double, tolerance_abs: double, tolerance_rel: double, rounding: string, unit_target: string>, failure_mapping map<string, string>"
# Coverages of a rule; greatest number of words of an XML file and of documents in a container.
COVERAGES = ("executable", "extractor_missing", "source_missing", "not_applicable", "advisory")
MAX_WORDS, MAX_MEMBERS = 8000, 40


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01: one JSON file per rule, with `error` where a code is not canonical or repeated, the coverage unknown or versions are mixed."""
    r = spark.read.schema(RULE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    n = r.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    versions = r.select("matrix_version").where("matrix_version is not null").distinct().limit(2).count()
    j = r.join(small(n), "code", "left").withColumn("versions", F.lit(versions))
    error = F.when(F.col("code").isNull() | (rule_code(F.col("code")) != F.col("code")), "code").when(F.col("n") > 1, "duplicate").when(~F.coalesce(F.col("coverage").isin(*COVERAGES), F.lit(False)), "coverage").when(F.col("versions") > 1, "version")
    return j.withColumn("error", error).drop("n", "versions")


def free_search(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: the entries; all must be MATRIX_GAP."""
    e = spark.read.schema("entries array<struct<code: string, kind: string, title: string, anchors: array<string>>>").option("multiLine", True).json(path)
    return e.select(F.explode("entries").alias("e")).select("e.*").withColumn("error", F.when(~F.col("kind").eqNullSafe("MATRIX_GAP"), "kind"))


def files_index(spark: SparkSession, path: str, hidden: tuple[str, ...] = (), present: DataFrame | None = None) -> DataFrame:
    """SRC-03: one JSON object a line; rows that can't be used keep a reason; a repeated file_id of an object gets a suffix from its path's hash.

    A MIXED stage is resolved from the file's name and first_page, where the line has one; what can't
    be resolved has the reason `stage`.  With present (path) files that are not there are `missing`.
    """
    x = spark.read.schema("object_id string, stage string, file_id string, path string, document_code string, section string, first_page string").json(path)
    x = x.withColumn("stage", stage_token(F.col("stage"), F.col("path"), F.coalesce("first_page", F.lit("")))).drop("first_page")
    x = x.withColumn("_there", F.lit(True)) if present is None else x.join(present.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    reason = F.when(F.col("object_id").isin(*hidden) if hidden else F.lit(False), "hidden").when(F.col("stage").isNull(), "stage").when(F.col("path").isNull() | F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "path").when(F.col("_there").isNull(), "missing")
    place = F.row_number().over(Window.partitionBy("object_id", "file_id").orderBy("path"))
    return x.withColumn("reason", reason).drop("_there").withColumn("file_id", F.when(place > 1, F.concat_ws("-", "file_id", F.left(F.sha2("path", 256), F.lit(8)))).otherwise(F.col("file_id")))


def folder(spark: SparkSession, root: str) -> DataFrame:
    """SRC-04: object/stage/**: path, object_id, stage, size, content of pdf, docx, xml and zip files."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,docx,xml,zip}").load(root)
    rest = F.split(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", ""), "/")
    return b.select("path", rest[0].alias("object_id"), F.when(F.size(rest) > 2, F.upper(rest[1])).alias("stage"), F.col("length").alias("size"), "content").where(F.col("stage").isin("PD", "RD", "ID"))


def _is_bomb(z: zipfile.ZipFile) -> bool:
    infos = z.infolist()
    return sum(i.file_size for i in infos) > UNPACKED_BYTES or any(i.file_size > RATIO * max(1, i.compress_size) for i in infos)


def _members(content: bytes) -> list[tuple[str, bytes | None, str | None]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in z.infolist() if not i.is_dir()]
        if _is_bomb(z):
            return [("", None, "bomb")]
        out = []
        for i in infos[:MAX_MEMBERS]:
            safe = not (i.filename.startswith("/") or ".." in i.filename.split("/"))
            out.append((i.filename, z.read(i) if safe else None, None if safe else "unsafe_name"))
        return out + [(i.filename, None, "too_many") for i in infos[MAX_MEMBERS:]]
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return [("", None, "corrupted")]


def expand_zip(files: DataFrame) -> DataFrame:
    """SRC-08: file_id, name, content, error of the members of archives (file_id, content); bombs, unsafe names and broken archives are rows with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{f}__{n}", name, data, error) for f, c in zip(b["file_id"], b["content"]) for n, (name, data, error) in enumerate(_members(c) if c is not None else [("", None, "corrupted")])]
            yield pd.DataFrame(rows, columns=["file_id", "name", "content", "error"])

    return files.select("file_id", "content").mapInPandas(run, "file_id string, name string, content binary, error string")


def _document_text(content: bytes | None, kind: str) -> tuple[str | None, str | None]:
    from xml.etree import ElementTree

    try:
        data = content or b""
        if kind == "docx":
            z = zipfile.ZipFile(io.BytesIO(data))
            if _is_bomb(z):
                return None, "bomb"
            data = z.read("word/document.xml")
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            return None, "entities"
        root = ElementTree.fromstring(data)
        if kind == "docx":
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
        else:
            text = "\n".join(t.strip() for t in root.itertext() if t.strip())
        return (None, "too_long") if kind == "xml" and len(text.split()) > MAX_WORDS else (text, None)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return None, "corrupted"


def document_text(files: DataFrame) -> DataFrame:
    """SRC-06, SRC-07: file_id, text, error of DOCX and XML contents (file_id, name, content); markup with entities, broken and overlong files are errors.

    Tokens follow from extract.tokens_of_text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_document_text(c, str(n).rsplit(".", 1)[-1].lower()) for n, c in zip(b["name"], b["content"])]
            yield pd.DataFrame({"file_id": b["file_id"], "text": [t for t, _ in out], "error": [e for _, e in out]})

    return files.select("file_id", "name", "content").mapInPandas(run, "file_id string, text string, error string")


def gold(spark: SparkSession, path: str, labels: tuple[str, ...] = ("VIOLATION_PRESENT", "NO_VIOLATION", "COMPARISON_IMPOSSIBLE")) -> DataFrame:
    """SRC-09: checks with known label; unknown labels and missing objects are errors; fpr_denominator marks the negatives, source_sha the files they come from."""
    g = spark.read.schema("check_id string, object_id string, parameter_code string, location string, matrix_scope string, violation_label string, score_eligible boolean, split string").json(path)
    raw = spark.read.format("binaryFile").load(path).agg(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), ",").alias("source_sha")).withColumn("_one", F.lit(1))  # the files' hashes, a row
    return g.withColumn("_one", F.lit(1)).join(raw, "_one").drop("_one").withColumn("fpr_denominator", F.col("violation_label") == "NO_VIOLATION").withColumn("error", F.when(F.col("object_id").isNull(), "object").when(~F.coalesce(F.col("violation_label").isin(*labels), F.lit(False)), "label"))


def frozen_validation(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: strict booleans; a bad line fails the read."""
    return spark.read.schema("object_id string, rule_code string, gold_positive boolean, predicted_positive boolean").option("mode", "FAILFAST").json(path)


def recognition_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: lines with flags VERTICAL and LOW_QUALITY from orientation and encoding."""
    x = spark.read.schema("line_id string, page_id string, object_id string, text_raw string, orientation string, encoding_flags array<string>, bbox array<double>").json(path)
    return x.withColumn("flags", F.array_compact(F.array(F.when(F.col("orientation") == "vertical", "VERTICAL"), F.when(F.size("encoding_flags") > 0, "LOW_QUALITY"))))


def cached_by_hash(fresh: DataFrame, cache: DataFrame, now: F.Column, ttl_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """SRC-15: (rows of the cache still valid for the hashes asked for, hashes to read anew)."""
    valid = cache.where(F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= ttl_s)
    return valid.join(fresh.select("file_hash").distinct(), "file_hash", "left_semi"), fresh.join(valid.select("file_hash").distinct(), "file_hash", "left_anti")


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """SRC-13: the table at `path` with rows of `new` in place of those of the same keys; written by the caller to a new folder, since Parquet has no merge."""
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a table that isn't there yet is none
            raise
        return new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def normative_registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: versions of norms, one JSON object a line; `error` for a missing id or an end before the start."""
    x = spark.read.schema("norm_id string, version string, effective_from date, expires_at date, signed boolean").json(path)
    return x.withColumn("error", F.when(F.col("norm_id").isNull(), "norm_id").when(F.col("expires_at") < F.col("effective_from"), "dates"))
