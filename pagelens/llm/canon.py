"""One form for text that looks the same in print, by SQL that DuckDB runs inside Arrow partitions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import cut_lineage, skew_join

# Fixed values, as classes of a regular expression: characters without width or ink, blanks, hyphens.
INVISIBLE = r"[\x{00}-\x{08}\x{0e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}]"
BLANKS = r"[\x{09}-\x{0d}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HYPHENS = r"[\x{2010}\x{2011}\x{fe63}\x{ff0d}]"
# Cyrillic and Greek letters with the shape of a Latin one, and that Latin letter.
SHAPES = "АВЕЅІЈКМНОРСТХасеѕіјорхуΑΒΕΖΗΙΚΜΝΟΡΤΧο"
LATIN = "ABESIJKMHOPCTXacesijopxyABEZHIKMNOPTXo"
# Latin letters that stand for a Cyrillic one of the same shape, for values otherwise in Cyrillic.
TO_CYRILLIC = ("ABESIJKMHOPCTXacesijopxyëËïÏ", "АВЕЅІЈКМНОРСТХасеѕіјорхуёЁїЇ")


@functools.cache
def width_forms() -> tuple[str, str]:
    """All characters of another width than usual, and the usual ones, by Unicode's own decomposition."""
    wide, usual = [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        kind, _, code = unicodedata.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>") and " " not in code:
            wide.append(c)
            usual.append(chr(int(code, 16)))
    return "".join(wide), "".join(usual)


def canonical_query(source: str, column: str, fast: bool = True) -> str:
    """DuckDB query for all columns of source and `canonical`, the printed form of one of them.

    Removed or unified are characters without ink, blanks at the ends, kinds of blank and hyphen,
    width forms, composed or separate accents, and alphabets of letters of one shape.  Case, raised
    digits, punctuation and the number of inner blanks stay.  A value with any letter that only
    Cyrillic has comes out in Cyrillic, any other in Latin letters.

    Values of plain Cyrillic, digits and marks are their own form but for outer blanks, which one
    test finds (fast); the others go through every step.
    """
    wide, usual = ("'" + s.replace("'", "''") + "'" for s in width_forms())
    own = "".join(chr(c) for c in range(0x410, 0x450) if chr(c) not in SHAPES)
    plain = rf"coalesce(regexp_full_match(x_v, '[ !-@\[-`{{-~А-Яа-яЁё№²³—‰]*') AND regexp_matches(x_v, '[{own}]'), false)" if fast else "false"
    back = f"translate(x_v, '{TO_CYRILLIC[0]}', '{TO_CYRILLIC[1]}')"
    steps = [
        f"regexp_replace(x_v, '{INVISIBLE}', '', 'g')",
        rf"CASE WHEN regexp_matches(x_v, '[\x{{3000}}-\x{{303f}}\x{{3131}}-\x{{318e}}\x{{ff01}}-\x{{ffee}}]') THEN regexp_replace(translate(x_v, {wide}, {usual}), '{INVISIBLE}', '', 'g') ELSE x_v END",
        f"regexp_replace(regexp_replace(x_v, '{BLANKS}', ' ', 'g'), '{HYPHENS}', '-', 'g')",
        f"nfc_normalize(translate(nfc_normalize(x_v), '{SHAPES}ёЁїЇ', '{LATIN}ëËïÏ'))",
        rf"CASE WHEN regexp_matches(x_v, '[\x{{400}}-\x{{52f}}]') THEN {back} ELSE x_v END",
    ]
    q = f"SELECT *, {column} AS x_v FROM {source}"
    q = f"SELECT *, {plain} AS x_plain FROM ({q})"
    for step in steps:
        q = f"SELECT * EXCLUDE (x_v), CASE WHEN x_plain THEN x_v ELSE {step} END AS x_v FROM ({q})"
    return f"SELECT * EXCLUDE (x_v, x_plain), trim(x_v, ' ') AS canonical FROM ({q})"


def canonicalize(df: DataFrame, column: str = "value") -> DataFrame:
    """df with `canonical`, the printed form of a text column.

    Each Arrow batch of a partition is handed to a DuckDB connection of one thread.  Null gives
    null, empty and blank texts give ''.  Texts of any length are taken whole; other columns,
    whatever their names, pass through (an existing `canonical` is replaced).
    """
    df = df.drop("canonical")
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    query = canonical_query("batch", f"c{names.index(column)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                result = con.sql(query).to_arrow_table() if hasattr(duckdb.DuckDBPyRelation, "to_arrow_table") else con.sql(query).arrow()
                yield from pa.table(result).to_batches()
                con.unregister("batch")
        finally:
            con.close()

    schema = ", ".join([*(f"{c} {t}" for c, t in plain.dtypes), "canonical string"])
    return plain.mapInArrow(run, schema).toDF(*names, "canonical")


SAME = ["field", "grp", "canonical"]


def _canonical_rows(rows: DataFrame) -> DataFrame:
    """The rows with their printed form, found once and written to the shared folder."""
    return cut_lineage(canonicalize(rows.where("grp is not null and key is not null and value is not null").select("field", "grp", "key", "value")))


def print_classes(rows: DataFrame) -> DataFrame:
    """field, grp, canonical, n_strings, n_records: the classes of equal print of a group that more than one string has.

    One row per class, however many records it has; null groups, keys and values are left out.
    """
    n = _canonical_rows(rows).groupBy(*SAME, "value").agg(F.countDistinct("key").alias("n"))
    return n.groupBy(*SAME).agg(F.count(F.lit(1)).alias("n_strings"), F.sum("n").alias("n_records")).where("n_strings > 1")


def equal_in_print(rows: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """field, key_a, key_b (key_a < key_b): pairs of records of one group whose values print the same but differ as strings.

    rows: field, grp, key, value.  Groups are first reduced to the printed forms that more than one
    string has; pairs are made of the distinct strings of those, and records joined to them, so
    that the work follows the pairs that come out and not the square of a group.  A string that
    many records have is split over several tasks in these joins.  Null groups, keys and values are
    left out; repeated rows count once.
    """
    rows = _canonical_rows(rows)
    mixed = rows.groupBy(*SAME).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*SAME)
    part = cut_lineage(rows.join(mixed, SAME).select(*SAME, "key", "value").distinct())
    strings = part.groupBy(*SAME, "value").agg(F.count(F.lit(1)).alias("n"))
    pairs = strings.withColumnsRenamed({"value": "va", "n": "na"}).join(strings.withColumnsRenamed({"value": "vb", "n": "nb"}), SAME).where("va < vb")
    side = lambda s: part.select(*SAME, F.col("value").alias(f"v{s}"), F.col("key").alias(f"k{s}"))
    pairs = skew_join(side("a"), pairs, [*SAME, "va"], "ka", "na", hot_rows)
    pairs = skew_join(side("b"), pairs, [*SAME, "vb"], "kb", "nb", hot_rows)
    return pairs.where("ka <> kb").select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def printed_values(files: DataFrame, checks: DataFrame) -> DataFrame:
    """field, grp, key, value of document_code per object and stage, and of location and pd_value per group of findings."""
    code = files.select(F.lit("document_code").alias("field"), F.when(F.col("object_id").isNotNull() & F.col("doc_stage").isNotNull(), F.concat_ws("\x1f", "object_id", "doc_stage")).alias("grp"), F.col("id").alias("key"), F.col("document_code").alias("value"))
    rest = checks.select(F.col("finding_group_id").alias("grp"), F.col("check_id").alias("key"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("location", "pd_value")))).alias("x"))
    return code.unionByName(rest.select("x.field", "grp", "key", "x.value"))
