"""Units, decimals, boxes and statistics as column expressions (MTH-01 to MTH-17)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.session import small

# Dimensions between which a mismatch is a conflict; critical value of the interval; millimetres of a point.
CONFLICTING = ("power", "pressure", "flow", "ratio")
Z = 1.96
POINT_MM = 25.4 / 72
# Acceptance thresholds; the last is an upper bound.
THRESHOLDS = {
    "character_accuracy": 0.95, "key_field_exact_match": 0.90, "document_linkage": 0.95, "evidence_localization": 0.95, "precision": 0.90, "recall": 0.80, "f1": 0.85,
    "false_positive_rate": 0.10,
}


def decimal(col: Column) -> Column:
    """The number as its shortest decimal notation says it."""
    return F.expr("cast(null as decimal(38,18))") if col is None else col.cast("string").try_cast("decimal(38,18)")


def quantize(col: Column, mode: Column) -> Column:
    """MTH-06: to four places: half_up, half_even, floor, ceil; none leaves it; anything else is half_up."""
    d = decimal(col)
    q = F.when(mode == "half_even", F.bround(d, 4).cast("double")).when(mode == "floor", F.floor(d * 10000).cast("double") / 10000).when(mode == "ceil", F.ceil(d * 10000).cast("double") / 10000).when(mode == "none", col.cast("double"))
    return F.coalesce(q, F.round(d, 4).cast("double"))


def exact_delta(actual: Column, expected: Column) -> Column:
    """MTH-07: difference of the two decimal notations."""
    return (decimal(actual) - decimal(expected)).cast("double")


def to_unit(df: DataFrame, value: str, unit: str, target: str, units: DataFrame) -> DataFrame:
    """MTH-01 to MTH-04: df with `scaled`, `unit_conflict`: the value in the target's unit where both are known and of one dimension, else unchanged.

    A conflict is a difference of dimension that touches power, pressure, flow or ratio.
    """
    a = small(units.select(F.col("canon").alias(unit), F.col("dimension").alias("_da"), F.col("si_factor").alias("_fa")))
    b = small(units.select(F.col("canon").alias(target), F.col("dimension").alias("_db"), F.col("si_factor").alias("_fb")))
    df = df.join(a, unit, "left").join(b, target, "left")
    scaled = F.when(F.col("_da") == F.col("_db"), F.col(value) * F.col("_fa") / F.col("_fb")).otherwise(F.col(value))
    conflict = F.coalesce((F.col("_da") != F.col("_db")) & (F.col("_da").isin(*CONFLICTING) | F.col("_db").isin(*CONFLICTING)), F.lit(False))
    return df.withColumn("scaled", scaled).withColumn("unit_conflict", conflict).drop("_da", "_fa", "_db", "_fb")


def bounds(polygon: Column) -> Column:
    """MTH-08: struct(x0, y0, x1, y1) of an array of struct(x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rows_overlap(a: Column, b: Column) -> Column:
    """MTH-08: the boxes share some height; touching is not sharing."""
    return (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def reading_key(page: Column, box: Column) -> list[Column]:
    """MTH-08, SRT-01: page, then top, then left edge."""
    return [page, F.bround(box["y0"], 4), F.bround(box["x0"], 4)]


def normalized_point(x: Column, y: Column, left: Column, bottom: Column, width: Column, height: Column, rotate: Column) -> Column:
    """MTH-09: a page point in [0, 1] with the origin at the top left, for a page turned by 0, 90, 180 or 270 degrees."""
    u, v = (x - left) / width, 1 - (y - bottom) / height
    turned = F.when(rotate == 90, F.struct((1 - v).alias("x"), u.alias("y"))).when(rotate == 180, F.struct((1 - u).alias("x"), (1 - v).alias("y"))).when(rotate == 270, F.struct(v.alias("x"), (1 - u).alias("y"))).otherwise(F.struct(u.alias("x"), v.alias("y")))

    def clamp(c: Column) -> Column:
        return F.when((c < 0) & (c > -1e-9), 0.0).when((c > 1) & (c < 1 + 1e-9), 1.0).otherwise(c)

    return F.struct(clamp(turned["x"]).alias("x"), clamp(turned["y"]).alias("y"))


def source_point(x: Column, y: Column, left: Column, bottom: Column, width: Column, height: Column, rotate: Column) -> Column:
    """MTH-09: the page point of a normalized one, the way back of normalized_point."""
    u = F.when(rotate == 90, y).when(rotate == 180, 1 - x).when(rotate == 270, 1 - y).otherwise(x)
    v = F.when(rotate == 90, 1 - x).when(rotate == 180, 1 - y).when(rotate == 270, x).otherwise(y)
    return F.struct((left + u * width).alias("x"), (bottom + (1 - v) * height).alias("y"))


def box_iou(a: Column, b: Column) -> Column:
    """MTH-11: shared area of two boxes over their union; 0 where either is flat."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def polygon_iou(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """MTH-10: shared area over union of a polygon and a convex one; 0 for flat or non-finite ones."""

    def area(p):
        return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, [*p[1:], p[0]])) / 2

    if len(a) < 3 or len(b) < 3 or not all(math.isfinite(v) for p in (*a, *b) for v in p) or not area(a) or not area(b):
        return 0.0
    a, b = (list(p) if area(p) > 0 else list(p)[::-1] for p in (a, b))
    kept = a
    for (px, py), (qx, qy) in zip(b, [*b[1:], b[0]]):
        side = lambda p: (qx - px) * (p[1] - py) - (qy - py) * (p[0] - px)  # noqa: B023, E731
        new = []
        for s, e in zip(kept, [*kept[1:], *kept[:1]]):
            u, v = side(s), side(e)
            if u >= 0:
                new.append(s)
            if (u >= 0) != (v >= 0):
                t = u / (u - v)
                new.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
        kept = new
        if len(kept) < 3:
            return 0.0
    shared = abs(area(kept))
    return shared / (area(a) + area(b) - shared)


@F.pandas_udf(T.DoubleType())
def polygons_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """MTH-10 over columns of array<struct<x, y>>."""
    points = lambda s: [(p["x"], p["y"]) for p in s] if s is not None else []
    return pd.Series([polygon_iou(points(x), points(y)) for x, y in zip(a, b)], dtype="float64")


def parallel_pairs(segments: DataFrame, keys: list[str], max_degrees: float = 2, min_overlap: float = 0.6, gap: tuple[float, float] = (2, 60), min_length: float = 20) -> DataFrame:
    """MTH-12: pairs of segments (ix, angle in degrees, lo, hi, offset) of one page that run side by side.

    lo and hi bound the segment along its direction, offset lies across it.  A band of the offset
    is part of the join's key, so that only neighbours meet.
    """
    s = segments.where(F.col("hi") - F.col("lo") >= min_length)
    width = float(gap[1])
    a = s.select(*keys, *(F.col(c).alias(f"{c}_a") for c in ("ix", "angle", "lo", "hi", "offset")), F.explode(F.array(*(F.floor(F.col("offset") / width) + i for i in (-1, 0, 1)))).alias("_band"))
    b = s.select(*keys, *(F.col(c).alias(f"{c}_b") for c in ("ix", "angle", "lo", "hi", "offset")), F.floor(F.col("offset") / width).alias("_band"))
    turn = F.pmod(F.abs(F.col("angle_a") - F.col("angle_b")), F.lit(180.0))
    shared = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
    pair = a.join(b, [*keys, "_band"]).where((F.col("ix_a") < F.col("ix_b")) & (F.least(turn, 180 - turn) <= max_degrees))
    pair = pair.withColumn("gap", F.abs(F.col("offset_a") - F.col("offset_b"))).withColumn("span", shared)
    pair = pair.where(F.col("gap").between(*gap) & (F.col("span") >= min_overlap * F.least(F.col("hi_a") - F.col("lo_a"), F.col("hi_b") - F.col("lo_b"))))
    return pair.select(*keys, "ix_a", "ix_b", "gap", "span")


def width_mm(gap: Column, scale: Column) -> Column:
    """MTH-13: drawn distance in points at scale 1:N, in millimetres."""
    return gap * POINT_MM * scale


def widest_pair(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MTH-13: of each group the pair with the longest span, then the narrower one."""
    return pairs.groupBy(*keys).agg(F.max_by(F.struct("ix_a", "ix_b", "gap", "span"), F.struct(F.col("span"), -F.col("gap"), -F.col("ix_a"), -F.col("ix_b"))).alias("pair")).select(*keys, "pair.*")


def jaccard(a: Column, b: Column) -> Column:
    """MTH-14: shared elements over all elements of two sets; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


#: Upper edge of the stamp on a page.
STAMP = 0.70


def grid_cells(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", cells: int = 16, least: int = 40) -> DataFrame:
    """MTH-14: keys, cells: occupied cells of a grid over [0, 1]² above the stamp, of pages with at least `least` paths, those in the stamp counted."""
    at = lambda c: F.least(F.lit(cells - 1), F.floor(F.col(c) * cells).cast("int"))
    inside = F.col(x).between(0, 1) & F.col(y).between(0, 1) & (F.col(y) < STAMP)
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_set(F.when(inside, at(y) * cells + at(x))).alias("cells"))
    return g.where(F.col("_n") >= least).drop("_n")


def visible(levels: DataFrame, keys: list[str], grey: str = "grey", least: float = 8, samples: int = 16) -> DataFrame:
    """MTH-15: whether grey levels vary enough to be seen; null for fewer than `samples` of them."""
    return levels.groupBy(*keys).agg(F.when(F.count(grey) >= samples, F.stddev_pop(grey) >= least).alias("visible"))


def all_visible(parts: DataFrame, keys: list[str]) -> DataFrame:
    """MTH-15: of several parts (column visible) one hidden makes the whole hidden; else one unknown makes it unknown."""
    return parts.groupBy(*keys).agg(F.when(F.bool_or(~F.col("visible")), False).when(F.count("visible") == F.count(F.lit(1)), True).alias("visible"))


def wilson(k: Column, n: Column) -> dict[str, Column]:
    """MTH-16: rate, low, high and width of the interval of k successes of n; (0, 0, 1) for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = F.coalesce(F.try_divide(k, n), F.lit(0.0))
    d = 1 + F.lit(Z * Z) / n
    mid = (p + F.lit(Z * Z) / (2 * n)) / d
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + F.lit(Z * Z) / (4 * n * n)) / d
    some = n.isNotNull()
    return {"rate": p, "low": F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), "high": F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(1.0)}


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """MTH-17, AGG-19: 0 where nothing is to be found and nothing was."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def meets(metric: Column, low: Column, high: Column) -> Column:
    """MTH-17: the interval's low end reaches the metric's threshold; for false positives the high end stays under it; null for an unknown metric."""
    threshold = F.try_element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), metric)
    return F.when(metric == "false_positive_rate", high <= threshold).otherwise(low >= threshold)
