"""Filling containers of fixed capacity: best-fit decreasing, certified by lower bounds, repacked where gaps remain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import cut_lineage, small

#: Items that one task packs, about.
PART_ITEMS = 40_000
#: Rounds of exchange at most; each must save a container, and those after the first few save next to nothing.
ROUNDS = 8
#: Size-by-threshold values computed at once for the bound.
BLOCK = 1 << 21
PACKED = "target_id int, capacity int, part bigint, doc_id bigint, piece int, n_tokens int, bin int, used int, bins int, bound int"


def items(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, capacity, doc_id, piece, n_tokens: each document as one item, or, if it alone exceeds the capacity, as full pieces and a rest.

    sizes: doc_id, tokenizer, n_tokens.  Targets of null or non-positive capacity get nothing.
    """
    t = small(targets.where("capacity > 0").select("target_id", "tokenizer", F.col("capacity").cast("int").alias("capacity")))
    x = sizes.join(t, "tokenizer").where("n_tokens is not null")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return x.select("target_id", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece").cast("bigint") * F.col("capacity")).cast("int").alias("n_tokens"))


def histogram_bound(s: np.ndarray, n: np.ndarray, capacity: int, enough: int | None = None) -> int:
    """Containers that any packing of n[i] items of each size s[i] needs: the best of three families of dual feasible functions, each with all its parameters.

    The thresholds of the second and third are all the sizes up to half the capacity, since between
    two sizes the functions are the same or weaker.  Nothing more is tried once the bound is `enough`.
    """
    s, n = s[s > 0].astype("int64"), n[s > 0].astype("int64")
    if not len(s):
        return 0
    best = -(-int((s * n).sum()) // capacity)
    if best == enough:
        return best
    for k in range(1, 21):  # round down to k-ths, keep exact multiples
        whole = ((k + 1) * s) % capacity == 0
        value = np.where(whole, s * k, (((k + 1) * s) // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    cuts = np.unique(s[s * 2 <= capacity])
    rows = max(1, BLOCK // len(s))
    for i in range(0, len(cuts), rows):
        if best == enough:
            break
        e = cuts[i : i + rows, None]
        # small items vanish, and what only they fit beside is full
        value = np.where(s > capacity - e, capacity, np.where(s < e, 0, s))
        best = max(best, int((-(-(value @ n) // capacity)).max()))
        # a large item counts by how few small ones fit beside it
        half = np.where(2 * s > capacity, 2 * (capacity // e - (capacity - s) // e), np.where(s >= e, np.where(2 * s == capacity, capacity // e, 2 * (s // e)), 0))
        best = max(best, int((-(-(half @ n) // (2 * (capacity // e[:, 0])))).max()))
    return best


def lower_bound(sizes: np.ndarray, capacity: int, enough: int | None = None) -> int:
    return histogram_bound(*np.unique(sizes.astype("int64"), return_counts=True), capacity, enough)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, and the amount in each container; items of size 0 go to the first container."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), dtype="int32")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, used = 0, []
    for i in order.tolist():
        size = int(sizes[i])
        if size == 0:
            if not used:
                used.append(0)
            continue
        fit = some >> size
        if fit:
            gap = (fit & -fit).bit_length() - 1 + size
            b = room[gap].pop()
            if not room[gap]:
                some &= ~(1 << gap)
        else:
            b, gap = len(used), capacity
            used.append(0)
        used[b] += size
        bins[i] = b
        if gap > size:
            room[gap - size].append(b)
            some |= 1 << (gap - size)
    return bins, np.asarray(used, dtype="int32")


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", na_position="last")
    sizes = pdf["n_tokens"].to_numpy(dtype="int64")
    bins, used = best_fit_decreasing(sizes, capacity)
    bound = max(lower_bound(sizes, capacity, len(used)), int(len(used) > 0 and not sizes.any()))
    return pdf.assign(bin=bins, used=used[bins], bins=len(used), bound=bound)[[c.split()[0] for c in PACKED.split(", ")]]


def _pack_parts(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy("target_id", "part").applyInPandas(_pack, PACKED))


def _spread(rows: DataFrame, by: list, counts: dict, part_items: int) -> tuple[DataFrame, dict]:
    """rows with `part`, by the hash of `by`, as many parts of a target as its items fill; and these numbers."""
    parts = {t: max(1, -(-n // part_items)) for t, n in counts.items()}
    known = rows.sparkSession.createDataFrame([*parts.items()], "target_id int, parts int")
    return rows.join(F.broadcast(known), "target_id").withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts").cast("bigint"))).drop("parts"), parts


def _containers(rows: DataFrame) -> dict:
    """Containers of each target: of each partition's rows one says how many it has."""
    b = rows.groupBy("target_id", "part").agg(F.countDistinct("bin").alias("n"))
    return {r["target_id"]: r["n"] for r in b.groupBy("target_id").agg(F.sum("n").alias("n")).collect()}


def _counts(rows: DataFrame) -> dict:
    return {r["target_id"]: r["count"] for r in rows.groupBy("target_id").count().collect()}


def pack(x: DataFrame, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """target_id, capacity, container_id, doc_id, piece, n_tokens, used: the container of every item.

    Items are spread by hash over partitions of about part_items and packed there by best-fit
    decreasing.  The lower bound of each partition's own items decides what becomes of it.  A
    partition whose containers are as few as its bound is certified and stays as it is.  Those with
    a gap exchange: the items of their open containers (those not full) are spread over new
    partitions of about part_items and packed again, and the new packing of a target is taken if
    it needs fewer containers.  That goes on while it saves any, no partition without a gap taking
    part, at most `rounds` times.  A certificate still leaves each partition up to one container
    too many for the whole, so at the end the least filled container of every partition is packed
    again with those of others.  No task takes more than about part_items items, whatever the
    sizes.  Items of 0 tokens take part and weigh nothing.  Repeated rows are separate items, on
    whatever partitions their places in the table put them.  An empty table gives no rows.
    """
    x = cut_lineage(x.withColumn("_row", F.monotonically_increasing_id()))  # the sizes are counted once, for the number of partitions and for the packing
    rest, parts = _spread(x, ["_row"], _counts(x), part_items)
    packed = _pack_parts(rest.drop("_row")).withColumn("round", F.lit(0))
    done, live = [], packed
    names = ["target_id", "capacity", "doc_id", "piece", "n_tokens"]
    for n_round in range(1, rounds + 1):
        parts = {t: n for t, n in parts.items() if n > 1}
        gap = live.where(F.col("target_id").isin(*parts) & (F.col("bins") > F.col("bound")) & (F.col("used") < F.col("capacity"))) if parts else live.limit(0)
        before = _containers(gap) if parts else {}
        if not before:
            break
        spread, parts = _spread(gap, ["part", "bin"], _counts(gap), part_items)
        again = _pack_parts(spread.select(*names, "part")).withColumn("round", F.lit(n_round))
        after = _containers(again)
        fewer = [t for t in before if after[t] < before[t]]
        if not fewer:
            break
        taken = F.col("target_id").isin(*fewer) & (F.col("bins") > F.col("bound")) & (F.col("used") < F.col("capacity"))
        done.append(live.where(~taken))
        live, parts = again.where(F.col("target_id").isin(*fewer)), {t: parts[t] for t in fewer}
    done.append(live)
    out = _union(done)
    # the last container of each partition, together with those of others
    last = out.where("used < capacity").groupBy("target_id", "round", "part").agg(F.min(F.struct("used", "bin")).alias("least")).select("target_id", "round", "part", F.col("least.bin").alias("bin"), F.lit(True).alias("last"))
    out = cut_lineage(out.join(last, ["target_id", "round", "part", "bin"], "left"))
    ends = out.where("last")
    before = {t: n for t, n in _containers(ends.withColumn("part", F.struct("round", "part"))).items() if n > 1}
    if before:
        ends = ends.where(F.col("target_id").isin(*before))
        spread, _ = _spread(ends, ["round", "part"], _counts(ends), part_items)
        again = _pack_parts(spread.select(*names, "part")).withColumn("round", F.lit(rounds + 1))
        fewer = [t for t, n in _containers(again).items() if n < before[t]]
        if fewer:
            of = F.col("target_id").isin(*fewer)
            out = _union([out.where(~(of & F.coalesce("last", F.lit(False)))).drop("last"), again.where(of)])
    return out.select("target_id", "capacity", F.concat_ws("-", "round", "part", "bin").alias("container_id"), "doc_id", "piece", "n_tokens", "used")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(packed: DataFrame) -> DataFrame:
    """Per target: items, tokens, containers, the lower bound over all items, unused share, and whether the count is proven least.

    The bound is taken from the histogram of sizes, at most capacity rows per target.
    """
    histogram = packed.groupBy("target_id", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    bins = packed.groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum(F.col("n_tokens").cast("bigint")).alias("tokens"))

    def bound(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        return pd.DataFrame({"target_id": [key[0]], "capacity": [capacity], "bound": [histogram_bound(pdf["n_tokens"].to_numpy(dtype="int64"), pdf["n"].to_numpy(dtype="int64"), capacity)]})

    least = histogram.groupBy("target_id").applyInPandas(bound, "target_id int, capacity int, bound bigint")
    r = bins.join(least, "target_id")
    return r.select("target_id", "capacity", "items", "tokens", "containers", "bound", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"), (F.col("containers") <= F.greatest("bound", F.lit(1))).alias("certified"))
