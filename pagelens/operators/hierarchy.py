"""Parent-child links to full hierarchies: components, then depth-first traversal of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.orphans import file_times
from pagelens.session import Rounds, cut_lineage, skew_join

#: Nodes up to which one component is traversed by one task; larger ones are resolved by pointer doubling.
COMPONENT_ROWS = 200_000
#: Values of a result batch.
BATCH_VALUES = 500_000
SCHEMA = "node string, parent string, root string, depth int, path array<string>, descendants array<string>, n_descendants bigint, mark string"


def parent_links(files: DataFrame) -> DataFrame:
    """node, parent of each file that has a parent.

    The parent is the predecessor (the smallest, should deliveries differ) that has a row;
    otherwise the smallest id that names the file as its successor.  A file may be its own
    parent.  Blank and dangling links give none.
    """
    once = cut_lineage(file_times(files))
    ids = once.select(F.col("id").alias("parent"))
    up = once.select(F.col("id").alias("node"), F.explode("predecessors").alias("parent")).join(ids, "parent", "left_semi").groupBy("node").agg(F.min("parent").alias("by_predecessor"))
    down = once.select(F.col("id").alias("parent"), F.explode("successors").alias("node")).groupBy("node").agg(F.min("parent").alias("by_successor"))
    return once.select(F.col("id").alias("node")).join(up, "node", "left").join(down, "node", "left").select("node", F.coalesce("by_predecessor", "by_successor").alias("parent")).where(F.col("parent").isNotNull())


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that is connected with it, in a graph of any links, by alternating large and small stars.

    Nodes are numbered in the order of their names.  Each round is two aggregations and joins of the
    remaining star edges, written to the checkpoint folder; their number grows with the logarithm of
    the longest chain.  Edges gather at one node of a component, so the join by it is split by skew_join.
    """
    nodes = links.select("node").unionByName(links.select(F.col("parent").alias("node"))).distinct()
    ids = cut_lineage(nodes.orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    a, b = ids.select("node", F.col("id").alias("a")), ids.select(F.col("node").alias("parent"), F.col("id").alias("b"))
    pairs = links.where(F.col("node") != F.col("parent")).select("node", "parent").join(a, "node").join(b, "parent")
    edges, seen = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = skew_join(both, low, "u", "v", "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    labels = ids.join(edges, F.col("id") == F.col("u"), "left").select("node", F.coalesce("v", "id").alias("id"))
    return labels.join(ids.withColumnRenamed("node", "component"), "id").select("node", "component")


def forest_components(links: DataFrame) -> DataFrame:
    """node, parent, component of a graph with one parent a node at most, and of its roots: a component is named by its root, or by the smallest node of its circle.

    Every node points to an ancestor, twice as far up each round, until that is the root; a round is
    one join, whose many rows for one ancestor adaptive execution can split.  After a round in which
    no more nodes were left than links looked up, all nodes below a root have ended, and the others
    lead into a circle and point to a node on it.
    """
    roots = links.select(F.col("parent").alias("node")).join(links.select("node"), "node", "left_anti").distinct()
    none = F.lit(None).cast("string")
    state = Rounds(links.sparkSession)
    state.add(roots.select("node", none.alias("parent"), none.alias("up"), F.col("node").alias("top"), F.col("node").alias("low")))
    state.add(links.select("node", "parent", F.col("parent").alias("up"), F.col("parent").alias("top"), F.least("node", "parent").alias("low")))
    steps, left, final = 1, None, False
    while True:
        live = state.read().where((F.col("round") == state.last) & F.col("up").isNotNull())
        left = live.count()
        if not left or final:
            break
        final = left < steps
        ahead = state.read().where((F.col("round") == state.last) | F.col("up").isNull())
        ahead = ahead.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("low").alias("low2"))
        state.add(live.join(ahead, "up").select("node", "parent", F.col("up2").alias("up"), F.col("top2").alias("top"), F.least("low", "low2").alias("low")))
        steps *= 2
    trees = state.read().where("up is null").select("node", "parent", F.col("top").alias("component"))
    if not left:
        return trees
    circles = live.join(live.select(F.col("node").alias("up"), F.col("low").alias("component")), "up")
    return trees.unionByName(circles.select("node", "parent", "component"))


def _traverse(nodes: list[str], parents: list[str | None], arrays: bool) -> Iterator[tuple]:
    """Depth-first, without recursion.  White nodes are new, grey ones on the current way down, black ones done.

    Rows are given one by one, so that of the paths and descendants, whose size may be the square of
    the component's, none is held.
    """
    parent = dict(zip(nodes, parents))
    children: dict[str, list[str]] = {}
    for n, p in parent.items():
        if p is not None:
            children.setdefault(p, []).append(n)
    black: set[str] = set()
    for top in (n for n, p in parent.items() if p is None):
        depth = 0
        below: dict[str, int] = {}
        order: list[tuple[str, int]] = []
        stack: list[tuple[str, bool]] = [(top, False)]
        while stack:
            n, leaving = stack.pop()
            if leaving:
                depth -= 1
                below[n] = len(order) - below[n]
                black.add(n)
                continue
            order.append((n, depth))
            below[n] = len(order)
            depth += 1
            stack.append((n, True))
            stack.extend((c, False) for c in sorted(children.get(n, ()), reverse=True))
        names, path = [n for n, _ in order], []
        for i, (n, depth) in enumerate(order):
            del path[depth:]
            path.append(n)
            yield n, parent[n], top, depth, list(path) if arrays else None, names[i + 1 : i + 1 + below[n]] if arrays else None, below[n], "tree"
    for start in parent:
        grey: dict[str, int] = {}
        walk, n = [], start
        while n not in black and n not in grey:
            grey[n] = len(walk)
            walk.append(n)
            n = parent[n]
        ring = walk[grey[n] :] if n in grey else []
        circle, first = set(ring), min(ring, default=None)
        black.update(walk)
        for m in walk:
            mark = "into_circle" if m not in circle else "back_edge" if parent[m] == first else "circle"
            yield m, parent[m], "CYCLE", -1, None, None, None, mark


def _by_component(arrays: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kept: list[pd.DataFrame] = []

        def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            rows, held = [], 0
            for row in _traverse(pdf["node"].tolist(), [p if isinstance(p, str) else None for p in pdf["parent"]], arrays):
                rows.append(row)
                held += 1 + len(row[4] or ()) + len(row[5] or ())
                if held > BATCH_VALUES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["component"].iloc[-1]
            open_ = pdf["component"] == last
            if open_.all() and (not kept or kept[-1]["component"].iloc[-1] == last):
                kept.append(pdf)
                continue
            yield from done(pd.concat([*kept, pdf[~open_]]))
            kept = [pdf[open_]]
        if kept:
            yield from done(pd.concat(kept))

    return run


def _double(state: DataFrame, most: int, step) -> DataFrame:
    """step(state, ahead) until no `up` is left or more than `most` links are known; ahead is the state of `up`."""
    steps = 1
    while steps <= most and state.where(F.col("up").isNotNull()).limit(1).count():
        ahead = state.select(F.col("node").alias("up"), *(F.col(c).alias(f"{c}2") for c in state.columns if c != "node"))
        state = cut_lineage(step(state, ahead))
        steps *= 2
    return state


def _doubling(nodes: DataFrame, arrays: bool) -> DataFrame:
    """The same result for components too large for one task: each round doubles the links known.

    A node carries its ancestor that many links up (none beyond the root), the highest one known,
    and the number of nodes less than that many links below; whoever still has an ancestor after
    as many links as there are nodes leads into a circle, and these ancestors are its nodes.
    Only for tree nodes, and only where asked, are ways written out, which is the size of the result.
    """
    nodes = cut_lineage(nodes)

    def pairs(state: DataFrame, ahead: DataFrame) -> DataFrame:
        more = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("below").alias("more"))
        j = state.join(ahead.drop("below2", "parent2", "component2"), "up", "left").join(more, "node", "left")
        return j.select("node", "parent", "component", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"))

    one = F.col("parent").isNotNull().cast("bigint")
    state = nodes.select("node", "parent", "component", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("top"), one.alias("depth"), F.lit(1).cast("bigint").alias("below"))
    state = _double(state, nodes.count(), pairs)
    none = F.lit(None).cast("array<string>")
    tree = state.where("up is null").select("node", "parent", F.col("top").alias("root"), F.col("depth").cast("int").alias("depth"), (F.col("below") - 1).alias("n_descendants"), F.lit("tree").alias("mark"))
    ring = state.where("up is not null")
    circle = ring.select(F.col("up").alias("node")).distinct().withColumn("on_it", F.lit(True))
    first = ring.groupBy("component").agg(F.min("up").alias("first"))  # a component has one circle at most
    mark = F.when(F.col("on_it") & (F.col("parent") == F.col("first")), "back_edge").when(F.col("on_it"), "circle").otherwise("into_circle")
    rings = ring.join(circle, "node", "left").join(first, "component").select("node", "parent", F.lit("CYCLE").alias("root"), F.lit(-1).alias("depth"), none.alias("path"), none.alias("descendants"), F.lit(None).cast("bigint").alias("n_descendants"), mark.alias("mark"))
    if not arrays:
        return tree.withColumn("path", none).withColumn("descendants", none).unionByName(rings)
    tree = cut_lineage(tree)
    longer = lambda s, ahead: s.join(ahead, "up", "left").select("node", F.col("up2").alias("up"), F.concat("way", F.coalesce("way2", F.array().cast("array<string>"))).alias("way"))
    ways = _double(tree.select("node", F.col("parent").alias("up"), F.array_compact(F.array("parent")).alias("way")), tree.count(), longer)
    ways = ways.select("node", "way", F.reverse(F.concat(F.array("node"), "way")).alias("path"))
    ways = cut_lineage(ways.orderBy("path").withColumn("pos", F.monotonically_increasing_id()))  # sorted by path is depth-first
    below = F.sort_array(F.collect_list(F.struct("pos", "d")))
    under = ways.select(F.explode("way").alias("node"), "pos", F.col("node").alias("d")).groupBy("node").agg(F.transform(below, lambda x: x["d"]).alias("descendants"))
    tree = tree.join(ways.select("node", "path"), "node").join(under, "node", "left").withColumn("descendants", F.coalesce("descendants", F.array().cast("array<string>")))
    return tree.unionByName(rings)


def hierarchy(links: DataFrame, arrays: bool = True, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """One row per node of a forest given as (node, parent), one parent per node: node, parent, root,
    depth, path (root first), descendants (depth-first order), n_descendants, mark.

    Nodes are grouped by connected component, each component is brought to one task and
    traversed there with an explicit stack; a component of more than component_rows nodes is
    resolved by joins instead, whatever its size.  A node on a circle, or whose way up leads
    into one, has root CYCLE, depth -1 and null path and descendants; mark is `circle`,
    `into_circle`, or `back_edge` for the node whose link closes the circle, walked from its
    smallest node.  The rows do not depend on component_rows.  With arrays=False
    path and descendants stay null.  Null nodes and parents are left out; an empty input gives
    no rows.
    """
    links = links.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")).where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    links = cut_lineage(links)
    rows = cut_lineage(forest_components(links))
    large = rows.groupBy("component").count().where(F.col("count") > component_rows).select("component")
    some = bool(large.limit(1).count())
    fit = rows.join(large, "component", "left_anti") if some else rows
    out = fit.repartition("component").sortWithinPartitions("component").mapInPandas(_by_component(arrays), SCHEMA)
    if some:
        rest = _doubling(rows.join(large, "component", "left_semi").select("node", "parent", "component"), arrays)
        out = out.unionByName(rest)
    return out
