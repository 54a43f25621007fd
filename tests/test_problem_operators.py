"""Sessions, orphan references and hierarchies against plain Python, with the odd cases."""

import random
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from pagelens.operators import hierarchy, orphans, sessions

EVENTS = "user_id string, ts bigint, event_id bigint, chunk string"


def brute_sessions(rows, gap):
    by = defaultdict(set)
    for i, (u, t, e) in enumerate(rows):
        if u is not None and u.strip() and t is not None:
            by[u].add((t, e if e is not None else f"none{i}"))
    out = []
    for u, es in by.items():
        cur = None
        for t, _ in sorted(es, key=lambda x: x[0]):
            if cur and t - cur[1] <= gap:
                cur[1], cur[2] = t, cur[2] + 1
            else:
                if cur:
                    out.append((u, *cur))
                cur = [t, t, 1]
        out.append((u, *cur))
    return sorted(out)


def test_sessions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "b", "c", None, " ", ""]), rng.choice([rng.randrange(0, 3_000_000), None, 1000, 2_000_000]), rng.choice([n, n, None])) for n in range(600)]
    rows += rows[:100] + [("edge", 0, 9001), ("edge", 1_800_000, 9002), ("edge", 3_600_001, 9003), ("max", 2**63 - 1, 9004), ("max", -(2**63) + 1, 9005)]
    distinct = []
    seen = set()
    for r in rows:  # an id names one event
        if r[2] is None or r not in seen:
            distinct.append(r)
        seen.add(r)
    df = spark.createDataFrame([(*r, "x") for r in rows], EVENTS)
    for chunk in (50_000, 21_600_000):
        got = sorted((r.user_id, r.start_ts, r.end_ts, r.n_events) for r in sessions.sessionize(df, chunk_ms=chunk).collect())
        assert got == brute_sessions(distinct, sessions.GAP_MS)


def test_sessions_empty(spark):
    assert sessions.sessionize(spark.createDataFrame([], EVENTS)).count() == 0


FILES = "id string, predecessor_id string, successor_id string, uploaded_at timestamp_ntz, at string"
CHECKS = "check_id string, recorded_at timestamp_ntz, evidence array<struct<stage: string, file_id: string>>"


def test_orphans(spark):
    t = [datetime(2024, m, 1) for m in range(1, 7)]
    files = spark.createDataFrame([("a", None, "b", t[1], ""), ("b", "a", " ", t[2], ""), ("b", "a", " ", t[5], ""), ("c", "gone", "lost", t[0], ""), ("d", "b", None, t[0], ""), ("e", "lost", "b", None, "")], FILES)
    checks = spark.createDataFrame([("k1", t[0], [("PD", "a"), ("RD", None), ("RD", "lost")]), ("k1", t[0], [("PD", "a"), ("RD", "lost")]), ("k2", t[4], [("PD", "a"), ("PD", "gone")]), ("k3", t[4], []), ("k4", None, None)], CHECKS)
    removed = spark.createDataFrame([("gone",), ("gone",), (None,), ("a",)], "id string")
    expected = {
        ("files", "c", "predecessor_id", "gone", "deleted", "2024-01"),
        ("files", "c", "successor_id", "lost", "missing", "2024-01"),
        ("files", "d", "predecessor_id", "b", "late", "2024-01"),
        ("files", "e", "predecessor_id", "lost", "missing", None),
        ("public_checks", "k1", "evidence.file_id", "a", "late", "2024-01"),
        ("public_checks", "k1", "evidence.file_id", "lost", "missing", "2024-01"),
        ("public_checks", "k2", "evidence.file_id", "gone", "deleted", "2024-05"),
    }
    for hot in (1, 100_000):
        found = orphans.orphan_references(orphans.file_references(orphans.file_times(files), checks), orphans.file_times(files).select("id", "at"), removed, hot_rows=hot)
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    report = {(r.src_table, r.kind, r.period): r.n_refs for r in orphans.orphan_report(found).collect()}
    assert report["files", "missing", "2024-01"] == 1
    none = orphans.orphan_references(orphans.file_references(orphans.file_times(files.limit(0)), checks.limit(0)), orphans.file_times(files.limit(0)).select("id", "at"), removed)
    assert none.count() == 0


def brute_tree(parent):
    out = {}
    for n in parent.keys() | {p for p in parent.values()}:
        way, x = [], n
        while x in parent and x not in way:
            way.append(x)
            x = parent[x]
        out[n] = ("CYCLE", -1) if x in parent else (x, len(way))
    return out


def test_hierarchy(spark):
    rng = random.Random(9)
    parent = {f"n{i:03d}": f"n{rng.randrange(0, 150):03d}" for i in range(120)} | {f"c{i:03d}": f"c{i + 1:03d}" for i in range(90)} | {"s": "s", "t": "s", "x": "y", "y": "x", "z": "x"}
    df = spark.createDataFrame([*parent.items(), ("x", None), (None, "q"), *list(parent.items())[:5]], "node string, parent string")
    expected = brute_tree(parent)
    kids = defaultdict(set)
    for n in expected:
        x = n
        while expected[n][1] > 0 and x in parent:
            x = parent[x]
            kids[x].add(n)
    for limit in (200_000, 30):
        rows = {r.node: r for r in hierarchy.hierarchy(df, component_rows=limit).collect()}
        assert {n: (r.root, r.depth) for n, r in rows.items()} == expected
        for n, r in rows.items():
            if r.depth >= 0:
                assert r.path[0] == r.root and r.path[-1] == n and len(r.path) == r.depth + 1
                assert set(r.descendants) == kids[n] and r.n_descendants == len(kids[n])
            else:
                assert r.path is None
        assert rows["z"].mark == "into_circle" and rows["t"].mark == "into_circle"
    assert sum(r.mark == "back_edge" for r in hierarchy.hierarchy(df).collect()) == sum(1 for _ in circles(parent))
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_large_components_carry_no_ways(spark, monkeypatch):
    """Without arrays nothing that is written between rounds may grow with the way up; a long way into a circle and a deep chain."""
    parent = {f"c{i:03d}": f"c{i + 1:03d}" for i in range(300)} | {"c300": "c298"} | {f"t{i:03d}": f"t{i + 1:03d}" for i in range(200)} | {"u": "t150"}
    df = spark.createDataFrame([*parent.items()], "node string, parent string")
    seen, cut = [], hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda x: seen.append(x.dtypes) or cut(x))
    rows = {r.node: r for r in hierarchy.hierarchy(df, arrays=False, component_rows=30).collect()}
    assert not [t for types in seen for _, t in types if t.startswith("array")]
    assert {n: (r.root, r.depth) for n, r in rows.items()} == brute_tree(parent)
    assert {n: r.n_descendants for n, r in rows.items()} == {r.node: r.n_descendants for r in hierarchy.hierarchy(df, arrays=False).collect()}
    assert sorted(n for n, r in rows.items() if r.mark not in ("tree", "into_circle")) == ["c298", "c299", "c300"]


def test_hierarchy_is_the_same_for_any_limit(spark):
    """Marks, order of descendants and all else, with and without arrays; several circles, a link to itself, siblings out of name order."""
    rng = random.Random(5)
    parent = {f"n{i}": f"n{rng.randrange(0, 90)}" for i in range(80)} | {f"d{i}": f"d{rng.randrange(0, i)}" for i in range(1, 60)} | {"s": "s", "t": "s", "x": "y", "y": "x", "z": "x"}
    df = spark.createDataFrame([*parent.items()], "node string, parent string")
    for arrays in (True, False):
        one, two = (sorted(map(repr, hierarchy.hierarchy(df, arrays, limit).select(*(c.split()[0] for c in hierarchy.SCHEMA.split(", "))).collect())) for limit in (200_000, 1))
        assert one == two
        assert sum("mark='back_edge'" in r for r in two) == sum(1 for _ in circles(parent))


def circles(parent):
    seen = set()
    for n in parent:
        way, x = [], n
        while x in parent and x not in way and x not in seen:
            way.append(x)
            x = parent[x]
        if x in way:
            yield x
        seen.update(way)


def test_parent_links(spark):
    files = spark.createDataFrame([("a", None, "b", None, ""), ("b", "lost", None, None, ""), ("c", "a", None, None, ""), ("d", "", "b", None, ""), ("e", "e", None, None, ""), ("f", None, "c", None, "")], FILES)
    got = {r.node: r.parent for r in hierarchy.parent_links(files).collect()}
    assert got == {"b": "a", "c": "a", "e": "e"}


def test_components(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("f", "f")], "node string, parent string")
    got = {r.node: r.component for r in hierarchy.components(links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert hierarchy.components(links.where(F.lit(False))).count() == 0
