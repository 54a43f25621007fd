"""Queries pN_ of the general training-data problems, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import hierarchy, orphans, sessions, units
from pagelens.session import cut_lineage, table


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.amounts(table(spark, d, "public_checks"), "check_id", "parameter_code", ["pd_value", "rd_value"], table(spark, d, "params"), table(spark, d, "measure_units"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_amount_other_unit(_amounts(spark, d), "pd_value", "rd_value").select(F.col("key").alias("check_id"))


def p1_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every stated quantity in its parameter's unit; a check delivered twice counts once."""
    a = _amounts(spark, d).withColumnRenamed("key", "check_id")
    return a.where(F.col("check_id").isNotNull()).select("check_id", "code", "field", "number", F.col("canon").alias("unit"), "dimension", "amount_si", "amount", "param_unit").distinct()


def _references(spark: SparkSession, d: str) -> DataFrame:
    once = cut_lineage(orphans.file_times(table(spark, d, "files")))  # read three times
    refs = cut_lineage(orphans.file_references(once, table(spark, d, "public_checks")))  # read twice: for the keys, and for the rows
    removed = table(spark, d, "file_removals").select(F.col("file_id").alias("id"))
    return orphans.orphan_references(refs, once.select("id", "at"), removed)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "ui_events")).select("user_id", "start_ts", "end_ts", "n_events")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "ui_events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "files")), arrays=False)
    return h.where(F.col("parent").isNotNull()).select(F.col("node").alias("file_id"), F.col("root").alias("root_id"), "depth")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every file that has a parent or a child: path and descendants as text, parted by blanks."""
    h = hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "files")))
    return h.select(F.col("node").alias("file_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", " ").alias("path"), F.array_join("descendants", " ").alias("descendants"), "n_descendants", "mark")


QUERIES = {f.__name__: f for f in (p1_found, p1_amounts, p3_found, p3_report, p4_found, p4_sessions, p5_found, p5_hierarchy)}

_P3 = """
once AS (SELECT id, min(uploaded_at) AS at FROM files WHERE id IS NOT NULL GROUP BY id),
named AS (
  SELECT DISTINCT 'files' AS src_table, id AS rec_id, 'predecessor_id' AS ref_field, predecessor_id AS ref_id FROM files
  UNION SELECT DISTINCT 'files', id, 'successor_id', successor_id FROM files),
refs AS (
  SELECT n.*, o.at FROM named n JOIN once o ON o.id = n.rec_id
  UNION ALL
  SELECT 'public_checks', check_id, 'evidence.file_id', ref_id, min(recorded_at)
  FROM (SELECT check_id, recorded_at, unnest(evidence).file_id AS ref_id FROM public_checks) GROUP BY check_id, ref_id),
found AS (
  SELECT r.src_table, r.rec_id, r.ref_field, r.ref_id,
    CASE WHEN o.id IS NULL THEN CASE WHEN r.ref_id IN (SELECT file_id FROM file_removals) THEN 'deleted' ELSE 'missing' END
         WHEN o.at > r.at AND r.ref_field <> 'successor_id' THEN 'late' END AS kind,
    strftime(r.at, '%Y-%m') AS period
  FROM refs r LEFT JOIN once o ON o.id = r.ref_id
  WHERE trim(coalesce(r.ref_id, '')) <> '')
"""

_P4 = """
WITH e AS (SELECT DISTINCT user_id, ts, event_id FROM ui_events WHERE trim(coalesce(user_id, '')) <> '' AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000 THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
"""

_LINKS = """ids AS (SELECT DISTINCT id FROM files),
up AS (SELECT id AS node, min(predecessor_id) AS parent FROM files WHERE predecessor_id IN (SELECT id FROM ids) GROUP BY id),
down AS (SELECT successor_id AS node, min(id) AS parent FROM files WHERE successor_id IN (SELECT id FROM ids) GROUP BY successor_id),
links AS (SELECT i.id AS node, coalesce(u.parent, d.parent) AS parent FROM ids i LEFT JOIN up u ON u.node = i.id LEFT JOIN down d ON d.node = i.id)"""

_P5 = f"""
WITH RECURSIVE {_LINKS},
walk AS (
  SELECT node, node AS root, 0 AS depth FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, w.root, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node)
SELECT l.node AS file_id, coalesce(w.root, 'CYCLE') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth
FROM links l LEFT JOIN walk w ON w.node = l.node WHERE l.parent IS NOT NULL
"""

_TREES = f"""
WITH RECURSIVE {_LINKS},
walk AS (
  SELECT node, [node] AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, list_append(w.path, l.node) FROM walk w JOIN links l ON l.parent = w.node),
under AS (SELECT a AS node, string_agg(node, ' ' ORDER BY path) AS descendants, count(*) AS n FROM (SELECT node, path, unnest(path[:-2]) AS a FROM walk) GROUP BY 1),
lost AS (SELECT * FROM links WHERE node NOT IN (SELECT node FROM walk)),
reach AS (SELECT node, parent AS top FROM lost UNION SELECT r.node, l.parent FROM reach r JOIN lost l ON l.node = r.top),
ring AS (SELECT node FROM reach WHERE node = top),
firsts AS (SELECT node, min(top) AS f FROM reach WHERE top IN (SELECT node FROM ring) GROUP BY 1)
SELECT l.node AS file_id, l.parent AS parent_id, coalesce(w.path[1], 'CYCLE') AS root_id, CAST(coalesce(len(w.path) - 1, -1) AS INTEGER) AS depth, array_to_string(w.path, ' ') AS path, CASE WHEN w.node IS NOT NULL THEN coalesce(u.descendants, '') END AS descendants, CASE WHEN w.node IS NOT NULL THEN coalesce(u.n, 0) END AS n_descendants,
  CASE WHEN w.node IS NOT NULL THEN 'tree' WHEN l.node NOT IN (SELECT node FROM ring) THEN 'into_circle' WHEN l.parent = f.f THEN 'back_edge' ELSE 'circle' END AS mark
FROM links l LEFT JOIN walk w ON w.node = l.node LEFT JOIN under u ON u.node = l.node LEFT JOIN firsts f ON f.node = l.node
WHERE l.parent IS NOT NULL OR u.n > 0
"""

SQL = {
    "p3_found": f"WITH {_P3} SELECT src_table, rec_id, ref_field, ref_id, kind, period FROM found WHERE kind IS NOT NULL",
    "p3_report": f"WITH {_P3} SELECT src_table, ref_field, kind, period, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys, count(DISTINCT rec_id) AS n_records FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, k",
    "p4_sessions": _P4 + "SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_ms, count(*) AS n_events FROM s GROUP BY user_id, k",
    "p5_found": _P5,
    "p5_hierarchy": _TREES,
}
