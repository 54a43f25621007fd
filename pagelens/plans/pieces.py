"""Queries of the operators whose inputs the test tables lack: small tables made of their columns; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import measure
from pagelens.operators import cascade, comparators, eventlog, extract, intake, revisions, scoring
from pagelens.session import table
from pagelens.sources import readers


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as boxes on pages: a page per order, sides from quantity, discount, tax and number."""
    li = table(spark, d, "lineitem")
    x, y = F.col("l_quantity") / 100, F.col("l_discount") * 5 + F.col("l_linenumber") / 20
    return li.select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ix"), x.alias("x0"), y.alias("y0"), (x + F.col("l_tax") + 0.01).alias("x1"), (y + 0.07).alias("y1"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("k"), "l_tax")


def _box(prefix: str = "") -> F.Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def _box_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first and the second line of an order as two boxes."""
    b = _boxes(spark, d)
    side = lambda k, s: b.where(F.col("k") == k).groupBy("file_id").agg(F.min_by(_box(), "ix").alias(s))
    return side(1, "a").join(side(2, "b"), "file_id")


def mth_boxes(spark: SparkSession, d: str) -> DataFrame:
    corners = lambda c: F.array(*(F.struct(c[x].alias("x"), c[y].alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    p = _box_pairs(spark, d)
    bounds = measure.bounds(F.concat(corners(F.col("a")), corners(F.col("b"))))
    p = p.select("file_id", measure.rows_overlap(F.col("a"), F.col("b")).alias("overlap"), F.round(measure.box_iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(measure.polygons_iou(corners(F.col("a")), corners(F.col("b"))), 6).alias("polygon_iou"), F.round(bounds["x1"] - bounds["x0"], 6).alias("width"))
    return p


def mth_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """The first token of each file in reading order."""
    b = _boxes(spark, d)
    first = b.groupBy("file_id").agg(F.min(F.struct(*measure.reading_key(F.col("page"), _box()), "ix")).alias("k"))
    return first.select("file_id", "k.ix")


def mth_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of pages of 200 by 100 from (10, 20), turned by the line's number, made normal and turned back."""
    t = F.pmod(F.col("k"), F.lit(4)) * 90
    frame = [F.lit(10.0), F.lit(20.0), F.lit(200.0), F.lit(100.0), t]
    b = _boxes(spark, d).select("file_id", "ix", (10 + F.col("x0") * 200).alias("x"), (20 + F.col("l_tax") * 100).alias("y"), t.alias("turn"))
    frame[-1] = F.col("turn")
    n = measure.normalized_point(F.col("x"), F.col("y"), *frame)
    b = b.withColumn("n", n).withColumn("back", measure.source_point(F.col("n.x"), F.col("n.y"), *frame))
    return b.groupBy("turn").agg(F.round(F.sum("n.x"), 4).alias("x"), F.round(F.sum("n.y"), 4).alias("y"), F.max(F.greatest(F.abs(F.col("back.x") - F.col("x")), F.abs(F.col("back.y") - F.col("y"))) < 1e-9).alias("returns"))


def mth_visible(spark: SparkSession, d: str) -> DataFrame:
    parts = measure.visible(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], "l_quantity", least=14.2, samples=8)
    return measure.all_visible(parts, ["l_suppkey"])


def int_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words that are kept by their certainty and box, and of these the ones under no hidden object of four times their size at most."""
    b = _boxes(spark, d).where(intake.keep_word(F.col("l_tax") * 1000, _box()))
    hidden = b.where(F.col("flag") == "R").select("file_id", "page", *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    kept = intake.suppress_hidden(b.where(F.col("flag") != "R"), hidden, ["file_id", "page"])
    return kept.select("file_id", "ix")


def int_fragments(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", "file_hash").distinct()
    k = F.right("id", F.lit(1)).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    polygon = F.when(k == 3, F.array(point(k / 10, k / 10))).otherwise(F.array(point(k / 8, k / 9), point(k / 10, k / 10), point(F.lit(0.0), F.lit(1.0))))
    return f.select(F.explode(intake.fragment_faults(F.when(k != 4, F.col("file_hash")), k, polygon)).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def int_roles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ui_events")
    return e.groupBy("screen", "event", intake.allowed_roles(F.array("screen", "event"), F.array(F.lit("queue"), F.lit("ZOOM"))).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def cas_missing_stage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "params")
    halt = cascade.halted((F.col("data_type").isNull(), "CLARIFICATION_REQUIRED"))
    status = F.coalesce(halt, intake.missing_stage(F.col("coverage") != "source_missing", F.coalesce("is_active", F.lit(False))), F.lit("-"))
    named = cascade.mapped(status, F.lower(status), F.create_map(F.lit("missing_evidence"), F.lit("SOURCE_ABSENT")))
    return p.groupBy("coverage", "is_active", named.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def cas_suspicion(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = cascade.suspicion(1 - F.col("l_discount") * 4, F.col("l_linestatus") == "F", F.col("l_linenumber"), F.lit(4), F.col("l_returnflag") == "R")
    return li.groupBy(s["kind"].alias("kind"), F.round(s["confidence"], 4).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def agg_timings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ui_events")
    v = cascade.timing_verdict(F.col("duration_ms") / 1000.0, F.when(F.col("event") != "SCROLL", 1.0), F.col("event") == "FILTER")
    return e.groupBy("event", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def cmp_operators(spark: SparkSession, d: str) -> DataFrame:
    """The orderings and set rules that the other query leaves out, over all lines."""
    li = table(spark, d, "lineitem")
    rule = lambda op: F.struct(F.lit(op).alias("operator"), F.lit(25.0).alias("value"), F.array(F.lit("a"), F.lit(" N ")).alias("values"))
    ordered = [comparators.compare_ordering(rule(op), F.lit(None).cast("double"), F.col("l_quantity"))["status"].alias(op) for op in ("eq", "ne", "gt", "le")]
    sets = [comparators.compare_membership(rule(op), F.col("l_returnflag"))["status"].alias(op) for op in ("in_set", "not_in_set")]
    text = comparators.compare_text(rule("ne"), F.col("l_returnflag"), F.col("l_linestatus"))["status"].alias("ne_text")
    return li.groupBy(*ordered, *sets, text).agg(F.count(F.lit(1)).alias("n"))


def cmp_triggers(spark: SparkSession, d: str) -> DataFrame:
    words = ["уменьшение площади", "Увеличение нагрузки", "замена и уменьшение", "подмена", "понижён класс", "превышение", "увеличен и понижен", "сдвиг осей", "менее прочный", "рост", None]
    return spark.createDataFrame([(w,) for w in words], "trigger string").select("trigger", comparators.trigger_sense(F.col("trigger")).alias("sense"))


def rev_overlay(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    o = revisions.approval_overlay(F.col("approval_status"), F.when(F.col("successor_id").isNull(), "SELECT"))
    return f.groupBy("approval_status", o.alias("status"), revisions.reads_agree(F.col("doc_stage"), F.col("discipline"), F.col("doc_stage")).alias("agree")).agg(F.count(F.lit(1)).alias("n"))


def rev_narrow(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "public_checks").where("finding_group_id is not null")
    return revisions.narrow(c, ["finding_group_id"], "id_value")


def rev_last_file(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    i = f.select("object_id", F.when(F.col("doc_stage") != "ID", F.col("doc_stage")).alias("stage"), F.col("id").alias("file_id"), F.struct("uploaded_at", "id").alias("pos"), (F.coalesce("approval_status", F.lit("")) == "NOT_APPROVED").alias("excluded"), F.col("document_code").isNotNull().alias("present"))
    return revisions.last_file(i)


def rev_gold_slots(spark: SparkSession, d: str) -> DataFrame:
    """The last file of each object and stage that a gold check's evidence names."""
    f = table(spark, d, "files").select("object_id", F.col("doc_stage").alias("stage"), F.col("id").alias("file_id"), F.struct("uploaded_at", "id").alias("pos"))
    gold = table(spark, d, "public_checks").where("split = 'TRAIN_PUBLIC'").select("object_id", F.explode("evidence.file_id").alias("file_id"))
    return revisions.gold_slots(f, gold)


def evt_claimable(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ui_events").select(F.col("event_id").alias("id"), F.when(F.col("check_id").isNotNull(), "PENDING").otherwise("DELIVERED").alias("status"), F.coalesce("click_index", F.lit(0)).alias("attempts"), F.col("received_at").alias("available_at"), F.col("received_at").alias("created_at"))
    return eventlog.claimable(e, F.lit("2030-01-01").cast("timestamp")).select("id", "status")


def evt_publish(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ui_events")
    o = eventlog.publish_outcome(F.col("screen"), F.when(F.col("event") != "SCROLL", F.col("screen")), F.col("target").isNull(), F.col("click_index") > 2)
    return e.groupBy(o.alias("outcome"), eventlog.sync_state(o).alias("sync")).agg(F.count(F.lit(1)).alias("n"))


def evt_mass_confirm(spark: SparkSession, d: str) -> DataFrame:
    """The first checks by id as one picked list, too many and with one that is no candidate."""
    c = table(spark, d, "public_checks").where("check_id < 'CHK-00-0000060'").select(F.col("check_id").alias("finding_id"), F.when(F.col("violation_label") == "VIOLATION_PRESENT", "CANDIDATE").otherwise("ABSTAIN").alias("status"), F.lit(True).alias("human"))
    r = eventlog.mass_confirm(c)
    return r.select("n", F.array_join("blocking", ",").alias("blocking"), "allowed")


def lim_missing(spark: SparkSession, d: str) -> DataFrame:
    """Of the files that evidence names and the index lacks, their number and the first eight by object."""
    named = table(spark, d, "public_checks").select("object_id", F.explode("evidence.file_id").alias("file_id")).where("file_id is not null")
    r = eventlog.missing_sample(named, table(spark, d, "files").select(F.col("id").alias("file_id")), ["object_id"], "file_id")
    return r.select("object_id", "n", F.array_join("sample", " ").alias("sample"))


def set_stale_outputs(spark: SparkSession, d: str) -> DataFrame:
    written = table(spark, d, "public_checks").select(F.col("parameter_code").alias("code"))
    return intake.stale_outputs(written, table(spark, d, "params").select("code"), "code")


def src_cache(spark: SparkSession, d: str) -> DataFrame:
    """Files against a cache of the approved ones' hashes, those of before the end of 2023 outdated."""
    f = table(spark, d, "files")
    cache = f.where("approval_status = 'APPROVED'").select("file_hash", F.col("uploaded_at").alias("cached_at")).groupBy("file_hash").agg(F.max("cached_at").alias("cached_at"))
    hits, misses = readers.cached_by_hash(f.select("file_hash").distinct(), cache, F.lit("2025-01-01").cast("timestamp"), 86400 * 366)
    return hits.select("file_hash", F.lit(True).alias("hit")).unionByName(misses.select("file_hash", F.lit(False).alias("hit")))


def ext_contours(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 4).alias("width"), (F.col("l_tax") * 1000 + 10).alias("height"), F.lit(200.0).alias("page_width"), F.lit(100.0).alias("page_height"), F.lit(100).alias("scale"))
    return extract.contour_area(r).select("file_id", "page", F.round("area_m2", 6).alias("area_m2"))


def ext_scales(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("text", F.when(F.col("flag") == "N", F.concat(F.lit("1:"), F.col("k") * 100)).otherwise("лист"))
    return extract.drawing_scale(b)


def ext_elements(spark: SparkSession, d: str) -> DataFrame:
    """Marks of orders by their lines' numbers, open lines against the others."""
    b = _boxes(spark, d).select("file_id", F.concat(F.lit("П"), F.col("k") % 3).alias("mark"), _box().alias("box"), "flag")
    return extract.element_match(b.where("flag = 'N'"), b.where("flag <> 'N'"), ["file_id"])


def ext_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Values beside the word of an anchor: every order asks for one."""
    b = _boxes(spark, d)
    t = b.withColumn("text", F.when(F.col("flag") == "N", "ширина").otherwise(F.col("k").cast("string")))
    rules = spark.createDataFrame([("G1", ["ширина прохода"])], "code string, anchors array<string>")
    return extract.geometry_fallback(b.select(F.lit("G1").alias("code"), "file_id").distinct(), t, rules, 0.2)


def ext_rooms(spark: SparkSession, d: str) -> DataFrame:
    """Rooms of both stages that no pair of sheets has settled, by whether any sheet has the feature; statuses of the verdicts."""
    c = table(spark, d, "public_checks").where("location is not null").select("object_id", F.col("location").alias("room"), F.col("pd_value").isNotNull().alias("p"), (F.length("rd_value") > 8).alias("q"), F.col("split")).distinct()
    settled = c.where("split = 'VALIDATION'").select("object_id", "room")
    side = lambda s: c.select("object_id", "room", F.when(F.coalesce(s, F.lit(False)), "x").alias("feature"))
    r = extract.across_sheets(side("p"), side("q"), settled, ["object_id"])
    return r.select("object_id", "room", "verdict", extract.room_status(F.col("verdict"), F.lit(True), F.lit(True)).alias("status"))


def ext_page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts of the two line states as rooms of pages."""
    li = table(spark, d, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy((F.col("l_suppkey") % 20).alias("object_id"), F.col("l_orderkey").alias("page")).agg(F.collect_set(F.col("l_partkey") % 40).alias("rooms"))
    return extract.page_pairs(side("O"), side("F"), ["object_id"], 0.5, 6)


def agg_localised(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which a box of an open line meets one of another line on the page."""
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    b = _boxes(spark, d).select(F.col("file_id").alias("key"), "file_id", "page", corners.alias("polygon"), "k")
    return scoring.localised(b.where("k < 3"), b.where("k >= 3"), ["key"], 0.1234567)


_FUNCS = (mth_boxes, mth_reading_order, mth_points, mth_visible, int_tokens, int_fragments, int_roles, cas_missing_stage, cas_suspicion, agg_timings, cmp_operators, cmp_triggers, rev_overlay, rev_narrow, rev_last_file, rev_gold_slots, evt_claimable, evt_publish, evt_mass_confirm, lim_missing, set_stale_outputs, src_cache, ext_contours, ext_scales, ext_elements, ext_geometry, ext_rooms, ext_page_pairs, agg_localised)
QUERIES = {f.__name__: f for f in _FUNCS}

_BOX = "b AS (SELECT l_orderkey AS file_id, (l_linenumber % 2 + 1)::INTEGER AS page, l_partkey * 10 + l_linenumber AS ix, l_quantity / 100 AS x0, l_discount * 5 + l_linenumber / 20 AS y0, l_quantity / 100 + l_tax + 0.01 AS x1, l_discount * 5 + l_linenumber / 20 + 0.07 AS y1, l_returnflag AS flag, l_linenumber AS k, l_tax FROM lineitem)"
_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)"

SQL = {
    "mth_boxes": f"""WITH {_BOX}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY ix) AS r FROM b),
        j AS (SELECT a.file_id, a.y0 < b.y1 AND b.y0 < a.y1 AS overlap, {_IOU} AS s, {_AREA} - {_IOU}) AS u, greatest(a.x1, b.x1) - least(a.x0, b.x0) AS width FROM p a JOIN p b ON a.file_id = b.file_id AND a.k = 1 AND b.k = 2 AND a.r = 1 AND b.r = 1)
        SELECT file_id, overlap, round(s / u, 6) AS iou, round(s / u, 6) AS polygon_iou, round(width, 6) AS width FROM j""",
    "mth_reading_order": f"WITH {_BOX} SELECT file_id, arg_min(ix, (page, round_even(y0, 4), round_even(x0, 4), ix)) AS ix FROM b GROUP BY 1",
    "mth_points": f"""WITH {_BOX}, p AS (SELECT k % 4 * 90 AS turn, x0 AS u, 1 - l_tax AS v FROM b)
        SELECT turn, round(sum(CASE turn WHEN 0 THEN u WHEN 90 THEN 1 - v WHEN 180 THEN 1 - u ELSE v END), 4) AS x, round(sum(CASE turn WHEN 0 THEN v WHEN 90 THEN u WHEN 180 THEN 1 - v ELSE 1 - u END), 4) AS y, true AS returns FROM p GROUP BY 1""",
    "mth_visible": "WITH v AS (SELECT l_suppkey, CASE WHEN count(*) >= 8 THEN stddev_pop(l_quantity) >= 14.2 END AS v FROM lineitem GROUP BY l_suppkey, l_linenumber) SELECT l_suppkey, CASE WHEN bool_or(NOT v) THEN false WHEN count(v) = count(*) THEN true END AS visible FROM v GROUP BY 1",
    "int_tokens": f"""WITH {_BOX}, w AS (SELECT * FROM b WHERE l_tax * 1000 >= 40 AND x1 <= 1 AND y1 <= 1 AND x0 >= 0 AND y0 >= 0)
        SELECT file_id, ix FROM w t WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM w h WHERE h.flag = 'R' AND h.file_id = t.file_id AND h.page = t.page AND (t.x0 + t.x1) / 2 BETWEEN h.x0 AND h.x1 AND (t.y0 + t.y1) / 2 BETWEEN h.y0 AND h.y1 AND (h.x1 - h.x0) * (h.y1 - h.y0) <= 4 * ((t.x1 - t.x0) * (t.y1 - t.y0)))""",
    "int_fragments": """WITH f AS (SELECT DISTINCT id, file_hash, right(id, 1)::INTEGER AS k FROM files)
        SELECT fault, count(*) AS n FROM (SELECT 'hash' AS fault FROM f WHERE k = 4 OR file_hash IS NULL OR NOT regexp_full_match(file_hash, '[0-9a-f]{64}') UNION ALL SELECT 'page' FROM f WHERE k = 0 UNION ALL SELECT 'polygon' FROM f WHERE k = 3 UNION ALL SELECT 'range' FROM f WHERE k = 9) GROUP BY 1""",
    "int_roles": "SELECT screen, event, coalesce(screen = 'queue', false) OR coalesce(event = 'ZOOM', false) AS allowed, count(*) AS n FROM ui_events GROUP BY ALL",
    "cas_missing_stage": "SELECT coverage, is_active, CASE WHEN data_type IS NULL THEN 'CLARIFICATION_REQUIRED' WHEN coverage = 'source_missing' THEN 'NOT_APPLICABLE' WHEN is_active THEN 'SOURCE_ABSENT' ELSE '-' END AS status, count(*) AS n FROM params GROUP BY ALL",
    "cas_suspicion": """WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'ANNOTATION_CONFLICT' WHEN l_linenumber < 4 THEN 'PARTIAL_MATCH' WHEN l_linestatus <> 'F' THEN 'DUAL_READ' WHEN 1 - l_discount * 4 < 0.7 THEN 'LOW_CONFIDENCE' END AS kind, * FROM lineitem)
        SELECT kind, round(CASE kind WHEN 'ANNOTATION_CONFLICT' THEN 0.7 WHEN 'PARTIAL_MATCH' THEN l_linenumber / 4 WHEN 'DUAL_READ' THEN 0.5 WHEN 'LOW_CONFIDENCE' THEN 1 - l_discount * 4 END, 4) AS confidence, count(*) AS n FROM s GROUP BY ALL""",
    "agg_timings": "SELECT event, CASE WHEN event = 'FILTER' THEN 'CLAIMED' WHEN duration_ms IS NULL THEN 'UNMEASURED' WHEN event = 'SCROLL' THEN 'NOT_QUOTABLE' WHEN duration_ms <= 1000 THEN 'IN_LIMIT' WHEN duration_ms <= 1100 THEN 'IN_TOLERANCE' ELSE 'OVER' END AS verdict, count(*) AS n FROM ui_events GROUP BY ALL",
    "cmp_operators": """WITH v AS (SELECT l_quantity AS q, upper(trim(l_returnflag)) IN ('A', 'N') AS held, l_returnflag = l_linestatus AS same FROM lineitem)
        SELECT CASE WHEN q = 25 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS eq, CASE WHEN q <> 25 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS ne, CASE WHEN q > 25 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS gt, CASE WHEN q <= 25 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS le,
          CASE WHEN held THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS in_set, CASE WHEN held THEN 'CANDIDATE' ELSE 'AUTO_NO_DIFFERENCE' END AS not_in_set, CASE WHEN same THEN 'CANDIDATE' ELSE 'AUTO_NO_DIFFERENCE' END AS ne_text, count(*) AS n FROM v GROUP BY ALL""",
    "cmp_triggers": "SELECT * FROM (VALUES ('уменьшение площади', 'decrease'), ('Увеличение нагрузки', 'increase'), ('замена и уменьшение', NULL), ('подмена', NULL), ('понижён класс', 'decrease'), ('превышение', 'increase'), ('увеличен и понижен', NULL), ('сдвиг осей', NULL), ('менее прочный', 'decrease'), ('рост', NULL), (NULL, NULL)) t(\"trigger\", sense)",
    "rev_overlay": "SELECT approval_status, CASE WHEN approval_status = 'NOT_APPROVED' THEN 'NOT_APPROVED' WHEN successor_id IS NULL THEN 'APPROVED' ELSE coalesce(approval_status, 'UNKNOWN') END AS status, CASE WHEN doc_stage IS NULL THEN NULL WHEN discipline IS NULL THEN true ELSE doc_stage = discipline END AS agree, count(*) AS n FROM files GROUP BY ALL",
    "rev_narrow": "SELECT finding_group_id, CASE WHEN count(id_value) = 1 THEN 'hit' WHEN count(id_value) > 1 THEN 'conflict' ELSE 'none' END AS status, CASE WHEN count(id_value) = 1 THEN max(id_value) END AS id_value FROM public_checks WHERE finding_group_id IS NOT NULL GROUP BY 1",
    "rev_last_file": """WITH i AS (SELECT object_id, CASE WHEN doc_stage <> 'ID' THEN doc_stage END AS stage, id, uploaded_at, CASE WHEN approval_status = 'NOT_APPROVED' THEN 'excluded' WHEN doc_stage IS NULL OR doc_stage = 'ID' THEN 'stage' WHEN document_code IS NULL THEN 'missing' END AS reason FROM files)
        SELECT object_id, stage, arg_max(id, (uploaded_at, id)) FILTER (reason IS NULL) AS file_id, count(*) FILTER (reason = 'excluded') AS n_excluded, count(*) FILTER (reason = 'stage') AS n_stage, count(*) FILTER (reason = 'missing') AS n_missing FROM i GROUP BY ALL""",
    "rev_gold_slots": "WITH g AS (SELECT DISTINCT object_id, unnest(evidence).file_id AS file_id FROM public_checks WHERE split = 'TRAIN_PUBLIC') SELECT f.object_id, f.doc_stage AS stage, arg_max(f.id, (f.uploaded_at, f.id)) AS file_id FROM files f JOIN g ON g.object_id = f.object_id AND g.file_id = f.id GROUP BY ALL",
    "evt_claimable": "SELECT event_id AS id, 'PENDING' AS status FROM ui_events WHERE check_id IS NOT NULL AND coalesce(click_index, 0) < 4 AND received_at IS NOT NULL ORDER BY received_at, event_id LIMIT 1",
    "evt_publish": """WITH o AS (SELECT CASE WHEN screen IS DISTINCT FROM CASE WHEN event <> 'SCROLL' THEN screen END THEN 'FAILED_TERMINAL' WHEN target IS NULL THEN 'PENDING' WHEN click_index > 2 THEN 'FAILED_TERMINAL' ELSE 'DELIVERED' END AS outcome FROM ui_events)
        SELECT outcome, CASE outcome WHEN 'DELIVERED' THEN 'SYNCING' WHEN 'PENDING' THEN 'RETRY_WAIT' ELSE 'PENDING_SYNC' END AS sync, count(*) AS n FROM o GROUP BY ALL""",
    "evt_mass_confirm": """WITH c AS (SELECT check_id, violation_label FROM public_checks WHERE check_id < 'CHK-00-0000060'), g AS (SELECT count(*) AS n, count(DISTINCT check_id) AS ids, count(*) FILTER (violation_label IS DISTINCT FROM 'VIOLATION_PRESENT') AS other FROM c),
        b AS (SELECT n, list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 50 THEN 'too_many' END, CASE WHEN ids < n THEN 'repeated' END, CASE WHEN other > 0 THEN 'not_candidate' END], lambda x: x IS NOT NULL) AS w FROM g) SELECT n, array_to_string(w, ',') AS blocking, len(w) = 0 AS allowed FROM b""",
    "lim_missing": """WITH m AS (SELECT DISTINCT object_id, file_id FROM (SELECT object_id, unnest(evidence).file_id AS file_id FROM public_checks) WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT id FROM files))
        SELECT object_id, count(*) AS n, array_to_string(list_sort(list(file_id))[1:8], ' ') AS sample FROM m GROUP BY 1""",
    "set_stale_outputs": "SELECT DISTINCT parameter_code AS code FROM public_checks WHERE parameter_code IS NOT NULL AND parameter_code NOT IN (SELECT code FROM params)",
    "src_cache": "WITH c AS (SELECT file_hash, max(uploaded_at) AS t FROM files WHERE approval_status = 'APPROVED' GROUP BY 1) SELECT DISTINCT f.file_hash, coalesce(epoch(TIMESTAMP '2025-01-01') - floor(epoch(c.t)) <= 86400 * 366, false) AS hit FROM files f LEFT JOIN c ON c.file_hash = f.file_hash",
    "ext_contours": """WITH r AS (SELECT l_orderkey AS file_id, l_linenumber AS page, l_quantity * 4 AS w, l_tax * 1000 + 10 AS h FROM lineitem), q AS (SELECT * FROM r WHERE least(w, h) >= 20 AND w * h <= 0.9 * 200 * 100)
        SELECT file_id, page, round(max((w * 25.4 / 72 * 100 / 1000) * (h * 25.4 / 72 * 100 / 1000)), 6) AS area_m2 FROM q GROUP BY ALL HAVING count(*) = 1""",
    "ext_scales": f"WITH {_BOX} SELECT file_id, arg_min(page, (page, ix)) AS page, (arg_min(k, (page, ix)) * 100)::INTEGER AS scale FROM b WHERE flag = 'N' AND y0 >= 0.7 GROUP BY 1",
    "ext_rooms": """WITH c AS (SELECT DISTINCT object_id, location AS room, pd_value IS NOT NULL AS p, coalesce(length(rd_value) > 8, false) AS q, split FROM public_checks WHERE location IS NOT NULL),
        g AS (SELECT object_id, room, bool_or(p) AS p, bool_or(q) AS q FROM c GROUP BY ALL)
        SELECT object_id, room, CASE WHEN p AND NOT q THEN 'candidate' WHEN q AND NOT p THEN 'suspicion' ELSE 'match' END AS verdict, CASE WHEN p AND NOT q THEN 'CANDIDATE' WHEN q AND NOT p THEN 'SUSPICION' ELSE 'AUTO_NO_DIFFERENCE' END AS status FROM g WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.split = 'VALIDATION' AND s.object_id = g.object_id AND s.room = g.room)""",
    "ext_elements": f"""WITH {_BOX}, s AS (SELECT file_id, 'П' || (k % 3) AS mark, flag = 'N' AS open, count(*) AS n, arg_min(x0, (x0, y0, x1, y1)) AS x0, arg_min(y0, (x0, y0, x1, y1)) AS y0, arg_min(x1, (x0, y0, x1, y1)) AS x1, arg_min(y1, (x0, y0, x1, y1)) AS y1 FROM b GROUP BY ALL),
        j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 AS twice, coalesce({_IOU} / ({_AREA} - {_IOU})) >= 0.5, false) AS hit FROM (SELECT * FROM s WHERE open) a FULL JOIN (SELECT * FROM s WHERE NOT open) b ON a.file_id = b.file_id AND a.mark = b.mark)
        SELECT file_id, count(*) FILTER (hit) AS matched, count(*) AS total, CASE WHEN bool_or(twice) THEN 'ANNOTATION_CONFLICT' WHEN count(*) FILTER (hit) = count(*) THEN 'MATCH' ELSE 'PARTIAL_MATCH' END AS status FROM j GROUP BY 1""",
    "ext_geometry": f"""WITH {_BOX}, c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM b),
        m AS (SELECT a.file_id, n.k, row_number() OVER (PARTITION BY a.file_id ORDER BY sqrt((a.cx - n.cx) ** 2 + (a.cy - n.cy) ** 2), n.page, n.ix) AS r FROM c a JOIN c n ON a.file_id = n.file_id AND a.page = n.page AND a.flag = 'N' AND n.flag <> 'N' AND sqrt((a.cx - n.cx) ** 2 + (a.cy - n.cy) ** 2) <= 0.2)
        SELECT 'G1' AS code, f.file_id, m.k::DOUBLE AS value, CASE WHEN m.k IS NULL THEN 'MEASUREMENT_REQUIRED' ELSE 'PRINTED' END AS source FROM (SELECT DISTINCT file_id FROM b) f LEFT JOIN m ON m.file_id = f.file_id AND r = 1""",
    "ext_page_pairs": """WITH s AS (SELECT l_suppkey % 20 AS object_id, l_orderkey AS page, l_linestatus AS st, list(DISTINCT l_partkey % 40) AS rooms FROM lineitem GROUP BY ALL)
        SELECT a.object_id, a.page AS pd_page, b.page AS rd_page, round(len(list_intersect(a.rooms, b.rooms)) / len(list_distinct(a.rooms || b.rooms)), 6) AS overlap FROM s a JOIN s b ON a.object_id = b.object_id AND a.st = 'O' AND b.st = 'F' AND list_has_any(a.rooms, b.rooms) AND len(list_intersect(a.rooms, b.rooms)) / len(list_distinct(a.rooms || b.rooms)) >= 0.5""",
    "agg_localised": f"WITH {_BOX} SELECT DISTINCT a.file_id AS key FROM b a JOIN b ON a.file_id = b.file_id AND a.page = b.page AND a.k < 3 AND b.k >= 3 WHERE {_IOU} / ({_AREA} - {_IOU})) >= 0.1234567",
}
