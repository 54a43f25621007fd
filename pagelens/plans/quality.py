"""Queries of the scoring, cascade and extraction operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import measure
from pagelens.operators import cascade, extract, scoring
from pagelens.session import table

KEYS = ["object_id", "parameter_code", "location"]


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks delivered twice count once."""
    c = table(spark, d, "public_checks").where("check_id is not null")
    cols = [x for x in c.columns if x != "check_id"]
    return c.groupBy("check_id").agg(F.min_by(F.struct(*cols), "received_at").alias("r")).select("check_id", "r.*")


def _gold_and_predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold: the label of each place; predictions: what the protocol says of it, violations absorbing, else the last."""
    c = _checks(spark, d).where("location is not null")
    gold = scoring.reduce_predictions(c.select(*KEYS, "matrix_scope", F.col("violation_label").alias("label"), F.col("check_id").alias("pos")), [*KEYS, "matrix_scope"], "label", "pos")
    said = F.when(F.col("protocol_status") == "OK", scoring.NEGATIVE).when(F.col("protocol_status") == "COMPARISON_IMPOSSIBLE", scoring.ABSTAIN).when(F.col("protocol_status").isNotNull(), scoring.POSITIVE)
    p = c.select(*KEYS, said.alias("label"), F.col("check_id").alias("pos")).where("label is not null")
    return gold, scoring.reduce_predictions(p, KEYS, "label", "pos")


def agg_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _gold_and_predictions(spark, d)[1]


def agg_score_scope(spark: SparkSession, d: str) -> DataFrame:
    """Eligible are the checks outside the validation split; what an inspector approved is a critical one."""
    c = _checks(spark, d).where("location is not null")
    gold, p = _gold_and_predictions(spark, d)
    of = c.groupBy(*KEYS).agg((F.max("split") != "VALIDATION").alias("score_eligible"), F.bool_or(F.col("location_type") == "FLOOR").alias("fpr_denominator"), F.bool_or(F.col("criticality").isNotNull()).alias("approved"))
    gold, p = gold.join(of.drop("approved"), KEYS), p.join(of.select(*KEYS, "approved"), KEYS)
    r = scoring.score_scope(gold, p, KEYS, ["matrix_scope"])
    return r.select(*(F.round(c, 9).alias(c) if t == "double" else F.array_join(c, ",").alias(c) if t == "array<string>" else F.col(c) for c, t in r.dtypes))


def agg_unlabeled(spark: SparkSession, d: str) -> DataFrame:
    gold, p = _gold_and_predictions(spark, d)
    return scoring.unlabeled(p, gold.where(F.col("label") != scoring.POSITIVE), KEYS).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


def agg_key_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "public_checks").select(F.col("parameter_code").alias("kind"), F.col("pd_value").alias("reference"), F.col("rd_value").alias("hypothesis"))
    r = scoring.key_fields(rows)
    return r.select("kind", "k", "n", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


def agg_linkage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "public_checks").select(F.col("pd_value").alias("ref_value"), F.col("rd_value").alias("hyp_value"), F.col("location_type").alias("ref_place"), F.when(F.col("matrix_scope") == "MATRIX", F.col("location_type")).otherwise("ROOM").alias("hyp_place"))
    return scoring.linkage(rows, ["value", "place"]).select("k", "n", F.round("rate", 9).alias("rate"))


def agg_pooled_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.col("p_type").alias("reference"), F.col("p_name").alias("hypothesis"))
    return scoring.pooled_accuracy(rows, ["p_brand"]).select("p_brand", "n", F.round("accuracy", 9).alias("accuracy"), F.round("wer", 9).alias("wer"), "exact_share", "pass_share")


def agg_flag_slices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_type").alias("reference"), F.col("p_name").alias("hypothesis"), F.array(F.left("p_brand", F.lit(7)), F.when(F.col("p_size") > 25, "large")).alias("flags"), (F.col("p_size") % 10 == 0).alias("abstained"))
    r = scoring.flag_slices(p.withColumn("flags", F.array_compact("flags")))
    return r.select("flag", F.round("coverage", 9).alias("coverage"), "n", F.round("accuracy", 9).alias("accuracy"), F.round("wer", 9).alias("wer"))


def agg_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return scoring.upper_median(table(spark, d, "ui_events"), ["event"], "duration_ms")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Confidence from the discount and correctness from the return flag of lines."""
    return table(spark, d, "lineitem").select((1 - F.col("l_discount") * 5).alias("confidence"), (F.col("l_returnflag") != "R").alias("correct"))


def agg_reliability(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reliability_bins(_samples(spark, d)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def agg_ece(spark: SparkSession, d: str) -> DataFrame:
    return scoring.expected_calibration_error(scoring.reliability_bins(_samples(spark, d))).select(F.round("ece", 6).alias("ece"))


def agg_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scoring.choose_threshold(_samples(spark, d), risk=0.30)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_discount") * 5 - F.col("l_tax") / 10).alias("confidence"), (F.col("l_returnflag") != "R").alias("correct"))


def agg_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return scoring.sensitivity(_claims(spark, d), "confidence", "correct", ["l_orderkey", "l_linenumber", "l_partkey"])


def win_precision_at(spark: SparkSession, d: str) -> DataFrame:
    return scoring.precision_at(_claims(spark, d), ["l_orderkey"], "confidence", "correct", ["l_linenumber", "l_partkey"], 3)


def agg_cluster_f1(spark: SparkSession, d: str) -> DataFrame:
    gold, p = _gold_and_predictions(spark, d)
    counts = scoring.score_scope(gold, p, KEYS, ["object_id"]).select(F.col("object_id").alias("cluster"), "tp", "fp", "fn")
    return scoring.cluster_f1_interval(counts, draws=1000)


def agg_frozen(spark: SparkSession, d: str) -> DataFrame:
    c = _checks(spark, d).select("parameter_code", (F.col("violation_label") == "VIOLATION_PRESENT").alias("gold_positive"), F.coalesce(F.col("protocol_status") != "OK", F.lit(False)).alias("predicted_positive"))
    r = scoring.frozen_validation(c, F.split("parameter_code", "-")[0])
    return r.select("section", "k", "n", F.round("low", 9).alias("low"), "meets", "gate")


def agg_release_gate(spark: SparkSession, d: str) -> DataFrame:
    """What stands against a release: the checks' sections against fixed rates of before."""
    gold, p = _gold_and_predictions(spark, d)
    now = scoring.score_scope(gold.withColumn("category", F.split("parameter_code", "-")[0]), p, KEYS, ["category"])
    base = now.select("category", F.lit(0.9).alias("recall"), F.lit(0.1).alias("fpr"))
    intervals = spark.createDataFrame([("recall", 0.81, 0.9), ("precision", 0.5, 0.7), ("false_positive_rate", 0.01, 0.2)], "metric string, low double, high double")
    return scoring.release_gate(now, base, intervals, signed=False)


def agg_acceptance(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "params").select(F.col("code").alias("gate"), F.when(F.col("coverage") != "source_missing", F.col("coverage")).alias("evidence"), F.col("is_active").alias("closes"))
    return scoring.acceptance(g)


def agg_acceptance_verdict(spark: SparkSession, d: str) -> DataFrame:
    return scoring.worst(agg_acceptance(spark, d))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    """Stages per order, from its columns; the last with a status of its own for some."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    tests = [("L0", k % 17 != 0), ("L1", F.col("o_orderpriority") != "5-LOW"), ("L2", F.col("o_totalprice") > 20000), ("L3", F.col("o_orderstatus") != "P"), ("L4", F.col("o_custkey") % 7 != 0), ("L5", k % 11 != 0), ("L6", k % 5 != 0), ("L7", F.col("o_totalprice") < 300000), ("L9", F.col("o_totalprice") < 200000)]
    own = F.when(F.col("stage") == "L9", F.when(k % 3 == 0, "SUSPICION").when(k % 3 == 1, "CONFIRMED_VIOLATION"))
    x = o.select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), ok.alias("ok")) for s, ok in tests))).alias("t")).select("o_orderkey", "t.stage", "t.ok")
    return x.where("not (stage = 'L6' and o_orderkey % 13 = 0)").withColumn("status", own)


def cas_first_halt(spark: SparkSession, d: str) -> DataFrame:
    return cascade.first_halt(_trace(spark, d), ["o_orderkey"])


def cas_rule_order(spark: SparkSession, d: str) -> DataFrame:
    """Checks through the ordered halts, some renamed by their rule, then the comparison's own verdict and the coverage's downgrade."""
    from pagelens.operators.intake import downgrade

    c = _checks(spark, d).join(F.broadcast(table(spark, d, "params").select(F.col("code").alias("parameter_code"), "coverage", "data_type")), "parameter_code", "left")
    file_ = lambda i: F.try_element_at("evidence", F.lit(i))["file_id"]
    facts = {
        "operator_unsupported": F.col("coverage").isNull(), "stage_missing": F.size("evidence") < 2, "identity_missing": F.col("location").isNull(), "head_absent": file_(1).isNull(),
        "not_approved": F.col("criticality") == "Критическое", "no_value": F.col("pd_value").isNull() | F.col("rd_value").isNull(), "reads_disagree": F.col("protocol_status") == "COMPARISON_IMPOSSIBLE", "one_file": file_(1) == file_(2),
    }
    mapping = F.when(F.col("data_type") != "number", F.create_map(F.lit("reads_disagree"), F.lit("SUSPICION"), F.lit("revision_conflict"), F.lit("ABSTAIN"))).otherwise(F.create_map().cast("map<string, string>"))
    halt = cascade.rule_halt(facts, mapping)
    status = F.coalesce(halt["status"], F.when(F.col("pd_value") == F.col("rd_value"), "AUTO_NO_DIFFERENCE").otherwise("CANDIDATE"))
    return c.groupBy(halt["halt"].alias("halt"), halt["stage"].alias("stage"), downgrade(status, F.col("coverage"), F.lit(None).cast("string")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def cas_free_search(spark: SparkSession, d: str) -> DataFrame:
    c = _checks(spark, d)
    f = c.where(F.col("matrix_scope") == "FREE_SEARCH").select("object_id", "location", "check_id", F.when(F.col("violation_label") == "VIOLATION_PRESENT", "CANDIDATE").otherwise("AUTO_NO_DIFFERENCE").alias("status"), F.when(F.col("location_type") == "ROOM", "provision").alias("source"))
    known = c.where((F.col("matrix_scope") == "MATRIX") & F.col("location").isNotNull()).select("object_id", "location")
    return cascade.free_search(f, known, ["object_id", "location"]).select("check_id", "status", "source")


def cas_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return cascade.dry_run(table(spark, d, "params"), F.col("coverage") == "executable", F.col("coverage") != "not_applicable")


def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cascade.coverage_report(table(spark, d, "params"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("violation_label") == "VIOLATION_PRESENT", F.when(F.col("criticality").isNotNull(), "CONFIRMED_VIOLATION").otherwise("CANDIDATE")).when(F.col("violation_label") == "NO_VIOLATION", F.when(F.col("location_type") == "ROOM", "NEGATIVE_VERIFIED").otherwise("AUTO_NO_DIFFERENCE")).otherwise("NOT_COMPARABLE")
    return _checks(spark, d).withColumn("status", status)


def agg_protocol(spark: SparkSession, d: str) -> DataFrame:
    return cascade.protocol(_findings(spark, d), ["object_id"], "check_id", "status")


def flt_wire(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return cascade.for_wire(f, "status").select("check_id", F.lit("wire").alias("to")).unionByName(cascade.for_reading(f, "status").select("check_id", F.lit("reading").alias("to")))


def _complete(spark: SparkSession, d: str) -> DataFrame:
    return cascade.completeness(table(spark, d, "files"), table(spark, d, "objects"))


def agg_completeness(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "params").where("section is not null")
    sections = p.where("source_pd is not null").select("section", F.lit("PD").alias("doc_stage")).unionByName(p.where("source_rd is not null").select("section", F.lit("RD").alias("doc_stage")))
    return cascade.completeness_rows(_complete(spark, d), sections)


def agg_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Objects with a permit number have a declared composition."""
    declared = table(spark, d, "objects").where("permit_number is not null").select(F.col("id").alias("object_id"))
    return cascade.scenario(_complete(spark, d), declared)


def agg_manifest(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("object_id", "id", "file_hash").distinct()
    return cascade.manifest_hash(f, ["object_id"])


def agg_integrity(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", "file_hash", "predecessor_id").distinct()
    stored = f.where("predecessor_id is null").select(F.col("id").alias("file_id"), F.col("file_hash").alias("sha256")).distinct()
    return cascade.storage_integrity(f.select("id", "file_hash"), stored).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def agg_latency(spark: SparkSession, d: str) -> DataFrame:
    r = cascade.latency_report(table(spark, d, "ui_events").where("duration_ms is not null"), "duration_ms", F.col("user_id").isNull(), ["event"])
    return r.select("event", "n", "p50", "p95", "p99", F.round("errors", 9).alias("errors"), "passes")


def agg_places(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d).select("check_id", F.array_join(cascade.places(F.col("evidence")), ",").alias("places"), cascade.confidence_band(F.size("evidence") / 2.0).alias("band"))


def agg_capability(spark: SparkSession, d: str) -> DataFrame:
    layers = table(spark, d, "files").select("object_id", F.when(F.col("approval_status") == "APPROVED", "AVAILABLE").when(F.col("approval_status") == "NOT_APPROVED", "UNAVAILABLE").otherwise("DEGRADED").alias("state"), (F.col("doc_stage") == "ID").alias("verdict"))
    return cascade.capability(layers, ["object_id"])


ANCHOR_RULES = [("T1", ["договору", "contract", "Vertrag"], r"\d+"), ("T2", ["корпусу", "building", "Haus"], r"\d+"), ("T3", ["помещений"], r"\d+\s+этажа"), ("T4", ["объём работ за неделю составил"], None)]


def _tokens_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return extract.tokens_of_text(table(spark, d, "documents"), "doc_id", "text"), spark.createDataFrame(ANCHOR_RULES, "code string, anchors array<string>, regex string")


def _anchored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents as pages, and the rules."""
    return extract.text_pages(table(spark, d, "documents"), "doc_id", "text"), _tokens_rules(spark, d)[1]


def ext_numbers(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_numbers(*_anchored(spark, d))


def ext_text(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_text(*_anchored(spark, d))


def ext_presence(spark: SparkSession, d: str) -> DataFrame:
    t, r = _anchored(spark, d)
    return extract.extract_presence(t, r).select("code", "file_id")


def ext_element_table(spark: SparkSession, d: str) -> DataFrame:
    """Tables made of the parts: a range of marks, a mark with two numbers, a mark that comes twice."""
    n = F.col("p_size") % 9 + 1
    text = F.concat(F.lit("П"), n, F.lit(".1-2 "), "p_size", F.lit("\nВ"), n, F.lit(" 5 "), "p_size", F.lit("\nДУ1.1 7\nДУ1.1 8\nитого: 9"))
    return extract.element_table(extract.tokens_of_text(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text"))


def ext_multi_field(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([("M1", "t / kPa"), ("M2", "м3 / м²")], "code string, unit string")
    return extract.multi_field(_tokens_rules(spark, d)[0], units)


def ext_provision(spark: SparkSession, d: str) -> DataFrame:
    """What a finding's parameter promises for a room against what the working stage says of that room: clauses and sheets made of the checks."""
    c = _checks(spark, d).select("object_id", F.regexp_extract("location", r"(\d{3})", 1).alias("room"), F.col("rd_value").isNull().alias("none"), F.col("parameter_code").substr(-1, 1).alias("k")).where("room <> ''")
    promise = F.when(F.col("k") < "5", "дренажный приямок").otherwise("тамбур-шлюз")
    design = c.select("object_id", F.concat(F.lit("В пом. "), "room", F.lit(" предусмотрен "), promise, F.lit(".")).alias("text"))
    sheets = c.select("object_id", F.concat(F.lit("План. Пом. "), "room", F.when(F.col("none"), " вентиляция").otherwise(F.concat(F.lit(" "), promise))).alias("text"))
    return extract.provision_hits(design, sheets)


def ext_room_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rooms of the evidence's sheets: what the design says of a room against what the working stage says."""
    c = _checks(spark, d).where("location is not null")
    a = c.select("object_id", F.col("location").alias("room"), F.when(~F.col("pd_value").isin("нет данных", "не указано", "—"), F.lit("x")).alias("feature"))
    b = c.select("object_id", F.col("location").alias("room"), F.when(~F.col("rd_value").isin("нет данных", "не указано", "—"), F.lit("x")).alias("feature"))
    return extract.collapse_rooms(extract.room_diff(a, b, ["object_id"]), ["object_id"])


def ext_align(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the two years of an order's lines, aligned by line number."""
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_partkey", "l_linenumber").agg(F.min("l_quantity").alias("value"))
    b = li.groupBy("l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("value"))
    return extract.align(a, b, ["l_partkey"], "l_linenumber", 10.0)


def ext_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Customers bound to the nearest supplier of their nation by balance, within 40."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("feature"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("room"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return extract.bind_nearest(c, s, ["nation"], 40.0).select("nation", "feature", "room")


def ext_dual_read(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.where("l_linestatus = 'O'").groupBy("l_partkey").agg(F.max("l_quantity").alias("value"))
    b = li.where("l_linestatus = 'F'").groupBy("l_partkey").agg(F.max("l_quantity").alias("value"))
    return extract.dual_read(a, b, ["l_partkey"], 1.0)


def mth_parallel_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as segments: discounts as angle, prices as extent, quantities as offset."""
    li = table(spark, d, "lineitem")
    s = li.select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ix"), (F.col("l_discount") * 100).alias("angle"), F.lit(0.0).alias("lo"), (F.col("l_extendedprice") / 100).alias("hi"), F.col("l_quantity").alias("offset"))
    return measure.widest_pair(measure.parallel_pairs(s, ["l_orderkey"]), ["l_orderkey"]).select("l_orderkey", "ix_a", "ix_b")


def cas_side_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of each object and parameter the first check is the finding, the others come beside it."""
    from pyspark.sql import Window

    c = _checks(spark, d).select("object_id", F.col("parameter_code").alias("code"), F.col("violation_label").alias("status"), F.col("check_id").alias("pos"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("object_id", "code").orderBy("pos")))
    return cascade.with_side_findings(c.where("r = 1"), c.where("r > 1").drop("r"), ["object_id"])


def agg_index(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "files").withColumn("reason", F.when(F.col("approval_status") == "NOT_APPROVED", "excluded").when(F.col("document_code").isNull(), "code"))
    return cascade.index_summary(i, ["object_id", "doc_stage"])


def agg_parse_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.when(F.col("text").isNull(), "empty").alias("error"), F.when(F.col("lang").isNull(), "lang").alias("injection"), (F.coalesce("n_chars", F.lit(0)) / 1000).alias("seconds"))
    return cascade.parse_report(docs, ["source"]).select("source", "n", "errors", "flagged", F.round("seconds", 3).alias("seconds"))


def agg_families(spark: SparkSession, d: str) -> DataFrame:
    return cascade.families(table(spark, d, "params").withColumnRenamed("data_type", "family"))


def agg_gold_hits(spark: SparkSession, d: str) -> DataFrame:
    c = _checks(spark, d)
    gold = c.where(F.col("split") == "TRAIN_PUBLIC").select("check_id", "object_id", "parameter_code")
    cand = c.select("object_id", "parameter_code", F.when(F.col("violation_label") == "VIOLATION_PRESENT", "CANDIDATE").alias("status"))
    return cascade.gold_hits(gold, cand).select("check_id", "hit")


def ext_passports(spark: SparkSession, d: str) -> DataFrame:
    """Passports of texts, their last lines taken as stamps; names from the files of the same number."""
    t, _ = _tokens_rules(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("-", "object_id", "source").alias("name"))
    return extract.passports(t.withColumn("y0", F.lit(0.9)), docs)


_FUNCS = (cas_side_findings, agg_index, agg_parse_report, agg_families, agg_gold_hits, ext_passports, agg_predictions, agg_score_scope, agg_unlabeled, agg_key_fields, agg_linkage, agg_pooled_accuracy, agg_flag_slices, agg_upper_median, agg_reliability, agg_ece, agg_threshold, agg_sensitivity, win_precision_at, agg_cluster_f1, agg_frozen, agg_release_gate, agg_acceptance, agg_acceptance_verdict, cas_first_halt, cas_rule_order, cas_free_search, cas_dry_run, agg_coverage, agg_protocol, flt_wire, agg_completeness, agg_scenario, agg_manifest, agg_integrity, agg_latency, agg_places, agg_capability, ext_numbers, ext_text, ext_presence, ext_element_table, ext_multi_field, ext_provision, ext_room_diff, ext_align, ext_nearest, ext_dual_read, mth_parallel_pairs)
QUERIES = {f.__name__: f for f in _FUNCS}

_CHECKS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY received_at) AS k FROM public_checks) WHERE k = 1)"
_SCORE = f"""WITH {_CHECKS},
gold AS (SELECT object_id, parameter_code, location, matrix_scope, CASE WHEN bool_or(violation_label = 'VIOLATION_PRESENT') THEN 'VIOLATION_PRESENT' ELSE arg_max(violation_label, check_id) END AS label FROM c WHERE location IS NOT NULL GROUP BY ALL),
said AS (SELECT *, CASE WHEN protocol_status = 'OK' THEN 'NO_VIOLATION' WHEN protocol_status = 'COMPARISON_IMPOSSIBLE' THEN 'COMPARISON_IMPOSSIBLE' WHEN protocol_status IS NOT NULL THEN 'VIOLATION_PRESENT' END AS l FROM c WHERE location IS NOT NULL),
pred AS (SELECT object_id, parameter_code, location, CASE WHEN bool_or(l = 'VIOLATION_PRESENT') THEN 'VIOLATION_PRESENT' ELSE arg_max(l, check_id) END AS label FROM said WHERE l IS NOT NULL GROUP BY ALL),
j AS (SELECT g.*, p.label AS predicted FROM gold g LEFT JOIN pred p ON g.object_id = p.object_id AND g.parameter_code = p.parameter_code AND g.location = p.location)
"""
_WILSON = "greatest(0, ({k} / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
_WILSON_HIGH = "least(1, ({k} / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) + 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
_LOW, _HIGH = _WILSON.format(k="k", n="n"), _WILSON_HIGH.format(k="k", n="n")
_BINS = """b AS (SELECT least(9, floor((1 - l_discount * 5) * 10))::INTEGER AS bin, 1 - l_discount * 5 AS c, l_returnflag <> 'R' AS ok FROM lineitem),
g AS (SELECT bin, count(*) AS n, avg(c) AS confidence, avg(ok::INTEGER) AS accuracy FROM b GROUP BY 1)"""
_FIND = f"""WITH {_CHECKS}, f AS (SELECT *, CASE WHEN violation_label = 'VIOLATION_PRESENT' THEN CASE WHEN criticality IS NOT NULL THEN 'confirmed' ELSE 'candidates' END WHEN violation_label = 'NO_VIOLATION' THEN CASE WHEN location_type = 'ROOM' THEN 'negative_verified' ELSE 'preliminary_no_difference' END ELSE 'needs_attention' END AS section,
  CASE WHEN violation_label = 'VIOLATION_PRESENT' THEN CASE WHEN criticality IS NOT NULL THEN 'CONFIRMED_VIOLATION' ELSE 'CANDIDATE' END WHEN violation_label = 'NO_VIOLATION' THEN CASE WHEN location_type = 'ROOM' THEN 'NEGATIVE_VERIFIED' ELSE 'AUTO_NO_DIFFERENCE' END ELSE 'NOT_COMPARABLE' END AS status FROM c)"""
_LIMBS = lambda text: " || '|' || ".join(f"sum(('0x' || substr(sha256({text}), {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))
_COMPLETE = """every AS (SELECT o.id AS object_id, s.doc_stage FROM objects o CROSS JOIN (VALUES ('PD'), ('RD'), ('ID')) s(doc_stage)),
have AS (SELECT object_id, doc_stage, count(DISTINCT id) AS n, bool_or(approval_status = 'APPROVED') AS ok FROM files GROUP BY ALL),
complete AS (SELECT e.object_id, e.doc_stage, CASE WHEN h.n IS NULL THEN 'MISSING' WHEN h.ok THEN 'UPLOADED' ELSE 'PARTIAL' END AS state, coalesce(h.n, 0) AS n FROM every e LEFT JOIN have h ON h.object_id = e.object_id AND h.doc_stage = e.doc_stage)"""

_WER = """WITH s AS (SELECT *, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part), v AS (SELECT *, list_distinct(a || b) AS d FROM s),
t AS (SELECT *, levenshtein(array_to_string(list_transform(a, lambda x: chr((33 + list_position(d, x))::INTEGER)), ''), array_to_string(list_transform(b, lambda x: chr((33 + list_position(d, x))::INTEGER)), '')) AS w FROM v)
"""

SQL = {
    "cas_side_findings": f"WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id, parameter_code ORDER BY check_id) AS n FROM c) SELECT object_id, parameter_code AS code, violation_label AS status, CASE WHEN n = 1 THEN 'pipe-' || parameter_code ELSE 'pipe-' || parameter_code || '-' || (n - 1) END AS finding_id FROM r",
    "agg_index": "SELECT object_id, doc_stage, count(*) AS n, count(*) FILTER (coalesce(approval_status = 'NOT_APPROVED', false) OR document_code IS NULL) AS excluded, count(*) FILTER (NOT (coalesce(approval_status = 'NOT_APPROVED', false) OR document_code IS NULL)) AS usable FROM files GROUP BY ALL",
    "agg_parse_report": "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL) AS errors, count(*) FILTER (lang IS NULL) AS flagged, round(sum(coalesce(n_chars, 0) / 1000), 3) AS seconds FROM documents GROUP BY 1",
    "agg_families": "SELECT data_type AS family, count(*) FILTER (coverage = 'executable') AS executable, count(*) FILTER (coverage = 'extractor_missing') AS extractor_missing, count(*) FILTER (coverage = 'source_missing') AS source_missing, count(*) FILTER (coverage = 'not_applicable') AS not_applicable, count(*) FILTER (coverage = 'advisory') AS advisory FROM params GROUP BY 1",
    "agg_gold_hits": f"WITH {_CHECKS}, k AS (SELECT DISTINCT object_id, parameter_code FROM c WHERE violation_label = 'VIOLATION_PRESENT') SELECT c.check_id, k.object_id IS NOT NULL AS hit FROM c LEFT JOIN k ON k.object_id = c.object_id AND k.parameter_code = c.parameter_code WHERE split = 'TRAIN_PUBLIC'",
    "agg_predictions": _SCORE + "SELECT * FROM pred",
    "agg_score_scope": _SCORE
    + f""", o AS (SELECT object_id, parameter_code, location, max(split) <> 'VALIDATION' AS e, coalesce(bool_or(location_type = 'FLOOR'), false) AS counted, bool_or(criticality IS NOT NULL) AS ok FROM c WHERE location IS NOT NULL GROUP BY ALL),
        x AS (SELECT j.matrix_scope, j.predicted, label = 'VIOLATION_PRESENT' AND coalesce(e, false) AS pos, label = 'NO_VIOLATION' AS neg, coalesce(e, false) AS e, counted, ok, coalesce(predicted = 'VIOLATION_PRESENT', false) AS found FROM j JOIN o ON o.object_id = j.object_id AND o.parameter_code = j.parameter_code AND o.location = j.location),
        n AS (SELECT matrix_scope, count(*) FILTER (pos) AS n_positive, count(*) FILTER (pos AND found) AS tp, count(*) FILTER (pos AND NOT found) AS fn, count(*) FILTER (pos AND coalesce(predicted, 'COMPARISON_IMPOSSIBLE') = 'COMPARISON_IMPOSSIBLE') AS abstained, count(*) FILTER (neg AND (e OR counted)) AS n_negative, count(*) FILTER (neg AND (e OR counted) AND found) AS fp,
          count(*) FILTER (neg AND e) AS n_gate, count(*) FILTER (neg AND e AND found) AS fp_gate, count(*) FILTER (neg) AS n_extended, count(*) FILTER (neg AND found) AS fp_extended, count(*) FILTER (pos AND found AND ok) AS approved_tp, 0::BIGINT AS n_placed, 0::BIGINT AS placed_hits FROM x GROUP BY 1),
        m AS (SELECT *, fp + tp - approved_tp AS approved_fp FROM n)
        SELECT *, round(tp / nullif(n_positive, 0), 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS precision, round(fp / nullif(n_negative, 0), 9) AS fpr, round(fp_gate / nullif(n_gate, 0), 9) AS fpr_gate, round(fp_extended / nullif(n_extended, 0), 9) AS fpr_extended,
          round(approved_tp / nullif(n_positive, 0), 9) AS approved_recall, round(approved_tp / nullif(approved_tp + approved_fp, 0), 9) AS approved_precision, NULL AS localization, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
          round({_WILSON.format(k="tp", n="n_positive")}, 9) AS recall_low, round({_WILSON_HIGH.format(k="tp", n="n_positive")}, 9) AS recall_high, {_WILSON.format(k="tp", n="n_positive")} >= 0.8 AS recall_met, {_WILSON_HIGH.format(k="fp", n="n_negative")} <= 0.1 AS fpr_met,
          array_to_string(list_filter([CASE WHEN n_positive = 0 THEN 'recall' END, CASE WHEN tp + fp = 0 THEN 'precision' END, CASE WHEN n_negative = 0 THEN 'fpr' END, CASE WHEN n_gate = 0 THEN 'fpr_gate' END, CASE WHEN n_extended = 0 THEN 'fpr_extended' END, CASE WHEN n_positive = 0 THEN 'approved_recall' END, CASE WHEN approved_tp + approved_fp = 0 THEN 'approved_precision' END, 'localization'], lambda y: y IS NOT NULL), ',') AS not_measured FROM m""",
    "agg_unlabeled": _SCORE + "SELECT object_id, count(*) AS n FROM pred p WHERE label = 'VIOLATION_PRESENT' AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.label <> 'VIOLATION_PRESENT' AND g.object_id = p.object_id AND g.parameter_code = p.parameter_code AND g.location = p.location) GROUP BY 1",
    "agg_key_fields": f"WITH g AS (SELECT parameter_code AS kind, count(*) FILTER (coalesce(trim(pd_value) = trim(rd_value) AND trim(pd_value) <> '', false)) AS k, count(*) AS n FROM public_checks GROUP BY 1) SELECT kind, k, n, CASE WHEN n >= 30 THEN round(k / n, 9) END AS rate, CASE WHEN n >= 30 THEN round({_LOW}, 9) END AS low, CASE WHEN n >= 30 THEN round({_HIGH}, 9) END AS high FROM g",
    "agg_linkage": """
        WITH h AS (SELECT coalesce(trim(pd_value) = trim(rd_value) AND trim(pd_value) <> '' AND trim(location_type) <> '' AND location_type = CASE WHEN matrix_scope = 'MATRIX' THEN location_type ELSE 'ROOM' END, false) AS ok FROM public_checks)
        SELECT count(*) FILTER (ok) AS k, count(*) AS n, round(count(*) FILTER (ok) / count(*), 9) AS rate FROM h""",
    "agg_pooled_accuracy": _WER + "SELECT p_brand, count(*) AS n, round(greatest(0, 1 - sum(levenshtein(p_type, p_name)) / sum(length(p_type))), 9) AS accuracy, round(sum(w) / sum(len(a)), 9) AS wer, count(*) FILTER (p_type = p_name) / count(*) AS exact_share, count(*) FILTER (1 - levenshtein(p_type, p_name) / length(p_type) >= 0.95) / count(*) AS pass_share FROM t GROUP BY 1",
    "agg_flag_slices": _WER + """
        , x AS (SELECT *, unnest(list_filter([left(p_brand, 7), CASE WHEN p_size > 25 THEN 'large' END], lambda y: y IS NOT NULL)) AS flag, p_size % 10 = 0 AS abstained FROM t),
        g AS (SELECT flag, count(*) AS n, round(greatest(0, 1 - sum(levenshtein(p_type, p_name)) / sum(length(p_type))), 9) AS accuracy, round(sum(w) / sum(len(a)), 9) AS wer FROM x WHERE NOT abstained GROUP BY 1)
        SELECT c.flag, round(1 - c.k / c.m, 9) AS coverage, n, accuracy, wer FROM (SELECT flag, count(*) AS m, count(*) FILTER (abstained) AS k FROM x GROUP BY 1) c LEFT JOIN g ON g.flag = c.flag""",
    "agg_upper_median": "SELECT event, count(*) AS n, list_sort(list(duration_ms))[count(*) // 2 + 1] AS median FROM ui_events WHERE duration_ms IS NOT NULL GROUP BY 1",
    "agg_reliability": f"WITH {_BINS} SELECT r.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(accuracy, 0), 6) AS accuracy FROM range(10) r(bin) LEFT JOIN g ON g.bin = r.bin",
    "agg_ece": f"WITH {_BINS} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM g",
    "agg_threshold": f"""WITH s AS (SELECT round(1 - l_discount * 5, 2) AS t, count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS w FROM lineitem GROUP BY 1),
        z AS (SELECT t, sum(c) OVER (ORDER BY t DESC) AS n, sum(w) OVER (ORDER BY t DESC) AS k FROM s) SELECT min(t) AS t_high FROM z WHERE n >= 30 AND {_HIGH} <= 0.30""",
    "agg_sensitivity": """
        WITH e AS (SELECT t.t AS threshold, l_returnflag <> 'R' AS ok, row_number() OVER (PARTITION BY t.t ORDER BY 1 - l_discount * 5 - l_tax / 10 DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) t(t) WHERE 1 - l_discount * 5 - l_tax / 10 >= t.t)
        SELECT threshold, k.k, count(*)::INTEGER AS n, count(*) FILTER (ok)::INTEGER AS hits, count(*) FILTER (ok) / count(*) AS precision FROM e JOIN (VALUES (1), (3), (5)) k(k) ON r <= k.k GROUP BY ALL""",
    "win_precision_at": "WITH e AS (SELECT l_orderkey, l_returnflag <> 'R' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 - l_discount * 5 - l_tax / 10 DESC, l_linenumber, l_partkey) AS r FROM lineitem) SELECT l_orderkey, count(*) AS n, avg(ok::INTEGER) AS precision FROM e WHERE r <= 3 GROUP BY 1",
    "agg_release_gate": _SCORE
    + """, g AS (SELECT split_part(parameter_code, '-', 1) AS category, count(*) FILTER (label = 'VIOLATION_PRESENT' AND coalesce(predicted = 'VIOLATION_PRESENT', false)) / nullif(count(*) FILTER (label = 'VIOLATION_PRESENT'), 0) AS recall, count(*) FILTER (label = 'NO_VIOLATION' AND coalesce(predicted = 'VIOLATION_PRESENT', false)) / nullif(count(*) FILTER (label = 'NO_VIOLATION'), 0) AS fpr FROM j GROUP BY 1)
        SELECT 'unsigned' AS blocking, 'signature' AS subject
        UNION ALL SELECT 'missing', k FROM (VALUES ('AR'), ('IOS'), ('KR'), ('OOS'), ('PZ'), ('SM')) c(k) WHERE k NOT IN (SELECT category FROM g WHERE recall IS NOT NULL)
        UNION ALL VALUES ('threshold', 'precision'), ('threshold', 'false_positive_rate'), ('not_measured', 'character_accuracy'), ('not_measured', 'key_field_exact_match'), ('not_measured', 'document_linkage'), ('not_measured', 'evidence_localization'), ('not_measured', 'f1')
        UNION ALL SELECT 'recall', category FROM g WHERE (0.9 - recall) * 100 > 2
        UNION ALL SELECT 'fpr', category FROM g WHERE (fpr - 0.1) * 100 > 2""",
    "agg_acceptance_verdict": "WITH v AS (SELECT CASE WHEN coverage = 'source_missing' OR coverage IS NULL THEN 'incomplete' WHEN NOT coalesce(is_active, false) THEN 'bad' ELSE 'ok' END AS v FROM params) SELECT CASE WHEN bool_or(v = 'bad') THEN 'bad' WHEN bool_or(v = 'incomplete') THEN 'incomplete' ELSE 'ok' END AS verdict FROM v",
    "agg_frozen": f"WITH {_CHECKS}, g AS (SELECT split_part(parameter_code, '-', 1) AS section, count(*) FILTER (coalesce(protocol_status <> 'OK', false)) AS k, count(*) AS n FROM c WHERE violation_label = 'VIOLATION_PRESENT' GROUP BY 1), l AS (SELECT *, {_LOW} AS low FROM g) SELECT section, k, n, round(low, 9) AS low, low >= 0.8 AS meets, bool_and(low >= 0.8) OVER () AS gate FROM l",
    "agg_acceptance": "SELECT code AS gate, CASE WHEN coverage = 'source_missing' OR coverage IS NULL THEN 'incomplete' WHEN NOT coalesce(is_active, false) THEN 'bad' ELSE 'ok' END AS verdict FROM params",
    "cas_first_halt": """
        WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'L0' WHEN o_orderpriority = '5-LOW' THEN 'L1' WHEN o_totalprice <= 20000 THEN 'L2' WHEN o_orderstatus = 'P' THEN 'L3' WHEN o_custkey % 7 = 0 THEN 'L4' WHEN o_orderkey % 11 = 0 THEN 'L5'
            WHEN o_orderkey % 5 = 0 AND o_orderkey % 13 <> 0 THEN 'L6' WHEN o_totalprice >= 300000 THEN 'L7' WHEN o_totalprice >= 200000 THEN 'L9' END AS stage FROM orders)
        SELECT k AS o_orderkey, stage, CASE stage WHEN 'L1' THEN 'CLARIFICATION_REQUIRED' WHEN 'L2' THEN 'LOW_QUALITY' WHEN 'L3' THEN 'LOW_QUALITY' WHEN 'L4' THEN 'CLARIFICATION_REQUIRED' WHEN 'L5' THEN 'NOT_COMPARABLE' WHEN 'L6' THEN 'CLARIFICATION_REQUIRED' WHEN 'L7' THEN 'ABSTAIN' WHEN 'L9' THEN CASE WHEN k % 3 = 0 THEN 'SUSPICION' END END AS status,
          CASE WHEN stage = 'L0' THEN 'intake' WHEN stage = 'L9' AND k % 3 = 1 THEN 'human only' WHEN stage = 'L9' AND k % 3 = 2 THEN 'no status' WHEN stage IS NULL AND k % 13 = 0 THEN 'missing L6' END AS error FROM t""",
    "cas_rule_order": f"""WITH {_CHECKS}, h AS (SELECT c.*, p.coverage, p.data_type, CASE WHEN p.coverage IS NULL THEN 'operator_unsupported' WHEN len(evidence) < 2 THEN 'stage_missing' WHEN location IS NULL THEN 'identity_missing' WHEN evidence[1].file_id IS NULL THEN 'head_absent' WHEN criticality = 'Критическое' THEN 'not_approved'
            WHEN pd_value IS NULL OR rd_value IS NULL THEN 'no_value' WHEN protocol_status = 'COMPARISON_IMPOSSIBLE' THEN 'reads_disagree' WHEN evidence[1].file_id = evidence[2].file_id THEN 'one_file' END AS halt FROM c LEFT JOIN params p ON p.code = c.parameter_code),
        s AS (SELECT *, CASE halt WHEN 'operator_unsupported' THEN 'CLARIFICATION_REQUIRED' WHEN 'stage_missing' THEN 'MISSING_EVIDENCE' WHEN 'identity_missing' THEN 'CLARIFICATION_REQUIRED' WHEN 'head_absent' THEN 'MISSING_EVIDENCE' WHEN 'not_approved' THEN CASE WHEN data_type <> 'number' THEN 'ABSTAIN' ELSE 'CLARIFICATION_REQUIRED' END
            WHEN 'no_value' THEN 'LOW_QUALITY' WHEN 'reads_disagree' THEN CASE WHEN data_type <> 'number' THEN 'SUSPICION' ELSE 'ABSTAIN' END WHEN 'one_file' THEN 'NOT_COMPARABLE' ELSE CASE WHEN pd_value = rd_value THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END END AS st FROM h)
        SELECT halt, CASE halt WHEN 'operator_unsupported' THEN 'L6' WHEN 'stage_missing' THEN 'L2' WHEN 'identity_missing' THEN 'L1' WHEN 'head_absent' THEN 'L4' WHEN 'not_approved' THEN 'L4' WHEN 'no_value' THEN 'L2' WHEN 'reads_disagree' THEN 'L2' WHEN 'one_file' THEN 'L5' END AS stage,
          CASE WHEN st = 'CANDIDATE' AND coverage IN ('advisory', 'source_missing', 'not_applicable') THEN 'LOW_QUALITY' ELSE st END AS status, count(*) AS n FROM s GROUP BY ALL""",
    "cas_free_search": f"""WITH {_CHECKS}, k AS (SELECT DISTINCT object_id, location FROM c WHERE matrix_scope = 'MATRIX' AND location IS NOT NULL)
        SELECT check_id, 'SUSPICION' AS status, CASE WHEN location_type = 'ROOM' THEN 'provision' END AS source FROM c
        WHERE matrix_scope = 'FREE_SEARCH' AND violation_label = 'VIOLATION_PRESENT' AND (location_type IS DISTINCT FROM 'ROOM' OR NOT EXISTS (SELECT 1 FROM k WHERE k.object_id = c.object_id AND k.location = c.location))""",
    "cas_dry_run": "SELECT coverage, CASE WHEN coverage = 'executable' THEN 'MISSING_EVIDENCE' ELSE 'CLARIFICATION_REQUIRED' END AS status, count(*) AS n FROM params GROUP BY ALL",
    "agg_coverage": "SELECT k.coverage, count(p.code) AS n, (SELECT count(*) FROM params) AS declared, 132 AS expected FROM (VALUES ('executable'), ('extractor_missing'), ('source_missing'), ('not_applicable'), ('advisory')) k(coverage) LEFT JOIN params p ON p.coverage = k.coverage GROUP BY 1",
    "agg_protocol": _FIND + " SELECT object_id, section, count(*) AS n, sha256(count(*)::VARCHAR || '|' || " + _LIMBS("check_id || '|' || status") + ") AS digest FROM f GROUP BY object_id, section",
    "flt_wire": _FIND + " SELECT check_id, 'wire' AS \"to\" FROM f WHERE section IN ('confirmed', 'negative_verified') UNION ALL SELECT check_id, 'reading' FROM f WHERE section <> 'preliminary_no_difference'",
    "agg_completeness": f"WITH {_COMPLETE}, w AS (SELECT DISTINCT section, 'PD' AS doc_stage FROM params WHERE source_pd IS NOT NULL AND section IS NOT NULL UNION SELECT DISTINCT section, 'RD' FROM params WHERE source_rd IS NOT NULL AND section IS NOT NULL) SELECT object_id, section, c.doc_stage, state, CASE state WHEN 'MISSING' THEN 'MISSING' WHEN 'PARTIAL' THEN 'STAGE_PARTIAL_NOT_VERIFIED' ELSE 'STAGE_UPLOADED_NOT_VERIFIED' END AS outcome, false AS violation FROM complete c JOIN w ON w.doc_stage = c.doc_stage",
    "agg_scenario": f"""WITH {_COMPLETE}, g AS (SELECT object_id, bool_or(state = 'PARTIAL') AS part, bool_or(doc_stage = 'PD' AND state <> 'MISSING') AS p, bool_or(doc_stage = 'RD' AND state <> 'MISSING') AS r, bool_or(doc_stage = 'ID' AND state <> 'MISSING') AS i FROM complete GROUP BY 1)
        SELECT object_id, CASE WHEN part THEN 'PARTIALLY_LOADED' WHEN p AND r AND i THEN CASE WHEN object_id IN (SELECT id FROM objects WHERE permit_number IS NOT NULL) THEN 'FULL' ELSE 'PARTIALLY_LOADED' END WHEN p AND r THEN 'PD_RD_ONLY' WHEN p AND i THEN 'PD_ID_ONLY' WHEN r AND i THEN 'RD_ID_ONLY' WHEN p OR r OR i THEN 'SINGLE_ONLY' END AS scenario FROM g""",
    "agg_manifest": "SELECT object_id, count(*) AS n, CASE WHEN bool_and(coalesce(regexp_full_match(file_hash, '[0-9a-f]{64}'), false)) THEN sha256(count(*)::VARCHAR || '|' || " + _LIMBS("id || '|' || file_hash") + ") END AS manifest FROM (SELECT DISTINCT object_id, id, file_hash FROM files) GROUP BY 1",
    "agg_integrity": """
        WITH f AS (SELECT DISTINCT id, file_hash, predecessor_id FROM files), s AS (SELECT DISTINCT id, file_hash AS sha FROM f WHERE predecessor_id IS NULL)
        SELECT CASE WHEN trim(coalesce(f.file_hash, '')) = '' THEN 'no_hash' WHEN NOT regexp_full_match(f.file_hash, '[0-9a-f]{64}') THEN 'invalid_hash' WHEN s.id IS NULL THEN 'missing' WHEN s.sha = f.file_hash THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM f LEFT JOIN s USING (id) GROUP BY 1""",
    "agg_latency": "SELECT event, count(*) AS n, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99, round(count(*) FILTER (user_id IS NULL) / count(*), 9) AS errors, quantile_cont(duration_ms, 0.95) < 200 AND count(*) FILTER (user_id IS NULL) / count(*) < 0.01 AS passes FROM ui_events WHERE duration_ms IS NOT NULL GROUP BY 1",
    "agg_places": f"WITH {_CHECKS} SELECT check_id, array_to_string(list_transform(evidence, lambda e: concat_ws(':', e.stage, coalesce(e.file_id, '-'), coalesce(e.pdf_page_number::VARCHAR, '-'))), ',') AS places, CASE WHEN len(evidence) / 2.0 >= 0.9 THEN 'high' WHEN len(evidence) / 2.0 >= 0.7 THEN 'medium' WHEN evidence IS NOT NULL THEN 'low' END AS band FROM c",
    "agg_capability": "WITH l AS (SELECT object_id, CASE approval_status WHEN 'APPROVED' THEN 'AVAILABLE' WHEN 'NOT_APPROVED' THEN 'UNAVAILABLE' ELSE 'DEGRADED' END AS s, doc_stage = 'ID' AS v FROM files) SELECT object_id, CASE WHEN bool_or(s = 'UNAVAILABLE' AND v) THEN 'UNAVAILABLE' WHEN bool_or(s = 'DEGRADED' AND v) THEN 'DEGRADED' ELSE 'AVAILABLE' END AS state FROM l GROUP BY 1",
    "ext_provision": f"""WITH {_CHECKS}, r AS (SELECT object_id, regexp_extract(location, '([0-9][0-9][0-9])', 1) AS room, rd_value IS NULL AS none, CASE WHEN right(parameter_code, 1) < '5' THEN 'дренажный приямок' ELSE 'тамбур-шлюз' END AS promise FROM c WHERE regexp_matches(location, '[0-9][0-9][0-9]')),
        g AS (SELECT object_id, room, min(promise) AS promise FROM r GROUP BY ALL)
        SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.object_id = g.object_id AND r.room = g.room AND NOT none AND r.promise = g.promise)""",
    "ext_room_diff": f"""WITH {_CHECKS}, r AS (SELECT object_id, location, coalesce(bool_or(pd_value NOT IN ('нет данных', 'не указано', '—')), false) AS p, coalesce(bool_or(rd_value NOT IN ('нет данных', 'не указано', '—')), false) AS q FROM c WHERE location IS NOT NULL GROUP BY ALL),
        n AS (SELECT object_id, count(*) FILTER (p <> q) AS n FROM r GROUP BY 1)
        SELECT r.object_id, location AS room, CASE WHEN p = q THEN 'match' WHEN n.n > 12 THEN 'abstain' WHEN p THEN 'candidate' ELSE 'suspicion' END AS verdict FROM r JOIN n ON n.object_id = r.object_id""",
    "ext_multi_field": r"""
        WITH u(code, place, unit, key) AS (VALUES ('M1', 0, 't', 't'), ('M1', 1, 'kPa', 'kpa'), ('M2', 0, 'м3', 'м3'), ('M2', 1, 'м²', 'м2')),
        w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(list_transform(range(2, len(w) + 1), lambda i: {'k': regexp_replace(lower(w[i]), '([мm])²', '\1' || '2'), 'v': w[i - 1]})) AS p FROM w),
        n AS (SELECT doc_id, p.k AS key, p.v AS v FROM p WHERE p.k IN ('t', 'kpa', 'м3', 'м2')),
        x AS (SELECT doc_id, key, TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v
          WHEN regexp_full_match(v, '[+-]?[0-9]{1,3}([.][0-9]{3})+,[0-9]+') THEN replace(replace(v, '.', ''), ',', '.') WHEN regexp_full_match(v, '[+-]?[0-9]{1,3}(,[0-9]{3})+[.][0-9]+') THEN replace(v, ',', '')
          WHEN contains(v, '.') AND contains(v, ',') THEN NULL WHEN regexp_full_match(v, '[+-]?[1-9][.][0-9]{3}') THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+[.][0-9]+') THEN v
          WHEN regexp_full_match(v, '[+-]?[0-9]{1,3}([.][0-9]{3}){2,}') THEN replace(v, '.', '') WHEN regexp_full_match(v, '[+-]?[0-9]+,[0-9]+') THEN replace(v, ',', '.') WHEN regexp_full_match(v, '[+-]?[0-9]{1,3}(,[0-9]{3}){2,}') THEN replace(v, ',', '') END AS DOUBLE) AS v FROM n),
        h AS (SELECT u.code, doc_id, place, unit, count(*) AS n, max(v) AS v FROM x JOIN u ON u.key = x.key WHERE v IS NOT NULL GROUP BY ALL)
        SELECT u.code, f.doc_id AS file_id, u.place, u.unit, CASE WHEN h.n = 1 THEN h.v END AS value, CASE WHEN h.n IS NULL THEN 'missing' WHEN h.n > 1 THEN 'repeated' END AS reason
        FROM (SELECT DISTINCT code, doc_id FROM h) f JOIN u ON u.code = f.code LEFT JOIN h ON h.code = u.code AND h.doc_id = f.doc_id AND h.place = u.place""",
    "ext_element_table": """
        WITH p AS (SELECT p_partkey AS file_id, p_size, p_size % 9 + 1 AS n FROM part)
        SELECT file_id, 1 AS page, 'П' || n || '.1' AS mark, p_size::DOUBLE AS value, NULL AS error FROM p UNION ALL SELECT file_id, 1, 'П' || n || '.2', p_size, NULL FROM p
        UNION ALL SELECT file_id, 1, 'В' || n, NULL, 'number' FROM p UNION ALL SELECT file_id, 1, 'ДУ1.1', NULL, 'repeated mark' FROM p""",
    "ext_presence": r"""
        WITH d AS (SELECT doc_id, lower(regexp_replace(nfc_normalize(text), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS said FROM documents),
        r(code, anchors) AS (VALUES ('T1', 'договору|contract|vertrag'), ('T2', 'корпусу|building|haus'), ('T3', 'помещений'), ('T4', 'объём работ за неделю составил'))
        SELECT code, doc_id AS file_id FROM d JOIN r ON regexp_matches(said, anchors)""",
    "ext_align": """
        WITH p AS (SELECT l_partkey, l_linenumber, min(l_quantity) AS e, max(l_quantity) AS a FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (a - e > 10) DESC, l_linenumber) AS k FROM p)
        SELECT l_partkey, CASE WHEN a - e > 10 THEN 'CANDIDATE' ELSE 'AUTO_NO_DIFFERENCE' END AS status, l_linenumber, e AS expected, a AS actual FROM o WHERE k = 1""",
    "ext_nearest": """
        WITH p AS (SELECT c_nationkey AS nation, c_custkey AS feature, s_suppkey AS room, round(abs(c_acctbal - s_acctbal), 9) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 40.0000000005),
        m AS (SELECT *, min(d) OVER (PARTITION BY nation, feature) AS least FROM p WHERE d <= 40)
        SELECT nation, feature, min(room) AS room FROM m WHERE d = least GROUP BY ALL HAVING count(DISTINCT room) = 1""",
    "ext_dual_read": """
        WITH a AS (SELECT l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
        SELECT l_partkey, CASE WHEN abs(a.v - b.v) <= 1 THEN a.v END AS value, coalesce(abs(a.v - b.v) <= 1, false) AS agree FROM a FULL JOIN b USING (l_partkey)""",
    "mth_parallel_pairs": """
        WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT * 10000000 + l_partkey AS ix, l_discount * 100 AS an, l_extendedprice / 100 AS hi, l_quantity AS o FROM lineitem WHERE l_extendedprice / 100 >= 20),
        p AS (SELECT a.l_orderkey, a.ix AS ix_a, b.ix AS ix_b, abs(a.o - b.o) AS gap, least(a.hi, b.hi) AS span FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.ix < b.ix AND abs(a.an - b.an) <= 2 AND abs(a.o - b.o) BETWEEN 2 AND 60)
        SELECT l_orderkey, ix_a, ix_b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY span DESC, gap, ix_a, ix_b) AS k FROM p) WHERE k = 1""",
}
