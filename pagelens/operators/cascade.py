"""From comparisons to findings and protocols (CAS-01 to CAS-07, AGG-01, AGG-25 to AGG-37, FLT-16, FLT-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import small

# Stages of the cascade with the status of a failure (the first is no finding's, the last two have none); section of each status in a protocol; statuses that only a human gives.
STAGES = {"L1": "CLARIFICATION_REQUIRED", "L2": "LOW_QUALITY", "L3": "LOW_QUALITY", "L4": "CLARIFICATION_REQUIRED", "L5": "NOT_COMPARABLE", "L6": "CLARIFICATION_REQUIRED", "L7": "ABSTAIN"}
SECTIONS = {
    "CANDIDATE": "candidates", "CONFIRMED_VIOLATION": "confirmed", "NEGATIVE_VERIFIED": "negative_verified", "SUSPICION": "suspicions",
    "MISSING_EVIDENCE": "missing_evidence", "AUTO_NO_DIFFERENCE": "preliminary_no_difference", "LOW_QUALITY": "needs_attention", "ABSTAIN": "needs_attention",
    "CLARIFICATION_REQUIRED": "needs_attention", "NOT_COMPARABLE": "needs_attention", "NOT_APPLICABLE": "needs_attention",
}
WIRE = {"confirmed": "CONFIRMED_VIOLATION", "negative_verified": "NEGATIVE_VERIFIED"}
HUMAN_ONLY = ("CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED")
COVERAGES = ("executable", "extractor_missing", "source_missing", "not_applicable", "advisory")
#: Rules of the whole catalogue.
RULES = 132


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def first_halt(trace: DataFrame, keys: list[str]) -> DataFrame:
    """CAS-01: keys, stage, status, error of the first stage that failed.

    trace: keys, stage, ok, and where needed the stage's own status, which wins over the table.  An
    error takes the status's place where the intake failed, a stage after the findings failed
    without a status of its own, the status is a human's to give, or, nothing having failed, stages
    from the first to the seventh are missing; the status is null where all of these passed.
    """
    t = trace if "status" in trace.columns else trace.withColumn("status", F.lit(None).cast("string"))
    bad = F.when(~F.col("ok"), F.struct("stage", "status"))
    seen = F.array_sort(F.array_except(F.array(*map(F.lit, STAGES)), F.collect_set("stage")))
    g = t.groupBy(*keys).agg(F.min(bad).alias("bad"), seen.alias("missing"))
    status = F.coalesce("bad.status", F.try_element_at(_lookup(STAGES), F.col("bad.stage")))
    error = F.when(F.col("bad.stage") == "L0", "intake").when(F.col("bad").isNotNull() & status.isNull(), "no status").when(status.isin(*HUMAN_ONLY), "human only").when(F.col("bad").isNull() & (F.size("missing") > 0), F.concat(F.lit("missing "), F.array_join("missing", ",")))
    return g.select(*keys, F.col("bad.stage").alias("stage"), F.when(error.isNull(), status).alias("status"), error.alias("error"))


def halted(*halts: tuple[Column, str]) -> Column:
    """CAS-02: the status of the first condition, in order, that holds; null where none does."""
    out = F.lit(None).cast("string")
    for condition, status in reversed(halts):
        out = F.when(F.coalesce(condition, F.lit(False)), status).otherwise(out)
    return out


# What stops the evaluation of a rule, in the order in which it is looked at: the fact, its stage, the name under which a rule may rename the status, the status.
RULE_HALTS = [
    ("extractor_unsupported", "L6", None, "CLARIFICATION_REQUIRED"),
    ("operator_unsupported", "L6", None, "CLARIFICATION_REQUIRED"),
    ("stage_missing", "L2", "source_absent", "MISSING_EVIDENCE"),
    ("revision_unresolved", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("binding_conflict", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("identity_missing", "L1", None, "CLARIFICATION_REQUIRED"),
    ("head_conflict", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("head_absent", "L4", "source_absent", "MISSING_EVIDENCE"),
    ("not_the_head", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("not_approved", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("approval_open", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("volumes_conflict", "L4", "revision_conflict", "CLARIFICATION_REQUIRED"),
    ("no_volume_hit", "L2", "low_quality", "LOW_QUALITY"),
    ("source_absent", "L2", "source_absent", "MISSING_EVIDENCE"),
    ("no_value", "L2", "low_quality", "LOW_QUALITY"),
    ("stamp_overlap", "L2", "low_quality", "LOW_QUALITY"),
    ("reads_disagree", "L2", "reads_disagree", "ABSTAIN"),
    ("not_grounded", "L2", "low_quality", "LOW_QUALITY"),
    ("not_localised", "L3", "low_quality", "LOW_QUALITY"),
    ("one_file", "L5", "not_comparable", "NOT_COMPARABLE"),
    ("unpaired", "L5", "not_comparable", "NOT_COMPARABLE"),
]


def rule_halt(facts: dict[str, Column], mapping: Column | None = None) -> Column:
    """CAS-02, CAS-03: struct(halt, stage, status) of the first fact that stops a rule; null where none does and the values are compared.

    facts: conditions by the names in RULE_HALTS; those left out, and null ones, do not hold.  mapping:
    the rule's own names for statuses.  All halts are one expression over one wide row.
    """
    unknown = facts.keys() - {name for name, *_ in RULE_HALTS}
    if unknown:
        raise ValueError(f"no halts: {sorted(unknown)}")

    def stop(name: str, stage: str, reason: str | None, status: str) -> Column:
        own = F.lit(status) if mapping is None or reason is None else mapped(F.lit(status), F.lit(reason), mapping)
        return F.when(facts[name], F.struct(F.lit(name).alias("halt"), F.lit(stage).alias("stage"), own.alias("status")))

    stops = [stop(*h) for h in RULE_HALTS if h[0] in facts]
    return F.coalesce(*stops) if stops else F.lit(None).cast("struct<halt: string, stage: string, status: string>")


def mapped(status: Column, reason: Column, mapping: Column) -> Column:
    """CAS-03: the rule's own name for a reason, else the status."""
    return F.coalesce(F.try_element_at(mapping, reason), status)


def free_search(findings: DataFrame, known_rooms: DataFrame, keys: list[str]) -> DataFrame:
    """CAS-05: candidates and suspicions as suspicions; provision rows only where the rooms aren't settled."""
    kept = findings.where(F.col("status").isin("CANDIDATE", "SUSPICION")).withColumn("status", F.lit("SUSPICION"))
    provisions = kept.where(F.col("source") == "provision").join(known_rooms.select(*keys).distinct(), keys, "left_anti")
    return kept.where(F.coalesce("source", F.lit("")) != "provision").unionByName(provisions)


def suspicion(confidence: Column, reads_agree: Column, matched: Column, total: Column, repeated: Column) -> Column:
    """CAS-07: struct(kind, confidence) of the signal, or null."""
    return F.when(repeated, F.struct(F.lit("ANNOTATION_CONFLICT").alias("kind"), F.lit(0.70).alias("confidence"))).when((matched > 0) & (matched < total), F.struct(F.lit("PARTIAL_MATCH").alias("kind"), (matched / total).alias("confidence"))).when(~reads_agree, F.struct(F.lit("DUAL_READ").alias("kind"), F.lit(0.50).alias("confidence"))).when(confidence < 0.70, F.struct(F.lit("LOW_CONFIDENCE").alias("kind"), confidence.alias("confidence")))


def section(status: Column) -> Column:
    """The protocol's section of a status."""
    return F.try_element_at(_lookup(SECTIONS), status)


def coverage_report(rules: DataFrame, kinds: tuple[str, ...] = COVERAGES, expected: int = RULES) -> DataFrame:
    """AGG-01: rules by coverage, all kinds there, beside the number of rules there are and that of the whole catalogue."""
    every = rules.sparkSession.createDataFrame([(k,) for k in kinds], "coverage string")
    n = every.join(rules.groupBy("coverage").agg(F.count(F.lit(1)).alias("n")), "coverage", "left").withColumn("_one", F.lit(1))
    total = rules.agg(F.count(F.lit(1)).alias("declared")).withColumn("_one", F.lit(1))
    return n.join(total, "_one").select("coverage", F.coalesce("n", F.lit(0)).alias("n"), "declared", F.lit(expected).alias("expected"))


def dry_run(rules: DataFrame, supported: Column, applicable: Column | None = None) -> DataFrame:
    """CAS-06: all rules against no documents: counts by coverage and status; what isn't supported must be clarified, of the rest every stage is missing."""
    from pagelens.operators.intake import missing_stage

    status = halted((~supported, "CLARIFICATION_REQUIRED")) if applicable is None else halted((~supported, "CLARIFICATION_REQUIRED"), (~applicable, "NOT_APPLICABLE"))
    return rules.groupBy("coverage", F.coalesce(status, missing_stage(F.lit(True), F.lit(True))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _limbs(text: Column) -> list[Column]:
    """SHA-256 of a text as eight 32-bit numbers; their sums over a set don't depend on its order, so no set need be gathered in one place."""
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]


def _digest(n: str, sums: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", F.col(n).cast("string"), *(F.col(c).cast("string") for c in sums)), 256)


def protocol(findings: DataFrame, keys: list[str], id_: str, status: str) -> DataFrame:
    """AGG-28: per object and section the number of findings and a digest of their ids and statuses that doesn't depend on order."""
    sums = [f"_h{i}" for i in range(8)]
    text = F.concat_ws("|", F.col(id_), F.col(status))
    g = findings.groupBy(*keys, section(F.col(status)).alias("section")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(c) for h, c in zip(_limbs(text), sums)))
    return g.select(*keys, "section", "n", _digest("n", sums).alias("digest"))


def for_wire(findings: DataFrame, status: str, placed: str | None = None) -> DataFrame:
    """FLT-16: only what a human has decided; a row whose status is not that of the section in which it is placed is dropped."""
    return findings.where(F.try_element_at(_lookup(WIRE), section(F.col(status)) if placed is None else F.col(placed)) == F.col(status))


def for_reading(findings: DataFrame, status: str) -> DataFrame:
    """FLT-17."""
    return findings.where(F.coalesce(section(F.col(status)), F.lit("")) != "preliminary_no_difference")


def completeness(files: DataFrame, objects: DataFrame, stages: tuple[str, ...] = ("PD", "RD", "ID")) -> DataFrame:
    """Object × stage: UPLOADED, PARTIAL (nothing approved) or MISSING."""
    s = F.explode(F.array(*map(F.lit, stages)))
    every = objects.select(F.col("id").alias("object_id"), s.alias("doc_stage"))
    have = files.groupBy("object_id", "doc_stage").agg(F.countDistinct("id").alias("n"), F.bool_or(F.col("approval_status") == "APPROVED").alias("ok"))
    return every.join(have, ["object_id", "doc_stage"], "left").select("object_id", "doc_stage", F.when(F.col("n").isNull(), "MISSING").when(F.col("ok"), "UPLOADED").otherwise("PARTIAL").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def completeness_rows(complete: DataFrame, sections: DataFrame) -> DataFrame:
    """AGG-29: object_id, section, doc_stage, state, outcome, violation: each section that expects a document of a stage against the stage's state.

    sections: section, doc_stage, a catalogue of fixed size.  An uploaded stage is not yet a verified
    section, so no outcome says that it is there, and none is a violation.
    """
    outcome = F.when(F.col("state") == "MISSING", "MISSING").when(F.col("state") == "PARTIAL", "STAGE_PARTIAL_NOT_VERIFIED").otherwise("STAGE_UPLOADED_NOT_VERIFIED")
    return complete.join(small(sections.select("section", "doc_stage").distinct()), "doc_stage").select("object_id", "section", "doc_stage", "state", outcome.alias("outcome"), F.lit(False).alias("violation"))


def scenario(complete: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """AGG-30: object_id, scenario by the stages that an object has; FULL only for the objects in declared, whose expected composition is known.

    A stage that is there in part makes the whole PARTIALLY_LOADED, and so do all three stages
    without a declared composition; no stage at all is no scenario (null).
    """
    g = complete.groupBy("object_id").agg(F.bool_or(F.col("state") == "PARTIAL").alias("part"), *(F.bool_or((F.col("doc_stage") == s) & (F.col("state") != "MISSING")).alias(s) for s in ("PD", "RD", "ID")))
    g = g.withColumn("known", F.lit(False)) if declared is None else g.join(declared.select("object_id", F.lit(True).alias("known")).distinct(), "object_id", "left")
    all_ = F.col("PD") & F.col("RD") & F.col("ID")
    name = (
        F.when(F.col("part"), "PARTIALLY_LOADED").when(all_ & F.coalesce("known", F.lit(False)), "FULL").when(all_, "PARTIALLY_LOADED")
        .when(F.col("PD") & F.col("RD"), "PD_RD_ONLY").when(F.col("PD") & F.col("ID"), "PD_ID_ONLY").when(F.col("RD") & F.col("ID"), "RD_ID_ONLY")
        .when(F.col("PD") | F.col("RD") | F.col("ID"), "SINGLE_ONLY")
    )
    return g.select("object_id", name.alias("scenario"))


def manifest_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-32: per object a digest of its ids and hashes that doesn't depend on their order; `pending` without files, null with a bad hash."""
    ok = F.coalesce(F.col("file_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    sums = [f"_h{i}" for i in range(8)]
    g = files.groupBy(*keys).agg(F.bool_and(ok).alias("ok"), F.count("id").alias("n"), *(F.sum(h).alias(c) for h, c in zip(_limbs(F.concat_ws("|", "id", "file_hash")), sums)))
    return g.select(*keys, "n", F.when(F.col("n") == 0, "pending").when(F.col("ok"), _digest("n", sums)).alias("manifest"))


def storage_integrity(files: DataFrame, stored: DataFrame) -> DataFrame:
    """AGG-25: status of each file against the stored contents (file_id, sha256)."""
    j = files.select("id", "file_hash").join(stored.select(F.col("file_id").alias("id"), "sha256", F.lit(True).alias("there")), "id", "left")
    valid = F.coalesce(F.col("file_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    return j.select("id", F.when(F.coalesce(F.trim("file_hash"), F.lit("")) == "", "no_hash").when(~valid, "invalid_hash").when(F.col("there").isNull(), "missing").when(F.col("sha256") == F.col("file_hash"), "ok").otherwise("mismatch").alias("status"))


def timing_verdict(seconds: Column, limit: Column, claimed: Column, tolerance: float = 1.1) -> Column:
    """AGG-26."""
    return F.when(claimed, "CLAIMED").when(seconds.isNull(), "UNMEASURED").when(limit.isNull(), "NOT_QUOTABLE").when(seconds <= limit, "IN_LIMIT").when(seconds <= limit * tolerance, "IN_TOLERANCE").otherwise("OVER")


def latency_report(requests: DataFrame, ms: str, error: Column, keys: list[str]) -> DataFrame:
    """AGG-27: n, p50, p95, p99, error share and whether p95 is under 200 ms with less than 1 % errors."""
    g = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(ms, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)), (F.count_if(error) / F.count(F.lit(1))).alias("errors"))
    return g.withColumn("passes", (F.col("n") > 0) & F.coalesce(F.col("p95") < 200, F.lit(False)) & (F.col("errors") < 0.01))


def capability(layers: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-34: by the layers with a verdict alone: unavailable if any of them is, degraded if any is degraded or only measured."""
    of = lambda *states: F.coalesce(F.bool_or(F.col("verdict") & F.col("state").isin(*states)), F.lit(False))
    return layers.groupBy(*keys).agg(F.when(of("UNAVAILABLE"), "UNAVAILABLE").when(of("DEGRADED", "MEASURED"), "DEGRADED").otherwise("AVAILABLE").alias("state"))


def confidence_band(confidence: Column) -> Column:
    """AGG-36."""
    return F.when(confidence >= 0.90, "high").when(confidence >= 0.70, "medium").when(confidence.isNotNull(), "low")


def places(evidence: Column) -> Column:
    """AGG-37: (stage, file, page) of the fragments; null for no group, an empty list for an empty one."""
    return F.transform(evidence, lambda e: F.concat_ws(":", e["stage"], F.coalesce(e["file_id"], F.lit("-")), F.coalesce(e["pdf_page_number"].cast("string"), F.lit("-"))))


def with_side_findings(findings: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """CAS-04: findings and the extra ones of their rules, each with an id `pipe-CODE` or `pipe-CODE-n`.

    findings: keys, code, status; extra: keys, code, pos, status.  Extra ones of a rule are numbered by pos from 1.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys, "code").orderBy("pos"))
    main = findings.select(*keys, "code", "status", F.concat(F.lit("pipe-"), "code").alias("finding_id"))
    return main.unionByName(extra.select(*keys, "code", "status", F.concat_ws("-", F.lit("pipe"), "code", n.cast("string")).alias("finding_id")))


def index_summary(index: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-02: rows, excluded and usable rows of a files index."""
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("excluded"), F.count_if(F.col("reason").isNull()).alias("usable"))


def parse_report(documents: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-31: documents, errors, flagged ones and seconds of a run."""
    return documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("injection").isNotNull()).alias("flagged"), F.sum("seconds").alias("seconds"))


def families(rules: DataFrame, coverages: tuple[str, ...] = COVERAGES) -> DataFrame:
    """AGG-33: rules of each extractor family by coverage, zero-filled, in one row."""
    return rules.groupBy("family").agg(*(F.count_if(F.col("coverage") == c).alias(c) for c in coverages))


def gold_hits(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """AGG-35: each gold check and whether its object has a candidate of its code."""
    c = candidates.where(F.col("status") == "CANDIDATE").select("object_id", "parameter_code", F.lit(True).alias("_hit")).distinct()
    return gold.join(c, ["object_id", "parameter_code"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
