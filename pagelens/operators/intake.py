"""Acceptance of uploads and hygiene of tables (FLT-01 to FLT-24, SET-01 to SET-05, WIN-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits in bytes and ratios, HTTP codes of the refusals, first bytes of the formats.
FILE_BYTES, BATCH_BYTES, UNPACKED_BYTES, RATIO = 50 << 20, 200 << 20, 100 << 20, 100
CODES = {
    "UNSUPPORTED_FORMAT": 415, "CORRUPTED_FILE": 422, "FILE_TOO_LARGE": 413, "BATCH_LIMIT_EXCEEDED": 413, "ANTIVIRUS_REJECTED": 422,
    "ENCRYPTED_FILE": 422, "PROCESSING_TIMEOUT": 504, "UNSAFE_FILENAME": 422,
}
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "xml": "3C|EFBBBF3C", "zip": "504B0304|504B0506|504B0708", "7z": "377ABCAF271C", "rar": "526172211A0700|526172211A070100"}
#: Words of a token window that is scanned at once.
WINDOW = 5
# Texts that try to give orders to a reading machine; the reference's 24 patterns of three types, in its order.
INJECTIONS = {
    "override": (
        r"\bignore\s+(all\s+)?(previous\s+)?rules?\b",
        r"\bignore\s+(all\s+)?instructions?\b",
        r"\bforget\s+(all\s+)?(previous\s+)?(rules?|instructions?)\b",
        r"\bdisregard\s+(all\s+)?rules?\b",
        r"\boverride\s+(all\s+)?rules?\b",
        r"\bnew\s+instructions?:\b",
        r"\bstop\s+following\b",
        r"игнорир[уй]+\s+все\s+правил",
        r"игнорир[уй]+\s+правил",
        r"забудь\s+(все\s+)?правил",
        r"отмен[иь]\s+(все\s+)?правил",
        r"новые\s+инструкции:",
    ),
    "role": (
        r"\byou\s+are\s+(now\s+)?a\b",
        r"\bpretend\s+(to\s+be|you\s+are)\b",
        r"\bact\s+as\s+(a|an)\b",
        r"\bfrom\s+now\s+on\s+you\s+are\b",
        r"ты\s+теперь\b",
        r"притворись\b",
        r"сделайся\s+(как\s+)?\b",
    ),
    "leak": (
        r"\bprint\s+system\s+prompt\b",
        r"\bshow\s+(me\s+)?your\s+(system\s+)?instructions\b",
        r"\brepeat\s+(everything\s+)?above\b",
        r"\bwhat\s+are\s+your\s+instructions\b",
        r"\becho\s+(back\s+)?your\s+prompt\b",
    ),
}
#: One more phrase, which the reference lets pass; looked for only where none of its patterns is found.
MORE_INJECTIONS = {"override": (r"\bignore\s+all\s+previous\s+instructions?\b",)}


def filename_is_safe(name: Column) -> Column:
    """FLT-01."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"^\s|\s$|[\x00-\x1f\x7f/\\]|^\.\.") & (F.octet_length(name) <= 255), F.lit(False))


def looks_like_bomb(unpacked: Column, packed: Column) -> Column:
    """FLT-03."""
    return F.coalesce((unpacked > UNPACKED_BYTES) | (F.try_divide(unpacked, packed) > RATIO), F.lit(False))


def check_file(name: Column, size: Column, header_hex: Column, unpacked: Column) -> Column:
    """FLT-02: the first refusal in order, or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    magic = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])
    return (
        F.when(~filename_is_safe(name), "UNSAFE_FILENAME")
        .when(~ext.isin(*MAGIC), "UNSUPPORTED_FORMAT")
        .when(F.coalesce(size, F.lit(0)) == 0, "CORRUPTED_FILE")
        .when(size > FILE_BYTES, "FILE_TOO_LARGE")
        .when(header_hex.isNotNull() & ~F.exists(F.split(F.try_element_at(magic, ext), r"\|"), lambda m: F.startswith(F.upper(header_hex), m)), "CORRUPTED_FILE")
        .when(looks_like_bomb(unpacked, size), "CORRUPTED_FILE")
    )


def batch_decision(files: DataFrame, batch: str, pos: str, name: str, size: str, content: str, header: Column | None = None, unpacked: Column | None = None) -> DataFrame:
    """FLT-04: batch, pos, decision, reason: accepted, rejected or duplicate.

    A batch of more than BATCH_BYTES over all its files is refused whole.  Of files with one content
    the first that passes is accepted, later ones are duplicates; refused ones don't register
    their content.  Sums and first positions are aggregated before they are joined back, so that
    a batch with a large share of the rows is no single window.
    """
    none = F.lit(None).cast("string")
    f = files.select(F.col(batch).alias("batch"), F.col(pos).alias("pos"), F.col(content).alias("content"), F.col(size).alias("size"), check_file(F.col(name), F.col(size), none if header is None else header, F.lit(None).cast("bigint") if unpacked is None else unpacked).alias("reason"))
    total = f.groupBy("batch").agg(F.sum("size").alias("total"))
    first = f.where("reason is null").groupBy("batch", "content").agg(F.min("pos").alias("first"))
    j = f.join(total, "batch").join(first, ["batch", "content"], "left")
    reason = F.when(F.col("total") > BATCH_BYTES, "BATCH_LIMIT_EXCEEDED").otherwise(F.col("reason"))
    decision = F.when(reason.isNotNull(), "rejected").when(F.col("content").isNotNull() & (F.col("pos") > F.col("first")), "duplicate").otherwise("accepted")
    return j.select("batch", "pos", decision.alias("decision"), reason.alias("reason"))


def batch_http(decisions: DataFrame) -> DataFrame:
    """FLT-05: 202 where nothing was refused, else the greatest code."""
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return decisions.groupBy("batch").agg(F.coalesce(F.max(F.try_element_at(codes, F.col("reason"))), F.lit(202)).alias("http_status"))


def is_quarantined(path: Column, folder: str = "quarantine", markers: tuple[str, ...] = ("hidden", "holdout")) -> Column:
    """FLT-06."""
    p = F.lower(F.translate(path, "\\", "/"))
    return F.array_contains(F.split(p, "/"), folder) | p.rlike("|".join(markers))


def usable(entries: DataFrame, allowed: DataFrame, hidden: DataFrame, path: str) -> DataFrame:
    """FLT-07, FLT-08: rows of allowed objects that are neither hidden nor quarantined by access or path."""
    return entries.join(allowed.select("object_id").distinct(), "object_id", "left_semi").join(hidden.select("object_id").distinct(), "object_id", "left_anti").where((F.coalesce("access", F.lit("")) != "QUARANTINED") & ~is_quarantined(F.col(path)))


def scan_injection(text: Column) -> Column:
    """FLT-10, WIN-10: struct(kind, pattern, window) of the first window of five words that matches, patterns in order; null if none does.

    Words are parted by blanks of any kind, letters compared in any case.  A match in a window is
    one in the whole text too, so texts without any are not cut into windows.
    """
    said = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    words = F.split(said, " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))

    def first(kinds: dict[str, tuple[str, ...]]) -> Column:
        any_ = "(?iuU)" + "|".join(p for ps in kinds.values() for p in ps)
        hit = F.try_element_at(F.filter(windows, lambda w: w.rlike(any_)), F.lit(1))
        found = F.coalesce(*[F.when(hit.rlike("(?iuU)" + p), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), hit.alias("window"))) for k, ps in kinds.items() for p in ps])
        return F.when(said.rlike(any_), found)

    return F.coalesce(first(INJECTIONS), first(MORE_INJECTIONS))


def fragment_faults(sha256: Column, page: Column, polygon: Column) -> Column:
    """FLT-11: names of the broken invariants of a fragment."""
    inside = F.forall(polygon, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))
    return F.array_compact(F.array(F.when(~F.coalesce(sha256.rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash"), F.when(~F.coalesce(page >= 1, F.lit(False)), "page"), F.when(~F.coalesce(F.size(polygon) >= 3, F.lit(False)), "polygon"), F.when(~F.coalesce(inside, F.lit(True)), "range")))


# Statuses that demand evidence, and the action that a human's verdict comes from.
EVIDENCE_REQUIRED = ("CANDIDATE", "CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED", "AUTO_NO_DIFFERENCE", "SUSPICION")
ACTIONS = {"CONFIRMED_VIOLATION": "CONFIRM", "NEGATIVE_VERIFIED": "REJECT"}


def finding_faults(status: Column, evidence: Column, action: Column, comment: Column, reason: Column) -> Column:
    """FLT-12: names of the broken invariants of a finding; evidence is whether it has an evidence group."""
    asked = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), status)
    return F.array_compact(
        F.array(
            F.when(status.isin(*EVIDENCE_REQUIRED) & ~F.coalesce(evidence, F.lit(False)), "evidence"),
            F.when(asked.isNotNull() & ~action.eqNullSafe(asked), "decision"),
            F.when(asked.isNotNull() & (F.length(F.trim(F.coalesce(comment, F.lit("")))) == 0), "comment"),
            F.when((status == "NEGATIVE_VERIFIED") & reason.isNull(), "reason"),
        )
    )


def missing_stage(applicable: Column, required: Column) -> Column:
    """FLT-14."""
    return F.when(~applicable, "NOT_APPLICABLE").when(required, "MISSING_EVIDENCE")


def downgrade(status: Column, coverage: Column, mapped: Column) -> Column:
    """FLT-15: a candidate under a rule that is not executable."""
    return F.when((status == "CANDIDATE") & coverage.isin("advisory", "source_missing", "not_applicable"), F.coalesce(mapped, F.lit("LOW_QUALITY"))).otherwise(status)


def registry_faults(versions: DataFrame, refs: DataFrame) -> DataFrame:
    """FLT-18: fault, key: repeated ids, ends before starts, and references to norms that the registry lacks."""
    twice = versions.groupBy("norm_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("fault"), F.col("norm_id").alias("key"))
    dates = versions.where(F.col("end") < F.col("start")).select(F.lit("dates").alias("fault"), F.col("norm_id").alias("key")).distinct()
    lost = refs.select("norm_id").distinct().join(versions.select("norm_id").distinct(), "norm_id", "left_anti").select(F.lit("unknown").alias("fault"), F.col("norm_id").alias("key"))
    return twice.unionByName(dates).unionByName(lost)


def allowed_roles(has: Column, allowed: Column) -> Column:
    """FLT-21: no common role is a refusal."""
    return F.coalesce(F.size(F.array_intersect(has, allowed)) > 0, F.lit(False))


def keep_word(confidence: Column, box: Column) -> Column:
    """FLT-22: recognised words of some certainty, with an area, inside the page."""
    return (confidence >= 40) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]) & (box["x0"] >= 0) & (box["y0"] >= 0) & (box["x1"] <= 1) & (box["y1"] <= 1)


def suppress_hidden(tokens: DataFrame, hidden: DataFrame, keys: list[str], k: float = 4.0) -> DataFrame:
    """FLT-23: tokens (x0, y0, x1, y1) whose centre lies in no invisible object of at most k times their area."""
    h = hidden.select(*keys, *(F.col(c).alias(f"h_{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    on = [tokens[c] == h[c] for c in keys] + [cx.between(F.col("h_x0"), F.col("h_x1")), cy.between(F.col("h_y0"), F.col("h_y1")), area("h_") <= k * area("")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return tokens.join(h, cond, "left_anti")


def first_per_hash(files: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """WIN-01: one file per content within the keys; aggregated, not windowed, so that a hot key is combined map-side."""
    cols = [c for c in files.columns if c not in (*keys, content)]
    g = files.where(F.col(content).isNotNull()).groupBy(*keys, content).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, content, "r.*", "n")


def wire_codes(matrix: DataFrame, free: DataFrame) -> DataFrame:
    """SET-01: codes of the matrix, then those of the free search that it lacks, in order."""
    both = matrix.select("code", F.lit(0).alias("src"), "pos").unionByName(free.select("code", F.lit(1).alias("src"), "pos"))
    return both.groupBy("code").agg(F.min(F.struct("src", "pos")).alias("k")).select("code", F.row_number().over(Window.orderBy("k.src", "k.pos", "code")).alias("pos"))


def stale_outputs(written: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """SET-04: keys that were written and are wanted no more."""
    return written.where(F.col(key).isNotNull()).select(key).distinct().join(wanted.select(key).distinct(), key, "left_anti")


def split_leakage(items: DataFrame, key: str = "object_id", split: str = "split") -> DataFrame:
    """SET-05: keys that stand in more than one split."""
    return items.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def submission_faults(checks: DataFrame) -> DataFrame:
    """FLT-09: object_id, check_id, faults of submitted checks that break the format; an object with any gets no score."""
    labels = F.col("violation_label").isin("VIOLATION_PRESENT", "NO_VIOLATION", "COMPARISON_IMPOSSIBLE")
    stages = F.forall(F.coalesce("evidence", F.array()), lambda e: F.coalesce(e["stage"].isin("PD", "RD", "ID"), F.lit(False)))
    pages = F.forall(F.coalesce("evidence", F.array()), lambda e: e["pdf_page_number"].isNull() | (e["pdf_page_number"] >= 1))
    faults = F.array_compact(F.array(F.when(F.col("object_id").isNull(), "object_id"), F.when(F.col("parameter_code").isNull(), "parameter_code"), F.when(~F.coalesce(labels, F.lit(False)), "violation_label"), F.when(~stages, "stage"), F.when(~pages, "page")))
    return checks.select("object_id", "check_id", faults.alias("faults")).where(F.size("faults") > 0)


def upload_guard(stage: Column, object_id: Column, process_object: Column, supersedes: Column, superseded_stage: Column, superseded_successor: Column, n_files: Column) -> Column:
    """FLT-13: the first refusal of an upload, or null; what supersedes a file is one file of its stage, and the only successor."""
    return (
        F.when(~F.coalesce(stage.isin("PD", "RD", "ID"), F.lit(False)), "STAGE_REQUIRED")
        .when(~object_id.eqNullSafe(process_object), "OBJECT_MISMATCH")
        .when(supersedes.isNotNull() & (n_files != 1), "SUPERSEDES_ONE_FILE")
        .when(supersedes.isNotNull() & ~stage.eqNullSafe(superseded_stage), "SUPERSEDES_OTHER_STAGE")
        .when(supersedes.isNotNull() & superseded_successor.isNotNull(), "ALREADY_SUPERSEDED")
    )


def traceability_gaps(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """FLT-19: gap, n: rules without norms (column norms), findings without code or evidence."""
    a = rules.agg(F.count_if(F.coalesce(F.size("norms"), F.lit(0)) <= 0).alias("n")).select(F.lit("rule_without_norm").alias("gap"), "n")
    b = findings.agg(F.count_if(F.col("parameter_code").isNull()).alias("c"), F.count_if(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("e"))
    return a.unionByName(b.select(F.lit("finding_without_code").alias("gap"), F.col("c").alias("n"))).unionByName(b.select(F.lit("finding_without_evidence").alias("gap"), F.col("e").alias("n")))


def split_dropped(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """FLT-24: (rows that stand, rows dropped with their error); an error never stops the rest."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())
