"""Which revision of a document is the current one (REV-02 to REV-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import name_mark, volume_key
from pagelens.operators.hierarchy import components
from pagelens.session import nonblank, small

KEYS = ["object_id", "doc_stage"]


def first_delivery(files: DataFrame) -> DataFrame:
    """One row per id: its earliest delivery."""
    cols = [c for c in files.columns if c != "id"]
    return files.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("uploaded_at", *[F.col(c) for c in cols if c != "uploaded_at"])).alias("r")).select("id", "r.*")


def identity_key(code: Column, discipline: Column) -> Column:
    """REV-04: code and discipline; null for a blank code."""
    return F.when(nonblank(code).isNotNull(), F.concat_ws("|", F.trim(code), F.coalesce(discipline, F.lit(""))))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """REV-02: the one most frequent value of each group; null and ambiguous where two are as frequent."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("most"), F.max_by(value, F.struct("n", value)).alias("winner"))
    ties = n.join(top, keys).where("n = most").groupBy(*keys).agg(F.count(F.lit(1)).alias("ties"))
    return top.join(ties, keys).select(*keys, F.when(F.col("ties") == 1, F.col("winner")).alias(value), (F.col("ties") > 1).alias("ambiguous"))


def reads_agree(*reads: Column) -> Column:
    """REV-03: whether all reads that are there are equal; null for fewer than two."""
    got = F.array_compact(F.array(*reads))
    return F.when(F.size(got) > 1, F.size(F.array_distinct(got)) == 1)


def blank_components(files: DataFrame) -> DataFrame:
    """REV-05: id, component of the files without a code, linked through predecessor and successor among themselves."""
    pool = first_delivery(files).where(nonblank(F.col("document_code")).isNull()).select("id", "predecessor_id", "successor_id")
    ids = pool.select(F.col("id").alias("parent"))
    links = pool.select(F.col("id").alias("node"), F.explode(F.array("predecessor_id", "successor_id")).alias("parent")).join(ids, "parent", "left_semi")
    found = components(links).withColumnRenamed("node", "id")
    return pool.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def filename_chains(files: DataFrame) -> DataFrame:
    """REV-06, WIN-06: revisions of one volume by the marks in the file names: id, volume, kind, number, previous_id, next_id, conflict.

    Files of the stages PD and RD with the same volume key form a chain in order of number.  A
    chain conflicts if marks are of mixed kinds, a number is missing, or a number stands for two contents.
    """
    f = first_delivery(files).where(F.col("doc_stage").isin("PD", "RD")).select("id", *KEYS, "file_hash", volume_key(F.col("file_path")).alias("volume"), name_mark(F.col("file_path"), F.col("revision")).alias("m")).where("volume <> ''").select("*", "m.kind", "m.number").drop("m")
    chain = Window.partitionBy(*KEYS, "volume")
    order = chain.orderBy(F.col("number").asc_nulls_first(), "id")
    same_number = Window.partitionBy(*KEYS, "volume", "number")
    kinds = F.size(F.collect_set(F.when(F.col("kind") != "none", F.col("kind"))).over(chain))
    f = f.withColumn("clash", (F.min("file_hash").over(same_number) != F.max("file_hash").over(same_number)) & F.col("number").isNotNull())
    conflict = (kinds > 1) | (F.col("kind") == "mixed") | F.max("clash").over(chain) | ((F.count(F.lit(1)).over(chain) > 1) & (F.count("number").over(chain) < F.count(F.lit(1)).over(chain)))
    return f.select("id", *KEYS, "volume", "kind", "number", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"), conflict.alias("conflict"))


def heads(files: DataFrame, policy: str = "sole_head", picks: DataFrame | None = None) -> DataFrame:
    """REV-04, REV-07 to REV-09: per object, stage and identity the current revision: status, head_id, n_heads, n_files.

    Files not approved and files without a code stay out.  A head has no successor in its pool and
    is named as predecessor by none of it.  No head is a cycle, several conflict.  A sole head of
    stage PD whose approval is unknown is taken under the policy sole_head if no other file of the
    pool is approved, else it must be clarified; RD and ID heads need no approval.  A file that an
    inspector picked (picks: id) is the head, whatever the links and approvals say; two picked ones conflict.
    """
    pool = first_delivery(files).where(F.coalesce(F.col("approval_status"), F.lit("UNKNOWN")) != "NOT_APPROVED")
    pool = pool.withColumn("identity", identity_key(F.col("document_code"), F.col("discipline"))).where(F.col("identity").isNotNull())
    keys = [*KEYS, "identity"]
    ids = pool.select(*keys, F.col("id").alias("other"))
    later = ids.withColumnRenamed("other", "successor_id").withColumn("has_later", F.lit(True))
    named = pool.where(F.col("predecessor_id").isNotNull() & (F.col("predecessor_id") != F.col("id"))).select(*keys, F.col("predecessor_id").alias("id")).distinct().withColumn("is_named", F.lit(True))
    pool = pool.join(later, [*keys, "successor_id"], "left").join(named, [*keys, "id"], "left")
    picked = pool.withColumn("picked", F.lit(False)) if picks is None else pool.join(picks.select("id").distinct().withColumn("picked", F.lit(True)), "id", "left")
    pool = picked.withColumn("picked", F.coalesce("picked", F.lit(False)))
    head = F.col("has_later").isNull() & F.col("is_named").isNull()
    g = pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(head).alias("n_heads"),
        F.min(F.when(head, F.col("id"))).alias("head_id"),
        F.max(F.when(head, F.col("approval_status"))).alias("head_approval"),
        F.count_if((F.col("approval_status") == "APPROVED") & ~head).alias("other_approved"),
        F.count_if("picked").alias("n_picked"),
        F.min(F.when(F.col("picked"), F.col("id"))).alias("picked_id"),
    )
    unknown = (F.col("doc_stage") == "PD") & (F.coalesce("head_approval", F.lit("UNKNOWN")) != "APPROVED")
    status = F.when(F.col("n_picked") == 1, "RESOLVED").when(F.col("n_picked") > 1, "CONFLICT").when(F.col("n_heads") == 0, "CYCLE").when(F.col("n_heads") > 1, "CONFLICT").when(unknown & ((F.col("other_approved") > 0) | F.lit(policy != "sole_head")), "CLARIFICATION_REQUIRED").otherwise("RESOLVED")
    return g.select(*keys, status.alias("status"), F.when(status == "RESOLVED", F.coalesce("picked_id", "head_id")).alias("head_id"), "n_heads", "n_files")


def stale(files: DataFrame) -> DataFrame:
    """REV-10: ids that another eligible file names as its predecessor."""
    f = first_delivery(files)
    by = f.where(F.coalesce("approval_status", F.lit("")) != "NOT_APPROVED").select(F.col("predecessor_id").alias("id"), F.col("id").alias("by")).where("id <> by")
    return f.select("id").join(by.select("id").distinct(), "id", "left_semi")


def approval_overlay(status: Column, decision: Column) -> Column:
    """REV-11: not approved stays so; a selection approves."""
    return F.when(status == "NOT_APPROVED", status).when(decision == "SELECT", "APPROVED").otherwise(F.coalesce(status, F.lit("UNKNOWN")))


def catalog(files: DataFrame) -> DataFrame:
    """REV-15: id, actuality: UNREADABLE without hash, CLARIFICATION_REQUIRED where the head is open, CURRENT for heads, else SUPERSEDED."""
    f = first_delivery(files).withColumn("identity", identity_key(F.col("document_code"), F.col("discipline")))
    h = heads(files).select(*KEYS, "identity", "status", "head_id")
    j = f.join(h, [*KEYS, "identity"], "left")
    actuality = F.when(nonblank(F.col("file_hash")).isNull(), "UNREADABLE").when(F.col("identity").isNull() | (F.coalesce("status", F.lit("")) != "RESOLVED"), "CLARIFICATION_REQUIRED").when(F.col("id") == F.col("head_id"), "CURRENT").otherwise("SUPERSEDED")
    return j.select("id", actuality.alias("actuality"))


def stage_volumes(heads_: DataFrame) -> DataFrame:
    """REV-12: per object and stage the resolved heads: none, page for one, volumes for several."""
    g = heads_.groupBy(*KEYS).agg(F.count("head_id").alias("n"), F.sort_array(F.collect_list("head_id")).alias("volumes"))
    return g.select(*KEYS, F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "page").otherwise("volumes").alias("binding"), "volumes")


def bind_rules(rules: DataFrame, heads_: DataFrame) -> DataFrame:
    """REV-13: per object, stage and rule: bound or conflict.

    rules: code, kinds; heads_: object_id, doc_stage, head_id, document_code, kinds.  One candidate is
    taken as it is; of several those that share a kind with the rule; more than one of them under one
    code conflict, under several codes all are taken; none conflict.
    """
    n = Window.partitionBy(*KEYS)
    h = heads_.withColumn("n_all", F.count(F.lit(1)).over(n))
    kinds = rules.select("code", F.explode("kinds").alias("kind"))
    by_kind = h.select(*KEYS, "head_id", "document_code", F.explode("kinds").alias("kind")).join(small(kinds), "kind").select("code", *KEYS, "head_id", "document_code").distinct()
    g = by_kind.groupBy("code", *KEYS).agg(F.countDistinct("head_id").alias("n_match"), F.countDistinct("document_code").alias("n_codes"))
    stages = h.groupBy(*KEYS).agg(F.max("n_all").alias("n_all"))
    codes = rules.agg(F.collect_set("code").alias("codes")).withColumn("_one", F.lit(1))  # one row: every stage gets every rule
    every = stages.withColumn("_one", F.lit(1)).join(codes, "_one").withColumn("code", F.explode("codes")).drop("_one", "codes")
    r = every.join(g, ["code", *KEYS], "left").fillna(0, ["n_match", "n_codes"])
    status = F.when((F.col("n_all") == 1) | (F.col("n_match") == 1), "BOUND").when((F.col("n_match") > 1) & (F.col("n_codes") > 1), "BOUND").otherwise("CONFLICT")
    return r.select("code", *KEYS, "n_all", "n_match", status.alias("status"))


def narrow(hits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """REV-14: the volume of each group that yields a value: hit for one, conflict for several, none."""
    g = hits.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("one"))
    return g.select(*keys, F.when(F.col("n") == 1, "hit").when(F.col("n") > 1, "conflict").otherwise("none").alias("status"), F.when(F.col("n") == 1, F.col("one")).alias(value))


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, page: str) -> DataFrame:
    """REV-16: ADDED, REMOVED, CHANGED, UNCHANGED, or AMBIGUOUS for several distinct values on a side; with the values of the first page."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.countDistinct(value).alias(f"n_{s}"), F.min_by(value, F.struct(page, value)).alias(f"{value}_{s}"), F.lit(True).alias(f"in_{s}"))

    j = side(old, "old").join(side(new, "new"), keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when((F.col("n_old") > 1) | (F.col("n_new") > 1), "AMBIGUOUS").when(F.col(f"{value}_old").eqNullSafe(F.col(f"{value}_new")), "UNCHANGED").otherwise("CHANGED")
    return j.select(*keys, change.alias("change"), f"{value}_old", f"{value}_new")


def latest_revision(asked: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """REV-18: the version of a norm with the latest effective_from, and whether it holds on the day asked for.

    asked: key, as_of; versions: key, version, effective_from, expires_at, signed.  The
    latest version is taken even if it takes effect after as_of.
    """
    last = versions.groupBy(key).agg(F.max_by(F.struct("version", "effective_from", "expires_at", "signed"), F.struct("effective_from", "version")).alias("v"))
    j = asked.join(last, key, "left")
    status = F.when(F.col("v").isNull(), "NOT_FOUND").when(~F.coalesce("v.signed", F.lit(False)), "UNSIGNED").when(F.col("as_of") > F.col("v.expires_at"), "EXPIRED").otherwise("VALID")
    return j.select(*asked.columns, F.col("v.version").alias("version"), status.alias("status"))


def in_force(asked: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """REV-19: ACCEPTED, NOT_YET_IN_FORCE, OUTDATED or UNKNOWN_VERSION of a named version on a day; open ends hold for ever."""
    j = asked.join(versions.select(key, version, "start", "end", F.lit(True).alias("_known")), [key, version], "left")
    status = F.when(F.col("_known").isNull(), "UNKNOWN_VERSION").when(F.col("on") < F.col("start"), "NOT_YET_IN_FORCE").when(F.col("on") > F.col("end"), "OUTDATED").otherwise("ACCEPTED")
    return j.select(*asked.columns, status.alias("status"))


def last_file(index: DataFrame, pos: str = "pos") -> DataFrame:
    """REV-20, REV-21: per object and stage the last usable file of an index; excluded rows, those without stage and missing files are counted by reason."""
    reason = F.when(F.col("excluded"), "excluded").when(F.col("stage").isNull(), "stage").when(~F.col("present"), "missing")
    x = index.withColumn("reason", reason)
    return x.groupBy("object_id", "stage").agg(F.max_by(F.when(F.col("reason").isNull(), F.col("file_id")), F.when(F.col("reason").isNull(), F.col(pos))).alias("file_id"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("excluded", "stage", "missing")))


def gold_slots(index: DataFrame, gold: DataFrame, pos: str = "pos") -> DataFrame:
    """REV-21: object_id, stage, file_id: of the files that the object's own gold evidence (object_id, file_id) names, the last per stage."""
    named = index.join(gold.select("object_id", "file_id").distinct(), ["object_id", "file_id"], "left_semi")
    return named.groupBy("object_id", "stage").agg(F.max_by("file_id", pos).alias("file_id"))


def prior_heads(files: DataFrame) -> DataFrame:
    """REV-17: per identity with a current revision the file before it, to be compared like a head: keys, head_id, prior_id."""
    h = heads(files).where("head_id is not null").select(*KEYS, "identity", "head_id")
    before = first_delivery(files).select(F.col("id").alias("head_id"), F.col("predecessor_id").alias("prior_id"))
    ids = files.select(F.col("id").alias("prior_id")).distinct()
    return h.join(before.where("prior_id is not null and prior_id <> head_id"), "head_id").join(ids, "prior_id", "left_semi").select(*KEYS, "identity", "head_id", "prior_id")
