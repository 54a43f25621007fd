"""Event processing in batch form (STR-01 to STR-10, AGG-23, AGG-24, WIN-02 to WIN-09, LIM-02 to LIM-04)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Waits after each attempt, attempts, lease; waits of the parser; milliseconds within which a card opened from the queue is no action.
RETRY_S, ATTEMPTS, LEASE_S, PARSE_RETRY_S, OPEN_MS = (60, 300, 900), 4, 30, (30, 120), 5000
# Legal steps of a process, a finding and a delivery; those that only a human may take.
PROCESS_STEPS = {("PENDING", "PARSING"), ("PARSING", "READY"), ("PARSING", "PENDING"), ("READY", "PARSING"), ("VERIFYING", "PARSING"), ("COMPLETED", "PARSING")}
PROCESS_BY_HUMAN = {("READY", "VERIFYING"), ("VERIFYING", "COMPLETED"), ("COMPLETED", "FINALIZED"), ("FINALIZED", "COMPLETED")}
FINDING_STEPS = {("CANDIDATE", "CLARIFICATION_REQUIRED"), ("CLARIFICATION_REQUIRED", "CANDIDATE"), ("SUSPICION", "CANDIDATE")}
FINDING_BY_HUMAN = {
    ("CANDIDATE", "CONFIRMED_VIOLATION"), ("CANDIDATE", "NEGATIVE_VERIFIED"), ("CLARIFICATION_REQUIRED", "CONFIRMED_VIOLATION"), ("CLARIFICATION_REQUIRED", "NEGATIVE_VERIFIED"),
    ("SUSPICION", "CONFIRMED_VIOLATION"), ("SUSPICION", "NEGATIVE_VERIFIED"), ("AUTO_NO_DIFFERENCE", "NEGATIVE_VERIFIED"), ("NOT_APPLICABLE", "CANDIDATE"),
}
SYNC_STEPS = {
    ("NOT_REQUESTED", "PENDING_SYNC"), ("PENDING_SYNC", "SYNCING"), ("SYNCING", "SYNCED"), ("SYNCING", "RETRY_WAIT"), ("SYNCING", "FAILED_TERMINAL"),
    ("SYNCING", "PENDING_SYNC"), ("RETRY_WAIT", "SYNCING"), ("RETRY_WAIT", "FAILED_TERMINAL"), ("FAILED_TERMINAL", "PENDING_SYNC"),
}
# Clicks and seconds allowed, sessions of a trial, cards of a log, events that are actions.
MAX_CLICKS, MAX_SECONDS, SESSIONS, CARDS = 3, 1800, 5, 14
ACTIONS = ("CLICK", "HOTKEY", "CARD_OPEN", "DECISION_SUBMIT")


def retry_delay(attempts: Column, waits: tuple[int, ...] = RETRY_S, most: int = ATTEMPTS) -> Column:
    """STR-01, STR-08: seconds to the next attempt; null once no attempt is left."""
    return F.when(attempts < most, F.try_element_at(F.array(*map(F.lit, waits)), F.greatest(F.lit(1), F.least(attempts, F.lit(len(waits))).cast("int"))))


def publish_outcome(sent: Column, expected: Column, error: Column, refused: Column) -> Column:
    """STR-02: what becomes of a claimed message."""
    return F.when(~sent.eqNullSafe(expected), "FAILED_TERMINAL").when(error, "PENDING").when(refused, "FAILED_TERMINAL").otherwise("DELIVERED")


def classify_inbox(ok: Column, redelivery: Column, event_id: Column, sha: Column) -> Column:
    """STR-03: struct(action, row_status, sha256)."""
    again = ~ok & (redelivery < ATTEMPTS)
    action = F.when(ok, "ack").when(again, "requeue").otherwise("dead_letter")
    row = F.when(ok, "RECEIVED").when(~again & event_id.isNotNull(), "POISON")
    return F.struct(action.alias("action"), row.alias("row_status"), F.when(F.coalesce(sha.rlike("^[0-9a-f]{64}$"), F.lit(False)), sha).otherwise("0" * 64).alias("sha256"))


def delivery_attempt(header: Column) -> Column:
    """STR-05: 1 without a readable count, else one more than it."""
    n = header.try_cast("int")
    return F.when(n.isNull(), 1).otherwise(F.greatest(n, F.lit(0)) + 1)


def sync_state(outbox: Column) -> Column:
    """STR-06: the broker's acceptance is not yet the receiver's."""
    return F.when(outbox == "DELIVERED", "SYNCING").when(outbox == "PENDING", "RETRY_WAIT").when(outbox == "FAILED_TERMINAL", "PENDING_SYNC")


def insert_once(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """STR-04: rows of `new`, the first of each key, whose key is not there yet."""
    cols = [c for c in new.columns if c != key]
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("r")).select(key, "r.*")
    return first.join(existing.select(key).distinct(), key, "left_anti")


def illegal_steps(log: DataFrame, keys: list[str], status: str, order: list[str], legal: set[tuple[str, str]], by_human: set[tuple[str, str]] = frozenset(), human: str | None = None) -> DataFrame:
    """STR-07: consecutive different statuses of one entity that are no legal step; those in by_human are legal where the column human is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = log.withColumn("before", F.lag(status).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
    rows = sorted({(a, b, False) for a, b in legal} | {(a, b, True) for a, b in by_human})
    steps = F.broadcast(log.sparkSession.createDataFrame(rows, f"before string, {status} string, _needs boolean"))
    allowed = x.join(steps, ["before", status], "left").where(F.col("_needs").isNull() | (F.col("_needs") & ~(F.coalesce(F.col(human), F.lit(False)) if human else F.lit(False))))
    return allowed.select(*keys, *order, "before", status)


def rate_limit(hits: DataFrame, key: str, ts: str, most: int, window_ms: int) -> DataFrame:
    """STR-09: key, ts, allowed: at most `most` allowed hits in any window of one key; refused hits don't count.

    Since refusals feed back, hits are walked in order of time.  A key's hits are sorted within one
    partition and streamed through it; only the allowed times of the current window are held.
    """
    x = hits.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("bigint").alias("ts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["ts"]):
                if k != now:
                    now, held = k, []
                while held and held[0] <= t - window_ms:
                    held.pop(0)
                ok = len(held) < most
                if ok:
                    held.append(t)
                out.append(ok)
            yield b.assign(allowed=out)

    return x.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, f"key {dict(x.dtypes)['key']}, ts bigint, allowed boolean").withColumnsRenamed({"key": key, "ts": ts})


def newest(jobs: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """STR-10: of queued jobs the newest generation per key; ties by the other columns."""
    rest = [c for c in jobs.columns if c not in keys]
    return jobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(generation, *[c for c in rest if c != generation])).alias("r")).select(*keys, "r.*")


def once(events: DataFrame) -> DataFrame:
    """Events delivered again count once: the first delivery, whole."""
    cols = ["event", "user_id", "object_id", "check_id", "screen", "target", "click_index", "duration_ms", "ts"]
    return events.where("event_id is not null").groupBy("event_id").agg(F.min_by(F.struct(*cols), F.struct("received_at", *cols)).alias("r")).select("event_id", "r.*")


def usability(events: DataFrame, sessions: list[str]) -> DataFrame:
    """AGG-23: per session its greatest click count and seconds, and whether each stays within what is allowed."""
    g = events.groupBy(*sessions).agg(F.max(F.coalesce("click_index", F.lit(0))).alias("max_clicks"), (F.sum(F.coalesce("duration_ms", F.lit(0))) / 1000).alias("seconds"))
    return g.select(*sessions, "max_clicks", "seconds", (F.col("seconds") <= MAX_SECONDS).alias("within_time"), (F.col("max_clicks") <= MAX_CLICKS).alias("within_clicks"))


def usability_verdict(sessions: DataFrame, user: str) -> DataFrame:
    """AGG-23: one row: sessions, users, and whether there are exactly five sessions of five users that all stay within both limits."""
    g = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct(user).alias("users"), F.coalesce(F.bool_and(F.col("within_time") & F.col("within_clicks")), F.lit(False)).alias("ok"))
    return g.select("sessions", "users", (F.col("ok") & (F.col("sessions") == SESSIONS) & (F.col("users") == SESSIONS)).alias("passes"))


def card_actions(events: DataFrame) -> DataFrame:
    """AGG-24, WIN-09: user_id, check_id, n_actions of the cards that a user decided.

    An action is a click, key, opening or decision that carries a click's number or aims at a
    decision on the card; an opening within OPEN_MS of a click in the queue on the same card is none
    of its own.
    """
    e = events.where("user_id is not null and trim(user_id) <> '' and check_id is not null and check_id <> '' and ts is not null")
    w = Window.partitionBy("user_id", "check_id").orderBy("ts", "event_id")
    action = F.col("event").isin(*ACTIONS) & (F.col("click_index").isNotNull() | ((F.col("screen") == "card") & F.col("target").startswith("decision-")))
    mounted = (F.col("event") == "CARD_OPEN") & (F.lag("event").over(w) == "CLICK") & (F.lag("screen").over(w) == "queue") & (F.col("ts") - F.lag("ts").over(w) <= OPEN_MS)
    e = e.withColumn("counts", F.coalesce(action, F.lit(False)) & ~F.coalesce(mounted, F.lit(False)))
    g = e.groupBy("user_id", "check_id").agg(F.count_if("counts").alias("n_actions"), F.bool_or(F.col("event") == "DECISION_SUBMIT").alias("decided"))
    return g.where("decided").drop("decided")


def participants(events: DataFrame) -> DataFrame:
    """AGG-24: user_id, cards_decided, max_clicks, seconds from the user's first event to the last, for users with any card."""
    known = events.where("user_id is not null and trim(user_id) <> '' and ts is not null")
    span = known.groupBy("user_id").agg(((F.max("ts") - F.min("ts")) / 1000).alias("seconds"), F.count_if(F.col("check_id") != "").alias("n")).where("n > 0").drop("n")
    decided = card_actions(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("cards_decided"), F.max("n_actions").alias("max_clicks"))
    return span.join(decided, "user_id", "left").select("user_id", F.coalesce("cards_decided", F.lit(0)).alias("cards_decided"), "max_clicks", "seconds")


def log_verdict(events: DataFrame) -> DataFrame:
    """AGG-24: one row: cards of the log, whether it measures anything (14 cards or more, some decided), the worst clicks and seconds, and whether both stay within what is allowed."""
    cards = events.where("ts is not null and check_id <> ''").agg(F.countDistinct("check_id").alias("cards")).withColumn("_one", F.lit(1))
    worst = participants(events).agg(F.count(F.lit(1)).alias("users"), F.max("max_clicks").alias("max_clicks"), F.max("seconds").alias("max_seconds")).withColumn("_one", F.lit(1))
    measured = (F.col("cards") >= CARDS) & F.col("max_clicks").isNotNull()
    within = measured & F.coalesce((F.col("max_clicks") <= MAX_CLICKS) & (F.col("max_seconds") <= MAX_SECONDS), F.lit(False))
    return cards.join(worst, "_one").select("users", "cards", measured.alias("measured"), "max_clicks", "max_seconds", within.alias("passes"))


def strongest(signals: DataFrame, keys: list[str], confidence: str, pos: str) -> DataFrame:
    """WIN-02: the surest signal of each key, the earlier of equals."""
    rest = [c for c in signals.columns if c not in keys]
    return signals.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(pos))).alias("r")).select(*keys, "r.*")


def upsert_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """WIN-03: new findings over old by finding_id; a human verdict on an unchanged candidate stays.

    Columns: finding_id, rule_code, expected, actual, status, decision.
    """
    o = old.select("finding_id", *(F.col(c).alias(f"o_{c}") for c in ("rule_code", "expected", "actual", "status", "decision")), F.lit(True).alias("was"))
    j = o.join(new.withColumn("is", F.lit(True)), "finding_id", "full_outer")
    carry = F.col("was") & F.col("is") & (F.col("status") == "CANDIDATE") & F.col("o_status").isin("CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED") & F.col("o_rule_code").eqNullSafe(F.col("rule_code")) & F.col("o_expected").eqNullSafe(F.col("expected")) & F.col("o_actual").eqNullSafe(F.col("actual"))
    keep = F.col("is").isNull() | F.coalesce(carry, F.lit(False))
    return j.select("finding_id", *(F.when(F.col("is").isNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("rule_code", "expected", "actual")), *(F.when(keep, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "decision")))


def next_version(protocols: DataFrame, objects: DataFrame) -> DataFrame:
    """WIN-05."""
    return objects.select("object_id").distinct().join(protocols.groupBy("object_id").agg(F.max("version").alias("v")), "object_id", "left").select("object_id", (F.coalesce("v", F.lit(0)) + 1).alias("version"))


def claimable(outbox: DataFrame, now: Column) -> DataFrame:
    """LIM-02: the one oldest message that may be sent."""
    return outbox.where((F.col("status") == "PENDING") & (F.col("attempts") < ATTEMPTS) & (F.col("available_at") <= now)).orderBy("created_at", "id").limit(1)


def mass_confirm(picked: DataFrame, most: int = 50) -> DataFrame:
    """LIM-04: one row: whether all picked findings may be confirmed at once, and why not."""
    g = picked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("finding_id").alias("ids"), F.count_if(F.col("status") != "CANDIDATE").alias("other"), F.count_if(~F.col("human")).alias("machine"))
    why = F.array_compact(F.array(F.when(F.col("n") == 0, "empty"), F.when(F.col("n") > most, "too_many"), F.when(F.col("ids") < F.col("n"), "repeated"), F.when(F.col("other") > 0, "not_candidate"), F.when(F.col("machine") > 0, "not_human")))
    return g.select("n", why.alias("blocking"), (F.size(why) == 0).alias("allowed"))


def missing_sample(named: DataFrame, index: DataFrame, keys: list[str], id_: str, most: int = 8) -> DataFrame:
    """LIM-03: keys, n, sample: how many distinct ids are named and missing in the index, and the first `most` of them in order.

    Only the first ids of a group are ever brought together: they are ranked before they are gathered.
    """
    lost = named.where(F.col(id_).isNotNull()).select(*keys, id_).distinct().join(index.select(id_).distinct(), id_, "left_anti")
    n = lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = lost.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(id_))).where(F.col("_r") <= most)
    return n.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list(id_)).alias("sample")), keys)


def locate(findings: DataFrame, wanted: DataFrame, legal: set[tuple[str, str]] = FINDING_STEPS | FINDING_BY_HUMAN) -> DataFrame:
    """WIN-04: for (finding_id, target) the last process where the step to target is legal, else the last that has the finding.

    findings: finding_id, process_id, pos, status.
    """
    steps = F.broadcast(findings.sparkSession.createDataFrame(sorted(legal), "status string, target string").withColumn("legal", F.lit(True)))
    j = wanted.join(findings, "finding_id").join(steps, ["status", "target"], "left")
    return j.groupBy("finding_id", "target").agg(F.max_by("process_id", F.struct(F.coalesce("legal", F.lit(False)), "pos")).alias("process_id"))
