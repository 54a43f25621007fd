"""How good the findings are (AGG-01 to AGG-22, AGG-35, MTH-16)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.measure import THRESHOLDS, f1, meets, polygons_iou, wilson
from pagelens.functions.text import token_distance

# Labels of a check, least groups of a summary.
POSITIVE, NEGATIVE, ABSTAIN = "VIOLATION_PRESENT", "NO_VIOLATION", "COMPARISON_IMPOSSIBLE"
LEAST = 30
_PAGE = ["file_id", "page"]
#: Draws, seed and least clusters of the resampled intervals.
DRAWS, SEED, CLUSTERS = 1000, 7, 10


def rate(df: DataFrame, keys: list[str], hit: Column, least: int = 0) -> DataFrame:
    """MTH-16 by group: k, n, rate, low, high; groups of fewer than `least` rows have null figures."""
    g = df.groupBy(*keys).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    measured = F.col("n") >= max(least, 1)
    return g.select(*keys, "k", "n", F.when(measured, w["rate"]).alias("rate"), F.when(measured | F.lit(least == 0), w["low"]).alias("low"), F.when(measured | F.lit(least == 0), w["high"]).alias("high"))


def key_fields(rows: DataFrame) -> DataFrame:
    """AGG-03: exact matches by kind (kind, reference, hypothesis); an empty reference never matches; kinds of few rows are not measured."""
    ref, hyp = F.trim("reference"), F.trim("hypothesis")
    same = F.when(F.col("kind") == "STAGE", F.upper(ref) == F.upper(hyp)).otherwise(ref == hyp)
    return rate(rows, ["kind"], F.coalesce(same & (F.length(ref) > 0), F.lit(False)), LEAST)


def linkage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """AGG-04: rows whose ref_ and hyp_ fields are all non-empty and equal."""
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.coalesce((F.length(F.trim(f"ref_{f}")) > 0) & (F.trim(f"ref_{f}") == F.trim(f"hyp_{f}")), F.lit(False))
    return rate(rows, [], ok, LEAST)


def line_accuracy(ref: Column, hyp: Column) -> Column:
    """AGG-06: 1 less the edit distance over the reference's length, not below 0; an empty reference is 1 against nothing, else 0."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(ref, hyp) / F.length(ref)))


def pooled_accuracy(rows: DataFrame, keys: list[str], ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """AGG-05, AGG-08, AGG-09: over all lines together character accuracy and word error rate; shares of exact lines and of lines at 0.95 or more.

    Lines with an empty reference don't count in the characters, but their words do count as errors;
    null where there are no characters or words to compare with.
    """
    r, h = (F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) for c in (ref, hyp))
    x = rows.select(*keys, r.alias("_r"), h.alias("_h")).withColumn("_words", token_distance(F.col("_r"), F.col("_h")))
    r, h, some = F.col("_r"), F.col("_h"), F.length("_r") > 0
    n_words = F.when(some, F.size(F.split("_r", " "))).otherwise(0)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.when(some, F.levenshtein(r, h))).alias("distance"), F.sum(F.when(some, F.length(r))).alias("chars"), F.sum("_words").alias("word_distance"), F.sum(n_words).alias("words"), F.count_if(r == h).alias("exact"), F.count_if(line_accuracy(r, h) >= 0.95).alias("passed")]
    g = x.groupBy(*keys).agg(*aggs)
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    return g.select(*keys, "n", F.when(F.col("chars") > 0, F.greatest(F.lit(0.0), 1 - rate("distance", "chars"))).alias("accuracy"), rate("word_distance", "words").alias("wer"), (F.col("exact") / F.col("n")).alias("exact_share"), (F.col("passed") / F.col("n")).alias("pass_share"))


def flag_slices(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """AGG-09: the same by flag; abstained lines lower the coverage, not the accuracy."""
    x = rows.withColumn("flag", F.explode_outer(flags))
    done = pooled_accuracy(x.where("not abstained"), ["flag"])
    cover = x.groupBy("flag").agg((1 - F.count_if("abstained") / F.count(F.lit(1))).alias("coverage"))
    return cover.join(done, ["flag"], "left")


def upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-10: count and the upper of the middle values.  Values are counted first, so that a hot group is as many rows as it has distinct values."""
    c = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*keys).orderBy(value)
    c = c.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    return c.where("upto > n div 2").groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("median"))


def reliability_bins(samples: DataFrame, bins: int = 10) -> DataFrame:
    """AGG-11: bin, n, mean confidence and share correct; all bins are there, empty ones with 0."""
    b = samples.where(F.col("confidence").isNotNull()).select(F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int").alias("bin"), "confidence", "correct")
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """AGG-12: null for no samples."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def choose_threshold(samples: DataFrame, min_n: int = 30, risk: float = 0.1) -> DataFrame:
    """AGG-13, WIN-08: the least confidence, to two places, above which the interval of the error rate stays under the risk.

    Samples are counted per confidence first; the running sums are over at most 101 rows.
    """
    g = samples.groupBy(F.round("confidence", 2).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    down = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    z = g.select("t", F.sum("n").over(down).alias("n"), F.sum("wrong").over(down).alias("wrong"))
    return z.where((F.col("n") >= min_n) & (wilson(F.col("wrong"), F.col("n"))["high"] <= risk)).agg(F.min("t").alias("t_high"))


def reduce_predictions(predictions: DataFrame, keys: list[str], label: str, pos: str) -> DataFrame:
    """AGG-16: a violation wins; else the last label."""
    last = F.max_by(label, F.struct(pos, label))
    return predictions.groupBy(*keys).agg(F.when(F.bool_or(F.col(label) == POSITIVE), POSITIVE).otherwise(last).alias(label))


def score_scope(gold: DataFrame, predictions: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """AGG-15, AGG-19: by scope the score of the predictions against the gold rows.

    gold: keys, label and, where needed, score_eligible and fpr_denominator (booleans; a row without
    the first is eligible) and localisable (it names a place).  predictions: keys, label and, where
    needed, approved (by an inspector) and localised (its evidence meets the gold place).

    Positives are eligible rows with a violation; a positive without prediction abstains.  The
    negatives of `fpr` are rows without violation that are eligible or in the denominator;
    `fpr_gate` counts the eligible ones of these alone, `fpr_extended` all rows without violation.
    At the approved level a hit that no inspector approved is a false positive.  Rates without a
    denominator are null, not 0, and named in not_measured.
    """
    optional = lambda df, c, v: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
    yes_ = F.lit(True) if "score_eligible" not in gold.columns else F.coalesce("score_eligible", F.lit(False))
    g = gold.select(*keys, *(c for c in scope if c not in keys), "label", yes_.alias("_eligible"), optional(gold, "fpr_denominator", False).alias("_counted"), optional(gold, "localisable", False).alias("_placed"))
    p = predictions.select(*keys, F.col("label").alias("predicted"), optional(predictions, "approved", False).alias("_approved"), optional(predictions, "localised", False).alias("_localised"))
    positive, negative = (F.col("label") == POSITIVE) & F.col("_eligible"), F.col("label") == NEGATIVE
    tz, found = negative & (F.col("_eligible") | F.col("_counted")), F.coalesce(F.col("predicted") == POSITIVE, F.lit(False))
    counts = {
        "n_positive": positive, "tp": positive & found, "fn": positive & ~found, "abstained": positive & (F.col("predicted").isNull() | (F.col("predicted") == ABSTAIN)),
        "n_negative": tz, "fp": tz & found, "n_gate": negative & F.col("_eligible"), "fp_gate": negative & F.col("_eligible") & found, "n_extended": negative, "fp_extended": negative & found,
        "approved_tp": positive & found & F.coalesce("_approved", F.lit(False)), "n_placed": positive & F.col("_placed"), "placed_hits": positive & F.col("_placed") & found & F.coalesce("_localised", F.lit(False)),
    }
    x = g.join(p, keys, "left").groupBy(*scope).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
    x = x.withColumn("approved_fp", F.col("fp") + F.col("tp") - F.col("approved_tp"))
    rates = {
        "recall": ("tp", F.col("n_positive")), "precision": ("tp", F.col("tp") + F.col("fp")), "fpr": ("fp", F.col("n_negative")), "fpr_gate": ("fp_gate", F.col("n_gate")),
        "fpr_extended": ("fp_extended", F.col("n_extended")), "approved_recall": ("approved_tp", F.col("n_positive")), "approved_precision": ("approved_tp", F.col("approved_tp") + F.col("approved_fp")),
        "localization": ("placed_hits", F.col("n_placed")),
    }
    rate_of = {n: F.try_divide(F.col(k).cast("double"), d) for n, (k, d) in rates.items()}
    recall, fpr = wilson(F.col("tp"), F.col("n_positive")), wilson(F.col("fp"), F.col("n_negative"))
    return x.select(
        *scope, *counts, "approved_fp", *(r.alias(n) for n, r in rate_of.items()), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        recall["low"].alias("recall_low"), recall["high"].alias("recall_high"), meets(F.lit("recall"), recall["low"], recall["high"]).alias("recall_met"),
        (meets(F.lit("false_positive_rate"), fpr["low"], fpr["high"]) & (F.col("n_negative") > 0)).alias("fpr_met"),
        F.array_compact(F.array(*(F.when(r.isNull(), n) for n, r in rate_of.items()))).alias("not_measured"),
    )


def localised(gold: DataFrame, evidence: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """AGG-15: keys of which a predicted polygon meets the gold one of the same file and page with an overlap of `least` or more.

    gold, evidence: keys, file_id, page, polygon (array of struct x, y).
    """
    j = gold.select(*keys, *_PAGE, F.col("polygon").alias("a")).join(evidence.select(*keys, *_PAGE, F.col("polygon").alias("b")), [*keys, *_PAGE])
    return j.where(polygons_iou("a", "b") >= least).select(*keys).distinct()


def unlabeled(predictions: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-15: violations predicted where gold says nothing."""
    return predictions.where(F.col("label") == POSITIVE).join(gold.select(*keys).distinct(), keys, "left_anti")


def sensitivity(claims: DataFrame, confidence: str, correct: str, order: list[str], thresholds: tuple[float, ...] = (0.5, 0.8, 0.9), ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """AGG-17, WIN-07: threshold, k, n, hits, precision of the k surest claims of each threshold; ties in the given order.

    The surest claims of all are those of each threshold that they reach, so only the greatest k are
    kept while the claims are read, and nothing is sorted whole.
    """
    top = claims.where(F.col(confidence) >= min(thresholds)).orderBy(F.col(confidence).desc(), *order).limit(max(ks)).select(F.col(confidence).alias("c"), F.col(correct).alias("ok"), F.struct(*order).alias("o"))
    g = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "o", "ok"))).alias("top"))
    grid = g.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    head = F.slice(F.filter("top", lambda x: -x["c"] >= F.col("threshold")), 1, F.col("k"))
    n, hits = F.size(head), F.size(F.filter(head, lambda x: F.coalesce(x["ok"], F.lit(False))))
    return grid.select("threshold", "k", n.alias("n"), hits.alias("hits"), F.try_divide(hits.cast("double"), n).alias("precision"))


def precision_at(claims: DataFrame, keys: list[str], confidence: str, correct: str, order: list[str], k: int) -> DataFrame:
    """WIN-07 by group: keys, n, precision among the k surest claims of each group; of a group only the k greatest are ever ranked together (a group limit comes before the shuffle)."""
    ranked = claims.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(confidence).desc(), *order))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("precision"))


def cluster_f1_interval(counts: DataFrame, draws: int = 5000, seed: int = SEED, least: int = CLUSTERS) -> DataFrame:
    """AGG-18: interval of F1 over resampled clusters; counts: cluster, tp, fp, fn.  Null for fewer than `least` clusters.

    Each cluster's weight in a draw is Poisson, drawn from its hash, so that draws are summed where
    the clusters lie and only one row per draw and task is shuffled.
    """

    def draw(batches):
        import numpy as np

        total = np.zeros((draws, 3))
        for b in batches:
            for c, *n in zip(b["h"], b["tp"], b["fp"], b["fn"]):
                w = np.random.default_rng((seed, int(c) & 0xFFFFFFFF)).poisson(1, draws)
                total += w[:, None] * np.array(n, dtype=float)
        yield pd.DataFrame({"draw": range(draws), "tp": total[:, 0], "fp": total[:, 1], "fn": total[:, 2]})

    n = counts.agg(F.count(F.lit(1)).alias("clusters"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1"))
    d = counts.select(F.xxhash64("cluster").alias("h"), "tp", "fp", "fn").mapInPandas(draw, "draw int, tp double, fp double, fn double").groupBy("draw").agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f"))
    ends = d.agg(F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))
    enough = F.col("clusters") >= least
    return n.withColumn("_one", F.lit(1)).join(ends.withColumn("_one", F.lit(1)), "_one").select("clusters", "f1", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def line_bootstrap(lines: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """AGG-07: accuracy, low, high of the pooled accuracy over resampled lines (id, distance, chars); all null without characters.

    As for clusters, a line's weight in a draw is Poisson, drawn from its id, so that a sample of any
    size is resampled where it lies, and one row per draw and task is shuffled.  Accuracies stop at 0.
    """

    def draw(batches):
        import numpy as np

        total = np.zeros((draws, 2))
        for b in batches:
            for h, distance, chars in zip(b["h"], b["distance"], b["chars"]):
                total += np.random.default_rng((seed, int(h) & 0xFFFFFFFF)).poisson(1, draws)[:, None] * np.array((distance, chars), dtype=float)
        yield pd.DataFrame({"draw": range(draws), "distance": total[:, 0], "chars": total[:, 1]})

    accuracy = F.when(F.sum("chars") > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(F.sum("distance").cast("double"), F.sum("chars").cast("double"))))
    x = lines.where("distance is not null and chars is not null")
    d = x.select(F.xxhash64("id").alias("h"), "distance", "chars").mapInPandas(draw, "draw int, distance double, chars double").groupBy("draw").agg(accuracy.alias("a"))
    ends = d.agg(F.percentile("a", 0.025).alias("low"), F.percentile("a", 0.975).alias("high")).withColumn("_one", F.lit(1))
    whole = x.agg(accuracy.alias("accuracy")).withColumn("_one", F.lit(1))
    return whole.join(ends, "_one").select("accuracy", F.when(F.col("accuracy").isNotNull(), F.col("low")).alias("low"), F.when(F.col("accuracy").isNotNull(), F.col("high")).alias("high"))


def frozen_validation(rows: DataFrame, section: Column, least_low: float = 0.8) -> DataFrame:
    """AGG-20: recall by section with its interval, and whether every section reaches the gate."""
    g = rate(rows.where("gold_positive").withColumn("section", section), ["section"], F.col("predicted_positive"))
    return g.withColumn("meets", F.col("low") >= least_low).withColumn("gate", F.bool_and(F.col("low") >= least_low).over(Window.partitionBy()))


# Categories that a release must cover; points that recall may fall and false positives may rise.
CATEGORIES = ("AR", "IOS", "KR", "OOS", "PZ", "SM")
POINTS = 2.0


def release_gate(now: DataFrame, baseline: DataFrame, intervals: DataFrame, signed: bool) -> DataFrame:
    """AGG-21: blocking, subject: everything that stands against a release; no row means that it may go out.

    now, baseline: category, recall, fpr; intervals: metric, low, high.  A release needs a signature,
    all of CATEGORIES, an interval within its threshold for every metric, and against the baseline
    no category whose recall fell or whose false positives rose by more than POINTS points.
    """
    spark = now.sparkSession
    row = lambda df, blocking, subject: df.select(F.lit(blocking).alias("blocking"), F.col(subject).alias("subject"))
    unsigned = spark.createDataFrame([] if signed else [("unsigned", "signature")], "blocking string, subject string")
    wanted = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    gone = row(wanted.join(now.where("recall is not null"), "category", "left_anti"), "missing", "category")
    metrics = spark.createDataFrame([(m,) for m in THRESHOLDS], "metric string").join(intervals, "metric", "left")
    unmeasured = row(metrics.where("low is null or high is null"), "not_measured", "metric")
    unmet = row(metrics.where(~meets(F.col("metric"), F.col("low"), F.col("high"))), "threshold", "metric")
    j = now.join(baseline.select("category", F.col("recall").alias("r0"), F.col("fpr").alias("f0")), "category")
    fell = row(j.where((F.col("r0") - F.col("recall")) * 100 > POINTS), "recall", "category")
    rose = row(j.where((F.col("fpr") - F.col("f0")) * 100 > POINTS), "fpr", "category")
    return unsigned.unionByName(gone).unionByName(unmeasured).unionByName(unmet).unionByName(fell).unionByName(rose)


def acceptance(gates: DataFrame) -> DataFrame:
    """AGG-22: gate, verdict from evidence (missing, SILVER or measured) and whether it closes; bad is worse than incomplete than ok."""
    v = F.when(F.col("evidence").isNull() | (F.col("evidence") == "SILVER"), "incomplete").when(~F.coalesce("closes", F.lit(False)), "bad").otherwise("ok")
    return gates.select("gate", v.alias("verdict"))


def worst(verdicts: DataFrame) -> DataFrame:
    """AGG-22: the verdict over all gates."""
    return verdicts.agg(F.when(F.bool_or(F.col("verdict") == "bad"), "bad").when(F.bool_or(F.col("verdict") == "incomplete"), "incomplete").otherwise("ok").alias("verdict"))
