"""Comparison of a stage pair under a declarative rule (CMP-01 to CMP-10), as one struct column.

A rule is a struct with operator, value (double), min_value, max_value, tolerance_abs,
tolerance_rel, rounding, values (array of strings) and trigger (text).  The result is a struct
of status, expected, actual, delta and error_reason; a bad ladder or an unknown operator is an
error_reason, not an exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.measure import exact_delta, quantize
from pagelens.functions.text import fold_homoglyphs

SAME, DIFFERENT, NO_EVIDENCE = "AUTO_NO_DIFFERENCE", "CANDIDATE", "MISSING_EVIDENCE"
OPERATORS = ("delta", "eq", "ne", "lt", "le", "gt", "ge", "range", "in_set", "not_in_set", "class_not_lower", "present")
#: Distance below which a relative tolerance has no base.
TINY = 1e-12
# Parts of words of a trigger that make it neutral, falling or rising.
NEUTRAL = "расхожден|изменен|подмен|сдвиг|замен"
FALLING = "уменьшен|понижен|менее прочн|менее пластич"
RISING = "увеличен|превышен"


def verdict(same: Column) -> Column:
    return F.when(same, SAME).otherwise(DIFFERENT)


def outcome(status: Column, expected: Column, actual: Column, delta: Column | None = None, error: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(status.alias("status"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), (none if delta is None else delta).cast("double").alias("delta"), (none if error is None else error).cast("string").alias("error_reason"))


def trigger_sense(text: Column) -> Column:
    """CMP-08: decrease or increase; null for a neutral text, for both and for neither."""
    t = F.translate(F.lower(text), "ё", "е")
    down, up = t.rlike(FALLING), t.rlike(RISING)
    return F.when(t.rlike(NEUTRAL), F.lit(None).cast("string")).when(down & ~up, "decrease").when(up & ~down, "increase")


def compare_delta(rule: Column, expected: Column, actual: Column) -> Column:
    """CMP-01, CMP-09: within the absolute or the relative tolerance; both missing is the same; a difference against the trigger's sense is none."""
    e, a = quantize(expected, rule["rounding"]), quantize(actual, rule["rounding"])
    d = exact_delta(a, e)
    size = F.greatest(F.abs(e), F.abs(a), F.lit(TINY))
    same = (F.abs(d) <= F.coalesce(rule["tolerance_abs"], F.lit(0.0))) | (F.abs(d) / size <= F.coalesce(rule["tolerance_rel"], F.lit(-1.0)))
    sense = trigger_sense(rule["trigger"])
    against = ((sense == "decrease") & (d >= 0)) | ((sense == "increase") & (d <= 0))
    return outcome(F.when(e.isNull() | a.isNull(), verdict(e.isNull() & a.isNull())).otherwise(verdict(same | F.coalesce(against, F.lit(False)))), e, a, d)


def compare_ordering(rule: Column, expected: Column, actual: Column) -> Column:
    """CMP-02: the actual value against the rule's own value, or the expected one where the rule has none."""
    ref, op = F.coalesce(rule["value"], expected), rule["operator"]
    holds = F.when(op == "eq", actual == ref).when(op == "ne", actual != ref).when(op == "lt", actual < ref).when(op == "le", actual <= ref).when(op == "gt", actual > ref).when(op == "ge", actual >= ref)
    return outcome(verdict(F.coalesce(holds, F.lit(False))), ref, actual, exact_delta(actual, ref))


def compare_range(rule: Column, expected: Column, actual: Column) -> Column:
    """CMP-03: both ends belong to the range, either may be missing."""
    inside = F.coalesce(actual >= rule["min_value"], F.lit(True)) & F.coalesce(actual <= rule["max_value"], F.lit(True)) & actual.isNotNull()
    return outcome(verdict(inside), expected, actual)


def compare_membership(rule: Column, actual_text: Column) -> Column:
    """CMP-04: without outer blanks and case; an empty set contains nothing."""
    held = F.coalesce(F.array_contains(F.transform(rule["values"], lambda v: F.upper(F.trim(v))), F.upper(F.trim(actual_text))), F.lit(False))
    return outcome(verdict(F.when(rule["operator"] == "in_set", held).otherwise(~held)), F.lit(None), F.lit(None))


def class_rank(ladder: Column, value: Column) -> Column:
    """Place on a ladder from low to high, from 0; null for an unknown value; the first of equal steps counts."""
    place = F.array_position(F.transform(ladder, lambda v: fold_homoglyphs(F.trim(v))), fold_homoglyphs(F.trim(value)))
    return F.when(place > 0, (place - 1).cast("double"))


def compare_class(rule: Column, expected_text: Column, actual_text: Column) -> Column:
    """CMP-05: an equal or higher step is right, a lower one is not; reported as places on the ladder."""
    ladder = rule["values"]
    e, a = class_rank(ladder, expected_text), class_rank(ladder, actual_text)
    error = F.when(F.coalesce(F.size(ladder), F.lit(0)) <= 0, "empty ladder").when(e.isNull() | a.isNull(), "unknown class")
    return outcome(F.when(error.isNull(), verdict(a >= e)), e, a, a - e, error)


def compare_text(rule: Column, expected_text: Column, actual_text: Column) -> Column:
    """CMP-06: equality of strings; the difference is 0 or 1."""
    equal = F.coalesce(expected_text == actual_text, F.lit(False))
    return outcome(verdict(F.when(rule["operator"] == "ne", ~equal).otherwise(equal)), F.lit(None), F.lit(None), (~equal).cast("int"))


def compare_presence(found: Column) -> Column:
    """CMP-07."""
    return outcome(F.when(F.coalesce(found, F.lit(False)), SAME).otherwise(NO_EVIDENCE), F.lit(None), found.cast("int"))


def compare(rule: Column, expected: Column, actual: Column, expected_text: Column, actual_text: Column) -> Column:
    """CMP-10: the comparison that the rule's operator names; eq and ne go by text where neither side is a number."""
    op = rule["operator"]
    texts = expected_text.isNotNull() & actual_text.isNotNull() & expected.isNull() & actual.isNull()
    return (
        F.when(op == "delta", compare_delta(rule, expected, actual))
        .when(op.isin("eq", "ne") & texts & rule["value"].isNull(), compare_text(rule, expected_text, actual_text))
        .when(op.isin("eq", "ne", "lt", "le", "gt", "ge"), compare_ordering(rule, expected, actual))
        .when(op == "range", compare_range(rule, expected, actual))
        .when(op.isin("in_set", "not_in_set"), compare_membership(rule, actual_text))
        .when(op == "class_not_lower", compare_class(rule, expected_text, actual_text))
        .when(op == "present", compare_presence(actual_text.isNotNull()))
        .otherwise(outcome(F.lit(None).cast("string"), F.lit(None), F.lit(None), None, F.lit("unknown operator")))
    )
