"""Scores, labels and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks with a name of their own, in the order in which they are tried.
FRACTIONS = [(1 / 3, "1/3"), (0.25, "1/4"), (0.5, "1/2"), (0.2, "1/5")]
FRACTION_SLACK = 0.005


def negative_of(mark: Column) -> Column:
    """The mark lost for a wrong answer; null, unreadable or below 0 is 0."""
    return F.greatest(F.coalesce(mark.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def raw_net(correct: Column, wrong: Column, mark: Column) -> Column:
    """The net score that ranks attempts: neither rounded nor clamped."""
    return correct - wrong * F.coalesce(mark, F.lit(0.0))


def round_to(x: Column, digits: int) -> Column:
    """x to some decimals, half to even on its exact binary value.

    Neither `round` nor `bround` does that: both start from the shortest decimal form. Here the product with a power of
    ten is split into what a double holds and the rest that it lost, which tells a true half from a near one.
    """
    ten = F.lit(10.0**digits)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    product = x * ten
    lost = (high * ten - product) + (x - high) * ten
    half = product - F.floor(product) == 0.5
    return F.rint(product + F.when(half, F.signum(lost) * 0.25).otherwise(0.0)) / ten


def round2(x: Column) -> Column:
    return round_to(x.cast("double"), 2)


def net_score(correct: Column, wrong: Column, mark: Column) -> Column:
    return round2(correct.cast("double") - wrong.cast("double") * negative_of(mark))


def negative_label(mark: Column) -> Column:
    neg = negative_of(mark)
    out = F.when(neg <= 0, F.lit(""))
    for value, label in FRACTIONS:
        out = out.when(F.abs(neg - F.lit(value)) < FRACTION_SLACK, F.lit(label))
    return out.otherwise(F.regexp_replace(F.format_string("%.2f", round2(neg)), r"\.?0+$", ""))


def score_text(rounded: Column) -> Column:
    """A score of two decimals: without them if it is whole."""
    return F.when(rounded == F.rint(rounded), F.rint(rounded).cast("long").cast("string")).otherwise(F.format_string("%.2f", rounded))


def format_score(x: Column) -> Column:
    return score_text(round2(F.coalesce(x, F.lit(0.0))))


def percent(correct: Column, total: Column) -> Column:
    """One decimal and a sign; "0%" of nothing."""
    return F.when(total > 0, F.format_string("%.1f%%", round_to(F.lit(100.0) * correct / total, 1))).otherwise(F.lit("0%"))


def percentage(correct: Column, total: Column) -> Column:
    return F.when(total > 0, round2(F.lit(100.0) * correct / total)).otherwise(F.lit(0.0))


def unanswered(total: Column, *answered: Column) -> Column:
    return F.greatest(F.lit(0), total - sum(answered[1:], answered[0]))


def format_duration(seconds: Column) -> Column:
    s = F.rint(F.coalesce(seconds, F.lit(0.0))).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, rest)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))


def timer_label(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    m = F.floor(s / 60)
    return (
        F.when(s <= 0, "No timer").when((s < 60) | (s == 90), F.format_string("%d sec", s))
        .when(s % 60 == 0, F.format_string("%d min", m)).otherwise(F.format_string("%d min %d sec", m, s % 60))
    )


def net_suffix(net: Column, mark: Column) -> Column:
    """What a result line says of its net score (rounded, best a column of its own); nothing without negative marking."""
    told = F.concat(F.lit(" • Net "), score_text(net), F.lit(" (-"), negative_label(mark), F.lit(")"))
    return F.when(negative_of(mark) > 0, told).otherwise(F.lit(""))


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def stats_name(username: Column, first_name: Column, user_id: Column) -> Column:
    """Handle first, then first name, then the id."""
    return F.coalesce(F.concat(F.lit("@"), _given(username)), _given(first_name), F.concat(F.lit("User "), user_id.cast("string")))


def group_name(username: Column, first_name: Column, user_id: Column) -> Column:
    """First name first, then handle, then the id."""
    return F.coalesce(_given(first_name), F.concat(F.lit("@"), _given(username)), F.concat(F.lit("User "), user_id.cast("string")))


def user_label(username: Column, first_name: Column, user_id: Column) -> Column:
    """Name and handle as far as they are known, and the id."""
    name, handle = _given(F.trim(first_name)), F.concat(F.lit("@"), _given(F.trim(username)))
    shown = F.coalesce(F.concat(name, F.lit(" ("), handle, F.lit(")")), name, handle, F.concat(F.lit("User "), user_id.cast("string")))
    return F.concat(shown, F.lit(" · ID "), user_id.cast("string"))


def history_line(correct: Column, wrong: Column, skipped: Column, timeouts: Column, total: Column, net: Column, mark: Column, duration: Column, finished_at: Column, status: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.concat(
        F.lit("• "), text(correct), F.lit("/"), text(total), F.lit(" ("), percent(correct, total), F.lit(") ✅"), text(correct), F.lit(" ❌"), text(wrong), F.lit(" ⏭"), text(skipped),
        F.lit(" ⏰"), text(F.coalesce(timeouts, F.lit(0))), net_suffix(net, mark), F.lit(" • "), format_duration(duration), F.lit(" • "),
        F.coalesce(F.date_format(finished_at, "yyyy-MM-dd HH:mm"), F.lit("")), F.when(status == "stopped", F.lit(" (stopped)")).otherwise(F.lit("")),
    )
