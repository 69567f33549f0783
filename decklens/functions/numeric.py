"""Number helpers: Python-exact rounding, clamping, zone labels, time texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from decklens import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A filter on a derived column is pushed below the projection that made it, which copies the
    whole expression; naming a value once keeps that copy small.
    """
    return F.get(F.transform(F.array(value), body), 0)


def py_round(x: Column, digits: int) -> Column:
    """Round like Python's ``round(float, digits)``: half-even on the exact binary value.

    ``bround`` works on the shortest decimal text of the double and so turns 2.675 into 2.68 where
    Python gives 2.67. ``format_number`` decides ties on the binary value, as Python does.
    """
    if digits == 0:
        return F.rint(x)
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` limited to ``low..high``; null stays null."""
    return let(x, lambda v: F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v))


def exact_sum(x: Column, decimals: int = 4) -> Column:
    """Sum of short decimals held as doubles.

    Added as decimals, so the result does not depend on how rows are split over tasks.
    """
    return F.sum(x.cast(f"decimal(18,{decimals})")).cast("double")


def mean_of(total: Column, n: Column) -> Column:
    """``total / n``; null for an empty group."""
    return total / F.when(n > 0, n)


def _label(x: Column, zones, rest: str, holds) -> Column:
    def pick(v: Column) -> Column:
        out = F.when(v.isNull(), F.lit(None).cast("string"))
        for limit, label in zones:
            out = out.when(holds(v, limit), F.lit(label))
        return out.otherwise(F.lit(rest))

    return let(x, pick)


def label_up_to(x: Column, zones, rest: str) -> Column:
    """Label of the first zone whose upper limit is not exceeded; null stays null."""
    return _label(x, zones, rest, lambda v, limit: v <= limit)


def label_from(x: Column, zones, rest: str) -> Column:
    """Label of the first zone whose lower limit is reached; null stays null."""
    return _label(x, zones, rest, lambda v, limit: v >= limit)


def _whole(seconds: Column) -> Column:
    return F.rint(seconds.cast("double")).cast("bigint")


def _minutes(whole: Column) -> Column:
    return F.floor(whole / 60)


def _rest(whole: Column) -> Column:
    return F.pmod(whole, F.lit(60))


def format_seconds(seconds: Column) -> Column:
    """``45s`` below a minute, else ``3m 05s``; a dash for null."""
    s = _whole(seconds)
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(s < 60, F.format_string("%ds", s))
        .otherwise(F.format_string("%dm %02ds", _minutes(s), _rest(s)))
    )


def format_seconds_chart(seconds: Column) -> Column:
    """As :func:`format_seconds` without the space, and without a zero seconds part; null is 0."""
    s = F.coalesce(_whole(seconds), F.lit(0).cast("bigint"))
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(_rest(s) == 0, F.format_string("%dm", _minutes(s)))
        .otherwise(F.format_string("%dm%02ds", _minutes(s), _rest(s)))
    )


def format_seconds_total(seconds: Column) -> Column:
    """``2m 5s``, minutes always shown (deck totals)."""
    s = seconds.cast("bigint")
    return F.format_string("%dm %ds", _minutes(s), _rest(s))


def format_clock(seconds: Column) -> Column:
    """``MM:SS`` of the running clock."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d", _minutes(s), _rest(s))


def deviation_pct(real: Column, reference: Column) -> Column:
    """Whole percent by which ``real`` differs from ``reference``; 0 without a reference."""
    usable = reference.isNotNull() & (reference != 0)
    gap = (real - reference) / F.when(usable, reference) * 100
    return F.when(usable, F.rint(gap.cast("double")).cast("int")).otherwise(F.lit(0))


def deviation_status(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), F.lit(K.STATUS_NO_TIME))
        .when(pct < -K.DEVIATION_LIMIT, F.lit(K.STATUS_UNDER))
        .when(pct > K.DEVIATION_LIMIT, F.lit(K.STATUS_OVER))
        .otherwise(F.lit(K.STATUS_OK))
    )
