"""Scalar column expressions: numbers, text, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TODAY = "today"


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit.cast("double")))


def logit(p: Column | float) -> Column:
    p = F.lit(p) if isinstance(p, (int, float)) else p
    return F.log(F.try_divide(p, 1.0 - p))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)


def half_even(c: Column, digits: int) -> Column:
    """Round with ties to the even digit, as the published numbers are."""
    return F.bround(c, digits)


def equal_bin(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Index of v among n equal bins over [lo, hi]; the last bin is closed on the right."""
    width = hi - lo
    raw = F.when(width > 0, F.floor((v - lo) / width * n)).otherwise(F.lit(0))
    return F.least(raw, n - 1).cast("int")


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals of the number as stored, exact halves away from zero."""
    halves = c * float(2 ** (digits + 1))                # exact; an odd whole number is a number halfway between two texts
    tie = F.pmod(halves, F.lit(2.0)) == 1.0
    pattern = F.lit("0." + "0" * digits if digits else "0")
    return F.call_function("format_number", F.when(tie, c * (1 + 1e-12)).otherwise(c), pattern)


def metres(m: Column) -> Column:
    return F.concat(fixed(m, 1), F.lit(" m"))


def compact(n: Column) -> Column:
    """2.1 M, 3 k, 87."""
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000.0, 1), F.lit(" M")))
        .when(n >= 1_000, F.concat(F.round(n / 1_000.0, 0).cast("long").cast("string"), F.lit(" k")))
        .otherwise(n.cast("string"))
    )


def object_name(name: Column, object_id: Column) -> Column:
    """The given name, or Object 07."""
    return F.coalesce(name, F.concat(F.lit("Object "), padded_id(object_id)))


def padded_id(object_id: Column) -> Column:
    return F.when(object_id < 10, F.lpad(object_id.cast("string"), 2, "0")).otherwise(object_id.cast("string"))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def stays_inside(path: Column) -> Column:
    return ~F.contains(path, F.lit(".."))


def title_words(title: Column) -> Column:
    return F.split(title, " · ")


# ---- dates ---------------------------------------------------------------------------------------------------------

def captured_at(captured: Column) -> Column:
    """The capture's time; the word "today" is the current date; anything unreadable is null."""
    return F.when(captured == TODAY, F.current_timestamp()).otherwise(F.try_to_timestamp(captured))


def _dated(captured: Column, pattern: str, missing: str) -> Column:
    return F.coalesce(F.date_format(captured_at(captured), pattern), F.lit(missing))


def date_text(captured: Column) -> Column:
    return F.when(captured == TODAY, F.lit(TODAY)).otherwise(_dated(captured, "d MMM yyyy", "undated"))


def short_date_text(captured: Column) -> Column:
    return F.when(captured == TODAY, F.lit(TODAY)).otherwise(_dated(captured, "d MMM", "—"))


def month_text(captured: Column) -> Column:
    return _dated(captured, "MMM", "—")


def year_text(captured: Column) -> Column:
    return _dated(captured, "yyyy", "————")


def clock_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm")


def stat_text(stats: Column, key: str) -> Column:
    return F.coalesce(stats[key], F.lit("—"))


def short_sha1(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 7)
