"""Column expressions on numbers, times, durations and codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from corpuscope.fixed_values import SNAPSHOT_DATE


def numeric(col: Column, kind: str = "double") -> Column:
    """Coerce text to a number; junk such as 'N/A' and NaN become NULL."""
    value = col.try_cast(kind)
    if kind in ("double", "float"):
        return F.when(~F.isnan(value), value)
    return value


def parse_timestamp(col: Column) -> Column:
    """ISO-8601 text to timestamp, NULL when unreadable."""
    return F.try_to_timestamp(col)


def age_days(ts: Column, snapshot: str = SNAPSHOT_DATE) -> Column:
    """Whole days from ``ts`` to the snapshot, rounded towards minus infinity."""
    micros = F.unix_micros(F.lit(snapshot).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint")


def rate_per_day(count: Column, days: Column, min_count: float | None = None, min_days: float | None = None) -> Column:
    """``count / days``; division by zero gives NULL.

    Rows below an optional minimum count or age give NULL as well.
    """
    rate = F.try_divide(count.cast("double"), days.cast("double"))
    if min_count is not None:
        rate = F.when(count > min_count, rate)
    if min_days is not None:
        rate = F.when(days >= min_days, rate)
    return rate


_CLOCK = r"^\s*(?:(\d+) days?,? )?(\d+):(\d+):(\d+(?:\.\d+)?)\s*$"


def duration_seconds(col: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``D day(s), H:MM:SS``; NULL otherwise."""
    def part(index: int) -> Column:
        return F.regexp_extract(col, _CLOCK, index)

    days = F.coalesce(part(1).try_cast("double"), F.lit(0.0))
    return (
        days * 86400 + part(2).try_cast("double") * 3600
        + part(3).try_cast("double") * 60 + part(4).try_cast("double")
    )


def duration_minutes(col: Column) -> Column:
    """Minutes of ``H:M:S`` or ``M:S``; any other shape (such as days) is NULL."""
    parts = F.split(col, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(parts) == 3, number(0) * 60 + number(1) + number(2) / 60)
        .when(F.size(parts) == 2, number(0) + number(1) / 60)
    )


def iso_duration_seconds(col: Column) -> Column:
    """Seconds of an ISO-8601 duration; a missing value counts as ``PT0S``."""
    text = F.coalesce(col, F.lit("PT0S"))
    shape = r"^P(?:\d+W)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"
    total = F.lit(0.0)
    for unit, seconds in (("W", 604800), ("D", 86400), ("H", 3600), ("M", 60), ("S", 1)):
        amount = F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double")
        total = total + F.coalesce(amount, F.lit(0.0)) * seconds
    return F.when(text.rlike(shape), total)


def clock_text(seconds: Column) -> Column:
    """``H:MM:SS`` with a leading ``D day(s), `` from one day on."""
    whole = F.floor(seconds).cast("bigint")
    days = F.floor(whole / 86400).cast("bigint")
    clock = F.format_string(
        "%d:%02d:%02d", F.floor((whole % 86400) / 3600).cast("bigint"),
        F.floor((whole % 3600) / 60).cast("bigint"), whole % 60,
    )
    return (
        F.when(days == 0, clock)
        .when(days == 1, F.concat(F.lit("1 day, "), clock))
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "), clock))
    )


def binary_encode(col: Column, one: str = "true", zero: str = "false") -> Column:
    """Text flag to 1/0, anything else NULL; booleans and 1/0 are read as flags too."""
    text = F.lower(col.cast("string"))
    if (one, zero) == ("true", "false"):
        return F.when(text.isin(one, "1"), 1).when(text.isin(zero, "0"), 0)
    return F.when(text == one, 1).when(text == zero, 0)


def significance(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    )


def threshold_label(p: Column, threshold) -> Column:
    return (p >= threshold).cast("int")


def keyword_slug(col: Column) -> Column:
    """Keyword to table name: blanks and hyphens become underscores."""
    return F.translate(col, " -", "__")


def literal_map(mapping: Mapping[str, object]) -> Column:
    """A map literal; ``mapping`` already lives on the driver, so it is small."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)


def label_map(col: Column, labels: Mapping[str, str]) -> Column:
    """Code to display label, the code itself where no label exists."""
    return F.coalesce(F.try_element_at(literal_map(labels), col), col)
