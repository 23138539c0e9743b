"""Time expressions: RFC 3339 instants, relative durations and interval settings."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the accepted text forms and fall-backs. ---
DURATION = r"^\s*([+-]?[0-9]+)([dhms])\s*$"
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
    r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$"
)
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
DEFAULT_INTERVAL = 120.0
DEFAULT_BATCH_TIMEOUT = 1.0


def parse_duration(text: Column) -> Column:
    """``7d``, ``24h``, ``30m`` or ``60s`` as a day-time interval; NULL for anything else."""
    amount = F.regexp_extract(text, DURATION, 1).try_cast("bigint")
    unit = F.regexp_extract(text, DURATION, 2)
    seconds = F.coalesce(
        *[F.when(unit == u, F.try_multiply(amount, F.lit(n))) for u, n in UNIT_SECONDS.items()]
    )
    # Intervals hold at most this many whole seconds.
    in_range = F.abs(seconds) <= 9_223_372_036_854
    return F.when(in_range, F.expr("interval '1' second") * seconds)


def parse_time(text: Column, now: Column) -> Column:
    """RFC 3339 text, or a duration before ``now``, as a zone-free UTC time; else NULL."""
    instant = F.regexp_replace(F.upper(text), " ", "T")
    # Fractions beyond microseconds are cut off, as the tables do.
    cut = F.regexp_replace(instant, r"(\.[0-9]{6})[0-9]+", "$1")
    absolute = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), cut.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(text.rlike(RFC3339), absolute).otherwise(now - parse_duration(text))


def require(parsed: Column, text: Column, what: str) -> Column:
    """Fail where ``text`` could not be parsed."""
    message = F.concat(F.lit("cannot parse "), F.coalesce(text, F.lit("NULL")), F.lit(f" as {what}"))
    return F.coalesce(parsed, F.raise_error(message).cast(_type_of(what)))


def _type_of(what: str) -> str:
    return "timestamp_ntz" if what == "time" else "interval day to second"


def duration(text: str) -> timedelta:
    """The literal form of :func:`parse_duration`; an error where the text is no duration."""
    match = re.match(DURATION, text)
    if not match:
        raise ValueError(f"cannot parse {text!r} as duration")
    return timedelta(seconds=int(match[1]) * UNIT_SECONDS[match[2]])


def _leading_number(text: str, suffix: str, whole: bool = False) -> float | None:
    if not text.endswith(suffix):
        return None
    pattern = r"\+?[0-9]+" if whole else r"\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    number = text[: -len(suffix)]
    return float(number) if re.fullmatch(pattern, number) else None


def interval_seconds(text: str) -> float:
    """Ingest interval: ``500ms``, ``1h``, ``1.5m``, ``30s``; anything else is two minutes."""
    for suffix, factor, whole in (("ms", 0.001, True), ("h", 3600, False), ("m", 60, False), ("s", 1, False)):
        number = _leading_number(text, suffix, whole)
        if number is not None:
            return number * factor
    return DEFAULT_INTERVAL


def batch_timeout_seconds(text: str) -> float:
    """Batch timeout: ``1s``, ``0.5s``, ``500ms``; anything else is one second."""
    for suffix, factor, whole in (("s", 1, False), ("ms", 0.001, True)):
        number = _leading_number(text, suffix, whole)
        if number is not None:
            return number * factor
    return DEFAULT_BATCH_TIMEOUT


def trigger_text(seconds: float) -> str:
    """A ``processingTime`` trigger for an interval."""
    return f"{max(1, round(seconds * 1000))} milliseconds"
