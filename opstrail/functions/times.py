"""Time functions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

STOP_FORMAT = "%Y-%m-%d %H:%M:%S"


def instant(c: Column) -> Column:
    """Unix seconds as a timestamp."""
    return F.timestamp_seconds(c)


def utc_literal(text: str, type_name: str = "timestamp") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` read as UTC, as a literal of the column type compared with.

    Neither form depends on the session time zone.
    """
    parsed = datetime.strptime(text, STOP_FORMAT)
    if type_name == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(int(parsed.replace(tzinfo=timezone.utc).timestamp())))


def elapsed_text(ms: Column) -> Column:
    """Milliseconds as ``250ms``, ``1.5s``, ``1m0.25s`` or ``2h0m5s``."""
    whole = F.floor(ms / 1000)
    fraction = F.rtrim(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("0"))
    seconds = F.concat(
        (whole % 60).cast("string"),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("s"),
    )
    minutes = F.concat((F.floor(whole / 60) % 60).cast("string"), F.lit("m"), seconds)
    hours = F.concat(F.floor(whole / 3600).cast("string"), F.lit("h"), minutes)
    return (
        F.when(ms == 0, "0s")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, seconds)
        .when(ms < 3_600_000, minutes)
        .otherwise(hours)
    )
