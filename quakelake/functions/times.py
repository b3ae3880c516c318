"""Time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted catalog time formats, in order, and their shapes. The shape is tested
# first so that each row runs the one matching parser.
TIME_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
]
DATE_ONLY = (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone (taken as UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def parse_time(c: Column, date_only: bool = False) -> Column:
    """First accepted format that fits, else NULL.

    A date without a time fits none of the formats; ``date_only=True`` accepts it as midnight.
    """
    text = F.btrim(c)
    formats = TIME_FORMATS + ([DATE_ONLY] if date_only else [])
    parsed = F.lit(None).cast("timestamp")
    for shape, fmt in reversed(formats):
        parsed = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))).otherwise(parsed)
    return parsed


def pick_time(c: Column) -> Column:
    """Absolute pick time: date, blank, time with 1-6 fraction digits."""
    shape, fmt = TIME_FORMATS[2]
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)))
