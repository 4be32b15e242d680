"""Column expressions over export file names and header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.profiles import DEVICE_MARKERS

TIME_COLUMN = "Time UTC"

# The time range at the end of an export name.
TIME_RANGE = r"_(\d{8}T\d{6}(?:\.\d+)?Z)_(\d{8}T\d{6}(?:\.\d+)?Z)(?:-NaN)?\.csv$"


def clean_header(field: Column) -> Column:
    """Normalise one header field: comment mark, blanks, quotes, time column."""
    bare = F.regexp_replace(F.trim(field), "^#", "")
    bare = F.regexp_replace(F.trim(bare), '^"+|"+$', "")
    is_time = bare.startswith(TIME_COLUMN) | bare.isin("sampleTime", "sample_time")
    return F.when(is_time, TIME_COLUMN).otherwise(bare)


def device_family(name: Column) -> Column:
    device = F.lit("other")
    for family, marker in reversed(DEVICE_MARKERS.items()):
        device = F.when(name.contains(marker), family).otherwise(device)
    return device


def name_time(name: Column, part: int) -> Column:
    """Start (1) or end (2) of the time range in an export name, or null."""
    stamp = F.regexp_extract(name, TIME_RANGE, part)
    digits = F.regexp_replace(stamp, "[TZ]", "")
    whole = F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss"))
    micros = F.rpad(F.regexp_extract(digits, r"\.(\d{1,6})", 1), 6, "0").try_cast("bigint")
    return F.timestamp_micros(F.unix_micros(whole) + F.coalesce(micros, F.lit(0)))


def series_key(name: Column) -> Column:
    """Name without its time range and without its last `_` part before it."""
    prefix = F.regexp_replace(name, TIME_RANGE, "")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(name.rlike(TIME_RANGE), F.regexp_replace(prefix, "_[^_]*$", "")).otherwise(stem)


def display_source(name: Column) -> Column:
    """Short source name for report tables: no suffix, no time range."""
    bare = F.replace(name, F.lit(".csv"), F.lit(""))
    return F.regexp_replace(bare, r"(?s)_\d{8}T\d{6}(?:\.\d+)?Z.*$", "")
