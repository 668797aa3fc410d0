"""Text, boolean and time helpers of the feeds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Fixed values of the wire format: what stands for the delimiters inside free text. Line
# breaks end a line of the feed, so they are written in the same way.
ESCAPES = {":": "U+003A", ",": "U+002C", "\n": "U+000A", "\r": "U+000D"}


def escape_delimiters(text: Column) -> Column:
    for char, code in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape_delimiters(text: Column) -> Column:
    for char, code in ESCAPES.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def lenient_boolean(text: Column) -> Column:
    """``true``/``false`` in any case; everything else is false."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def lenient_millis(text: Column) -> Column:
    """Epoch milliseconds written as ``"1539202764000.0"``."""
    return F.substring_index(text, ".", 1).try_cast("bigint")


def created_at_ms(text: Column) -> Column:
    """Epoch milliseconds of ``"Wed Oct 10 20:19:24 +0000 2018"``.

    Spark does not parse weekday names, so the leading one is cut off.
    """
    without_weekday = F.regexp_replace(text, r"^\w+\s+", "")
    return F.unix_millis(F.try_to_timestamp(without_weekday, F.lit("MMM dd HH:mm:ss Z yyyy")))


def day_offset_ms(time_ms: Column, days: int) -> Column:
    return time_ms + F.lit(days * DAY_MS)
