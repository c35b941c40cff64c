"""Identifiers that sort by the time they were made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(at: Column, random: Column | None = None) -> Column:
    """A version-7 UUID as text: 48 bits of milliseconds, the rest of `random`, 16 bytes (by default new ones a row)."""
    fresh = F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))
    noise = F.lower(F.hex(fresh if random is None else random))
    millis = F.lpad(F.lower(F.hex(F.floor(F.unix_micros(at) / 1000).cast("long"))), 12, "0")
    variant = F.lower(F.hex(F.conv(F.substring(noise, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(millis, 1, 8), F.substring(millis, 9, 4), F.concat(F.lit("7"), F.substring(noise, 14, 3)), F.concat(variant, F.substring(noise, 18, 3)), F.substring(noise, 21, 12)]
    return F.concat_ws("-", *parts)
