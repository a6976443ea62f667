"""Asset names and the shared reproducible numbers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_of(text: Column, digits: int = 8) -> Column:
    """A number of so many hex digits from a string: the same in Python, Spark and plain SQL.

    Eight digits make 32 bits; fifteen are the most that fit a signed 64-bit number.
    """
    return F.conv(F.substring(F.md5(text.cast("string")), 1, digits), 16, 10).cast("bigint")


def number_of_str(text: str) -> int:
    """``number_of`` for a Python string."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def stem(name: Column, sep: str) -> Column:
    """The name up to its last ``sep``; the whole name if it has none."""
    cut = F.length(name) - F.length(F.substring_index(name, sep, -1)) - len(sep)
    return F.when(F.instr(name, sep) > 0, F.substring(name, F.lit(1), cut)).otherwise(name)


def count_of(name: Column, char: str) -> Column:
    """How often ``char`` occurs."""
    return F.length(name) - F.length(F.replace(name, F.lit(char), F.lit("")))
