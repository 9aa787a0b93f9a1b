"""Column helpers: lenient casts, dates, periods, ratios and stable hash order.

All of them are built-in expressions, so they stay inside generated code and never throw
under ANSI mode: a value that cannot be read becomes NULL.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbers(values: Iterable[float], kind: str = "double") -> Column:
    """An array of many numbers as one literal."""
    return F.split(F.lit(" ".join(repr(v) for v in values)), " ").cast(f"array<{kind}>")


def to_double(c: Column | str) -> Column:
    return F.trim(_col(c)).try_cast("double")


def to_int(c: Column | str) -> Column:
    return F.trim(_col(c)).try_cast("int")


def lenient_number(c: Column | str) -> Column:
    """Strip everything but digits, sign and point, then read a number."""
    return F.regexp_replace(_col(c), r"[^0-9.\-]", "").try_cast("double")


def null_if(c: Column | str, sentinel: object) -> Column:
    return F.nullif(_col(c), F.lit(sentinel))


def cut(c: Column | str, first: int, last: int) -> Column:
    """Characters ``first`` to ``last`` (1-based, both included), trimmed."""
    return F.trim(F.substring(_col(c), first, last - first + 1))


def safe_date(year: Column | str, month: Column | str, day: Column | str | int = 1) -> Column:
    day = F.lit(day) if isinstance(day, int) else _col(day)
    text = F.format_string("%04d-%02d-%02d", _col(year).cast("int"), _col(month).cast("int"), day.cast("int"))
    return F.try_to_date(text, "yyyy-MM-dd")


def century_date(yymmdd: Column | str, pivot: int = 69) -> Column:
    """Two-digit years: ``pivot``..99 belong to 19xx, the rest to 20xx."""
    text = _col(yymmdd)
    century = F.when(F.substring(text, 1, 2).try_cast("int") >= pivot, F.lit("19")).otherwise(F.lit("20"))
    return F.try_to_date(F.concat(century, text), "yyyyMMdd")


def in_years(date: Column | str, first: int, last: int) -> Column:
    """Whether a date lies in the given years, as a range that a scan can use to skip data."""
    return _col(date).between(F.lit(datetime.date(first, 1, 1)), F.lit(datetime.date(last, 12, 31)))


def decade(year: Column | str) -> Column:
    return (F.floor(_col(year) / 10) * 10).cast("int")


def period_index(year: Column | str, month: Column | str, start: int) -> Column:
    return ((_col(year) - F.lit(start)) * 12 + _col(month)).cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def percent(a: Column | str, b: Column | str) -> Column:
    return ratio(a, b) * 100


def mid_date(first: Column | str, last: Column | str) -> Column:
    return F.date_from_unix_date(F.floor((F.unix_date(_col(first)) + F.unix_date(_col(last))) / 2).cast("int"))


def hash_key(seed: int, *cols: Column | str) -> Column:
    """A reproducible pseudo-random text key: the same on every engine and every run."""
    return F.md5(F.concat_ws(":", *[_col(c).cast("string") for c in cols], F.lit(str(seed))))


def hash_number(seed: int, *cols: Column | str) -> Column:
    """32 uniform bits taken from ``hash_key``."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint")


def hash_fold(k: int, seed: int, *cols: Column | str) -> Column:
    return F.pmod(hash_number(seed, *cols), F.lit(k)).cast("int")
