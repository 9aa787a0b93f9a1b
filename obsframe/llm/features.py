"""Hashed features of whole texts, and the bounded labelled sample that small models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPOTS = 32  # the place of a byte in its word counts modulo this power of two
_MIX = np.random.default_rng(20260101).integers(1, 1 << 63, (_SPOTS, 256), dtype=np.uint64).ravel()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes between spaces, in order."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    inside = b != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.arange(len(b), dtype=np.int32)
    spot = (at - np.maximum.accumulate(at * first)) & (_SPOTS - 1)
    values = _MIX[(spot << 8) | b]
    values[~inside] = 0
    return np.add.reduceat(values, starts)


def gram_codes(data: bytes, n: int) -> np.ndarray:
    """The byte n-grams (n up to 4) with no space but at their ends, as numbers."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < n:
        return np.empty(0, np.uint32)
    m = len(b) - n + 1
    code, fits = b[:m].astype(np.uint32), np.ones(m, bool)
    for j in range(1, n):
        code |= b[j : j + m].astype(np.uint32) << np.uint32(8 * j)
        if j < n - 1:
            fits &= b[j : j + m] != 32
    return code[fits]


def spread(codes: np.ndarray, bits: int) -> np.ndarray:
    """Numbers to buckets 0 .. 2**bits - 1, by multiplication."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def fold(id_col: Column) -> Column:
    """0 to 4, from the CRC-32 of an id as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(id_col: Column) -> Column:
    return fold(id_col) == 0


def one_label_per_id(labels: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """Ids whose every named label is known and the same in all their rows."""
    both = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
    agreed = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*both)
    for n in names:
        agreed = agreed.where(F.col(f"{n}_lo") == F.col(f"{n}_hi"))
    return agreed.select("id", *[F.col(f"{n}_lo").cast("double").alias(n) for n in names])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, names: Sequence[str], rows_of: Callable[[str], np.ndarray],
    limit: int, id_col: str = "doc_id", text_col: str = "text", counted: bool = True,
) -> pd.DataFrame:
    """At most ``limit`` labelled documents outside the held-out fold: labels, distinct feature rows and (``counted``) counts.

    The ids come first in the order of a hash, so the choice is the same on every run. Only
    the hashed features of the sample reach the driver.
    """
    chosen = (
        one_label_per_id(labels, id_col, names).where(~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id").limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("id", *names, "text")
    kinds = ", ".join(f"{n} double" for n in names)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [np.unique(rows_of(t), return_counts=True) for t in batch.pop("text")]
            batch = batch.assign(rows=[r.astype(np.int32) for r, _ in bags])
            yield batch.assign(counts=[c.astype(np.int32) for _, c in bags]) if counted else batch

    sample = joined.mapInPandas(count, f"id long, {kinds}, rows array<int>" + ", counts array<int>" * counted).toPandas()
    return sample.sort_values("id", ignore_index=True, kind="stable").drop_duplicates("id", ignore_index=True)
