"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint of 64 bits is eight bytes, each a token (position, byte). Two fingerprints that differ in
at most three bits share at least five of their eight tokens: that is the guaranteed minimum. The lists of single
tokens would hold 1/256 of all fingerprints each, so the index is kept by four tokens at once. Of the sets of four
positions out of eight, the 14 whose numbers have the exclusive or 0 are enough: any three positions
(all that can differ) lie in one such set, whose complement is another and agrees on all four. Pairs that meet in a list
are tallied over all eight tokens, those that reach the minimum are verified by their differing bits.

Equal fingerprints are one class from the start; links are made between distinct fingerprints only.

Defined results: a text with fewer words than a shingle is one shingle of all its words; a null text or one without
words has the fingerprint zero, linked like any other; rows of a repeated id are linked by their own fingerprints;
a component of rows with null ids only has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.components import components
from obsframe.session import scratch_path

LIST_POSITIONS = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority of the shingles' XXH64, as a signed number."""
    words = text.encode().lower().split() if text else []  # on bytes both know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[i:j], seed) for i, j in cuts]), np.uint8).reshape(-1, 8)
    ones = np.zeros((8, 8), np.int64)
    for place in range(8):
        ones[place] = np.bincount(hashes[:, place], minlength=256) @ _BITS
    bits = 2 * ones.ravel() > len(hashes)
    return int(np.packbits(bits).view(">i8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carried: Sequence[Column] = ()) -> DataFrame:
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(compute, "long")(F.col(text_col)).alias("fp"), *carried)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def list_keys(fp: Column) -> Column:
    """The 14 index lists of a fingerprint, as numbers: which list, then its four bytes."""
    keys = []
    for number, positions in enumerate(LIST_POSITIONS):
        parts = [F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(positions)]
        keys.append(reduce(Column.bitwiseOR, parts, F.lit(number << 32).cast("long")))
    return F.array(*keys)


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints ``fp`` that differ in at most ``max_bits`` (up to 3) bits."""
    index = fps.select("fp", F.explode(list_keys(F.col("fp"))).alias("key"))
    left, right = index.select(F.col("fp").alias("a"), "key"), index.select(F.col("fp").alias("b"), "key")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    shared = reduce(Column.__add__, [(_byte(differing, p) == 0).cast("int") for p in range(8)])
    near = (F.col("a") < F.col("b")) & (shared >= 8 - max_bits) & (F.bit_count(differing) <= max_bits)
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "b")


def link_near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
    carried: Sequence[Column] = (),
) -> DataFrame:
    """``id``, ``fp`` (the fingerprint as a signed number) and ``component`` (its smallest id) of every row.

    With ``carried`` columns of ``docs`` (named unlike these) also those, and ``root``, a fingerprint that names the component.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees links of up to 3 differing bits")
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    with_fingerprints(docs, id_col, text_col, shingle, carried).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    found = rows.join(rooted.join(smallest, "root").select("fp", "component", "root"), "fp")
    return found.select("id", "fp", "component", *(["root", *rows.columns[2:]] if carried else []))
