"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Rows are dealt into blocks of bounded size. Each block holds a forest: per tree a long string of hash bits
(signs of random projections, drawn from a fixed seed and orthogonal within groups) for each row, sorted. A query descends in every
tree to the rows that share the longest prefix with it; then all trees ascend together, one bit at a time,
until the rows found make up ``share`` of the block and at least ``floor``. They are scored by the true cosine and the best ones of
all blocks are merged. Queries are dealt into blocks as well, so that no task holds more than one block of each kind.

Equal vectors are one class: its members all have the same cosine to a query, so its ``k`` + 1 smallest ids are enough to
answer, however many copies there are, and a query vector is searched once for all its copies.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part as query or candidate;
vectors of other lengths than the query's are no candidates; a repeated id counts as one candidate, and as one
query, per distinct vector; a null id takes no part; with fewer than ``k`` candidates all are returned; ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Settings:
    trees: int = 96
    bits: int = 24  # length of a hash string
    share: float = 0.35  # of a block, scored for each query
    floor: int = 512  # rows scored at least, for each query and block
    block_rows: int = 16384
    block_queries: int = 4096
    seed: int = 11


def usable(vector: Column) -> Column:
    """Known, not zero, all components finite."""
    sane = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sane & F.exists(vector, lambda x: x != 0)


def projections(dim: int, cfg: Settings) -> np.ndarray:
    """One column per hash bit of every tree; columns are orthogonal in groups of ``dim``."""
    rng = np.random.default_rng([cfg.seed, dim])
    groups = -(-cfg.trees * cfg.bits // dim)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(groups)])[:, : cfg.trees * cfg.bits]


def hash_strings(unit: np.ndarray, planes: np.ndarray, cfg: Settings) -> np.ndarray:
    """Per row and tree the hash bits, first bit highest, as one number."""
    place = (1 << np.arange(cfg.bits - 1, -1, -1)).astype(np.int64)
    out = np.empty((len(unit), cfg.trees), np.int64)
    for lo in range(0, len(unit), 1024):
        signs = unit[lo : lo + 1024] @ planes > 0
        out[lo : lo + 1024] = signs.reshape(-1, cfg.trees, cfg.bits) @ place
    return out


class Forest:
    """The sorted arrays of one block of rows."""

    def __init__(self, unit: np.ndarray, planes: np.ndarray, cfg: Settings):
        strings = hash_strings(unit, planes, cfg)
        self.cfg, self.n = cfg, len(unit)
        order = np.argsort(strings, axis=0, kind="stable").T
        self.base = np.arange(cfg.trees, dtype=np.int64) << cfg.bits  # the arrays of all trees, one after the other
        self.order = order.ravel()
        self.sorted = (np.take_along_axis(strings.T, order, axis=1) + self.base[:, None]).ravel()

    def candidates(self, strings: np.ndarray, wanted: int) -> np.ndarray:
        """Rows met by one query, of which ``strings`` has the hash string in every tree."""
        for level in range(self.cfg.bits, -1, -1):
            spare = self.cfg.bits - level
            low = ((strings >> spare) << spare) + self.base
            los, his = np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + (1 << spare))
            if (his - los).sum() < wanted and level:
                continue  # even without rows met twice these are too few
            met = np.zeros(self.n, bool)
            met[np.concatenate([self.order[lo:hi] for lo, hi in zip(los, his)])] = True
            if np.count_nonzero(met) >= wanted or not level:
                return np.flatnonzero(met)
        raise AssertionError("level 0 meets every row")


def _search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int, cfg: Settings) -> Iterator[tuple]:
    exact = np.stack(rows["vector"]).astype(np.float64)
    length = np.linalg.norm(exact, axis=1)
    unit = exact / length[:, None]
    planes = projections(exact.shape[1], cfg)
    wanted = min(len(rows), max(cfg.floor, int(np.ceil(cfg.share * len(rows)))))
    asked = np.stack(queries["vector"]).astype(np.float64)
    asked_length = np.linalg.norm(asked, axis=1)
    first = np.array([ids[0] for ids in rows["ids"]], np.int64)
    all_rows = wanted >= len(rows)
    if not all_rows:
        forest = Forest(unit, planes, cfg)
        strings = hash_strings(asked / asked_length[:, None], planes, cfg)
    for i, query in enumerate(queries["vector_key"]):
        found = np.arange(len(rows)) if all_rows else forest.candidates(strings[i], wanted)
        near = unit[found] @ (asked[i] / asked_length[i])
        # Every row that reaches the last place or ties with it, but for rounding, is scored; of equal scores the smallest id comes first.
        place = min(len(found), k + 1) - 1
        found = found[near >= np.partition(near, len(found) - 1 - place)[len(found) - 1 - place] - 1e-9]
        score = (exact[found] * asked[i]).sum(axis=1) / (length[found] * asked_length[i])
        for j in np.lexsort((first[found], -score))[: k + 1]:
            yield query, rows["ids"].iat[found[j]], float(score[j])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, cfg: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``: the ``k`` nearest found of every row of ``queries`` but itself."""
    def plain(df: DataFrame) -> DataFrame:
        df = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
        return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).withColumn("vector_key", F.sha2(F.array_join("vector", " "), 256))

    rows, asked = (plain(df).dropDuplicates(["vector_key", "id"]) for df in (vectors, queries))
    ranked = Window.partitionBy("vector_key").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    classes = few.groupBy("vector_key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    searched = asked.groupBy("vector_key").agg(F.first("vector").alias("vector"))
    row_blocks = max(1, -(-vectors.count() // cfg.block_rows))
    query_blocks = max(1, -(-queries.count() // cfg.block_queries))
    spot = F.conv(F.substr("vector_key", F.lit(1), F.lit(8)), 16, 10).cast("long")
    dim = F.size("vector").alias("dim")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = classes.select(dim, (spot % row_blocks).cast("int").alias("rb"), every(query_blocks).alias("qb"), "vector", "ids")
    right = searched.select(dim, every(row_blocks).alias("rb"), (spot % query_blocks).cast("int").alias("qb"), "vector", "vector_key")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["vector_key", "ids", "score"]
        if rows.empty or asked.empty:
            return pd.DataFrame({n: [] for n in names}).astype({"score": "float64"})
        return pd.DataFrame(list(_search_block(rows, asked, k, cfg)), columns=names)

    keys = ["dim", "rb", "qb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "vector_key string, ids array<long>, score double")
    best = best.select("vector_key", "score", F.explode("ids").alias("id"))
    first = Window.partitionBy("vector_key").orderBy(F.desc("score"), "id")
    best = best.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("vector_key", "score", "id")
    answers = asked.select(F.col("id").alias("query_id"), "vector_key").join(best, "vector_key").where("query_id <> id")
    by_query = Window.partitionBy("query_id", "vector_key").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "id", "score")
