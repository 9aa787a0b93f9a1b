"""Near-duplicates by an inverted index of MinHash coordinates, confirmed on whole sets of word shingles.

A text's signature has one minimum of its shingle hashes for each of ``coordinates`` orders. Every pair of a coordinate and its
value is a list of the texts that bear it. Two texts of Jaccard similarity s agree in a coordinate with probability s, so a
linked pair collides in at least ``matches`` lists (with 64 coordinates, 38 matches and s = 0.85 but for 1 in 10 000 000).

A value that only one text bears can match nothing, and a text with fewer than ``matches`` shared values has no partner. For
the others the lists are merged by prefix and skip: a text's values are put in one order for all texts, rarest first; since
at most ``held - matches`` of its values may miss, any partner meets it in one of the first ``held - matches + 1`` lists of both. Only
these lists are merged; the long ones are skipped and looked up for the pairs that met. Pairs with enough collisions are
confirmed on their whole sets.

Equal sets are one class from the start. Only components are wanted, so a large group does not form all its pairs as rows. A text is first
compared with the smallest of its lists' first texts. Of the lists that then hold texts of several components, the short ones form
their pairs, whose number is bounded by that of their entries. Texts that share long ones are dealt into blocks of bounded size, a
task compares two blocks, and gives back only links that join components. A pair that is not compared lies in one component already.

Defined results: words are parted by ASCII white space and lower-cased in ASCII; a text with fewer words than a shingle is one
shingle of all its words; a null text or one without words has an empty set, a component of its own and is kept; every row of a
repeated id is linked by its own text, and has the smallest id of all its component's rows; a component of rows with null ids only has a null
id, and such rows are kept; shingles are told by 64-bit hashes; an empty table gives no rows. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.components import components
from obsframe.session import scratch_path


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    percent: int = 85
    coordinates: int = 64
    matches: int = 38
    short: int = 16  # texts of a list that forms its pairs
    block_texts: int = 512
    block_shingles: int = 200_000


class _WordHashes(dict):
    """XXH64 of a word, remembered."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.encode().lower().split() if text else []  # on bytes both know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total = (total ^ (total >> np.uint64(29))) * _ODD + hashes[j : j + n]
    for _ in range(2):
        total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique(total ^ (total >> np.uint64(32)))


def _orders(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factors, shifts = rng.integers(0, 1 << 64, (2, coordinates), np.uint64, endpoint=False) if coordinates else (None, None)
    return factors | np.uint64(1), shifts


def signature(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for each coordinate and its least value: the coordinate in the low bits, so that lists are told apart."""
    factors, shifts = orders
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * factors + shifts).min(axis=0), out=least)
    bits = np.uint64(max(1, int(len(factors) - 1).bit_length()))
    return (((least >> bits) << bits) | np.arange(len(factors), dtype=np.uint64)).view(np.int64)


def _described(cfg: Settings):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(cfg.coordinates)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(t.as_py(), cfg.shingle) for t in part.column("text")]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                tokens = [signature(s, orders) if len(s) else np.empty(0, np.int64) for s in sets]

                def lists(arrays: list[np.ndarray]) -> pa.ListArray:
                    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))

                columns = [part.column("id"), pa.array(nodes), pa.array(sizes), lists(tokens), lists(sets)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "tokens", "hashes"])

    return describe


def _block_links(cfg: Settings):
    """Links between the texts of two blocks, or of one, as few as join all the components that links join."""

    def compare(table: pa.Table) -> pa.Table:
        # In one order, so that a lost task gives the same links again.
        table = table.sort_by("node")
        node, root, n, block = (table[c].to_numpy() for c in ("node", "root", "n", "block"))
        rows = len(node)
        sets, held = (table[c].combine_chunks() for c in ("set", "tokens"))
        owner = np.repeat(np.arange(rows), np.diff(held.offsets.to_numpy()))
        tokens = held.flatten().to_numpy()
        mask = (1 << max(1, int(cfg.coordinates - 1).bit_length())) - 1
        coordinates = np.full((rows, cfg.coordinates), -1, np.int64)
        known = np.zeros((rows, cfg.coordinates), bool)
        coordinates[owner, tokens & mask], known[owner, tokens & mask] = tokens, True

        owner = np.repeat(np.arange(rows), np.diff(sets.offsets.to_numpy()))
        shared, place, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        again = times[place] > 1
        owner, place = owner[again], number[place[again]]
        bits = np.zeros((rows, max(1, int(number[-1] + 8) // 8)), np.uint8)
        np.bitwise_or.at(bits, (owner, place >> 3), (1 << (place & 7)).astype(np.uint8))

        parent = {int(r): int(r) for r in root}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        low = table["lo"][0].as_py()
        alone = low == table["hi"][0].as_py()
        left = np.flatnonzero(block == low)
        right = left if alone else np.flatnonzero(block != low)
        links, step = [], max(1, (16 << 20) // bits.shape[1])
        for i in left.tolist():
            others = right[right > i] if alone else right
            others = others[(root[others] != root[i]) & (np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * cfg.percent)]
            others = others[((coordinates[others] == coordinates[i]) & known[others] & known[i]).sum(axis=1) >= cfg.matches]
            for start in range(0, len(others), step):
                some = others[start : start + step]
                both = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
                for j in some[both * 100 >= (n[some] + n[i] - both) * cfg.percent].tolist():
                    a, b = find(int(root[i])), find(int(root[j]))
                    if a != b:
                        parent[a] = b
                        links.append((int(node[i]), int(node[j])))
        ends = [pa.array([pair[k] for pair in links], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays(ends, ["a", "b"])

    return compare


def link_similar(docs: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (size of the set) and ``component`` (its smallest id) of every row."""
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = kept(texts.mapInArrow(_described(cfg), "id long, node long, n long, tokens array<long>, hashes array<long>"), "signatures")
    classes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    index = kept(classes.select("node", "n", F.explode("tokens").alias("key")), "coordinates")
    shared = kept(index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    held = F.sort_array(F.collect_list(F.struct("size", "key")))
    nodes = index.join(shared, "key").groupBy("node", "n").agg(held.alias("held")).where(F.size("held") >= cfg.matches)
    nodes = kept(nodes.select("node", "n", "held.key"), "nodes")
    prefix = F.slice("key", F.lit(1), F.size("key") - (cfg.matches - 1))
    posts = kept(nodes.select(F.explode(prefix).alias("key"), "node", "n"), "posts")

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * cfg.percent

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        """``node``, ``n`` and ``set`` of the nodes that are wanted."""
        ends = kept(wanted.select("node").distinct(), f"ends-{name}")
        sets = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("set"))
        return kept(sets, f"sets-{name}")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs ``a``, ``b`` that collide often enough and whose sets are similar enough."""
        for side, other in (("a", "b"), ("b", "a")):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("key").alias(f"key_{side}")), side)
        met = kept(pairs.where(F.size(F.array_intersect("key_a", "key_b")) >= cfg.matches).select("a", "b"), f"met-{name}")
        sets = sets_of(met.select(F.col("a").alias("node")).unionAll(met.select("b")), name)
        for side in ("a", "b"):
            met = met.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("set").alias(f"set_{side}")), side)
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        linked = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * cfg.percent
        return kept(met.where(linked).select("a", "b"), f"near-{name}")

    firsts = posts.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("size"))
    firsts = kept(firsts.where("size > 1").drop("size"), "firsts")
    star = posts.join(firsts, "key").where((F.col("node") > F.col("first.node")) & fits(F.col("n"), F.col("first.n")))
    star = kept(star.groupBy("node").agg(F.min("first.node").alias("a")).select("a", F.col("node").alias("b")), "star")
    near = confirmed(star, "star")

    rooted = posts.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = kept(rooted, "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    several = kept(several.where("lo < hi").drop("lo", "hi"), "open")
    left = kept(rooted.join(several, "key"), "left")

    few = left.where(F.col("size") <= cfg.short)
    right = few.select("key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root"))
    apart = (F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & fits(F.col("n"), F.col("other_n"))
    pairs = few.join(right, "key").where(apart).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    pairs = kept(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    near = near.unionAll(confirmed(pairs, "pairs"))

    many = left.where(F.col("size") > cfg.short)
    groups = kept(components(many.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), "groups")
    members = kept(groups.withColumnRenamed("root", "group").join(many.select("node", "n", "root").distinct(), "node"), "members")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / cfg.block_texts), F.ceil(F.col("shingles") / cfg.block_shingles)).cast("int")
    sizes = kept(sizes.select("group", blocks.alias("blocks")), "sizes")
    placed = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root")
    placed = placed.join(nodes.withColumnRenamed("key", "tokens"), "node").join(sets_of(members, "blocks").drop("n"), "node")
    near = near.unionAll(kept(placed.groupBy("group", "lo", "hi").applyInArrow(_block_links(cfg), "a long, b long"), "near-blocks"))
    roots = components(near)

    firsts = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    rooted = kept(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    rooted = kept(rooted.join(smallest, "root").select("node", "component"), "components")
    found = rows.where("n > 0").select("id", "node", "n").join(rooted, "node").select("id", "n", "component")
    return found.unionAll(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
