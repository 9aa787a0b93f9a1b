"""Ranked lexical search by MaxScore whose bounds know pairs of terms.

Documents are read once into a forward index of the terms that the searched items hold, with counts over all documents. The index proper
is made of segments, one row for a bounded run of documents: for each term its documents, impacts (what one occurrence in
an item adds to a score) and their maximum; for each pair of terms that are neighbours in an item's order of weights the
documents that hold both and the greatest joint impact of these.

The terms of an item are ordered by weight. The score of a document that holds none but the first ``s`` of them is at most ``bound[s]``,
put together from pairs and single terms: ``bound[s]`` is the lesser of ``bound[s-1]`` plus the maximum of term ``s`` and
``bound[s-2]`` plus what terms ``s-1`` and ``s`` can bring together, which is their joint maximum, or the greater single
maximum where no document holds both. Terms that cannot reach the threshold together only complete documents found by other
terms; a document is given up as soon as its score so far and the bound of the rest stay below the threshold, and a
document outside a pair's list is held to the greater of its two maxima before its postings are looked up. A segment whose whole
bound is below the threshold is not searched. The threshold starts at the last place of the answer from the segment with
the greatest bound, and rises while a task goes through its segments. All scores are whole numbers, so nothing is lost by rounding.

Defined results: every row of ``items`` is a query of its own, also with a repeated or null id; every row of ``docs`` is a document; null
texts and texts without terms are no documents and find nothing; equal scores are ranked by document id, nulls
last; an empty table gives no rows. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.session import scratch_path

_SEPARATE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()  # on bytes lower() knows ASCII only
_LAST = np.iinfo(np.int64).max
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """``saturation`` and ``slope`` are the numbers of the scoring rule in hundredths: 12 is k1 = 1.2, 25 is b = 0.25."""

    k: int = 20
    saturation: int = 12
    slope: int = 25
    segment_docs: int = 1024
    segment_postings: int = 200_000
    block_bytes: int = 4 << 20  # of items' text in one pass over the documents


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other characters beyond ASCII, A to Z lower-cased."""
    return text.encode().translate(_SEPARATE).split() if text else []


@dataclass(frozen=True)
class Queries:
    """One block of items over a vocabulary of numbered terms, and the pairs of terms that they need bounds for."""

    weights: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # terms by ascending weight, times each occurs, number of the pair with the one before
    pairs: np.ndarray  # term, times, term, times

    @staticmethod
    def of(bags: list[Counter], vocabulary: dict[bytes, int], weights: np.ndarray) -> Queries:
        numbers: dict[tuple[int, int, int, int], int] = {}
        items = []
        for bag in bags:
            known = [(int(weights[vocabulary[t]]) * n, vocabulary[t], n) for t, n in bag.items()]
            order = [(t, n) for w, t, n in sorted(known) if w > 0]
            chain = [numbers.setdefault(a + b, len(numbers)) for a, b in zip(order, order[1:])]
            terms, times = (np.array([x[i] for x in order], np.int64) for i in (0, 1))
            items.append((terms, times, np.array([-1] * (len(order) > 0) + chain, np.int64)))
        return Queries(weights, items, np.array(list(numbers), np.int64).reshape(-1, 4))


def bounds_of(most: list[int], joint: list[int]) -> tuple[list[int], list[bool]]:
    """``bound`` of the first 0, 1, ... terms, and whether the last of them is taken in one pair with the term before."""
    bound, paired = [0], [False]
    for i, single in enumerate(most):
        alone = bound[i] + single
        together = bound[i - 1] + joint[i] if i else alone
        bound.append(min(alone, together))
        paired.append(together < alone)
    return bound, paired


class Segment:
    """The postings, impacts, maxima and pair lists of a run of documents."""

    # Kept as bytes of these types; ``parts`` of the impacts are what they are without the weight of their term, which keeps them small.
    PARTS = {
        "terms": "<i4", "starts": "<i4", "docs": "<i2", "parts": "<i4", "maxima": "<i8", "pair_starts": "<i4", "pair_docs": "<i2", "joint": "<i8",
    }

    def __init__(self, size: int, weights: np.ndarray, parts: dict[str, np.ndarray]):
        self.size = size
        for name in self.PARTS:
            setattr(self, name, parts[name])
        self.impacts = self.parts * np.repeat(weights[self.terms], np.diff(self.starts))
        self.looked = self.skipped = 0

    @staticmethod
    def build(queries: Queries, lengths: np.ndarray, held: list[np.ndarray], counts: list[np.ndarray], n: int, total: int, cfg: Settings) -> Segment:
        """``held`` and ``counts``: the terms of each document and how often; ``n`` documents have ``total`` terms."""
        doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
        term, tf = np.concatenate(held).astype(np.int64), np.concatenate(counts).astype(np.int64)
        m = np.array([100 - cfg.slope + cfg.slope * length * n // total for length in lengths.tolist()], np.int64)
        part = SCALE * tf // (1000 * tf + cfg.saturation * m[doc])
        order = np.argsort(term, kind="stable")
        term, doc, part = term[order], doc[order], part[order]
        terms, starts = np.unique(term, return_index=True)
        parts = {"terms": terms, "starts": np.append(starts, len(term)), "docs": doc, "parts": part}
        parts["maxima"] = np.maximum.reduceat(part, starts) * queries.weights[terms]
        segment = Segment(len(held), queries.weights, parts | dict.fromkeys(("pair_starts", "pair_docs", "joint")))
        slots = segment.slots(len(queries.weights))
        both, joint, scratch = [], [], np.zeros(len(held), np.int64)
        for a, times_a, b, times_b in queries.pairs.tolist():
            docs_a, impacts_a = segment.postings(slots[a])
            docs_b, impacts_b = segment.postings(slots[b])
            scratch[docs_b] = impacts_b
            shared = scratch[docs_a] > 0
            both.append(docs_a[shared])
            joint.append(int((times_a * impacts_a[shared] + times_b * scratch[docs_a[shared]]).max()) if shared.any() else 0)
            scratch[docs_b] = 0
        segment.pair_docs = np.concatenate(both) if both else np.empty(0, np.int64)
        segment.pair_starts = np.concatenate([[0], np.cumsum([len(x) for x in both], dtype=np.int64)])
        segment.joint = np.array(joint, np.int64)
        return segment

    def slots(self, vocabulary: int) -> np.ndarray:
        out = np.full(vocabulary, -1, np.int64)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def postings(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        if slot < 0:
            return self.docs[:0], self.impacts[:0]
        cut = slice(self.starts[slot], self.starts[slot + 1])
        return self.docs[cut], self.impacts[cut]

    def limits(self, item: tuple, slots: np.ndarray) -> tuple[list[int], list[int]]:
        """The greatest impact of each term of an item, and of each with the one before it in one document."""
        terms, times, pairs = item
        slot = slots[terms]
        most = np.where(slot >= 0, times * self.maxima[slot], 0) if len(self.maxima) else np.zeros(len(terms), np.int64)
        joint = most.copy()
        if len(most) > 1:
            joint[1:] = np.maximum(self.joint[pairs[1:]], np.maximum(most[1:], most[:-1]))
        return most.tolist(), joint.tolist()

    def search(self, item: tuple, slots: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all documents that score ``threshold`` (1 at least) or more, maybe of some below."""
        terms, times, pairs = item
        most, joint = self.limits(item, slots)
        bound, paired = bounds_of(most, joint)
        first = max(s for s in range(len(bound)) if bound[s] < threshold)
        score = np.zeros(self.size, np.int64)
        for i in range(first, len(terms)):
            docs, impacts = self.postings(slots[terms[i]])
            score[docs] += times[i] * impacts
            self.looked += len(docs)
        found = np.flatnonzero((score > 0) & (score + bound[first] >= threshold))
        while first and len(found):
            rest = first - 1 - paired[first]
            if paired[first]:
                number = pairs[first - 1]
                inside = np.zeros(self.size, bool)
                inside[self.pair_docs[self.pair_starts[number] : self.pair_starts[number + 1]]] = True
                reach = np.where(inside[found], joint[first - 1], max(most[rest : first]))
                found = found[score[found] + reach + bound[rest] >= threshold]
            for i in range(rest, first):
                docs, impacts = self.postings(slots[terms[i]])
                if len(docs) and len(found):
                    spot = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    score[found] += np.where(docs[spot] == found, times[i] * impacts[spot], 0)
                    self.looked += min(len(found), len(docs))
                    self.skipped += max(len(docs) - len(found), 0)
                else:
                    self.skipped += len(docs)
            first = rest
            found = found[score[found] + bound[first] >= threshold]
        self.skipped += sum(len(self.postings(slots[t])[0]) for t in terms[:first])
        return found, score[found]


class Best:
    """The ``k`` best documents of one item so far and the score that a further one has to reach."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(1, threshold)
        self.ids, self.known, self.scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        ids, known, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.known, known), (self.scores, scores)))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.ids, self.known, self.scores = ids[order], known[order], scores[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def _forward(vocabulary: dict[bytes, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                held = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                lengths.append(len(words))
                terms += [t for t, _ in held]
                counts += [c for _, c in held]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return read


_SEGMENT = T.StructType(
    [T.StructField("segment", T.LongType()), T.StructField("bounds", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType()))]
    + [T.StructField(p, T.BinaryType()) for p in Segment.PARTS]
)


def _segments(queries, n: int, total: int, cfg: Settings):
    """Rows of the forward index become rows that hold a segment each."""
    def row(number: int, ids: list, lengths: list, held: list, counts: list) -> pa.RecordBatch:
        segment = Segment.build(queries.value, np.array(lengths, np.int64), held, counts, n, total, cfg)
        slots = segment.slots(len(queries.value.weights))
        bounds = [bounds_of(*segment.limits(item, slots))[0][-1] for item in queries.value.items]
        arrays = [pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64())]
        arrays += [pa.array([values], pa.list_(pa.int64())) for values in (bounds, ids)]
        arrays += [pa.array([getattr(segment, p).astype(kind).tobytes()], pa.binary()) for p, kind in Segment.PARTS.items()]
        return pa.RecordBatch.from_arrays(arrays, _SEGMENT.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, postings, docs = 0, 0, []
        for batch in batches:
            ids, lengths = batch.column("id").to_pylist(), batch.column("n").to_pylist()
            terms, counts = (batch.column(c) for c in ("terms", "counts"))
            for i in range(batch.num_rows):
                held = terms[i].values.to_numpy()
                docs.append((ids[i], lengths[i], held, counts[i].values.to_numpy()))
                postings += len(held)
                if len(docs) >= cfg.segment_docs or postings >= cfg.segment_postings:
                    yield row(number, *map(list, zip(*docs)))
                    number, postings, docs = number + 1, 0, []
        if docs:
            yield row(number, *map(list, zip(*docs)))

    return build


def _searched(queries, thresholds: list[int], cfg: Settings):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = queries.value.items
        best = [Best(cfg.k, t) for t in thresholds]
        for batch in batches:
            for i in range(batch.num_rows):
                bounds = batch.column("bounds")[i].values.to_numpy()
                wanted = [j for j in np.flatnonzero(bounds).tolist() if bounds[j] >= best[j].threshold]
                if not wanted:
                    continue
                ids = batch.column("ids")[i].values
                known, ids = ~ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(_LAST).to_numpy()
                parts = {p: np.frombuffer(batch.column(p)[i].as_buffer(), kind) for p, kind in Segment.PARTS.items()}
                segment = Segment(len(ids), queries.value.weights, parts)
                slots = segment.slots(len(queries.value.weights))
                for j in wanted:
                    found, scores = segment.search(items[j], slots, best[j].threshold)
                    if len(found):
                        best[j].add(ids[found], known[found], scores)
        for j, b in enumerate(best):
            if len(b.ids):
                ids = pa.array(b.ids, pa.int64(), mask=~b.known)
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(ids), pa.int32()), ids, pa.array(b.scores)], ["item", "id", "score"])

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: list, id_type: T.DataType, cfg: Settings) -> DataFrame:
    """The answers of the items ``rows`` (id and text), which are few enough for every task."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    bags = [Counter(terms_of(text)) for _, text in rows]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    answers = T.StructType([T.StructField("item_id", id_type), *T.StructType.fromDDL("rank int, id long, score long").fields])

    path = scratch_path(spark, "forward")
    docs.mapInArrow(_forward(vocabulary), "id long, n long, terms array<int>, counts array<int>").write.parquet(path)
    forward = spark.read.parquet(path).where("n > 0")
    n, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    if not held:
        return spark.createDataFrame([], answers)
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held:
        weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    queries = context.broadcast(Queries.of(bags, vocabulary, weights))

    path = scratch_path(spark, "segments")
    some = forward.where(F.size("terms") > 0)
    some.mapInArrow(_segments(queries, n, total, cfg), _SEGMENT).write.parquet(path)
    segments = spark.read.parquet(path)
    highest = segments.select("segment", F.posexplode("bounds").alias("item", "bound")).groupBy("item").agg(F.max_by("segment", F.struct("bound", "segment")).alias("segment"))
    # One segment an item at most, so the list is bounded by the block of items; as a filter it reaches the scan.
    first = segments.where(F.col("segment").isin(sorted({r["segment"] for r in highest.collect()})))
    kind = "item int, id long, score long"
    seeds = _top(first.mapInArrow(_searched(queries, [1] * len(rows), cfg), kind), cfg.k).where(F.col("rank") == cfg.k)
    thresholds = [1] * len(rows)
    for r in seeds.collect():
        thresholds[r["item"]] = r["score"]
    found = _top(segments.mapInArrow(_searched(queries, thresholds, cfg), kind), cfg.k)
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)])
    named = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(rows)], names)
    return found.join(named, "item").select(*answers.names)


def rank_documents(
    docs: DataFrame, items: DataFrame, cfg: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``id`` and ``score`` of the ``k`` best documents of every row of ``items`` that score above 0.

    A set of items larger than ``block_bytes`` takes several passes; the counts that scores depend on are over all documents in each.
    """
    if not 0 < cfg.segment_docs < 1 << 15:
        raise ValueError("a segment holds up to 32767 documents")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / cfg.block_bytes))
    out = None
    for block in range(blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()]
        part = _search_block(docs, rows, asked.schema["id"].dataType, cfg)
        out = part if out is None else out.unionAll(part)
    return out
