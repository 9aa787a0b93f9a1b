"""Substring dedup by seed and extend.

A repeat is a stretch of at least ``length`` words found before (in a smaller id, or earlier in the same document).
Seeds are winnowed anchors: of every ``length`` consecutive words one short word k-gram is chosen, the one with
the smallest hash, so equal stretches choose equal anchors at the same place. Documents are joined on anchors:
only those found at least twice can lie in a repeat. Each such seed is extended both ways,
j words to the left and the rest to the right for every j at which the stretch chooses this seed; stretches with equal
seed and equal extension are the same words, and all but the first of them are repeats. Overlapping
repeats of a document merge into maximal ones, which are cut out.

A text that is equal to one with a smaller id is a repeat as a whole (if long enough), so only the first of equal texts takes
part in the join, and groups of copies never meet. Seeds and stretches are counted by aggregates that combine before
they shuffle; no pair of documents is ever formed.

Defined results: a null text has no words; a text with fewer words than ``length`` keeps them all; a null id counts as the
smallest; rows of one id are taken in the order of their text's hash, and rows equal in id and text are one document (each row
gets its result); an empty table gives no rows; extra columns stay, those named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    length: int = 20  # words of the shortest repeat
    seed_words: int = 6  # words of an anchor


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # on bytes: the six ASCII spaces only


def _powers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    m = len(hashes) - n + 1
    total = np.zeros(max(m, 0), np.uint64)
    for j, p in enumerate(_powers(n, seed)):
        total += hashes[j : j + len(total)] * p
    return _scramble(total)


def stretches(words: list[bytes], cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch of ``length`` words: the hash of its anchor and the place of the anchor."""
    return _stretches(_word_hashes(words), cfg)


def _stretches(hashes: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) < cfg.length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = _runs(hashes, cfg.seed_words, 1)
    room = cfg.length - cfg.seed_words + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, room).argmin(axis=1) + np.arange(len(hashes) - cfg.length + 1)
    return grams[at], at


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def _anchors(batches: Iterator[pd.DataFrame], cfg: Settings) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch["text"]:
            hashes, at = stretches(_words(text), cfg)
            found.append(hashes[np.unique(at, return_index=True)[1]].view(np.int64))
        counts = [len(f) for f in found]
        yield pd.DataFrame({
            "seed": np.concatenate(found), "k": np.repeat(batch["k"].to_numpy(), counts),
            "version": np.repeat(batch["version"].to_numpy(), counts),
        })


def _found(hashes: np.ndarray, seeds: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Starts and seeds of the stretches whose seed is among those given."""
    own = _stretches(hashes, cfg)[0].view(np.int64)
    starts = np.flatnonzero(np.isin(own, np.asarray(seeds, np.int64)))
    return starts, own[starts]


def _extended(text: str, seeds: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, seeds and extensions of the stretches whose seed is among those given."""
    hashes = _word_hashes(_words(text))  # taken once, for the seeds and for the extensions
    starts, own = _found(hashes, seeds, cfg)
    if not len(starts):
        return starts, own, own
    return starts, own, _runs(hashes, cfg.length, 2)[starts].view(np.int64)


def _extend(batches: Iterator[pd.DataFrame], cfg: Settings) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [_extended(t, s, cfg) for t, s in zip(batch["text"], batch["seeds"])]
        counts = [len(f[0]) for f in found]
        if sum(counts):
            yield pd.DataFrame({
                "seed": np.concatenate([f[1] for f in found]), "stretch": np.concatenate([f[2] for f in found]),
                "k": np.repeat(batch["k"].to_numpy(), counts), "version": np.repeat(batch["version"].to_numpy(), counts),
                "start": np.concatenate([f[0] for f in found]),
            })


def _cut(batches: Iterator[pd.DataFrame], cfg: Settings, held: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, copy, seeds, firsts in zip(batch["text"], batch["copy"], batch["seeds"], batch["firsts"]):
            words = _words(text)
            gone = np.zeros(len(words), bool)
            if copy:
                gone[:] = len(words) >= cfg.length
            elif seeds is not None:
                starts = _found(_word_hashes(words), seeds, cfg)[0]
                again = np.setdiff1d(starts, np.asarray([] if firsts is None else firsts, np.int64), assume_unique=True)
                edges = np.zeros(len(words) + 1, np.int64)
                edges[again] += 1
                edges[again + cfg.length] -= 1
                gone = np.cumsum(edges)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            left = words if not n_removed[-1] else [w for w, g in zip(words, gone.tolist()) if not g]
            kept.append(b" ".join(left).decode())
        yield batch[held].assign(kept=kept, n_words=n_words, n_removed=n_removed)


def remove_repeats(docs: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words that are left (joined by spaces), ``n_words`` (before) and ``n_removed``."""
    text = F.col(text_col)
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    held = {f"_{n}": c for n, c in enumerate(others)}  # names that cannot clash
    # Every reader takes all columns, so that the texts are shuffled by document once for all.
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("version"),
        text.alias("text"), *[F.col(f"`{c}`").alias(h) for h, c in held.items()],
    )
    names = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("version"),
        F.xxhash64(F.lit("second"), text).alias("other"),
    )
    equal = names.groupBy("version", "other").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    copies = names.join(equal, ["version", "other"]).where("k > first").select("k", "version").distinct().withColumn("copy", F.lit(True))
    base = source.join(copies, ["k", "version"], "left")

    unique = base.where("copy is null")
    seeds = unique.mapInPandas(lambda b: _anchors(b, cfg), "seed long, k long, version long")
    twice = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    shared = seeds.join(twice, "seed", "left_semi").groupBy("k", "version").agg(F.collect_set("seed").alias("seeds"))
    extended = unique.join(shared, ["k", "version"]).mapInPandas(
        lambda b: _extend(b, cfg), "seed long, stretch long, k long, version long, start long"
    )
    first = extended.groupBy("seed", "stretch").agg(F.min(F.struct("k", "version", "start")).alias("at")).select("at.*")
    firsts = first.groupBy("k", "version").agg(F.collect_set("start").alias("firsts"))
    joined = base.join(shared, ["k", "version"], "left").join(firsts, ["k", "version"], "left")
    kinds = "".join(f"{h} {joined.schema[h].dataType.simpleString()}, " for h in held)
    out = joined.mapInPandas(lambda b: _cut(b, cfg, list(held)), f"{kinds}kept string, n_words long, n_removed long")
    return out.select(*[F.col(h).alias(c) for h, c in held.items()], F.col("kept").alias(text_col), "n_words", "n_removed")
