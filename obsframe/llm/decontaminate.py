"""Benchmark decontamination: BM25 over an inverted index of test items, read with block-max WAND.

Every document is cut into overlapping passages of twice the length of the longest test item, so each
stretch as long as an item lies whole in one of them. A passage is a query of its distinct words; the score of an item is its BM25
score as a share of what the item scores against itself, so 1 means that the passage holds all its words. All items
with a share of ``Settings.retrieve`` or more are retrieved, then verified: enough of the question's five-word shingles and of
the answer's words must be in the passage. The answer is what follows the last question mark, else the last
sentence, else the last quarter of the words.

Most passages are passed over by their bound: items are taken in blocks of neighbours, and a passage's bound for
a block is the sum of the largest scores that its words have there. The words of the longest lists count at their
largest in every passage, up to ``Settings.constant`` in all. A passage with a block that reaches the threshold is searched with
block-max WAND over the whole index.

The index is built on the driver from ``Settings.block_items`` test items at a time and broadcast; a larger test set takes
several such indexes. Documents are never shuffled.

Defined results: null or empty texts and items match nothing; equal items match alike; each row of a
repeated id is searched; empty tables give no matches; extra columns stay, one named ``matches`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.features import word_hashes

MATCH = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,passage:bigint>>"


@dataclass(frozen=True)
class Settings:
    retrieve: float = 0.6  # least score, as a share of the item's own
    question: float = 0.8  # least share of the question's shingles
    answer: float = 0.8  # least share of the answer's words
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    neighbours: int = 1  # items in a block of the bound
    constant: float = 0.3  # what words with long lists may add to every bound
    list_block: int = 8  # postings in a block of a list
    block_items: int = 5000  # items in one index


_TOP = 18  # bits of a word's hash that lead to its place
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str) -> bytes:
    """A text lower-cased, with a space for each ASCII character that is no letter or digit."""
    return text.lower().encode().translate(_TO_SPACE)


def word_numbers(text: str) -> np.ndarray:
    """Hashes of the words of a text, lower-cased and without ASCII punctuation."""
    return word_hashes(plain_words(text))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item."""
    if "?" in text.rstrip().rstrip("?"):
        at = text.rstrip().rstrip("?").rindex("?") + 1
        return text[:at], text[at:]
    parts = [p for p in re.split(r"(?<=[.!])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = len(words) - -(-len(words) // 4)
    return " ".join(words[:at]), " ".join(words[at:])


def shingles(words: np.ndarray, n: int) -> set[bytes]:
    if not len(words):
        return set()
    n = min(n, len(words))
    return {words[i : i + n].tobytes() for i in range(len(words) - n + 1)}


class Index:
    """Postings with their scores, the largest score of each list and list block, and the bounds of item blocks."""

    def __init__(self, items: list[tuple[int, str]], cfg: Settings):
        self.cfg = cfg
        items = [(i, t, w) for i, t in items if t and len(w := word_numbers(t))]
        self.ids = [i for i, _, _ in items]
        self.longest = max((len(w) for _, _, w in items), default=0)
        self.parts = []
        for _, text, _ in items:
            question, answer = (word_numbers(part) for part in split_item(text))
            self.parts.append((shingles(question, cfg.shingle), min(cfg.shingle, max(1, len(question))), np.unique(answer)))
        if not items:
            return
        counted = [np.unique(w, return_counts=True) for _, _, w in items]
        self.words, word = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        item = np.repeat(np.arange(len(items)), [len(c[0]) for c in counted])
        tf = np.concatenate([c[1] for c in counted]).astype(float)
        size = np.array([len(w) for _, _, w in items], float)
        df = np.bincount(word)
        idf = np.log1p((len(items) - df + 0.5) / (df + 0.5))
        score = idf[word] * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * size[item] / size.mean()))
        score /= np.bincount(item, score)[item]
        order = np.lexsort((item, word))
        self.item, self.score = item[order], score[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        top = (self.words >> np.uint64(64 - _TOP)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(1 << _TOP)).astype(np.int32)
        self.crowd = int(np.bincount(top).max())
        self.padded = np.concatenate([self.words, np.repeat(self.words[:1], self.crowd)])
        self.list_max = np.maximum.reduceat(self.score, self.start[:-1])
        self._bounds(df, len(items))

    def _bounds(self, df: np.ndarray, n: int) -> None:
        """Per word its blocks and their largest scores, without the words that count as a constant."""
        self.n_blocks = -(-n // self.cfg.neighbours)
        word = np.repeat(np.arange(len(df)), df)
        cells, back = np.unique(word * self.n_blocks + self.item // self.cfg.neighbours, return_inverse=True)
        largest = np.zeros(len(cells))
        np.maximum.at(largest, back, self.score)
        cell_word, cell_block = cells // self.n_blocks, cells % self.n_blocks
        first = np.searchsorted(cell_word, np.arange(len(df) + 1))
        self.rest = np.zeros(self.n_blocks)
        varied = np.ones(len(df), bool)
        for w in np.argsort(-np.diff(first), kind="stable"):
            own = slice(first[w], first[w + 1])
            total = self.rest[cell_block[own]] + largest[own]
            if (total > self.cfg.constant).any():
                break
            self.rest[cell_block[own]] = total
            varied[w] = False
        use = varied[cell_word]
        self.cell_block, self.cell_max = cell_block[use], largest[use]
        self.cell_start = np.searchsorted(cell_word[use], np.arange(len(df) + 1))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the index, -1 for others."""
        at = self.first[(hashes >> np.uint64(64 - _TOP)).astype(np.int32)]
        found = np.full(len(hashes), -1, np.int32)
        for _ in range(self.crowd):  # words with equal top bits stand together
            np.copyto(found, at, where=self.padded[at] == hashes)
            at = at + 1
        return found

    def promising(self, known: np.ndarray) -> np.ndarray:
        """Numbers of the passages whose bound reaches the threshold."""
        halves = -(-len(known) // self.longest)
        at = np.flatnonzero(known >= 0)
        word = known[at]
        n = self.cell_start[word + 1] - self.cell_start[word]
        cell = np.repeat(self.cell_start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        spot = np.repeat(at // self.longest, n) * self.n_blocks + self.cell_block[cell]
        sums = np.bincount(spot, self.cell_max[cell], halves * self.n_blocks).reshape(halves, self.n_blocks)
        if halves > 1:
            sums = sums[:-1] + sums[1:]
        return np.flatnonzero((sums + self.rest >= self.cfg.retrieve - 1e-9).any(axis=1))

    def may_match(self, words: np.ndarray) -> bool:
        """Whether the bound of these distinct words reaches the threshold."""
        n = self.cell_start[words + 1] - self.cell_start[words]
        cell = np.repeat(self.cell_start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.bincount(self.cell_block[cell], self.cell_max[cell], self.n_blocks)
        return bool((sums + self.rest >= self.cfg.retrieve - 1e-9).any())

    def search(self, words: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: every item that scores the threshold or more for these distinct words."""
        need, step = self.cfg.retrieve - 1e-9, self.cfg.list_block
        cursors = [[int(self.item[self.start[w]]), int(self.start[w]), int(self.start[w + 1]), float(self.list_max[w])] for w in words]
        found = []

        def advance(cursor: list, to: int) -> None:
            at = cursor[1] + int(np.searchsorted(self.item[cursor[1] : cursor[2]], to))
            cursor[0], cursor[1] = (int(self.item[at]) if at < cursor[2] else self_end), at

        self_end = len(self.ids)
        while True:
            cursors = sorted((c for c in cursors if c[0] < self_end), key=lambda c: c[0])
            total, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                total += c[3]
                if total >= need:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else self_end
            for c in cursors[: pivot + 1]:  # the blocks in which the lists would hold the pivot
                at = c[1] + int(np.searchsorted(self.item[c[1] : c[2]], item))
                if at < c[2]:
                    end = min(c[2], at - at % step + step)
                    bound += float(self.score[at:end].max())
                    until = min(until, int(self.item[end - 1]) + 1)
            if bound < need:
                for c in cursors[: pivot + 1]:
                    advance(c, max(until, item + 1))
            elif cursors[0][0] == item:
                score = sum(float(self.score[c[1]]) for c in cursors[: pivot + 1])
                if score >= need:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    advance(c, item)

    def matches(self, text: str | None) -> list[dict]:
        """Verified items, each with its best passage."""
        if not text or not self.ids:
            return []
        hashes = word_numbers(text)
        if not len(hashes):
            return []
        known, best = self.known(hashes), {}
        for passage in self.promising(known):
            lo = int(passage) * self.longest
            words = np.unique(known[lo : lo + 2 * self.longest])
            words = words[words >= 0]
            if not self.may_match(words):  # counted once, repeated words fall short
                continue
            window = hashes[lo : lo + 2 * self.longest]
            own: dict[int, set[bytes]] = {}
            for item, score in self.search(words):
                question, n, answer = self.parts[item]
                if n not in own:
                    own[n] = shingles(window, n)
                overlap = len(question & own[n]) / len(question) if question else 1.0
                answered = float(np.isin(answer, window).mean()) if len(answer) else 1.0
                if overlap >= self.cfg.question and answered >= self.cfg.answer:
                    row = {"item_id": self.ids[item], "score": score, "question_overlap": overlap, "answer_overlap": answered, "passage": int(passage)}
                    if item not in best or (overlap, answered, score) > best[item][0]:
                        best[item] = ((overlap, answered, score), row)
        return [best[i][1] for i in sorted(best)]


def _searcher(index: Broadcast):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([index.value.matches(t) for t in texts], dtype=object)

    return F.pandas_udf(search, MATCH)


def find_contamination(
    docs: DataFrame, items: DataFrame, cfg: Settings = Settings(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``matches``: the test items found in each, with scores, overlaps and passage number."""
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = -(-items.count() // cfg.block_items)
    columns = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["id"], r["text"]) for r in own], cfg))
        columns.append(_searcher(index)(F.col(text_col)))
    found = F.concat(*columns) if columns else F.array().cast(MATCH)
    return docs.withColumn("matches", found)
