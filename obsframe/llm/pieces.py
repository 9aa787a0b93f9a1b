"""SentencePiece encoding and decoding with the tokenizers library as the backend.

``read_model`` parses the model's protobuf (pieces with scores and kinds, trainer and normaliser settings). ``backend`` rebuilds
the tokenizer from it: the normaliser (its compiled character map, if any, and white space rules), the
metaspace marker, byte fallback, and the scores: a unigram model takes them as they are, a BPE model takes the merges
in the order of the scores.

Encoding works on units: no piece holds a marker after another character (checked at load), so no piece crosses
the border before a run of markers, and encoding unit by unit gives exactly the whole text's encoding. Units not
met before by a worker go to ``encode_batch`` together, on several threads; known ones are looked up. Models for which the border does not hold
are encoded as whole texts.

Parity is verified for every unit a worker meets: the SentencePiece library must give the same ids, and decoding them must give the unit
back. ``parity`` and ``round_trip`` of a text say that this held for all its units.

Defined results: a null text has null ids and counts, an empty text has none; repeated rows are encoded each; an empty table
gives no rows; extra columns stay, those named as the outputs are replaced.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

MARK = "▁"
CHUNK = 1 << 19
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Model(
        pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
        bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)),
    )


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two, best piece first."""
    number = {text: n for n, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = []
    for text, n in number.items():
        splits = [(text[:i], text[i:]) for i in range(1, len(text))]
        ranked += [(-model.pieces[n][1], number[a], number[b], a, b) for a, b in splits if a in number and b in number]
    return [(a, b) for *_, a, b in sorted(ranked, key=lambda m: m[:3])]


def unit_borders_hold(model: Model) -> bool:
    """Whether no piece has a marker after another character, and a marker alone is a piece."""
    texts = {t for t, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    return model.escape_spaces and model.dummy_prefix and MARK in texts and not any(re.search(f"[^{MARK}]{MARK}", t) for t in texts)


def backend(model: Model):
    """The tokenizer, rebuilt for the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((t for t, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        at = next((n for n, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
        core = models.Unigram([(t, s) for t, s, _ in model.pieces], at, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {t: n for n, (t, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    tokenizer.add_tokens([AddedToken(t, normalized=False) for t, _, kind in model.pieces if kind == USER_DEFINED])
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class Units(dict):
    """Numbers of the units met, with their ids one after the other and whether both checks held."""

    ROOM = 600_000  # units kept; when full, those met only once since the last time are forgotten

    def __init__(self, data: bytes, threads: int):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        self.model = read_model(data)
        self.tokenizer = backend(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        plain = not self.model.charsmap and not self.model.trim_spaces
        self.texts = [t for t, _, _ in self.model.pieces]
        self.lone = self.tokenizer.token_to_id(MARK)
        self.split = plain and unit_borders_hold(self.model)
        self._clear(self.ROOM)

    def _clear(self, room: int) -> None:
        self.clear()
        self.ids, self.used = np.empty(1 << 20, np.int32), 0
        self.at, self.size, self.met = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.same, self.back = np.zeros(room, bool), np.zeros(room, bool)

    def _add(self, units: list[str], flat: np.ndarray, size: np.ndarray, same: np.ndarray, back: np.ndarray) -> None:
        lo, hi = len(self), len(self) + len(units)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(flat)), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[lo:hi] = self.used + np.cumsum(size) - size
        self.size[lo:hi], self.same[lo:hi], self.back[lo:hi] = size, same, back
        self.used += len(flat)
        self.update(zip(units, range(lo, hi)))

    def _make_room(self, wanted: int) -> None:
        often = [u for u, k in self.items() if self.met[k] > 1]
        if len(often) + wanted > self.ROOM:
            often = []
        k = np.fromiter(map(self.__getitem__, often), np.int64, len(often))
        kept = self._flat(k), self.size[k], self.same[k], self.back[k]
        self._clear(max(self.ROOM, wanted))
        self._add(often, *kept)

    def _flat(self, known: np.ndarray) -> np.ndarray:
        """The ids of some units, one after the other."""
        size = self.size[known]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[known] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def units(self, text: str) -> list[str]:
        """A text as units, each without its first marker (the one the normaliser puts in front)."""
        if not self.split:
            return [text]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes the units not met before."""
        wanted = {u: None for units in texts for u in units}
        new = [u for u in wanted if u not in self]
        if len(self) + len(new) > self.ROOM:
            self._make_room(len(wanted))
            new = [u for u in wanted if u not in self]
        if not new:
            return
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        same = list(map(operator.eq, ids, self.library.encode(new, num_threads=1)))
        back = [text == MARK + u.replace(" ", MARK) for u, text in zip(new, map("".join, (map(self.texts.__getitem__, i) for i in ids)))]
        odd = [k for k, b in enumerate(back) if not b or MARK in new[k]]  # bytes, or a marker that is no space
        for k, text in zip(odd, self.library.decode([ids[k] for k in odd])):
            back[k] = text == new[k]
        if self.split and "" in wanted and "" in new:  # a marker by itself: the library adds none to an empty text
            k = new.index("")
            ids[k], same[k], back[k] = [self.lone], True, True
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))
        self._add(new, flat, size, np.array(same), np.array(back))

    def encode(self, units: list[str]) -> tuple[np.ndarray, bool, bool]:
        known = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        self.met[known] += 1
        return self._flat(known), bool(self.same[known].all()), bool(self.back[known].all())


@functools.lru_cache(maxsize=2)
def _units(data: bytes, threads: int) -> Units:
    """One per worker process and model: what it has met stays known from task to task."""
    return Units(data, threads)


def _encode_rows(known: Units, texts: list[str | None]) -> list[pa.Array]:
    """``ids``, ``parity`` and ``round_trip`` of some texts."""
    units = [known.units(t) if t else [] for t in texts]
    known.learn(units)
    out = [known.encode(u) for u in units]
    null = np.array([t is None for t in texts])
    ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _, _ in out])])
    offsets = pa.array(ends, pa.int32(), mask=np.append(null, False))
    ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([ids for ids, _, _ in out]), pa.int32()))
    return [ids, *[pa.array(np.array([o[k] for o in out]), mask=null) for k in (1, 2)]]


def encode(
    docs: DataFrame, model_path: str = DEFAULT_MODEL, text_col: str = "text", threads: int = 2, drop: Sequence[str] = (),
) -> DataFrame:
    """``docs`` without the columns ``drop`` but with ``ids``, ``parity`` and ``round_trip``; ``model_path`` is read on the driver.

    Rows go through a worker a few at a time (``CHUNK`` bytes of text), so what it holds does not grow with a batch.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    model = docs.sparkSession.sparkContext.broadcast(data)  # the size of the model file
    kept = [c for c in docs.columns if c not in (*drop, "ids", "parity", "round_trip")]
    source = docs.select(F.col(text_col).alias("text"), F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"))
    schema = StructType([source.schema["row"]]).add("ids", ArrayType(IntegerType())).add("parity", BooleanType()).add("round_trip", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _units(model.value, threads)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            group = np.cumsum(sizes, dtype=np.int64) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    part = batch.slice(lo, hi - lo)
                    found = _encode_rows(known, part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("row"), *found], ["row", "ids", "parity", "round_trip"])

    encoded = source.mapInArrow(run, schema)
    return encoded.select(*[F.col(f"row.`{c}`") for c in kept], "ids", "parity", "round_trip")


def decode(rows: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids; null ids have a null text."""
    with open(model_path, "rb") as f:
        data = f.read()
    model = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _units(model.value, 2).tokenizer
        for batch in batches:
            texts = tokenizer.decode_batch([[] if i is None else list(i) for i in batch], skip_special_tokens=False)
            yield pd.Series([None if i is None else t for i, t in zip(batch, texts)], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids_col)))
