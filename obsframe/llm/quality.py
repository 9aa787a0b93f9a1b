"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram (3 and 4 bytes of UTF-8) of a word between its boundaries, the end mark of a document
and the mark "same word again" is hashed to a row of a vector table. A document is the mean of its
vectors, a softmax over two classes gives the probability of label 1. Table and output layer are learned
together by stochastic gradient descent in numpy, from a bounded sample of labelled documents
(``Settings.train_rows``); scoring covers every whole text.

With two classes the softmax is the logistic function of the difference of the two outputs, so scoring needs
one number per row of the table: its vector times the difference of the output columns.

Defined results: a null text counts as empty; an empty text has the end mark only and gets the score
of that mark; every row of a repeated id is scored; a null id is held out; labels that are null or
contradict each other are not learned; with no label at all every score is 0.5. Extra columns stay;
columns named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm import features


@dataclass(frozen=True)
class Settings:
    train_rows: int = 1500  # bound of the sample that reaches the driver
    bits: int = 16  # the table has 2**bits rows
    dim: int = 10
    epochs: int = 4
    rate: float = 0.6
    row_rate: float = 40.0  # rows move by this much more: each gets only its share of a mean over many inputs (at most so much)
    threshold: float = 0.3
    least_steps: int = 8000  # a small sample is gone through more often
    seed: int = 7


END, AGAIN, MARKS = 0, 1, 2


def input_rows(text: str, bits: int) -> np.ndarray:
    """Table rows of all inputs of a text, repeats included."""
    data = b" " + " ".join(text.split()).encode() + b" "
    words = features.word_hashes(data)
    found = [features.spread(words, bits)]
    found += [features.spread(features.gram_codes(data, n), bits) for n in (3, 4)]
    again = np.count_nonzero(words[1:] == words[:-1])
    rows = np.maximum(np.concatenate(found), MARKS)
    return np.concatenate([[END], np.full(again, AGAIN), rows])


def train(sample: pd.DataFrame, cfg: Settings) -> tuple[np.ndarray, float]:
    """Weight of each table row for label 1, and the bias."""
    if sample.empty:
        return np.zeros(1 << cfg.bits, np.float32), 0.0
    docs = [(np.asarray(r), (np.asarray(c) / np.sum(c)).astype(np.float32)) for r, c in zip(sample["rows"], sample["counts"])]
    labels = sample["label"].to_numpy().astype(np.int64)
    rng = np.random.default_rng(cfg.seed)
    table = rng.uniform(-1 / cfg.dim, 1 / cfg.dim, (1 << cfg.bits, cfg.dim)).astype(np.float32)
    out, bias = np.zeros((cfg.dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(cfg.epochs, -(-cfg.least_steps // len(docs)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            rows, share = docs[d]
            rate = cfg.rate * (1 - done / steps)
            hidden = share @ table[rows]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            faster = min(cfg.row_rate, 1 / float(share @ share))  # a short text moves its few rows no further than its mean
            step = (faster * rate * (out @ p)).astype(np.float32)
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            table[rows] -= np.outer(share, step)
            done += 1
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def classify_quality(
    docs: DataFrame, labels: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (probability of label 1) and ``predicted``."""
    named = labels.select(id_col, F.col(label_col).alias("label"))
    bits = cfg.bits
    sample = features.labelled_sample(docs, named, ["label"], lambda t: input_rows(t, bits), cfg.train_rows, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, cfg))  # 2**bits numbers

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = model.value
        for texts in batches:
            z = np.fromiter((weights[input_rows(t, bits)].mean() for t in texts), np.float64, len(texts)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    probability = F.pandas_udf(score, "double")
    return docs.withColumns({
        "held_out": features.held_out(F.col(id_col)),
        "score": probability(F.coalesce(F.col(text_col), F.lit(""))),
    }).withColumn("predicted", F.when(F.col("score") >= cfg.threshold, 1).otherwise(0))
