"""Toxicity by a chain of classifiers.

The categories are predicted one after the other, each by a linear model over the presence of words and of their
n-grams of four bytes (hashed, lower-cased, without punctuation), and over the probabilities of the categories before it. In training those are out-of-fold: the
sample is cut into folds, and each row's probability comes from a model that has not seen its fold, so a later model
learns to trust an earlier one as much as it will deserve on new texts. The models are logistic regressions with
an L1 penalty, fitted by follow-the-regularised-leader steps in numpy on a bounded sample of labelled documents
(``Settings.train_rows``); scoring covers every whole text.

Defined results: a null or empty text has no words and gets the probability of the intercepts; labels that are null or contradict each other
are not learned; with no label at all every probability is 0.5; each row of a repeated id is scored; extra columns stay, those
named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm import features
from obsframe.llm.decontaminate import plain_words
from obsframe.llm.frames import free_names


@dataclass(frozen=True)
class Settings:
    train_rows: int = 5000  # bound of the sample that reaches the driver
    bits: int = 18  # words are hashed to 2**bits weights
    folds: int = 3
    epochs: int = 3
    rate: float = 0.5
    l1: float = 3.0
    l2: float = 0.5
    threshold: float = 0.3
    seed: int = 5


def word_rows(text: str, bits: int) -> np.ndarray:
    """Distinct buckets of the words of a text and of their n-grams of four bytes, with one space at the ends."""
    data = b" " + plain_words(text) + b" "
    return np.unique(features.spread(np.concatenate([features.word_hashes(data), features.gram_codes(data, 4).astype(np.uint64)]), bits))


@dataclass
class Linear:
    """Weights of words, of earlier categories' log-odds, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    intercept: float

    def log_odds(self, rows: np.ndarray, earlier: np.ndarray) -> float:
        return float(self.words[rows].sum() + self.earlier @ earlier + self.intercept)


def fit(docs: Sequence[np.ndarray], earlier: np.ndarray, labels: np.ndarray, cfg: Settings) -> Linear:
    """L1 logistic regression; the columns of ``earlier`` and the intercept are not penalised by L1."""
    size, dense = 1 << cfg.bits, earlier.shape[1] + 1
    z, n = np.zeros(size + dense), np.zeros(size + dense)
    l1 = np.concatenate([np.full(size, cfg.l1), np.zeros(dense)])
    rng = np.random.default_rng(cfg.seed)
    extra = np.arange(size, size + dense)

    def weights(ids: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[ids]) * np.maximum(np.abs(z[ids]) - l1[ids], 0)
        return -shrunk / ((1 + np.sqrt(n[ids])) / cfg.rate + cfg.l2)

    for _ in range(cfg.epochs):
        for d in rng.permutation(len(docs)):
            ids = np.concatenate([docs[d], extra])
            x = np.concatenate([np.ones(len(docs[d])), earlier[d], [1.0]])
            w = weights(ids)
            g = (_sigmoid(w @ x) - labels[d]) * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / cfg.rate * w
            n[ids] += g * g
    w = weights(np.arange(size + dense))
    return Linear(w[:size], w[size:-1], float(w[-1]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_chain(sample: pd.DataFrame, categories: Sequence[str], cfg: Settings) -> list[Linear]:
    docs = [np.asarray(r) for r in sample["rows"]]
    earlier = np.zeros((len(docs), 0))
    fold = np.random.default_rng(cfg.seed).permutation(len(docs)) % cfg.folds
    chain = []
    for name in categories:
        labels = sample[name].to_numpy()
        chain.append(fit(docs, earlier, labels, cfg))
        unseen = np.zeros(len(docs))
        for f in range(cfg.folds):
            rest = np.flatnonzero(fold != f)
            model = fit([docs[i] for i in rest], earlier[rest], labels[rest], cfg)
            for i in np.flatnonzero(fold == f):
                unseen[i] = model.log_odds(docs[i], earlier[i])
        earlier = np.column_stack([earlier, np.clip(unseen, -8, 8)])
    return chain


def score_toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category, in the order of the chain."""
    bits, names = cfg.bits, list(categories)
    sample = features.labelled_sample(docs, labels, names, lambda t: word_rows(t, bits), cfg.train_rows, id_col, text_col, counted=False)
    model = docs.sparkSession.sparkContext.broadcast(fit_chain(sample, names, cfg))  # 2**bits numbers per category

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = model.value
        for texts in batches:
            out = np.zeros((len(texts), len(chain)))
            for i, text in enumerate(texts):
                rows = word_rows(text, bits)
                for c, linear in enumerate(chain):
                    out[i, c] = linear.log_odds(rows, np.clip(out[i, :c], -8, 8))
            yield pd.DataFrame(_sigmoid(out), columns=names)

    probabilities = F.pandas_udf(score, ", ".join(f"`{n}` double" for n in names))(F.coalesce(F.col(text_col), F.lit("")))
    (p,) = free_names([*docs.columns, *(f"p_{n}" for n in names)], "_p")
    scored = docs.withColumn(p, probabilities)
    return scored.withColumns({f"p_{n}": F.col(f"{p}.`{n}`") for n in names}).drop(p)
