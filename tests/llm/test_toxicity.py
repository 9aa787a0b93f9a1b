import numpy as np
import pytest

from obsframe.llm import toxicity

SMALL = toxicity.Settings(bits=12, epochs=6, l1=0.5)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{n}" for n in rng.integers(0, 60, 40)]
        rude, threat = i % 5 == 0, i % 10 == 0
        words += ["rudeword"] * rude + ["threatening"] * threat
        rows.append((i, " ".join(rng.permutation(words)).title()))
        labels.append((i, int(rude), int(threat)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, threat int")


def test_chain_tells_held_out_rows_apart(corpus):
    docs, labels = corpus
    got = toxicity.score_toxicity(docs, labels, ["rude", "threat"], SMALL).join(labels, "doc_id").collect()
    unseen = [r for r in got if toxicity_held_out(r["doc_id"])]
    assert len(unseen) > 40
    for name in ("rude", "threat"):
        assert np.mean([(r[f"p_{name}"] >= 0.5) == bool(r[name]) for r in unseen]) > 0.97


def toxicity_held_out(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_later_models_use_earlier_probabilities(corpus):
    """A second category that equals the first is learned from it, out of fold."""
    import pandas as pd

    rng = np.random.default_rng(1)
    first = rng.integers(0, 2, 300)
    rows = [np.unique(np.concatenate([rng.integers(10, 900, 30), [5] if y else [6]])) for y in first]
    sample = pd.DataFrame({"rows": rows, "a": first.astype(float), "b": first.astype(float)})
    chain = toxicity.fit_chain(sample, ["a", "b"], SMALL)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0.1


def test_odd_rows_and_clashing_columns(corpus, spark):
    _, labels = corpus
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "Rudeword", "x"), (3, "w1 " * 50000, "x"), (4, "!!! \n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_rude string")
    more = labels.unionAll(spark.createDataFrame([(5, None, 1), (6, 0, 0), (6, 1, 0)], labels.schema))
    got = toxicity.score_toxicity(docs, more, ["rude"], SMALL).collect()
    assert len(got) == 6 and all(0 <= r["p_rude"] <= 1 for r in got)
    assert len({r["p_rude"] for r in got if r["doc_id"] in (1, 2, 4)}) == 1


def test_empty_tables(corpus):
    docs, labels = corpus
    assert toxicity.score_toxicity(docs.limit(0), labels, ["rude"], SMALL).count() == 0
    assert {r["p_rude"] for r in toxicity.score_toxicity(docs, labels.limit(0), ["rude"], SMALL).collect()} == {0.5}
