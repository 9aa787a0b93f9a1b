"""Links by MinHash coordinates against all pairs of whole sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from obsframe.llm import coordinate_join
from obsframe.llm.coordinate_join import Settings, shingle_set, signature

SCHEMA = "doc_id long, text string"


def slow_set(text, k=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_components(rows, percent=85):
    sets, root, links = [slow_set(t) for _, t in rows], list(range(len(rows))), 0
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            links += sets[a] != sets[b]
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root)), key=repr), links


def corpus(seed):
    """Groups with few changes each, so that similarities lie on both sides of the bound, over a passage that all share."""
    rng = random.Random(seed)
    vocabulary, rows = [f"word{n}" for n in range(400)], []
    passage = rng.choices(vocabulary, k=40)
    for _ in range(30):
        base = passage + rng.choices(vocabulary, k=rng.choice([0, 3, 12, 60, 150]))
        for _ in range(9):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((5000 - len(rows), " ".join(words + rng.choices(vocabulary, k=rng.choice([0, 0, 2, 9])))))
    return rows


def found(spark, rows, cfg=Settings()):
    linked = coordinate_join.link_similar(spark.createDataFrame(rows, SCHEMA), cfg)
    return sorted(((r["id"], r["n"], r["component"]) for r in linked.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    want, links = slow_components(rows)
    assert found(spark, rows) == want and links > 100


@pytest.mark.parametrize("cfg", [Settings(short=1), Settings(short=1, block_texts=7), Settings(short=3, block_shingles=400)])
def test_blocks_match_all_pairs(spark, cfg):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(60)]
    base, rows = rng.choices(vocabulary, k=90), []
    for i in range(130):  # one large group around the bound, with changes that texts share
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    want, links = slow_components(rows + corpus(9)[:90])
    assert found(spark, rows + corpus(9)[:90], cfg) == want and len({c for *_, c in want}) > 10


def test_other_settings(spark):
    rows = corpus(7)
    want, _ = slow_components(rows, 92)
    assert found(spark, rows, Settings(percent=92, coordinates=48, matches=33)) == want


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "two words"), (5, "Two\nWORDS"), (4, "two"), (3, "x " * 60000), (2, "X X x")]
    rows += [(6, "two words"), (6, "other text of one id"), (None, "other  text of one id"), (None, "alone without an id"), (None, None)]
    want, _ = slow_components(rows)
    assert found(spark, rows) == want
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d", 1, "s"), (1, "A b c d", 2, "t")], SCHEMA + ", node int, key string")
    assert {(r["id"], r["component"]) for r in coordinate_join.link_similar(docs).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "a b c d", "a a a a a", "b a b a b a c", "É é e"])
def test_sets_have_the_right_size(text):
    assert len(shingle_set(text)) == len(slow_set(text))


def test_short_texts_differ_from_shingles():
    sets = [shingle_set(t)[0] for t in ("a b", "b a", "a", "b", "a b c", "c b a", "a a", "a a a")]
    assert len(set(sets)) == len(sets)


def test_collisions_estimate_the_similarity():
    rng = np.random.default_rng(3)
    orders, agreed = coordinate_join._orders(64), []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 230).astype(np.uint64)
        a, b = np.unique(pool[:200]), np.unique(pool[30:])
        agreed.append((signature(a, orders) == signature(b, orders)).sum())
    assert abs(np.mean(agreed) / 64 - 170 / 230) < 0.02 and min(agreed) >= 30
    assert len(set(signature(a, orders).tolist())) == 64
