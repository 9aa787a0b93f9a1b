"""Ranked search against scores added up one by one, its bounds, and how much it skips."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from obsframe.llm import pair_search
from obsframe.llm.pair_search import Queries, Segment, Settings, bounds_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id long, text string"


def slow_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow_ranking(docs, items, k=20):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(size for *_, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m = 100 - 25 + 25 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in slow_terms(text) if t in bag
            )
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def ranking(spark, docs, items, cfg=Settings()):
    found = pair_search.rank_documents(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, "item_id long, text string"), cfg)
    return sorted(((r["item_id"], r["rank"], r["id"], r["score"]) for r in found.collect()), key=repr)


def corpus(seed, docs=400, items=25):
    rng = random.Random(seed)
    vocabulary, odds = [f"w{n}" for n in range(500)], [1 / (n + 1) for n in range(500)]
    rows = [(1000 - i, " ".join(rng.choices(vocabulary, odds, k=rng.choice([0, 3, 30, 200])))) for i in range(docs)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(60)]
    return rows, [(i, " ".join(rng.choices(vocabulary, odds, k=rng.choice([1, 4, 30])))) for i in range(items)]


@pytest.mark.parametrize("text", [None, "", "A-b c_D 9x", "Éa é x", "naïve İ ΑΒ", "a\x00b\x7fc", "x " * 9, " wide，space"])
def test_terms(text):
    assert [t.decode() for t in pair_search.terms_of(text)] == slow_terms(text)


@pytest.mark.parametrize("cfg", [Settings(), Settings(segment_docs=7), Settings(segment_postings=50, k=3), Settings(block_bytes=200, segment_docs=64)])
def test_ranking_matches_brute_force(spark, cfg):
    docs, items = corpus(3)
    assert ranking(spark, docs, items, cfg) == slow_ranking(docs, items, cfg.k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "A,B;C"), (5, "z " * 200_000), (6, "x y"), (6, "a")]
    items = [(1, "a b"), (1, "a b"), (2, None), (3, " "), (None, "z x"), (4, "unseen"), (5, "c c a")]
    assert ranking(spark, docs, items) == slow_ranking(docs, items)
    assert ranking(spark, [], items) == [] and ranking(spark, docs, []) == [] and ranking(spark, docs, [(1, "unseen")]) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "s"), (2, "a", 3, "t")], ROWS + ", id int, rank string")
    items = spark.createDataFrame([(7, "a b", 1)], "item_id long, text string, score int")
    found = pair_search.rank_documents(docs, items)
    assert [(r["item_id"], r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]


def prepared(seed):
    docs, items = corpus(seed, docs=900)
    bags = [Counter(pair_search.terms_of(t)) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    counts = [{vocabulary[t]: c for t, c in Counter(pair_search.terms_of(text)).items() if t in vocabulary} for _, text in docs]
    counts = [c for c in counts if c]
    df = Counter(t for c in counts for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) for t in range(len(vocabulary))], np.int64)
    queries = Queries.of(bags, vocabulary, weights)
    lengths = np.array([sum(c.values()) for c in counts])
    held = [np.array(list(c), np.int64) for c in counts]
    return queries, Segment.build(queries, lengths, held, [np.array(list(c.values())) for c in counts], len(counts), int(lengths.sum()), Settings())


def test_pairs_tighten_the_bounds_and_skip_more():
    queries, segment = prepared(5)
    slots = segment.slots(len(queries.weights))
    read = {}
    for pairs in (True, False):
        segment.looked = segment.skipped = 0
        if not pairs:  # a joint maximum that tells nothing leaves independent maxima
            segment.joint = np.full(len(segment.joint), 1 << 50)
        answers = []
        for item in queries.items:
            every, scores = segment.search(item, slots, 1)
            threshold = int(np.sort(scores)[-20]) if len(scores) >= 20 else 1
            found, best = segment.search(item, slots, threshold)
            assert set(every[scores >= threshold]) == set(found[best >= threshold])
            answers.append(sorted(best[best >= threshold].tolist()))
        read[pairs] = (segment.looked, segment.skipped, answers)
    assert read[True][2] == read[False][2]
    assert read[True][0] < read[False][0] and read[True][1] > read[False][1] > 0


def test_bounds_hold_for_every_document():
    queries, segment = prepared(8)
    slots = segment.slots(len(queries.weights))
    for item in queries.items:
        bound = bounds_of(*segment.limits(item, slots))[0]
        for s in range(len(item[0]) + 1):
            score = np.zeros(segment.size, np.int64)
            for t, n in zip(item[0][:s], item[1][:s]):
                docs, impacts = segment.postings(slots[t])
                score[docs] += n * impacts
            assert score.max(initial=0) <= bound[s]


def test_pair_lists_hold_the_documents_with_both():
    queries, segment = prepared(11)
    slots = segment.slots(len(queries.weights))
    for number, (a, _, b, _) in enumerate(queries.pairs.tolist()):
        both = np.intersect1d(segment.postings(slots[a])[0], segment.postings(slots[b])[0])
        assert np.array_equal(both, segment.pair_docs[segment.pair_starts[number] : segment.pair_starts[number + 1]])
