import random

import numpy as np
import pytest

from obsframe.llm import decontaminate

CFG = decontaminate.Settings()


def corpus(seed, n_items=40):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) + ". " + " ".join(rng.choices(vocabulary, k=4))) for i in range(n_items)]
    return rng, vocabulary, items


def all_scores(index, words):
    """Every item's score for distinct words, list by list."""
    score = np.zeros(len(index.ids))
    for w in words:
        own = slice(index.start[w], index.start[w + 1])
        score[index.item[own]] += index.score[own]
    return score


@pytest.mark.parametrize("retrieve, list_block", [(0.05, 1), (0.2, 3), (0.6, 8)])
def test_search_retrieves_all_above_threshold(retrieve, list_block):
    rng, vocabulary, items = corpus(1)
    index = decontaminate.Index(items, decontaminate.Settings(retrieve=retrieve, list_block=list_block))
    some = 0
    for _ in range(200):
        text = " ".join(rng.choices(vocabulary, k=30)) + " " + " ".join(rng.choice(items)[1].split()[: rng.randint(0, 30)])
        known = np.unique(index.known(decontaminate.word_numbers(text)))
        words = known[known >= 0]
        want = {i: s for i, s in enumerate(all_scores(index, words)) if s >= retrieve - 1e-9}
        got = dict(index.search(words))
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in got)
        some += len(want)
        if want:
            assert index.may_match(words)
    assert some


def test_bound_passes_over_no_match():
    rng, vocabulary, items = corpus(2)
    for neighbours in (1, 3):
        index = decontaminate.Index(items, decontaminate.Settings(neighbours=neighbours))
        for _ in range(60):
            filler = rng.choices(vocabulary, k=rng.randint(0, 300))
            at = rng.randint(0, len(filler))
            item, text = rng.choice(items)
            whole = " ".join(filler[:at] + text.split() + filler[at:])
            assert item in [m["item_id"] for m in index.matches(whole)]


def test_near_copies_and_decorated_copies_are_found():
    _, _, items = corpus(3)
    index = decontaminate.Index(items, CFG)
    item, text = next((i, t) for i, t in items if len(t.split()) > 40)
    words = text.split()
    for changed in (" ".join(f"{w.upper()}!!" for w in words), text.replace(words[3] + " ", "other ", 1)):
        assert [m["item_id"] for m in index.matches("before it " + changed)] == [item]
    assert index.matches(" ".join(words[: len(words) // 2])) == []


def test_answer_must_be_there():
    index = decontaminate.Index([(1, "what is the name of the tallest hill of the whole land? mount zanzibaro"), (2, "other words. fill the index")], CFG)
    assert [m["item_id"] for m in index.matches("what is the name of the tallest hill of the whole land mount zanzibaro")] == [1]
    assert index.matches("what is the name of the tallest hill of the whole land we wondered") == []


@pytest.mark.parametrize("text, parts", [
    ("Who? Me", ("Who?", " Me")), ("A b. C d.", ("A b.", "C d.")), ("one two three four five", ("one two three", "four five")), ("x", ("", "x")),
])
def test_split_item(text, parts):
    assert decontaminate.split_item(text) == parts


def test_frames(spark):
    _, _, items = corpus(4, 12)
    schema = "item_id long, text string"
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, items[0][1])], schema)
    rows = [(1, None, "m"), (2, "", "m"), (3, items[0][1], "m"), (3, items[0][1], "m"), (4, "x " * 60000 + items[5][1], "m"), (5, "nothing here", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    for block in (5000, 4):
        got = decontaminate.find_contamination(docs, bench, decontaminate.Settings(block_items=block)).collect()
        ids = sorted((r["doc_id"], sorted(m["item_id"] for m in r["matches"])) for r in got)
        assert ids == [(1, []), (2, []), (3, [0, 92]), (3, [0, 92]), (4, [5]), (5, [])]
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert {len(r["matches"]) for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {0}
