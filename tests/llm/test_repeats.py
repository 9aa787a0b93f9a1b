import random

import numpy as np
import pytest

from obsframe.llm import repeats


def brute(rows, length):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    gone = {}
    for i in order:
        words = (rows[i][1] or "").encode().split()
        cut = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                cut[s : s + length] = [True] * length
            seen.add(window)
        gone[i] = (rows[i][0], len(words), sum(cut), b" ".join(w for w, c in zip(words, cut) if not c).decode())
    return sorted(gone.values())


def run(spark, rows, cfg):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in repeats.remove_repeats(docs, cfg).select("doc_id", "n_words", "n_removed", "text").collect())


@pytest.mark.parametrize("length, seed_words", [(20, 6), (5, 2), (4, 4)])
def test_matches_brute_force(spark, length, seed_words):
    rng = random.Random(length)
    passages = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randint(0, 999)}" for _ in range(rng.randint(1, 25))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100 + i, rows[7][1]) for i in range(10)]
    assert run(spark, rows, repeats.Settings(length, seed_words)) == brute(rows, length)


def test_one_word_over_and_over(spark):
    rows = [(1, "a " * 100), (2, "a " * 30), (3, "a " * 19), (4, "b " * 20)]
    got = run(spark, rows, repeats.Settings())
    assert got == brute(rows, 20) and [r[2] for r in got] == [99, 30, 0, 0]


def test_odd_rows(spark):
    long = " ".join(f"x{n}" for n in range(30000))
    rows = [(1, None), (2, ""), (3, " \u00a0x\x85 "), (5, long), (6, "p " + long), (7, "\x00 \x1c")]
    assert run(spark, rows, repeats.Settings()) == brute(rows, 20)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"y{n}" for n in range(25))
    got = run(spark, [(1, text), (1, text), (4, text)], repeats.Settings())
    assert [r[2] for r in got] == [0, 0, 25]
    docs = spark.createDataFrame([(None, text), (0, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()} == {None: 0, 0: 25}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, [1])], "doc_id long, text string, k int, seeds array<int>")
    row = repeats.remove_repeats(docs).first()
    assert (row["k"], row["seeds"], row["text"], row["n_words"]) == (3, [1], "a b", 2)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_equal_stretches_choose_equal_seeds():
    words = [b"%d" % n for n in np.random.default_rng(2).integers(0, 50, 400)]
    cfg = repeats.Settings()
    hashes, at = repeats.stretches(words + [b"z"] * 7 + words[100:200], cfg)
    inner, place = repeats.stretches(words[100:200], cfg)
    assert (hashes[407:] == inner).all() and (at[407:] - 407 == place).all()
