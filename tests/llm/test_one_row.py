"""The near-duplicate stage leaves exactly one row of each group, whatever its ids."""

import random

import corpus_pipeline


def test_repeated_and_null_ids(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(80)) for x in "abcd")
    rows = [(1, a, 1), (1, a, 2), (1, b, 3), (0, b.upper(), 4), (4, a.replace(" ", "\n"), 5)]  # other texts, the same words
    rows += [(None, c, 6), (None, c, 7), (None, c + " ", 8), (None, d, 9), (3, d, 10), (8, None, 11), (7, "", 12), (None, " ", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(((r["doc_id"], r["text"], r["n"]) for r in corpus_pipeline.keep_first_near_duplicate(spark, docs, "").collect()), key=str)
    groups = [{1, 2, 5}, {3, 4}, {6, 7, 8}, {9, 10}, {11, 12, 13}]
    assert len(got) == 5 and all(sum(n in g for *_, n in got) == 1 for g in groups)
    assert {i for i, *_ in got if i is not None} == {0, 1, 3, 7} and (1, a, 1) in got
