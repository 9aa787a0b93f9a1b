import dataclasses

import numpy as np
import pytest

from obsframe.llm import hash_forest

EXACT = hash_forest.Settings()
SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    sane = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v]
    sane = [(i, v) for i, v in sane if i is not None and np.isfinite(v).all() and v.any()]
    out = []
    for q, x in sane:
        if q in queries:
            near = [(-(x @ v) / (np.linalg.norm(x) * np.linalg.norm(v)), i) for i, v in sane if i != q and len(v) == len(x)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in near)[:k])]
    return sorted(out)


def run(spark, rows, queries, k=5, cfg=EXACT):
    vectors = frame(spark, rows)
    got = hash_forest.nearest(vectors, vectors.where(vectors.vec_id.isin(queries)), k, cfg).collect()
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got)


def same(got, want):
    return [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-9)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8)) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(30)] + [(300, -rows[10][1]), (301, 2 * rows[11][1])]
    queries = [0, 10, 50, 205, 229, 300]
    assert same(run(spark, rows, queries), brute(rows, queries, 5))


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, None), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, []), (8, [1, 0, 0]), (None, [1, 0])]
    got = run(spark, rows, [0, 2, 3, 4, 5, 6, 7, 8])
    assert got == [(0, 1, 1, pytest.approx(2**-0.5))]


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (1, [1, 0.5]), (1, [1, 0.5])]
    assert [g[:3] for g in run(spark, rows, [0])] == [(0, 1, 1)]
    assert run(spark, [], [0]) == []


def test_recall_of_the_forest_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64)) for i in range(4000)]
    queries = list(range(0, 4000, 50))
    cfg = dataclasses.replace(EXACT, block_rows=1500, block_queries=30, floor=100)
    got, want = run(spark, rows, queries, cfg=cfg), brute(rows, queries, 5)
    found = {g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}
    assert len(got) == len(want) and len(found) / len(want) >= 0.9


def test_candidates_come_by_longest_prefix():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((500, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cfg = hash_forest.Settings(trees=4, bits=12)
    planes = hash_forest.projections(16, cfg)
    forest, strings = hash_forest.Forest(unit, planes, cfg), hash_forest.hash_strings(unit, planes, cfg)
    for q in range(20):
        found = forest.candidates(strings[q], 40)
        common = [max((cfg.bits - int(x).bit_length()) for x in strings[i] ^ strings[q]) for i in range(500)]
        level = max(lv for lv in range(cfg.bits + 1) if sum(c >= lv for c in common) >= 40)
        assert found.tolist() == [i for i in range(500) if common[i] >= level]


@pytest.mark.parametrize("rows", [40, 900])
def test_ties_of_different_vectors_go_to_the_smallest_ids(spark, rows):
    one = np.random.default_rng(3).standard_normal(8)
    table = [(n, (one * 2.0 ** (n % 60)).tolist()) for n in range(rows - 1, -1, -1)]  # all in one direction, none equal to its neighbours
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = hash_forest.nearest(vectors, vectors.where("vec_id in (3, 39)")).orderBy("query_id", "rank").collect()
    got = {q: [r["id"] for r in found if r["query_id"] == q] for q in (3, 39)}
    assert got == {3: [0, 1, 2, 4, 5], 39: [0, 1, 2, 3, 4]}
