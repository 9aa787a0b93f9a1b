import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from obsframe.llm import components, simhash_bytes


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["a b c d e f", "A b", "É x\u00a0y z q", "one", "", None, " \t", "w " * 500, "a b a b a b c"])
def test_fingerprint_bit_by_bit(text):
    assert simhash_bytes.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_shingle_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert simhash_bytes.fingerprint("A b c") == row["h"]


def test_positions_cover_every_pair():
    for gone in combinations(range(8), 3):
        assert any(not set(p) & set(gone) for p in simhash_bytes.LIST_POSITIONS)


def test_links_match_all_pairs(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << bit
            values.add(v - (1 << 64) if v >> 63 else v)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in simhash_bytes.links(frame).collect()}
    want = {(a, b) for a, b in combinations(sorted(values), 2) if bin((a ^ b) % (1 << 64)).count("1") <= 3}
    assert got == want and len(want) > 100


def test_documents_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{n}" for n in range(300)]
    rows, base = [], None
    for i in range(150):
        if i % 6 == 0:
            base = rng.choices(vocabulary, k=120)
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 40])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "\n"), (4, "two words"), (4, "two words"), (5, "Two WORDS"), (6, "x " * 50000)]
    got = simhash_bytes.link_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {(i, t): slow_fingerprint(t) for i, t in rows}
    distinct = sorted(set(fps.values()))
    near = [(a, b) for a, b in combinations(distinct, 2) if bin(a ^ b).count("1") <= 3]
    root = roots(distinct, near)
    smallest = {}
    for (i, _), f in fps.items():
        smallest[root[f]] = min(i, smallest.get(root[f], i))
    want = sorted((i, fps[i, t], smallest[root[fps[i, t]]]) for i, t in rows)
    assert sorted((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got) == want and near


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "only null here"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted((r["component"] for r in simhash_bytes.link_near_duplicates(docs).collect()), key=repr) == [3, 3, None]
    assert simhash_bytes.link_near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash_bytes.link_near_duplicates(docs, max_bits=4)


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1)], [(n, n + 1) for n in range(60)], [(0, n) for n in range(1, 50)], [(-5, 7), (7, 9), (8, 10), (10, 9), (20, 21)],
])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = [(a, b) for a, b in links if a != b]
    assert got == roots({n for pair in linked for n in pair}, linked)


def test_random_components(spark):
    pairs = np.random.default_rng(5).integers(0, 400, (260, 2)).tolist()
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = [(a, b) for a, b in pairs if a != b]
    assert got == roots({n for pair in linked for n in pair}, linked)


def test_byte_of_signed_number(spark):
    row = spark.range(1).select(*[simhash_bytes._byte(F.lit(-2).cast("long"), p).alias(f"b{p}") for p in range(8)]).first()
    assert tuple(row) == (254,) + (255,) * 7
