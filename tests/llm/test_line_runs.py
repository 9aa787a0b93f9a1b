import random

import pytest

from obsframe.llm import line_runs

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if i is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [lower(x.strip(SPACE)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if i is None or len(holders.get(k, ())) < 2 or min(holders[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_runs.dedup_lines(docs, **kw).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted([tuple(r) for r in got], key=repr)


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (3, 2), (6, 3)])
def test_matches_brute_force(spark, batches, fan_in):
    rng = random.Random(batches)
    pool = [f"line number {n} of the Pool É{'x' * n}" for n in range(12)] + ["short", "", "  ", "UPPER CASE LINE", "upper case line ", "éCLAIR ÉCLAIR", "éclair Éclair"]
    rows = [(rng.choice([i, i, i * 3]), "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(40)]
    assert run(spark, rows, batches=batches, fan_in=fan_in) == brute(rows)


def test_odd_rows(spark):
    same = "the very same line of text"
    rows = [(5, None), (5, ""), (None, same), (7, same), (7, same), (9, same + "\n" + "y" * 200000), (9, "\t" + same.upper() + "\r"), (2, "\n\n")]
    assert run(spark, rows) == brute(rows)


def test_null_id_drops_nothing(spark):
    rows = [(None, "a line that is long enough"), (3, "a line that is long enough")]
    assert run(spark, rows) == brute(rows) and all(r[2] == 0 for r in run(spark, rows))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "x\ny", "keep", -1, 4)], "doc_id long, text string, h1 string, n_dropped int, _id int")
    row = line_runs.dedup_lines(docs).first()
    assert (row["_id"], row["h1"], row["n_dropped"], row["n_lines"], row["text"]) == (4, "keep", 0, 2, "x\ny")


def test_runs_are_compacted(spark):
    store = line_runs.RunStore(spark, fan_in=2)
    for n in range(5):
        path = line_runs.scratch_path(spark, "test-run")
        spark.createDataFrame([(n, n, True), (n, 99, False)], "h1 long, h2 long, fresh boolean").write.parquet(path)
        store.add(path)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in store.seen().collect()) == [(n, n) for n in range(5)]
