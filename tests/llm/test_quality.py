import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from obsframe.llm import features, quality

GOOD, BAD = "plain words of an even tempered text ", "BUY!! NOW!! CHEAP!! "
SMALL = quality.Settings(bits=10, epochs=8)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.permutation((BAD if i % 4 == 0 else GOOD).split() * 5))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    return docs, labels


def test_held_out_rows_are_told_apart(corpus):
    docs, labels = corpus
    got = quality.classify_quality(docs, labels, SMALL).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    unseen = [r for r in got if r["held_out"]]
    assert len(unseen) > 20 and all(r["predicted"] == r["quality"] for r in unseen)


def test_held_out_labels_are_not_learned(corpus, spark):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(features.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.classify_quality(docs, labels, SMALL).select("doc_id", "score")
    b = quality.classify_quality(docs, turned, SMALL).select("doc_id", "score")
    assert a.exceptAll(b).count() == 0


def test_odd_rows_and_clashing_columns(corpus, spark):
    _, labels = corpus
    rows = [(1, None, 7.0), (2, "", 7.0), (2, "", 7.0), (None, GOOD, 7.0), (3, GOOD * 20000, 7.0), (4, " \n\t ", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.classify_quality(docs, labels.unionAll(spark.createDataFrame([(3, None), (1, 0), (1, 1)], labels.schema)), SMALL).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]


def test_empty_tables(corpus, spark):
    docs, labels = corpus
    assert quality.classify_quality(docs.limit(0), labels, SMALL).count() == 0
    assert {r["score"] for r in quality.classify_quality(docs, labels.limit(0), SMALL).collect()} == {0.5}


def test_repeated_word_mark():
    rows = quality.input_rows("a b b b c", 8)
    assert (rows == quality.AGAIN).sum() == 2 and (rows == quality.END).sum() == 1


def test_word_hashes_depend_on_the_order_of_bytes():
    a, b, c = features.word_hashes(b" ab  ba ab ")
    assert a == c != b
    assert len(features.word_hashes(b"")) == len(features.word_hashes(b"   ")) == 0


def test_grams_keep_to_words():
    codes = features.gram_codes(b" ab c ", 3)
    wanted = [b" ab", b"ab ", b" c "]
    assert sorted(codes.tolist()) == sorted(int.from_bytes(w, "little") for w in wanted)
