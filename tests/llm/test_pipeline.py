"""The pipeline on a small corpus with planted cases, stage by stage against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from obsframe.llm import decontaminate, simhash_bytes
from obsframe.llm.pieces import DEFAULT_MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs.toPandas().set_index("doc_id").sort_index(), spark.read.parquet(path).toPandas().set_index("doc_id").sort_index())
        docs = spark.read.parquet(path)
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "simhash", "decontaminate", "pieces"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert list(before.columns) == list(after.columns) and set(after.index) <= set(before.index)


def test_quality_drops_what_it_rejects(stages, spark):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    bad, good = (set(labels[labels == q].index) for q in (0, 1))
    assert len(good & set(after.index)) >= 0.95 * len(good & set(before.index))
    assert len(bad & set(after.index)) <= 0.2 * len(bad)


def test_lines_keep_their_first_place(stages):
    before, after = stages["line_dedup"]
    assert list(before.index) == list(after.index)
    seen, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in before["text"].items():
        kept = []
        for line in text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(lower)
            if len(key) < 10 or seen.setdefault(key, i) == i:
                kept.append(line)
        assert after["text"][i] == "\n".join(kept) and after["n_chars"][i] == len(after["text"][i])


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash"]
    ids = list(before.index)
    fps = np.array([simhash_bytes.fingerprint(t) for t in before["text"]]).view(np.uint64)
    component = list(range(len(ids)))
    for i in range(len(ids)):  # ids ascend: every link lowers to the smaller root
        for j in range(i):
            if bin(int(fps[i] ^ fps[j])).count("1") <= 3:
                a, b = component[i], component[j]
                component = [min(a, b) if c in (a, b) else c for c in component]
    assert list(after.index) == [ids[c] for c in sorted(set(component))]


def test_contaminated_documents_go(stages, spark):
    before, after = stages["decontaminate"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    numbers = [decontaminate.word_numbers(t).tobytes() for t in items]
    for i, text in before["text"].items():
        whole = decontaminate.word_numbers(text).tobytes()
        if any(n in whole for n in numbers):
            assert i not in after.index
    assert len(after) > 0.8 * len(before)


def test_encoding_is_whole(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    before, after = stages["pieces"]
    assert list(before.index) == list(after.index) and after["parity"].all()
    for i, text in before["text"].items():
        assert after["ids"][i].tolist() == library.encode(text) and after["n_ids"][i] == len(after["ids"][i])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, _id int, matches int"
    rows = [(1, None, None, None, None, "s", 1, 2), (2, "", "en", "a", 0, "s", 1, 2), (3, "some words of text", None, "a", 18, "s", 1, 2)]
    rows += [rows[2], (None, "a text without an id", "en", None, 20, "s", 1, 2), (7, "x y\n" * 30000, "en", "b", 120000, "s", 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert out.count() <= len(rows)
    if name != "pieces":
        assert out.columns == docs.columns and all(r["score"] == "s" and r["matches"] == 2 for r in out.collect())
    assert stage(spark, docs.limit(0), SF).count() == 0
