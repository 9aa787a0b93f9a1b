import hypothesis.strategies as st
import pytest
import sentencepiece
from hypothesis import given, settings

from obsframe.llm import pieces

with open(pieces.DEFAULT_MODEL, "rb") as f:
    DATA = f.read()
UNITS = pieces._units(DATA, 1)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=DATA)
TEXTS = [
    "", " ", "   ", "a", " a", "a  b", "a ", "x\ny\t z", "é 😀 \x00", "<s> </s> <0x41> <unk>", "a b", "word " * 3000,
    "▁x", "a▁ b", "日本語 テキスト", "x" * 2000,
]


def encode(text):
    units = UNITS.units(text) if text else []
    UNITS.learn([units])
    return UNITS.encode(units)


@pytest.mark.parametrize("text", TEXTS)
def test_parity_with_the_library(text):
    ids, same, back = encode(text)
    assert ids.tolist() == LIBRARY.encode(text) and same
    assert back == ("▁" not in text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ab\n\tÉ😀▁.,<>0x　") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_parity_on_any_text(text):
    assert encode(text)[0].tolist() == LIBRARY.encode(text)


def test_whole_texts_give_the_same_as_units():
    tokenizer = pieces.backend(pieces.read_model(DATA))
    for text in TEXTS:
        assert tokenizer.encode(text, add_special_tokens=False).ids == encode(text)[0].tolist()


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(pieces.Units, "ROOM", 40)
    small = pieces.Units(DATA, 1)
    for text in ["one two three one one two " + " ".join(f"w{n}x{k}" for n in range(k)) for k in range(60)]:
        units = small.units(text)
        small.learn([units])
        assert small.encode(units)[0].tolist() == LIBRARY.encode(text)


def test_model_without_borders_is_encoded_whole(monkeypatch):
    monkeypatch.setattr(pieces, "unit_borders_hold", lambda model: False)
    whole = pieces.Units(DATA, 1)
    units = whole.units("a  b c")
    whole.learn([units])
    assert units == ["a  b c"] and whole.encode(units)[0].tolist() == LIBRARY.encode("a  b c")


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            import struct
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_model_takes_the_best_segmentation():
    found = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -9.0, 1), ("▁a", -2.0, 1), ("▁ab", -7.5, 1)]
    body = b"".join(message((1, message((1, t.encode()), (2, s), (3, k)))) for t, s, k in found)
    model = pieces.read_model(body + message((2, message((3, 1)))) + message((3, message((3, 1), (4, 0), (5, 1)))))
    assert (model.kind, model.pieces[5][0], model.dummy_prefix, model.trim_spaces) == (pieces.UNIGRAM, "▁a", True, False)
    tokenizer = pieces.backend(model)
    assert tokenizer.encode("ab", add_special_tokens=False).tokens == ["▁a", "b"]
    assert tokenizer.decode([5, 3]) == "ab"


def test_frames(spark):
    rows = [(i, t, "own") for i, t in enumerate(TEXTS)] + [(98, None, "own"), (98, None, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parity string")
    encoded = pieces.encode(docs)
    got = pieces.decode(encoded).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
        else:
            assert r["ids"] == LIBRARY.encode(r["text"]) and r["parity"] and r["decoded"] == LIBRARY.decode(r["ids"])
            assert r["round_trip"] == (r["decoded"] == r["text"])
    assert pieces.encode(docs.limit(0)).count() == 0
