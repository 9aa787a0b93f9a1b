"""A text's words are hashed once for seeds and extensions."""

from __future__ import annotations

from obsframe.llm import repeats


def test_words_are_hashed_once(monkeypatch):
    calls, real = [], repeats._word_hashes
    monkeypatch.setattr(repeats, "_word_hashes", lambda words: calls.append(len(words)) or real(words))
    cfg = repeats.Settings()
    text = " ".join(f"w{i % 37}" for i in range(90))
    seeds = repeats.stretches(repeats._words(text), cfg)[0].view("int64")
    calls.clear()
    starts, own, whole = repeats._extended(text, seeds, cfg)
    assert len(starts) == len(own) == len(whole) == 71 and calls == [90]
    assert len(repeats._extended("", seeds, cfg)[0]) == 0
