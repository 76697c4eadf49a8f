"""Word hashes and windows against plain Python."""

import random
import re

import numpy as np

from labelloom.llm import words as W


def test_equal_words_have_equal_hashes_wherever_they_stand():
    random.seed(3)
    texts = ["", " \t\n", "one", "one two  one\x0bé \x85x"] + [
        " ".join(random.choice(["a", "bb", "é", "日本", "a\x1cb", "x" * 50]) for _ in range(random.randint(0, 30)))
        for _ in range(200)]
    seen = {}
    for first, last, h, bounds in W.chunks([t.encode() for t in texts]):
        for i in range(first, last):
            own = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
            got = h[bounds[i - first] : bounds[i - first + 1]].tolist()
            assert len(own) == len(got)
            for word, value in zip(own, got, strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_a_text_longer_than_a_chunk_is_cut_between_words(monkeypatch):
    text = b"alpha beta gamma " * 500
    whole = next(W.chunks([text]))[2]
    monkeypatch.setattr(W, "CHUNK", 1000)
    pieces = next(W.chunks([text]))[2]
    assert np.array_equal(whole, pieces)


def test_windows_stay_inside_texts():
    bounds = np.array([0, 3, 3, 8])
    at, doc = W.whole(bounds, 3)
    assert at.tolist() == [0, 3, 4, 5] and doc.tolist() == [0, 2, 2, 2]


def thue_morse(n):
    """Two words of ``n`` letters that every polynomial hash modulo 2**64 takes for one."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse_are_told_apart():
    some = [*thue_morse(2048), *thue_morse(512), *thue_morse(64), "a", "a\0", "\0a", "a" * 7, "a" * 7 + "\0", "a" * 8]
    data = np.frombuffer(" ".join(some).encode(), dtype=np.uint8)
    values = W.hashes(data, *W.spans(data))
    assert len(set(values.tolist())) == len(some)
    a, b = (np.array([values[0] if c == "a" else values[1] for c in word], dtype=np.uint64) for word in thue_morse(2048))
    assert W.window_hashes(a, 2048) != W.window_hashes(b, 2048)


def test_equal_compares_bytes():
    r = random.Random(5)
    words = ["".join(r.choices("ab", k=r.choice([1, 2, 7, 8, 9, 16, 17]))) for _ in range(3000)] + ["x" * 3000, "x" * 2999 + "y"]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends = W.spans(data)
    other = np.array([r.randrange(len(words)) for _ in words])
    assert W.equal(data, starts, ends, other).tolist() == [words[i] == words[j] for i, j in enumerate(other)]


def test_windows_with_a_seed_differ_and_do_not_warn():
    h = np.arange(50, dtype=np.uint64)
    assert not np.intersect1d(W.window_hashes(h, 20), W.window_hashes(h, 20, 1)).size
    assert all(len(np.unique(W.window_hashes(h, n))) == 51 - n for n in range(1, 51))
