import random
import re

import numpy as np
import pyarrow as pa
import pytest

from registra.llm import words as w

TEXTS = ["Hello  world\n", None, "", "a", " x y z  hello world", "ünï cö\x0bde", "q" * 3, "\x00A-b9\x7f"]


@pytest.mark.parametrize("separators, pattern", [(w.WHITE_SPACE, rb"[^\x20\x09-\x0D]+"), (w.NOT_ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("block", [4, 1 << 20])
def test_words_and_identities(monkeypatch, separators, pattern, block):
    monkeypatch.setattr(w, "BLOCK", block)
    monkeypatch.setattr(w, "_tables", [])
    seen = {}
    for low, high, bounds, data in w.text_slices(pa.array(TEXTS), 12):
        found = w.find_words(bounds, data, separators, lower=True)
        spaced, start, end = found.spaced()
        hashes = found.hashes()
        for i in range(low, high):
            own = slice(found.first[i - low], found.first[i - low + 1])
            expected = re.findall(pattern, (TEXTS[i] or "").encode().lower())
            assert [spaced[a:b] for a, b in zip(start[own], end[own])] == expected
            for word, value in zip(expected, hashes[own]):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_windows_and_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 7, 18, 35):
        hashes = w.rolling(values, width)
        by_window = {}
        for i in range(len(values) - width + 1):
            assert by_window.setdefault(tuple(values[i : i + width]), hashes[i]) == hashes[i]
        assert len(set(by_window.values())) == len(by_window)
        least, place = w.sliding_minimum(values, width)
        for i in range(len(values) - width + 1):
            assert (least[i], place[i]) == (values[i : i + width].min(), i + values[i : i + width].argmin())
    first = np.array([0, 3, 3, 10, 12])
    assert w.windows_inside(first, 3).tolist() == [0, 3, 4, 5, 6, 7]


def test_slices_cover_all_rows():
    texts = ["x" * random.Random(i).randint(0, 30) for i in range(50)]
    column = pa.array(texts).slice(3)
    got = [data[bounds[i] : bounds[i + 1]].tobytes().decode() for low, high, bounds, data in w.text_slices(column, 40) for i in range(high - low)]
    assert got == texts[3:]
