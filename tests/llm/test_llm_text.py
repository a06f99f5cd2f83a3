"""Fingerprints of tokens against plain Python."""

import re

import numpy as np
import pytest

from causeway.llm import text as T

TEXTS = ["", None, "A b\tc", "  x ", "é漢😀-Z9", "a" * 3000, "a b " * 500, "\n\n", "tail word", "x\x1cy"]


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_tokens_are_the_words(monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    for alphabet, pattern in ((T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (T.SOLID, r"[^\x20\x09-\x0D]+")):
        tokens = T.tokens_of(TEXTS, alphabet)
        words = [re.findall(pattern, "".join(c.lower() if c < "\x80" else c for c in t or "")) for t in TEXTS]
        assert np.diff(tokens.bounds).tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        said = [tokens.data[a:b].decode() for a, b in zip(tokens.starts, tokens.ends)]
        assert ["".join(c.lower() if c < "\x80" else c for c in s) for s in said] == flat
        by_print = {}
        for word, value in zip(flat, tokens.prints):
            assert by_print.setdefault(word, value) == value
        assert len(set(by_print.values())) == len(by_print)


def test_shingles_of_short_and_long_texts():
    tokens = T.tokens_of(["a b c d", "a b", "", "b c d", "a b c a b c"], T.SOLID)
    sets = T.distinct_sets(tokens, 3)
    assert [len(s) for s in sets] == [2, 1, 0, 1, 3]
    assert sets[3][0] in sets[0] and sets[1][0] not in sets[0]


def test_groups_cover_all_texts():
    assert list(T.grouped([None, "ab", "cdef", "", "x"], 4)) == [(0, 3), (3, 5)]
    assert list(T.grouped([])) == []
