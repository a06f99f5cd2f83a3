"""Decontamination, license scans and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest

from causeway.llm import decontaminate, fmindex, licenses, nearest


def words_of(text):
    lowered = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("sample", [1, 3, 8])
def test_fm_index_finds_every_place(sample):
    rng = np.random.default_rng(sample)
    for size in (1, 7, 400):
        symbols = rng.integers(0, 4, size).astype(np.int64)
        symbols[-1] = 0
        index = fmindex.FmIndex(symbols, 4, sample)
        for length in (1, 2, 5):
            phrases = rng.integers(1, 4, (30, length))
            low, high = index.search(phrases[:, ::-1], np.full(30, length))
            for phrase, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(size - length + 1) if (symbols[i : i + length] == phrase).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_copies_do_not_break_the_order():
    symbols = np.array(([1, 2, 1, 2, 3] * 20 + [0]) * 30, np.int64)
    index = fmindex.FmIndex(symbols, 4)
    low, high = index.search(np.array([[3, 2, 1]]), np.array([3]))
    assert high[0] - low[0] == 600
    assert sorted(index.locate(np.arange(low[0], high[0]))) == [i for i in range(len(symbols) - 2) if list(symbols[i : i + 3]) == [1, 2, 3]]


def brute_hits(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(len(own), window)
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add("" if name is None else str(name))
    return len(words), hit, sorted(found)


def make_texts(rng, count):
    return [" ".join(rng.choice(["a", "b", "C,", "d-e", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("block_chars", [20, 10**6])
def test_contamination_against_brute_force(spark, block_chars):
    rng = random.Random(3)
    items = [(i % 9, t) for i, t in enumerate(make_texts(rng, 12))] + [(None, "b b"), (77, None), (78, ""), (79, "?!"), (80, "zzz")]
    texts = [*make_texts(rng, 60), None, "", "...", "é " * 3000]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, window=4, block_chars=block_chars).collect()
    assert len(got) == len(rows) + 1
    for row in got:
        n, hit, found = brute_hits(row.text, items, 4)
        assert row.n_words == n and sorted(row["items"]) == found
        assert {i for a, b in zip(row.hit_starts, row.hit_ends, strict=True) for i in range(a, b)} == hit
        assert all(a > b for a, b in zip(row.hit_starts[1:], row.hit_ends, strict=False))
    cleaned = decontaminate.remove_contamination(docs, bench, window=4, block_chars=block_chars).collect()
    for row in cleaned:
        assert not brute_hits(row.text, items, 4)[1]
    clean = [t for t in texts if not brute_hits(t, items, 4)[1]]
    assert {t for t in clean if t is not None} <= {r.text for r in cleaned}
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def as_pattern(template):
    """A template as a regular expression over words that each end with a blank."""
    found, at = "", 0
    for mark in [*re.finditer(r"<<([^>]*)>>", template), None]:
        plain = template[at : mark.start() if mark else len(template)]
        found += "".join(re.escape(w) + " " for w in plain.split())
        if mark is None:
            return found
        at, said = mark.end(), mark[1]
        if said == "beginOptional":
            found += "(?:"
        elif said == "endOptional":
            found += ")?"
        elif "match" in said:
            found += f"(?:{said.split(chr(34))[1]}) "
        else:
            least, most = said.split('"')[1].split("-")
            found += f"(?:[^ ]+ ){{{least},{most}}}"


def test_licenses_against_regular_expressions(spark):
    rng = random.Random(8)
    parts = ["Licensed under", "Released under the", "under the MIT License.", "terms of the", "Apache License, Version 2", "0", "CC BY-NC",
             "CC BY", "4.0", "GNU General Public License,", "version 3", "or any later version", "this work is", "word", "mit", "license"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(500)] + [None, "", "licensed " * 2000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = words_of(text)
        said = "".join(w + " " for w in words)
        base = [(k, v) for p, v in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        labels = {v for _, v in base} | {v for v, t in licenses.TEMPLATES if re.search("(?:^| )" + as_pattern(t), said)}
        row = got[i]
        assert (row.n_words, row.n_base) == (len(words), len(base))
        assert row.base_labels == ",".join(sorted({v for _, v in base})) and row.labels == ",".join(sorted(labels))
        assert (row.first_word, row.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(labels)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["<<beginOptional>> a", "a <<endOptional>>", "<<what>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton.compile(bad)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    vectors = (centres[rng.integers(0, 8, 600)] + 0.4 * rng.normal(size=(600, 16))).astype(np.float32)
    vectors[50:90] = vectors[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(601, None), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (605, [None] * 16),
           (606, []), (607, [1.0, 2.0]), rows[3]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = nearest.nearest(frame.where("vec_id % 20 = 0 OR vec_id > 600"), frame, k=10, shard_rows=200, block_rows=8).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in range(600) if i % 20 == 0]
    assert sorted(found) == asked
    exact = vectors.astype(float)
    hits = 0
    for q in asked:
        scores = exact @ exact[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert len(found[q]) == 10 and [i for i, _ in found[q]] == sorted((i for i, _ in found[q]), key=lambda i: (-scores[i], i))
        assert all(abs(s - scores[i]) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in found[q]} & set(want))
    assert hits >= 0.9 * 10 * len(asked)
    few = nearest.nearest(frame.where("vec_id = 0"), frame.where("vec_id < 4"), k=10).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted((1, 2, 3), key=lambda i: -(exact[i] @ exact[0]))
    assert nearest.nearest(frame.limit(0), frame).count() == 0 and nearest.nearest(frame, frame.limit(0)).count() == 0
