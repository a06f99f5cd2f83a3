"""Filter audit, periodic runs and source mixing against brute force, and odd rows."""

import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import audit, mixing, runs

DOCS = "doc_id long, text string, source string, n int, bits string, runs string, taken string"


def documents(spark, rows):
    """Rows (id, text, source) with columns whose names the operators use."""
    return spark.createDataFrame([(*r, i, "x", "y", "z") for i, r in enumerate(rows)], DOCS)


# --- filter audit ----------------------------------------------------------------


def slow_audit(rows, labels):
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    failed = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and firsts[text] < i,
        }
        own = [(q, t) for d, q, t in labels if d == i and i is not None]
        failed.append((source or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                earlier = [f for f in mine if f[1][letter] and any(f[1][x] for x in order[: step - 1])]
                alone = [f for f in mine if f[1][letter] and sum(f[1].values()) == 1]
                left = [f for f in left if not f[1][letter]]
                totals[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(earlier), len(alone), sum(f[2] for f in gone), sum(f[3] for f in gone), letter
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = totals[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, rng.choice([5, 199, 200, 260]))) for _ in range(14)]
    texts += [" ".join(rng.choice(words[:60]) for _ in range(220)), "A B C " + texts[0], "é $ " + texts[1], "Ü|" * 3, "", None, "\n \t"]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(120)]
    rows += [(None, texts[0], "a"), (None, texts[0], "a"), (3, rows[3][1], rows[3][2]), (4, texts[2], "b"), (119, texts[3], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(None, 1, 1), (6, 1, 0), (6, 0, 1)]
    return rows, labels


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "SALT", 3)
    rows, labels = audit_rows()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3)
    want = slow_audit(rows, labels)
    for few in (10**6, 0):  # hashes broadcast and shuffled
        monkeypatch.setattr(audit, "FEW", few)
        got = audit.audit(documents(spark, rows).repartition(5), frame).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want
        assert len(got) == len(want) == 600 * 3


def test_equal_hashes_are_told_apart_by_text(spark, monkeypatch):
    """With one hash for all texts the exact comparison decides."""
    rows, labels = audit_rows(2)
    keyed = audit._keyed
    monkeypatch.setattr(audit, "_keyed", lambda docs: keyed(docs).withColumn("hash", F.lit(7).cast("long")))
    got = audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == slow_audit(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, []), labels).collect() == []
    one = audit.audit(documents(spark, [(1, "word " * 50_000, "a")]), labels).collect()
    assert len(one) == 600 and {r.shapley for r in one if r.filter_order[r.step - 1] == "B"} == {120}


# --- periodic runs -----------------------------------------------------------------


def slow_runs(words, times=4, shortest=6):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng):
    letters, size = rng.choice([1, 2, 3, 40]), rng.randint(0, rng.choice([8, 60, 500]))
    words = [rng.randrange(letters) for _ in range(size)]
    for _ in range(rng.randint(0, 3)):
        if words:
            start, period = rng.randrange(size), rng.randint(1, max(1, size // 4))
            block = [rng.randrange(letters) for _ in range(period)]
            if period > 3 and rng.random() < 0.5:  # highly periodic but for its end
                inner = rng.randint(1, period // 4 + 1)
                block = [block[i % inner] for i in range(period - 1)] + [block[-1]]
            for i in range(start, rng.randint(start, size)):
                words[i] = block[(i - start) % period]
    return [f"é{w}" for w in words]


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        texts = [periodic(rng) for _ in range(25)]
        size, found, collapsed = runs._worked(pa.array([" \n".join(t) for t in texts], pa.large_string()), 4, 6)
        assert size.to_pylist() == [len(t) for t in texts]
        for words, got, left in zip(texts, found.to_pylist(), collapsed.to_pylist()):
            want = slow_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            assert left == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_sets_are_consistent_and_dense():
    """Equal contexts are chosen alike, and every window of t places without small period holds a choice."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3, 400)
    t, ends, h = 4, np.full(400, 400), runs.mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2):
        h = np.append(runs.mix(h[:-step] * runs._FACTOR + h[step:]), np.zeros(step, np.uint64))
    low = runs._least_ahead(h, t)
    n = 400 - 2 * t + 1
    chosen = (h[:n] == low[:n]) | (h[t : t + n] == low[:n])
    seen = {}
    for i in range(n):
        assert seen.setdefault(tuple(ids[i : i + 2 * t]), chosen[i]) == chosen[i]
    assert all(chosen[i : i + t].any() for i in range(n - t))
    assert chosen.mean() < 0.75 and len(ends) == 400


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(3, np.int64), np.array([0, 3]), times=3)


def test_runs_of_odd_rows(spark):
    long = "a b c " * 40_000 + "end"
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n\t", "s"), (4, "x " * 6, None), (4, "x " * 6, None), (None, "x " * 5, "s"), (5, long, "s")]
    got = runs.periodic_runs(documents(spark, rows).repartition(3)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 7 and got[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed"]
    assert all(by_id[i].n_words == 0 and by_id[i].runs == [] and by_id[i].collapsed == "" for i in (1, 2, 3))
    assert [tuple(r) for r in by_id[4].runs] == [(0, 6, 1)] and by_id[4].collapsed == "x"
    assert by_id[None].runs == [] and by_id[None].collapsed == "x x x x x"
    assert [tuple(r) for r in by_id[5].runs] == [(0, 120_000, 3)] and by_id[5].collapsed == "a b c end"
    assert runs.periodic_runs(documents(spark, [])).count() == 0


def test_best_run_is_exact(spark):
    rng = random.Random(3)
    rows = [[(rng.randint(0, 9), q * rng.randint(4, 6) + rng.randint(0, 1), q) for q in rng.choices(range(1, 9), k=k)] for k in range(8)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, runs array<struct<start: long, length: long, period: long>>")
    got = {r.id: r.best for r in frame.select("id", runs.best_run(F.col("runs")).alias("best")).collect()}
    for i, own in enumerate(rows):
        want = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert (got[i] and tuple(got[i])) == want


def test_made_periodic(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(0, 30))), "s") for i in range(200)] + [(None, "a b", "s"), (7, None, "s")]
    got = runs.made_periodic(documents(spark, rows)).collect()
    changed = 0
    texts = {(i, t) for i, t, _ in rows}
    for r in got:
        own = [t for i, t in texts if i == r.doc_id]
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        options = []
        for text in own:
            words = (text or "").split()
            if h % 10 or not words:
                options.append(text)
                continue
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            options.append(" ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)))
            changed += options[-1] != text
        assert r.text in options
    assert changed > 5


# --- mixing --------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Excess of the capped sources is dealt out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, fixed = Fraction(share) * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in rest)
        level = (goal - sum(fixed.values())) / total if total else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in rest}}
        fixed.update({s: Fraction(most * sizes[s]) for s in over})


def mixed_rows(seed, n=700):
    rng = random.Random(seed)
    sources = ["a", "B", "z", "é", "", None, "𐀀", "ﬀ", "empty"]
    rows = [(i, "w " * rng.choice([1, 5, 30, 200]), rng.choice(sources[:-1] + ["z"] * 6)) for i in range(n)]
    return rows + [(n, "", "empty"), (n + 1, None, "empty"), (n + 2, None, "a"), (0, rows[0][1], rows[0][2]), (None, "w w", "a"), (None, "w w", "a")]


@pytest.mark.parametrize("cell, few", [(4096, 100_000), (7, 0)])
def test_mix_meets_its_targets(spark, monkeypatch, cell, few):
    monkeypatch.setattr(mixing, "CELL", cell)
    monkeypatch.setattr(mixing, "FEW", few)
    rows = mixed_rows(1)
    got = mixing.mix(documents(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "source", "size", "source_size", "target", "taken"]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, float(want[r.source]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 200
        assert taken[source] <= 2 * sizes[source]
    again = mixing.mix(documents(spark, rows[::-1]).repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_copies_have_their_expectation(spark):
    """Over many seeds every document is taken as often as its source's ratio says."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 5 == 0]) for i in range(60)]
    frame = documents(spark, rows).cache()
    drawn = [{r.doc_id: (r.taken / r.size, r.target / r.source_size) for r in mixing.mix(frame, seed=s).collect()} for s in range(25)]
    means = np.array([[d[i][0] for i in range(60)] for d in drawn]).mean(axis=0)
    ratio = np.array([drawn[0][i][1] for i in range(60)])
    assert abs((means - ratio).mean()) < 0.05 and np.abs(means - ratio).max() < 0.5


def test_rounding_keeps_words():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = rng.integers(1, 40)
        size, x = rng.integers(1, 50, n).astype(float), rng.random(n)
        done = mixing.round_pairs(size, x, rng.random(n))
        assert np.isclose(size @ done, size @ x)
        assert ((done > mixing.CLOSE) & (done < 1 - mixing.CLOSE)).sum() <= 1 and (done >= 0).all() and (done <= 1).all()


def test_one_bundle_of_equal_rows(spark, monkeypatch):
    """A third of the table repeats one row; it is rounded in bundles, and each row comes back."""
    monkeypatch.setattr(mixing, "BUNDLE", 10)
    rows = [(1, "w w w", "a")] * 95 + [(i, "w w", "b") for i in range(2, 190)]
    got = mixing.mix(documents(spark, rows)).collect()
    same = [r.taken for r in got if r.doc_id == 1]
    assert len(got) == len(rows) and len(same) == 95 and set(same) <= {0, 3, 6}
    assert abs(sum(same) - got[0].target if got[0].doc_id == 1 else 0) <= 3


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
