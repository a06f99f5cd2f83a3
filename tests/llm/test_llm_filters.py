"""Quality, language and URL operators, and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import langid, quality, queries, urls

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def prose(rng, extra=()):
    words = [rng.choice(["the", "of", f"word{rng.randint(0, 400)}"]) for _ in range(rng.randint(30, 90))]
    for word in extra:
        words.insert(rng.randrange(len(words)), word)
    return " ".join(words) + "."


def corpus(rng, size=900):
    """(id, text, quality, toxic): junk repeats one word, toxic texts have words of their own."""
    rows = []
    for i in range(size):
        kind = rng.choice(["good"] * 6 + ["junk", "toxic"])
        if kind == "junk":
            rows.append((i, " ".join([rng.choice(["blah!!", "spam***"])] * rng.randint(20, 60)), 0, 0))
        else:
            rows.append((i, prose(rng, ["scum", "moron"] if kind == "toxic" else []), 1, int(kind == "toxic")))
    return rows


def test_quality_tells_kinds_apart(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows] + [(None, None, 1.0), (9000, "", 1.0), (0, rows[0][1], 0.5)], "doc_id long, text string, draw double")
    seen = [(i, q, t) for i, _, q, t in rows if i % 2] + [(None, 0, 1), (3, None, None), (9999, 1, 0)]
    labels = spark.createDataFrame(seen, "doc_id long, quality int, toxic int")
    scored = quality.resample(docs, labels, texts=True)
    assert scored.columns == ["doc_id", "text", "log_weight", "draw", "drawn"]
    got = {r.doc_id: r for r in scored.collect()}
    assert scored.count() == quality.resample(docs, labels).count() == len(rows) + 3
    held = [(i, q == 1 and t == 0) for i, _, q, t in rows if not i % 2]
    assert np.mean([got[i].drawn == good for i, good in held]) > 0.97
    assert np.mean([got[i].drawn for i, good in held if good]) > 0.98
    assert got[None].log_weight == got[9000].log_weight == 0
    few = quality.resample(docs, labels, k=50).where("drawn")
    assert 50 <= few.count() <= 51 and few.where("log_weight < 0").count() == 0
    assert quality.resample(docs, labels.limit(0)).where("NOT drawn").count() == 0
    assert quality.resample(docs.limit(0), labels, texts=True).count() == 0
    assert quality.resample(docs, labels, k=0).where("drawn").count() == 0


def test_weights_and_draws_are_recomputed(spark):
    """Weights from the model's tables by a plain loop, draws from a sort of all rows."""
    rows = corpus(random.Random(4), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = {r.doc_id: r for r in quality.resample(docs, labels, texts=True).collect()}
    for i, text, _, _ in rows:
        grams = quality.Grams.of([text])
        style = sum(model.style[b] * n for b, n in zip(grams.bucket, grams.times))
        wording = sum(min(model.wording[0][a], model.wording[1][b]) for a, b in zip(*grams.words))
        share = model.shares
        most = max(0.0, style, wording)  # keeps the powers in range
        raw = share[0] * np.exp(-most) + share[1] * np.exp(style - most) + share[2] * np.exp(wording - most)
        assert np.isclose(scored[i].log_weight, -np.log(raw) - most, atol=1e-9)
    expected = sum(r.log_weight >= 0 for r in scored.values())
    ranked = sorted(scored.values(), key=lambda r: -r.draw)
    assert {r.doc_id for r in ranked[:expected]} == {i for i, r in scored.items() if r.drawn}
    # Noise decides: half of the rows are not the half of the largest weights, and another seed draws others.
    half = [{r.doc_id for r in quality.resample(docs, labels, k=150, seed=s).where("drawn").collect()} for s in (0, 1)]
    heaviest = sorted(scored.values(), key=lambda r: -r.log_weight)[:150]
    assert half[0] != half[1] and half[0] != {r.doc_id for r in heaviest}
    assert all(abs(len(h) - 150) <= 1 for h in half)


def test_draws_follow_the_weights(spark):
    """Of two kinds of rows, drawn without replacement, shares are those of a simulation."""
    weights = np.array([0.0] * 500 + [-2.0] * 500)
    frame = spark.createDataFrame([(i, "", float(w)) for i, w in enumerate(weights)], "doc_id long, text string, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id", "text"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    draws = frame.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform)))
    got = draws.where(quality._cut(draws, 300)).where("log_weight = 0").count()
    rng = np.random.default_rng(3)
    simulated = [np.sum(rng.choice(1000, 300, replace=False, p=np.exp(weights) / np.exp(weights).sum()) < 500) for _ in range(200)]
    assert abs(got - np.mean(simulated)) < 5 * np.std(simulated)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([0.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e6), -1e9]) for _ in range(800)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 399, 800):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    network = langid.Network.fresh(["a", "b"], 1)
    for name in ("embedding", "bias", "weights", "base"):
        setattr(network, name, getattr(network, name).astype(float))
    network.filters = [f.astype(float) for f in network.filters]
    windows = rng.integers(0, 257, (5, 24))
    gold = np.array([0, 1, 1, 0, 1])

    def loss():
        return -np.log(network.probabilities(windows)[np.arange(5), gold]).mean()

    for parameter, slope in zip(network.parameters(), network.gradient(windows, gold), strict=True):
        flat, own = parameter.reshape(-1), slope.reshape(-1)
        for place in np.argsort(-np.abs(own))[:3]:
            held = flat[place]
            flat[place] = held + 1e-6
            up = loss()
            flat[place] = held - 1e-6
            down = loss()
            flat[place] = held
            assert abs((up - down) / 2e-6 - own[place]) < 1e-4


def test_windows_cover_all_bytes():
    texts = [b"", b"ab", b"x" * 128, b"y" * 300]
    windows, owner, size = langid.windows_of(texts)
    assert owner.tolist() == [0, 1, 2, 3, 3, 3] and size.tolist() == [0, 2, 128, 128, 128, 44]
    for i, text in enumerate(texts):
        flat = windows[owner == i].reshape(-1)
        assert bytes(flat[flat != langid.BLANK].astype(np.uint8)) == text


def test_languages(spark):
    rng = random.Random(3)
    said = {"xx": "zu wa ki ro".split(), "yy": "été où ça là".split()}
    rows = [(i, " ".join(rng.choice(said[lang]) for _ in range(rng.randint(1, 200))), lang) for i, lang in enumerate(["xx", "yy"] * 120)]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "12 !?", "xx"), (None, "zu wa", None), rows[0]]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    texts, gold = langid.training_windows(frame)
    assert set(gold) == {"xx", "yy"} and len(texts) <= 160 + 1
    network = langid.train(texts, gold, steps=150)
    got = langid.predict_languages(frame, network).collect()
    assert len(got) == len(rows) + 5
    assert np.mean([r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 900]) > 0.95
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.training_windows(frame.limit(0)) == ([], [])
    assert langid.train([], []) is None
    assert {r.lang_pred for r in langid.predict_languages(frame, None).collect()} == {"und"}


@needs_tables
def test_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def judged_by_hand(url, rules, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    bare = host.removeprefix("www.") + path.rstrip("/") if host else None
    return host, path, None, "block" if bare is not None and bare in listed else "allow"


@pytest.mark.parametrize("max_blocks", [1, 1 << 16])
def test_urls_by_hand(spark, max_blocks):
    rng = random.Random(4)
    hosts = ["a.Example.org", "example.org", "xexample.org", "b.com", "www.b.com", "org", "é.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "//", "/a.html/"]
    made = [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/x", "#/es/", "?"]) for _ in range(400)]
    made += [None, "", "nothing", "://", "http://a.org/x\ny", "http://u://x.org/es/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"), ("b.com", "/e", "allow")]
    listed = ["é.net/es", "b.com", "é.net", None, "é.net"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(made)], "page_id long, url string, verdict string")
    rule_rows = spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, verdict string")
    listed_rows = spark.createDataFrame([(u,) for u in listed], "canonical string")
    got = urls.judge_urls(pages, rule_rows, listed_rows, max_blocks=max_blocks).collect()
    assert len(got) == len(made)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged_by_hand(made[r.page_id], rules, set(listed)), made[r.page_id]
    assert urls.judge_urls(pages.limit(0), rule_rows, listed_rows).count() == 0
    empty = urls.judge_urls(pages, rule_rows.limit(0), listed_rows.limit(0))
    assert empty.where("verdict <> 'allow'").count() == 0 and empty.count() == len(made)


@needs_tables
@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})")
    assert sorted(map(str, map(tuple, frame.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], SF_DIR)))
        assert seen[-1].columns == docs.columns
        assert seen[-1].count() <= seen[-2].count()
    assert seen[2].where("n_chars <> length(text)").count() == 0
    from causeway.llm import decontaminate, jaccard

    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontaminate.find_contamination(seen[4], bench).where("size(items) > 0").count() == 0
    assert jaccard.repeated_documents(seen[3]).count() == 0
    final = corpus_pipeline.run(spark, SF_DIR)
    assert final.count() == seen[4].count() and final.where("NOT round_trip").count() == 0
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert seen[1].join(labels, "doc_id", "left_semi").count() >= 0.95 * clean.count()


@pytest.mark.parametrize("documents", [(299, 49, 51), (27, 3, 10), (100, 30, 7), (5, 0, 1)])
def test_texts_without_words_have_weight_one(documents):
    flat = np.zeros(quality.BUCKETS)
    model = quality.Model(np.array(documents) / sum(documents), flat, (flat, flat))
    assert model.log_weights([None, "", " \n", "a b"])[:3].tolist() == [0.0] * 3


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "a", 33)] * 3 + [(2, text, "en", "a", 33), (3, "", "en", "b", 0), (3, "", "en", "b", 0), (4, "quite another text", "en", "b", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
