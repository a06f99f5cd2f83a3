import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import chains, dedup, filters, groups, skew, splits

SCHEMA = (
    "corpus string, doc_id string, sent_id bigint, example_id bigint, text string, "
    "tagged_text string, extra string"
)


def brute_merge(rows):
    """Brute force over the rows of one sentence, in order."""
    import re

    text = rows[0][4]
    for n, row in enumerate(rows, 1):
        for letter in "ce":
            span = re.search(f"<{letter}>(.*?)</{letter}>", row[5]).group(1)
            if span not in text:
                return None
            text = text.replace(span, f"<{letter}{n}>{span}</{letter}{n}>")
    return text


def sentences(seed, count, biggest):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "c", "1", "rain", ""]
    rows = []
    for s in range(count):
        body = [rng.choice(words) for _ in range(6)]
        for e in range(rng.randint(1, biggest)):
            pick = lambda: rng.choice(body + ["zzz"] * (rng.random() < 0.1))
            rows.append(
                ("x", f"d{s % 5}", s, e, " ".join(body), f"<c>{pick()}</c> q <e>{pick()}</e>", f"{s}.{e}")
            )
    return rows


def test_merge_against_brute_force(spark):
    rows = sentences(5, 60, 4)
    want = {}
    for key in {r[:3] for r in rows}:
        group = sorted([r for r in rows if r[:3] == key], key=lambda r: (r[3], r[5]))
        merged = brute_merge(group)
        if merged is not None:
            want[key] = (merged, group[0][6])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = groups.merge_causal_groups(frame).collect()
    assert {tuple(r[:3]): (r.tagged_text, r.extra) for r in got} == want
    assert len(got) == len(want)


def test_merge_drops_null_keys(spark):
    rows = [("x", None, 1, 0, "a b", "<c>a</c> <e>b</e>", ""), ("x", "d", 1, 0, "a b", "<c>a</c> <e>b</e>", "")]
    got = groups.merge_causal_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.tagged_text for r in got] == ["<c1>a</c1> <e1>b</e1>"]


@pytest.mark.parametrize("hot_rows, hot_share", [(100_000, 1e-4), (2, 0.0)])
def test_group_size(spark, hot_rows, hot_share):
    """The same sizes whether the hot keys are spread or not; NULL keys are equal."""
    rows = [(1, None, i) for i in range(50)] + [(2, "b", i) for i in range(3)] + [(3, "c", 0), (None, None, 9)]
    frame = spark.createDataFrame(rows, "k int, j string, v int")
    got = skew.with_group_size(frame, ["k", "j"], "n", hot_rows, hot_share).collect()
    want = [(*r, sum(q[:2] == r[:2] for q in rows)) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merge_keeps_large_numbers_and_groups(spark):
    """Numbers beyond 2**53 beside NULLs, and 5,000 relations in one sentence."""
    big = 2**53 + 1
    rows = [("x", "d", 1, i, "a b", "<c>a</c> <e>b</e>", big if i == 0 else None) for i in range(5000)]
    rows += [("x", "e", 1, 0, "a b", "<c>a</c> <e>b</e>", None)]
    schema = "corpus string, doc_id string, sent_id int, example_id int, text string, tagged_text string, extra bigint"
    frame = spark.createDataFrame([(*r[:4], *("".join(f"w{r[3]} v{r[3]}") for _ in range(1)), f"<c>w{r[3]}</c> <e>v{r[3]}</e>", r[6]) for r in rows], schema)
    frame = frame.withColumn("text", F.expr("CASE WHEN doc_id = 'd' THEN array_join(transform(sequence(0, 4999), i -> concat('w', i, ' v', i, ',')), ' ') ELSE text END"))
    merged = groups.merge_causal_groups(frame)
    assert "Python" not in merged._jdf.queryExecution().toString()
    # a short span also stands inside longer words, which keep the text small here
    assert groups.merge_causal_groups(frame.where("doc_id = 'e'")).first().extra is None
    sizes = frame.groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in sizes} == {"d": 5000, "e": 1}
    few = groups.merge_causal_groups(frame.where("example_id < 9"))
    assert {r.doc_id: r.extra for r in few.collect()} == {"d": big, "e": None}
    many = frame.where("doc_id = 'd'").withColumns({"text": F.lit("a b"), "tagged_text": F.lit("<c>q</c> <e>b</e>")})
    assert groups.merge_causal_groups(many).count() == 0
    assert groups.malformed_relations(frame.withColumn("tagged_text", F.lit("<c>q</c>"))).count() == 5001


def test_single_and_multi(spark):
    frame = spark.createDataFrame(sentences(9, 20, 3), SCHEMA)
    single = groups.causal_groups(frame, "single")
    multi = groups.filter_num_causal(frame, "multi")
    assert single.count() + multi.count() == frame.count()
    assert single.groupBy(*groups.GROUP_KEY).count().where("count > 1").count() == 0
    assert single.where("tagged_text LIKE '%<c1>%'").count() == 0


@pytest.mark.parametrize("block", [2, 4, 1000])
def test_chain_with_gaps(spark, block):
    rows = [("k", p, f"e{p}", f"c{p}", 0) for p in (0, 1, 2, 3, 6, 7, 8, 5000)]
    frame = spark.createDataFrame(rows, "k string, pos long, event string, short_context string, label long")
    got = chains.chain_pairs_from_elements(frame, "k", "pos", block=block).collect()
    assert {(r.example_id, tuple(r.events)) for r in got} == {
        (f"reco_k_{i}", tuple(f"e{rows[i + n][1]}" for n in range(3))) for i in range(6)
    }


def test_dedup(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None), (6, "c")]
    frame = spark.createDataFrame(rows, "row_id int, text string")
    assert sorted(r.row_id for r in dedup.keep_first(frame).collect()) == [1, 2, 4, 6]
    assert sorted(r.row_id for r in dedup.keep_unique(frame).collect()) == [2, 6]


@pytest.mark.parametrize("n, sizes", [(21325, (17060, 2132, 2133)), (10, (8, 1, 1)), (7, (5, 1, 1)), (3, (2, 0, 1))])
def test_split_sizes(spark, n, sizes):
    frame = spark.range(n)
    parts = splits.split_80_10_10(frame, 42, ["id"])
    counts = {r.split: r.n_rows for r in splits.split_sizes(parts).collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "valid", "test")) == sizes
    assert parts.select("id").distinct().count() == n


@pytest.mark.parametrize(
    "n_rest, n_test, sizes", [(1885, 316, (1569, 316)), (577, 401, (462, 115)), (903, 51, (852, 51)), (4, 1, (4, 0))]
)
def test_adaptive_sizes(spark, n_rest, n_test, sizes):
    parts = splits.split_train_valid(spark.range(n_rest), spark.range(n_test), 1, ["id"])
    counts = {r.split: r.n_rows for r in splits.split_sizes(parts).collect()}
    assert (counts.get("train", 0), counts.get("valid", 0)) == sizes


def test_order_is_seeded(spark):
    frame = spark.range(500)
    ranked = {r.id: r["rank"] for r in splits.global_rank(frame, 7, ["id"]).collect()}
    assert sorted(ranked.values()) == list(range(1, 501))
    in_order = [r.id for r in splits.shuffle(frame, 7, ["id"]).collect()]
    assert in_order == sorted(ranked, key=ranked.get)
    shots = {r.id: r.shot for r in splits.sample_k(frame, 5, 7, ["id"]).collect()}
    assert shots == {i: n for n, i in enumerate(in_order[:5], 1)}
    other = [r.id for r in splits.shuffle(frame, 8, ["id"]).collect()]
    assert other != in_order
    parts = {r.id: r.split for r in splits.split_80_10_10(frame, 7, ["id"]).collect()}
    assert [parts[i] for i in in_order] == ["train"] * 400 + ["valid"] * 50 + ["test"] * 50


def test_coarse_buckets_cut_at_the_same_rows(spark, monkeypatch):
    """With few buckets several borders fall into one bucket."""
    frame = spark.range(97)
    fine = {r.id: r.split for r in splits.split_80_10_10(frame, 3, ["id"]).collect()}
    monkeypatch.setattr(splits, "BUCKET_DIGITS", 1)
    coarse = {r.id: r.split for r in splits.split_80_10_10(frame, 3, ["id"]).collect()}
    assert coarse == fine


def test_equal_keys_keep_sizes_exact(spark):
    """A third of all rows share one key; wherever the borders fall, sizes hold."""
    frame = spark.range(90).selectExpr("if(id % 3 = 0, -1, id) AS k", "id")
    for seed in range(6):
        parts = splits.split_80_10_10(frame, seed, ["k"])
        counts = {r.split: r.n_rows for r in splits.split_sizes(parts).collect()}
        assert counts == {"train": 72, "valid": 9, "test": 9}, seed
        assert parts.select("id").distinct().count() == 90


def test_cut_may_leave_rows_out(spark):
    ranked = {r.id: r["rank"] for r in splits.global_rank(spark.range(50), 5, ["id"]).collect()}
    parts = lambda n: [("none", F.lit(0)), ("a", F.lit(3)), ("b", F.lit(10))]
    got = {r.id: r.split for r in splits.cut(spark.range(50), 5, ["id"], parts).collect()}
    assert got == {i: "a" if r <= 3 else "b" for i, r in ranked.items() if r <= 10}
    assert splits.cut(spark.range(0), 5, ["id"], parts).count() == 0


def test_head(spark):
    assert [r.id for r in splits.head(spark.range(10), 3, ["id"]).collect()] == [0, 1, 2]
    assert splits.head(spark.range(2), 3, ["id"]).count() == 2


def test_chain_pairs(spark):
    rows = [
        ("7", ["a_b", "c", "d", "e"], ["x", "y", "z"], 3),
        ("8", ["a", "b"], ["x"], 0),
        ("9", ["a"], [], 0),
    ]
    frame = spark.createDataFrame(rows, "index string, events array<string>, short_contexts array<string>, label bigint")
    got = {r.example_id: (r.events, r.short_contexts, r.labels) for r in chains.chain_pairs(frame).collect()}
    assert got == {
        "reco_7_0": (["a b", "c", "d"], ["x", "y"], 1),
        "reco_7_1": (["c", "d", "e"], ["y", "z"], 0),
    }
    elements = frame.select("index", "label", "short_contexts", F.posexplode("events").alias("pos", "event"))
    elements = elements.withColumn("short_context", F.get("short_contexts", "pos"))
    for block in (1000, 2):
        again = chains.chain_pairs_from_elements(elements, "index", "pos", block=block).collect()
        assert {r.example_id: (r.events, r.short_contexts, r.labels) for r in again} == got


@pytest.mark.parametrize("block", [2, 3, 7, 1000])
def test_long_chains_in_blocks(spark, block):
    """One chain of 100 elements and many short ones, whatever the block size."""
    rows = [(0, i, f"e{i}", f"c{i}", 3) for i in range(100)]
    rows += [(k, i, f"e{k}.{i}", None, 0) for k in range(1, 30) for i in range(k % 5)]
    frame = spark.createDataFrame(rows, "k int, pos int, event string, short_context string, label int")
    want = {}
    for k, i, *_ in rows:
        chain = [r for r in rows if r[0] == k]
        if i + 2 < len(chain):
            label = 0 if chain[0][4] == i + 2 else 1
            want[f"reco_{k}_{i}"] = ([r[2] for r in chain[i : i + 3]], [r[3] for r in chain[i : i + 2]], label)
    got = chains.chain_pairs_from_elements(frame, "k", "pos", block=block).collect()
    assert {r.example_id: (r.events, r.short_contexts, r.labels) for r in got} == want
    assert len(got) == len(want)


def test_quarantine(spark):
    frame = spark.createDataFrame([(0,), (1,), (2,), (None,)], "label int")
    good, bad = filters.quarantine(frame, filters.valid_chain_label(F.col("label")))
    assert [r.label for r in good.collect()] == [0, 2]
    assert [r.label for r in bad.collect()] == [1, None]


def test_test_docs(spark):
    ids = ["wsj_0034", "wsj_23x", "wsj_05", "wsj_24", "Article247_327.ann", "xwsj_001"]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    got = lambda **kw: [r.doc_id for r in frame.where(filters.is_test_doc(F.col("doc_id"), **kw)).collect()]
    assert got() == ["wsj_0034", "wsj_23x"]
    assert got(also=filters.TEST_DOC_ID) == ["wsj_0034", "wsj_23x", "Article247_327.ann"]


def test_ids(spark):
    row = spark.createDataFrame([("fincausal2_10.5", 3)], "a string, b int")
    got = row.select(
        filters.normalize_id(F.col("a")).alias("d"),
        filters.normalize_id(F.lit("none")).alias("n"),
        filters.make_id("reco", F.col("b"), F.lit(0)).alias("m"),
    ).first()
    assert (got.d, got.n, got.m) == (2105, None, "reco_3_0")


def test_a_group_of_many_relations_streams_by(spark):
    """600 relations of one sentence, over several Arrow batches, between small groups."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = [("a", 1, 0, "x y", "<c>x</c> <e>y</e>"), ("z", 1, 0, "x y", "<c>x</c> <e>y</e>")]
        rows += [("m", 1, i, "p q", "<c>p</c> <e>q</e>") for i in range(3)]
        rows += [("n", 1, i, "p q", "<c>p</c> <e>gone</e>") for i in range(2)]
        names = [f"w{i:05}" for i in range(300)]
        text = " ".join(names)
        long = [("long", 1, i, text, f"<c>{names[i % 300]}</c> <e>{names[(i * 7 + 1) % 300]}</e>") for i in range(600)]
        frame = spark.createDataFrame(rows + long, "doc_id string, sent_id int, example_id int, text string, tagged_text string")
        frame = frame.withColumn("corpus", F.lit("k")).repartition(5)
        got = {r.doc_id: r for r in groups.merge_causal_groups(frame).collect()}
        want = text
        for i in range(600):
            for letter, word in (("c", names[i % 300]), ("e", names[(i * 7 + 1) % 300])):
                want = want.replace(word, f"<{letter}{i + 1}>{word}</{letter}{i + 1}>")
        assert got["long"].tagged_text == want and got["long"].example_id == 0
        assert got["a"].tagged_text == "<c1>x</c1> <e1>y</e1>" and "n" not in got
        assert got["m"].tagged_text == "<c1><c2><c3>p</c3></c2></c1> <e1><e2><e3>q</e3></e2></e1>"
        multi = {r.doc_id for r in groups.merge_causal_groups(frame, least=2).collect()}
        assert multi == {"m", "long"}
        assert "collect_list" not in groups.merge_causal_groups(frame)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
