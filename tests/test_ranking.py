"""Places, borders and class indices that no single task has to see whole."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import ranking, report, splits
from test_plans import plan


def largest_task(frame):
    return max(frame.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"])


def test_positions_follow_the_order(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1, 2, 3, 3, 3]) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(values)), "id int, k int").repartition(7)
    got = sorted((r.position, r.k) for r in ranking.with_position(frame, ["k"]).collect())
    assert [p for p, _ in got] == list(range(1, 201))
    assert [k for _, k in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    last = ranking.with_position(frame, [F.col("k").asc_nulls_last()], "place")
    assert max((r.place, r.k) for r in last.where("k IS NOT NULL").collect()) == (200 - values.count(None), 3)
    assert ranking.with_position(frame.limit(0), ["k"]).collect() == []


def test_input_positions_keep_the_order_of_a_sort(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).orderBy("k")
    assert all(r.position == r.k + 1 for r in ranking.with_input_position(frame).collect())


def test_dense_rank(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("B",)], "k string")
    assert {r.k: r["rank"] for r in ranking.dense_rank(frame, "k").collect()} == {None: 1, "B": 2, "a": 3, "b": 4}


def test_one_key_is_cut_exactly_and_spread(spark):
    """All rows share their key, so any border falls among them."""
    frame = spark.range(20_000, numPartitions=8).select(F.lit("same").alias("k"), "id")
    parts = splits.split_80_10_10(frame, 4, ["k"])
    assert {r.split: r.n_rows for r in splits.split_sizes(parts).collect()} == {"train": 16000, "valid": 2000, "test": 2000}
    assert parts.select("id").distinct().count() == 20_000
    ranked = splits.global_rank(frame, 4, ["k"])
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(1, 20_001))
    for frame in (parts, ranked):
        assert "Window" not in plan(frame, "simple")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # no partition of the sort holds much more than its share
        assert largest_task(ranking._ordered(frame.select("k", "id"), ["k"])) <= 1.5 * 20_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_cut_without_torn_keys_moves_no_rows(spark):
    text = plan(splits.split_80_10_10(spark.range(1000), 4, ["id"]), "simple")
    assert "Exchange" not in text and "Join" not in text and "Window" not in text


@pytest.mark.parametrize("distinct", [1, 5, 300, 10**6])
def test_head_of_any_size(spark, monkeypatch, distinct):
    monkeypatch.setattr(splits, "TOP", 10)
    monkeypatch.setattr(splits, "BETWEEN", 50)
    monkeypatch.setattr(splits, "PIVOTS", 4)
    rng = random.Random(distinct)
    rows = [(rng.choice([None, "x", "y"]), rng.randrange(distinct), i) for i in range(700)]
    frame = spark.createDataFrame(rows, "a string, b int, id int").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    ordered = sorted(map(key, rows))
    for n in (0, 1, 11, 233, 350, 699, 700, 900):
        got = [tuple(r) for r in splits.head(frame, n, ["a", "b"]).collect()]
        assert sorted(map(key, got)) == ordered[:n], n
        assert len({r[2] for r in got}) == min(n, 700)


def test_head_of_half_a_table_is_a_filter(spark):
    frame = spark.range(50_000, numPartitions=8).select((F.col("id") * 7919 % 50_000).alias("k"))
    half = splits.head(frame, 25_000, ["k"])
    assert half.count() == 25_000 and half.agg(F.max("k")).first()[0] == 24_999
    text = plan(half, "simple")
    assert "Exchange" not in text and "TakeOrdered" not in text and "GlobalLimit" not in text


def test_many_classes(spark):
    frame = spark.range(3000).select(F.lit(0).alias("s"), F.format_string("c%06d", "id").alias("t"), F.lit("c000001").alias("p"))
    table = report.confusion(frame, "t", "p")
    recalls = report.class_recall(table)
    assert "Window" not in plan(recalls, "simple") and "SinglePartition" not in plan(recalls, "simple")
    got = {r["class"]: (r.class_index, r.recall) for r in recalls.collect()}
    assert got == {f"c{i:06}": (i, float(i == 1)) for i in range(3000)}
    rows = report.report_rows(report.score(table, ["c000001"], "binary"), recalls)
    assert {r.metric: r.value for r in rows.collect()}["accuracy_1"] == 1.0 and rows.count() == 3004


def test_class_indices_begin_anew_in_each_slice(spark):
    rows = [("x", "b", "a"), ("y", "c", "c"), ("y", "d", "c"), (None, "e", "e")]
    frame = spark.createDataFrame(rows, "s string, t string, p string")
    recalls = report.class_recall(report.confusion(frame, "t", "p", ["s"]), ["s"]).collect()
    assert {(r.s, r["class"]): (r.class_index, r.recall) for r in recalls} == {
        ("x", "a"): (0, 0.0), ("x", "b"): (1, 0.0), ("y", "c"): (0, 1.0), ("y", "d"): (1, 0.0), (None, "e"): (0, 1.0)
    }
