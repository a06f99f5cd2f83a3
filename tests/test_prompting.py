"""Scoring that goes on where it stopped, and rows paired by place."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.operators import prompting


def asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().splitlines())


def test_a_scorer_that_dies_is_not_asked_again(spark, tmp_path):
    calls, kept = str(tmp_path / "calls"), str(tmp_path / "kept")
    os.mkdir(calls)
    frame = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(None, "p-"), (3, "p3")], "id int, prompt string")

    def scorer(limit):
        def score(batch):
            if len(asked(calls)) > limit:
                raise RuntimeError("gone")
            with open(os.path.join(calls, f"{os.getpid()}"), "a") as out:
                out.writelines(f"{p}\n" for p in batch)
            return batch.str.upper()

        return score

    with pytest.raises(Exception, match="gone"):
        prompting.score_resumed(frame, scorer(15), ["id"], kept, rounds=8)
    before = len(asked(calls))
    done = prompting.finished_outputs(spark, kept, frame.schema).count()
    assert 15 < before < 41 and done == before
    got = prompting.score_resumed(frame, scorer(1000), ["id"], kept, rounds=8).collect()
    assert sorted((r.id is None, r.id or 0, r.output) for r in got) == sorted(
        [(False, i, f"P{i}") for i in range(40)] + [(True, 0, "P-"), (False, 3, "P3")]
    )
    assert len(asked(calls)) == len(set(asked(calls))) == 41
    # Another prompt under a known key is asked; the rest is not.
    more = frame.withColumn("prompt", F.when(F.col("id") == 7, "new").otherwise(F.col("prompt")))
    again = {r.id: r.output for r in prompting.score_resumed(more, scorer(1000), ["id"], kept, rounds=8).collect()}
    assert again[7] == "NEW" and again[8] == "P8" and len(asked(calls)) == 42


def test_nothing_to_score(spark, tmp_path):
    frame = spark.createDataFrame([], "id int, prompt string")
    assert prompting.score_resumed(frame, lambda batch: batch, ["id"], str(tmp_path)).collect() == []


def test_rows_pair_by_place(spark):
    left = spark.range(500).select((F.col("id") * 3).alias("k"), F.lit("l").alias("side")).orderBy("k")
    right = spark.range(480).select((F.col("id") * 5).alias("n"), F.lit("r").alias("side")).repartition(7).orderBy("n")
    got = sorted(tuple(r) for r in prompting.pair_by_position(left, right).collect())
    assert got == [(5 * i, "r", 3 * i) for i in range(480)]
    by_order = prompting.pair_by_position(
        left.select(F.col("k").alias("o"), (F.col("k") + 1).alias("x")), right.select(F.col("n").alias("o")), ["o"]
    )
    assert sorted(map(tuple, by_order.collect())) == [(5 * i, 3 * i + 1) for i in range(480)]
