"""The plans keep to what they promise: no Python, no shuffle where none is needed."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from causeway.plans.registry import QUERIES
from causeway.operators import filters, groups, skew, splits

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# The only queries that may run Python: a user's scorer, and the streamed merge
# of very long groups.
WITH_PYTHON = {
    "scored_prompts",
    "merged_groups",
    "merged_multi",
    "numbered_spans",
    "explicit_merged",
    "load_span_corpus",
}


def plan(frame, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


@needs_tables
def test_no_python_in_built_in_operators(spark):
    for name, query in QUERIES.items():
        if name.startswith(("scan_", "load_")) or name.endswith("_sink") or name in WITH_PYTHON:
            continue
        text = plan(query(spark, SF_DIR), "simple")
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups", text), name


@needs_tables
def test_no_cross_join_between_tables(spark):
    for name, query in QUERIES.items():
        if name.startswith(("scan_", "load_")) or name.endswith("_sink"):
            continue
        text = plan(query(spark, SF_DIR), "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def exchanges(frame):
    return plan(frame, "simple").count("Exchange hashpartitioning")


def test_row_filters_do_not_shuffle(spark):
    frame = spark.createDataFrame([("a", "<c>a</c><e>b</e>", 1)], "text string, tagged_text string, num_sents int")
    for out in (
        filters.filter_plicit(frame, "explicit"),
        filters.filter_nested(frame),
        filters.filter_num_sents(frame, "intra"),
        filters.filter_sentence_count(frame, "inter"),
    ):
        assert "Exchange" not in plan(out, "simple")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "pairs")
    frame = spark.createDataFrame([(0, 1, "a", "b")], "eg_id int, pair_label int, text string, other string")
    frame.write.parquet(path)
    text = plan(filters.positive_pairs(spark.read.parquet(path)).select("text"))
    assert "EqualTo(pair_label,1)" in text
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "other" not in schema and "eg_id" not in schema


def test_split_reads_rows_once_and_moves_none(spark, tmp_path):
    """With unique keys the rows go through a projection; only hashes are counted and sorted."""
    path = str(tmp_path / "rows")
    spark.range(100).withColumn("text", F.lit("x")).write.parquet(path)
    parts = splits.split_80_10_10(spark.read.parquet(path), 1, ["id"])
    assert len(parts.collect()) == 100
    final = plan(parts, "simple").split("Initial Plan")[0]
    main = final.split("Subquer")[0]
    assert "Exchange" not in main and "Window" not in main and "Join" not in main


def test_group_sizes_are_counted_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id % 3 AS k", "id AS v").write.parquet(path)
    text = plan(skew.with_group_size(spark.read.parquet(path), ["k"], "n"), "simple")
    assert "partial_count" in text


def test_merge_is_one_aggregation_without_python(spark, tmp_path):
    path = str(tmp_path / "rows")
    schema = "corpus string, doc_id string, sent_id bigint, example_id bigint, text string, tagged_text string"
    spark.createDataFrame([("c", "d", 1, 0, "a b", "<c>a</c> <e>b</e>")], schema).write.parquet(path)
    merged = groups.merge_causal_groups(spark.read.parquet(path))
    text = plan(merged, "simple")
    assert "Window" not in text and "Join" not in text and "Python" not in text
    assert text.count("FileScan") == 1 and exchanges(merged) == 1
    assert [r.tagged_text for r in merged.collect()] == ["<c1>a</c1> <e1>b</e1>"]
