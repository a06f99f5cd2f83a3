"""Files of corpora, and what is staged of them, take no more room than they must."""

import os

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from causeway.operators import dedup, splits
from causeway.plans.registry import QUERIES
from causeway.sources import corpora, scratch
from test_disk import folders
from test_plans import SF_DIR, needs_tables, plan


def numbered(spark):
    texts = ["a", "b", "a", None, None, "c", "a", "b"]
    places = [0, 1, 7, 8, 32767, 32768, 10**15, 10**15 + 40000]
    return scratch.staged(spark.createDataFrame(list(zip(texts, places, texts)), "text string, row_id long, more string"))


@pytest.mark.parametrize("most", [25_000, 0])
def test_numbered_rows_are_chosen_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "BITMAPS", most)
    rows = numbered(spark)
    for keep in (dedup.keep_first, dedup.keep_unique):
        chosen = keep(rows, numbered=True)
        assert sorted(map(str, chosen.select(*rows.columns).collect())) == sorted(map(str, keep(rows).select(*rows.columns).collect()))
        assert ("Exchange hashpartitioning" in plan(chosen, "simple")) == (most == 0)


def test_texts_of_pairs_are_staged_once(spark):
    schema = "doc_id string, eg_id long, text string, text_w_pairs string"
    rows = spark.createDataFrame(
        [
            ("d1", 0, "a b", "<ARG0>a</ARG0> <ARG1>b</ARG1>"),
            ("d2", 0, "omitted b", "<ARG0>a</ARG0> <ARG1>b</ARG1>"),
            ("d3", 0, "plain", "plain"),
            ("d4", 0, None, "<ARG0>a</ARG0>"),
            ("d5", 0, "a", None),
            ("d6", 0, None, None),
        ],
        schema,
    )
    before = folders(spark)
    kept = corpora._staged_pairs(rows)
    assert kept.schema == rows.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    (folder,) = folders(spark) - before
    held = {r.doc_id: r.text for r in spark.read.parquet(folder).collect()}
    assert held == {"d1": None, "d2": "omitted b", "d3": None, "d4": None, "d5": "a", "d6": None}


def csv_folders(made):
    local = [f.removeprefix("file://").removeprefix("file:") for f in made]
    return [d for f in local for d, _, files in os.walk(f) if any(x.endswith((".csv", ".csv.gz")) for x in files)]


def test_hashes_of_a_split_go(spark):
    before = folders(spark)
    parts = splits.split_80_10_10(spark.range(50), 1, ["id"])
    assert folders(spark) == before
    assert parts.groupBy("split").count().where("split = 'train'").first()["count"] == 40


@needs_tables
@pytest.mark.parametrize("name", ["load_cross_corpus", "load_all"])
def test_files_of_a_corpus_go_when_it_is_staged(spark, name):
    before = folders(spark)
    loaded = QUERIES[name](spark, SF_DIR)
    assert not csv_folders(folders(spark) - before)
    assert loaded.count()
