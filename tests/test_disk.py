"""Intermediate files go as soon as nothing reads them."""

import os
import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import jaccard, lines
from causeway.sources import scratch


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def folders(spark):
    made = {folder for _, folder in scratch._MADE}
    return {f for f in made if os.path.isdir(f.removeprefix("file://").removeprefix("file:"))}


def gone_at_last(files, before):
    for _ in range(100):
        if not files() - before:
            return True
        time.sleep(0.1)
    return False


def test_shuffles_go_when_rows_are_staged(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    kept = scratch.staged(rows)
    assert gone_at_last(lambda: shuffle_files(spark), before)
    assert sorted(tuple(r) for r in kept.collect()) == [(k, 100) for k in range(10)]
    assert spark.conf.get(scratch._CLEANUP, "false") == "false"


def test_settled_keeps_its_result_only(spark):
    before = folders(spark)

    def inner():
        return scratch.staged(scratch.staged(spark.range(10)).where("id > 3"))

    def outer():
        found = scratch.settled(inner)
        assert len(folders(spark) - before) == 1
        return found.where("id > 5")

    kept = scratch.settled(outer)
    assert len(folders(spark) - before) == 1
    assert sorted(r.id for r in kept.collect()) == [6, 7, 8, 9]


def line_documents(spark):
    rng = random.Random(5)
    words = ["w%03d" % i for i in range(300)]
    texts = ["\n".join(" ".join(rng.choices(words, k=8)) for _ in range(4)) for _ in range(40)]
    texts += [texts[i] + "\n" + texts[i + 1].replace("w00", "w01") for i in range(10)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (99, "")], "doc_id long, text string")


def test_line_dedup_leaves_occurrences_and_groups_only(spark):
    before = folders(spark)
    gone = lines.repeated_lines(line_documents(spark))
    assert len(folders(spark) - before) == 2
    assert gone.count() >= 10


def test_texts_outside_of_families_stay_where_they_are(spark, monkeypatch):
    """Lines that share a key by chance, but are not near, are not sent to where families are compared."""
    sharing, seen = [], []
    filter_of, whole = lines.bloom, lines.family_components

    def counted(nodes):
        sharing.append(nodes.distinct().count())
        return filter_of(nodes)

    def spied(families, payload, *args, **more):
        seen.append((families.select("node").distinct().count(), payload.count(), families.join(payload, "node").count()))
        return whole(families, payload, *args, **more)

    monkeypatch.setattr(lines, "bloom", counted)
    monkeypatch.setattr(lines, "family_components", spied)
    rng = random.Random(3)
    drawn = lambda n: "".join(rng.choices("abcdefghij", k=n))
    start = drawn(40)
    texts = [f"{start} {drawn(100)}" for _ in range(200)]
    texts += [texts[0] + "x", texts[1] + "y"]
    gone = lines.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.id for r in gone.collect()) == [200, 201]
    ((members, sent, joined),) = seen
    assert sent == joined == members < sharing[0] / 2


def test_filter_of_nodes_has_no_shuffle_left(spark):
    before = shuffle_files(spark)
    bitmap = jaccard.bloom(spark.range(100).select(F.xxhash64("id").alias("node")).repartition(3))
    assert bitmap.any()
    assert gone_at_last(lambda: shuffle_files(spark), before)


def test_a_stage_leaves_its_documents_only(spark, monkeypatch):
    def first(spark, docs, sf_dir):
        return scratch.staged(scratch.staged(docs.where("doc_id > 1")).where("doc_id > 2"))

    def last(spark, docs, sf_dir):
        return docs

    rows = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), ("second", first), ("last", last)])
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: rows)
    before = folders(spark)
    out = corpus_pipeline.run(spark, "nowhere")
    assert len(folders(spark) - before) == 2
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5]
