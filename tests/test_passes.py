"""How often queries compute what is dear, and that the cheap ways give the same."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.functions import markup, tagging
from causeway.operators import dedup, prompting
from causeway.plans import evaluate, route_queries
from causeway.plans.registry import QUERIES
from causeway.sources import ranges, readers, scratch
from causeway.sources.rules import SPAN

SF = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def counted(spark):
    """A function that lets an array through and counts the rows that it sees."""
    seen = spark.sparkContext.accumulator(0)

    def through(kind):
        def count(value):
            seen.add(1)
            return value

        return F.udf(count, kind).asNondeterministic()

    return seen, through


def test_predictions_beside_references_are_made_once(spark, counted, monkeypatch):
    seen, through = counted
    made = scratch.staged(route_queries._word_predictions(spark, SF))
    want = made.count()
    monkeypatch.setattr(route_queries, "_word_predictions", lambda *_: made.withColumn("pred", through("array<string>")("pred")))
    assert QUERIES["word_pairs_by_position"](spark, SF).count() == want
    assert seen.value == want


def test_scores_of_tokens_are_read_once(spark, counted):
    seen, through = counted
    tokens = [([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1, -100, 2]), ([[0.0, 1.0, 0.0]], [0])]
    rows = spark.createDataFrame(tokens, "scores array<array<double>>, labels array<int>")
    got = evaluate.encoder_report(rows.withColumn("scores", through("array<array<double>>")("scores")), SPAN).first()
    assert (got.accuracy, got.exact_match) == pytest.approx((2 / 3, 0.5))
    assert seen.value == 2


def test_valid_and_rejected_tags_come_from_one_pass(spark):
    assert "Union" not in optimized(QUERIES["tag_quarantine"](spark, SF))


def test_ids_are_made_once(spark):
    plan = optimized(QUERIES["pad_mask"](spark, SF))
    assert plan.count("conv(") == 1
    plan = optimized(QUERIES["concat_sep"](spark, SF))
    assert plan.index("Generate explode") < plan.index("conv(")  # below the windows


def test_aligned_tags_by_runs_and_by_steps_agree(spark):
    texts = ["", "plain", "<c>ab</c> and <e>c</e>", "<c1>x</c1><e1>yz</e1>", "<e></e>q<c>é😀</c>", "a < b", "<c>all</c>", "x<c>y", "</c>x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("tokens", F.split(markup.untag(F.col("t")), ""))
    got = rows.select("t", "tokens", tagging.aligned_tags(F.col("t"), F.col("tokens")).alias("tags"))
    for text, tokens, tags in got.collect():
        at, then, want = 0, "O", []
        for token in tokens:
            first = None
            if text[at:].startswith("</"):
                at, then = text.index(">", at) + 1, "O"
            if text[at:].startswith(("<c", "<e")):
                kind = text[at + 1].upper()
                at, then, first = text.index(">", at) + 1, f"I-{kind}", f"B-{kind}"
            want.append(first or then)
            at += len(token)
        if "<e></e>" not in text:
            assert tags == want, text
    plain = spark.createDataFrame([("no tags",), ("<b1>a</b1>",), (None,)], "t string")
    got = plain.select(markup.strip_clues(F.col("t")).alias("t"), markup.has_crossing(F.col("t")).alias("x")).collect()
    assert [tuple(r) for r in got] == [("no tags", False), ("<c>a</c>", False), (None, None)]


def test_predictions_are_read_by_several_tasks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = QUERIES["prediction_sink"](spark, SF)
        files = len(read.inputFiles())
        assert read.rdd.getNumPartitions() > 3 * files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_are_worked_on_in_stretches():
    values = pa.array(["x" * 100_000] * 500 + ["y" * (ranges.STRETCH + 1), "", "z"])
    batch = pa.RecordBatch.from_arrays([values, pa.array(["f"] * 503), pa.array([0] * 503)], names=["value", "file", "block"])
    parts = [part for _, part in ranges._runs(iter([batch]))]
    assert [v for part in parts for v in part.to_pylist()] == values.to_pylist()
    assert all(len(part) == 1 or sum(map(len, part.to_pylist())) <= ranges.STRETCH for part in parts)


def test_digests_of_texts_travel_as_bytes(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "text string, row_id long")
    assert sorted(r.row_id for r in dedup.keep_first(rows).collect()) == [1, 2, 4]
    assert [r.row_id for r in dedup.keep_unique(rows).collect()] == [2]
    by_text = dedup._by_text(rows, "text", "row_id")
    assert "unhex" in optimized(by_text)


def test_rows_of_resumed_prompts_are_made_once(spark, counted, tmp_path):
    seen, through = counted
    rows = spark.range(20).select("id", F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("prompt"))
    rows = scratch.staged(rows).withColumn("prompt", through("string")("prompt"))
    got = prompting.score_resumed(rows, lambda batch: batch + "!", [], str(tmp_path / "kept"), rounds=2).collect()
    assert sorted((r.id, r.output) for r in got) == [(i, f"p{i % 7}!") for i in range(20)]
    assert seen.value == 20


def test_ranges_that_end_with_a_record_are_not_read_for_torn_ones(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    class Counted(ranges._QuotedLines):
        def feed(self, lines, *torn):
            seen.add(len(lines))
            return super().feed(lines, *torn)

    monkeypatch.setattr(ranges, "_QuotedLines", Counted)
    rows = [("n", "v")] + [(str(i), "x" * (i % 50)) for i in range(2000)]
    path = tmp_path / "plain.csv"
    path.write_text("".join(f'{n},"{v}"\n' for n, v in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = ranges.read_quoted_csv(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.n, r.v or "") for r in got) == sorted(rows[1:])
    assert seen.value == len(rows)


def test_plain_numbers_and_others_agree(spark):
    texts = ["1", "1.0", " 7 ", "+5", "-3", "1e3", "", "x", "12\n", "9" * 18, "9" * 19, "9223372036854775807", "0012", "1.5", "٣", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    number = F.col("t").try_cast("decimal(38,10)")
    want = F.when(number == F.floor(number), number.try_cast("bigint"))
    got = rows.select("t", readers.whole_number(F.col("t")).alias("got"), want.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert "RLIKE" in optimized(rows.select(readers.whole_number(F.col("t"))))


def test_phrases_are_cut_out_behind_the_sort(spark, monkeypatch):
    plans = []
    write = route_queries._write_csv

    def kept(df, path, sep):
        plans.append(optimized(df))
        write(df, path, sep)

    monkeypatch.setattr(route_queries, "_write_csv", kept)
    assert QUERIES["load_phrase_corpus"](spark, SF).count() > 0
    assert len(plans) == 2
    for plan in plans:
        above, below = plan.split("Sort [", 1)
        assert "regexp_extract(" in above and "regexp_extract(" not in below


def test_a_scorer_gets_some_prompts_at_a_time(spark):
    rows = spark.range(0, 4000, 1, 1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("é"), 500)).alias("prompt"))

    def size(batch):
        return pd.Series([str(batch.str.encode("utf-8").str.len().sum())] * len(batch)).where(batch.notna(), None)

    got = prompting.score_prompts(rows, size).orderBy("id").collect()
    assert [r.output is None for r in got] == [i % 9 == 0 for i in range(4000)]
    assert max(float(r.output) for r in got if r.output) <= prompting.AT_ONCE
