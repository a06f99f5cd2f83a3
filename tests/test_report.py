import math

import pytest
from pyspark.sql import functions as F

from causeway.functions.parsing import parse_class, response_spans, sentence_count, span_overlap, unwrap, word_response
from causeway.operators import report, spans

# Classes and scores of published tests, here and below.
TRUE = ["cat"] * 6 + ["pig"] * 6
PRED = ["cat"] * 3 + ["pig", "other", "other"] + ["cat"] * 2 + ["pig"] + ["other"] * 3


@pytest.mark.parametrize(
    "average, labels, expected",
    [
        ("macro", ["cat", "pig"], [0.333, 0.55, 0.333, 0.398]),
        ("binary", ["cat"], [0.333, 0.6, 0.5, 0.545]),
        ("binary", ["pig"], [0.333, 0.5, 0.167, 0.25]),
        ("micro", ["cat", "pig"], [0.333, 0.571, 0.333, 0.421]),
    ],
)
def test_scores(spark, average, labels, expected):
    rows = spark.createDataFrame(list(zip(TRUE, PRED)), "t string, p string")
    got = report.classification_report(rows, "t", "p", labels, average).first()
    for name, value in zip(("accuracy", "precision", "recall", "f1"), expected):
        assert math.isclose(got[name], value, abs_tol=1e-3), name


def test_binary_needs_one_label(spark):
    rows = spark.createDataFrame([("a", "a")], "t string, p string")
    with pytest.raises(ValueError):
        report.classification_report(rows, "t", "p", ["a", "b"], "binary")
    with pytest.raises(ValueError):
        report.classification_report(rows, "t", "p", ["a"], "weighted")


def test_class_recall(spark):
    """Places go over the sorted union of true and predicted classes."""
    rows = spark.createDataFrame(list(zip(TRUE, PRED)), "t string, p string")
    table = report.confusion(rows, "t", "p")
    got = {r["class"]: (r.class_index, r.recall) for r in report.class_recall(table).collect()}
    assert got == {"cat": (0, 0.5), "other": (1, 0.0), "pig": (2, 1 / 6)}
    full = report.with_class_recall(
        report.score(table, ["cat"], "binary"), report.class_recall(table)
    ).first()
    assert full.class_accuracy == {"accuracy_0": 0.5, "accuracy_1": 0.0, "accuracy_2": 1 / 6}


def test_own_metric(spark):
    report.METRICS["rows"] = lambda labels, average: F.sum("n")
    try:
        rows = spark.createDataFrame(list(zip(TRUE, PRED)), "t string, p string")
        table = report.confusion(rows, "t", "p")
        assert report.score(table, ["cat"], "binary", metrics=["rows", "recall"]).first() == (12, 0.5)
    finally:
        del report.METRICS["rows"]


@pytest.mark.parametrize(
    "pred, ref, expected",
    [
        ([[0, 1], [1, 1]], [[0, 0], [0, 1]], 0.0),
        ([[0, 1], [1, 1]], [[0, 1], [0, 1]], 0.5),
        ([[0, 4, 6], [2, 5, 3]], [[0, 1, -100], [2, -100, 3]], 0.5),
    ],
)
def test_exact_match(spark, pred, ref, expected):
    rows = spark.createDataFrame(list(zip(pred, ref)), "p array<int>, r array<int>")
    assert spans.exact_match(rows, "p", "r").first().exact_match == expected


def test_token_prf(spark):
    refs, preds = [1, 0, 2, 2, 0, 0, 1, 0, 0], [1, 0, 0, 2, 0, 1, 1, 0, 0]
    rows = spark.createDataFrame(
        [(preds[:4], refs[:4]), (preds[4:] + [1], refs[4:] + [-100])], "p array<int>, r array<int>"
    )
    got = spans.token_prf(rows, "p", "r").first()
    for name, value in {"f1": 0.733, "precision": 0.83, "recall": 0.75}.items():
        assert math.isclose(got[name], value, rel_tol=0.01)


def test_select_best(spark):
    log = [
        (0, 1, "valid", 0.5), (0, 1, "test", 0.1), (0, 2, "valid", 0.8), (0, 2, "test", 0.2),
        (0, 3, "valid", 0.8), (0, 3, "test", 0.3), (1, 1, "valid", 0.8), (1, 1, "test", 0.9),
    ]
    frame = spark.createDataFrame(log, "lr int, epoch int, split string, accuracy double")
    best = report.select_best(frame).first()
    assert (best.lr, best.epoch, best.valid_accuracy, best.test_accuracy) == (0, 2, 0.8, 0.2)


def test_round(spark):
    frame = spark.createDataFrame([(1 / 3,)], "f1 double")
    assert report.round_metrics(frame, ["f1"]).first().f1 == 0.33333


@pytest.mark.parametrize(
    "truth, guess, expected",
    [("", "", (1.0, 1.0, 1.0)), ("a b", "c", (0.0, 0.0, 0.0)), ("a b b", "a", (1.0, 0.5, 2 / 3))],
)
def test_span_overlap(spark, truth, guess, expected):
    row = spark.createDataFrame([(truth, guess)], "t string, g string")
    got = row.select(span_overlap(F.col("t"), F.col("g")).alias("s")).first().s
    assert tuple(got) == pytest.approx(expected)


def test_span_overlap_takes_a_tokenizer(spark):
    row = spark.createDataFrame([("雨と風", "風")], "t string, g string")
    by_character = lambda c: F.split(c, "")
    got = row.select(span_overlap(F.col("t"), F.col("g"), by_character).alias("s")).first().s
    assert tuple(got) == pytest.approx((1.0, 1 / 3, 0.5))
    empty = spark.createDataFrame([("", "")], "t string, g string")
    no_tokens = lambda c: F.filter(F.split(c, ""), lambda t: t != "")
    assert tuple(empty.select(span_overlap(F.col("t"), F.col("g"), no_tokens).alias("s")).first().s) == (1, 1, 1)


@pytest.mark.parametrize("output, expected", [("it is N12.", "12"), ("no", "-1"), ("N N0 N1", "0")])
def test_parse_class(spark, output, expected):
    row = spark.createDataFrame([(output,)], "o string")
    assert row.select(parse_class(F.col("o")).alias("p")).first().p == expected


@pytest.mark.parametrize(
    "output, cause, effect",
    [
        ("Causes: [a] [b]\nEffects: [c]", "a b", "c"),
        ("Causes: x\nCauses: y", " y", ""),
        ("Causes: a Effects: b", " a Effects: b", ""),
        ("nothing", "", ""),
        ("Effects: [a]\nEffects: []", "", " []"),
    ],
)
def test_response_spans(spark, output, cause, effect):
    row = spark.createDataFrame([(output,)], "o string")
    got = row.select(
        unwrap(response_spans(F.col("o"), "Causes:")).alias("c"),
        unwrap(response_spans(F.col("o"), "Effects:")).alias("e"),
    ).first()
    assert (got.c, got.e) == (cause, effect)


def test_word_response(spark):
    row = spark.createDataFrame([("[Labels]\na: B-C\nb: O\nc: O\nd: O", ["a", "b"])], "o string, t array<string>")
    got = row.select(word_response(F.col("o"), F.col("t"), "[Labels]\n", ": ").alias("p")).first().p
    assert got == ["B-C", "O"]
    row = spark.createDataFrame([("x: O", ["a", "b"])], "o string, t array<string>")
    got = row.select(word_response(F.col("o"), F.col("t"), "[Labels]\n", ": ").alias("p")).first().p
    assert got == ["x: O", ""]


def test_sentence_count(spark):
    texts = ["", "One.", "One. Two!", "A 3.5 rise? Yes.\nNo", "  lead. "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(sentence_count(F.col("t")).alias("n"), sentence_count(F.col("t"), True).alias("m"))
    assert [r.n for r in got.collect()] == [0, 1, 2, 3, 1]
    assert [r.m for r in got.collect()] == [0, 1, 2, 3, 1]
