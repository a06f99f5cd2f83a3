"""Classification reports from a confusion table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_position


def confusion(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Count rows per true and predicted class; everything else derives from this table."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(
        F.count("*").alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _total(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double")


def _label_counts(label) -> tuple[Column, Column, Column]:
    """Rows of a label that are hit, predicted and true."""
    truth, guess = F.col("truth") == label, F.col("guess") == label
    return _total(truth & guess), _total(guess), _total(truth)


def _averaged(labels: Sequence, average: str, score: Callable[..., Column]) -> Column:
    counts = [_label_counts(label) for label in labels]
    if average == "micro":
        return score(*[reduce(lambda a, b: a + b, column) for column in zip(*counts)])
    if average == "binary" and len(labels) != 1:
        raise ValueError("binary scores need exactly one label")
    if average not in ("binary", "macro"):
        raise ValueError(f"unknown average {average!r}")
    return reduce(lambda a, b: a + b, [score(*c) for c in counts]) / len(counts)


def accuracy(labels: Sequence = (), average: str = "") -> Column:
    return _total(F.col("truth") == F.col("guess")) / F.sum("n")


def precision(labels: Sequence, average: str) -> Column:
    return _averaged(labels, average, lambda hit, guessed, true: _ratio(hit, guessed))


def recall(labels: Sequence, average: str) -> Column:
    return _averaged(labels, average, lambda hit, guessed, true: _ratio(hit, true))


def f1(labels: Sequence, average: str) -> Column:
    return _averaged(labels, average, lambda hit, guessed, true: _ratio(2 * hit, guessed + true))


# Metrics by name; each is an aggregate over the confusion table. Add your own here.
METRICS: dict[str, Callable[[Sequence, str], Column]] = {
    "accuracy": accuracy,
    "f1": f1,
    "precision": precision,
    "recall": recall,
}


def score(
    table: DataFrame,
    labels: Sequence,
    average: str,
    by: Sequence[str] = (),
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Named metrics over a confusion table, in one aggregation."""
    return table.groupBy(*by).agg(*[METRICS[m](labels, average).alias(m) for m in metrics])


def classification_report(
    df: DataFrame, truth: str, guess: str, labels: Sequence, average: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, F1, precision and recall over the given labels, per slice ``by``."""
    return score(confusion(df, truth, guess, by), labels, average, by)


def label_scores(table: DataFrame, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """One row per given label: precision, recall, F1 and support."""
    rows = []
    for label in labels:
        hit, guessed, true = _label_counts(label)
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                _ratio(hit, guessed).alias("precision"),
                _ratio(hit, true).alias("recall"),
                _ratio(2 * hit, guessed + true).alias("f1"),
                true.cast("bigint").alias("support"),
            )
        )
    return table.groupBy(*by).agg(F.array(*rows).alias("_rows")).select(*by, F.inline("_rows"))


def class_recall(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall of every class seen as truth or prediction, and its place in sorted order.

    A class never true has recall 0. Places come from a distributed sort of the distinct
    classes, so their number is not bounded by a task, with or without ``by``.
    """
    sides = F.array(
        F.struct(
            F.col("truth").alias("class"),
            F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit"),
            F.col("n").alias("true"),
        ),
        F.struct(
            F.col("guess").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("true")
        ),
    )
    classes = (
        table.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("hit").cast("double").alias("hit"), F.sum("true").alias("true"))
    )
    placed = with_position(classes, [*by, "class"], "_place")
    index = F.col("_place") - 1
    if by:
        named = [F.col(b).alias(f"_{b}") for b in by]
        firsts = placed.groupBy(*named).agg(F.min("_place").alias("_first"))
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
        placed, index = placed.join(firsts, same), F.col("_place") - F.col("_first")
    return placed.select(*by, "class", index.alias("class_index"), _ratio(F.col("hit"), F.col("true")).alias("recall"))


def report_rows(scores: DataFrame, recalls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A full report as rows ``metric, value``: the scores, and ``accuracy_<i>`` for every class.

    However many classes there are, no cell and no task holds all of them.
    """
    names = [c for c in scores.columns if c not in by]
    listed = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    named = F.concat(F.lit("accuracy_"), F.col("class_index").cast("string")).alias("metric")
    return scores.select(*by, F.inline(listed)).unionByName(recalls.select(*by, named, F.col("recall").alias("value")))


def with_class_recall(report: DataFrame, recalls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the recalls to a report as a map ``accuracy_0``, ``accuracy_1``, ...

    For reports of one record with few classes; `report_rows` has no such bound.
    """
    named = F.struct(F.concat(F.lit("accuracy_"), "class_index").alias("key"), F.col("recall"))
    maps = recalls.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("class_accuracy")
    )
    if by:
        return report.join(maps, list(by))
    return report.withColumn("class_accuracy", maps.scalar())


def round_metrics(df: DataFrame, columns: Sequence[str], digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def corpus_profile(df: DataFrame, corpus: str, label: str) -> DataFrame:
    """Rows, positives and negatives per corpus and split, with subtotals (NULL keys)."""
    return df.rollup(corpus, "split").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    )


def select_best(log: DataFrame, run: str = "lr", epoch: str = "epoch") -> DataFrame:
    """The best epoch of the best run by validation accuracy.

    ``log`` has one row per run, epoch and split with its ``accuracy``. Ties go
    to the earlier epoch, then to the smaller ``run`` (give the place in the
    list of learning rates to keep that order).
    """
    metrics = [c for c in log.columns if c not in (run, epoch, "split")]
    wide = log.groupBy(run, epoch).agg(
        *[
            F.max(F.when(F.col("split") == split, F.col(metric))).alias(f"{split}_{metric}")
            for split in ("valid", "test")
            for metric in metrics
        ]
    )
    row = F.struct(*wide.columns)
    by_epoch = wide.groupBy(run).agg(
        F.max_by(row, F.struct("valid_accuracy", -F.col(epoch))).alias("row")
    )
    best = by_epoch.select("row.*").agg(
        F.max_by(row, F.struct("valid_accuracy", -F.col(run))).alias("row")
    )
    return best.select("row.*")
