"""Span metrics, token rows and label tensors over whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import Tokenizer, blank_tokens, same_span, span_overlap
from ..functions.tagging import IGNORED_LABEL, attention_mask, pad_to


def explode_tokens(df: DataFrame, *arrays: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per token with its place and its entry of each parallel array."""
    # A plain explode makes Catalyst filter on the array's size first, which
    # computes the array twice; the outer form with a filter behind it does not.
    zipped = df.select(*keep, F.posexplode_outer(F.arrays_zip(*arrays)).alias("pos", "_token"))
    return zipped.where("pos IS NOT NULL").select(
        *keep, "pos", *[F.col(f"_token.{a}").alias(a) for a in arrays]
    )


def tag_inventory(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode_outer(tags).alias("tag")).where("tag IS NOT NULL").distinct()


def tag_counts(df: DataFrame, tags: str = "tags", by: Sequence[str] = ()) -> DataFrame:
    each = df.select(*by, F.explode_outer(tags).alias("tag")).where("tag IS NOT NULL")
    return each.groupBy(*by, "tag").agg(F.count("*").alias("n"))


def _rate(condition: Column) -> Column:
    hits = F.sum(F.when(condition, 1).otherwise(0)).cast("double")
    return (hits / F.count("*")).alias("exact_match")


def exact_match(
    df: DataFrame, guess: str, truth: str, ignore: int = IGNORED_LABEL, by: Sequence[str] = ()
) -> DataFrame:
    """Share of rows whose label arrays agree wherever the truth is not ignored."""
    agree = F.forall(
        F.arrays_zip(F.col(guess).alias("g"), F.col(truth).alias("t")),
        lambda x: (x["t"] == ignore) | x["g"].eqNullSafe(x["t"]),
    )
    return df.groupBy(*by).agg(_rate(agree))


def exact_match_tags(df: DataFrame, guess: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_rate(F.col(guess) == F.col(truth)))


def exact_match_spans(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with both spans right; columns ``true_*`` and ``pred_*``."""
    both = same_span(F.col("true_cause"), F.col("pred_cause")) & same_span(
        F.col("true_effect"), F.col("pred_effect")
    )
    return df.groupBy(*by).agg(_rate(both))


def span_overlap_report(
    df: DataFrame, by: Sequence[str] = (), tokenizer: Tokenizer = blank_tokens
) -> DataFrame:
    """Mean token-set precision, recall and F1 of causes and effects, and their means."""
    scored = df.select(
        *by,
        *[
            span_overlap(F.col(f"true_{part}"), F.col(f"pred_{part}"), tokenizer).alias(part)
            for part in ("cause", "effect")
        ],
    )
    names = ("precision", "recall", "f1")
    means = scored.groupBy(*by).agg(
        *[
            F.avg(f"{part}.{name}").alias(f"{part}_{name}")
            for part in ("cause", "effect")
            for name in names
        ]
    )
    return means.withColumns(
        {name: (F.col(f"cause_{name}") + F.col(f"effect_{name}")) / 2 for name in names}
    )


def token_prf(
    df: DataFrame,
    guess: str,
    truth: str,
    labels: Sequence[int] = (1, 2),
    ignore: int = IGNORED_LABEL,
    by: Sequence[str] = (),
) -> DataFrame:
    """Token precision, recall and F1, averaged over the labels.

    Rows are reduced to counts before the shuffle; tokens are never exploded.
    """
    pairs = F.filter(
        F.arrays_zip(F.col(guess).alias("g"), F.col(truth).alias("t")), lambda x: x["t"] != ignore
    )

    def count(condition) -> Column:
        return F.sum(F.size(F.filter("_pairs", condition))).cast("double")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, 0.0).otherwise(top / bottom)

    def label_counts(v: int) -> list[Column]:
        return [
            count(lambda x: (x["g"] == v) & (x["t"] == v)).alias(f"_hit{v}"),
            count(lambda x: x["g"] == v).alias(f"_guess{v}"),
            count(lambda x: x["t"] == v).alias(f"_true{v}"),
        ]

    counts = (
        df.select(*by, pairs.alias("_pairs"))
        .groupBy(*by)
        .agg(*[column for label in labels for column in label_counts(label)])
    )

    def mean(score) -> Column:
        return sum((score(label) for label in labels), F.lit(0.0)) / len(labels)

    return counts.select(
        *by,
        mean(
            lambda v: ratio(2 * F.col(f"_hit{v}"), F.col(f"_guess{v}") + F.col(f"_true{v}"))
        ).alias("f1"),
        mean(lambda v: ratio(F.col(f"_hit{v}"), F.col(f"_guess{v}"))).alias("precision"),
        mean(lambda v: ratio(F.col(f"_hit{v}"), F.col(f"_true{v}"))).alias("recall"),
    )


def max_length(train: DataFrame, ids: str, special: int, limit: int) -> DataFrame:
    """Longest id array of the training rows plus special tokens, clamped to the model's limit."""
    longest = F.max(F.size(ids)) + special
    return train.agg(F.least(longest, F.lit(limit)).alias("max_length"))


def pad_inputs(df: DataFrame, ids: str, length: DataFrame, pad: int) -> DataFrame:
    """Cut or pad the ids to a one-value frame ``length`` and add the attention mask."""
    sized = df.withColumn("_length", length.scalar())
    return sized.withColumns(
        {
            ids: pad_to(F.col(ids), F.col("_length"), pad),
            "attention_mask": attention_mask(F.col(ids), F.col("_length")),
        }
    ).drop("_length")
