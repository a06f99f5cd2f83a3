"""Whole evaluation runs: prompts to reports, and encoder inputs and scores."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import check_template
from ..functions.tagging import IGNORED_LABEL, align_labels, argmax_class, concat_with_sep, cut_body
from ..operators import filters, prompting, report, spans, splits
from ..sources import corpora, sinks
from ..sources.scratch import staged
from ..sources.rules import CHAIN, SEQUENCE, SPAN, check_pair, resolve_filters

LAYOUTS = {SEQUENCE: "class", SPAN: "span", CHAIN: "chain"}
# Tags scored in the per-word report and metrics that are rounded.
WORD_LABELS = ["B-C", "I-C", "B-E", "I-E", "O"]
SCORES = ["f1", "accuracy", "precision", "recall"]
# Names of the filters in a report.
FILTER_ENTRIES = {
    "num_sent": "intra-/inter-sent",
    "num_causal": "single-/multi-causal",
    "plicit": "ex-/im-plicit",
}

# Columns that tell examples apart when sampling.
SAMPLE_KEYS = {
    SEQUENCE: ["example_id", "text"],
    SPAN: ["example_id", "tagged_text"],
    CHAIN: ["example_id"],
}


def build_prompts(
    rows: DataFrame,
    task: str,
    template: dict[str, str],
    shot: int,
    seed: int = 42,
    by_word: bool = False,
    effects_first: bool = False,
) -> DataFrame:
    """Test rows with prompts; examples come from the train rows."""
    if by_word and task != SPAN:
        raise ValueError("answers by word exist for span detection only")
    layout = "word" if by_word else LAYOUTS[task]
    shots = None
    if prompting.check_shots(shot) > 0:
        shots = splits.sample_k(rows.where("split = 'train'"), shot, seed, SAMPLE_KEYS[task])
    test = rows.where("split = 'test'")
    return prompting.render_prompts(test, check_template(template), layout, shots, effects_first)


def read_outputs(
    scored: DataFrame, task: str, template: dict[str, str], by_word: bool = False
) -> DataFrame:
    """Predictions parsed from the model outputs."""
    if task != SPAN:
        return prompting.class_predictions(scored)
    if by_word:
        return prompting.word_predictions(scored, template)
    return prompting.span_predictions(scored)


def prompt_report(predictions: DataFrame, task: str, by_word: bool = False) -> DataFrame:
    """One row of metrics for a set of predictions."""
    if task != SPAN:
        table = report.confusion(predictions, "labels", "pred")
        scores = report.score(table, ["1"], "binary")
        return report.round_metrics(
            report.with_class_recall(scores, report.class_recall(table)), SCORES
        )
    if by_word:
        tokens = spans.explode_tokens(predictions, "tags", "pred")
        table = report.confusion(tokens, "tags", "pred")
        scores = report.with_class_recall(
            report.score(table, WORD_LABELS, "macro"), report.class_recall(table)
        )
        match = spans.exact_match_tags(predictions, "pred", "tags")
        return report.round_metrics(scores.withColumn("exact_match", match.scalar()), SCORES)
    overlap = spans.span_overlap_report(predictions)
    match = spans.exact_match_spans(predictions)
    return report.round_metrics(overlap.withColumn("exact_match", match.scalar()), ["exact_match"])


def prediction_rows(predictions: DataFrame, task: str, by_word: bool = False) -> DataFrame:
    """The columns of the predictions file; one row per token for answers by word.

    Tokens of an example share its ``row``. Its texts stand beside its first token only: beside
    every token the file would grow with the square of a sentence's length.
    """
    if task != SPAN:
        return predictions.select("example_id", "labels", "output", "pred")
    if by_word:
        texts = ["text", "tagged_text", "output"]
        numbered = predictions.withColumn("row", F.monotonically_increasing_id())
        rows = spans.explode_tokens(numbered, "tokens", "tags", "pred", keep=["row", "example_id", *texts])
        rows = rows.withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in texts})
        return rows.withColumnsRenamed({"tokens": "token", "tags": "tag", "pred": "pred_tag"})
    return predictions.select(
        "example_id", "text", "tagged_text", "output",
        "true_cause", "true_effect", "pred_cause", "pred_effect",
    )


def describe_run(task: str, corpus: str, options: dict[str, str]) -> dict[str, str]:
    """Report entries that tell what was run."""
    entries = {"task_type": task, "dataset_type": corpus}
    return entries | {FILTER_ENTRIES[name]: value for name, value in options.items()}


def evaluate_prompts(
    spark: SparkSession,
    task: str,
    corpus: str,
    data_dir: str,
    output_dir: str,
    template: dict[str, str],
    scorer: Callable[[pd.Series], pd.Series],
    model: str,
    shot: int = 0,
    seed: int = 42,
    num_sent: str = "all",
    num_causal: str = "all",
    plicit: str = "all",
    test_samples: int | None = None,
    by_word: bool = False,
    template_name: str = "",
    multi_line: bool = True,
    resume_dir: str | None = None,
) -> DataFrame:
    """Load a corpus, prompt a scorer, and write its outputs, predictions and report.

    Outputs are written before they are read by both sinks, so the scorer sees
    each prompt once, whatever is recomputed later. With ``resume_dir`` they are kept there by
    parts, and a run that broke off goes on with the prompts that have no output yet.
    """
    check_pair(corpus, task)
    options = resolve_filters(corpus, num_sent=num_sent, num_causal=num_causal, plicit=plicit)
    rows = corpora.load_data(
        spark, task, corpus, data_dir, test_samples=test_samples, seed=seed, multi_line=multi_line, **options
    )
    run = {
        "task": task,
        "dataset": corpus,
        "filters": sinks.filter_tag(**options) + ("_by_word" if by_word else ""),
        "model": model,
        "run": f"{template_name or 'template'}_{shot}_{seed}" + (f"_{test_samples}" if test_samples is not None else ""),
    }
    prompts = build_prompts(rows, task, template, shot, seed, by_word)
    outputs = os.path.join(output_dir, "outputs", *run.values())
    if resume_dir is None:
        scored = prompting.score_prompts(prompts, scorer)
    else:
        scored = prompting.score_resumed(prompts, scorer, [], os.path.join(resume_dir, *run.values()))
    scored.write.mode("overwrite").parquet(outputs)
    predictions = read_outputs(spark.read.parquet(outputs), task, template, by_word)
    scores = filters.with_metadata(
        prompt_report(predictions, task, by_word),
        **run,
        **describe_run(task, corpus, options),
        template=template_name,
        shot=shot,
        seed=seed,
    )
    files = filters.with_metadata(prediction_rows(predictions, task, by_word), **run)
    sinks.write_predictions(files, os.path.join(output_dir, "predictions"))
    sinks.write_report(scores, os.path.join(output_dir, "reports"))
    return scores


Encoder = Callable[[Column], Column]


def _cut(rows: DataFrame, column: str, length: DataFrame, ends: int) -> DataFrame:
    """Cut longer arrays in front of the special tokens at their end."""
    room = rows.withColumn("_room", length.scalar())
    return room.withColumn(column, cut_body(F.col(column), F.col("_room"), ends)).drop("_room")


def sequence_inputs(rows: DataFrame, encode: Encoder, limit: int, pad: int = 0, ends: int = 1) -> DataFrame:
    """Padded ids and mask of each text, as long as the longest train text allows.

    ``encode`` maps a text column to an id array, special tokens included; the
    last ``ends`` of these stay at the end of a text that is cut.
    """
    encoded = rows.withColumn("input_ids", encode(F.col("text")))
    length = spans.max_length(encoded.where("split = 'train'"), "input_ids", 0, limit)
    return spans.pad_inputs(_cut(encoded, "input_ids", length, ends), "input_ids", length, pad)


def span_inputs(
    rows: DataFrame, encode: Encoder, limit: int, pad: int = 0, ends: int = 1
) -> DataFrame:
    """Padded ids, mask and label ids of tokenised sentences.

    ``encode`` maps a token array to an array of structs ``id, word``, the word
    being NULL for special tokens, the last ``ends`` of which stay where a
    sentence is cut. Train rows with other tags than the known ones are an error.
    """
    checked = rows.withColumn(
        "tags",
        F.when((F.col("split") != "train") | filters.valid_tags(F.col("tags")), F.col("tags")).otherwise(
            F.raise_error(F.concat(F.lit("unknown tags: "), F.array_join("tags", " ")))
        ),
    )
    pieces = checked.withColumn("_pieces", encode(F.col("tokens")))
    train = pieces.where("split = 'train'").select(F.col("_pieces.id").alias("input_ids"))
    length = spans.max_length(train, "input_ids", 0, limit)
    encoded = _cut(pieces, "_pieces", length, ends).withColumn("input_ids", F.col("_pieces.id"))
    padded = spans.pad_inputs(encoded, "input_ids", length, pad)
    labels = align_labels(F.col("_pieces.word"), F.col("tags"))
    kept = F.slice(labels, F.lit(1), F.size("input_ids"))
    filler = F.array_repeat(F.lit(IGNORED_LABEL), F.size("input_ids") - F.size(kept))
    return padded.withColumn("labels", F.concat(kept, filler)).drop("_pieces")


def chain_inputs(
    rows: DataFrame, encode: Encoder, limit: int, start: int, separator: int, pad: int = 0
) -> DataFrame:
    """Events and contexts as one padded id array with separators and special tokens."""
    parts = F.transform(F.concat("events", "short_contexts"), encode)
    encoded = rows.withColumn("input_ids", concat_with_sep(parts, separator))
    train = encoded.where("split = 'train'")
    length = spans.max_length(train, "input_ids", 2, limit)
    room = encoded.withColumn("_room", length.scalar() - 2)
    framed = F.concat(
        F.array(F.lit(start)),
        F.slice("input_ids", F.lit(1), F.col("_room")),
        F.array(F.lit(separator)),
    )
    return spans.pad_inputs(
        room.withColumn("input_ids", framed).drop("_room"), "input_ids", length, pad
    )


def encoder_report(scored: DataFrame, task: str) -> DataFrame:
    """Metrics of score vectors ``scores`` against ``labels``, in one row.

    Spans carry one score vector per token; ignored labels are left out. What is read more
    than once, predictions or their confusion table, is written first, so that scores are read once.
    """
    if task != SPAN:
        table = staged(report.confusion(
            scored.withColumn("pred", argmax_class(F.col("scores"))), "labels", "pred"
        ))
        return report.with_class_recall(
            report.score(table, [1], "binary"), report.class_recall(table)
        )
    guessed = staged(scored.select("labels", F.transform("scores", argmax_class).alias("pred")))
    tokens = spans.explode_tokens(guessed, "labels", "pred").where(F.col("labels") != IGNORED_LABEL)
    table = report.confusion(tokens, "labels", "pred")
    scores = report.with_class_recall(report.score(table, [1, 2], "macro"), report.class_recall(table))
    return scores.withColumn("exact_match", spans.exact_match(guessed, "pred", "labels").scalar())
