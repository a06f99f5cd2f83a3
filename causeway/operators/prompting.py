"""Few-shot prompts, model outputs, and the parsed predictions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.markup import bracketed_spans
from ..functions.parsing import (
    CAUSE_LINE,
    EFFECT_LINE,
    parse_class,
    response_spans,
    unwrap,
    word_response,
)
from ..functions.prompts import SHOTS, answer_text, question_text
from ..sources.ranges import stretches
from ..sources.scratch import shared_folder, staged
from .ranking import with_input_position, with_position

# Bytes of prompts that a scorer gets at a time.
AT_ONCE = 1 << 20


def shot_block(
    shots: DataFrame, template: dict[str, str], layout: str, effects_first: bool = False
) -> DataFrame:
    """All examples as one string, in order of their ``shot`` number.

    The sample holds at most as many rows as the largest allowed shot count.
    """
    example = F.concat(question_text(template, layout), answer_text(template, layout, effects_first))
    listed = F.array_sort(F.collect_list(F.struct(F.col("shot"), example.alias("example"))))
    body = F.array_join(F.transform(listed, lambda s: s["example"]), "")
    return shots.agg(F.concat(F.lit(template["header_example"]), body).alias("block"))


def render_prompts(
    df: DataFrame,
    template: dict[str, str],
    layout: str,
    shots: DataFrame | None = None,
    effects_first: bool = False,
) -> DataFrame:
    """Add the prompt: task, examples if any, question and the row's own text.

    ``layout`` is ``class``, ``span``, ``word`` or ``chain``. The block of
    examples is a scalar subquery: computed once, then a constant in every task.
    """
    parts = [F.lit(template["task_description"])]
    if shots is not None:
        parts.append(shot_block(shots, template, layout, effects_first).scalar())
    parts += [F.lit(template["question"]), question_text(template, layout)]
    return df.withColumn("prompt", F.concat(*parts))


def check_shots(k: int) -> int:
    if k not in SHOTS:
        raise ValueError(f"the number of shots must be one of {SHOTS}")
    return k


def score_prompts(
    df: DataFrame, scorer: Callable[[pd.Series], pd.Series], prompt: str = "prompt"
) -> DataFrame:
    """Add ``output`` by calling a user's scorer on stretches of Arrow batches of prompts.

    Only the prompts go to Python, where ``AT_ONCE`` bytes of them are objects at a time. The
    scorer counts as non-deterministic, so no rewrite of the plan calls it twice for a row.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = stretches(batch, AT_ONCE)
            outputs = [pa.Array.from_pandas(scorer(part.to_pandas()), type=pa.string()) for part in parts]
            yield pa.concat_arrays(outputs) if outputs else batch

    return df.withColumn("output", run.asNondeterministic()(F.col(prompt)))


def attach_outputs(df: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded outputs joined by row key; rows without one stay, with NULL."""
    return df.join(outputs.select(*keys, "output"), keys, "left")


def pair_predictions(predictions: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    return references.join(predictions, keys)


def pair_by_position(
    predictions: DataFrame, references: DataFrame, order: Sequence[str] | None = None
) -> DataFrame:
    """Row n of ``references`` beside row n of ``predictions``, for tables without common keys.

    Places are those of the frames' own row order, or of ``order`` (columns that both have).
    They come from the sizes of partitions, so neither table passes through one task. Rows
    beyond the shorter table's end are left out. Columns that both have are the references'.
    """

    def placed(df: DataFrame) -> DataFrame:
        return with_position(df, order, "_place") if order else with_input_position(df, "_place")

    own = placed(predictions)
    own = own.select("_place", *[c for c in predictions.columns if c not in references.columns])
    return placed(references).join(own, "_place").drop("_place")


# --- scoring that goes on where it stopped -----------------------------------------


def _resume_key(keys: Sequence[str], prompt: str) -> Column:
    """A prompt under other keys, or another prompt under the same, is scored anew."""
    return F.xxhash64(*keys, prompt)


def finished_outputs(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Outputs of the rounds that the manifest names; those of a round that broke off are not read."""
    manifest = f"{folder}/manifest"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    # One row for each round that was ever finished.
    rounds = [r.round for r in spark.read.schema("round string").json(manifest).collect()]
    paths = [f"{folder}/outputs/{name}" for name in rounds]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def score_resumed(
    df: DataFrame,
    scorer: Callable[[pd.Series], pd.Series],
    keys: Sequence[str],
    folder: str,
    rounds: int = 16,
    prompt: str = "prompt",
    stop_after: int | None = None,
) -> DataFrame:
    """`score_prompts` whose outputs are kept in ``folder``, a part of the keys at a time.

    Keys are dealt into ``rounds`` buckets by hash, each scored over the whole cluster and
    written; then the bucket's folder is entered in a manifest. If a scorer dies, a later call finds
    the finished ones there and leaves their prompts out by an anti join, so at most the
    prompts of one bucket are sent twice. Rows that agree on keys and prompt are sent once.
    ``stop_after`` ends a run after so many buckets; rows of the others have no output then.

    The rows are written first, as both their prompts and the rows that get the outputs are read.
    Prompts are grouped and joined by their hash first, since they begin alike for long.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys([*keys, prompt]))
    df = staged(df)
    asked = df.select(*names).withColumn("_resume", _resume_key(keys, prompt)).dropDuplicates(["_resume", *names])
    schema = StructType([*asked.schema.fields, StructField("output", StringType())])
    same = reduce(lambda a, b: a & b, [F.col(f"asked.{c}").eqNullSafe(F.col(f"done.{c}")) for c in ("_resume", *names)])
    done = finished_outputs(spark, folder, schema).alias("done")
    left = asked.alias("asked").join(done, same, "left_anti")
    waiting = shared_folder(spark)
    left.withColumn("_bucket", F.pmod("_resume", F.lit(rounds))).write.partitionBy("_bucket").parquet(waiting)
    waiting = spark.read.schema(StructType([*asked.schema.fields, StructField("_bucket", LongType())])).parquet(waiting)
    buckets = sorted(r[0] for r in waiting.select("_bucket").distinct().collect())
    for bucket in buckets[:stop_after]:
        name = f"{uuid.uuid4().hex}-{bucket}"
        own = waiting.where(F.col("_bucket") == bucket).drop("_bucket")
        score_prompts(own, scorer, prompt).write.parquet(f"{folder}/outputs/{name}")
        spark.createDataFrame([(name,)], "round string").coalesce(1).write.mode("append").json(f"{folder}/manifest")
    done = finished_outputs(spark, folder, schema).withColumnsRenamed({c: f"_{c}" for c in (*names, "_resume")})
    pairs = [("_own", "__resume"), *[(c, f"_{c}") for c in names]]
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other)) for c, other in pairs])
    return df.withColumn("_own", _resume_key(keys, prompt)).join(done, match, "left").select(*df.columns, "output")


def class_predictions(df: DataFrame) -> DataFrame:
    """Labels as strings beside the class read from the output."""
    return df.withColumns(
        {"labels": F.col("labels").cast("string"), "pred": parse_class(F.col("output"))}
    )


def span_predictions(df: DataFrame) -> DataFrame:
    """True spans from the tagged text and predicted spans from the output."""
    return df.withColumns(
        {
            "true_cause": unwrap(bracketed_spans(F.col("tagged_text"), "c")),
            "true_effect": unwrap(bracketed_spans(F.col("tagged_text"), "e")),
            "pred_cause": unwrap(response_spans(F.col("output"), CAUSE_LINE)),
            "pred_effect": unwrap(response_spans(F.col("output"), EFFECT_LINE)),
        }
    )


def word_predictions(df: DataFrame, template: dict[str, str]) -> DataFrame:
    """Predicted tag per token from a line-per-token output."""
    header = template["format_class"].split("{}")[0]
    separator = template["format_tag"].split("{}")[1]
    return df.withColumn(
        "pred", word_response(F.col("output"), F.col("tokens"), header, separator)
    )
