"""Whole runs: corpus files to reports, and encoder inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import TEMPLATES
from ..operators import splits
from ..sources import corpora, rules, scratch
from . import evaluate, source_queries, views
from .corpus_queries import _SPLIT, SEED, documents
from .registry import query
from .source_queries import _ANN, _TEST

_EVALUATED = f"""judged AS (
  SELECT seq_label AS y, CASE WHEN contains(text, ' leads to ') THEN 1 ELSE 0 END AS g FROM ann WHERE eg_id = 0 AND {_TEST}
), counted AS (
  SELECT count(*) FILTER (y = 1 AND g = 1)::DOUBLE AS hit, count(*) FILTER (g = 1) AS guessed, count(*) FILTER (y = 1) AS truth,
    count(*) FILTER (y = g)::DOUBLE / count(*) AS accuracy FROM judged)"""


@query(
    "evaluate_classes",
    f"""{_ANN}, {_EVALUATED} SELECT round(accuracy, 5) AS accuracy, round(CASE WHEN guessed + truth = 0 THEN 0 ELSE 2 * hit / (guessed + truth) END, 5) AS f1,
      round(CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END, 5) AS precision, round(CASE WHEN truth = 0 THEN 0 ELSE hit / truth END, 5) AS recall
    FROM counted""",
)
def evaluate_classes(spark, sf):
    """A corpus file, prompts, a scorer, and the report, run twice into the same folders."""
    folder = scratch.shared_folder(spark)
    source_queries.write_pairs(views.pairs(spark, sf), f"{folder}/{corpora.ONE_FILE['pdtb']}")

    def scorer(prompts):
        own = prompts.str.rsplit("Text: ", n=1).str[1]
        return "Classification: N" + own.str.contains(" leads to ", regex=False).astype(int).astype(str)

    for _ in range(2):
        evaluate.evaluate_prompts(
            spark, rules.SEQUENCE, "pdtb", folder, f"{folder}/runs", TEMPLATES["sequence_classification"], scorer, "stub", shot=3
        )
    rows = spark.read.json(f"{folder}/runs/reports")
    return rows.select("accuracy", "f1", "precision", "recall")


@query(
    "encoder_inputs",
    f"""WITH enc AS (
      SELECT doc_id, split, list_concat([101], list_transform(string_split(text, ' '), lambda w: length(w)), [102]) AS ids FROM {_SPLIT}
    ), room AS (SELECT least(max(len(ids)) FILTER (split = 'train'), 64) AS n FROM enc)
    SELECT doc_id, least(len(ids), n) AS n_real, array_to_string(CASE WHEN len(ids) > n THEN list_concat(ids[:n - 1], [102])
      ELSE list_concat(ids, list_transform(range(0, n - len(ids)), lambda i: 0)) END, ',') AS input_ids FROM enc, room""",
)
def encoder_inputs(spark, sf):
    """Ids padded or cut to one length; the special token at the end stays."""
    rows = splits.split_80_10_10(documents(spark, sf), SEED, ["doc_id"])

    def encode(text):
        return F.concat(F.array(F.lit(101)), F.transform(F.split(text, " "), F.length), F.array(F.lit(102)))

    out = evaluate.sequence_inputs(rows, encode, limit=64)
    real = F.size(F.filter("attention_mask", lambda m: m == 1)).cast("bigint")
    return out.select("doc_id", real.alias("n_real"), F.array_join("input_ids", ",").alias("input_ids"))
