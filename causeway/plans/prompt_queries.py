"""Prompts, few-shot blocks and scored outputs."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import functions as F

from ..functions.prompts import TEMPLATES
from ..operators import chains, filters, prompting, splits
from ..sources import scratch
from . import views
from .corpus_queries import SEED, documents, span_rows, tagged_rows
from .registry import query


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fill(template: str, *values: str) -> str:
    parts, used = [], 0
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(_text(literal))
        if field is not None:
            parts.append(f"({values[used]})")
            used += 1
    return " || ".join(parts)


def _prompt_sql(template: dict[str, str], body: str, shots: str | None) -> str:
    block = f"|| {_text(template['header_example'])} || {shots} " if shots else ""
    return f"{_text(template['task_description'])} {block}|| {_text(template['question'])} || {body}"


def _digest(df, *keys):
    return df.select(
        *keys, F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("n_chars")
    )


def _rows_sql(keys: str, source: str, prompt: str) -> str:
    return f"SELECT {keys}, md5(prompt) AS digest, length(prompt) AS n_chars FROM (SELECT *, {prompt} AS prompt FROM {source})"


def _ranked_sql(source: str, keys: list[str]) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || {' || $|$ || '.join(keys)})) AS shot FROM {source})".replace("$", "'")


_CLASS = TEMPLATES["sequence_classification"]
_CLASS_TEXT = _fill(_CLASS["format_text"], "text")
_CLASS_SHOTS = f"""(SELECT string_agg({_CLASS_TEXT} || {_fill(_CLASS['format_class'], 'labels')}, '' ORDER BY shot)
  FROM {_ranked_sql('train', ['doc_id'])} WHERE shot <= 3)"""
_DOCS = """WITH docs AS (SELECT d.doc_id, d.text, l.quality AS labels FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  train AS (SELECT * FROM docs WHERE labels IS NOT NULL)"""


def _labelled(spark, sf):
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("labels"))
    return documents(spark, sf).select("doc_id", "text").join(labels, "doc_id", "left")


@query("prompts_zero_shot", f"{_DOCS} {_rows_sql('doc_id', 'docs', _prompt_sql(_CLASS, _CLASS_TEXT, None))}")
def prompts_zero_shot(spark, sf):
    return _digest(prompting.render_prompts(_labelled(spark, sf), _CLASS, "class"), "doc_id")


@query("prompts_class", f"{_DOCS} {_rows_sql('doc_id', 'docs', _prompt_sql(_CLASS, _CLASS_TEXT, _CLASS_SHOTS))}")
def prompts_class(spark, sf):
    rows = _labelled(spark, sf)
    shots = splits.sample_k(rows.where("labels IS NOT NULL"), 3, SEED, ["doc_id"])
    return _digest(prompting.render_prompts(rows, _CLASS, "class", shots), "doc_id")


_PAIR_KEYS = ["corpus", "doc_id", "sent_id", "example_id"]
_TEST = "regexp_matches(doc_id, '^wsj_(00|01|22|23|24).+')"
_SPAN_DATA = f"WITH {views.PAIRS_SQL}, {views.SPAN_ROWS_SQL}, train AS (SELECT * FROM span_rows WHERE NOT {_TEST}), test AS (SELECT * FROM span_rows WHERE {_TEST})"


def _span_sql(name: str, swapped: bool = False) -> str:
    template = TEMPLATES[name]
    text = _fill(template["format_text"], "text")
    spans = [
        f"'[' || trim(regexp_extract(tagged_text, '<{x}>(.*?)</{x}>', 1)) || ']'" for x in "ce"
    ]
    answer = _fill(template["format_class"], *(spans[::-1] if swapped else spans))
    shots = f"""(SELECT string_agg({text} || {answer}, '' ORDER BY shot)
      FROM {_ranked_sql('train', _PAIR_KEYS)} WHERE shot <= 5)"""
    return f"{_SPAN_DATA} {_rows_sql('doc_id, sent_id, example_id', 'test', _prompt_sql(template, text, shots))}"


def _test_and_shots(rows, k):
    is_test = filters.is_test_doc(F.col("doc_id"))
    return rows.where(is_test), splits.sample_k(rows.where(~is_test), k, SEED, _PAIR_KEYS)


for _query, _template, _swapped in (
    ("prompts_span", "span_detection", False),
    ("prompts_span_persona", "span_detection_financial_expert", False),
    ("prompts_span_reverse", "span_detection_reverse", False),
    ("prompts_span_effects_first", "span_detection_reverse", True),
    ("prompts_span_sentence", "span_detection_by_sentence", False),
):

    @query(_query, _span_sql(_template, _swapped))
    def prompts_span(spark, sf, name=_template, swapped=_swapped):
        rows, shots = _test_and_shots(span_rows(spark, sf), 5)
        out = prompting.render_prompts(rows, TEMPLATES[name], "span", shots, swapped)
        return _digest(out, "doc_id", "sent_id", "example_id")


_WORD = TEMPLATES["span_detection_by_word"]
_WORD_TEXT = _fill(_WORD["format_text"], "text", "array_to_string(tokens, ' / ')")
_WORD_LINES = f"array_to_string(list_transform(range(1, 1 + len(tokens)), lambda i: {_fill(_WORD['format_tag'], 'tokens[i]', 'tags[i]')}), '')"
_WORD_SHOTS = f"""(SELECT string_agg({_WORD_TEXT} || {_fill(_WORD['format_class'], _WORD_LINES)}, '' ORDER BY shot)
  FROM {_ranked_sql('train', _PAIR_KEYS)} WHERE shot <= 1)"""


@query(
    "prompts_word",
    f"""WITH {views.PAIRS_SQL}, {views.TOKENS_SQL}, {views.SPAN_ROWS_SQL}, words AS (
      SELECT s.*, t.tokens, t.tags FROM span_rows s JOIN tagged t ON t.corpus = s.corpus AND t.doc_id = s.doc_id
        AND t.sent_id = s.sent_id AND t.eg_id = s.example_id
    ), train AS (SELECT * FROM words WHERE NOT {_TEST}), test AS (SELECT * FROM words WHERE {_TEST})
    {_rows_sql('doc_id, sent_id, example_id', 'test', _prompt_sql(_WORD, _WORD_TEXT, _WORD_SHOTS))}""",
)
def prompts_word(spark, sf):
    rows, shots = _test_and_shots(tagged_rows(spark, sf), 1)
    out = prompting.render_prompts(rows, _WORD, "word", shots)
    return _digest(out, "doc_id", "sent_id", "example_id")


_CHAIN = TEMPLATES["chain_classification"]
_CHAIN_TEXT = _fill(_CHAIN["format_text"], "array_to_string(events, ', ')", "short_contexts[1]", "short_contexts[2]")
_CHAIN_SHOTS = f"""(SELECT string_agg({_CHAIN_TEXT} || {_fill(_CHAIN['format_class'], 'labels')}, '' ORDER BY shot)
  FROM {_ranked_sql('inst_pairs', ['example_id'])} WHERE shot <= 3)"""


@query(
    "prompts_chain",
    f"WITH {views.INSTANCES_SQL} {_rows_sql('example_id', 'inst_pairs', _prompt_sql(_CHAIN, _CHAIN_TEXT, _CHAIN_SHOTS))}",
)
def prompts_chain(spark, sf):
    rows = chains.chain_pairs(views.instances(spark, sf))
    shots = splits.sample_k(rows, 3, SEED, ["example_id"])
    return _digest(prompting.render_prompts(rows, _CHAIN, "chain", shots), "example_id")


@query(
    "scored_prompts",
    f"""{_SPAN_DATA} SELECT doc_id, sent_id, example_id, CASE WHEN contains(text, ' leads to ') THEN '1' ELSE '0' END AS pred
    FROM test""",
)
def scored_prompts(spark, sf):
    rows, _ = _test_and_shots(span_rows(spark, sf), 1)
    prompts = prompting.render_prompts(
        rows.select("doc_id", "sent_id", "example_id", "text", F.lit("1").alias("labels")), _CLASS, "class"
    )

    def scorer(batch):
        hits = batch.str.contains(" leads to ", regex=False)
        return "Classification: N" + hits.astype(int).astype(str)

    scored = prompting.class_predictions(prompting.score_prompts(prompts, scorer))
    return scored.select("doc_id", "sent_id", "example_id", "pred")


@query(
    "resumed_prompts",
    f"""{_SPAN_DATA} SELECT doc_id, sent_id, example_id, CASE WHEN contains(text, ' leads to ') THEN '1' ELSE '0' END AS pred
    FROM test""",
)
def resumed_prompts(spark, sf):
    """A run that ends half-way, and a second one that gets only what is left."""
    rows, _ = _test_and_shots(span_rows(spark, sf), 1)
    prompts = prompting.render_prompts(
        rows.select("doc_id", "sent_id", "example_id", "text", F.lit("1").alias("labels")), _CLASS, "class"
    )
    folder, keys = scratch.shared_folder(spark), ["doc_id", "sent_id", "example_id"]

    def right(batch):
        return "Classification: N" + batch.str.contains(" leads to ", regex=False).astype(int).astype(str)

    # The first run ends after half of its buckets, as if the service had gone.
    prompting.score_resumed(prompts, right, keys, folder, rounds=4, stop_after=2)
    return prompting.class_predictions(prompting.score_resumed(prompts, right, keys, folder, rounds=4)).select(*keys, "pred")


@query(
    "paired_by_position",
    f"WITH {views.CLASS_RESPONSES_SQL} SELECT doc_id, labels, output FROM preds",
)
def paired_by_position(spark, sf):
    """Two tables in the same order, one of which has no key."""
    rows = views.class_responses(spark, sf).orderBy("doc_id")
    return prompting.pair_by_position(rows.select("output"), rows.select("doc_id", "labels"))
