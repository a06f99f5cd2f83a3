"""Classification, span and token reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tagging
from ..functions.prompts import TEMPLATES
from ..operators import filters, prompting, report, spans
from . import views
from .corpus_queries import span_rows, tagged_rows
from .registry import query

_SCORES = ["accuracy", "f1", "precision", "recall"]
_PRED = f"""WITH {views.CLASS_RESPONSES_SQL}, p AS (
  SELECT *, cast(labels AS varchar) AS t, CASE WHEN regexp_matches(output, 'N[0-9]+')
    THEN regexp_extract(output, 'N([0-9]+)', 1) ELSE '-1' END AS g FROM preds)"""


def _rounded(df, columns, digits=6):
    return report.round_metrics(df, columns, digits)


def _predictions(spark, sf):
    return prompting.class_predictions(views.class_responses(spark, sf))


def _div(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom}) END)"


def _counts(label: str) -> dict[str, str]:
    return {
        "hit": f"count(*) FILTER (t = '{label}' AND g = '{label}')",
        "guess": f"count(*) FILTER (g = '{label}')",
        "true": f"count(*) FILTER (t = '{label}')",
    }


def _scores_sql(labels: list[str], average: str, by: str, source: str, digits: int = 6) -> str:
    counts = [_counts(label) for label in labels]
    if average == "micro":
        counts = [{k: "(" + " + ".join(c[k] for c in counts) + ")" for k in counts[0]}]

    def mean(score) -> str:
        return "(" + " + ".join(score(c) for c in counts) + f") / {len(counts)}"

    names = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {names}round(count(*) FILTER (t = g)::DOUBLE / count(*), {digits}) AS accuracy,
      round({mean(lambda c: _div(f"2 * {c['hit']}", f"{c['guess']} + {c['true']}"))}, {digits}) AS f1,
      round({mean(lambda c: _div(c['hit'], c['guess']))}, {digits}) AS precision,
      round({mean(lambda c: _div(c['hit'], c['true']))}, {digits}) AS recall FROM {source} {group}"""


@query("class_report", f"{_PRED} {_scores_sql(['1'], 'binary', 'source', 'p')}")
def class_report(spark, sf):
    rows = _predictions(spark, sf)
    out = report.classification_report(rows, "labels", "pred", ["1"], "binary", ["source"])
    return _rounded(out, _SCORES)


@query("macro_report", f"{_PRED} {_scores_sql(['0', '1'], 'macro', 'lang', 'p')}")
def macro_report(spark, sf):
    rows = _predictions(spark, sf)
    out = report.classification_report(rows, "labels", "pred", ["0", "1"], "macro", ["lang"])
    return _rounded(out, _SCORES)


@query("micro_report", f"{_PRED} {_scores_sql(['0', '1'], 'micro', 'lang', 'p')}")
def micro_report(spark, sf):
    rows = _predictions(spark, sf)
    out = report.classification_report(rows, "labels", "pred", ["0", "1"], "micro", ["lang"])
    return _rounded(out, _SCORES)


@query(
    "run_report",
    f"""{_PRED} SELECT *, 'sequence_classification' AS task_type, 'all' AS dataset_type,
      'all' AS filter_num_sent, 3 AS shot, 42 AS seed
    FROM ({_scores_sql(['1'], 'binary', '', 'p', 5)})""",
)
def run_report(spark, sf):
    rows = _predictions(spark, sf)
    out = report.classification_report(rows, "labels", "pred", ["1"], "binary")
    return filters.with_metadata(
        report.round_metrics(out, _SCORES),
        task_type="sequence_classification",
        dataset_type="all",
        filter_num_sent="all",
        shot=3,
        seed=42,
    )


@query(
    "confusion_matrix",
    f"{_PRED} SELECT source, t AS truth, g AS guess, count(*) AS n FROM p GROUP BY 1, 2, 3",
)
def confusion_matrix(spark, sf):
    return report.confusion(_predictions(spark, sf), "labels", "pred", ["source"])


@query(
    "label_scores",
    f"""{_PRED}, c AS (SELECT lang, label, count(*) FILTER (t = label AND g = label) AS hit,
      count(*) FILTER (g = label) AS guess, count(*) FILTER (t = label) AS support
      FROM p, (VALUES ('-1'), ('0'), ('1')) AS v(label) GROUP BY 1, 2)
    SELECT lang, label, round({_div('hit', 'guess')}, 6) AS precision,
      round({_div('hit', 'support')}, 6) AS recall,
      round({_div('2 * hit', 'guess + support')}, 6) AS f1, support FROM c""",
)
def label_scores(spark, sf):
    table = report.confusion(_predictions(spark, sf), "labels", "pred", ["lang"])
    out = report.label_scores(table, ["-1", "0", "1"], ["lang"])
    return _rounded(out, ["precision", "recall", "f1"])


_RECALL = f"""{_PRED}, classes AS (
      SELECT source, t AS class FROM p UNION SELECT source, g FROM p
    ), r AS (
    SELECT source, class, row_number() OVER (PARTITION BY source ORDER BY class) - 1 AS class_index,
      (SELECT round({_div('count(*) FILTER (p.g = classes.class)', 'count(*)')}, 6) FROM p
       WHERE p.source = classes.source AND p.t = classes.class) AS recall
    FROM classes)"""


@query("class_recall", f"{_RECALL} SELECT * FROM r")
def class_recall(spark, sf):
    table = report.confusion(_predictions(spark, sf), "labels", "pred", ["source"])
    return _rounded(report.class_recall(table, ["source"]), ["recall"])


@query(
    "full_report",
    f"""{_RECALL}, a AS ({_scores_sql(['1'], 'binary', 'source', 'p')})
    SELECT a.*, coalesce(max(r.recall) FILTER (class_index = 0), -1) AS accuracy_0,
      coalesce(max(r.recall) FILTER (class_index = 1), -1) AS accuracy_1,
      coalesce(max(r.recall) FILTER (class_index = 2), -1) AS accuracy_2
    FROM a JOIN r ON r.source = a.source GROUP BY ALL""",
)
def full_report(spark, sf):
    table = report.confusion(_predictions(spark, sf), "labels", "pred", ["source"])
    scores = report.score(table, ["1"], "binary", ["source"])
    rows = report.report_rows(scores, report.class_recall(table, ["source"]), ["source"])
    metrics = [*_SCORES, *(f"accuracy_{i}" for i in range(3))]
    wide = rows.groupBy("source").agg(*[F.max(F.when(F.col("metric") == m, F.round("value", 6))).alias(m) for m in metrics])
    return wide.fillna(-1.0, metrics[len(_SCORES) :])


@query(
    "report_rows",
    f"""{_RECALL}, a AS ({_scores_sql(['1'], 'binary', 'source', 'p')})
    SELECT source, metric, value FROM (UNPIVOT a ON accuracy, f1, precision, recall INTO NAME metric VALUE value)
    UNION ALL SELECT source, 'accuracy_' || class_index, recall FROM r""",
)
def report_rows(spark, sf):
    table = report.confusion(_predictions(spark, sf), "labels", "pred", ["source"])
    scores = report.score(table, ["1"], "binary", ["source"])
    return _rounded(report.report_rows(scores, report.class_recall(table, ["source"]), ["source"]), ["value"])


@query("response_classes", f"{_PRED} SELECT doc_id, t AS labels, g AS pred FROM p")
def response_classes(spark, sf):
    return _predictions(spark, sf).select("doc_id", "labels", "pred")


@query(
    "output_join",
    f"""WITH {views.CLASS_RESPONSES_SQL} SELECT d.doc_id, d.source, coalesce(p.output, '(none)') AS output FROM documents d
    LEFT JOIN preds p ON p.doc_id = d.doc_id""",
)
def output_join(spark, sf):
    rows = views.table(spark, sf, "documents").select("doc_id", "source")
    joined = prompting.attach_outputs(rows, views.class_responses(spark, sf), ["doc_id"])
    return joined.fillna("(none)", ["output"])


@query(
    "paired_accuracy",
    """SELECT count(*) AS n, round(avg((d.lang = CASE WHEN l.quality = 1 THEN 'en' ELSE 'de' END)::INT), 6) AS accuracy
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def paired_accuracy(spark, sf):
    truth = views.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("truth"))
    guess = views.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "en").otherwise("de").alias("guess")
    )
    table = report.confusion(prompting.pair_predictions(guess, truth, ["doc_id"]), "truth", "guess")
    out = table.agg(F.sum("n").alias("n"), report.accuracy().alias("accuracy"))
    return _rounded(out, ["accuracy"])


# --- spans -----------------------------------------------------------------


def _unwrap_sql(text: str) -> str:
    inner = rf"regexp_extract_all({text}, '\[([^\]]+)\]', 1)"
    return f"(CASE WHEN len({inner}) = 0 THEN {text} ELSE array_to_string({inner}, ' ') END)"


def _bracket_sql(letter: str) -> str:
    spans = f"regexp_extract_all(tagged_text, '<{letter}[0-9]*>(.*?)</{letter}[0-9]*>', 1)"
    return f"array_to_string(list_transform({spans}, lambda s: '[' || trim(s) || ']'), ' ')"


def _line_sql(test: str, mark: str) -> str:
    lines = f"list_filter(string_split(output, chr(10)), lambda x: {test})"
    return f"coalesce(replace({lines}[-1], '{mark}', ''), '')"


_SPAN_PRED = f"""WITH {views.PAIRS_SQL}, {views.SPAN_ROWS_SQL}, {views.SPAN_RESPONSES_SQL}, raw_spans AS (
  SELECT *, {_bracket_sql('c')} AS tc, {_bracket_sql('e')} AS te,
    {_line_sql("contains(x, 'Causes:')", 'Causes:')} AS pc,
    {_line_sql("contains(x, 'Effects:') AND NOT contains(x, 'Causes:')", 'Effects:')} AS pe
  FROM span_preds
), parsed AS (
  SELECT corpus, doc_id, sent_id, {_unwrap_sql('tc')} AS true_cause, {_unwrap_sql('te')} AS true_effect,
    {_unwrap_sql('pc')} AS pred_cause, {_unwrap_sql('pe')} AS pred_effect FROM raw_spans
)"""


def _span_predictions(spark, sf):
    return prompting.span_predictions(views.span_responses(spark, span_rows(spark, sf)))


@query("span_response", f"{_SPAN_PRED} SELECT * FROM parsed")
def span_response(spark, sf):
    return _span_predictions(spark, sf).drop("tagged_text", "output")


@query(
    "exact_match_spans",
    f"""{_SPAN_PRED} SELECT corpus, round(avg((trim(true_cause) = trim(pred_cause)
      AND trim(true_effect) = trim(pred_effect))::INT), 6) AS exact_match FROM parsed GROUP BY 1""",
)
def exact_match_spans(spark, sf):
    out = spans.exact_match_spans(_span_predictions(spark, sf), ["corpus"])
    return _rounded(out, ["exact_match"])


def _overlap_sql(part: str) -> str:
    truth, guess = f"string_split(true_{part}, ' ')", f"string_split(pred_{part}, ' ')"
    common = f"len(list_intersect({truth}, {guess}))::DOUBLE"
    n_truth, n_guess = f"len(list_distinct({truth}))", f"len(list_distinct({guess}))"
    return f"""avg({common} / {n_guess}) AS {part}_precision, avg({common} / {n_truth}) AS {part}_recall,
      avg(2 * {common} / ({n_truth} + {n_guess})) AS {part}_f1"""


_OVERLAPS = [f"{p}{m}" for p in ("cause_", "effect_", "") for m in ("precision", "recall", "f1")]


@query(
    "span_overlap",
    f"""{_SPAN_PRED}, m AS (SELECT corpus, {_overlap_sql('cause')}, {_overlap_sql('effect')} FROM parsed GROUP BY 1)
    SELECT corpus, round(cause_precision, 6) AS cause_precision, round(cause_recall, 6) AS cause_recall,
      round(cause_f1, 6) AS cause_f1, round(effect_precision, 6) AS effect_precision,
      round(effect_recall, 6) AS effect_recall, round(effect_f1, 6) AS effect_f1,
      round((cause_precision + effect_precision) / 2, 6) AS precision,
      round((cause_recall + effect_recall) / 2, 6) AS recall, round((cause_f1 + effect_f1) / 2, 6) AS f1 FROM m""",
)
def span_overlap(spark, sf):
    return _rounded(spans.span_overlap_report(_span_predictions(spark, sf), ["corpus"]), _OVERLAPS)


_WORDS = f"WITH {views.PAIRS_SQL}, {views.TOKENS_SQL}, {views.SPAN_ROWS_SQL}, {views.WORD_RESPONSES_SQL}"
_WORD_TEMPLATE = TEMPLATES["span_detection_by_word"]


def _word_predictions(spark, sf):
    rows = views.word_responses(tagged_rows(spark, sf))
    return prompting.word_predictions(rows, _WORD_TEMPLATE)


@query(
    "word_response",
    f"""{_WORDS} SELECT corpus, doc_id, sent_id, example_id, array_to_string(tags, '|') AS tags,
      array_to_string(pred, '|') AS pred FROM word_preds""",
)
def word_response(spark, sf):
    return _word_predictions(spark, sf).select(
        "corpus",
        "doc_id",
        "sent_id",
        "example_id",
        F.array_join("tags", "|").alias("tags"),
        F.array_join("pred", "|").alias("pred"),
    )


@query(
    "exact_match_tags",
    f"{_WORDS} SELECT corpus, round(avg((tags = pred)::INT), 6) AS exact_match FROM word_preds GROUP BY 1",
)
def exact_match_tags(spark, sf):
    out = spans.exact_match_tags(_word_predictions(spark, sf), "pred", "tags", ["corpus"])
    return _rounded(out, ["exact_match"])


@query(
    "tag_quarantine",
    f"""{_WORDS} SELECT doc_id, sent_id, example_id, CASE WHEN len(list_filter(pred,
      lambda t: t NOT IN ('O', 'I-C', 'I-E', 'B-C', 'B-E'))) = 0 THEN 'valid' ELSE 'rejected' END AS status FROM word_preds""",
)
def tag_quarantine(spark, sf):
    rows = _word_predictions(spark, sf).select("doc_id", "sent_id", "example_id", "pred")
    return filters.with_status(rows, filters.valid_tags(F.col("pred"))).drop("pred")


_WORD_LABELS = ["B-C", "I-C", "B-E", "I-E", "O"]


@query(
    "word_report",
    f"""{_WORDS}, tg AS (SELECT corpus, unnest(tags) AS t, unnest(pred) AS g FROM word_preds)
    {_scores_sql(_WORD_LABELS, 'macro', 'corpus', 'tg')}""",
)
def word_report(spark, sf):
    rows = spans.explode_tokens(_word_predictions(spark, sf), "tags", "pred", keep=["corpus"])
    out = report.classification_report(rows, "tags", "pred", _WORD_LABELS, "macro", ["corpus"])
    return _rounded(out, _SCORES)


_IDS = f"""WITH {views.PAIRS_SQL}, {views.TOKENS_SQL}, ids AS (
  SELECT *, CASE WHEN length(token) <= 1 THEN -100 WHEN tag = 'O' THEN 0 WHEN tag IN ('B-C', 'I-C') THEN 1 ELSE 2 END AS t
  FROM bio WHERE pair_label = 1
), tg AS (SELECT *, CASE WHEN (pos - 1 + src_id + sent_id) % 11 = 0 THEN 0 ELSE t END AS g FROM ids)"""


def _label_rows(spark, sf):
    rows = tagged_rows(spark, sf)
    words = F.transform("tokens", lambda t, i: F.when(F.length(t) > 1, i))
    rows = rows.withColumn("truth", tagging.align_labels(words, F.col("tags")))
    number = F.col("src_id") + F.col("sent_id")
    guess = F.transform("truth", lambda x, i: F.when((i + number) % 11 == 0, 0).otherwise(x))
    return rows.withColumn("guess", guess)


@query(
    "exact_match_masked",
    f"""{_IDS}, r AS (SELECT corpus, doc_id, sent_id, eg_id, bool_and(t = -100 OR t = g) AS ok FROM tg GROUP BY ALL)
    SELECT corpus, round(avg(ok::INT), 6) AS exact_match FROM r GROUP BY 1""",
)
def exact_match_masked(spark, sf):
    out = spans.exact_match(_label_rows(spark, sf), "guess", "truth", by=["corpus"])
    return _rounded(out, ["exact_match"])


@query(
    "token_prf",
    f"""{_IDS}, kept AS (SELECT corpus, t::VARCHAR AS t, g::VARCHAR AS g FROM tg WHERE t <> -100)
    SELECT corpus, f1, precision, recall FROM ({_scores_sql(['1', '2'], 'macro', 'corpus', 'kept')})""",
)
def token_prf(spark, sf):
    out = spans.token_prf(_label_rows(spark, sf), "guess", "truth", by=["corpus"])
    return _rounded(out, ["f1", "precision", "recall"])


@query(
    "best_run",
    f"""WITH {views.RUN_LOG_SQL}, wide AS (
      SELECT lr, epoch, max(accuracy) FILTER (split = 'valid') AS valid_accuracy, max(f1) FILTER (split = 'valid') AS valid_f1,
        max(accuracy) FILTER (split = 'test') AS test_accuracy, max(f1) FILTER (split = 'test') AS test_f1
      FROM run_log GROUP BY 1, 2
    ), per_lr AS (
      SELECT *, row_number() OVER (PARTITION BY lr ORDER BY valid_accuracy DESC NULLS LAST, epoch) AS k FROM wide)
    SELECT lr, epoch, round(valid_accuracy, 5) AS valid_accuracy, round(valid_f1, 5) AS valid_f1,
      round(test_accuracy, 5) AS test_accuracy, round(test_f1, 5) AS test_f1
    FROM per_lr WHERE k = 1 ORDER BY per_lr.valid_accuracy DESC NULLS LAST, lr LIMIT 1""",
)
def best_run(spark, sf):
    best = report.select_best(views.run_log(spark, sf))
    return report.round_metrics(
        best, ["valid_accuracy", "valid_f1", "test_accuracy", "test_f1"]
    )
