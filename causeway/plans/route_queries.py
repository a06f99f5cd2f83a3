"""Every corpus route and every kind of run, from files made of whole tables to rows and reports."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from ..functions.prompts import REQUIRED_KEYS, TEMPLATES
from ..operators import prompting, ranking, spans, splits
from ..sources import corpora, readers, rules, scratch
from . import evaluate, views
from .corpus_queries import _CANON, _CROSSING, _EXPLICIT, _RANKED, SEED, _letters, documents, span_rows
from .prompt_queries import _CHAIN_TEXT
from .registry import query
from .report_queries import (
    _IDS,
    _OVERLAPS,
    _SCORES,
    _SPAN_PRED,
    _WORD_LABELS,
    _WORDS,
    _label_rows,
    _rounded,
    _scores_sql,
    _span_predictions,
    _word_predictions,
)
from .source_queries import _ADAPTIVE, _ANN, _FIN, _TEST, _write_csv, _write_fincausal, _write_instances, delete_read, write_pairs

_TAGS_OF_SEGMENTS = """array_to_string(list_transform(range(1, 1 + len(segs)), lambda j:
      CASE WHEN segs[j] = '' THEN '' WHEN marks[j][:2] = '<c' THEN 'C' || repeat('c', length(segs[j]) - 1)
        WHEN marks[j][:2] = '<e' THEN 'E' || repeat('e', length(segs[j]) - 1)
        ELSE repeat('O', length(segs[j])) END), '')"""


@query(
    "load_clue_corpus",
    f"""{_CANON}{_CROSSING}, lines AS (
      SELECT src_id, sent_id, CASE src_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
        'kessan_' || CASE src_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END || '_'
          || (row_number() OVER (PARTITION BY src_id % 3 ORDER BY src_id, sent_id) - 1) AS example_id FROM clues
    ), seg AS (
      SELECT src_id, sent_id, tagged_text, string_split_regex(tagged_text, '</?[ce][0-9]*>') AS segs,
        list_concat([''], regexp_extract_all(tagged_text, '</?[ce][0-9]*>')) AS marks FROM crossing WHERE NOT crosses)
    SELECT example_id, array_to_string(segs, '') AS text, {_TAGS_OF_SEGMENTS} AS tags, tagged_text, split
    FROM seg JOIN lines USING (src_id, sent_id)""",
)
def load_clue_corpus(spark, sf):
    """Sentences with clue marks in three files of JSON lines; rows with crossing spans are left out."""
    folder = scratch.shared_folder(spark)
    rows = views.clue_sentences(spark, sf)
    for number, file in enumerate(corpora.SPLIT_FILES.values()):
        own = rows.where(F.col("src_id") % 3 == number).orderBy("src_id", "sent_id")
        own.select("tagged_sentence").write.json(os.path.join(folder, "kessan", f"{file}.jsonl"))
    loaded = corpora.load_corpus(spark, "jpfinresults", rules.SPAN, folder)
    return loaded.select("example_id", "text", _letters(F.col("tags")).alias("tags"), "tagged_text", "split")


_PHRASES = f"""{_ANN}, {views.SPAN_ROWS_SQL}, fin AS (
  SELECT src_id % 2 AS part, src_id, sent_id, example_id AS eg, replace(text, ';', ',') AS text,
    'fincausal' || CASE WHEN src_id % 2 = 0 THEN '' ELSE '2' END || '_' || src_id || '.' || sent_id || '.' || example_id AS example_id,
    replace(tagged_text, ';', ',') AS tagged_text FROM span_rows
), numbered AS (
  SELECT *, part * 1000000000000000 + row_number() OVER (PARTITION BY part ORDER BY src_id, sent_id, eg) - 1 AS row_id,
    count(*) OVER (PARTITION BY text) AS copies FROM fin
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || row_id)) AS rank, count(*) OVER () AS n FROM numbered WHERE copies = 1
), t AS (
  SELECT *, string_split(text, ' ') AS tok, string_split(regexp_extract(tagged_text, '<c>(.*?)</c>', 1), ' ') AS c,
    string_split(regexp_extract(tagged_text, '<e>(.*?)</e>', 1), ' ') AS e,
    CASE WHEN rank <= n - ceil(n / 5) THEN 'train' WHEN rank <= n - ceil(ceil(n / 5) / 2) THEN 'valid' ELSE 'test' END AS split FROM ranked
)"""


@query(
    "load_phrase_corpus",
    f"""{_PHRASES} SELECT example_id, text, list_reduce(list_transform(range(1, 1 + len(tok)),
      lambda i: {{'i': i, 'skip': 0, 'kind': '', 'tags': ''}}), lambda a, x: CASE
        WHEN a.skip > 0 THEN {{'i': x.i, 'skip': a.skip - 1, 'kind': a.kind, 'tags': a.tags || lower(a.kind)}}
        WHEN tok[x.i:x.i + len(c) - 1] = c THEN {{'i': x.i, 'skip': (len(c) - 1)::INT, 'kind': 'C', 'tags': a.tags || 'C'}}
        WHEN tok[x.i:x.i + len(e) - 1] = e THEN {{'i': x.i, 'skip': (len(e) - 1)::INT, 'kind': 'E', 'tags': a.tags || 'E'}}
        ELSE {{'i': x.i, 'skip': 0, 'kind': '', 'tags': a.tags || 'O'}} END,
      {{'i': 0::BIGINT, 'skip': 0, 'kind': '', 'tags': ''}}).tags AS tags, tagged_text, split FROM t""",
)
def load_phrase_corpus(spark, sf):
    """Two files that give cause and effect as phrases; every copy of a repeated text goes."""
    folder = scratch.shared_folder(spark)

    def plain(column):
        return F.replace(column, F.lit(";"), F.lit(","))

    def phrase(letter):
        return plain(F.regexp_extract("tagged_text", f"<{letter}>(.*?)</{letter}>", 1))

    numbered = F.regexp_replace(F.regexp_replace("tagged_text", "<(/?)c>", "<$1e1>"), "<(/?)e>", "<$1e2>")
    columns = [
        F.concat_ws(".", "src_id", "sent_id", "example_id").alias("Index"),
        plain(F.col("text")).alias("Text"),
        phrase("c").alias("Cause"),
        phrase("e").alias("Effect"),
        plain(numbered).alias("Sentence"),
    ]
    # A sort makes its input twice, for its ranges first. So phrases are cut out behind it.
    order = ["src_id", "sent_id", "example_id"]
    rows = span_rows(spark, sf)
    for number, part in enumerate(corpora.FINCAUSAL_PARTS):
        path = os.path.join(folder, corpora.FINCAUSAL_FILE.format(part=part, task=2))
        own = rows.where(F.col("src_id") % 2 == number).select(*order, "text", "tagged_text").orderBy(*order)
        _write_csv(own.select(*columns), path, "; ")
    loaded = corpora.load_corpus(spark, "fincausal", rules.SPAN, folder, seed=SEED)
    return loaded.select("example_id", "text", _letters(F.col("tags")).alias("tags"), "tagged_text", "split")


@query(
    "load_filtered_corpus",
    f"""{_EXPLICIT}, {views.TOKENS_SQL}, lone AS (
      SELECT *, count(*) OVER (PARTITION BY corpus, doc_id, sent_id) AS relations FROM span_rows WHERE {_TEST}
    ), test AS (
      SELECT l.* EXCLUDE (relations) FROM lone l JOIN judged j USING (doc_id, sent_id, example_id)
      WHERE explicit AND relations = 1 AND num_sents = 1
    ), rest AS (SELECT * FROM span_rows WHERE NOT {_TEST}), {_ADAPTIVE}, every AS (
      SELECT corpus, doc_id, sent_id, example_id, text, tagged_text, split FROM divided
      UNION ALL SELECT corpus, doc_id, sent_id, example_id, text, tagged_text, 'test' FROM test)
    SELECT e.example_id, e.text, array_to_string(tags, '|') AS tags, e.tagged_text, split
    FROM every e JOIN tagged t ON t.corpus = e.corpus AND t.doc_id = e.doc_id AND t.sent_id = e.sent_id AND t.eg_id = e.example_id""",
)
def load_filtered_corpus(spark, sf):
    """All three filters at once: lone, explicit relations of single sentences are the test part."""
    folder = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), os.path.join(folder, corpora.ONE_FILE["pdtb"]))
    loaded = corpora.load_corpus(
        spark, "pdtb", rules.SPAN, folder, num_sent="intra", num_causal="single", plicit="explicit", seed=SEED
    )
    return loaded.select("example_id", "text", F.array_join("tags", "|").alias("tags"), "tagged_text", "split")


_PAIR_CORPORA = [c for c in corpora.ALL_CORPORA[rules.SEQUENCE] if c != "fincausal"]


def _one_of_all(k: int) -> str:
    """CTEs of one corpus: the names of the adaptive split get its number."""
    named = re.sub(r"\b(ranked|rest|sizes|test|divided)\b(?!')", rf"\g<1>{k}", _ADAPTIVE)
    own = f"SELECT *, eg_id AS example_id FROM ann WHERE eg_id = 0 AND src_id % {len(_PAIR_CORPORA)} = {k}"
    return f"test{k} AS ({own} AND {_TEST}), rest{k} AS ({own} AND NOT {_TEST}), {named}"


_ALL_ROWS = " UNION ALL ".join(
    f"SELECT example_id, text, seq_label AS labels, split FROM divided{k} UNION ALL SELECT example_id, text, seq_label, 'test' FROM test{k}"
    for k in range(len(_PAIR_CORPORA))
)


@query(
    "load_all",
    f"""{_FIN}, {views.ANN_SQL}, {', '.join(map(_one_of_all, range(len(_PAIR_CORPORA))))}, numbered AS (
      SELECT *, part * 1000000000000000 + row_number() OVER (PARTITION BY part ORDER BY src_id, sent) - 1 AS row_id FROM fin
    ), firsts AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS k FROM numbered) WHERE k = 1
    ), fin_ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || row_id)) AS fr, count(*) OVER () AS fn FROM firsts)
    {_ALL_ROWS} UNION ALL SELECT regexp_replace(example_id, '[^0-9]', '', 'g')::BIGINT, text, labels,
      CASE WHEN fr <= fn - ceil(fn / 5) THEN 'train' WHEN fr <= fn - ceil(ceil(fn / 5) / 2) THEN 'valid' ELSE 'test' END FROM fin_ranked""",
)
def load_all(spark, sf):
    """All corpora of a task from their files, under one numbering of ids."""
    folder = scratch.shared_folder(spark)
    rows = views.pairs(spark, sf)
    is_test = F.col("doc_id").rlike("^wsj_(00|01|22|23|24)")
    for k, corpus in enumerate(_PAIR_CORPORA):
        own = rows.where(F.col("src_id") % len(_PAIR_CORPORA) == k)
        if corpus in corpora.ONE_FILE:
            write_pairs(own, os.path.join(folder, corpora.ONE_FILE[corpus]), packed=True)
            continue
        for part, chosen in (("train", ~is_test), ("test", is_test)):
            write_pairs(own.where(chosen), os.path.join(folder, f"{corpora.TWO_FILES[corpus]}_{part}.csv"), packed=True)
    _write_fincausal(spark, sf, folder, packed=True)
    return corpora.load_corpus(spark, "all", rules.SEQUENCE, folder, seed=SEED, done=delete_read(spark, folder))


# --- runs ------------------------------------------------------------------------


def _report_of(spark, folder: str, *columns: str):
    schema = ", ".join(f"{c} double" for c in columns)
    return spark.read.schema(schema).json(f"{folder}/runs/reports").select(*[F.round(c, 6).alias(c) for c in columns])


_SPLIT_AT = {" because ": ("after", "before"), " leads to ": ("before", "after")}
_GUESSED = "CASE " + " ".join(
    f"""WHEN contains(text, '{mark}') THEN 'Causes: [' || {parts[cause]} || ']' || chr(10) || 'Effects: [' || {parts[effect]} || ']'"""
    for mark, (cause, effect) in _SPLIT_AT.items()
    for parts in [{"before": f"text[:strpos(text, '{mark}') - 1]", "after": f"text[strpos(text, '{mark}') + {len(mark)}:]"}]
) + " ELSE 'no relation found' END"
_SPAN_RUN = _SPAN_PRED.replace(
    views.SPAN_RESPONSES_SQL,
    f"""lone AS (SELECT *, count(*) OVER (PARTITION BY corpus, doc_id, sent_id) AS relations FROM span_rows WHERE {_TEST}
    ), span_preds AS (SELECT corpus, doc_id, sent_id, tagged_text, {_GUESSED} AS output FROM lone WHERE relations = 1)""",
)


def _overlap_sql(part: str) -> str:
    truth, guess = f"string_split(true_{part}, ' ')", f"string_split(pred_{part}, ' ')"
    common = f"len(list_intersect({truth}, {guess}))::DOUBLE"
    n_truth, n_guess = f"len(list_distinct({truth}))", f"len(list_distinct({guess}))"
    return f"""avg({common} / {n_guess}) AS {part}_precision, avg({common} / {n_truth}) AS {part}_recall,
      avg(2 * {common} / ({n_truth} + {n_guess})) AS {part}_f1"""


@query(
    "evaluate_spans",
    f"""{_SPAN_RUN}, m AS (SELECT {_overlap_sql('cause')}, {_overlap_sql('effect')},
      avg((trim(true_cause) = trim(pred_cause) AND trim(true_effect) = trim(pred_effect))::INT) AS exact FROM parsed)
    SELECT {', '.join(f'round({p}_{x}, 6) AS {p}_{x}' for p in ('cause', 'effect') for x in ('precision', 'recall', 'f1'))},
      {', '.join(f'round((cause_{x} + effect_{x}) / 2, 6) AS {x}' for x in ('precision', 'recall', 'f1'))},
      round(exact, 5) AS exact_match FROM m""",
)
def evaluate_spans(spark, sf):
    """A span corpus file, prompts, a scorer that cuts at two cues, and the report."""
    folder = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), os.path.join(folder, corpora.ONE_FILE["pdtb"]))

    def answer(prompt):
        text = prompt.rsplit("Text: ", 1)[1].removesuffix("\n")
        for mark, places in _SPLIT_AT.items():
            before, found, after = text.partition(mark)
            if found:
                cause, effect = ({"before": before, "after": after}[p] for p in places)
                return f"Causes: [{cause}]\nEffects: [{effect}]"
        return "no relation found"

    evaluate.evaluate_prompts(
        spark, rules.SPAN, "pdtb", folder, f"{folder}/runs", TEMPLATES["span_detection"],
        lambda prompts: prompts.map(answer), "stub", shot=3, num_causal="single", resume_dir=f"{folder}/kept",
    )
    return _report_of(spark, folder, *_OVERLAPS, "exact_match")


_WORD_RUN = f"""{_WORDS.split(', word_preds AS')[0]}, lone AS (
  SELECT s.*, count(*) OVER (PARTITION BY corpus, doc_id, sent_id) AS relations FROM span_rows s WHERE {_TEST}
), guessed AS (
  SELECT t.tags, list_transform(range(1, 1 + len(t.tokens)), lambda i:
    CASE WHEN i = 1 THEN 'B-C' WHEN i <= 3 THEN 'I-C' WHEN i = len(t.tokens) THEN 'B-E' ELSE 'O' END) AS pred
  FROM lone s JOIN tagged t ON t.corpus = s.corpus AND t.doc_id = s.doc_id AND t.sent_id = s.sent_id AND t.eg_id = s.example_id
  WHERE relations = 1
), tg AS (SELECT unnest(tags) AS t, unnest(pred) AS g FROM guessed)"""


@query(
    "evaluate_words",
    f"""{_WORD_RUN}, a AS ({_scores_sql(_WORD_LABELS, 'macro', '', 'tg', 5)})
    SELECT a.*, (SELECT round(avg((tags = pred)::INT), 5) FROM guessed) AS exact_match FROM a""",
)
def evaluate_words(spark, sf):
    """The same corpus with answers by word: the first three tokens are the cause, the last one the effect."""
    folder = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), os.path.join(folder, corpora.ONE_FILE["pdtb"]))

    def answer(prompt):
        tokens = prompt.rsplit("[Tokens] ", 1)[1].removesuffix("\n").split(" / ")
        tags = ["B-C", "I-C", "I-C", *["O"] * len(tokens)][: len(tokens)]
        if len(tokens) > 3:
            tags[-1] = "B-E"
        return "[Labels]\n" + "".join(f"{token}: {tag}\n" for token, tag in zip(tokens, tags, strict=True))

    evaluate.evaluate_prompts(
        spark, rules.SPAN, "pdtb", folder, f"{folder}/runs", TEMPLATES["span_detection_by_word"],
        lambda prompts: prompts.map(answer), "stub", num_causal="single", by_word=True,
    )
    return _report_of(spark, folder, *_SCORES, "exact_match")


@query(
    "evaluate_chains",
    f"""WITH {views.INSTANCES_SQL}, p AS (
      SELECT labels::VARCHAR AS t, (length({_CHAIN_TEXT}) % 2)::VARCHAR AS g FROM inst_pairs
      WHERE split_part(example_id, '_', 2)::BIGINT % 3 = 2)
    {_scores_sql(['1'], 'binary', '', 'p', 5)}""",
)
def evaluate_chains(spark, sf):
    """Chain documents, read by ranges, prompts, a scorer, and the report."""
    folder = scratch.shared_folder(spark)
    rows = views.instances(spark, sf)
    for number, file in enumerate(corpora.SPLIT_FILES.values()):
        own = rows.where(F.col("index").cast("bigint") % 3 == number)
        _write_instances(own, os.path.join(folder, "reco", f"{file}.json"))
    template = TEMPLATES["chain_classification"]
    lead = len(template["task_description"] + template["question"])

    def answers(prompts):
        return "Classification: N" + (prompts.str.slice(lead).str.len() % 2).astype(str)

    evaluate.evaluate_prompts(spark, rules.CHAIN, "reco", folder, f"{folder}/runs", template, answers, "stub")
    return _report_of(spark, folder, *_SCORES)


@query(
    "encoder_report",
    f"""WITH p AS (SELECT (l.quality = 1)::INT::VARCHAR AS t, ((d.n_chars % 10) > 4)::INT::VARCHAR AS g
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id), a AS ({_scores_sql(['1'], 'binary', '', 'p')})
    SELECT a.*, (SELECT round(avg((g = '0')::INT), 6) FROM p WHERE t = '0') AS accuracy_0 FROM a""",
)
def encoder_report(spark, sf):
    """Score vectors of two classes; the first maximum is the prediction."""
    labels = views.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).cast("int").alias("labels"))
    score = (F.col("n_chars") % 10).cast("double")
    scored = documents(spark, sf).join(labels, "doc_id").select("labels", F.array(F.lit(4.0), score).alias("scores"))
    out = evaluate.encoder_report(scored, rules.SEQUENCE)
    return _rounded(out, _SCORES).withColumn("accuracy_0", F.round(F.col("class_accuracy")["accuracy_0"], 6)).drop("class_accuracy")


@query(
    "encoder_span_report",
    f"""{_IDS}, kept AS (SELECT t::VARCHAR AS t, g::VARCHAR AS g FROM tg WHERE t <> -100),
    r AS (SELECT bool_and(t = -100 OR t = g) AS ok FROM tg GROUP BY corpus, doc_id, sent_id, eg_id),
    a AS ({_scores_sql(['1', '2'], 'macro', '', 'kept')})
    SELECT a.*, (SELECT round(avg(ok::INT), 6) FROM r) AS exact_match FROM a""",
)
def encoder_span_report(spark, sf):
    """One score vector per token; ignored labels count for nothing."""
    rows = _label_rows(spark, sf)
    vector = lambda g: F.array(*[F.when(g == c, 1.0).otherwise(0.0) for c in range(3)])
    scored = rows.select(F.col("truth").alias("labels"), F.transform("guess", vector).alias("scores"))
    out = evaluate.encoder_report(scored, rules.SPAN)
    return _rounded(out, [*_SCORES, "exact_match"]).select(*_SCORES, "exact_match")


# --- templates, order, tokenizers -----------------------------------------------------


@query(
    "scan_templates",
    """SELECT 'About ' || source AS task_description, 'Examples:' AS header_example, 'Text: {}' AS format_text, lang AS format_class,
      CASE WHEN doc_id % 3 > 0 THEN 'Is it so, ' || doc_id || '?' END AS question,
      CASE WHEN doc_id % 3 > 0 THEN '' ELSE 'question' END AS missing_keys
    FROM (SELECT source, min(doc_id) AS doc_id, min(lang) AS lang FROM documents WHERE source IS NOT NULL GROUP BY source)""",
)
def scan_templates(spark, sf):
    """A template file for every source; some lack a key."""
    path = scratch.shared_folder(spark)
    sources = documents(spark, sf).where("source IS NOT NULL").groupBy("source").agg(
        F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang")
    )
    rows = sources.select(
        F.concat(F.lit("About "), "source").alias("task_description"),
        F.lit("Examples:").alias("header_example"),
        F.lit("Text: {}").alias("format_text"),
        F.col("lang").alias("format_class"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Is it so, "), "doc_id", F.lit("?"))).alias("question"),
    )
    rows.write.option("maxRecordsPerFile", 1).json(path)
    read = readers.read_templates(spark, path)
    return read.select(*REQUIRED_KEYS, F.array_join("missing_keys", ",").alias("missing_keys"))


@query("seeded_shuffle", f"SELECT doc_id, rank AS place FROM ({_RANKED})")
def seeded_shuffle(spark, sf):
    """The order of a seeded shuffle, by the place at which each row then stands."""
    shuffled = splits.shuffle(documents(spark, sf).select("doc_id"), SEED, ["doc_id"])
    return ranking.with_input_position(shuffled, "place")


def _pieces_sql(part: str) -> str:
    truth, guess = (f"string_split_regex(lower({side}_{part}), '[ ,.]+')" for side in ("true", "pred"))
    common = f"len(list_intersect({truth}, {guess}))::DOUBLE"
    return f"avg(2 * {common} / (len(list_distinct({truth})) + len(list_distinct({guess})))) AS {part}_f1"


@query(
    "tokenizer_overlap",
    f"""{_SPAN_PRED} SELECT corpus, round({_pieces_sql('cause').split(' AS ')[0]}, 6) AS cause_f1,
      round({_pieces_sql('effect').split(' AS ')[0]}, 6) AS effect_f1 FROM parsed GROUP BY 1""",
)
def tokenizer_overlap(spark, sf):
    """Overlap of spans under another tokenizer than blanks."""
    tokenizer = lambda text: F.split(F.lower(text), "[ ,.]+")
    out = spans.span_overlap_report(_span_predictions(spark, sf), ["corpus"], tokenizer)
    return _rounded(out, ["cause_f1", "effect_f1"]).select("corpus", "cause_f1", "effect_f1")


@query(
    "word_pairs_by_position",
    f"""{_WORDS} SELECT doc_id, sent_id, example_id, array_to_string(tags, '|') AS tags, array_to_string(pred, '|') AS pred FROM word_preds""",
)
def word_pairs_by_position(spark, sf):
    """Predictions without keys beside their references, both in the order of the references."""
    order = ["doc_id", "sent_id", "example_id", "corpus"]
    joined = [F.array_join(c, "|").alias(c) for c in ("tags", "pred")]
    # Two sorts read the rows, each twice to find its ranges; they are made once.
    rows = scratch.staged(_word_predictions(spark, sf).select(*order, *joined)).orderBy(*order)
    keyed = rows.select("doc_id", "sent_id", "example_id", "tags")
    return prompting.pair_by_position(rows.select("pred"), keyed)
