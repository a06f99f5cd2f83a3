"""Files in every corpus layout: write the derived tables, read them back, load corpora."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import TEMPLATES
from ..operators import prompting, report
from ..sources import corpora, ranges, readers, rules, scratch, sinks
from . import views
from .corpus_queries import MERGED_SQL, SEED, documents
from .registry import query
from .report_queries import _PRED, _predictions, _scores_sql

_ANN = f"WITH {views.PAIRS_SQL}"
_TEST = "regexp_matches(doc_id, '^wsj_(00|01|22|23|24).+')"


def _write_csv(df: DataFrame, path: str, sep: str = ",", packed: bool = False) -> None:
    writer = df.write.option("header", True).option("sep", sep).option("escape", '"')
    if sep == "; ":
        writer = writer.option("quote", "")
    if packed:
        writer = writer.option("compression", "gzip")
    with scratch.shuffles_removed(df.sparkSession):
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_pairs(df: DataFrame, path: str, packed: bool = False) -> None:
    # Columns in another order and one too many, as in the published files, and whole
    # numbers written with a decimal point.
    rows = df.withColumn("seq_label", F.concat("seq_label", F.lit(".0")))
    others = [c for c in readers.PAIR_COLUMNS if c not in ("eg_id", "text")]
    _write_csv(rows.select("eg_id", "text", F.lit("x").alias("context"), *others), path, packed=packed)


@query(
    "scan_pairs_csv",
    f"{_ANN} SELECT corpus, doc_id, sent_id, eg_id, text, text_w_pairs, seq_label, pair_label, num_sents FROM ann",
)
def scan_pairs_csv(spark, sf):
    path = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), path)
    return readers.read_pairs_csv(spark, path)


_FIN = f"""WITH {views.SENTENCES_SQL}, fin AS (
  SELECT src_id % 2 AS part, 'fincausal' || CASE WHEN src_id % 2 = 0 THEN '' ELSE '2' END || '_' || src_id || '.' || sent AS example_id,
    replace(s, ';', ',') AS text, (src_id + sent) % 2 AS labels, src_id, sent FROM sents)"""


def _write_fincausal(spark, sf, folder: str, torn: int = 0, packed: bool = False) -> None:
    """``torn``: lines of every so many documents get a field too many."""
    rows = views.sentences(spark, sf).select(
        F.concat_ws(".", "src_id", "sent").alias("Index"),
        F.replace("s", F.lit(";"), F.lit(",")).alias("Text"),
        ((F.col("src_id") + F.col("sent")) % 2).alias("Gold"),
        "src_id",
        "sent",
    )
    if torn:
        extra = F.concat("Text", F.lit("; and more"))
        rows = rows.withColumn("Text", F.when(F.col("src_id") % torn == 0, extra).otherwise(F.col("Text")))
    for number, part in enumerate(corpora.FINCAUSAL_PARTS):
        path = os.path.join(folder, corpora.FINCAUSAL_FILE.format(part=part, task=1))
        ordered = rows.where(F.col("src_id") % 2 == number).orderBy("src_id", "sent")
        _write_csv(ordered.select("Index", "Text", "Gold"), path, "; ", packed)


def delete_read(spark, folder: str) -> Callable[[str], None]:
    """Deletes the files of a corpus below ``folder``, which were written for one query."""

    def done(corpus: str) -> None:
        if corpus in corpora.TWO_FILES:
            names = [f"{corpora.TWO_FILES[corpus]}_{part}.csv" for part in ("train", "test")]
        elif corpus in corpora.ONE_FILE:
            names = [corpora.ONE_FILE[corpus]]
        else:
            names = [corpora.FINCAUSAL_FILE.format(part=part, task=1) for part in corpora.FINCAUSAL_PARTS]
        for name in names:
            scratch.discard(spark, os.path.join(folder, name))

    return done


@query(
    "scan_delimited",
    f"{_FIN} SELECT example_id, text, labels::VARCHAR AS labels FROM fin WHERE src_id % 40 <> 0",
)
def scan_delimited(spark, sf):
    folder = scratch.shared_folder(spark)
    _write_fincausal(spark, sf, folder, torn=40)
    paths = {
        f"fincausal{part}": os.path.join(folder, corpora.FINCAUSAL_FILE.format(part=part, task=1))
        for part in corpora.FINCAUSAL_PARTS
    }
    rows = readers.read_delimited(spark, paths, corpora.FINCAUSAL_COLUMNS[rules.SEQUENCE])
    return rows.select(
        F.col("Index").alias("example_id"), F.col("Text").alias("text"), F.col("Gold").alias("labels")
    )


@query(
    "scan_tsv",
    "SELECT n_chars % 2 AS labels, 'kessan_' || doc_id AS example_id, replace(text, chr(10), ' ') AS text FROM documents",
)
def scan_tsv(spark, sf):
    path = scratch.shared_folder(spark)
    rows = documents(spark, sf).select(
        (F.col("n_chars") % 2).alias("gold"),
        F.col("doc_id").alias("id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("sentence"),
    )
    _write_csv(rows, path, "\t")
    read = readers.read_tsv(spark, path, "labels bigint, example_id string, text string")
    return read.withColumn("example_id", F.concat_ws("_", F.lit("kessan"), "example_id"))


_CLUES = f"WITH {views.CLUE_SENTENCES_SQL}"


@query(
    "scan_jsonl",
    f"""{_CLUES} SELECT 'kessan_train_' || (row_number() OVER (ORDER BY src_id, sent_id) - 1) AS example_id,
      tagged_sentence FROM clues""",
)
def scan_jsonl(spark, sf):
    path = scratch.shared_folder(spark)
    rows = views.clue_sentences(spark, sf).orderBy("src_id", "sent_id")
    rows.select("tagged_sentence").write.json(path)
    return readers.read_jsonl(spark, path, "tagged_sentence string", "kessan_train")


def _write_instances(df: DataFrame, path: str) -> None:
    one = F.struct("index", "events", "short_contexts", "label")
    df.select(F.array(one).alias("instances")).write.json(path)


@query(
    "scan_instances",
    f"""WITH {views.INSTANCES_SQL} SELECT doc_id::VARCHAR AS index,
      array_to_string(list_transform(parts, lambda s: replace(s, ' ', '_')), '|') AS events,
      array_to_string(parts[:len(parts) - 1], '|') AS short_contexts, label FROM inst""",
)
def scan_instances(spark, sf):
    path = scratch.shared_folder(spark)
    _write_instances(views.instances(spark, sf), path)
    rows = readers.read_instances(spark, path, multi_line=False)
    return rows.withColumns(
        {c: F.array_join(c, "|") for c in ("events", "short_contexts")}
    )


@query("scan_json_elements", f"""WITH {views.INSTANCES_SQL} SELECT doc_id::VARCHAR AS index,
      array_to_string(parts, '|') AS events, array_to_string(parts[:len(parts) - 1], '|') AS short_contexts, label FROM inst""")
def scan_json_elements(spark, sf):
    """Documents that hold an array, read by ranges; what else they hold is skipped."""
    path = scratch.shared_folder(spark)
    one = F.struct("index", F.col("parts").alias("events"), "short_contexts", "label")
    about = F.struct(F.array(F.struct(F.lit("{[").alias("index"))).alias("instances"))
    rows = views.instances(spark, sf).withColumn("parts", F.transform("events", lambda e: F.replace(e, F.lit("_"), F.lit(" "))))
    rows.select(about.alias("about"), F.array(one).alias("instances")).write.json(path)
    rows = readers.read_instances(spark, path)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("events", "short_contexts")})


@query("scan_quoted_csv", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def scan_quoted_csv(spark, sf):
    """Whole texts with their line breaks and quotes, read by ranges."""
    path = scratch.shared_folder(spark)
    _write_csv(documents(spark, sf).select("doc_id", "text", "lang"), path)
    return ranges.read_quoted_csv(spark, path)


# --- whole corpora ---------------------------------------------------------------

_KEY = "corpus || '|' || doc_id || '|' || sent_id || '|' || example_id || '|' || text || '|' || text_w_pairs"
_ADAPTIVE = f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || {_KEY})) AS rank, count(*) OVER () AS n FROM rest
), sizes AS (SELECT count(*) AS n_test FROM test), divided AS (
  SELECT * EXCLUDE (rank, n, n_test), CASE WHEN rank <= n - CASE WHEN n_test * 4 < n THEN n_test ELSE n // 5 END
    THEN 'train' ELSE 'valid' END AS split FROM ranked, sizes)"""


@query(
    "load_span_corpus",
    f"""{_ANN}, {views.SPAN_ROWS_SQL}, {MERGED_SQL}, {views.TOKENS_SQL}, test AS (
      SELECT corpus, doc_id, sent_id, example_id, text, tagged_text FROM merged WHERE tagged_text IS NOT NULL AND {_TEST}
    ), rest AS (SELECT * FROM span_rows WHERE NOT {_TEST}), {_ADAPTIVE}, every AS (
      SELECT corpus, doc_id, sent_id, example_id, text, tagged_text, split FROM divided
      UNION ALL SELECT *, 'test' FROM test)
    SELECT e.example_id, e.text, array_to_string(tokens, '|') AS tokens, array_to_string(tags, '|') AS tags, tagged_text, split
    FROM every e JOIN tagged t ON t.corpus = e.corpus AND t.doc_id = e.doc_id AND t.sent_id = e.sent_id AND t.eg_id = e.example_id""",
)
def load_span_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), os.path.join(folder, corpora.ONE_FILE["pdtb"]))
    rows = corpora.load_corpus(spark, "pdtb", rules.SPAN, folder, seed=SEED)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("tokens", "tags")})


@query(
    "load_sequence_corpus",
    f"""{_ANN}, seq AS (SELECT *, eg_id AS example_id FROM ann WHERE eg_id = 0),
    test AS (SELECT * FROM seq WHERE {_TEST} AND num_sents = 1), rest AS (SELECT * FROM seq WHERE NOT {_TEST}), {_ADAPTIVE}
    SELECT example_id, text, seq_label AS labels, split FROM divided
    UNION ALL SELECT example_id, text, seq_label, 'test' FROM test""",
)
def load_sequence_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    rows = views.pairs(spark, sf)
    is_test = F.col("doc_id").rlike("^wsj_(00|01|22|23|24)")
    for part, chosen in (("train", ~is_test), ("test", is_test)):
        write_pairs(rows.where(chosen), os.path.join(folder, f"{corpora.TWO_FILES['ctb']}_{part}.csv"))
    return corpora.load_corpus(spark, "ctb", rules.SEQUENCE, folder, num_sent="intra", seed=SEED)


@query(
    "load_delimited_corpus",
    f"""{_FIN}, numbered AS (
      SELECT *, part * 1000000000000000 + row_number() OVER (PARTITION BY part ORDER BY src_id, sent) - 1 AS row_id FROM fin
    ), firsts AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS k FROM numbered) WHERE k = 1
    ), ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || row_id)) AS rank, count(*) OVER () AS n FROM firsts)
    SELECT example_id, text, labels, CASE WHEN rank <= n - ceil(n / 5) THEN 'train'
      WHEN rank <= n - ceil(ceil(n / 5) / 2) THEN 'valid' ELSE 'test' END AS split FROM ranked""",
)
def load_delimited_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    _write_fincausal(spark, sf, folder)
    return corpora.load_corpus(spark, "fincausal", rules.SEQUENCE, folder, seed=SEED)


@query(
    "load_cross_corpus",
    f"""{_FIN}, {views.ANN_SQL},
    seq AS (SELECT *, eg_id AS example_id FROM ann WHERE eg_id = 0),
    test AS (SELECT * FROM seq WHERE {_TEST}), rest AS (SELECT * FROM seq WHERE NOT {_TEST}), {_ADAPTIVE}, numbered AS (
      SELECT *, part * 1000000000000000 + row_number() OVER (PARTITION BY part ORDER BY src_id, sent) - 1 AS row_id FROM fin
    ), firsts AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS k FROM numbered) WHERE k = 1
    ), fin_ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || row_id)) AS fr, count(*) OVER () AS fn FROM firsts)
    SELECT example_id::VARCHAR AS example_id, text, seq_label AS labels, split FROM divided
    UNION ALL (SELECT example_id, text, labels, 'test' FROM fin_ranked WHERE fr > fn - ceil(ceil(fn / 5) / 2)
      ORDER BY example_id, text LIMIT 50)""",
)
def load_cross_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    write_pairs(views.pairs(spark, sf), os.path.join(folder, corpora.ONE_FILE["because"]), packed=True)
    _write_fincausal(spark, sf, folder, packed=True)
    return corpora.load_data(
        spark,
        rules.SEQUENCE,
        "because",
        folder,
        test_corpus="fincausal",
        test_samples=50,
        seed=SEED,
        done=delete_read(spark, folder),
    )


@query(
    "load_tsv_corpus",
    f"""WITH rows AS (
      SELECT n_chars % 2 AS labels, 'kessan_' || doc_id AS example_id, replace(text, chr(10), ' ') AS text FROM documents
    ), ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || example_id || '|' || text)) AS rank, count(*) OVER () AS n FROM rows)
    SELECT example_id, text, labels, CASE WHEN rank <= n - ceil(n / 5) THEN 'train'
      WHEN rank <= n - ceil(ceil(n / 5) / 2) THEN 'valid' ELSE 'test' END AS split FROM ranked""",
)
def load_tsv_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    rows = documents(spark, sf).select(
        (F.col("n_chars") % 2).alias("gold"),
        F.col("doc_id").alias("id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("sentence"),
    )
    name, _ = corpora.JAPANESE_TSV["jpfinresults"]
    _write_csv(rows, os.path.join(folder, name), "\t")
    return corpora.load_corpus(spark, "jpfinresults", rules.SEQUENCE, folder, seed=SEED)


@query(
    "load_chain_corpus",
    f"""WITH {views.INSTANCES_SQL}, placed AS (SELECT *, split_part(example_id, '_', 2)::BIGINT % 3 AS part FROM inst_pairs)
    SELECT example_id, array_to_string(events, '|') AS events, array_to_string(short_contexts, '|') AS short_contexts, labels,
      CASE part WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM placed""",
)
def load_chain_corpus(spark, sf):
    folder = scratch.shared_folder(spark)
    rows = views.instances(spark, sf)
    for number, file in enumerate(corpora.SPLIT_FILES.values()):
        chosen = rows.where(F.col("index").cast("bigint") % 3 == number)
        _write_instances(chosen, os.path.join(folder, "reco", f"{file}.json"))
    rows = corpora.load_corpus(spark, "reco", rules.CHAIN, folder, multi_line=False)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("events", "short_contexts")})


@query(
    "load_quarantine",
    f"""{_ANN} SELECT 'number' AS reason, doc_id, eg_id::VARCHAR AS eg_id, text FROM ann WHERE src_id % 50 = 0""",
)
def load_quarantine(spark, sf):
    """Rows whose sentence number is none, out of a corpus file."""
    folder = scratch.shared_folder(spark)
    rows = views.pairs(spark, sf)
    spoilt = F.when(F.col("src_id") % 50 == 0, "n/a").otherwise(F.col("sent_id").cast("string"))
    write_pairs(rows.withColumn("sent_id", spoilt), os.path.join(folder, corpora.ONE_FILE["pdtb"]))
    rejected = corpora.load_quarantine(spark, "pdtb", rules.SPAN, folder)
    return rejected.select(
        "reason", *[F.get_json_object("record", f"$.{c}").alias(c) for c in ("doc_id", "eg_id", "text")]
    )


# --- sinks -----------------------------------------------------------------------


@query(
    "report_sink",
    f"""{_PRED} SELECT *, 'sequence_classification' AS task, source AS dataset, 'intra' AS filters
    FROM ({_scores_sql(['1'], 'binary', 'source', 'p', 5)})""",
)
def report_sink(spark, sf):
    scores = report.classification_report(
        _predictions(spark, sf), "labels", "pred", ["1"], "binary", ["source"]
    )
    rows = report.round_metrics(scores, ["accuracy", "f1", "precision", "recall"]).withColumns(
        {
            "task": F.lit(rules.SEQUENCE),
            "dataset": F.col("source"),
            "filters": F.lit(sinks.filter_tag(num_sent="intra")),
        }
    )
    path = scratch.shared_folder(spark)
    sinks.write_report(rows, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spark.read.schema(schema).json(path).select(*rows.columns)


@query(
    "prediction_sink",
    f"""WITH {views.PAIRS_SQL}, {views.TOKENS_SQL}, {views.SPAN_ROWS_SQL}, {views.WORD_RESPONSES_SQL}
    SELECT doc_id, sent_id, example_id, array_to_string(tokens, '|') AS tokens, array_to_string(pred, '|') AS pred,
      'span_detection' AS task FROM word_preds""",
)
def prediction_sink(spark, sf):
    rows = views.word_responses(
        corpora.tag_pairs(corpora.select_pairs(views.pairs(spark, sf), rules.SPAN))
    )
    rows = prompting.word_predictions(rows, TEMPLATES["span_detection_by_word"])
    path = scratch.shared_folder(spark)
    sinks.write_predictions(
        rows.select("doc_id", "sent_id", "example_id", "tokens", "pred", F.lit(rules.SPAN).alias("task")),
        path,
    )
    # Line breaks are escaped in the tokens' JSON, so a row is a line and tasks share a file.
    read = (
        spark.read.schema(
            "doc_id string, sent_id bigint, example_id bigint, tokens string, pred string, task string"
        )
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )
    return read.withColumns(
        {c: F.array_join(F.from_json(c, "array<string>"), "|") for c in ("tokens", "pred")}
    )
