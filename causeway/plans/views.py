"""Annotated corpora derived from the given tables, for Spark and as SQL.

Every sentence of every document becomes an annotated pair row: its words are
kept in order, the first eight of them are marked as spans around a cue, and
sentences too short for that are rows without a relation.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a session on one machine may ask for its rows to be dealt out.

    The test tables are single files, which one task would read. A cluster's tables
    have many files, and it does not set ``spark.causeway.tables.partitions``.
    """
    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    parts = spark.conf.get("spark.causeway.tables.partitions", "")
    return rows.repartition(int(parts)) if parts and name in DEALT else rows


# Tables from which text is derived; the others are small.
DEALT = ("documents",)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty sentences: ``src_id, source, sent, s, words``."""
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").alias("src_id"),
            "source",
            F.posexplode(F.split("text", "[.\n]+")).alias("sent", "s"),
        )
        .withColumn("s", F.trim("s"))
        .where("s <> ''")
        .withColumn("words", F.split("s", " +"))
    )


SENTENCES_SQL = """
sents AS (
  SELECT src_id, source, sent, s, string_split_regex(s, ' +') AS words FROM (
    SELECT src_id, source, generate_subscripts(parts, 1) - 1 AS sent, trim(unnest(parts), ' ') AS s
    FROM (SELECT doc_id AS src_id, source, string_split_regex(text, '[.\n]+') AS parts FROM documents)
  ) WHERE s <> ''
)"""


def _words(dialect: str, start: str, count: str) -> str:
    if dialect == "spark":
        return f"array_join(slice(words, {start}, {count}), ' ')"
    return f"array_to_string(words[{start}:{start} + {count} - 1], ' ')"


def _size(dialect: str) -> str:
    return "size(words)" if dialect == "spark" else "len(words)"


def _head(cause: str, effect: str) -> str:
    return f"""CASE layout WHEN 0 THEN {cause} || ' leads to ' || {effect}
      WHEN 1 THEN {effect} || ' because ' || {cause}
      WHEN 2 THEN 'Once ' || {cause} || ', ' || {effect}
      WHEN 3 THEN {cause} || ' zzz ' || {effect}
      WHEN 4 THEN {cause} || ' has been the reason why ' || {effect}
      ELSE {cause} || ', ' || {effect} END"""


def _spans(dialect: str, source: str) -> str:
    """Sentences of eight words or more, cut into two causes, two effects and the rest."""
    return f"""SELECT src_id, source, sent, {_words(dialect, '1', 'k')} AS c1,
      {_words(dialect, '(k + 1)', '2')} AS e1, {_words(dialect, '(k + 3)', '2')} AS c2,
      {_words(dialect, '(k + 5)', '2')} AS e2, {_words(dialect, '(k + 7)', _size(dialect))} AS rest
    FROM (SELECT *, CASE WHEN sent % 9 = 0 THEN 1 ELSE 2 END AS k FROM {source}
          WHERE {_size(dialect)} >= 8)"""


def _ann_select(sents: str, labels: str) -> str:
    plain, marked = _head("c1", "e1"), _head("'<ARG0>' || c1 || '</ARG0>'", "'<ARG1>' || e1 || '</ARG1>'")
    return f"""
  SELECT r.source AS corpus,
    'wsj_' || lpad(cast(r.src_id % 25 AS string), 2, '0') || lpad(cast(r.src_id AS string), 9, '0') AS doc_id,
    cast(r.sent AS bigint) AS sent_id, cast(r.eg_id AS bigint) AS eg_id, r.src_id, r.text, r.text_w_pairs,
    cast(1 + r.sent % 3 AS bigint) AS num_sents, cast(coalesce(l.quality, 0) AS bigint) AS seq_label,
    cast(r.is_pair AS bigint) AS pair_label
  FROM (
    SELECT src_id, source, sent, 0 AS eg_id, text, head_marked || sp || c2 || ' and ' || e2 || tail AS text_w_pairs,
      1 AS is_pair FROM (
      SELECT *, head_plain || sp || CASE WHEN (src_id + sent) % 28 = 0 THEN 'omitted' ELSE c2 END
        || ' and ' || e2 || tail AS text FROM (
        SELECT *, {plain} AS head_plain, {marked} AS head_marked FROM (
          SELECT *, (src_id * 7 + sent) % 6 AS layout, CASE WHEN sent % 13 = 0 THEN '  ' ELSE ' ' END AS sp,
            CASE WHEN rest = '' THEN '.' ELSE ' ' || rest || '.' END AS tail
          FROM ({_spans('duckdb', sents)}) AS spans) AS a) AS b) AS c
    UNION ALL
    SELECT src_id, source, sent, 1 AS eg_id, text,
      head_plain || sp || '<ARG0>' || c2 || '</ARG0> and <ARG1>' || e2 || '</ARG1>' || tail AS text_w_pairs,
      1 AS is_pair FROM (
      SELECT *, head_plain || sp || CASE WHEN (src_id + sent) % 28 = 0 THEN 'omitted' ELSE c2 END
        || ' and ' || e2 || tail AS text FROM (
        SELECT *, {plain} AS head_plain FROM (
          SELECT *, (src_id * 7 + sent) % 6 AS layout, CASE WHEN sent % 13 = 0 THEN '  ' ELSE ' ' END AS sp,
            CASE WHEN rest = '' THEN '.' ELSE ' ' || rest || '.' END AS tail
          FROM ({_spans('duckdb', sents)}) AS spans) AS a) AS b
      WHERE (src_id + sent) % 4 = 0) AS c
    UNION ALL
    SELECT src_id, source, sent, 0 AS eg_id, s || '.' AS text, s || '.' AS text_w_pairs, 0 AS is_pair
    FROM {sents} WHERE len(words) < 8
  ) AS r LEFT JOIN {labels} AS l ON l.doc_id = r.src_id"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated pairs: one row per relation, or per sentence without one.

    The same rows as the SQL, made in one pass over the sentences.
    """
    number = F.col("src_id") + F.col("sent")
    size, k = F.size("words"), F.when(F.col("sent") % 9 == 0, 1).otherwise(2)

    def words(start, count):
        return F.array_join(F.slice("words", start, count), " ")

    cut = sentences(spark, sf_dir).select(
        "src_id",
        "source",
        "sent",
        "s",
        (size >= 8).alias("is_pair"),
        words(F.lit(1), k).alias("c1"),
        words(k + 1, F.lit(2)).alias("e1"),
        words(k + 3, F.lit(2)).alias("c2"),
        words(k + 5, F.lit(2)).alias("e2"),
        words(k + 7, size).alias("rest"),
    )

    def join(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def head(c, e):
        layout = (F.col("src_id") * 7 + F.col("sent")) % 6
        return (
            F.when(layout == 0, join(c, " leads to ", e))
            .when(layout == 1, join(e, " because ", c))
            .when(layout == 2, join("Once ", c, ", ", e))
            .when(layout == 3, join(c, " zzz ", e))
            .when(layout == 4, join(c, " has been the reason why ", e))
            .otherwise(join(c, ", ", e))
        )

    c1, e1, c2, e2 = (F.col(c) for c in ("c1", "e1", "c2", "e2"))
    marked = head(join("<ARG0>", c1, "</ARG0>"), join("<ARG1>", e1, "</ARG1>"))
    built = cut.select(
        "src_id",
        "source",
        "sent",
        "s",
        "is_pair",
        "c2",
        "e2",
        head(c1, e1).alias("plain"),
        marked.alias("marked"),
        F.when(F.col("sent") % 13 == 0, "  ").otherwise(" ").alias("sp"),
        F.when(F.col("rest") == "", ".").otherwise(join(" ", F.col("rest"), ".")).alias("tail"),
    )
    plain, sp, tail = F.col("plain"), F.col("sp"), F.col("tail")
    shown = F.when(number % 28 == 0, "omitted").otherwise(c2)
    text = join(plain, sp, shown, " and ", e2, tail)
    first = join(F.col("marked"), sp, c2, " and ", e2, tail)
    second = join(plain, sp, "<ARG0>", c2, "</ARG0> and <ARG1>", e2, "</ARG1>", tail)

    def relation(eg_id, text, text_w_pairs):
        return F.struct(
            F.lit(eg_id).cast("bigint").alias("eg_id"),
            text.alias("text"),
            text_w_pairs.alias("text_w_pairs"),
        )

    short = join(F.col("s"), ".")
    relations = (
        F.when(~F.col("is_pair"), F.array(relation(0, short, short)))
        .when(number % 4 == 0, F.array(relation(0, text, first), relation(1, text, second)))
        .otherwise(F.array(relation(0, text, first)))
    )
    rows = built.select("src_id", "source", "sent", "is_pair", F.inline_outer(relations))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("src_id"), "quality")
    number_text = F.col("src_id").cast("string")
    return rows.join(quality, "src_id", "left").select(
        F.col("source").alias("corpus"),
        join(
            "wsj_",
            F.lpad((F.col("src_id") % 25).cast("string"), 2, "0"),
            F.lpad(number_text, 9, "0"),
        ).alias("doc_id"),
        F.col("sent").cast("bigint").alias("sent_id"),
        "eg_id",
        "src_id",
        "text",
        "text_w_pairs",
        (1 + F.col("sent") % 3).cast("bigint").alias("num_sents"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("bigint").alias("seq_label"),
        F.col("is_pair").cast("bigint").alias("pair_label"),
    )


ANN_SQL = f"ann AS ({_ann_select('sents', 'labels')})"
PAIRS_SQL = f"{SENTENCES_SQL}, {ANN_SQL}"

# One row per token of every pair, tagged by the last marker at or before it.
TOKENS_SQL = """
raw AS (
  SELECT corpus, doc_id, sent_id, eg_id, src_id, pair_label, generate_subscripts(parts, 1) AS pos, unnest(parts) AS tok
  FROM (SELECT *, string_split(text_w_pairs, ' ') AS parts FROM ann)
), marks AS (
  SELECT *, CASE WHEN contains(tok, '<ARG0>') THEN 1 WHEN contains(tok, '</ARG0>') THEN 2
    WHEN contains(tok, '<ARG1>') THEN 3 WHEN contains(tok, '</ARG1>') THEN 4 END AS mark FROM raw
), bio AS (
  SELECT corpus, doc_id, sent_id, eg_id, src_id, pair_label, pos, regexp_replace(tok, '</*[A-Z]+[0-9]*>', '', 'g') AS token,
    CASE mark WHEN 1 THEN 'B-C' WHEN 2 THEN 'I-C' WHEN 3 THEN 'B-E' WHEN 4 THEN 'I-E' ELSE
      CASE coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY corpus, doc_id, sent_id, eg_id
        ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      WHEN 1 THEN 'I-C' WHEN 3 THEN 'I-E' ELSE 'O' END END AS tag
  FROM marks
), tagged AS (
  SELECT corpus, doc_id, sent_id, eg_id, src_id, pair_label, list(token ORDER BY pos) AS tokens, list(tag ORDER BY pos) AS tags
  FROM bio GROUP BY ALL
)"""

# Span rows: positive pairs with their markup as <c> and <e>.
SPAN_ROWS_SQL = """
span_rows AS (
  SELECT corpus, doc_id, sent_id, eg_id AS example_id, src_id, text, text_w_pairs, num_sents,
    replace(replace(replace(replace(text_w_pairs, '<ARG0>', '<c>'), '</ARG0>', '</c>'), '<ARG1>', '<e>'), '</ARG1>', '</e>') AS tagged_text
  FROM ann WHERE pair_label = 1
)"""

_PREDS = """
  SELECT d.doc_id, cast(l.quality AS bigint) AS labels, l.toxic,
    CASE WHEN d.doc_id % 17 = 0 THEN 'cannot say'
         WHEN d.doc_id % 3 = 0 THEN concat('Classification: N', cast(1 - l.quality AS string))
         ELSE concat('Classification: N', cast(l.quality AS string)) END AS output,
    d.source, d.lang
  FROM {documents} AS d JOIN {labels} AS l ON l.doc_id = d.doc_id"""


def class_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class responses beside the gold label."""
    return spark.sql(
        _PREDS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")
    )


CLASS_RESPONSES_SQL = f"preds AS ({_PREDS.format(documents='documents', labels='labels')})"

_SPAN_RESPONSES = """
  SELECT corpus, doc_id, sent_id, tagged_text,
    CASE WHEN (src_id + sent_id) % 7 = 0 THEN 'no relation found'
      WHEN (src_id + sent_id) % 3 = 0 THEN 'Causes: [' || e || ']' || chr(10) || 'Effects: [' || c || ']'
      WHEN (src_id + sent_id) % 11 = 0 THEN 'Causes: [' || c || ']' || chr(10) || 'Effects: [' || e || ']'
      WHEN (src_id + sent_id) % 5 = 0 THEN 'Causes: x' || chr(10) || 'Causes: ' || c || chr(10) || 'Effects: ' || e
      ELSE 'Causes: [' || c || ']' || chr(10) || 'Effects: [' || split_part(e, ' ', 1) || ']' END AS output
  FROM (SELECT *, regexp_extract(tagged_text, '<c>(.*?)</c>', 1) AS c,
          regexp_extract(tagged_text, '<e>(.*?)</e>', 1) AS e FROM {span_rows}) AS x"""


def span_responses(spark: SparkSession, span_rows: DataFrame) -> DataFrame:
    """Span responses: right, swapped, partly right, unparsable."""
    return spark.sql(_SPAN_RESPONSES, span_rows=span_rows)


SPAN_RESPONSES_SQL = f"span_preds AS ({_SPAN_RESPONSES.format(span_rows='span_rows')})"


def word_responses(rows: DataFrame) -> DataFrame:
    """Line-per-token responses; some tags are wrong and some responses stop half-way."""
    number = F.col("src_id") + F.col("sent_id")
    lines = F.transform(
        F.arrays_zip("tokens", "tags"),
        lambda x, i: F.concat(
            x["tokens"], F.lit(": "), F.when((i + number) % 5 == 4, "O").otherwise(x["tags"])
        ),
    )

    def kept(lines):
        half = F.slice(lines, F.lit(1), F.floor(F.size(lines) / 2).cast("int"))
        more = F.concat(lines, F.array(F.lit("done: O")))
        return F.when(number % 7 == 0, half).when(number % 7 == 1, more).otherwise(lines)

    return rows.withColumn("output", F.concat(F.lit("[Labels]\n"), F.array_join(let(lines, kept), "\n")))


WORD_RESPONSES_SQL = """
word_rows AS (
  SELECT s.*, t.tokens, t.tags,
    '[Labels]' || chr(10) || array_to_string(list_concat(list_transform(
      range(1, 1 + CASE WHEN (s.src_id + s.sent_id) % 7 = 0 THEN len(t.tokens) // 2 ELSE len(t.tokens) END),
      lambda i: t.tokens[i] || ': ' || CASE WHEN (i - 1 + s.src_id + s.sent_id) % 5 = 4 THEN 'O' ELSE t.tags[i] END),
      CASE WHEN (s.src_id + s.sent_id) % 7 = 1 THEN ['done: O'] ELSE [] END), chr(10)) AS output
  FROM span_rows s JOIN tagged t ON t.corpus = s.corpus AND t.doc_id = s.doc_id AND t.sent_id = s.sent_id
    AND t.eg_id = s.example_id
), word_preds AS (
  SELECT *, list_transform(range(1, 1 + len(tokens)), lambda i:
    CASE WHEN i <= len(lines) THEN replace(lines[i], tokens[i] || ': ', '') ELSE '' END) AS pred
  FROM (SELECT *, string_split(replace(output, '[Labels]' || chr(10), ''), chr(10)) AS lines FROM word_rows)
)"""


def _clue_select(dialect: str, sents: str) -> str:
    return f"""
  SELECT source, src_id, sent AS sent_id,
    CASE (src_id + sent) % 5
      WHEN 0 THEN '<b1>' || c1 || '</b1><c1>cue</c1><r1>' || e1 || '</r1>' || c2 || e2 || rest
      WHEN 1 THEN '<b1>' || c1 || '</b1> <c1>cue</c1> <r1>' || e1 || '</r1> <b2>' || c2 || '</b2> and <r2>' || e2 || '</r2>' || rest
      WHEN 2 THEN '<b1>' || c1 || '<b2>' || e1 || '</b2></b1> <r1>' || c2 || '</r1><r2>' || e2 || '</r2>' || rest
      WHEN 3 THEN rest || '<r1>' || e1 || '</r1>' || c2 || '<b1>' || c1 || '</b1>' || e2
      ELSE '<b1>' || c1 || '</b1><r1>' || e1 || '</r1><b3>' || c2 || '</b3><r3>' || e2 || '</r3>' || rest END AS tagged_sentence
  FROM ({_spans(dialect, sents)}) AS spans
  UNION ALL SELECT source, src_id, sent AS sent_id, s AS tagged_sentence FROM {sents} WHERE {_size(dialect)} < 8"""


def clue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences marked with clue, cause and effect tags: none, one, two, nested, reversed."""
    return spark.sql(_clue_select("spark", "{sents}"), sents=sentences(spark, sf_dir))


CLUE_SENTENCES_SQL = f"{SENTENCES_SQL}, clues AS ({_clue_select('duckdb', 'sents')})" + """
, stripped AS (
  SELECT *, regexp_replace(tagged_sentence, '</?c[0-9]>', '', 'g') AS bare FROM clues
), canon AS (
  SELECT source, src_id, sent_id,
    CASE WHEN contains(bare, '<b2>') THEN regexp_replace(regexp_replace(bare, '<(/?)b([12])>', '<\\1c\\2>', 'g'), '<(/?)r([12])>', '<\\1e\\2>', 'g')
      ELSE replace(replace(replace(replace(bare, '<b1>', '<c>'), '</b1>', '</c>'), '<r1>', '<e>'), '</r1>', '</e>') END AS tagged_text
  FROM stripped
)"""

_ELEMENTS = """
  SELECT conv_id, turn, role || '_' || replace(text, ' ', '_') AS event, text AS short_context,
    cast(CASE WHEN conv_id % 4 = 0 THEN 0 ELSE conv_id % 4 + 1 END AS bigint) AS label
  FROM {conversations}"""


def chain_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain element."""
    return spark.sql(_ELEMENTS, conversations=table(spark, sf_dir, "conversations"))


CHAIN_ELEMENTS_SQL = f"elements AS ({_ELEMENTS.format(conversations='conversations')})"


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain instances with arrays: the sentences of a document as its events."""
    parts = F.filter(
        F.transform(F.split("text", "[.\n]+"), lambda s: F.trim(s)), lambda s: s != ""
    )
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").cast("string").alias("index"), "doc_id", parts.alias("parts"))
        .select(
            "index",
            F.transform("parts", lambda s: F.replace(s, F.lit(" "), F.lit("_"))).alias("events"),
            F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))).alias(
                "short_contexts"
            ),
            F.when(F.col("doc_id") % 4 == 0, F.lit(0))
            .otherwise(F.col("doc_id") % 4 + 1)
            .cast("bigint")
            .alias("label"),
        )
    )


INSTANCES_SQL = """
inst AS (
  SELECT doc_id, parts, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 4 + 1 END AS label FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda s: trim(s, ' ')),
      lambda s: s <> '') AS parts FROM documents)
), inst_pairs AS (
  SELECT 'reco_' || doc_id || '_' || i AS example_id, label, i,
    list_transform(parts[i + 1:i + 3], lambda s: replace(replace(s, ' ', '_'), '_', ' ')) AS events,
    parts[:len(parts) - 1][i + 1:i + 2] AS short_contexts,
    CASE WHEN label = i + 2 THEN 0 ELSE 1 END AS labels
  FROM (SELECT *, unnest(range(0, len(parts) - 2)) AS i FROM inst)
)"""

_RUN_LOG = """
  SELECT cast(doc_id % 3 AS bigint) AS lr, cast(1 + doc_id % 5 AS bigint) AS epoch,
    CASE WHEN cast(doc_id / 15 AS bigint) % 2 = 0 THEN 'valid' ELSE 'test' END AS split,
    sum(CASE WHEN output = concat('Classification: N', cast(labels AS string)) THEN 1 ELSE 0 END) / cast(count(*) AS double) AS accuracy,
    cast(sum(labels) AS double) / count(*) AS f1
  FROM {preds} GROUP BY 1, 2, 3"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per learning rate, epoch and split."""
    return spark.sql(_RUN_LOG.replace("doc_id / 15", "floor(doc_id / 15)"), preds=class_responses(spark, sf_dir))


RUN_LOG_SQL = (
    f"{CLASS_RESPONSES_SQL}, run_log AS ("
    + _RUN_LOG.replace("doc_id / 15", "floor(doc_id / 15)").format(preds="preds")
    + ")"
)
