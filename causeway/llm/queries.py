"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import (
    audit,
    counts,
    decontaminate,
    encode,
    jaccard,
    langid,
    licenses,
    lines,
    mixing,
    nearest,
    quality,
    runs,
    urls,
)
from causeway.llm.pieces import Vocabulary
from causeway.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# The rules that the URL query applies, as (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

OP6_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0), '') AS path
  FROM cut
), bare AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM bare WHERE regexp_matches(url, '[?&]utm_source=feed(&|#|$)')
), ruled AS (
  SELECT b.host, b.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
    max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM bare) b JOIN rules r
    ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path)
  GROUP BY b.host, b.path
)
SELECT b.page_id, b.host, b.path, u.rule,
  coalesce(u.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM bare b LEFT JOIN ruled u ON u.host = b.host AND u.path = b.path
LEFT JOIN listed l ON l.canonical = b.canonical
"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; else URLs that have been seen with a feed's tracking mark are blocked."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS rules(verdict, host, path)")
    seen = pages.where(F.col("url").rlike("[?&]utm_source=feed(&|#|$)"))
    listed = seen.select(
        urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("canonical")
    )
    return urls.judge_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


# Where the public vocabulary file stands; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """Ids of every whole text, their number, and whether decoding gives the text back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode.encode_texts(documents, Vocabulary.read(path)).drop("text")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """Number of tokens of every whole text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.count_tokens(documents, Vocabulary.read(path)).drop("text")


OP5_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words
), hits AS (
  SELECT p.doc_id, p.i, s.size, x.item_id
  FROM places p CROSS JOIN (SELECT DISTINCT size FROM windows) s
  JOIN windows x ON x.size = s.size AND x.phrase = array_to_string(p.w[p.i:p.i + s.size - 1], ' ')
  WHERE p.i + s.size - 1 <= len(p.w)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS id FROM hits) GROUP BY 1
)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""


@query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole document: hit words and the items they belong to."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(
        F.arrays_zip("hit_starts", "hit_ends"),
        F.lit(0).cast("long"),
        lambda total, r: total + r["hit_ends"] - r["hit_starts"],
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(documents).drop("text")


@query("op3_importance_resampling")
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight, draw and decision of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(documents, table(spark, sf_dir, "labels"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document by a network that has not seen the held-out ones."""
    documents = table(spark, sf_dir, "documents")
    network = langid.train(*langid.training_windows(documents.select("doc_id", "text", "lang")))
    predicted = langid.predict_languages(documents.select("doc_id", "text"), network)
    return predicted.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(rows.where(F.col("vec_id") % 20 == 0), rows)


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 90 * (a.n + b.n - c.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM split
  UNION SELECT r.doc_id, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON l.x = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM split d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY ALL
"""


@query("op10_jaccard_components", OP10_SQL)
def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity 0.9."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.with_components(documents, width=3, percent=90)


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines and of repeated lines of every document, and which lines go."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = lines.repeated_lines(documents).withColumnRenamed("id", "other_id")
    rows = documents.select(
        "doc_id",
        lines.row_key(F.col("doc_id"), F.col("text")).alias("row"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
    )
    joined = rows.join(gone, (rows["row"] == gone["row"]) & rows["doc_id"].eqNullSafe(gone["other_id"]), "left")
    return joined.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("lines", F.array().cast("array<int>")).alias("removed"),
    )


OP11_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM base GROUP BY t
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT b.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(b.t, '[^A-Z]+', '', 'g')) > 2 * length(b.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(b.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN f.first_id < b.doc_id THEN 'E' ELSE '' END AS fails
  FROM base b JOIN firsts f ON f.t = b.t LEFT JOIN known k ON k.doc_id = b.doc_id
), letters(l) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, i AS step, substr(filter_order, i, 1) AS own, substr(filter_order, 1, i - 1) AS before
  FROM orders, (VALUES (1), (2), (3), (4), (5)) AS x(i)
), sets AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flags GROUP BY part, fails
), marked AS (
  SELECT s.part, t.filter_order, t.step, t.own, s.fails, s.n, s.good, s.toxic, contains(s.fails, t.own) AS hit,
    t.before <> '' AND s.fails <> '' AND regexp_matches(s.fails, '[' || t.before || '0]') AS gone
  FROM sets s, steps t
), report AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (NOT hit AND NOT gone) AS kept,
    sum(n) FILTER (hit AND NOT gone) AS removed,
    sum(n) FILTER (hit AND gone) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails,
    sum(good) FILTER (hit AND NOT gone) AS good_lost,
    sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM marked GROUP BY ALL
)
SELECT part, filter_order, cast(step AS integer) AS step, cast(coalesce(kept, 0) AS bigint) AS kept,
  cast(coalesce(removed, 0) AS bigint) AS removed, cast(coalesce(redundant, 0) AS bigint) AS redundant,
  cast(coalesce(unique_fails, 0) AS bigint) AS unique_fails, cast(coalesce(good_lost, 0) AS bigint) AS good_lost,
  cast(coalesce(toxic_lost, 0) AS bigint) AS toxic_lost,
  cast(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS bigint) AS shapley
FROM report
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do at every step of every order, for every source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit.audit(documents, table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(cast(doc_id AS varchar), ''),
        lambda c: list_concat([ascii(c)::UBIGINT], list_resize([]::UBIGINT[], 8, 256::UBIGINT))))),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END
    ))::BIGINT AS h
  FROM documents
), placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), tailed AS (
  SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM placed
), texts AS (
  SELECT row, doc_id, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
  FROM tailed
), words AS (
  SELECT row, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts
), pairs AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.row = x.row AND y.word = x.word
    AND y.i > x.i AND y.i - x.i <= x.n // 4
), stretches AS (
  SELECT row, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS block FROM pairs) GROUP BY row, q, block
), runs AS (
  SELECT row, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY row, s, l
), dropped AS (
  SELECT DISTINCT row, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT w.row, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM words w ANTI JOIN dropped d ON d.row = w.row AND d.i = w.i GROUP BY w.row
), found AS (
  SELECT row, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY row
), best AS (
  SELECT r.row, r.s, r.l, r.q, row_number() OVER (
    PARTITION BY r.row ORDER BY r.l // r.q DESC, cast(r.l % r.q AS double) / r.q DESC, r.s, r.q) AS place
  FROM runs r
)
SELECT t.doc_id, coalesce(f.n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period,
  cast(1000 * b.l // b.q AS bigint) AS exponent_milli,
  sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM texts t LEFT JOIN found f ON f.row = t.row LEFT JOIN best b ON b.row = t.row AND b.place = 1 LEFT JOIN kept k ON k.row = t.row
"""


@query("op12_periodic_runs", OP12_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods in every whole document, and the text without their repeats."""
    texts = runs.made_periodic(table(spark, sf_dir, "documents"))
    found = runs.periodic_runs(texts).withColumn("best", runs.best_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_source_mixing")
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, so that sources share 150 % of all words by weights 5, 2, 1."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
