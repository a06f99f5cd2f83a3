"""File readers. Every reader names its columns and types; nothing is inferred."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prompts import REQUIRED_KEYS, check_template
from .ranges import json_elements, read_quoted_csv

# Columns of the annotated-pair files that are read, by name.
PAIR_COLUMNS = {
    "corpus": "string",
    "doc_id": "string",
    "sent_id": "bigint",
    "eg_id": "bigint",
    "text": "string",
    "text_w_pairs": "string",
    "seq_label": "bigint",
    "pair_label": "bigint",
    "num_sents": "bigint",
}
INSTANCE_SCHEMA = (
    "instances array<struct<index: string, events: array<string>, "
    "short_contexts: array<string>, label: bigint>>"
)


def whole_number(text: Column) -> Column:
    """A whole number, also one written as ``1.0``; NULL for anything else.

    Plain digits, as most numbers are, need no decimals.
    """
    number = text.try_cast("decimal(38,10)")
    plain = F.when(text.rlike(r"\A[0-9]{1,18}\z"), text.cast("bigint"))
    return plain.when(number == F.floor(number), number.try_cast("bigint"))


def _pair_cells(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, Column]:
    """The columns that are read, as text, and whether all numbers of a row are numbers."""
    if multi_line:
        raw = read_quoted_csv(spark, path)
    else:
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    fits = F.lit(True)
    for name, kind in PAIR_COLUMNS.items():
        if kind == "bigint":
            fits &= F.col(name).isNull() | whole_number(F.col(name)).isNotNull()
    return raw.select(*PAIR_COLUMNS), fits


def read_pairs_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Annotated pairs: quoted CSV with a header; other columns are ignored.

    ``multi_line`` allows line breaks in quoted text: files are still read by byte ranges in
    many tasks, but scanned three times; turn it off for files without them. Rows with a
    number that is none are left to `pairs_quarantine`.
    """
    cells, fits = _pair_cells(spark, path, multi_line)
    typed = [
        (whole_number(F.col(name)) if kind == "bigint" else F.col(name)).alias(name)
        for name, kind in PAIR_COLUMNS.items()
    ]
    return cells.where(fits).select(*typed)


def pairs_quarantine(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of a pair file that `read_pairs_csv` leaves out: ``reason`` and the row as JSON."""
    cells, fits = _pair_cells(spark, path, multi_line)
    return cells.where(~fits).select(F.lit("number").alias("reason"), F.to_json(F.struct("*")).alias("record"))


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a file scan 0, 1, ... in order of file path and position.

    Rows are counted per file block; running totals over the blocks give each its
    first number, and a row's place less the first place of its block is its
    place in there. Only the table of blocks, one row each, is shuffled and sent.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )
    before = Window.orderBy("_file", "_block")
    blocks = (
        placed.groupBy("_file", "_block")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select("_file", "_block", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"))
    )
    return placed.join(F.broadcast(blocks), ["_file", "_block"]).select(
        *df.columns, (F.col("_place") + F.col("_shift")).alias(name)
    )


_CORRUPT = "_corrupt"


def _delimited(spark: SparkSession, path: str, columns: list[str], sep: str, header: bool) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in (*columns, _CORRUPT))
    return (
        spark.read.schema(schema)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("header", header)
        .option("sep", sep)
        .option("quote", "")
        .csv(path)
    )


def read_delimited(
    spark: SparkSession,
    paths: dict[str, str],
    columns: list[str],
    sep: str = "; ",
    header: bool = True,
) -> DataFrame:
    """Files with a delimiter of several characters, unioned.

    ``paths`` maps an id prefix to a file; the first column becomes
    ``<prefix>_<id>`` and ``row_id`` keeps the order of files and rows. Quotes
    have no meaning in this layout. Lines with more or fewer fields are left to
    `delimited_quarantine`.
    """
    frames = []
    for number, (prefix, path) in enumerate(paths.items()):
        rows = with_ordinal(_delimited(spark, path, columns, sep, header), "row_id")
        frames.append(
            rows.where(F.col(_CORRUPT).isNull())
            .drop(_CORRUPT)
            .withColumns(
                {
                    columns[0]: F.concat_ws("_", F.lit(prefix), F.col(columns[0])),
                    "row_id": F.col("row_id") + F.lit(number * 10**15),
                }
            )
        )
    return reduce(DataFrame.unionByName, frames)


def delimited_quarantine(
    spark: SparkSession, paths: dict[str, str], columns: list[str], sep: str = "; ", header: bool = True
) -> DataFrame:
    """Lines that `read_delimited` leaves out: ``reason`` and the line."""
    frames = [
        _delimited(spark, path, columns, sep, header)
        .where(F.col(_CORRUPT).isNotNull())
        .select(F.lit("fields").alias("reason"), F.col(_CORRUPT).alias("record"), columns[0])
        for path in paths.values()
    ]
    return reduce(DataFrame.unionByName, frames).select("reason", "record")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated file whose header is dropped; names and types go by position."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", "\t")
        .option("escape", '"')
        .csv(path)
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, prefix: str) -> DataFrame:
    """JSON lines with ids ``<prefix>_<line number>``."""
    rows = with_ordinal(spark.read.schema(schema).json(path))
    return rows.withColumn(
        "example_id", F.concat_ws("_", F.lit(prefix), F.col("ordinal").cast("string"))
    ).drop("ordinal")


def read_instances(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chain instances from JSON documents that hold them in one array each.

    A document may span lines and be as large as a file: it is read by byte ranges in many
    tasks. With ``multi_line`` off a document is a line, which needs one scan only.
    """
    if multi_line:
        element = INSTANCE_SCHEMA.removeprefix("instances array<").removesuffix(">")
        rows = json_elements(spark, path, "instances")
        return rows.select(F.from_json("value", element).alias("instance")).select("instance.*")
    return spark.read.schema(INSTANCE_SCHEMA).json(path).select(F.inline("instances"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates, one per JSON file, with the names of missing keys."""
    schema = ", ".join(f"{k} string" for k in (*REQUIRED_KEYS, "format_tag"))
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    missing = F.filter(
        F.array(*[F.when(F.col(k).isNull(), k) for k in REQUIRED_KEYS]), lambda k: k.isNotNull()
    )
    return rows.select(
        F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("name"),
        "*",
        missing.alias("missing_keys"),
    )


def load_template(spark: SparkSession, path: str) -> dict[str, str]:
    """One template as a dict; raises if a required key is missing."""
    row = read_templates(spark, path).drop("name", "missing_keys").first()
    if row is None:
        raise ValueError(f"no template at {path}")
    return check_template({k: v for k, v in row.asDict().items() if v is not None})


def write_template(spark: SparkSession, template: dict[str, str], path: str) -> None:
    """Save a template as a JSON file at a path of any file system that the session knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(json.dumps(template, indent=4).encode())
    out.close()
