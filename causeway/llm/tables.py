"""Given tables, and intermediate ones that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.scratch import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there.

    This cuts lineage and survives the loss of executors.
    """
    return staged(df)


def row_key(doc_id: Column, text: Column) -> Column:
    """A number for a document; rows that repeat an id and its text share it."""
    return F.xxhash64(doc_id, text)
