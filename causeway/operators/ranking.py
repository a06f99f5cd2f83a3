"""Places of rows in a global order, found without one task that sees all of them.

A distributed sort leaves ordered partitions; their sizes give each partition the place at
which it begins, and a row's place within its partition does the rest. Rows with equal keys
are told apart by a number of their own, so one key that fills the table is spread as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

# monotonically_increasing_id() keeps the partition above this bit and the row below it.
ROW_BITS = 33


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows by partition and place within it, from 1; the rows are written once."""
    kept = staged(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    # As many rows as there are partitions, whatever the size of the table.
    sizes = sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for size in sizes:
        begins.append((size["part"], total))
        total += size["n"]
    begins = kept.sparkSession.createDataFrame(begins, "_part bigint, _begin bigint")
    place = F.col("_begin") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + 1
    joined = kept.join(F.broadcast(begins), part == F.col("_part"))
    return joined.select(*rows.columns, place.alias(name))


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """A distributed sort whose ranges cut through equal keys, too."""
    return df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie")


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Place of every row in ``order``, from 1 to the number of rows.

    Null keys stand where the order puts them. Rows with equal keys get different places, in
    the order in which the input happens to hold them. The column ``name`` must be new.
    """
    return _placed(_ordered(df, order), name).select(*df.columns, name)


def with_input_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Place of every row in the order of the input's partitions, from 1; nothing is sorted."""
    return _placed(df, name)


def dense_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Distinct values of ``key`` with their rank in sorted order, from 1; null is the first."""
    return with_position(df.select(key).distinct(), [key], name)
