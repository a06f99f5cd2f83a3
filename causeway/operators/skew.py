"""Group sizes on every row, without sending a hot group to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this many rows and this share of all rows.
# The share bounds the number of hot keys by its inverse, so they can be broadcast.
HOT_ROWS = 100_000
HOT_SHARE = 1e-4


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def with_group_size(
    df: DataFrame,
    keys: list[str],
    name: str,
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Add the number of rows that share the keys; NULL keys equal each other.

    Sizes come from a pre-aggregated count. Rows of hot keys take theirs from a
    broadcast table and are never shuffled; all other rows are joined with the
    sizes of their keys.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_size"))
    rows = sizes.agg(F.sum("_size").alias("n")).scalar()
    is_hot = F.col("_size") > F.greatest(F.lit(hot_rows).cast("double"), rows * F.lit(hot_share))
    same = _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    hot = F.broadcast(sizes.where(is_hot))
    columns = [*df.columns, F.col("_size").alias(name)]
    rest = df.join(hot, same, "left_anti").join(sizes.where(~is_hot), same)
    return rest.select(*columns).unionByName(df.join(hot, same).select(*columns))
