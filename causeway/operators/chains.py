"""Event chains: sliding windows of three events and two contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements of a chain that one window function sorts at a time.
BLOCK = 1_000



def clean_events(events: Column) -> Column:
    return F.transform(events, lambda e: F.replace(e, F.lit("_"), F.lit(" ")))


def _pair_label(label: Column, i: Column) -> Column:
    """0 if the chain breaks at this pair, else 1."""
    return F.when(label == i + 2, 0).otherwise(1)


def chain_pairs(instances: DataFrame, prefix: str = "reco") -> DataFrame:
    """Windows of instance rows ``index, events, short_contexts, label``."""
    return chain_windows(instances.withColumn("events", clean_events(F.col("events"))), prefix)


def chain_windows(instances: DataFrame, prefix: str = "reco") -> DataFrame:
    """The same of arrays that hold anything, such as the ids of events and contexts."""
    starts = F.when(
        F.size("short_contexts") >= 2,
        F.sequence(F.lit(0), F.greatest(F.size("short_contexts") - 2, F.lit(0))),
    )
    rows = instances.withColumn("_i", F.explode(starts))
    i = F.col("_i")
    return rows.select(
        F.concat_ws("_", F.lit(prefix), F.col("index").cast("string"), i.cast("string")).alias("example_id"),
        F.slice("events", i + 1, F.lit(3)).alias("events"),
        F.slice("short_contexts", i + 1, F.lit(2)).alias("short_contexts"),
        _pair_label(F.col("label"), i).alias("labels"),
    )


def _with_dense_place(elements: DataFrame, key: str, pos: str, block: int) -> DataFrame:
    """``_pos``: the element's place in its chain, 0, 1, 2, ... whatever gaps ``pos`` has.

    Elements are counted per stretch of ``block`` positions and ranked inside
    their stretch only. An element without a position comes first.
    """
    placed = elements.withColumn("_stretch", F.coalesce(F.floor(F.col(pos) / block), F.lit(-1)))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_of"))
        .agg(F.count("*").alias("_n"))
        .select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(key, "_stretch").orderBy(pos)
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, ranked[key].eqNullSafe(starts["_key"]) & (ranked["_stretch"] == starts["_of"]))
    return joined.withColumn("_pos", F.col("_start") + F.col("_rank")).select(*elements.columns, "_pos")


def chain_pairs_from_elements(
    elements: DataFrame, key: str, pos: str, prefix: str = "reco", block: int = BLOCK
) -> DataFrame:
    """The same windows from one row per chain element.

    ``pos`` orders the elements of a chain; it may have gaps. Chains are cut into
    blocks of ``block`` elements, and the first two elements of a block go to the
    block before as well, so every window is whole inside one block. A chain of
    any length is spread over tasks, and a window function never sees more than
    a block.
    """
    dense = _with_dense_place(elements, key, pos, block)
    number = F.floor(F.col("_pos") / block)
    spills = (F.col("_pos") % block < 2) & (number > 0)
    blocks = F.when(spills, F.array(number, number - 1)).otherwise(F.array(number))
    placed = dense.select(
        key,
        "_pos",
        F.replace("event", F.lit("_"), F.lit(" ")).alias("_event"),
        "short_context",
        "label",
        F.explode(blocks).alias("_block"),
    )
    order = Window.partitionBy(key, "_block").orderBy("_pos")

    def run(column: str, length: int) -> Column:
        return F.array(F.col(column), *[F.lead(column, n).over(order) for n in range(1, length)])

    windows = placed.select(
        key,
        "_pos",
        "_block",
        "label",
        run("_event", 3).alias("events"),
        run("short_context", 2).alias("short_contexts"),
        F.lead("_pos", 2).over(order).alias("_last"),
    ).where((F.floor(F.col("_pos") / block) == F.col("_block")) & F.col("_last").isNotNull())
    return windows.select(
        F.concat_ws("_", F.lit(prefix), F.col(key).cast("string"), F.col("_pos").cast("string")).alias(
            "example_id"
        ),
        "events",
        "short_contexts",
        _pair_label(F.col("label"), F.col("_pos")).alias("labels"),
    )
