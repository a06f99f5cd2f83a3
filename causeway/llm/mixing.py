"""Copies of documents so that sources reach target weights, by dependent rounding.

A source's documents all have the same expected number of copies, target / size. Its whole
part is taken at once; the fraction is rounded by pivotal sampling: two documents with open
fractions pass words between them, in a random direction that keeps both expectations, until
one has a whole number of copies. Words neither appear nor vanish, so a source's words stay
at their target until one open document is left, and only that one is rounded by itself.

This runs as a reduction tree. Cells of a few thousand documents, told apart by hash, are
rounded in parallel and each leaves one open document at most; these meet in cells of the
next level, until one cell per source is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.tables import written
from causeway.operators.ranking import with_position

WORD = r"[^\x20\x09-\x0D]+"
CELL = 4096  # documents of a cell, about, and cells that meet in one of the next level
BUNDLE = 1000  # rows of equal id, source and size that are rounded as one
FEW = 100_000  # sources that are broadcast, at most
CLOSE = 1e-9  # from a whole number of copies


def sizes_of(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of each whole text, none for null."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    return documents.select("doc_id", "source", n.cast("bigint").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``source, source_size, n, target``: targets share ``share`` of all words by weight.

    Sources in order, null last, take ``weights`` in turn. No target is above ``most`` times
    its source's size: the level rises until what the capped ones leave is dealt out. Each
    round of that is one aggregation over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = with_position(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(placed.withColumn("weight", weight)).withColumn("cap", most * F.col("source_size"))
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        row = sources.agg(
            F.count_if(above).alias("capped"),
            F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (goal - row["full"]) / row["open"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return sources.select("source", "source_size", "n", target.alias("target"))


def round_pairs(size: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Fractions ``x`` rounded so that ``size @ x`` stays; one at most is left open.

    Words pass from one open document to the next, or back, until one of the two is whole;
    chances are such that neither's expectation changes.
    """
    x = x.copy()
    held = -1
    for i in range(len(x)):
        if not CLOSE < x[i] < 1 - CLOSE:
            x[i] = round(x[i])
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - x[held]) * size[held], x[i] * size[i])
        down = min(x[held] * size[held], (1 - x[i]) * size[i])
        words = up if draws[i] * (up + down) < down else -down
        x[held] += words / size[held]
        x[i] -= words / size[i]
        left = [k for k in (held, i) if CLOSE < x[k] < 1 - CLOSE]
        for k in {held, i}.difference(left):
            x[k] = round(x[k])
        held = left[0] if left else -1
    return x


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """Round each cell; at the last level its open document is drawn by its own fraction."""

    def work(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "order", "doc_id", "bundle"], ascending=[False, True, True, True])
        rng = np.random.default_rng(int(cell["seed"].iloc[0]) & (2**63 - 1))
        x = round_pairs(cell["size"].to_numpy(float), cell["x"].to_numpy(float), rng.random(len(cell)))
        if last:
            x = (rng.random(len(x)) < x).astype(float)
        return cell.assign(x=x)

    return rows.groupBy("source", "cell").applyInPandas(work, rows.schema)


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 13,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``documents``.

    ``taken`` is the size times a whole number of copies, at most ``most``. A source's words
    miss its target by less than the size of one document. The draw depends on ids, sizes,
    sources and ``seed`` only, not on partitions; rows that repeat all three are
    interchangeable. A null text and an empty one have size 0 and take nothing; a null source
    is a source of its own, after all others; a null id is an id like any other.
    """
    sizes = written(sizes_of(documents))
    sources = written(source_targets(sizes, weights, share, most))
    bounds = sources.agg(F.count("*").alias("sources"), F.max("n").alias("most")).first()
    hint = F.broadcast if bounds["sources"] <= FEW else lambda df: df
    parts = hint(sources.withColumnRenamed("source", "own"))

    equal = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    bundles = equal.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / BUNDLE) - 1)))
    rows = F.least(F.lit(BUNDLE), F.col("rows") - BUNDLE * F.col("bundle"))
    joined = bundles.withColumn("rows", rows).join(parts, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    # Rows of a bundle are alike: of all their copies only one fraction is open.
    copies = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    joined = joined.withColumn("copies", copies)
    extra = F.col("rows") * (F.col("copies") - F.floor("copies"))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "bundle")
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL))
    state = joined.select(
        "doc_id",
        "source",
        "size",
        "bundle",
        "rows",
        "source_size",
        "target",
        F.floor("copies").alias("whole"),
        F.floor(extra).alias("more"),
        (extra - F.floor(extra)).alias("x"),
        order.alias("order"),
        F.pmod(order, cells).cast("bigint").alias("cell"),
        F.lit(0).cast("bigint").alias("seed"),
    )
    is_open = (F.col("x") > 0) & (F.col("x") < 1)
    state = written(state)
    done, rest = [state.where(~is_open)], state.where(is_open)
    level, width = 0, -(-(bounds["most"] or 0) // CELL)
    while True:
        last = width <= 1
        seeded = rest.withColumn("seed", F.xxhash64(F.lit(seed), F.lit(level), "source", "cell"))
        state = written(_level(seeded, last))
        done.append(state.where(~is_open))
        if last:
            break
        rest = state.where(is_open).withColumn("cell", F.floor(F.col("cell") / CELL))
        level, width = level + 1, -(-width // CELL)

    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return _expanded(settled)


def _expanded(settled: DataFrame) -> DataFrame:
    """One row for each row of a bundle; so many of them take one copy more."""
    more = F.col("more") + F.round("x")
    row: Column = F.explode(F.sequence(F.lit(1), F.col("rows")))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("row") <= more, 1).otherwise(0))
    return settled.withColumn("row", row).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )
