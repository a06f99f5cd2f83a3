"""Connected components, and links within families of candidates, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from causeway.llm.tables import written
from causeway.llm.text import lean

BLOCK = 1024  # nodes of a block of a family, about
FEW = 100_000  # large families, of 16 bytes each, that are broadcast


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the smallest node.

    Large-star and small-star steps in turn: each hangs a node's neighbours on the smallest
    of them, so the number of rounds grows with the logarithm of the longest path. A round
    is written to the shared folder. Null ends and loops are left out.
    """
    a, b = F.col("a"), F.col("b")
    now, mark = _round(edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        pairs = F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
        small = large.join(lows, "u").select(F.inline(pairs)).where("u <> v")
        before = mark
        now, mark = _round(small)
        if before == mark:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Distinct edges, written, with their number and the sum of their hashes."""
    seen = Observation()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    kept = written(edges.distinct().observe(seen, F.count("*").alias("edges"), mark.alias("mark")))
    return kept, seen.get


class Forest:
    """Which of some numbered members hang together."""

    def __init__(self, labels: np.ndarray):
        self.roots = np.unique(labels, return_inverse=True)[1]

    def apart(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return self.roots[one] != self.roots[other]

    def join(self, one: int, other: int) -> bool:
        a, b = self.roots[one], self.roots[other]
        if a == b:
            return False
        self.roots[self.roots == b] = a
        return True


Linker = Callable[..., list[tuple[int, int]]]


def _links(units: DataFrame, linker: Linker, together: int = 0) -> DataFrame:
    """Links of each unit: nodes ``a, b``. A task holds one unit at a time, or units of ``together`` rows."""
    names = units.columns

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key, rows = None, 0

        def close() -> pa.RecordBatch:
            table = pa.concat_tables(held)
            nodes = table["node"].to_numpy()
            if together:
                own = table["unit"].to_numpy()
                once = np.lexsort((nodes, own))
                same = (own[once][1:] == own[once][:-1]) & (nodes[once][1:] == nodes[once][:-1])
                once = once[np.append(True, ~same)]
            else:
                _, once = np.unique(nodes, return_index=True)
            table, nodes = table.take(once), nodes[once]
            payload = {n: table[n].combine_chunks() for n in names if n not in ("unit", "label")}
            more = (table["unit"].to_numpy(),) if together else ()
            pairs = linker(payload, table["label"].to_numpy(), *more) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([int(nodes[i]) for i, _ in pairs], pa.int64()), pa.array([int(nodes[j]) for _, j in pairs], pa.int64())],
                names=["a", "b"],
            )

        for batch in batches:
            unit = batch.column(names.index("unit")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)] if len(unit) else []
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if rows and unit[first] != key and rows >= together:
                    yield close()
                    held, rows = [], 0
                key = unit[first]
                held.append(pa.Table.from_batches([batch.slice(first, last - first)]))
                rows += last - first
        if held:
            yield close()

    # Small units may take long, so adaptive execution is not to merge tasks by their bytes.
    tasks = [int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if together else []
    return units.repartition(*tasks, "unit").sortWithinPartitions("unit").mapInArrow(work, "a long, b long")


def family_components(families: DataFrame, payload: DataFrame, linker: Linker, block: int = BLOCK, together: int = 0) -> DataFrame:
    """Components (``node, root``) of the links that ``linker`` finds within families.

    ``families`` has ``node, family``, a node once in each of its families; ``payload`` has
    ``node``, once each, and what the linker reads. Nodes that share no family are never
    linked. The linker
    gets the columns of some members and their labels, and returns linked pairs of members
    with different labels, at least so many that they join all that hang together. With
    ``together`` it gets small units at once, up to so many rows, and the unit of each member.

    A family of up to two blocks is one unit of work. A larger one is cut into blocks, and
    first each block meets the first one. Members that then are in the family's largest
    component need no comparison with one another. The others, in blocks, meet everyone.
    """
    columns = [c for c in payload.columns if c != "node"]
    sizes = families.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > 2 * block)
    sizes = written(sizes.select("family", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    # One row for each large family; as long as these are few, nodes need not be shuffled for them.
    large_families = sizes.count()
    hint = F.broadcast if large_families <= FEW else lambda df: df
    rows = families.join(hint(sizes), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mates = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = rows.withColumn("with", F.explode(mates)).select(
        F.xxhash64("family", "with").alias("unit"), F.col("node").alias("label"), "node"
    )
    first = written(_links(units.join(payload, "node").select("unit", "label", "node", *columns), linker, together))
    found = components(first)
    if not large_families:
        return found

    large = rows.where("blocks > 1").join(found, "node", "left").withColumn("label", F.coalesce("root", "node"))
    parts = large.groupBy("family", "label").agg(F.count("*").alias("n"))
    mains = parts.groupBy("family").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n")
    )
    mains = mains.where("n > inside").select(
        "family",
        "main",
        F.ceil((F.col("n") - F.col("inside")) / block).cast("int").alias("outer"),
        F.ceil(F.col("inside") / block).cast("int").alias("inner"),
    )
    rest = large.select("family", "node", "label").join(hint(mains), "family")
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    inner = F.sequence(F.lit(0), F.col("inner") - 1)
    with_outer = F.transform(outer, lambda o: F.struct(F.lit(0).alias("kind"), F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    with_inner = F.transform(inner, lambda i: F.struct(F.lit(1).alias("kind"), own.alias("x"), i.alias("y")))
    to_outer = F.transform(outer, lambda o: F.struct(F.lit(1).alias("kind"), o.alias("x"), own.alias("y")))
    meets = F.when(is_main, to_outer).otherwise(F.concat(with_outer, with_inner))
    units = rest.withColumn("with", F.explode(meets)).select(
        F.xxhash64("family", "with.kind", "with.x", "with.y").alias("unit"), "label", "node"
    )
    second = written(_links(units.join(payload, "node").select("unit", "label", "node", *columns), linker, together))
    if second.isEmpty():
        return found
    return components(first.unionByName(second))
