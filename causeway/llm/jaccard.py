"""N-gram Jaccard join: signature trees over families of candidate documents.

A document is its set of hashed word shingles. Two sets that are similar enough differ in
at most ``k`` shingles, ``k`` following from their sizes. So if the shingles are dealt to
``k + 1 + s`` parts by their hash, the two agree in ``s + 1`` whole parts. Empty parts tell
nothing: a set with at most ``s`` of them has keys for the others only, as one of the agreeing
parts is no empty one; the few sets with more have keys for all parts. Sizes fall into bands
such that a similar pair lies in one band or two neighbouring ones; a set has keys for its
own band and the one below. Sets that share a key belong to one family, and nothing
outside a family can be linked.

In a family, sets are the leaves of a signature tree. A node holds the bitmaps of its sets'
tokens, combined by OR, and the range of their sizes. Pairs of nodes are traversed from the
root down; a pair is pruned if the sizes rule out a link, or if the largest overlap that
the bitmaps admit is too small. Leaves that are left are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from causeway.llm.components import BLOCK, Forest, components, family_components
from causeway.llm.tables import row_key, written
from causeway.sources.scratch import shuffles_removed
from causeway.llm.text import SOLID, Alphabet, distinct_sets, grouped, lean, list_array, mix, tokens_of

WORDS = 64  # 64-bit words of a bitmap
FANOUT = 8
PAIRS = 8192  # pairs of leaves that are compared at once
BLOOM_WORDS = 1 << 20  # 8 MB
BLOOM_SHIFTS = (38, 12)


class Bands:
    """Bands of set sizes and the number of parts for each."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("the similarity is a percentage above 0")
        self.percent = percent
        self.lows, self.parts, self.spare = [1], [], []

    def reach(self, size: int) -> None:
        """Make bands up to a size."""
        p = self.percent
        while self.lows[-1] <= size or len(self.parts) < len(self.lows) - 1:
            low = self.lows[-1]
            after = low * 100 // p + 1
            top = after - 1
            differ = (top + top * 100 // p) * (100 - p) // (100 + p)
            self.lows.append(after)
            spare = 0
            while spare < differ // 2:  # as many empty parts as a set of this size has, with a margin
                empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
                if empty + 4 * math.sqrt(empty) <= spare + 0.5:
                    break
                spare += 1
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1


def _keys(sets: list[np.ndarray], prints: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Part keys of some sets, each with the set's fingerprint; within these, sets that share
    a key are joined to the first of them at once, so a key occurs once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bands.reach(int(sizes.max()))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = mix(np.concatenate(sets) + np.uint64(0x51))
    weights = mix(values + np.uint64(0x9E3779B97F4A7C15))
    own = bands.of(sizes)
    keys, nodes = [], []
    for step in (0, 1):  # the band's own keys, and those shared with the band below
        band = own - step
        used = (sizes > 0) & (band >= 0)
        parts = np.where(used, np.array(bands.parts)[np.maximum(band, 0)], 0)
        start = np.cumsum(parts) - parts
        sums = np.zeros(parts.sum(), np.uint64)
        live = used[owner]
        place = start[owner[live]] + (values[live] % parts[owner[live]].astype(np.uint64)).astype(np.int64)
        np.add.at(sums, place, weights[live])
        filled = np.bincount(place, minlength=len(sums)) > 0
        holder = np.repeat(np.arange(len(sets)), parts)
        empty = np.bincount(holder[~filled], minlength=len(sets))
        kept = filled | (empty > np.array(bands.spare)[np.maximum(band, 0)])[holder]
        nth = np.arange(len(sums)) - start[holder]
        salt = mix((band[holder].astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64))
        keys.append(mix(sums + salt)[kept])
        nodes.append(prints[holder[kept]])
    key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    pivot = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    joined = np.unique(np.stack([pivot, node])[:, pivot != node], axis=1)
    edge = mix(mix(joined[0].view(np.uint64)) + joined[1].view(np.uint64)).view(np.int64)
    return np.concatenate([key[head], edge, edge]), np.concatenate([node[head], joined[0], joined[1]])


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """A fingerprint of each whole set."""
    found = []
    for values in sets:
        one, two = mix(values + np.uint64(3)).sum(dtype=np.uint64), mix(values + np.uint64(5)).sum(dtype=np.uint64)
        found.append(mix(np.array([one], np.uint64)) + two + np.uint64(len(values)))
    return mix(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64)


class Tree:
    """A signature tree; level 0 are the sets, in an order that puts like ones together."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((least, size))
        bits = np.zeros((len(sets), WORDS * 64), bool)
        for row, i in enumerate(self.order):
            bits[row, (sets[i] % np.uint64(WORDS * 64)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        size = size[self.order]
        # how many tokens of a set may share the bits of others
        slack = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cuts),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                    np.maximum.reduceat(slack, cuts),
                )
            )

    def admits(self, level: int, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of nodes below which a link is possible."""
        maps, low, high, slack = self.levels[level]
        need = -(-percent * (low[one] + low[other]) // (100 + percent))
        fits = (100 * high[one] >= percent * low[other]) & (100 * high[other] >= percent * low[one])
        at = np.flatnonzero(fits)
        common = np.bitwise_count(maps[one[at]] & maps[other[at]]).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(slack[one[at]], slack[other[at]])
        if level == 0:  # a bit that only one set has is a token that the other lacks
            most = np.minimum(most, low[one[at]] - np.bitwise_count(maps[one[at]] & ~maps[other[at]]).sum(axis=1, dtype=np.int64))
            most = np.minimum(most, low[other[at]] - np.bitwise_count(maps[other[at]] & ~maps[one[at]]).sum(axis=1, dtype=np.int64))
        fits[at] = most >= need[at]
        return fits

    def below(self, level: int, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children on the next lower level, each once."""
        count = len(self.levels[level - 1][0])
        step = np.arange(FANOUT)
        a = (one[:, None, None] * FANOUT + step[None, :, None]) + 0 * step[None, None, :]
        b = (other[:, None, None] * FANOUT + step[None, None, :]) + 0 * step[None, :, None]
        a, b = a.ravel(), b.ravel()
        real = (a < count) & (b < count) & (a <= b)
        return a[real], b[real]


def similar_links(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join all which hang together and have different labels."""
    tree, forest, found = Tree(sets), Forest(labels), []
    zero = np.zeros(1, np.int64)
    waiting = [(len(tree.levels) - 1, zero, zero)]
    while waiting:
        level, one, other = waiting.pop()
        if len(one) > PAIRS:
            waiting.append((level, one[PAIRS:], other[PAIRS:]))
            one, other = one[:PAIRS], other[:PAIRS]
        if level > 0:
            fits = tree.admits(level, one, other, percent)
            waiting.append((level - 1, *tree.below(level, one[fits], other[fits])))
            continue
        left, right = tree.order[one], tree.order[other]
        live = (left != right) & forest.apart(left, right)
        one, other, left, right = one[live], other[live], left[live], right[live]
        if not len(one):
            continue
        fits = tree.admits(0, one, other, percent)
        left, right = left[fits], right[fits]
        while len(left):
            i, j = int(left[0]), int(right[0])
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                forest.join(i, j)
                found.append((i, j))
                live = forest.apart(left, right)
                left, right = left[live], right[live]
            else:
                left, right = left[1:], right[1:]
    return found


def bloom(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size; each node, which is a hash, sets the two bits that it names."""
    bits = [F.shiftrightunsigned("node", n).bitwiseAND(F.lit(64 * BLOOM_WORDS - 1).cast("long")) for n in BLOOM_SHIFTS]
    places = nodes.select(F.explode(F.array(*bits)).alias("bit"))
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    with shuffles_removed(nodes.sparkSession):
        words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(own).alias("bits")).toArrow()
    bitmap = np.zeros(BLOOM_WORDS, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(np.uint64)


def may_hold(bitmap: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    found = np.ones(len(nodes), bool)
    for shift in BLOOM_SHIFTS:
        bit = (nodes.view(np.uint64) >> np.uint64(shift)) & np.uint64(64 * BLOOM_WORDS - 1)
        found &= (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    return found


def with_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    alphabet: Alphabet = SOLID,
) -> DataFrame:
    """Every row's ``id_col`` with ``n_shingles`` and ``component_id``.

    Shingles are runs of ``width`` words (lower-cased A-Z, cut at ASCII white space); a text
    with fewer words is one shingle as a whole. Documents are linked when 100 times the
    common shingles are at least ``percent`` times the united ones. ``component_id`` is the
    smallest id that links lead to, its own included. Null, empty and blank texts have no
    shingles and are linked with nothing. Repeated rows and equal texts are one set and
    always hang together. Null ids stay null and count for no component. Empty tables give
    no rows. Sets are told apart by 64-bit fingerprints.
    """
    rows = classes(docs, id_col, text_col, width, percent, alphabet)
    parts = rows.where("n_shingles > 0").groupBy("part").agg(F.min("id").alias("least"))
    return rows.join(parts, "part", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def repeated_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    alphabet: Alphabet = SOLID,
) -> DataFrame:
    """``row``: the `row_key` of every document that goes when one of each component stays.

    The smallest id stays, of equal ids the smallest key; a null id only where there is no
    other. Rows that repeat an id and its text are one document and stay or go together. A
    text without shingles stays. Other cases as in `with_components`.
    """
    rows = classes(docs, id_col, text_col, width, percent, alphabet).where("n_shingles > 0")
    rows = rows.select("part", F.struct(F.col("id").isNull(), "id", "row").alias("place"))
    firsts = rows.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    return rows.join(firsts, "part").where("place <> first").select("place.row").distinct()


def _by_band(families: DataFrame, documents: DataFrame, percent: int, large: int = 2 * BLOCK) -> DataFrame:
    """``node, family``, large families being split by size.

    A link holds between sets of one band or two neighbouring ones, so a member of a large
    family goes to the family of its own band and to that of the band below.
    """
    families = families.withColumnRenamed("root", "family")
    sizes = families.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > large)
    bands = Bands(percent)
    bands.reach(documents.agg(F.max("n_shingles")).first()[0] or 1)
    band = F.size(F.filter(F.array(*[F.lit(low) for low in bands.lows]), lambda low: low <= F.col("n_shingles")))
    counted = documents.select("node", "n_shingles").distinct()
    split = families.join(sizes, "family").join(counted, "node")
    split = split.select("node", F.explode(F.array(band, band - 1)).alias("band"), "family")
    split = split.select("node", F.xxhash64("family", "band").alias("family"))
    return written(families.join(sizes, "family", "left_anti").select("node", "family").unionByName(split))


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, alphabet: Alphabet) -> DataFrame:
    """``id, row, n_shingles, part`` of every row; ``part`` names its component."""
    texts = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row")
    )

    def sets_of(batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        whole = batch.column(place).to_pylist()
        for first, last in grouped(whole):
            yield first, last, distinct_sets(tokens_of(whole[first:last], alphabet), width)

    @lean
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in sets_of(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_prints(sets)),
                    ],
                    names=["id", "row", "n_shingles", "node"],
                )

    @lean
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for _, _, sets in sets_of(batch, 0):
                key, node = _keys(sets, _prints(sets), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    id_field = StructField("id", docs.schema[id_col].dataType)
    schema = StructType([id_field, *[StructField(n, LongType()) for n in ("row", "n_shingles", "node")]])
    documents = written(texts.mapInArrow(sizes, schema))

    # a key occurs once in a group of texts, so not even a key that all share is a hot one
    shared = texts.select("text").mapInArrow(keys, "key long, node long")
    shared = shared.withColumn("low", F.min("node").over(Window.partitionBy("key"))).where("node <> low")
    families = written(components(written(shared.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())))
    bitmap = bloom(families.select("node"))

    @lean
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in sets_of(batch, 0):
                node = _prints(sets)
                _, once = np.unique(node, return_index=True)
                chosen = [i for i in once[may_hold(bitmap, node[once])] if len(sets[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[chosen]), list_array([sets[i].view(np.int64) for i in chosen], pa.int64())], names=["node", "tokens"]
                )

    candidates = texts.select("text").mapInArrow(members, "node long, tokens array<long>").dropDuplicates(["node"])

    def linker(payload: dict, labels: np.ndarray) -> list[tuple[int, int]]:
        tokens = payload["tokens"]
        flat, cuts = tokens.flatten().to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        cuts = cuts - cuts[0]
        return similar_links([np.sort(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], labels, percent)

    linked = family_components(_by_band(families, documents, percent), candidates, linker)
    return documents.join(linked, "node", "left").withColumn("part", F.coalesce("root", "node"))
