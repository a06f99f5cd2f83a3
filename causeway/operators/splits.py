"""Exact-size, reproducible samples and splits.

Rows are ordered by the md5 of seed and key, so membership depends on nothing
but those. Borders in that order are found without sorting the data: rows are
counted per hash bucket, and running totals over the buckets (a bounded table)
tell which buckets hold a border. Only hashes in those are sorted, to find the
hash at each border; after that a row's part is a comparison of its hash with a constant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import passing, staged
from .ranking import with_input_position, with_position

# Hex digits of the hash that name a bucket: 16**4 = 65,536 buckets at most,
# which bounds the broadcast table and keeps a bucket to 1/65,536 of the rows.
BUCKET_DIGITS = 4

# The largest top-k that one task sorts; pivots of a round, and keys that are sorted at the end.
TOP, PIVOTS, BETWEEN = 10_000, 32, 10_000

# Name and last rank of a part; None stands for all the rest.
Part = tuple[str, Column | None]


def seeded_hash(seed: int, keys: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _hashed(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    return df.withColumn("_hash", seeded_hash(seed, keys))


def _bucketed(hashed: DataFrame) -> DataFrame:
    return hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def global_rank(df: DataFrame, seed: int, keys: list[str], name: str = "rank") -> DataFrame:
    """Rank of every row in the seeded order, 1 to n, by a distributed sort.

    Rows with equal keys are spread over tasks like any others; which of them comes first is
    not determined.
    """
    return with_position(_hashed(df, seed, keys), ["_hash", *keys], name).select(*df.columns, name)


def shuffle(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Seeded order as a distributed sort."""
    return df.orderBy(seeded_hash(seed, keys), *keys)


def _places(hashes: DataFrame, sizes: list, borders: list[int]) -> dict[int, tuple[str, int, int]]:
    """For each border its hash, with the first and last rank of that hash.

    ``sizes`` are buckets and their numbers of rows, in order. Only hashes of buckets that
    hold a border are counted and summed up, one bucket in a task.
    """
    near, total = [], 0
    for bucket, n in sizes:
        if any(total < b <= total + n for b in borders):
            near.append((bucket, total))
        total += n
    if not near:
        return {}
    starts = F.broadcast(hashes.sparkSession.createDataFrame(near, "_bucket string, _before bigint"))
    upto = Window.partitionBy("_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        _bucketed(hashes)
        .join(starts, "_bucket")
        .groupBy("_bucket", "_before", "_hash")
        .agg(F.count("*").alias("_n"))
        .withColumn("_last", F.col("_before") + F.sum("_n").over(upto))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )
    holds = reduce(lambda a, b: a | b, [F.lit(b).between(F.col("_first"), F.col("_last")) for b in borders])
    found = ranked.where(holds).select("_hash", "_first", "_last").collect()
    return {b: tuple(row) for b in borders for row in found if row["_first"] <= b <= row["_last"]}


def cut(
    df: DataFrame,
    seed: int,
    keys: list[str],
    parts: Callable[[Column], list[Part]],
    name: str = "split",
) -> DataFrame:
    """Cut the seeded order into named parts of exact size.

    ``parts`` gets the number of rows and returns (name, last rank) pairs in
    order; rows past the last border are dropped. Keys should identify a row. The keys are
    read once to write their hashes, and borders are found in these; then a row's part is a
    comparison of its hash with constants, so rows are neither joined nor shuffled. Only if
    a border falls among rows of equal keys are those rows numbered, by a distributed sort.
    """
    hashed = _hashed(df, seed, keys)
    with passing():  # nothing reads the hashes once borders are found
        hashes = staged(hashed.select("_hash"))
        # At most 65,536 rows, and as many borders as there are parts.
        sizes = sorted(map(tuple, _bucketed(hashes).groupBy("_bucket").agg(F.count("*")).collect()))
        total = sum(n for _, n in sizes)
        named = parts(F.lit(total))
        lasts = [last.cast("bigint") for _, last in named if last is not None]
        borders = [max(0, min(b, total)) for b in df.sparkSession.range(1).select(*lasts).first()]
        places = _places(hashes, sizes, sorted({b for b in borders if 0 < b < total}))

    def part_at(place: Column, ends: list) -> Column:
        found = F.when(place <= F.lit(ends[0]), named[0][0])
        for (label, _), end in zip(named[1:], ends[1:]):
            found = found.when(place <= F.lit(end), label)
        return found if len(ends) == len(named) else found.otherwise(named[-1][0])

    # Hash digits end at f, so "g" lies behind every hash and "" before.
    limits = ["" if b == 0 else "g" if b == total else places[b][0] for b in borders]
    torn = sorted({places[b] for b in places if b < places[b][2]})
    columns = [*df.columns, name]
    if torn:
        out = hashed.where(~F.col("_hash").isin([h for h, _, _ in torn]))
    else:
        out = hashed
    out = out.withColumn(name, part_at(F.col("_hash"), limits)).select(*columns)
    if torn:
        rows = with_position(hashed.where(F.col("_hash").isin([h for h, _, _ in torn])), ["_hash"], "_place")
        before, shift = 0, F.lit(0)
        for hash_, first, last in torn:
            shift = F.when(F.col("_hash") == hash_, first - 1 - before).otherwise(shift)
            before += last - first + 1
        rows = rows.withColumn(name, part_at(F.col("_place") + shift, borders))
        out = out.unionByName(rows.select(*columns))
    return out if len(borders) < len(named) else out.where(F.col(name).isNotNull())


def split_80_10_10(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Train, valid and test: a fifth, rounded up, is held out; its larger half is the test set."""

    def parts(n: Column) -> list[Part]:
        held = F.ceil(n / 5)
        test = F.ceil(held / 2)
        return [("train", n - held), ("valid", n - test), ("test", None)]

    return cut(df, seed, keys, parts)


def split_train_valid(train_valid: DataFrame, test: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Train and valid parts, sized by the test set.

    As many valid rows as test rows if four test sets would fit into the data,
    otherwise a fifth, rounded down.
    """
    n_test = test.agg(F.count("*").alias("n")).scalar()

    def parts(n: Column) -> list[Part]:
        valid = F.when(n_test * 4 < n, n_test).otherwise(F.floor(n / 5))
        return [("train", n - valid), ("valid", None)]

    return cut(train_valid, seed, keys, parts)


def sample_k(df: DataFrame, k: int, seed: int, keys: list[str]) -> DataFrame:
    """The first k rows of the seeded order, ranked: a top-k, not a full sort."""
    first = df.withColumn("_hash", seeded_hash(seed, keys)).orderBy("_hash", *keys).limit(k)
    # k rows at most are left, so the window is as small as the sample.
    rank = F.row_number().over(Window.orderBy("_hash", *keys))
    return first.withColumn("shot", rank).drop("_hash")


def _literal(df: DataFrame, order: list[str], row: Sequence) -> Column:
    kinds = [df.schema[c].dataType for c in order]
    return F.struct(*[F.lit(v).cast(k).alias(c) for c, k, v in zip(order, kinds, row)])


def nth_key(df: DataFrame, n: int, order: list[str]) -> tuple[tuple, int, int] | None:
    """Values of ``order`` in the n-th row, with the numbers of rows before and up to that key.

    None if there are fewer rows. Each round draws some keys, counts the rows below and at
    each of them, and goes on between the two nearest; ``BETWEEN`` keys are left after a few
    rounds, and these are sorted. A key that many rows share is found as soon as it is drawn.
    """
    key = F.struct(*order)
    keys = df.select(*order)
    left, below = keys.count(), 0
    if not 0 < n <= left:
        return None
    low = high = None
    seed = 0
    while left > BETWEEN:
        inside = keys if low is None else keys.where(key > low)
        inside = inside if high is None else inside.where(key < high)
        drawn = inside.sample(fraction=min(1.0, 4 * PIVOTS / left), seed=seed).limit(16 * PIVOTS).distinct()
        drawn = [tuple(r) for r in drawn.orderBy(*order).collect()]
        seed += 1
        if not drawn:
            continue
        pivots = drawn[:: max(1, len(drawn) // PIVOTS)]
        bounds = [_literal(df, order, p) for p in pivots]
        counts = inside.agg(
            *[F.count_if(key < b).alias(f"b{i}") for i, b in enumerate(bounds)],
            *[F.count_if(key <= b).alias(f"u{i}") for i, b in enumerate(bounds)],
        ).first()
        start, upper = below, below + left
        for i, pivot in enumerate(pivots):
            before, through = below + counts[f"b{i}"], below + counts[f"u{i}"]
            if before < n <= through:
                return pivot, before, through
            if through < n:
                low, start = bounds[i], through
            elif before >= n:
                high, upper = bounds[i], before
                break
        below, left = start, upper - start
    inside = keys if low is None else keys.where(key > low)
    inside = inside if high is None else inside.where(key < high)
    placed = with_position(inside, order, "_place")
    found = tuple(placed.where(F.col("_place") == n - below).select(*order).first())
    same = placed.where(key == _literal(df, order, found)).agg(F.min("_place"), F.max("_place")).first()
    return found, below + same[0] - 1, below + same[1]


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in a given order; all rows if there are fewer.

    Up to ``TOP`` rows are a top-k, in order. More are a filter by the key of the n-th row, in
    no order; of rows that share this key, as many as are wanted are taken.
    """
    if n <= TOP:
        return df.orderBy(*order).limit(n)
    found = nth_key(df, n, order)
    if found is None:
        return df
    border, below, upto = found
    key, limit = F.struct(*order), _literal(df, order, border)
    if upto == n:
        return df.where(key <= limit)
    ties = with_input_position(df.where(key == limit), "_place")
    return df.where(key < limit).unionByName(ties.where(F.col("_place") <= n - below).drop("_place"))


def cross_corpus(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and valid rows of one split corpus with the test rows of another."""
    return train.where("split IN ('train', 'valid')").unionByName(test.where("split = 'test'"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))
