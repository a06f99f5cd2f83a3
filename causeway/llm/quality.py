"""Quality classifier by importance resampling of hashed n-grams.

The raw text is a mixture of target, low-quality and toxic text in the proportions of the
labels. Each unwanted kind has a generative model of n-grams (words, runs of punctuation,
pairs of neighbours) that fall into a fixed number of buckets, and so has the target text:

* Low-quality text differs in its style, so every occurrence of an n-gram counts. Buckets
  whose document counts do not differ for certain from all raw text keep its frequency.
* Toxic text differs in few words, so only their presence counts. A word has a bucket
  under each of two hashes, and the weaker evidence of the two is taken.

A document's importance weight is ``p(target text) / p(raw text)``. Documents are drawn
without replacement in proportion to their weights: the ``k`` largest of log weight plus
Gumbel noise, the noise being a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from causeway.llm.tables import written
from causeway.llm.text import MARKED, Tokens, grouped, lean, mix, tokens_of

BUCKETS = 1 << 17
SLICE = 1 << 12  # buckets whose counts travel as one row
KINDS = ("target", "low", "toxic")
SAMPLE = 20_000  # labelled documents of each kind that the models are fitted on, about
PRIOR = 5.0  # documents, or occurrences, as in all text that every bucket of a kind starts with
STYLE_SURE = 3.0  # standard deviations by which a bucket must differ to count for the style
WORDING_SURE = 4.5  # the same for the wording
WORDING_RATIO = 4.0  # a toxic word is in at least so many times as many texts as in target text
SPLITS = 4096


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of some texts: bucket, occurrences and text; and distinct words:
    bucket under each of two hashes and text."""

    bucket: np.ndarray
    times: np.ndarray
    owner: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    word_owner: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Grams:
        """A doubled token is one n-gram, whatever it is."""
        tokens = tokens_of(texts, MARKED)
        owner = tokens.owner()
        single = mix(tokens.prints + np.uint64(7))
        pairs, pair_owner = _pairs(tokens)
        both = np.concatenate([owner, pair_owner]) * BUCKETS + (np.concatenate([single, pairs]) % np.uint64(BUCKETS)).astype(np.int64)
        both, times = np.unique(both, return_counts=True)
        size = np.uint64(BUCKETS.bit_length() - 1)
        words = np.unique((owner.astype(np.uint64) << (size + size)) | (single >> (np.uint64(64) - size - size)))
        low = np.uint64(BUCKETS - 1)
        return Grams(
            both % BUCKETS,
            times,
            both // BUCKETS,
            ((words & low).astype(np.int64), ((words >> size) & low).astype(np.int64)),
            (words >> (size + size)).astype(np.int64),
        )


def _pairs(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    owner = tokens.owner()
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = tokens.prints[pair], tokens.prints[pair + 1]
    pairs = mix(left * np.uint64(0xA0761D6478BD642F) + right * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1))
    pairs[left == right] = 1
    return pairs, owner[pair]


def _sketches(texts: list[str | None]) -> np.ndarray:
    """Three min-hashes of each text's pairs of tokens, in one number; equal for most copies."""
    tokens = tokens_of(texts, MARKED)
    pairs, owner = _pairs(tokens)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = mix(np.arange(len(texts), dtype=np.uint64))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            lows = [mix(pairs[a:b] + np.uint64(k)).min() for k in (1, 2, 3)]
            found[i] = mix(mix(lows[0] + lows[1]) + lows[2])
    return found.view(np.int64)


# What is counted by bucket: of all documents, and of labelled ones.
COUNTED = (
    "raw_times", "raw", "target_times", "target", "low_times", "low",
    "target_words_0", "target_words_1", "toxic_words_0", "toxic_words_1",
)


@dataclass(frozen=True)
class Model:
    """Log ratios of the unwanted kinds to the target, by bucket, and the kinds' shares."""

    shares: np.ndarray
    style: np.ndarray
    wording: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def fit(counts: dict[str, np.ndarray], documents: np.ndarray, sampled: np.ndarray) -> Model | None:
        """None without labelled target text. A kind without documents has no share."""
        if not documents[0] or not counts["target"].sum():
            return None
        share = counts["raw_times"] / counts["raw_times"].sum()
        spread = counts["raw"] / counts["raw"].sum()

        def style(kind: str) -> np.ndarray:
            times, there = counts[f"{kind}_times"], counts[kind]
            ratio = (times + PRIOR) / (times.sum() * share + PRIOR)
            expected = there.sum() * spread
            ratio[np.abs(there - expected) < STYLE_SURE * np.sqrt(expected + 1)] = 1
            return np.log(ratio) - np.log((ratio * share).sum())

        def wording(toxic: np.ndarray, target: np.ndarray) -> np.ndarray:
            pool = (toxic + target) / sampled[[0, 2]].sum()
            odds = (toxic + PRIOR * pool) / (sampled[2] + PRIOR) / np.maximum((target + PRIOR * pool) / (sampled[0] + PRIOR), 1e-300)
            expected = sampled[2] * pool
            sure = (toxic - expected >= WORDING_SURE * np.sqrt(expected + 1)) & (odds >= WORDING_RATIO)
            return np.log(np.where(sure, odds, 1.0))

        return Model(
            documents / documents.sum(),
            style("low") - style("target"),
            tuple(wording(counts[f"toxic_words_{h}"], counts[f"target_words_{h}"]) for h in (0, 1)),
        )

    def log_weights(self, texts: list[str | None]) -> np.ndarray:
        grams = Grams.of(texts)
        style = np.bincount(grams.owner, self.style[grams.bucket] * grams.times, len(texts))
        weaker = np.minimum(self.wording[0][grams.words[0]], self.wording[1][grams.words[1]])
        wording = np.bincount(grams.word_owner, weaker, len(texts))
        with np.errstate(divide="ignore"):
            shares = np.log(self.shares)
        weights = -np.logaddexp.reduce(np.stack([shares[0] + 0 * style, shares[1] + style, shares[2] + wording]))
        weights[np.bincount(grams.owner, minlength=len(texts)) + np.bincount(grams.word_owner, minlength=len(texts)) == 0] = 0.0
        return weights


def labelled_kinds(labels: DataFrame, sample: int) -> tuple[DataFrame, np.ndarray]:
    """A sample of labelled ids with their kinds, about ``sample`` of each kind at most, and how
    many labelled ids a kind has.

    An id with several labels counts as toxic if one of them says so, else as low if one
    says so. Labels without an id or a quality count for nothing, except toxic ones.
    """
    kinds = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .select(
            "doc_id",
            F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("kind"),
        )
        .where("kind IS NOT NULL")
    )
    number = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # of a larger kind those whose hash is in the share of all hashes that gives ``sample``
    taken = F.lit(False)
    for kind, n in number.items():
        taken |= (F.col("kind") == kind) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < min(n, sample))
    return kinds.where(taken), np.array([number.get(k, 0) for k in range(len(KINDS))])


def _without_copies(sampled: DataFrame) -> DataFrame:
    """One id for each kind and sketch: a group of copies must not make its words typical."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sketch = [_sketches(texts[a:b]) for a, b in grouped(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *sketch]))],
                names=["doc_id", "kind", "sketch"],
            )

    schema = StructType([sampled.schema["doc_id"], StructField("kind", IntegerType()), StructField("sketch", LongType())])
    sketched = sampled.select("doc_id", "kind", "text").mapInArrow(work, schema)
    return sketched.groupBy("kind", "sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "kind")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Count the n-grams of all documents and of a sample of the labelled ones.

    What comes to the driver is one number for each bucket and entry of ``COUNTED``.
    """
    kinds, documents = labelled_kinds(labels, sample)
    texts = docs.select("doc_id", "text")
    # About ``sample`` ids of each kind, at most, are broadcast, here and below.
    single = _without_copies(texts.join(F.broadcast(kinds), "doc_id")).select("doc_id", F.lit(True).alias("single"))
    marked = texts.join(F.broadcast(kinds), "doc_id", "left").join(F.broadcast(single), "doc_id", "left")
    marked = marked.select("text", "kind", F.coalesce("single", F.lit(False)).alias("single"))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros(BUCKETS, np.int64) for name in COUNTED}
        sampled = np.zeros(len(KINDS), np.int64)
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            is_single = batch.column(2).to_numpy(zero_copy_only=False)
            for begin, end in grouped(texts):
                grams = Grams.of(texts[begin:end])
                kind = np.array([-1 if k is None else k for k in own[begin:end]], np.int64)
                once = np.where(is_single[begin:end], kind, -1)  # copies say nothing new about wording
                sampled += np.bincount(once[once >= 0], minlength=len(KINDS))
                of_gram, of_word = kind[grams.owner], once[grams.word_owner]
                target, low = of_gram == 0, of_gram == 1
                for name, bucket, times in (
                    ("raw_times", grams.bucket, grams.times),
                    ("raw", grams.bucket, None),
                    ("target_times", grams.bucket[target], grams.times[target]),
                    ("target", grams.bucket[target], None),
                    ("low_times", grams.bucket[low], grams.times[low]),
                    ("low", grams.bucket[low], None),
                    *[(f"target_words_{h}", grams.words[h][of_word == 0], None) for h in (0, 1)],
                    *[(f"toxic_words_{h}", grams.words[h][of_word == 2], None) for h in (0, 1)],
                ):
                    total[name] += np.bincount(bucket, times, BUCKETS).astype(np.int64)
        rows = [(i, part[k : k + SLICE]) for i, part in enumerate(total.values()) for k in range(0, BUCKETS, SLICE)]
        places = [i * BUCKETS + k for i in range(len(total)) for k in range(0, BUCKETS, SLICE)]
        yield _slices([*places, -1], [*[part for _, part in rows], sampled])

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int64)
                total[place] = total[place] + part if place in total else part
        yield _slices(list(total), list(total.values()))

    schema = StructType([StructField("place", IntegerType()), StructField("counts", BinaryType())])
    sums = marked.mapInArrow(count, schema).repartition("place").mapInArrow(add, schema).collect()
    whole = np.zeros((len(COUNTED), BUCKETS), np.int64)
    sampled = np.zeros(len(KINDS), np.int64)
    for row in sums:
        part = np.frombuffer(row["counts"], np.int64)
        if row["place"] < 0:
            sampled = part
        else:
            whole.reshape(-1)[row["place"] : row["place"] + len(part)] = part
    return Model.fit(dict(zip(COUNTED, whole, strict=True)), documents, sampled)


def _slices(places: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["place", "counts"]
    )


def score(docs: DataFrame, model: Model | None, seed: int = 0) -> DataFrame:
    """Every row with its ``log_weight`` and the ``draw`` that ranks it: weight plus Gumbel noise."""
    kept = [f for f in docs.schema.fields if f.name not in ("log_weight", "draw", "drawn")]
    place = [f.name for f in kept].index("text")
    added = StructField("log_weight", DoubleType())

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            weights = [model.log_weights(texts[a:b]) if model else np.zeros(b - a) for a, b in grouped(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate([np.zeros(0), *weights]))], names=[*batch.schema.names, added.name]
            )

    rows = docs.select(*[f.name for f in kept]).mapInArrow(work, StructType([*kept, added]))
    # 52 bits of the row's hash as a number within 0 and 1
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(numbers: DataFrame, column: str, k: int) -> float:
    """The k-th largest number, found by counting in ranges; equal numbers count one by one.

    A round reads the numbers once and brings at most ``SPLITS`` counts to the driver.
    """
    low, high = numbers.agg(F.min(column), F.max(column)).first()
    value = F.col(column)
    while low < high:
        width = (high - low) / SPLITS
        if low + width == low:  # neighbours among the floats: the few left are counted as they are
            for r in numbers.where(value.between(low, high)).groupBy(value.alias("v")).count().orderBy(F.desc("v")).collect():
                if k <= r["count"]:
                    return r["v"]
                k -= r["count"]
        cell = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(SPLITS - 1))
        cells = (
            numbers.where(value.between(low, high))
            .groupBy(cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
            .orderBy(F.desc("cell"))
            .collect()
        )
        for r in cells:
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def _cut(draws: DataFrame, k: int) -> Column:
    """Whether a row is among the ``k`` largest draws."""
    rows = draws.count()
    if k <= 0 or not rows:
        return F.lit(False)
    return F.lit(True) if k >= rows else F.col("draw") >= F.lit(kth_largest(draws, "draw", k))


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, seed: int = 0, texts: bool = False
) -> DataFrame:
    """Rows of ``docs`` (with ``doc_id`` and ``text``) scored and drawn; without their texts unless ``texts``.

    Added are ``log_weight``, ``draw`` and ``drawn``: whether the row is among the ``k``
    largest draws; they replace columns of the same names. So rows are drawn without replacement,
    in proportion to their weights. By default ``k`` is the number of rows of weight 1
    or more, which are likelier under the target's model than under the raw text's; the draw decides
    which of them give way to others. The models are fitted on all documents and on about
    ``sample`` labelled ones of each kind, or all if there are fewer.

    A null or empty text has no n-grams and weight 1. Repeated rows have equal draws: all
    rows whose draw equals the k-th largest are drawn. Without target labels every weight
    is 1 and, by default, all rows are drawn. Empty tables give empty results. Scores without
    texts are written to the shared folder; with ``texts`` rows are scored a second time, so that
    no copy of the texts is kept there.
    """
    model = fit(docs, labels, sample)
    draws = written(score(docs.select("doc_id", "text"), model, seed).drop("text"))
    drawn = _cut(draws, draws.where("log_weight >= 0").count() if k is None else k)
    return (score(docs, model, seed) if texts else draws).withColumn("drawn", drawn)
