"""Language identification by a convolutional network over bytes, trained here in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it. Filters of
several widths slide over embedded bytes; the largest answer of each filter in a window
goes to a softmax over the languages. A text's probabilities are the mean of its windows',
weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 24  # of each width
EMBEDDED = 8
SAMPLE = 12_000  # windows to learn from, about, dealt evenly to the languages
STEPS = 900
BATCH = 64
BLANK = 256  # the byte number that fills a window up
UNKNOWN = "und"


def _has_letter(text: str) -> bool:
    """Any character of category L, which is what the training rows are chosen by, too."""
    return any(map(str.isalpha, text))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 257 x EMBEDDED
    filters: list[np.ndarray]  # for each width: width x EMBEDDED x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        pooled = FILTERS * len(WIDTHS)

        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return Network(
            languages,
            normal(0.5, BLANK + 1, EMBEDDED),
            [normal((2 / (w * EMBEDDED)) ** 0.5, w, EMBEDDED, FILTERS) for w in WIDTHS],
            np.zeros(pooled, np.float32),
            normal(0.1, pooled, len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def answers(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest answer of each filter in each window, and where it is."""
        found, where = [], []
        for kernel in self.filters:
            width = len(kernel)
            span = windows.shape[1] - width + 1
            # an embedded byte times a filter's row is one of 257 vectors
            total = (self.embedding @ kernel[0])[windows[:, :span]]
            for k in range(1, width):
                total += (self.embedding @ kernel[k])[windows[:, k : k + span]]
            if places:
                best = total.argmax(axis=1)
                where.append(best)
                found.append(np.take_along_axis(total, best[:, None], 1)[:, 0])
            else:
                found.append(total.max(axis=1))
        return np.concatenate(found, axis=1) + self.bias, np.concatenate(where, axis=1) if places else None

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.answers(windows)[0], 0) @ self.weights + self.base
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def gradient(self, windows: np.ndarray, gold: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of `parameters`."""
        answers, where = self.answers(windows, places=True)
        pooled = np.maximum(answers, 0)
        logits = pooled @ self.weights + self.base
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = odds / odds.sum(axis=1, keepdims=True)
        slope[np.arange(len(gold)), gold] -= 1
        slope /= len(gold)
        back = (slope @ self.weights.T) * (answers > 0)
        embedding = np.zeros_like(self.embedding)
        filters = []
        for i, kernel in enumerate(self.filters):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            change = np.zeros_like(kernel)
            for k in range(len(kernel)):
                byte = np.take_along_axis(windows, where[:, own] + k, 1)  # windows x filters
                change[k] = np.einsum("nfd,nf->df", self.embedding[byte], back[:, own])
                np.add.at(embedding, byte.ravel(), (back[:, own, None] * kernel[k].T[None]).reshape(-1, EMBEDDED))
            filters.append(change)
        return [embedding, *filters, back.sum(axis=0), pooled.T @ slope, slope.sum(axis=0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.weights, self.base]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all bytes, the text of each window and its number of bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(-(-sizes // WINDOW), 1)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.full(len(owner) * WINDOW, BLANK, np.int64)
    start = np.cumsum(count) - count
    data = np.frombuffer(b"".join(texts), np.uint8)
    flat[np.arange(len(data)) + np.repeat(start * WINDOW - (np.cumsum(sizes) - sizes), sizes)] = data
    return flat.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - nth * WINDOW, WINDOW)


def train(texts: list[str], gold: list[str], seed: int = 0, steps: int = STEPS) -> Network | None:
    """A network for the languages in ``gold``; None without any."""
    languages = sorted(set(gold))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {name: i for i, name in enumerate(languages)}
    labels = np.array([number[g] for g in gold])
    windows = np.full((len(texts), WINDOW), BLANK, np.int64)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass")[:WINDOW], np.uint8)
        windows[i, : len(raw)] = raw
    network = Network.fresh(languages, seed)
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(texts), BATCH)
        batch = windows[chosen]
        cut = rng.integers(6, WINDOW, BATCH)  # some windows are short, as ends of texts are
        short = rng.random(BATCH) < 0.3
        batch[short[:, None] & (np.arange(WINDOW)[None] >= cut[:, None])] = BLANK
        rate = 0.004 * (1 - step / (steps + 1))
        for p, g, m, v in zip(network.parameters(), network.gradient(batch, labels[chosen]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Windows of labelled documents that are not held out, and their languages.

    Of each language a share of documents by their hash is taken, about the same number of
    each, and of each of these one window from anywhere in its text: about ``sample`` in all.
    """
    usable = docs.where(
        F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    number = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return [], []
    share = max(1, sample // len(number))
    taken = F.lit(False)
    for language, n in number.items():
        taken |= (F.col("lang") == language) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < min(n, share))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1)
    part = F.substring("text", place.cast("int") + 1, F.lit(WINDOW)).alias("part")
    rows = sorted(usable.where(taken).select("lang", part, F.xxhash64("doc_id").alias("order")).collect(), key=tuple)
    return [r["part"] for r in rows], [r["lang"] for r in rows]


def predict_languages(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and its ``score``, the mean probability over the whole text.

    A null text, and one without a letter, is ``und`` with score 0, and so is every text if
    nothing was learned. Texts of any length are read whole, in windows; at a tie the
    language that sorts first wins. Added columns replace columns of the same names.
    Nothing is shuffled.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    place = [f.name for f in kept].index(text_col)
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def mean_probabilities(raw: list[bytes]) -> np.ndarray:
        windows, owner, size = windows_of(raw)
        total = np.zeros((len(raw), len(network.languages)))
        for at in range(0, len(windows), 256):
            part = slice(at, at + 256)
            np.add.at(total, owner[part], network.probabilities(windows[part]) * size[part, None])
        return total / np.maximum([len(t) for t in raw], 1)[:, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            telling = [i for i, t in enumerate(texts) if t and network and _has_letter(t)]
            held: list[int] = []
            size = 0
            for n, i in enumerate(telling):
                held.append(i)
                size += len(texts[i])
                if size >= 1 << 20 or n == len(telling) - 1:
                    mean = mean_probabilities([texts[k].encode("utf-8", "surrogatepass") for k in held])
                    for k, best, row in zip(held, mean.argmax(axis=1), mean, strict=True):
                        languages[k], scores[k] = network.languages[best], min(1.0, float(row[best]))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.select(*[f.name for f in kept]).mapInArrow(work, schema)
