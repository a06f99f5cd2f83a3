"""Benchmark decontamination: test phrases are searched in an FM-index of each training shard.

A task cuts its rows into shards of bounded size and builds an index of each. Words that
no benchmark item has are one symbol that ends a stretch, and stretches shorter than the
shortest phrase hold no occurrence, so both stay out of the index. The benchmark is
searched in blocks of bounded size, one pass each; a pass adds to what earlier ones found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from causeway.llm.fmindex import FmIndex
from causeway.llm.tables import written
from causeway.llm.text import ALNUM, Tokens, grouped, lean, list_array, tokens_of

WINDOW = 10  # words of a phrase
BLOCK_CHARS = 8_000_000  # benchmark text that is shipped to tasks at once, one item at least
SHARD_BYTES = 4 << 20

ADDED = ("n_words", "hit_starts", "hit_ends", "items")


class Phrases:
    """All distinct windows of some items, as numbers of the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        names = sorted({"" if name is None else name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        self.names = np.array([*names, ""], object)[:-1]
        words = tokens_of([text for _, text in items], ALNUM)
        self.words = np.unique(words.prints)
        self.alphabet = len(self.words) + 1
        symbols = np.searchsorted(self.words, words.prints) + 1
        owners: dict[tuple[int, ...], set[int]] = {}
        for i, (name, _) in enumerate(items):
            own = symbols[words.bounds[i] : words.bounds[i + 1]].tolist()
            for start in range(max(len(own) - window, 0) + 1 if own else 0):
                phrase = tuple(own[start : start + window])
                owners.setdefault(phrase, set()).add(number["" if name is None else name])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.backwards = np.zeros((len(owners), window), np.int64)
        for i, phrase in enumerate(owners):
            self.backwards[i, : len(phrase)] = phrase[::-1]
        self.owners = [np.array(sorted(o), np.int64) for o in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def occurrences(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The first token of each occurrence, and the phrase's number."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(tokens.prints):
            return none
        place = np.minimum(np.searchsorted(self.words, tokens.prints), len(self.words) - 1)
        symbol = np.where(self.words[place] == tokens.prints, place + 1, 0)
        # stretches of known words within a text
        begins = np.zeros(len(symbol), bool)
        begins[tokens.bounds[:-1][np.diff(tokens.bounds) > 0]] = True
        known = symbol > 0
        starts = np.flatnonzero(known & (begins | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & np.concatenate([begins[1:] | ~known[1:], [True]])) + 1
        long_enough = ends - starts >= self.shortest
        starts, size = starts[long_enough], (ends - starts)[long_enough]
        if not len(starts):
            return none
        offsets = np.concatenate([[0], np.cumsum(size + 1)])  # each stretch and a 0 behind it
        text = np.zeros(offsets[-1], np.int64)
        inside = np.ones(len(text), bool)
        inside[offsets[1:] - 1] = False
        origin = np.arange(len(text)) - np.repeat(offsets[:-1] - starts, size + 1)
        text[inside] = symbol[origin[inside]]
        index = FmIndex(text, self.alphabet)
        low, high = index.search(self.backwards, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        return origin[index.locate(rows)], phrase


def _unite(words: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge ranges that overlap or touch."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    covered = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _search(texts: list[str | None], phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: number of words, starts and ends of hit ranges, numbers of the items."""
    tokens = tokens_of(texts, ALNUM)
    first, phrase = phrases.occurrences(tokens)
    owner = np.searchsorted(tokens.bounds, first, "right") - 1
    order = np.argsort(owner, kind="stable")
    first, phrase, owner = first[order], phrase[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    none = np.zeros(0, np.int64)
    for i in range(len(texts)):
        words = int(tokens.bounds[i + 1] - tokens.bounds[i])
        own = slice(cuts[i], cuts[i + 1])
        if own.start == own.stop:
            yield words, none, none, none
            continue
        begin = first[own] - tokens.bounds[i]
        starts, ends = _unite(words, begin, begin + phrases.lengths[phrase[own]])
        yield words, starts, ends, np.unique(np.concatenate([phrases.owners[p] for p in np.unique(phrase[own])]))


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``chars`` characters, one item at least."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / chars))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["id"], r["text"]) for r in numbered.where(F.col("block") == block).collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every row of ``docs`` with its number of words, hit word ranges and items.

    Added are ``n_words``, ``hit_starts`` and ``hit_ends`` (merged ranges of words, from 0,
    end excluded) and ``items`` (distinct ids, as strings, of items that occur). They
    replace columns of the same names. Null and empty texts have no words. Null and empty
    items are never found; an item without an id is listed as an empty string, and rows
    that repeat an id are one item. Nothing is shuffled.
    """
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    place = [f.name for f in kept].index(text_col)
    schema = StructType(
        [
            *kept,
            StructField("n_words", LongType()),
            StructField("hit_starts", ArrayType(LongType(), False)),
            StructField("hit_ends", ArrayType(LongType(), False)),
            StructField("items", ArrayType(StringType(), False)),
        ]
    )
    found = docs.select(*[f.name for f in kept])
    for number, items in enumerate(benchmark_blocks(benchmark, item_id_col, item_text_col, block_chars)):
        found = found.mapInArrow(_pass(Phrases(items, window), place, len(kept), number == 0), schema)
    return found


def _pass(phrases: Phrases, place: int, kept: int, is_first: bool):
    """Search one block of the benchmark; later passes add to the columns of earlier ones."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(place).to_pylist()
            for first, last in grouped(whole, SHARD_BYTES):
                rows = batch.slice(first, last - first)
                words, starts, ends, items = [], [], [], []
                for count, begin, end, own in _search(whole[first:last], phrases):
                    words.append(count)
                    starts.append(begin)
                    ends.append(end)
                    items.append(phrases.names[own])
                if not is_first:
                    for i, (a, b, known) in enumerate(zip(*[rows.column(kept + k).to_pylist() for k in (1, 2, 3)], strict=True)):
                        starts[i], ends[i] = _unite(
                            words[i],
                            np.concatenate([starts[i], np.array(a, np.int64)]),
                            np.concatenate([ends[i], np.array(b, np.int64)]),
                        )
                        items[i] = np.array(sorted({*items[i], *known}), object)
                lists = [list_array(starts, pa.int64()), list_array(ends, pa.int64()), pa.array([i.tolist() for i in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:kept], pa.array(words, pa.int64()), *lists], names=[*rows.schema.names[:kept], *ADDED]
                )

    return work


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without some ranges of words; a line break stands where one was."""
    tokens = tokens_of([text], ALNUM)
    parts, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        parts.append(tokens.data[at : tokens.starts[start]])
        at = int(tokens.ends[end - 1])
    parts.append(tokens.data[at:-1])
    return b"\n".join(p.strip(b" ") for p in parts).decode("utf-8", "surrogatepass").strip("\n")


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows of ``docs`` whose texts have lost every hit range of words, and ``n_removed`` words.

    Texts without a hit stay as they are. Cutting may bring words together that form a
    phrase again; a text is searched until none is left. Other cases as in
    `find_contamination`.
    """
    names = [f.name for f in docs.schema.fields if f.name != "n_removed"]
    place = names.index(text_col)
    schema = StructType([*[f for f in docs.schema.fields if f.name != "n_removed"], StructField("n_removed", LongType())])
    cleaned = docs.select(*names).withColumn("n_removed", F.lit(0).cast("long"))
    blocks = [Phrases(i, window) for i in benchmark_blocks(benchmark, item_id_col, item_text_col, block_chars)]
    before = -1
    while True:
        for phrases in blocks:
            cleaned = cleaned.mapInArrow(_cut(phrases, place, len(names)), schema)
        if len(blocks) == 1:
            return cleaned
        # a cut for one block may make a phrase of another, so all take their turns again
        cleaned = written(cleaned)
        removed = cleaned.agg(F.sum("n_removed")).first()[0] or 0
        if removed in (0, before):
            return cleaned
        before = removed


def _cut(phrases: Phrases, place: int, kept: int):
    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(place).to_pylist()
            removed = np.array(batch.column(kept).to_pylist(), np.int64)
            for first, last in grouped(whole, SHARD_BYTES):
                waiting = list(range(first, last))
                while waiting:
                    hit = []
                    found = _search([whole[i] for i in waiting], phrases)
                    for i, (_, starts, ends, _items) in zip(waiting, found, strict=True):
                        if len(starts):
                            whole[i] = _without(whole[i], starts.tolist(), ends.tolist())
                            removed[i] += int((ends - starts).sum())
                            hit.append(i)
                    waiting = hit
            columns = list(batch.columns[:kept])
            columns[place] = pa.array(whole, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=batch.schema.names)

    return work
