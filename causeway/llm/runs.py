"""Periodic runs of words by string synchronising sets.

At scale t (1, 2, 4, ...) a set of positions is chosen by hashes alone: position i belongs to
it if, of the t + 1 windows of t words that begin at i to i + t, the one of smallest hash is
the first or the last. Whether i is chosen depends on its context, the 2 t words from i, and
on nothing else, so wherever a context recurs the choice recurs. Two neighbours with equal
context at distance d <= 2 t propose period d. A run of period t <= q < 2 t with four periods
has a chosen position whose context recurs q words later within the run, so it is proposed.

Windows that have a period of a quarter of t or less would be chosen too often, or not at
all. They are left out of the choice: these highly periodic regions have been detected at lower
scales, and their periods come from there. The scale t / 4 or lower proposes all of them, as
a run of period q, with t / 8 < q <= t / 4, is at least t words long if it holds such a window.

Proposals that overlap are joined and then extended word by word, so what is reported is
compared on words, not on hashes. Texts of a group are laid out behind one another, longest
first, so that the scales that only long texts need work on a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.text import mix

GROUP = 1 << 21  # bytes of text that are worked on at once, one text at least
TIMES, SHORTEST = 4, 6  # a run has so many periods and words at least
WORD = r"[^\x20\x09-\x0D]+"
AHEAD = 64  # words that an extension compares at once

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(2**64 - 1)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, as bytes in one array, and where those of each text begin.

    Words are longest runs of anything but ASCII white space; a null text has none.
    """
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = solid[edges]  # a word ends where its text ends
    starts = np.flatnonzero(first)
    whole = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])[np.append(starts, len(data))]
    buffers = [None, pa.py_buffer(whole.astype(np.int64)), pa.py_buffer(data[solid])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    return words, np.searchsorted(starts, offsets)


def _least_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``key[i : i + width + 1]``, ``width`` being a power of two."""
    low, step = key, 1
    while step < width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:-1], low[1:])


def _covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in any of the ranges."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change[:-1]) > 0


def _reach(ids: np.ndarray, at: np.ndarray, other: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from ``at`` and ``other`` on in direction ``way``, ``room`` at most."""
    far = np.zeros(len(at), np.int64)
    steps = np.arange(AHEAD)
    open_ = np.flatnonzero(room > 0)
    while len(open_):
        place = far[open_, None] + steps
        inside = place < room[open_, None]
        place = np.where(inside, place, 0) * way
        agree = inside & (ids[at[open_, None] + place] == ids[other[open_, None] + place])
        full = agree.all(axis=1)
        far[open_] += np.where(full, AHEAD, agree.argmin(axis=1))
        open_ = open_[full]
    return far


def _proposals(h: np.ndarray, twice: np.ndarray, ends: np.ndarray, loose: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``a`` of the set of scale ``t`` whose context recurs ``d`` words later."""
    key = np.where(loose, _NEVER, h)
    low = _least_ahead(key, t)
    n = len(low)
    chosen = (low != _NEVER) & ((key[:n] == low) | (key[t : t + n] == low))
    chosen &= np.arange(n) + 2 * t <= ends[:n]
    places = np.flatnonzero(chosen)
    context = twice[places]
    order = np.argsort(context, kind="stable")
    a, b = places[order[:-1]], places[order[1:]]
    near = (context[order[:-1]] == context[order[1:]]) & (b - a <= 2 * t) & (ends[a] == ends[b])
    return a[near], (b - a)[near]


def _extended(ids, begins, ends, a, d, t) -> np.ndarray:
    """Maximal stretches (start, stop, period) around proposals; those that overlap are one."""
    order = np.lexsort((a, d))
    a, d = a[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] - a[:-1] > 2 * t)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    start, stop, period = a[new], a[last] + 2 * t + d[new], d[new]
    left = _reach(ids, start - 1, start - 1 + period, start - begins[start], -1)
    right = _reach(ids, stop, stop - period, ends[start] - stop, 1)
    return np.unique(np.stack([start - left, stop + right, period], axis=1), axis=0)


def find_runs(ids: np.ndarray, bounds: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """All runs (start, stop, smallest period) of texts laid out longest first.

    A run has ``times`` periods (4 or more) and ``shortest`` words at least, and can't be
    extended. ``bounds`` are the places at which texts begin, and the end.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may be missed")
    size = np.diff(bounds)
    begins, ends = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    known = np.zeros((0, 3), np.int64)
    t = 1
    while True:
        n = int(bounds[np.count_nonzero(size >= max(shortest, times * t))])
        if not n:
            break
        h = h[:n]
        twice = np.zeros(n, np.uint64)
        twice[: n - t] = mix(h[: n - t] * _FACTOR + h[t:])
        inside = known[(known[:, 2] <= t // 4) & (known[:, 1] - known[:, 0] >= t) & (known[:, 0] < n)]
        loose = _covered(n, inside[:, 0], inside[:, 1] - t + 1)
        a, d = _proposals(h, twice, ends, loose, t)
        if len(a):
            known = np.concatenate([known, _extended(ids, begins, ends, a, d, t)])
        h, t = twice, 2 * t
    length = known[:, 1] - known[:, 0]
    known = known[(length >= shortest) & (length >= times * known[:, 2])]
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    if len(known):  # the same stretch by a multiple of its period
        known = known[np.append(True, (np.diff(known[:, :2], axis=0) != 0).any(axis=1))]
    equal = [np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in known]
    return known[np.array(equal, bool)]


def _worked(texts: pa.Array, times: int, shortest: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, first = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(size[order])])
    pick = np.repeat(first[:-1][order] - bounds[:-1], size[order]) + np.arange(len(codes))
    found = find_runs(codes[pick], bounds, times, shortest)

    # Back in the order of the texts.
    text = order[np.searchsorted(bounds, found[:, 0], side="right") - 1]
    shift = first[:-1][text] - bounds[:-1][np.argsort(order)][text]
    start, stop, period = found[:, 0] + shift, found[:, 1] + shift, found[:, 2]
    by_text = np.lexsort((period, start))
    start, stop, period, text = start[by_text], stop[by_text], period[by_text], text[by_text]
    runs = pa.StructArray.from_arrays(
        [pa.array(start - first[:-1][text]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"]
    )
    cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    kept = ~_covered(len(codes), start + period, stop)
    left = coded.dictionary.take(pa.array(codes[kept]))
    ends = np.concatenate([[0], np.cumsum(kept)])[first].astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(ends), left)
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    return pa.array(size), pa.ListArray.from_arrays(pa.array(cuts), runs), collapsed.cast(pa.large_string())


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``GROUP`` bytes, one text at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, length in enumerate(lengths.tolist()):
        held += length
        if held >= GROUP:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def periodic_runs(documents: DataFrame, times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``documents`` (``doc_id, text``).

    ``runs`` holds start, length and smallest period of all maximal runs of words, by start
    and period, numbered from 0. ``collapsed`` is the text without the words that a run has
    after its first period, joined by spaces. A null or empty text has no words and no runs;
    rows that repeat an id are rows of their own; other columns are ignored. Memory is linear
    in the longest text.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    schema = f"doc_id {kind}, n_words bigint, runs {runs}, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for first, last in _groups(texts):
                size, found, collapsed = _worked(texts.slice(first, last - first), times, shortest)
                columns = [batch.column(0).slice(first, last - first), size, found, collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, schema)


def best_run(runs: Column) -> Column:
    """The run of greatest exact length / period; ties go to the smaller start, then period."""

    def better(best: Column, run: Column) -> Column:
        more, least = run["length"] * best["period"], best["length"] * run["period"]
        smaller = F.struct(run["start"], run["period"]) < F.struct(best["start"], best["period"])
        return F.when((more > least) | ((more == least) & smaller), run).otherwise(best)

    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), better))


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def made_periodic(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: for ids whose CRC-32 ends in 0, the tail of words repeats its first ones.

    With h the CRC-32 of the id in decimal, g = h div 10 and n words, the tail begins at
    g mod n and repeats with period 1 + (n - start) div (3 + g mod 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    rows = rows.withColumn("first", F.when(F.col("n") > 0, F.pmod("g", "n")))
    rows = rows.withColumn("period", 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.pmod("g", F.lit(8)))))
    n, first, period = F.col("n"), F.col("first"), F.col("period")
    places = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.when(i < first, i).otherwise(first + F.pmod(i - first, period)).cast("int")
    )
    changed = F.array_join(F.transform(places, lambda i: F.get("words", i)), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))
