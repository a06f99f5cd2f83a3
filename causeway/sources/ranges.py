"""Records that span lines, read by byte ranges of a file in many tasks.

Spark's text source cuts a file into ranges and lets each range begin after a mark. Whether
such a place lies within a quoted cell or a JSON string, and how deep, follows from all that
stands before it. So the ranges are first summed up in parallel, then running totals over
them (one row for each range) tell the state in which every range begins, and a second pass
cuts records knowing it. Only records that are torn between ranges are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

# Workers get this module's functions as they are, whether or not they can import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE = ["file", "block"]
# Bytes of text that a task works on at a time; its arrays take many times that.
STRETCH = 1 << 22
_RECORD = "file string, block bigint, owner bigint, first boolean, value string"


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """What stands between marks, in the order of the scan, and the range it belongs to."""
    return spark.read.option("lineSep", mark).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def stretches(values: pa.Array, size: int = STRETCH) -> Iterator[pa.Array]:
    """The values in stretches of ``size`` bytes; a longer value is one of its own."""
    lengths = pc.fill_null(pc.binary_length(values), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + size, "right")), first + 1)
        yield values.slice(first, last - first)
        first = last


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array]]:
    """Values of each range, stretch by stretch, with the range's other columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        block, file = batch.column(names.index("block")), batch.column(names.index("file")).dictionary_encode().indices
        place = np.stack([block.to_numpy(zero_copy_only=False), file.to_numpy(zero_copy_only=False)])
        cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            own = {n: batch.column(i)[first].as_py() for i, n in enumerate(names) if n != "value"}
            for values in stretches(batch.column(names.index("value")).slice(first, last - first)):
                yield own, values


def _records(pieces: DataFrame, states: DataFrame, cutter: type, torn: bool, glue: str) -> DataFrame:
    """Whole records of each range, or the torn ones put together.

    A cutter begins with a range's state. Fed pieces, it gives the end of a record that began
    in an earlier range, if it comes, and the records that are whole; ``held`` is what is left.
    Only ranges whose state is ``torn`` begin or end within a record, so text of the others
    does not leave the scan when torn records are looked for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, own = None, None

        def batch(own: dict, values: list | pa.Array, head: bool, first: list | np.ndarray) -> pa.RecordBatch:
            owner = None if not torn else own["owner"] if head else own["block"]
            same = [(own["file"], pa.string()), (own["block"], pa.int64()), (owner, pa.int64())]
            columns = [pa.repeat(pa.scalar(value, kind), len(values)) for value, kind in same]
            columns += [pa.array(first, pa.bool_()), pa.array(values, pa.string()) if isinstance(values, list) else values]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "owner", "first", "value"])

        def close() -> Iterator[pa.RecordBatch]:
            if torn and scan is not None and scan.held:
                yield batch(own, [glue.join(scan.held)], scan.headed, [False])

        for now, values in _runs(batches):
            if own is None or (now["file"], now["block"]) != (own["file"], own["block"]):
                yield from close()
                own, scan = now, cutter(now)
            head, whole = scan.feed(values, torn)
            if torn and head is not None:
                yield batch(own, [head], True, [False])
            if not torn and len(whole):
                first = np.zeros(len(whole), bool)
                first[0] = own["block"] == 0 and scan.count == len(whole)
                yield batch(own, whole, False, first)
        yield from close()

    if torn:
        states = states.where("torn")
    cut = pieces.join(F.broadcast(states.drop("torn")), RANGE).mapInArrow(work, _RECORD)
    if not torn:
        return cut.select("file", "block", "first", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = F.array_join(F.transform(parts, lambda part: part["value"]), glue)
    whole = cut.groupBy("file", "owner").agg(joined.alias("value"))
    return whole.select("file", F.col("owner").alias("block"), F.lit(False).alias("first"), "value")


def _with_owner(blocks: DataFrame) -> DataFrame:
    """``owner``: the last range before that leaves a record open (``tail``)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("owner", F.last(F.when(F.col("tail"), F.col("block")), ignorenulls=True).over(before))


def _before(column: Column, blocks: WindowSpec) -> Column:
    """Sum over the ranges before this one."""
    return F.coalesce(F.sum(column).over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


# --- quoted CSV ------------------------------------------------------------------


class _QuotedLines:
    """Lines of a range joined to records: one ends where all quotes so far pair up."""

    def __init__(self, state: dict):
        self.open = int(state["odd_before"])
        self.headed = bool(self.open)  # what is held belongs to a record of an earlier range
        self.held: list[str] = []
        self.count = 0

    def feed(self, lines: pa.Array, torn: bool = False) -> tuple[str | None, pa.Array]:
        parity = (self.open + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2
        ends = np.flatnonzero(parity == 0) + 1
        self.open = int(parity[-1])
        head, records = None, lines.slice(0, 0)
        if not len(ends):
            self.held += lines.to_pylist()
            return head, records
        start = 0
        if self.held or self.headed:
            start = 1
            record = "\n".join([*self.held, *lines.slice(0, int(ends[0])).to_pylist()])
            head, records = (record, records) if self.headed else (None, pa.array([record], lines.type))
        self.held = lines.slice(int(ends[-1])).to_pylist()
        self.headed = False
        if not torn and len(ends) > start:
            offsets = np.concatenate([[0], ends])[start:]
            own = lines.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            if len(own) > len(offsets) - 1:  # some record has several lines
                own = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), own), "\n")
            records = pa.concat_arrays([records, own]) if len(records) else own
        self.count += len(records)
        return head, records


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, first, value``: records of CSV files, line breaks in quotes kept.

    A cell that holds a quote must be quoted and double it. ``first`` marks the first record
    of a file, ``value`` has no line break at its end, and blank lines between records are left
    out. The text is scanned three times: for the quotes, for whole records and for torn ones;
    the last scan goes on with ranges that have one.
    """
    lines = _pieces(spark, path, "\n")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    blocks = lines.groupBy(*RANGE).agg((F.sum(odd) % 2).alias("flip"), F.max(odd).alias("turns"))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("odd_before", _before(F.col("flip"), in_file) % 2)
    tail = ((F.col("odd_before") + F.col("flip")) % 2 == 1) & ((F.col("odd_before") == 0) | (F.col("turns") == 1))
    states = _with_owner(blocks.withColumn("tail", tail)).select(
        *RANGE, "odd_before", "owner", (F.col("tail") | (F.col("odd_before") == 1)).alias("torn")
    )
    records = [_records(lines, states, _QuotedLines, torn, "\n") for torn in (False, True)]
    both = records[0].unionByName(records[1]).where(r"value RLIKE '\\S'")
    bare = F.regexp_replace("value", "\r$", "")
    return both.withColumn("value", F.when(F.contains("value", F.lit("\r")), bare).otherwise(F.col("value")))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header as columns of text; a record may span lines and ranges."""
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).csv(path).columns
    cells = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {k: v for k, v in options.items() if k != "header"})
    # Inlined, the cells are parsed once for each record; as plain fields of the struct they
    # would be parsed again for every column, and again for every use in a filter.
    return quoted_records(spark, path).where("NOT first").select(F.inline(F.array(cells)))


# --- arrays in JSON documents ------------------------------------------------------

_OPENS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool)
_OPENS[[0x5B, 0x7B]] = _CLOSES[[0x5D, 0x7D]] = True
_QUOTE, _SLASH, _BRACE, _BRACE_END = 0x22, 0x5C, 0x7B, 0x7D


def _structure(data: np.ndarray, in_string: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that begin or end strings; brackets outside of strings, and the depth after each."""
    quotes = np.flatnonzero(data == _QUOTE)
    if (data == _SLASH).any():
        plain = np.maximum.accumulate(np.where(data != _SLASH, np.arange(len(data)), -1))
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    brackets = np.flatnonzero(_OPENS[data] | _CLOSES[data])
    brackets = brackets[(in_string + np.searchsorted(quotes, brackets)) % 2 == 0]
    return quotes, brackets, depth + np.cumsum(np.where(_OPENS[data[brackets]], 1, -1))


def _as_bytes(pieces: pa.Array) -> np.ndarray:
    """The pieces as they stood, each with the brace that ended it."""
    return np.frombuffer(("}".join(pieces.to_pylist()) + "}").encode("utf-8", "surrogatepass"), np.uint8)


def _root_keys(data: np.ndarray, quotes: np.ndarray, brackets: np.ndarray, depth: np.ndarray) -> list[tuple[int, str]]:
    """Members of a document's root that hold an array or an object: place, and key if an array."""
    found = []
    for at in brackets[(depth == 2) & _OPENS[data[brackets]]].tolist():
        k = int(np.searchsorted(quotes, at))
        key = bytes(data[quotes[k - 2] + 1 : quotes[k - 1]]).decode("utf-8", "replace") if k >= 2 else ""
        found.append((at, "" if data[at] == _BRACE else key))
    return found


class _Elements:
    """Objects in the array under one key of the root, cut out of a range."""

    def __init__(self, state: dict):
        self.in_string, self.depth = int(state["string_before"]), int(state["depth_before"])
        self.wanted, self.key = state["wanted"], state["key_before"] or ""
        self.open = self.headed = self.depth >= 3 and self.key == self.wanted
        self.held: list[str] = []
        self.count = 0

    def feed(self, pieces: pa.Array, torn: bool = False) -> tuple[str | None, list[str]]:
        data = _as_bytes(pieces)
        quotes, brackets, depth = _structure(data, self.in_string, self.depth)
        keys = _root_keys(data, quotes, brackets, depth)
        kind = data[brackets]
        places = [p for p, _ in keys]
        chosen = ((kind == _BRACE) & (depth == 3)) | ((kind == _BRACE_END) & (depth == 2))
        records, head, start = [], None, 0
        for at, begins in zip(brackets[chosen].tolist(), (kind[chosen] == _BRACE).tolist(), strict=True):
            k = int(np.searchsorted(places, at))
            if (keys[k - 1][1] if k else self.key) != self.wanted:
                continue
            if begins:
                self.open, start = True, at
            elif self.open:
                record = "".join(self.held) + bytes(data[start : at + 1]).decode("utf-8", "replace")
                self.held, self.open = [], False
                if self.headed:
                    head, self.headed = record, False
                else:
                    records.append(record)
        if self.open:
            self.held.append(bytes(data[start:]).decode("utf-8", "replace"))
        self.in_string = (self.in_string + len(quotes)) % 2
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.key = keys[-1][1] if keys else self.key
        self.count += len(records)
        return head, records


def _summed(pieces: DataFrame, schema: str, start: Callable, add: Callable) -> DataFrame:
    """One row for each range: ``add`` folds its batches into what ``start`` makes of its columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        rows: list[dict] = []
        for now, values in _runs(batches):
            if own is None or (now["file"], now["block"]) != (own["file"], own["block"]):
                if own is not None:
                    rows.append({"file": own["file"], "block": own["block"], **state})
                own, state = now, start(now)
            add(state, _as_bytes(values))
        if own is not None:
            rows.append({"file": own["file"], "block": own["block"], **state})
            rows = [{k: v for k, v in row.items() if not k.startswith("_")} for row in rows]
            yield pa.RecordBatch.from_pylist(rows)

    return pieces.mapInArrow(work, schema)


def _add_depths(state: dict, data: np.ndarray) -> None:
    for string in (0, 1):
        _, _, depth = _structure(data, (string + state["flip"]) % 2, 0)
        state[f"depth{string}"] += int(depth[-1]) if len(depth) else 0
    state["flip"] = (state["flip"] + len(_structure(data, 0, 0)[0])) % 2


def _add_keys(state: dict, data: np.ndarray) -> None:
    quotes, brackets, depth = _structure(data, state["_string"], state["_depth"])
    keys = _root_keys(data, quotes, brackets, depth)
    state["key"] = keys[-1][1] if keys else state["key"]
    state["closes"] = state["closes"] or bool(((data[brackets] == _BRACE_END) & (depth == 2)).any())
    state["_string"] = (state["_string"] + len(quotes)) % 2
    state["_depth"] = int(depth[-1]) if len(depth) else state["_depth"]


def json_elements(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``value``: objects of the array under ``key`` of each JSON document, as JSON text.

    A document is an object; a file holds one, or several behind one another. The text is
    scanned four times: for string state and depth, for the root's keys, for whole elements
    and for torn ones. Other members of the root, arrays included, are skipped.
    """
    pieces = _pieces(spark, path, "}")
    in_file = Window.partitionBy("file").orderBy("block")
    depths = _summed(
        pieces,
        "file string, block bigint, flip bigint, depth0 bigint, depth1 bigint",
        lambda own: {"flip": 0, "depth0": 0, "depth1": 0},
        _add_depths,
    )
    blocks = depths.withColumn("string_before", _before(F.col("flip"), in_file) % 2)
    change = F.when(F.col("string_before") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    blocks = blocks.withColumn("depth_before", _before(change, in_file)).withColumn("depth_after", F.col("depth_before") + change)
    blocks = blocks.select(*RANGE, "string_before", "depth_before", "depth_after")
    keys = _summed(
        pieces.join(F.broadcast(blocks), RANGE),
        "file string, block bigint, key string, closes boolean",
        lambda own: {"key": None, "closes": False, "_string": own["string_before"], "_depth": own["depth_before"]},
        _add_keys,
    )
    upto = in_file.rowsBetween(Window.unboundedPreceding, 0)
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(keys, RANGE).withColumns(
        {"key_before": F.last("key", ignorenulls=True).over(before), "key_after": F.last("key", ignorenulls=True).over(upto)}
    )
    inside = (F.col("depth_before") >= 3) & F.col("key_before").eqNullSafe(F.lit(key))
    tail = (F.col("depth_after") >= 3) & F.col("key_after").eqNullSafe(F.lit(key)) & (~inside | F.col("closes"))
    states = _with_owner(blocks.withColumns({"tail": tail, "torn": tail | inside})).withColumn("wanted", F.lit(key))
    states = states.select(*RANGE, "string_before", "depth_before", "key_before", "wanted", "owner", "torn")
    records = [_records(pieces, states, _Elements, torn, "") for torn in (False, True)]
    return records[0].unionByName(records[1]).select("value")
