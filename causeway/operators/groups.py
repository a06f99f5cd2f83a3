"""Sentences with several causal relations: select and merge them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import numbered_span
from .skew import with_group_size

# Workers get this module's functions as they are, whether or not they can import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP_KEY = ["corpus", "doc_id", "sent_id"]


def filter_num_causal(df: DataFrame, mode: str, keys: list[str] = GROUP_KEY) -> DataFrame:
    """``single``: sentences with one relation; ``multi``: with several, as they are."""
    sized = with_group_size(df, keys, "_relations")
    chosen = F.col("_relations") == 1 if mode == "single" else F.col("_relations") > 1
    return sized.where(chosen).drop("_relations")


def _wrap(text: str | None, span: str | None, letter: str, number: int) -> str | None:
    """Tag every occurrence of the span; None if it does not occur."""
    if text is None or span is None or span not in text:
        return None
    return text.replace(span, f"<{letter}{number}>{span}</{letter}{number}>")


def _merge_sorted(keys: list[str], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold of rows that come sorted by group; the state is one text and the group's first row."""

    def changes(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
        """Whether each row begins a group."""
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if before is not None:
                new[0] |= bool(column[0] != before.column(key)[0])
        new[0] |= before is None
        return new

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, text, number = None, None, 0

        def finished(rows: list[pa.RecordBatch], texts: list[str]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks().drop_columns(["_cause", "_effect"])
            at = table.schema.get_field_index("tagged_text")
            table = table.set_column(at, "tagged_text", pa.array(texts, pa.string()))
            return table.to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, texts = [], []
            columns = [batch.column(c) for c in ("text", "_cause", "_effect")]
            begins = changes(batch, first)
            for i in range(batch.num_rows):
                if begins[i]:
                    if text is not None and number >= least:
                        rows.append(first)
                        texts.append(text)
                    first, text, number = batch.slice(i, 1), columns[0][i].as_py(), 0
                number += 1
                if text is not None:
                    text = _wrap(text, columns[1][i].as_py(), "c", number)
                    text = _wrap(text, columns[2][i].as_py(), "e", number)
            if rows:
                yield finished(rows, texts)
        if text is not None and number >= least:
            yield finished([first], [text])

    return work


def merge_causal_groups(
    df: DataFrame, keys: list[str] = GROUP_KEY, order: str = "example_id", least: int = 1
) -> DataFrame:
    """One row per sentence, its relations numbered in ``tagged_text``.

    Relations are applied in ``order`` to the plain text, each tagging all
    occurrences of its cause and then of its effect, also inside earlier tags.
    A sentence where a span does not occur is dropped, as are NULL keys and
    sentences with fewer than ``least`` relations; `malformed_relations` tells
    which rows have no markup at all. Other columns come from the first relation.

    Rows are sorted by group and order, which spills, and folded as they stream by, so
    a task holds one text, however many relations a sentence has.
    """
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    relations = df.where(named).withColumns(
        {
            "_cause": numbered_span(F.col("tagged_text"), "c", F.lit("")),
            "_effect": numbered_span(F.col("tagged_text"), "e", F.lit("")),
        }
    )
    # Rows that agree on the order column are told apart by their markup.
    streamed = relations.repartition(*keys).sortWithinPartitions(*keys, order, "tagged_text")
    return streamed.mapInArrow(_merge_sorted(keys, least), df.schema)


def malformed_relations(df: DataFrame) -> DataFrame:
    """Rows whose ``tagged_text`` lacks a cause or an effect; merging drops their sentences."""
    cause, effect = (numbered_span(F.col("tagged_text"), letter, F.lit("")) for letter in "ce")
    return df.where(cause.isNull() | effect.isNull())


def causal_groups(df: DataFrame, mode: str, keys: list[str] = GROUP_KEY) -> DataFrame:
    """Number-of-relations filter with the merge that belongs to each mode.

    ``single`` keeps lone relations untouched, ``multi`` merges the others, and
    ``all`` merges everything, which numbers lone relations too.
    """
    if mode == "single":
        return filter_num_causal(df, "single", keys)
    return merge_causal_groups(df, keys, least=2 if mode == "multi" else 1)
