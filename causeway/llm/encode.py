"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps the boundaries that paths may still reach back to, which the longest piece
bounds. When all paths that could still win go back to one boundary, the ids up to it are
committed and the window moves on.
Stretches between sure boundaries (in front of a space, at a line break) repeat a lot, so
a task remembers their ids in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from causeway.llm.pieces import BLANK, Vocabulary
from causeway.llm.text import grouped, lean, list_array

REMEMBERED = 400_000  # stretches a task remembers; longer ones than LONGEST are not
LONGEST = 64
SPAN = 128  # boundaries after which a path is committed as far as it is sure


def best_path(text: str, vocabulary: Vocabulary) -> Iterator[tuple[int, int]]:
    """Ranges of the best path through ``text``, committed while it is read.

    The best path has the highest sum of scores; at a tie, the last piece is the longest
    one, at every boundary. Scores are summed from the last committed boundary on. Only the
    boundaries behind that one are held: when ``SPAN`` of them are done, whatever is common
    to all paths that reach beyond is committed; nothing in common makes the span longer.
    """
    root, longest, missing = vocabulary.trie, vocabulary.longest, vocabulary.unknown_score
    size, done, span = len(text), 0, SPAN
    sums: list = [0.0] + [None] * (span + longest)  # of the best path to each boundary
    back = [0] * len(sums)
    at = 0
    while done + at < size:
        if at == span:
            heads = {i for i in range(at, len(sums)) if sums[i] is not None}
            while len(heads) > 1:
                last = max(heads)
                heads.remove(last)
                heads.add(back[last])
            (common,) = heads
            if common:
                yield from _trace(back, common, done)
                base = sums[common]
                sums = [s if s is None else s - base for s in sums[common:]] + [None] * common
                back = [max(0, b - common) for b in back[common:]] + [0] * common
                done, at = done + common, at - common
            else:
                sums += [None] * span
                back += [0] * span
                span *= 2
        base, node, end, covered = sums[at], root, at, False
        for char in text[done + at : done + at + longest]:
            node = node.get(char)
            if node is None:
                break
            end += 1
            score = node.get("")
            if score is not None:
                total = base + score
                if sums[end] is None or total > sums[end]:
                    sums[end], back[end] = total, at
                covered = covered or end == at + 1
        at += 1
        if not covered and (sums[at] is None or base + missing > sums[at]):
            sums[at], back[at] = base + missing, at - 1
    yield from _trace(back, at, done)


def _trace(back: list[int], end: int, origin: int) -> list[tuple[int, int]]:
    """The ranges of the path to a boundary."""
    found = []
    while end:
        found.append((origin + back[end], origin + end))
        end = back[end]
    found.reverse()
    return found


def ids_of(text: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of text in which spaces are already U+2581."""
    found: list[int] = []
    for start, end in best_path(text, vocabulary):
        piece = text[start:end]
        number = vocabulary.ids.get(piece)
        if number is None:
            found += vocabulary.spell(piece)
        else:
            found.append(number)
    return found


class Memory(dict):
    """Ids, as bytes, of stretches; a stretch that begins with a line break stands as it
    is, any other one behind a space."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        if word[:1] == "\n":
            ids = self.vocabulary.spell("\n") + ids_of(word[1:], self.vocabulary)
        else:
            ids = ids_of(BLANK + word, self.vocabulary)
        found = np.array(ids, np.int32).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def encoder(vocabulary: Vocabulary) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids."""
    memory = Memory(vocabulary)
    borders = vocabulary.borders()
    newline_splits = "\n" in borders and "\n" not in vocabulary.ids

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(BLANK, " ")
        if " " not in borders or "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            return np.array(ids_of(BLANK + text.replace(" ", BLANK), vocabulary), np.int32)
        if newline_splits:
            text = text.replace("\n", " \n")
        # the text's own first stretch has the space that is put in front of a text
        words = text.split(" ")
        if words[0] == "":  # a line break comes first
            words[0:1] = []
            return np.concatenate(
                [np.array(ids_of(BLANK, vocabulary), np.int32), np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32)]
            )
        return np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32)

    return encode


def decoder(vocabulary: Vocabulary) -> Callable[[np.ndarray], str]:
    """A function from ids to text; it takes one space off the front."""
    spelled = vocabulary.spelled

    def decode(ids: np.ndarray) -> str:
        text = b"".join(map(spelled.__getitem__, ids.tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")

    return decode


def encode_texts(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """Every row with ``ids``, ``n_ids`` and ``round_trip`` (decoding the ids gives the text).

    A null text has null in all three, an empty one no ids. U+2581 in a text counts as a
    space, so such a text does not come back as it was. Added columns replace columns of
    the same names. Rows are mapped where they are: nothing is shuffled.
    """
    added = [
        StructField("ids", ArrayType(IntegerType(), False)),
        StructField("n_ids", LongType()),
        StructField("round_trip", BooleanType()),
    ]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    place = [f.name for f in kept].index(text_col)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(vocabulary), decoder(vocabulary)
        for batch in batches:
            whole = batch.column(place).to_pylist()
            for first, last in grouped(whole):
                texts = whole[first:last]
                ids = [np.zeros(0, np.int32) if t is None else encode(t) for t in texts]
                null = np.array([t is None for t in texts])
                lists = list_array(ids, pa.int32())
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(null))
                counts = pa.array([None if t is None else len(i) for t, i in zip(texts, ids, strict=True)], pa.int64())
                same = pa.array([None if t is None else decode(i) == t for t, i in zip(texts, ids, strict=True)], pa.bool_())
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, lists, counts, same], names=[*rows.schema.names, "ids", "n_ids", "round_trip"]
                )

    return df.select(*[f.name for f in kept]).mapInArrow(work, StructType([*kept, *added]))


def decode_ids(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids have a null text, unknown ids fail."""
    kept = [f for f in df.schema.fields if f.name != into]
    place = [f.name for f in kept].index(ids_col)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(vocabulary)
        for batch in batches:
            texts = [
                None if ids is None else decode(np.array(ids, np.int64)) for ids in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into]
            )

    schema = StructType([*kept, StructField(into, StringType())])
    return df.select(*[f.name for f in kept]).mapInArrow(work, schema)
