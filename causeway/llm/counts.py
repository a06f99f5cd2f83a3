"""Token counts without tokens: Aho-Corasick matches and a search that carries numbers only.

An automaton of all pieces enumerates every place where a piece ends. For each boundary
the best score and the number of ids on the best path are kept, nothing else. Ties go to
the longest last piece, as in the tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from causeway.llm.encode import LONGEST, REMEMBERED
from causeway.llm.pieces import BLANK, Vocabulary


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """Each piece with its length and score."""
    built = ahocorasick.Automaton()
    for piece, score in vocabulary.scores.items():
        built.add_word(piece, (len(piece), score))
    if not len(built):
        built.add_word("\0\0", (2, vocabulary.unknown_score))
    built.make_automaton()
    return built


def count_ids(text: str, vocabulary: Vocabulary, matches: ahocorasick.Automaton) -> int:
    """Number of ids of text in which spaces are already U+2581.

    The window of boundaries is a ring as long as the longest piece, so memory does not
    grow with the text. Sums are taken relative to the newest boundary's each round.
    """
    ring = vocabulary.longest + 1
    sums, counts = [0.0] * ring, [0] * ring
    spelled, missing = bool(vocabulary.byte_ids), vocabulary.unknown_score
    found = matches.iter(text)
    ahead = next(found, None)
    for end in range(1, len(text) + 1):
        top, number, length = None, 0, 0
        while ahead is not None and ahead[0] == end - 1:  # the longest piece first: it wins a tie
            length, score = ahead[1]
            place = (end - length) % ring
            total = sums[place] + score
            if top is None or total > top:
                top, number = total, counts[place] + 1
            ahead = next(found, None)
        if length != 1:  # no piece covers the character
            place = (end - 1) % ring
            total = sums[place] + missing
            if top is None or total > top:
                own = len(text[end - 1].encode("utf-8", "surrogatepass")) if spelled else 1
                top, number = total, counts[place] + own
        sums[end % ring], counts[end % ring] = top, number
        if end % (1 << 12) == 0:
            sums = [s - top for s in sums]
    return counts[len(text) % ring]


class Counts(dict):
    """Numbers of ids of stretches, as `encode.Memory` has the ids themselves."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.matches = vocabulary, automaton(vocabulary)
        self.newline = len(vocabulary.spell("\n"))

    def of(self, text: str) -> int:
        return count_ids(text, self.vocabulary, self.matches)

    def __missing__(self, word: str) -> int:
        found = self.newline + self.of(word[1:]) if word[:1] == "\n" else self.of(BLANK + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def counter(vocabulary: Vocabulary):
    """A function from a text to its number of ids."""
    memory = Counts(vocabulary)
    borders = vocabulary.borders()

    def count(text: str) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if " " not in borders or "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            return memory.of(BLANK + text.replace(" ", BLANK))
        if "\n" in borders:
            text = text.replace("\n", " \n")
        words = text.split(" ")
        if words[0] == "":
            return memory.of(BLANK) + sum(map(memory.__getitem__, words[1:]))
        return sum(map(memory.__getitem__, words))

    return count


def count_tokens(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """Every row with its number of tokens; a null text has null, an empty one 0.

    The added column replaces one of the same name. Nothing is shuffled.
    """
    kept = [f for f in df.schema.fields if f.name != into]
    place = [f.name for f in kept].index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            numbers = [None if t is None else count(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, into]
            )

    schema = StructType([*kept, StructField(into, LongType())])
    return df.select(*[f.name for f in kept]).mapInArrow(work, schema)
