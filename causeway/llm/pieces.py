"""A unigram vocabulary as plain data that is shipped to tasks.

Its size is checked, so shipping it with the task is bounded. Text is prepared as the
model says for an identity normalizer: a space becomes U+2581 and one is put in front.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

BLANK = "▁"
MAX_PIECES = 1_000_000
UNKNOWN_MARGIN = 10.0  # an unknown character scores this much below the lowest piece


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores; ids of bytes spell characters that no piece covers."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]  # empty without byte fallback
    unknown_id: int
    spelled: tuple[bytes, ...]  # the bytes that each id stands for
    longest: int = field(default=1)
    unknown_score: float = field(default=0.0)

    @staticmethod
    def make(
        pieces: list[tuple[str, float]], byte_ids: tuple[int, ...], unknown_id: int, ids: list[int], size: int
    ) -> Vocabulary:
        if size > MAX_PIECES:
            raise ValueError(f"{size} pieces; at most {MAX_PIECES} are shipped to tasks")
        spelled = [b""] * size
        spelled[unknown_id] = " ⁇ ".encode()
        for (piece, _), number in zip(pieces, ids, strict=True):
            spelled[number] = piece.replace(BLANK, " ").encode()
        for value, number in enumerate(byte_ids):
            spelled[number] = bytes([value])
        return Vocabulary(
            {p: i for (p, _), i in zip(pieces, ids, strict=True)},
            dict(pieces),
            byte_ids,
            unknown_id,
            tuple(spelled),
            max([1, *(len(p) for p, _ in pieces)]),
            min([0.0, *(s for _, s in pieces)]) - UNKNOWN_MARGIN,
        )

    @staticmethod
    def read(path: str) -> Vocabulary:
        """The pieces of a sentencepiece model file, which the driver reads."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        ordinary = [
            i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        byte_ids = tuple(i for i in range(size) if model.is_byte(i))
        if byte_ids and len(byte_ids) != 256:
            raise ValueError(f"{len(byte_ids)} byte pieces, 256 are needed")
        return Vocabulary.make(
            [(model.id_to_piece(i), model.get_score(i)) for i in ordinary],
            byte_ids,
            model.unk_id(),
            ordinary,
            size,
        )

    @cached_property
    def trie(self) -> dict:
        """Nested dicts by character; a piece's score stands under the empty string."""
        root: dict = {}
        for piece, score in self.scores.items():
            node = root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = score
        return root

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trie"}

    def borders(self) -> str:
        """Of space and line break, those that stand in no piece but at its beginning.

        A best path always breaks in front of such a character if none stands before it.
        """
        found = ""
        if not any(BLANK in p.lstrip(BLANK) for p in self.ids):
            found += " "
        if not any("\n" in p for p in self.ids):
            found += "\n"
        return found

    def spell(self, text: str) -> list[int]:
        """Ids of characters that no piece covers."""
        if not self.byte_ids:
            return [self.unknown_id] * len(text)
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]
