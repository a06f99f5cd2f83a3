"""Token fingerprints of whole texts, computed on byte arrays inside tasks.

A text is scanned as UTF-8 bytes. Every byte has a kind; a token is a longest run of
bytes of one kind, and bytes of kind 0 separate tokens. A token's fingerprint is a mixed
64-bit polynomial of its bytes, so equal tokens always have equal fingerprints.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes that are scanned at once
GROUP = 1 << 19  # bytes of text that are held as tokens at once, one text at least
LARGE = 1 << 22  # bytes from which an array is a mapping of its own, which its end gives back

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_FOLDS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)


@dataclass(frozen=True)
class Alphabet:
    """Kinds of the 256 bytes, and the byte that each counts as."""

    kind: np.ndarray
    fold: np.ndarray


def _alphabet(kinds: dict[int, Iterable[int]], lower: bool) -> Alphabet:
    kind = np.zeros(256, np.uint8)
    for number, members in kinds.items():
        kind[list(members)] = number
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Alphabet(kind, fold)


_LETTERS = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
_BLANKS = [9, 10, 11, 12, 13, 32]
#: Lower-cased runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = _alphabet({1: _LETTERS}, lower=True)
#: Lower-cased runs of anything but ASCII white space.
SOLID = _alphabet({1: [b for b in range(256) if b not in _BLANKS]}, lower=True)
#: Words as written, and runs of punctuation as tokens of their own.
MARKED = _alphabet(
    {1: _LETTERS, 2: [b for b in range(256) if b not in _BLANKS and b not in _LETTERS]}, lower=False
)


@dataclass
class Tokens:
    """Tokens of some texts: fingerprints, byte places in ``data``, and where each text begins."""

    data: bytes
    prints: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # first token of each text, and the number of all tokens
    origins: np.ndarray  # first byte of each text

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _FACTOR, np.uint64)
    down = np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(maxsize=1)
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to keep no large freed blocks; None where it is another one."""
    try:
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(-3, LARGE)  # M_MMAP_THRESHOLD
        return library
    except (OSError, AttributeError):
        return None


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(work: Work) -> Work:
    """A task's work that leaves no memory behind in a worker, which goes on to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _allocator()
        try:
            yield from work(batches)
        finally:
            _powers.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if library is not None:
                library.malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scan(data: bytes, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer(data, np.uint8)
    prints, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(whole):
        stop = min(at + PIECE, len(whole))
        while stop < len(whole):  # cut after a separator; a longer token is taken whole
            gaps = np.flatnonzero(alphabet.kind[whole[at:stop]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(2 * stop - at, len(whole))
        piece = whole[at:stop]
        kind = alphabet.kind[piece]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(piece)]])
        real = kind[first] != 0
        first, last = first[real], last[real]
        up, down = _powers(1 << max(20, (len(piece) - 1).bit_length()))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((alphabet.fold[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        prints.append(mix((total[last] - total[first]) * down[first]))
        starts.append(first + at)
        ends.append(last + at)
        at = stop
    return np.concatenate(prints), np.concatenate(starts), np.concatenate(ends)


def tokens_of(texts: list[str | None], alphabet: Alphabet) -> Tokens:
    """Tokens of all texts; a null text has none."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    origins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    prints, starts, ends = _scan(data, alphabet)
    return Tokens(data, prints, starts, ends, np.searchsorted(starts, origins), origins[:-1])


def grouped(texts: list[str | None], size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += 1 if text is None else len(text)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingles(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``width`` tokens and the text of each.

    A text with fewer tokens, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(tokens.bounds)
    last = np.repeat(tokens.bounds[1:], count)
    start = np.flatnonzero(np.arange(len(tokens.prints)) + width <= last)
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total = mix(total + tokens.prints[start + k] * _FOLDS[k % len(_FOLDS)])
    owner = tokens.owner()[start]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for text in short:
            value = np.array([count[text]], np.uint64)
            for p in tokens.prints[tokens.bounds[text] : tokens.bounds[text + 1]]:
                value = mix(value * _FOLDS[0] + p)
            extra.append(value[0])
        total = np.concatenate([total, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
    return total, owner


def distinct_sets(tokens: Tokens, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles."""
    value, owner = shingles(tokens, width)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(tokens.bounds)))
    value = value[order]
    return [np.unique(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
