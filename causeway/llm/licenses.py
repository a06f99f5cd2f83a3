"""License scans: notices as token automata compiled from template markup.

A template is words with regions marked in angle brackets:

``<<beginOptional>> ... <<endOptional>>``   may be left out; such regions may be nested
``<<var;match="a|b">>``                     one of the words
``<<var;words="0-4">>``                     any words, in a number within the limits

Everything else is mandatory wording and has to match word by word. An automaton's states
stand in a row, a word leads from a state to the next one, and a region that may be left
out is an edge without a word. A set of states is one integer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from causeway.llm.text import ALNUM, Tokens, grouped, tokens_of

# Phrases that make a base label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license notices as templates, with their labels.
TEMPLATES = [
    (
        "mit",
        '<<var;match="released|licensed|distributed|available|provided">> under the <<beginOptional>>terms of the'
        "<<endOptional>> mit <<beginOptional>>open source<<endOptional>> license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction",
    ),
    (
        "apache-2",
        '<<var;match="released|licensed|distributed">> under the <<beginOptional>>terms of the<<endOptional>> apache'
        " license version 2 0 <<beginOptional>>the license you may not use this <<var;words=\"1-2\">> except in compliance"
        " with the license<<endOptional>>",
    ),
    (
        "gpl-3",
        '<<beginOptional>>this <<var;match="work|program|software|file|library">> is <<endOptional>>licensed under the'
        " <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the"
        " free software foundation <<beginOptional>>either<<endOptional>> <<endOptional>>version 3"
        " <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>>"
        " any later version<<endOptional>>",
    ),
    (
        "cc-by-nc",
        "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by nc 4 0"
        " <<beginOptional>>license<<endOptional>>",
    ),
    (
        "cc-by-nc",
        'licensed under <<var;match="a|the">> creative commons attribution noncommercial 4 0 <<beginOptional>>international'
        "<<endOptional>> license",
    ),
    ("cc-by", "licensed under <<beginOptional>>the <<endOptional>>cc by 4 0 <<beginOptional>>license<<endOptional>>"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ),
    ("mpl-2", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
]

_MARK = re.compile(r'<<(beginOptional|endOptional|var;match="[^"]*"|var;words="\d+-\d+")>>')


@dataclass
class Automaton:
    """States in a row: ``words[i]`` lead from state i to i + 1, None means any word."""

    words: list[frozenset[str] | None] = field(default_factory=list)
    skips: list[tuple[int, int]] = field(default_factory=list)  # edges without a word, forward only

    @staticmethod
    def compile(template: str) -> Automaton:
        built, opened, at = Automaton(), [], 0
        for mark in [*_MARK.finditer(template), None]:
            plain = template[at : mark.start() if mark else len(template)]
            if "<<" in plain or ">>" in plain:
                raise ValueError(f"unknown markup in {plain!r}")
            built.words += [frozenset([w]) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower())]
            if mark is None:
                break
            at, said = mark.end(), mark[1]
            if said == "beginOptional":
                opened.append(len(built.words))
            elif said == "endOptional":
                if not opened:
                    raise ValueError("endOptional without a beginning")
                built.skips.append((opened.pop(), len(built.words)))
            elif said.startswith("var;match"):
                built.words.append(frozenset(said.split('"')[1].lower().split("|")))
            else:
                least, most = map(int, said.split('"')[1].split("-"))
                start = len(built.words)
                built.words += [None] * most
                built.skips += [(start + k, start + most) for k in range(least, most)]
        if opened:
            raise ValueError("beginOptional without an end")
        built.skips.sort()
        begin = built.close(1)
        if begin >> len(built.words) & 1:
            raise ValueError("a template needs mandatory wording")
        if any(w is None and begin >> i & 1 for i, w in enumerate(built.words)):
            raise ValueError("a template can't begin with any word")
        return built

    def close(self, states: int) -> int:
        """All states that edges without a word lead to."""
        for start, end in self.skips:
            if states >> start & 1:
                states |= 1 << end
        return states


class Scanner:
    """All templates and phrases over one vocabulary of words; 0 stands for any other word."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        automata = [(label, Automaton.compile(text)) for label, text in templates]
        split = {phrase: phrase.split(" ") for phrase in phrases}
        words = sorted({w for p in split.values() for w in p} | {w for _, a in automata for s in a.words if s for w in s})
        prints = tokens_of([" ".join(words)], ALNUM).prints
        if len(prints) != len(words):
            raise ValueError("a word of a phrase or template is not one token")
        self.order = np.argsort(prints)
        self.prints = prints[self.order]
        number = {w: i + 1 for i, w in enumerate(words)}
        self.phrases = [(np.array([number[w] for w in ws]), phrases[p]) for p, ws in split.items()]
        self.automata = []
        for label, a in automata:
            steps = [0] * (len(words) + 1)  # states that a word leads out of
            for state, allowed in enumerate(a.words):
                for w in range(len(steps)) if allowed is None else [number[w] for w in allowed]:
                    steps[w] |= 1 << state
            begin = a.close(1)
            # the first two words decide for most places that nothing matches
            pairs = np.zeros((len(steps), len(steps)), bool)
            for one, states in enumerate(steps):
                after = a.close((begin & states) << 1)
                if begin & states:
                    pairs[one] = [bool(after & s) or bool(after >> len(a.words) & 1) for s in steps]
            self.automata.append((label, a, steps, begin, pairs))

    def symbols(self, tokens: Tokens) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(tokens.prints), np.int64)
        place = np.minimum(np.searchsorted(self.prints, tokens.prints), len(self.prints) - 1)
        return np.where(self.prints[place] == tokens.prints, self.order[place] + 1, 0)

    def base_places(self, symbols: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """First word, end and label of each place of a phrase."""
        for words, label in self.phrases:
            start = np.flatnonzero(symbols == words[0])
            start = start[start + len(words) <= last[start]]
            for k in range(1, len(words)):
                start = start[symbols[start + k] == words[k]]
            for s in start.tolist():
                yield s, s + len(words), label

    def template_places(self, symbols: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """First word, end and label of the longest match from each word."""
        follow = np.zeros(len(symbols), np.int64)
        follow[:-1] = symbols[1:]
        alone = np.arange(len(symbols)) + 1 >= last
        for label, automaton, steps, begin, pairs in self.automata:
            final = len(automaton.words)
            some = pairs.any(axis=1)
            for start in np.flatnonzero(np.where(alone, some[symbols], pairs[symbols, follow])).tolist():
                states, end = begin, None
                for at in range(start, int(last[start])):
                    states &= steps[symbols[at]]
                    if not states:
                        break
                    states = automaton.close(states << 1)
                    if states >> final & 1:
                        end = at + 1
                if end is not None:
                    yield start, end, label


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] = BASE_PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Every row with the license wording of its whole text.

    Added are ``n_words``; ``n_base``, the number of all places where a phrase stands;
    ``first_word`` and ``last_word``, the smallest and largest first word of these (else
    null); ``base_labels`` and ``labels`` (the phrases' and, in the second, also the
    templates' labels, distinct, sorted, joined by commas); ``score``, the share of all
    words that stand in a phrase or template. They replace columns of the same names. A
    null text counts as an empty one: no words, no labels, score 0. Nothing is shuffled.
    """
    added = [
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", StringType()),
        StructField("labels", StringType()),
        StructField("score", DoubleType()),
    ]
    schema = StructType([*[f for f in docs.schema.fields if f.name not in {a.name for a in added}], *added])
    kept = [f.name for f in schema.fields[: -len(added)]]
    place = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            whole = batch.column(place).to_pylist()
            for first, last in grouped(whole):
                found = pa.RecordBatch.from_pylist(
                    list(_rows(scanner, tokens_of(whole[first:last], ALNUM))),
                    pa.schema([(a.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[a.dataType.simpleString()]) for a in added]),
                )
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, *found.columns], names=schema.names)

    return docs.select(*kept).mapInArrow(work, schema)


def _rows(scanner: Scanner, tokens: Tokens) -> Iterator[dict]:
    symbols = scanner.symbols(tokens)
    last = np.repeat(tokens.bounds[1:], np.diff(tokens.bounds))
    base: dict[int, list] = {}
    every: dict[int, list] = {}
    owner = tokens.owner()
    for place in scanner.base_places(symbols, last):
        base.setdefault(int(owner[place[0]]), []).append(place)
    for place in scanner.template_places(symbols, last):
        every.setdefault(int(owner[place[0]]), []).append(place)
    for text, words in enumerate(np.diff(tokens.bounds).tolist()):
        own, origin = base.get(text, []), int(tokens.bounds[text])
        places = own + every.get(text, [])
        covered, at = 0, origin
        for start, end, _ in sorted(places):
            covered += max(0, end - max(start, at))
            at = max(at, end)
        yield {
            "n_words": words,
            "n_base": len(own),
            "first_word": min(p[0] for p in own) - origin if own else None,
            "last_word": max(p[0] for p in own) - origin if own else None,
            "base_labels": ",".join(sorted({p[2] for p in own})),
            "labels": ",".join(sorted({p[2] for p in places})),
            "score": covered / words if words else 0.0,
        }
