"""Span markup: clean, translate between tag dialects, extract and check spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import first_gap, let, strip

# Tag spellings of each corpus dialect and the canonical tag they become.
DIALECTS: dict[str, dict[str, str]] = {
    "arg": {"<ARG0>": "<c>", "</ARG0>": "</c>", "<ARG1>": "<e>", "</ARG1>": "</e>"},
    "e12": {"<e1>": "<c>", "</e1>": "</c>", "<e2>": "<e>", "</e2>": "</e>"},
    "br": {"<b1>": "<c>", "</b1>": "</c>", "<r1>": "<e>", "</r1>": "</e>"},
}

UPPER_TAG = r"</*[A-Z]+[0-9]*>"
CLUE_TAG = r"</?c[0-9]>"
SPAN_TAG = r"</?(c|e)[0-9]*>"


def strip_markup(text: Column) -> Column:
    """Remove every upper-case tag such as ``<SIG0>`` or ``</ARG1>``."""
    return F.regexp_replace(text, UPPER_TAG, "")


def untag(text: Column) -> Column:
    """Remove cause and effect tags, numbered or not."""
    return F.regexp_replace(text, SPAN_TAG, "")


def map_tags(text: Column, dialect: str) -> Column:
    """Rewrite one dialect's tags as ``<c>``/``<e>``."""
    return reduce(
        lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])),
        DIALECTS[dialect].items(),
        text,
    )


def relation_count(text: Column, letter: str = "c") -> Column:
    """How many relations are numbered 1, 2, ... without a gap."""
    return first_gap(F.regexp_extract_all(text, F.lit(f"<{letter}([0-9]+)>"), F.lit(1)))


def strip_clues(text: Column) -> Column:
    """Drop clue tags, then turn ``<bN>``/``<rN>`` into cause and effect tags.

    Tags keep their number only when a second relation is present. Numbering is
    followed up to its first gap; tags past the gap stay as they are.
    """

    def renumber(bare: Column) -> Column:
        def one(out: Column, i: Column) -> Column:
            n = i.cast("string")
            for old, new in (("b", "c"), ("r", "e")):
                for slash in ("", "/"):
                    out = F.replace(
                        out,
                        F.concat(F.lit(f"<{slash}{old}"), n, F.lit(">")),
                        F.concat(F.lit(f"<{slash}{new}"), n, F.lit(">")),
                    )
            return out

        numbered = let(
            relation_count(bare, "b"),
            lambda count: F.when(count == 0, bare).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), bare, one)
            ),
        )
        return F.when(bare.contains("<b2>"), numbered).otherwise(map_tags(bare, "br"))

    stripped = let(F.regexp_replace(text, CLUE_TAG, ""), renumber)
    return F.when(~text.contains("<"), text).otherwise(stripped)


def spans_of(text: Column, letter: str) -> Column:
    """All spans of one kind, trimmed, in text order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"(?d)<{letter}[0-9]*>(.*?)</{letter}[0-9]*>"), F.lit(1)),
        strip,
    )


def bracketed_spans(text: Column, letter: str) -> Column:
    """Spans of one kind written as ``[a] [b]``; the empty string if there is none."""
    return F.array_join(
        F.transform(spans_of(text, letter), lambda s: F.concat(F.lit("["), s, F.lit("]"))), " "
    )


def numbered_span(text: Column, letter: str, number: Column) -> Column:
    """First span numbered ``number`` (pass '' for plain tags); NULL if absent."""
    pattern = F.concat(
        F.lit(f"(?d)<{letter}"), number, F.lit(f">(.*?)</{letter}"), number, F.lit(">")
    )
    return F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(1))


def spans_by_number(text: Column, letter: str, count: Column) -> Column:
    """First spans numbered 1 to ``count``, in this order, NULL where one is absent.

    One scan with a fixed pattern finds all spans, nested ones too: what follows an opening tag is
    only looked at, so the scan goes on right behind the tag.
    """
    pattern = F.lit(rf"(?d)<{letter}([1-9][0-9]{{0,8}})>(?=(.*?)</{letter}\1>)")
    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("numbers"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("spans"),
    )

    def entry(n: Column, at: Column, span: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), at.cast("int").alias("at"), span.alias("span"))

    def ordered(parts: Column) -> Column:
        found = F.transform(parts["numbers"], lambda n, i: entry(n, i, F.get(parts["spans"], i)))
        # A last entry for every number, so that none is missing.
        gaps = F.transform(F.sequence(F.lit(1), count), lambda n: entry(n, F.size(parts["numbers"]), F.lit(None).cast("string")))
        return F.array_sort(F.concat(F.filter(found, lambda e: e["n"] <= count), gaps))

    def firsts(entries: Column) -> Column:
        kept = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["n"] != e["n"]))
        return F.transform(kept, lambda e: e["span"])

    return F.when(count > 0, let(let(parts, ordered), firsts)).otherwise(F.array().cast("array<string>"))


def has_crossing(text: Column) -> Column:
    """Whether any two numbered spans overlap; NULL if a span is malformed.

    Spans sorted by start overlap somewhere exactly when two neighbours overlap,
    so no span pairs are formed.
    """

    def bounds(letter: str, i: Column, text: Column) -> Column:
        n = i.cast("string")
        return F.struct(
            F.position(F.concat(F.lit(f"<{letter}"), n, F.lit(">")), text).alias("start"),
            F.position(F.concat(F.lit(f"</{letter}"), n, F.lit(">")), text).alias("stop"),
        )

    def check(count: Column, text: Column) -> Column:
        spans = F.array_sort(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                    lambda i: F.array(bounds("c", i, text), bounds("e", i, text)),
                )
            )
        )
        return F.when(count == 0, F.lit(False)).otherwise(let(spans, neighbours_overlap))

    def neighbours_overlap(spans: Column) -> Column:
        malformed = F.exists(spans, lambda s: s["start"] >= s["stop"])
        overlap = F.exists(
            F.sequence(F.lit(1), F.size(spans) - 1),
            lambda i: F.get(spans, i)["start"] <= F.get(spans, i - 1)["stop"],
        )
        return F.when(~malformed, overlap)

    checked = let(text, lambda t: let(relation_count(t), lambda count: check(count, t)))
    return F.when(~text.contains("<c1>"), False).otherwise(checked)
