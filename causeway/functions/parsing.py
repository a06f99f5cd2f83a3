"""Read model responses: class labels, span lines, per-word tags, set overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, strip

# What marks a class, and what a response without one counts as.
CLASS_PATTERN = "N([0-9]+)"
NO_CLASS = "-1"
CAUSE_LINE, EFFECT_LINE = "Causes:", "Effects:"


def parse_class(output: Column) -> Column:
    """First class number ``N<digits>`` of a response, or ``-1``, also where there is no response."""
    found = F.regexp_extract(output, CLASS_PATTERN, 1)
    return F.when(found == "", NO_CLASS).otherwise(F.coalesce(found, F.lit(NO_CLASS)))


def unwrap(text: Column) -> Column:
    """Contents of all ``[...]`` joined by blanks; the text itself if there are none."""
    return let(
        F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)),
        lambda inner: F.when(F.size(inner) == 0, text).otherwise(F.array_join(inner, " ")),
    )


def response_spans(output: Column, line_mark: str) -> Column:
    """Text behind the last line carrying ``Causes:`` or ``Effects:``, '' without one.

    A line that carries both counts as a cause line only.
    """

    def is_ours(line: Column) -> Column:
        hit = line.contains(line_mark)
        return hit & ~line.contains(CAUSE_LINE) if line_mark == EFFECT_LINE else hit

    return let(
        F.filter(F.split(output, "\n"), is_ours),
        lambda lines: F.coalesce(
            F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(line_mark), F.lit("")), F.lit("")
        ),
    )


def word_response(output: Column, tokens: Column, header: str, separator: str) -> Column:
    """Tag predicted for each token by a response with one ``token: tag`` per line.

    Line i belongs to token i. Lines past the last token are dropped and missing
    lines give ''.
    """
    return let(
        F.split(F.replace(output, F.lit(header), F.lit("")), "\n"),
        lambda lines: F.transform(
            tokens,
            lambda token, i: F.coalesce(
                F.replace(F.get(lines, i), F.concat(token, F.lit(separator)), F.lit("")), F.lit("")
            ),
        ),
    )


Tokenizer = Callable[[Column], Column]


def blank_tokens(text: Column) -> Column:
    """Split on single blanks; the empty string gives one empty token."""
    return F.split(text, " ")


def span_overlap(truth: Column, guess: Column, tokenizer: Tokenizer = blank_tokens) -> Column:
    """Precision, recall and F1 between two spans taken as token sets.

    Pass another tokenizer (any column expression, or a pandas UDF) for text
    that is not split on blanks. Two empty sets score 1, no common token 0.
    """

    def score(sets: Column) -> Column:
        common = F.size(F.array_intersect(sets["truth"], sets["guess"])).cast("double")
        n_truth, n_guess = F.size(sets["truth"]), F.size(sets["guess"])

        def ratio(value: Column) -> Column:
            return F.when((n_truth == 0) & (n_guess == 0), 1.0).when(common == 0, 0.0).otherwise(value)

        return F.struct(
            ratio(common / n_guess).alias("precision"),
            ratio(common / n_truth).alias("recall"),
            ratio(2 * common / (n_truth + n_guess)).alias("f1"),
        )

    sets = F.struct(
        F.array_distinct(tokenizer(truth)).alias("truth"),
        F.array_distinct(tokenizer(guess)).alias("guess"),
    )
    return let(sets, score)


def same_span(truth: Column, guess: Column) -> Column:
    """Equality of two spans without their outer white space."""
    return strip(truth) == strip(guess)


def sentence_count(text: Column, locale_aware: bool = False) -> Column:
    """Number of sentences in a text.

    By default a sentence ends at a run of ``.``, ``!`` or ``?`` before white
    space or the end; ``locale_aware`` uses Spark's own sentence splitter.
    """
    if locale_aware:
        return F.size(F.sentences(text))
    pieces = F.split(strip(text), r"(?<=[.!?])\s+")
    return F.size(F.filter(pieces, lambda piece: piece != ""))
