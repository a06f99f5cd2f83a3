"""BIO tagging and label tensors as column expressions over arrays.

Every tagger is linear in the length of the text: runs of equal tags are built
with ``array_repeat`` and flattened, never appended one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let
from .markup import SPAN_TAG, strip_markup, untag

# The tag set and its label ids.
TAGS = ("O", "I-C", "I-E", "B-C", "B-E")
OPEN_CAUSE, CLOSE_CAUSE, OPEN_EFFECT, CLOSE_EFFECT = "<ARG0>", "</ARG0>", "<ARG1>", "</ARG1>"
IGNORED_LABEL = -100


def _run(first: Column, rest: Column, length: Column) -> Column:
    return F.concat(F.array(first), F.array_repeat(rest, length - 1))


def marked_tokens(marked: Column) -> Column:
    """Tokens of a marked-up sentence, split on single blanks, markup removed.

    Empty tokens from doubled blanks are kept; they receive tags like any other.
    """

    def clean(token: Column) -> Column:
        own = F.when(token.contains(OPEN_CAUSE), F.replace(token, F.lit(OPEN_CAUSE), F.lit("")))
        for marker in (CLOSE_CAUSE, OPEN_EFFECT, CLOSE_EFFECT):
            own = own.when(token.contains(marker), F.replace(token, F.lit(marker), F.lit("")))
        return F.when(~token.contains("<"), token).otherwise(strip_markup(own.otherwise(token)))

    return F.transform(F.split(marked, " "), clean)


def marked_tags(marked: Column, strict: bool = False) -> Column:
    """BIO tags of a marked-up sentence.

    A token is judged by the first marker it holds in the order open cause,
    close cause, open effect, close effect. So a one-word span counts as opened
    only, and ``I-`` runs on to the next marker; ``strict=True`` closes it.
    """

    markers = (OPEN_CAUSE, CLOSE_CAUSE, OPEN_EFFECT, CLOSE_EFFECT)

    def holds(token: Column) -> Column:
        hit = token.contains(markers[0])
        for marker in markers[1:]:
            hit = hit | token.contains(marker)
        return token.contains("<") & hit

    def judge(place: Column) -> Column:
        token = place["token"]
        opens_cause, closes_cause = token.contains(OPEN_CAUSE), token.contains(CLOSE_CAUSE)
        opens_effect, closes_effect = token.contains(OPEN_EFFECT), token.contains(CLOSE_EFFECT)
        after_cause = F.when(closes_cause, "O").otherwise("I-C") if strict else F.lit("I-C")
        after_effect = F.when(closes_effect, "O").otherwise("I-E") if strict else F.lit("I-E")
        return F.struct(
            place["at"].alias("at"),
            F.when(opens_cause, "B-C")
            .when(closes_cause, "I-C")
            .when(opens_effect, "B-E")
            .otherwise("I-E")
            .alias("tag"),
            F.when(opens_cause, after_cause)
            .when(closes_cause, "O")
            .when(opens_effect, after_effect)
            .otherwise("O")
            .alias("then"),
        )

    def tags(tokens: Column) -> Column:
        places = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("token")))
        found = F.transform(F.filter(places, lambda p: holds(p["token"])), judge)
        return let(found, lambda marks: runs(marks, F.size(tokens)))

    def runs(found: Column, n: Column) -> Column:
        lead = F.array_repeat(F.lit("O"), F.coalesce(F.get(found, F.lit(0))["at"], n))
        return F.concat(
            lead,
            F.flatten(
                F.transform(
                    found,
                    lambda m, j: _run(
                        m["tag"], m["then"], F.coalesce(F.get(found, j + 1)["at"], n) - m["at"]
                    ),
                )
            ),
        )

    return let(F.split(marked, " "), tags)


def _phrase_hits(row: Column) -> Column:
    """Places at which a phrase stands, with its kind and length; the cause if both do."""
    tokens = row["tokens"]

    def length_at(i: Column, phrase: Column) -> Column:
        n = F.size(phrase)
        # The ends first: most places are out by one comparison, and nothing is copied for them.
        ends = (F.get(tokens, i) == F.get(phrase, F.lit(0))) & (F.get(tokens, i + n - 1) == F.get(phrase, n - 1))
        return F.when(ends, F.when(F.slice(tokens, i + 1, n) == phrase, n))

    def hit(i: Column) -> Column:
        return F.struct(
            i.alias("at"), length_at(i, row["cause"]).alias("cause"), length_at(i, row["effect"]).alias("effect")
        )

    first = lambda phrase: F.get(phrase, F.lit(0))
    places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
    near = F.filter(places, lambda i: F.get(tokens, i).isin(first(row["cause"]), first(row["effect"])))
    found = F.filter(F.transform(near, hit), lambda h: h["cause"].isNotNull() | h["effect"].isNotNull())
    return F.transform(
        found,
        lambda h: F.struct(
            h["at"].alias("at"),
            F.when(h["cause"].isNotNull(), "C").otherwise("E").alias("kind"),
            F.coalesce(h["cause"], h["effect"]).alias("length"),
        ),
    )


def phrase_tags(tokens: Column, cause: Column, effect: Column) -> Column:
    """BIO tags from a left-to-right scan for the cause phrase, then the effect phrase.

    All three arguments are token arrays. At each position the cause is tried first, and a
    match is consumed whole. A null or empty phrase stands nowhere. Phrases are compared as
    arrays at the places where their first and last tokens stand.
    """
    nothing = F.array().cast("array<struct<at: int, kind: string, length: int>>")

    def pick(state: Column, hit: Column) -> Column:
        taken = F.struct(
            (hit["at"] + hit["length"]).alias("free"), F.concat(state["picks"], F.array(hit)).alias("picks")
        )
        return F.when(hit["at"] >= state["free"], taken).otherwise(state)

    def tags(row: Column) -> Column:
        start = F.struct(F.lit(0).alias("free"), nothing.alias("picks"))
        picked = F.aggregate(_phrase_hits(row), start, pick, lambda state: state["picks"])
        return let(F.struct(picked.alias("picks"), F.size(row["tokens"]).alias("n")), lambda r: runs(r["picks"], r["n"]))

    def end(hit: Column) -> Column:
        return F.coalesce(hit["at"] + hit["length"], F.lit(0))

    def runs(picks: Column, n: Column) -> Column:
        outside = lambda length: F.array_repeat(F.lit("O"), length)
        named = F.transform(
            picks,
            lambda p, j: F.concat(
                outside(p["at"] - end(F.get(picks, j - 1))),
                _run(F.concat(F.lit("B-"), p["kind"]), F.concat(F.lit("I-"), p["kind"]), p["length"]),
            ),
        )
        return F.concat(F.flatten(named), outside(n - end(F.get(picks, F.size(picks) - 1))))

    return let(F.struct(tokens.alias("tokens"), cause.alias("cause"), effect.alias("effect")), tags)


# What a tag does, as the last digit of its code; the rest of the code is its length.
_CLOSES, _OPENS_CAUSE, _OPENS_EFFECT = 1, 2, 3
# Tokens that are tagged before their tags are put behind those of earlier blocks.
_BLOCK = 64


def aligned_tags(tagged: Column, tokens: Column) -> Column:
    """BIO tags for tokens of an unspaced text, read off the tagged string.

    Each token takes its tag from the tags that stand right before it. When the
    tokens add up to the text and tags sit only between tokens, segment numbers
    per character give the answer. Other rows (nested tags, dropped blanks) take a merge:
    a place in the tagged string moves over tokens and tags, whose offsets are known, so
    no rest of the text is copied. Both are linear in the text. Rows without tags, and segments
    whose tokens are single characters, take runs of equal tags and no step per character.
    """
    row = F.struct(tagged.alias("tagged"), tokens.alias("tokens"))
    plain = F.array_repeat(F.lit("O"), F.size(tokens))
    return F.when(~tagged.contains("<") & tokens.isNotNull(), plain).otherwise(
        let(row, lambda r: _aligned(r["tagged"], r["tokens"]))
    )


def _aligned(tagged: Column, tokens: Column) -> Column:
    def opened_kinds() -> Column:
        # Segment j lies behind the j-th tag; what that tag opens is its kind.
        opened = F.transform(
            F.regexp_extract_all(tagged, F.lit(f"({SPAN_TAG})"), F.lit(1)),
            lambda mark: F.when(mark.startswith("<c"), "C").when(mark.startswith("<e"), "E").otherwise("O"),
        )
        return F.concat(F.array(F.lit("O")), opened)

    def by_run(segments: Column) -> Column:
        def run(segment: Column, kind: Column) -> Column:
            inside = _run(F.concat(F.lit("B-"), kind), F.concat(F.lit("I-"), kind), F.length(segment))
            plain = F.array_repeat(F.lit("O"), F.length(segment))
            return F.when((kind == "O") | (segment == ""), plain).otherwise(inside)

        return let(opened_kinds(), lambda kinds: F.flatten(F.transform(segments, lambda s, j: run(s, F.get(kinds, j)))))

    def by_segment(segments: Column) -> Column:
        chars = F.struct(
            opened_kinds().alias("kinds"),
            F.flatten(F.transform(segments, lambda s, j: F.array_repeat(j, F.length(s)))).alias("seg"),
            F.flatten(F.transform(tokens, lambda t, i: F.array_repeat(i, F.length(t)))).alias("tok"),
            F.size(F.filter(segments, lambda s: s != "")).alias("filled"),
        )
        return let(chars, by_char)

    def by_char(chars: Column) -> Column:
        seg, tok, kinds = chars["seg"], chars["tok"], chars["kinds"]

        def enters(i: Column) -> Column:
            return (i == 0) | (F.get(seg, i) != F.get(seg, i - 1))

        def tag(i: Column) -> Column:
            kind = F.get(kinds, F.get(seg, i))
            return F.when(kind == "O", "O").otherwise(
                F.concat(F.when(enters(i), "B-").otherwise("I-"), kind)
            )

        def finish(heads: Column) -> Column:
            # Each filled segment must begin at a token, or a tag cuts one.
            whole = F.size(F.filter(heads, enters)) == chars["filled"]
            return F.when(whole, F.transform(heads, tag)).otherwise(by_scan())

        heads = F.filter(
            F.sequence(F.lit(0), F.size(tok) - 1),
            lambda i: (i == 0) | (F.get(tok, i) != F.get(tok, i - 1)),
        )
        return F.when(F.size(tok) == 0, F.array().cast("array<string>")).otherwise(let(heads, finish))

    def by_scan() -> Column:
        def code(mark: Column) -> Column:
            act = F.when(mark.startswith("</"), _CLOSES).when(mark.startswith("<c"), _OPENS_CAUSE).otherwise(_OPENS_EFFECT)
            return F.length(mark) * 10 + act

        def codes(parts: Column) -> Column:
            # The code of a tag at its first character, 0 at every other one.
            blank = lambda length: F.array_repeat(F.lit(0), length)
            behind = F.transform(
                parts["marks"],
                lambda mark, j: F.concat(
                    F.array(code(mark)), blank(F.length(mark) - 1), blank(F.length(F.get(parts["segments"], j + 1)))
                ),
            )
            return F.concat(blank(F.length(F.get(parts["segments"], F.lit(0)))), F.flatten(behind))

        parts = F.struct(
            F.split(tagged, SPAN_TAG).alias("segments"),
            F.regexp_extract_all(tagged, F.lit(f"({SPAN_TAG})"), F.lit(1)).alias("marks"),
        )
        lengths = F.transform(tokens, F.length)
        both = F.struct(let(parts, codes).alias("codes"), lengths.alias("lengths"))
        return let(both, lambda r: merged(r["codes"], r["lengths"]))

    def merged(codes: Column, lengths: Column) -> Column:
        def step(state: Column, length: Column) -> Column:
            first = F.coalesce(F.get(codes, state["at"]), F.lit(0))
            return let(F.struct(state.alias("s"), first.alias("first")), lambda r: close(r["s"], r["first"], length))

        def close(state: Column, first: Column, length: Column) -> Column:
            closed = first % 10 == _CLOSES
            at = state["at"] + F.when(closed, F.floor(first / 10).cast("int")).otherwise(0)
            carried = F.when(closed, "O").otherwise(state["then"])
            after = F.struct(
                at.alias("at"), F.coalesce(F.get(codes, at), F.lit(0)).alias("next"), carried.alias("then"),
                state["tags"].alias("tags"),
            )
            return let(after, lambda r: enter(r, length))

        def enter(after: Column, length: Column) -> Column:
            act = after["next"] % 10
            opened = act.isin(_OPENS_CAUSE, _OPENS_EFFECT)
            skipped = F.when(opened, F.floor(after["next"] / 10).cast("int")).otherwise(0)
            kind = F.when(act == _OPENS_CAUSE, "C").otherwise("E")
            return F.struct(
                (after["at"] + skipped + length).alias("at"),
                F.when(opened, F.concat(F.lit("I-"), kind)).otherwise(after["then"]).alias("then"),
                F.concat(
                    after["tags"], F.array(F.when(opened, F.concat(F.lit("B-"), kind)).otherwise(after["then"]))
                ).alias("tags"),
            )

        none = F.array().cast("array<string>")

        def block(state: Column, first: Column) -> Column:
            start = F.struct(state["at"].alias("at"), state["then"].alias("then"), none.alias("tags"))
            return let(
                F.aggregate(F.slice(lengths, first + 1, F.lit(_BLOCK)), start, step),
                lambda done: F.struct(
                    done["at"].alias("at"),
                    done["then"].alias("then"),
                    F.concat(state["blocks"], F.array(done["tags"])).alias("blocks"),
                ),
            )

        start = F.struct(F.lit(0).alias("at"), F.lit("O").alias("then"), F.array().cast("array<array<string>>").alias("blocks"))
        firsts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_BLOCK))
        return F.flatten(F.aggregate(firsts, start, block, lambda state: state["blocks"]))

    simple = (
        (F.array_join(tokens, "") == untag(tagged))
        & ~F.array_contains(tokens, "")
        & ~tagged.rlike("<[ce][0-9]*></?[ce][0-9]*>|</[ce][0-9]*></[ce][0-9]*>")
    )
    segments = F.split(tagged, SPAN_TAG)
    single = F.size(tokens) == F.length(F.array_join(tokens, ""))
    return F.when(simple & single, let(segments, by_run)).when(simple, let(segments, by_segment)).otherwise(by_scan())


def align_labels(word_ids: Column, tags: Column) -> Column:
    """Label id of each sub-word: its word's tag with ``B-`` read as ``I-``.

    Sub-words without a word (special tokens) get the ignored label.
    """

    def label(word: Column) -> Column:
        tag = F.get(tags, word)
        return (
            F.when(word.isNull(), IGNORED_LABEL)
            .when(tag == "O", 0)
            .when(tag.isin("I-C", "B-C"), 1)
            .when(tag.isin("I-E", "B-E"), 2)
        )

    return F.transform(word_ids, label)


def pad_to(ids: Column, length: Column, pad: int) -> Column:
    """Cut or fill an int array to ``length``."""
    kept = F.slice(ids, F.lit(1), length)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))


def cut_body(ids: Column, length: Column, ends: int = 1) -> Column:
    """An array cut to ``length`` in front of its last ``ends`` elements, the special tokens there."""
    return F.when(F.size(ids) <= length, ids).otherwise(
        F.concat(F.slice(ids, F.lit(1), F.greatest(length - ends, F.lit(0))), F.slice(ids, F.lit(-ends), F.lit(ends)))
    )


def attention_mask(ids: Column, length: Column) -> Column:
    """1 for each real id, 0 for padding."""
    kept = F.least(F.size(ids), length)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), length - kept))


def concat_with_sep(parts: Column, separator: int) -> Column:
    """Join an array of int arrays with a separator id between neighbours."""
    return F.flatten(
        F.transform(
            parts,
            lambda part, i: F.when(i == 0, part).otherwise(
                F.concat(F.array(F.lit(separator)), part)
            ),
        )
    )


def argmax_class(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
