import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import markup, tagging


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, expected", [("<ARG0>", ""), ("</ARG1>", ""), ("<ARG0>Start", "Start"), ("end</ARG0> .", "end .")]
)
def test_strip_markup(spark, text, expected):
    assert one(spark, markup.strip_markup(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, tokens, tags",
    [
        (
            "Hello, <ARG0>this pencil</ARG0> makes me <ARG1>very mad</ARG1>.",
            "Hello, this pencil makes me very mad.",
            "O B-C I-C O O B-E I-E",
        ),
        (
            "<ARG1>This trouble</ARG0> was caused by <ARG0>your carelessness</ARG0>.",
            "This trouble was caused by your carelessness.",
            "B-E I-C O O O B-C I-C",
        ),
        ("no marks here", "no marks here", "O O O"),
        ("", "", "O"),
        ("a  <ARG0>b</ARG0>  c <ARG1>d e</ARG1>", "a  b  c d e", "O O B-C I-C I-C B-E I-E"),
        ("<SIG0>x</SIG0> <ARG0>y <SIG1>z</ARG0> w", "x y z w", "O B-C I-C O"),
    ],
)
def test_marked(spark, text, tokens, tags):
    assert one(spark, tagging.marked_tokens(F.col("t")), t=text) == tokens.split(" ")
    assert one(spark, tagging.marked_tags(F.col("t")), t=text) == tags.split(" ")


def test_strict_closes_one_word_spans(spark):
    text = "<ARG0>rain</ARG0> made us <ARG1>late</ARG1> today"
    assert one(spark, tagging.marked_tags(F.col("t")), t=text) == ["B-C", "I-C", "I-C", "B-E", "I-E"]
    assert one(spark, tagging.marked_tags(F.col("t"), strict=True), t=text) == ["B-C", "O", "O", "B-E", "O"]


def scan_phrases(tokens, cause, effect):
    """Brute force: walk the tokens, prefer the cause, consume whole matches."""
    out, i = [], 0
    while i < len(tokens):
        for phrase, kind in ((cause, "C"), (effect, "E")):
            if phrase and tokens[i : i + len(phrase)] == phrase:
                out += [f"B-{kind}"] + [f"I-{kind}"] * (len(phrase) - 1)
                i += len(phrase)
                break
        else:
            out.append("O")
            i += 1
    return out


def test_phrase_tags_against_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "ab", "\\E", "$1", "\x01b", "(", "", "\x01"]
    rows = []
    for _ in range(300):
        pick = lambda n: [rng.choice(words) for _ in range(n)]
        rows.append((pick(rng.randint(0, 12)), pick(rng.randint(0, 3)), pick(rng.randint(0, 3))))
    frame = spark.createDataFrame(rows, "t array<string>, c array<string>, e array<string>")
    got = frame.select("t", "c", "e", tagging.phrase_tags(F.col("t"), F.col("c"), F.col("e")).alias("g"))
    for row in got.collect():
        assert row.g == scan_phrases(row.t, row.c, row.e), row


def walk_aligned(tagged, tokens):
    """Brute force: consume the tagged string token by token."""
    import re

    out, then = [], "O"
    for token in tokens:
        now = then
        close = re.match(r"</[ce]\d*>", tagged)
        if close:
            now = then = "O"
            tagged = tagged[close.end() :]
        begin = re.match(r"<([ce])\d*>", tagged)
        if begin:
            kind = begin.group(1).upper()
            now, then = f"B-{kind}", f"I-{kind}"
            tagged = tagged[begin.end() :]
        out.append(now)
        tagged = tagged[len(token) :]
    return out


def test_aligned_tags_against_brute_force(spark):
    rng = random.Random(3)
    marks = ["<c>", "</c>", "<e1>", "</e1>", "<e>", "</e>"]
    rows = []
    for _ in range(300):
        tokens = ["".join(rng.choice("日本語ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            tagged = "".join((rng.choice(marks) if rng.random() < 0.4 else "") + t for t in tokens)
            tagged += rng.choice(["", "</c>"])
        else:
            tagged = "".join(ch + (rng.choice(marks) if rng.random() < 0.2 else "") for ch in "".join(tokens))
        if rng.random() < 0.1:
            tokens = tokens[:-1]
        rows.append((tagged, tokens))
    frame = spark.createDataFrame(rows, "x string, t array<string>")
    got = frame.select("x", "t", tagging.aligned_tags(F.col("x"), F.col("t")).alias("g"))
    for row in got.collect():
        assert row.g == walk_aligned(row.x, row.t), row


def test_label_tensors(spark):
    words = F.array(F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(1), F.lit(2), F.lit(None).cast("int"))
    tags = F.split(F.col("t"), " ")
    assert one(spark, tagging.align_labels(words, tags), t="B-C I-E O") == [-100, 1, 1, 2, 0, -100]
    ids = F.array(*[F.lit(i) for i in (5, 6, 7)])
    assert one(spark, tagging.pad_to(ids, F.lit(5), 0), t="") == [5, 6, 7, 0, 0]
    assert one(spark, tagging.pad_to(ids, F.lit(2), 0), t="") == [5, 6]
    assert one(spark, tagging.attention_mask(ids, F.lit(5)), t="") == [1, 1, 1, 0, 0]
    assert one(spark, tagging.attention_mask(ids, F.lit(2)), t="") == [1, 1]
    parts = F.array(ids, F.array(F.lit(8)), ids)
    assert one(spark, tagging.concat_with_sep(parts, 99), t="") == [5, 6, 7, 99, 8, 99, 5, 6, 7]
    scores = F.array(*[F.lit(v) for v in (0.1, 0.7, 0.7)])
    assert one(spark, tagging.argmax_class(scores), t="") == 1


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<c1>因</c1><b1>雨</b1>で<r1>遅れ</r1>", "因<c>雨</c>で<e>遅れ</e>"),
        ("<b1>a</b1><r1>b</r1><b2>c</b2><r2>d</r2>", "<c1>a</c1><e1>b</e1><c2>c</c2><e2>d</e2>"),
        ("<b1>a</b1><b2>c</b2><b4>d</b4>", "<c1>a</c1><c2>c</c2><b4>d</b4>"),
        ("<b2>c</b2><r2>d</r2>", "<b2>c</b2><r2>d</r2>"),
    ],
)
def test_strip_clues(spark, text, expected):
    assert one(spark, markup.strip_clues(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<c>a</c><e>b</e>", False),
        ("<c1>a</c1><e1>b</e1><c2>c</c2><e2>d</e2>", False),
        ("<c1>a<e1>b</e1></c1>", True),
        ("<c1>a</c1><e1>b<c2>c</e1></c2><e2>d</e2>", True),
        ("<c1>a</c1><e1>b</e1><c3>a<e3>b</c3></e3>", False),
        ("<c1>a<e1>b</e1>", None),
    ],
)
def test_has_crossing(spark, text, expected):
    assert one(spark, markup.has_crossing(F.col("t")), t=text) is expected


def test_spans(spark):
    text = "<c1> a </c1> x <c2>b</c3> <e>q\nr</e>"
    assert one(spark, markup.bracketed_spans(F.col("t"), "c"), t=text) == "[a] [b]"
    assert one(spark, markup.bracketed_spans(F.col("t"), "e"), t=text) == ""
    assert one(spark, markup.untag(F.col("t")), t="<c1>a</c1><e>b</e>") == "ab"
    assert one(spark, markup.map_tags(F.col("t"), "e12"), t="<e1>a</e1><e2>b</e2>") == "<c>a</c><e>b</e>"
