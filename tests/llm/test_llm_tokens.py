"""Encoding, decoding and counting against a library, brute force and each other."""

import os
import random

import pytest
from pyspark.sql import functions as F

from causeway.llm import counts, encode
from causeway.llm.pieces import BLANK, Vocabulary

PATH = "/opt/tokenizers/piece_bpe_32k.model"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


def small(pieces, spelled=False):
    """A vocabulary of (piece, score); ids from 1, and from 1000 for bytes."""
    byte_ids = tuple(range(1000, 1256)) if spelled else ()
    return Vocabulary.make(pieces, byte_ids, 0, list(range(1, len(pieces) + 1)), 1256 if spelled else len(pieces) + 1)


def slow_path(text, vocabulary):
    """The whole table at once: best sums, the longest last piece at a tie."""
    sums, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = [(sums[s] + vocabulary.scores[text[s:end]], s) for s in range(end) if text[s:end] in vocabulary.scores]
        if text[end - 1] not in vocabulary.scores:
            options.append((sums[end - 1] + vocabulary.unknown_score, end - 1))
        best = max(o[0] for o in options)
        sums.append(best)
        back.append(min(s for o, s in options if o == best))
    found, end = [], len(text)
    while end:
        found.append((back[end], end))
        end = back[end]
    return found[::-1]


@pytest.mark.parametrize("span", [1, 3, 128])
def test_streaming_search_is_the_whole_search(monkeypatch, span):
    monkeypatch.setattr(encode, "SPAN", span)
    rng = random.Random(span)
    for _ in range(300):
        words = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 5))) for _ in range(8)}
        vocabulary = small([(w, float(-rng.randint(1, 4))) for w in sorted(words)])
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 40)))
        assert list(encode.best_path(text, vocabulary)) == slow_path(text, vocabulary)
        assert counts.count_ids(text, vocabulary, counts.automaton(vocabulary)) == len(slow_path(text, vocabulary))


def test_a_text_that_never_converges_is_right():
    vocabulary = small([("aa", -1.0), ("a", -1.5)])
    assert list(encode.best_path("a" * 1001, vocabulary)) == slow_path("a" * 1001, vocabulary)


@needs_vocabulary
def test_words_against_a_library():
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer, models

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    library = Tokenizer(models.Unigram([(p.piece, p.score) for p in proto.pieces], 0, True))
    vocabulary = Vocabulary.read(PATH)
    rng = random.Random(5)
    for _ in range(3000):
        word = BLANK + "".join(rng.choice("thesaniro,.éXß") for _ in range(rng.randint(0, 14)))
        assert encode.ids_of(word, vocabulary) == library.encode(word, add_special_tokens=False).ids


@needs_vocabulary
def test_every_text_comes_back_and_counts_agree():
    vocabulary = Vocabulary.read(PATH)
    run, back, count = encode.encoder(vocabulary), encode.decoder(vocabulary), counts.counter(vocabulary)
    rng = random.Random(6)
    texts = ["", " ", "\n", "\n\na", "a  b", " a", "a ", "a\n b", "a \nb", "\x00\t", "漢字😀", "the" * 5000]
    texts += ["".join(rng.choice("ab the\n é漢😀!x ing") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = run(text)
        whole = encode.ids_of(BLANK + text.replace(" ", BLANK), vocabulary) if text else []
        assert ids.tolist() == whole and back(ids) == text and count(text) == len(whole)


@needs_vocabulary
def test_frames(spark):
    vocabulary = Vocabulary.read(PATH)
    rows = [(1, "the end", "x"), (None, None, None), (2, "", "y"), (1, "the end", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_ids string")
    got = encode.encode_texts(frame, vocabulary)
    assert got.columns == ["doc_id", "text", "ids", "n_ids", "round_trip"]
    by_text = {r.text: r for r in got.collect()}
    assert by_text[None].ids is None and by_text[None].n_ids is None and by_text[None].round_trip is None
    assert by_text[""].ids == [] and by_text[""].round_trip
    assert by_text["the end"].n_ids == len(by_text["the end"].ids) and got.count() == 4
    decoded = encode.decode_ids(got, vocabulary).where("text IS NOT NULL")
    assert decoded.where("decoded <> text").count() == 0
    counted = counts.count_tokens(frame, vocabulary, into="n_ids")
    want = sorted((str(r.text), r.n_ids) for r in got.collect() if r.text is not None)
    assert sorted((str(r.text), r.n_ids) for r in counted.collect() if r.text is not None) == want
    assert encode.encode_texts(frame.limit(0), vocabulary).count() == 0
    assert counts.count_tokens(frame.limit(0), vocabulary).count() == 0
    assert got.where(F.col("text").isNull()).count() == 1
