"""Corpora as split frames: read, annotate, filter the test set, split."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import has_crossing, map_tags, strip_clues, strip_markup, untag
from ..functions.parsing import Tokenizer, blank_tokens
from ..functions.tagging import aligned_tags, marked_tags, marked_tokens, phrase_tags
from ..operators import chains, filters, splits
from ..operators.dedup import keep_first, keep_unique
from ..operators.groups import causal_groups, malformed_relations
from . import readers
from .scratch import staged
from .rules import CHAIN, SEQUENCE, SPAN, RejectedOption, check_pair

# File names of the corpora.
ONE_FILE = {"because": "because.csv", "pdtb": "pdtb.csv"}
TWO_FILES = {"altlex": "altlex", "ctb": "ctb", "esl": "esl2", "semeval": "semeval2010t8"}
FINCAUSAL_FILE = "fnp2020-fincausal{part}-task{task}.csv"
FINCAUSAL_PARTS = ("", "2")
FINCAUSAL_COLUMNS = {
    SEQUENCE: ["Index", "Text", "Gold"],
    SPAN: ["Index", "Text", "Cause", "Effect", "Sentence"],
}
JAPANESE_TSV = {
    "jpfinresults": ("kessan_data_for_classify.tsv", "kessan"),
    "jpnikkei": ("nikkei_data.tsv", "nikkei"),
}
SPLIT_FILES = {"train": "train", "valid": "dev", "test": "test"}
# What "all" stands for.
ALL_CORPORA = {
    SEQUENCE: ("altlex", "because", "ctb", "esl", "pdtb", "semeval", "fincausal"),
    SPAN: ("altlex", "because", "pdtb", "fincausal"),
}
# Corpora whose pairs carry no sentence kinds to filter by.
NO_SENT_FILTER = ("altlex", "because", "semeval")

PAIR_KEY = ["corpus", "doc_id", "sent_id", "example_id", "text"]


def select_pairs(pairs: DataFrame, task: str) -> DataFrame:
    """The rows of a pair file that a task uses, with their tagged text."""
    return _named(_of_task(pairs, task))


def _of_task(pairs: DataFrame, task: str) -> DataFrame:
    return (filters.first_relation if task == SEQUENCE else filters.positive_pairs)(pairs)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tagged_text", map_tags(F.col("text_w_pairs"), "arg")).withColumnsRenamed(
        {"eg_id": "example_id", "seq_label": "labels"}
    )


def tag_pairs(rows: DataFrame) -> DataFrame:
    """Tokens and BIO tags. Run it last: until then the rows travel without arrays."""
    marked = F.col("text_w_pairs")
    return rows.withColumns({"tokens": marked_tokens(marked), "tags": marked_tags(marked)})


def filter_test(
    test: DataFrame, corpus: str, task: str, num_sent: str, num_causal: str, plicit: str
) -> DataFrame:
    """Filters of the test part, cheapest data first and the cue filter last."""
    if task == SPAN:
        test = causal_groups(test, num_causal)
    if num_sent != "all" and corpus in NO_SENT_FILTER:
        raise RejectedOption(f"num_sent={num_sent!r} is not available for {corpus!r}")
    test = filters.filter_num_sents(test, num_sent)
    return filters.filter_plicit(test, plicit) if task == SPAN else test


def _staged(rows: DataFrame) -> DataFrame:
    """The rows of a text file as columns in the shared folder, so that it is parsed once."""
    return staged(rows)


def _staged_pairs(rows: DataFrame) -> DataFrame:
    """The same for pairs: a text that is the tagged one without its markup is not written twice."""
    bare = strip_markup(F.col("text_w_pairs"))
    twice = F.coalesce(F.col("text") == bare, F.lit(False))
    kept = _staged(rows.withColumns({"_bare": twice, "text": F.when(~twice, F.col("text"))}))
    return kept.withColumn("text", F.when(F.col("_bare"), bare).otherwise(F.col("text"))).select(*rows.columns)


def _with_split(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("split", F.lit(name))


def _pairs(
    spark, corpus, task, data_dir, num_sent, num_causal, plicit, seed, tokenizer, multi_line
) -> DataFrame:
    def read(name: str) -> DataFrame:
        path = os.path.join(data_dir, name)
        return _named(_staged_pairs(_of_task(readers.read_pairs_csv(spark, path, multi_line), task)))

    if corpus in ONE_FILE:
        rows = read(ONE_FILE[corpus])
        also = filters.TEST_DOC_ID if corpus == "because" else None
        is_test = filters.is_test_doc(F.col("doc_id"), also)
        test, rest = rows.where(is_test), rows.where(~is_test)
    else:
        rest, test = (read(f"{TWO_FILES[corpus]}_{part}.csv") for part in ("train", "test"))
    test = filter_test(test, corpus, task, num_sent, num_causal, plicit)
    key = [*PAIR_KEY, "text_w_pairs"]
    parts = splits.split_train_valid(rest, test, seed, key)
    return tag_pairs(parts.unionByName(_with_split(test, "test")))


def annotate_phrases(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Tokens, tags and tagged text of rows that give cause and effect as phrases."""
    return rows.withColumns(
        {
            "tokens": tokenizer(F.col("Text")),
            "tags": phrase_tags(
                tokenizer(F.col("Text")), tokenizer(F.col("Cause")), tokenizer(F.col("Effect"))
            ),
            "tagged_text": map_tags(F.col("Sentence"), "e12"),
        }
    )


def _fincausal_paths(task: str, data_dir: str) -> dict[str, str]:
    number = 1 if task == SEQUENCE else 2
    return {
        f"fincausal{part}": os.path.join(data_dir, FINCAUSAL_FILE.format(part=part, task=number))
        for part in FINCAUSAL_PARTS
    }


def _fincausal(
    spark, corpus, task, data_dir, num_sent, num_causal, plicit, seed, tokenizer, multi_line
) -> DataFrame:
    rows = filters.has_text(
        _staged(readers.read_delimited(spark, _fincausal_paths(task, data_dir), FINCAUSAL_COLUMNS[task])), "Text"
    ).withColumnRenamed("Index", "example_id")
    if task == SEQUENCE:
        rows = rows.withColumn("labels", readers.whole_number(F.col("Gold"))).where("labels IS NOT NULL")
        rows = keep_first(rows, "Text", numbered=True)
    else:
        rows = annotate_phrases(keep_unique(rows, "Text", numbered=True), tokenizer or blank_tokens)
    rows = rows.withColumnRenamed("Text", "text")
    parts = splits.split_80_10_10(rows, seed, ["row_id"])
    test = filters.filter_sentence_count(parts.where("split = 'test'"), num_sent)
    if task == SPAN:
        test = filters.filter_plicit(test, plicit)
    return parts.where("split <> 'test'").unionByName(test)


def annotate_japanese(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Span rows from clue-tagged sentences; rows with overlapping spans are dropped."""
    tagged = filters.filter_nested(
        rows.withColumn("tagged_text", strip_clues(F.col("tagged_sentence")))
    )
    worded = tagged.withColumn("text", untag(F.col("tagged_text"))).withColumn(
        "tokens", tokenizer(F.col("text"))
    )
    return worded.withColumn("tags", aligned_tags(F.col("tagged_text"), F.col("tokens")))


def _characters(text):
    return F.split(text, "")


def _japanese(
    spark, corpus, task, data_dir, num_sent, num_causal, plicit, seed, tokenizer, multi_line
) -> DataFrame:
    if plicit != "all":
        raise RejectedOption(f"plicit={plicit!r} is not available for {corpus!r}")
    if task == SEQUENCE:
        name, prefix = JAPANESE_TSV[corpus]
        rows = readers.read_tsv(
            spark, os.path.join(data_dir, name), "labels bigint, example_id string, text string"
        ).withColumn("example_id", F.concat_ws("_", F.lit(prefix), "example_id"))
        return splits.split_80_10_10(rows, seed, ["example_id", "text"])
    parts = [
        _with_split(
            annotate_japanese(
                readers.read_jsonl(
                    spark,
                    os.path.join(data_dir, "kessan", f"{file}.jsonl"),
                    "tagged_sentence string",
                    f"kessan_{file}",
                ),
                tokenizer or _characters,
            ),
            split,
        )
        for split, file in SPLIT_FILES.items()
    ]
    *others, test = parts
    return reduce(DataFrame.unionByName, [*others, filters.filter_numbered(test, num_causal)])


def _chains(
    spark, corpus, task, data_dir, num_sent, num_causal, plicit, seed, tokenizer, multi_line
) -> DataFrame:
    def read(file: str) -> DataFrame:
        rows = readers.read_instances(spark, os.path.join(data_dir, "reco", f"{file}.json"), multi_line)
        valid, _ = filters.quarantine(rows, filters.valid_chain_label(F.col("label")))
        return chains.chain_pairs(valid)

    return reduce(
        DataFrame.unionByName,
        [_with_split(read(file), split) for split, file in SPLIT_FILES.items()],
    )


def union_corpora(frames: list[DataFrame], task: str) -> DataFrame:
    """Union of split corpora with ids reduced to their digits."""
    columns = filters.TASK_COLUMNS[task]
    return reduce(
        DataFrame.unionByName,
        [
            f.withColumn("example_id", filters.normalize_id(F.col("example_id"))).select(
                *columns, "split"
            )
            for f in frames
        ],
    )


_LOADERS = {
    **dict.fromkeys((*ONE_FILE, *TWO_FILES), _pairs),
    "fincausal": _fincausal,
    **dict.fromkeys(JAPANESE_TSV, _japanese),
    "reco": _chains,
}


def load_corpus(
    spark: SparkSession,
    corpus: str,
    task: str,
    data_dir: str,
    num_sent: str = "all",
    num_causal: str = "all",
    plicit: str = "all",
    seed: int = 42,
    tokenizer: Tokenizer | None = None,
    multi_line: bool = True,
    done: Callable[[str], None] | None = None,
) -> DataFrame:
    """One corpus for one task: its task columns and ``split``.

    Filters touch the test part only. ``tokenizer`` is a column function used
    where a corpus gives plain text instead of marked tokens. ``multi_line``
    reads CSV with line breaks in quotes, and JSON documents over several lines,
    by byte ranges that are scanned several times; turn it off for files without them.
    What a corpus holds but can't be used is in `load_quarantine`.
    ``done`` is told the name of each corpus of pairs or ``fincausal`` when it is staged and
    its files are not read any more.
    """
    check_pair(corpus, task)
    options = (data_dir, num_sent, num_causal, plicit, seed, tokenizer, multi_line)
    if corpus == "all":
        parts = [load_corpus(spark, c, task, *options, done=done) for c in ALL_CORPORA[task]]
        return union_corpora(parts, task)
    rows = _LOADERS[corpus](spark, corpus, task, *options)
    if done and _LOADERS[corpus] in (_pairs, _fincausal):
        done(corpus)
    return rows.select(*filters.TASK_COLUMNS[task], "split")


def load_quarantine(spark: SparkSession, corpus: str, task: str, data_dir: str, multi_line: bool = True) -> DataFrame:
    """What `load_corpus` leaves out of a corpus as malformed: ``reason`` and ``record``.

    Reasons are ``number`` (a number that is none), ``fields`` (a line with more or fewer
    fields), ``label`` (no valid label) and ``spans`` (a relation that lacks its markup).
    """
    check_pair(corpus, task)

    def rejected(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(F.lit(reason).alias("reason"), F.to_json(F.struct("*")).alias("record"))

    if corpus == "all":
        return reduce(
            DataFrame.unionByName,
            [load_quarantine(spark, c, task, data_dir, multi_line) for c in ALL_CORPORA[task]],
        )
    if corpus in ONE_FILE or corpus in TWO_FILES:
        names = [ONE_FILE[corpus]] if corpus in ONE_FILE else [f"{TWO_FILES[corpus]}_{p}.csv" for p in ("train", "test")]
        frames = []
        for name in names:
            path = os.path.join(data_dir, name)
            frames.append(readers.pairs_quarantine(spark, path, multi_line))
            if task == SPAN:
                pairs = select_pairs(readers.read_pairs_csv(spark, path, multi_line), task)
                frames.append(rejected(malformed_relations(pairs), "spans"))
        return reduce(DataFrame.unionByName, frames)
    if corpus == "fincausal":
        paths, columns = _fincausal_paths(task, data_dir), FINCAUSAL_COLUMNS[task]
        torn = readers.delimited_quarantine(spark, paths, columns)
        if task == SPAN:
            return torn
        rows = filters.has_text(readers.read_delimited(spark, paths, columns), "Text")
        return torn.unionByName(rejected(rows.where(readers.whole_number(F.col("Gold")).isNull()), "label"))
    if corpus == "reco":
        frames = []
        for file in SPLIT_FILES.values():
            rows = readers.read_instances(spark, os.path.join(data_dir, "reco", f"{file}.json"), multi_line)
            frames.append(rejected(filters.quarantine(rows, filters.valid_chain_label(F.col("label")))[1], "label"))
        return reduce(DataFrame.unionByName, frames)
    if task == SEQUENCE:
        name, _ = JAPANESE_TSV[corpus]
        rows = readers.read_tsv(spark, os.path.join(data_dir, name), "labels string, example_id string, text string")
        return rejected(rows.where(readers.whole_number(F.col("labels")).isNull()), "label")
    frames = []
    for file in SPLIT_FILES.values():
        path = os.path.join(data_dir, "kessan", f"{file}.jsonl")
        rows = readers.read_jsonl(spark, path, "tagged_sentence string", f"kessan_{file}")
        broken = has_crossing(strip_clues(F.col("tagged_sentence"))).isNull()
        frames.append(rejected(rows.where(broken), "spans"))
    return reduce(DataFrame.unionByName, frames)


def load_data(
    spark: SparkSession,
    task: str,
    corpus: str,
    data_dir: str,
    test_corpus: str | None = None,
    test_samples: int | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """Train and valid rows of a corpus with the test rows of it or of another one.

    ``test_samples`` keeps the first test rows in order of their ids.
    """
    rows = load_corpus(spark, corpus, task, data_dir, seed=seed, **options)
    other = rows
    if test_corpus and test_corpus != corpus:
        other = load_corpus(spark, test_corpus, task, data_dir, seed=seed, **options)
        if rows.schema["example_id"].dataType != other.schema["example_id"].dataType:
            rows, other = (
                f.withColumn("example_id", F.col("example_id").cast("string")) for f in (rows, other)
            )
    test = other.where("split = 'test'")
    if test_samples is not None:
        order = ["example_id", "text"] if task != CHAIN else ["example_id"]
        test = splits.head(test, test_samples, order)
    return splits.cross_corpus(rows, test)
