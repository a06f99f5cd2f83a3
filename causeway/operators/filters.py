"""Row filters and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import is_explicit_row
from ..functions.markup import has_crossing
from ..functions.parsing import sentence_count

# Which documents form the test set, and valid chain labels.
TEST_DOC = r"(?d)^wsj_(00|01|22|23|24).+"
TEST_DOC_ID = "Article247_327.ann"
CHAIN_LABELS = (0, 2, 3, 4)
TAG_SET = ("O", "I-C", "I-E", "B-C", "B-E")

# Output columns of each task.
TASK_COLUMNS = {
    "sequence_classification": ["example_id", "text", "labels"],
    "span_detection": ["example_id", "text", "tokens", "tags", "tagged_text"],
    "chain_classification": ["example_id", "events", "short_contexts", "labels"],
}


def first_relation(df: DataFrame) -> DataFrame:
    return df.where(F.col("eg_id") == 0)


def positive_pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("pair_label") == 1)


def _intra_inter(df: DataFrame, count: Column, mode: str) -> DataFrame:
    if mode == "intra":
        return df.where(count == 1)
    if mode == "inter":
        return df.where(count >= 2)
    return df


def filter_num_sents(df: DataFrame, mode: str) -> DataFrame:
    """Within one sentence (``intra``) or across several (``inter``), as annotated."""
    return _intra_inter(df, F.col("num_sents"), mode)


def filter_sentence_count(df: DataFrame, mode: str, locale_aware: bool = False) -> DataFrame:
    """The same, counting the sentences in the text."""
    return _intra_inter(df, sentence_count(F.col("text"), locale_aware), mode)


def is_test_doc(doc_id: Column, also: str | None = None) -> Column:
    """Test documents by name, and one more by its full id if given."""
    by_name = doc_id.rlike(TEST_DOC)
    return by_name | (doc_id == also) if also else by_name


def has_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_numbered(df: DataFrame, mode: str) -> DataFrame:
    """``single`` or ``multi`` relations, told by the tag ``<c1>``."""
    numbered = F.col("tagged_text").contains("<c1>")
    if mode == "single":
        return df.where(~numbered)
    if mode == "multi":
        return df.where(numbered)
    return df


def filter_plicit(df: DataFrame, mode: str, repaired: bool = False) -> DataFrame:
    """Rows whose relations are all ``explicit``, or those with one that is not."""
    explicit = is_explicit_row(F.col("text"), F.col("tagged_text"), repaired)
    if mode == "explicit":
        return df.where(explicit)
    if mode == "implicit":
        return df.where(~explicit)
    return df


def filter_nested(df: DataFrame) -> DataFrame:
    """Drop rows with overlapping numbered spans."""
    return df.where(~has_crossing(F.col("tagged_text")))


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check and rows that do not (NULL does not)."""
    passed = F.coalesce(valid, F.lit(False))
    return df.where(passed), df.where(~passed)


def with_status(df: DataFrame, valid: Column) -> DataFrame:
    """Both parts of `quarantine` in one pass, told apart by ``status``: valid or rejected."""
    return df.withColumn("status", F.when(F.coalesce(valid, F.lit(False)), "valid").otherwise("rejected"))


def valid_chain_label(label: Column) -> Column:
    return label.isin(*CHAIN_LABELS)


def valid_tags(tags: Column) -> Column:
    return F.forall(tags, lambda t: t.isin(*TAG_SET))


def project_task(df: DataFrame, task: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The task's columns, and any others named in ``keep``."""
    return df.select(*TASK_COLUMNS[task], *keep)


def cast_label(df: DataFrame, to: str, column: str = "labels") -> DataFrame:
    return df.withColumn(column, F.col(column).cast(to))


def normalize_id(column: Column) -> Column:
    """The digits of an id as a number; NULL when there are none."""
    return F.regexp_replace(column.cast("string"), "[^0-9]", "").try_cast("bigint")


def make_id(prefix: str, *columns: Column) -> Column:
    """``prefix_a_b``."""
    return F.concat_ws("_", F.lit(prefix), *[c.cast("string") for c in columns])


def with_metadata(df: DataFrame, **values) -> DataFrame:
    """Attach constants that describe a run."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})
