"""How filters of a corpus overlap, for every order in which they could be applied.

Each document gets one bit for each filter that it fails. Documents are then counted by part
and combination of bits, and every report of every order is a sum over these few counts.

The filter "repeats an earlier text" is an existential self-join: a left semi join on the hash
of the text, the exact text, and a smaller id. Its right side is the row of smallest id for
each text, which exists if and only if any row of smaller id does; groups of copies are salted,
so a text that fills a third of the table is compared in many tasks. The ids that the join
marks are united with those that fail the other filters and combined per document.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = "E"  # letter of the filter that the self-join decides
SALT = 128  # copies of one text that are compared together, about
FEW = 1_000_000  # hashes of 8 bytes and a number, broadcast up to this many


def row_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides by itself, by letter."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _keyed(documents: DataFrame) -> DataFrame:
    """Id, part, text and two hashes of the text; a null text is empty, as is a null source."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("")).alias("part"),
        text.alias("body"),
        F.xxhash64(text).alias("hash"),
        F.xxhash64(F.lit(1), text).alias("mark"),
    )


def repeats(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows (``id, part, hash, mark``) whose exact text a row of smaller id has.

    ``narrow`` holds the same rows without texts. Only texts whose hash stands under several
    ids take part in the join.
    """
    groups = narrow.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    groups = written(groups.where("least < most").select("hash", F.ceil(F.col("n") / SALT).cast("int").alias("salts")))
    hint = F.broadcast if groups.count() <= FEW else lambda df: df
    copies = written(rows.where("id IS NOT NULL").join(hint(groups), "hash"))
    first = copies.groupBy("hash", "body").agg(F.min("id").alias("least"), F.max("salts").alias("salts"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).alias("own")
    first = first.select("hash", "body", "salt", "least").alias("first")
    same = (
        (F.col("own.hash") == F.col("first.hash"))
        & (F.col("own.salt") == F.col("first.salt"))
        & (F.col("own.body") == F.col("first.body"))
        & (F.col("first.least") < F.col("own.id"))
    )
    return own.join(first, same, "left_semi").select("id", "part", "hash", "mark")


def failed_filters(documents: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``id, part, n, bits``: rows that share an id, a source and a text, and what they fail.

    Bit i stands for the i-th letter. A null text counts as empty. A null id is smaller than
    none and no id is smaller than it, so it neither is nor makes a repeat; nor do rows of
    equal id repeat one another.
    """
    rows = _keyed(documents)
    conditions = row_conditions(F.col("body"))
    bits = F.lit(0)
    for letter in letters.replace(REPEATS, ""):
        bits = bits + F.when(conditions[letter], 1 << letters.index(letter)).otherwise(0)
    narrow = written(rows.select("id", "part", "hash", "mark", F.lit(1).alias("n"), bits.alias("bits")))
    failures = narrow
    if REPEATS in letters:
        marks = repeats(rows, narrow)
        failures = narrow.unionByName(
            marks.select("*", F.lit(0).alias("n"), F.lit(1 << letters.index(REPEATS)).alias("bits"))
        )
    merged = failures.groupBy("id", "part", "hash", "mark").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
    return merged


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: documents by part and by what they fail.

    A document is good or toxic if any of its labels says so; labels of a null id are nobody's.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = known.withColumn("nobody", F.lit(False))
    # Rows without an id go by their hash, so that they do not meet in one task.
    key = F.coalesce("id", "hash")
    joined = failed.join(known, (key == F.col("label_id")) & (F.col("id").isNull() == F.col("nobody")), "left")

    def count(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)

    return joined.groupBy("part", "bits").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _sum(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda total, row: total + value(row))


def orders_report(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What every filter does at its step, for every part and every order of the filters.

    ``shapley`` is the sum over all orders: a document that fails k filters is removed by each
    of them in one k-th of the orders.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("sets"))
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)

    def mask(text: Column) -> Column:
        return sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))

    steps = steps.withColumns({"own": mask(letter), "before": mask(before)})
    own, before = F.col("own"), F.col("before")
    fails = lambda row: row["bits"].bitwiseAND(own) != 0
    gone = lambda row: row["bits"].bitwiseAND(before) != 0
    removed = F.filter("sets", lambda row: fails(row) & ~gone(row))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        _sum(F.filter("sets", lambda row: row["bits"].bitwiseAND(own.bitwiseOR(before)) == 0), lambda r: r["n"]).alias("kept"),
        _sum(removed, lambda r: r["n"]).alias("removed"),
        _sum(F.filter("sets", lambda row: fails(row) & gone(row)), lambda r: r["n"]).alias("redundant"),
        _sum(F.filter("sets", lambda row: row["bits"] == own), lambda r: r["n"]).alias("unique_fails"),
        _sum(removed, lambda r: r["good"]).alias("good_lost"),
        _sum(removed, lambda r: r["toxic"]).alias("toxic_lost"),
        _sum(
            F.filter("sets", fails),
            lambda r: r["n"] * (F.lit(factorial(len(letters))) / F.bit_count(r["bits"])).cast("bigint"),
        ).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The report of all orders over whole ``documents``; an empty table has no parts."""
    return orders_report(written(combinations(failed_filters(documents, letters), labels)), letters)
