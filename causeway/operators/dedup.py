"""Duplicate texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

BITMAPS = 25_000  # of 4 kB, for 32,768 numbers each, that are broadcast at most

def _by_text(df: DataFrame, text: str, order: str) -> DataFrame:
    # Copies are counted map-side per digest, so a hot text costs one row per
    # task, and rows come back by their unique order column, never by text. As bytes a
    # digest takes half the room that it takes as digits.
    return df.groupBy(F.unhex(F.sha2(F.col(text), 256)).alias("_digest")).agg(
        F.min(order).alias(order), F.count("*").alias("_copies")
    )


def _of_order(df: DataFrame, kept: DataFrame, order: str, numbered: bool) -> DataFrame:
    """Rows whose ``order`` is in ``kept``."""
    if numbered:
        # Numbers meet before bits are set, or each task would send bits for all numbers.
        near = kept.select(order, F.bitmap_bucket_number(order).alias("_bucket")).repartition("_bucket")
        bits = staged(near.groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(order)).alias("_bits")))
        if bits.count() <= BITMAPS:
            place = F.bitmap_bit_position(order)
            byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            stays = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1
            rows = df.withColumn("_bucket", F.bitmap_bucket_number(order)).join(F.broadcast(bits), "_bucket")
            return rows.where(stays).select(*df.columns)
    return df.join(kept, order, "left_semi")


def keep_first(df: DataFrame, text: str = "text", order: str = "row_id", numbered: bool = False) -> DataFrame:
    """The first row of each text; ``order`` must be unique.

    ``numbered`` says that ``order`` is a running number. Then rows don't move: the numbers
    that stay are sent to them, a bit each, unless they turn out to lie too far apart.
    """
    return _of_order(df, _by_text(df, text, order).select(order), order, numbered)


def keep_unique(df: DataFrame, text: str = "text", order: str = "row_id", numbered: bool = False) -> DataFrame:
    """Rows whose text occurs once: every copy of a repeated text goes."""
    lone = _by_text(df, text, order).where("_copies = 1").select(order)
    return _of_order(df, lone, order, numbered)
