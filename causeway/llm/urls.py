"""URL filter: a blocked Bloom filter in front of an exact join, in DataFrame operations only.

Listed are rules (host and path prefix) and single canonical URLs. Each distinct URL gives
the keys under which it could be listed. The Bloom filter, whose size is bounded by a
parameter whatever the length of the list, lets possible hits pass to a join on the whole
key, which removes false positives. A URL is judged once however many pages have it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words of a block; a key sets one bit in each
KEYS_PER_BLOCK = 40  # about 13 bits a key: less than 1 in 100 passes wrongly
MAX_BLOCKS = 1 << 16  # 4 MB of words; a longer list only lets more false hits pass

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.regexp_replace(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", "")
    return F.when(at > 0, F.regexp_extract(rest, "^[^?#]*", 0)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without slashes at its end; null without a host."""
    bare = F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", bare)


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, path)


def url_key(canonical_url: Column) -> Column:
    return F.concat(F.lit("url "), canonical_url)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The word's one bit that the key sets."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit("bit"), key), 6 * word).bitwiseAND(F.lit(63).cast("long"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that a key falls into: ``block, w0 ... w7``."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    )


def possible_hits(candidates: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose eight bits are all set."""
    bloom = blocked_bloom(keys, blocks)
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0)
    marked = candidates.withColumn("block", _block(F.col("key"), blocks))
    # At most MAX_BLOCKS rows of 72 bytes are broadcast.
    return marked.join(F.broadcast(bloom), "block").where(hit).select(*candidates.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    url_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    ``rules`` has ``host, path, verdict``: a rule fits its host and all subdomains if the
    path starts with the rule's; of several the longest wins, at equal length the one with
    the longer host, then ``block``. ``listed`` has ``canonical``: canonical URLs that are
    blocked where no rule fits. Anything else is allowed.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. Null rules and null listed URLs are left out; repeated ones count once. Added
    columns replace columns of ``pages`` with the same names. Empty tables give no hits.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = pages[url_col]
    judged = pages.select(*names, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})

    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    entries = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        rule_key(F.col("host"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        F.struct(F.length(F.concat("host", "path")), F.length("host"), F.col("verdict")).alias("rank"),
        "verdict",
    )
    singles = listed.where("canonical IS NOT NULL").select(url_key(F.col("canonical")).alias("key")).distinct()
    entries = entries.unionByName(
        singles.select("key", F.lit("block").alias("verdict")), allowMissingColumns=True
    )
    count, lengths = entries.agg(
        F.count("*"), F.collect_set(F.length("rule") - F.col("rank.col2"))
    ).first()
    blocks = min(max_blocks, max(1, math.ceil(count / KEYS_PER_BLOCK)))

    host, path = F.col("host"), F.col("path")
    labels = F.split(host, "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    # Lengths of rule paths are few numbers, however many rules there are.
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: rule_key(s, p))))
    own = F.array(url_key(canonical(host, path)))
    candidates = (
        judged.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.concat(keys, own)).alias("key"))
    )
    hits = possible_hits(candidates, entries.select("key"), blocks)
    verdicts = (
        hits.join(entries, "key")
        .groupBy("host", "path")
        .agg(
            F.max_by("rule", "rank").alias("rule"),
            F.max_by("verdict", "rank").alias("by_rule"),
            F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("by_list"),
        )
    )
    return (
        judged.join(verdicts, ["host", "path"], "left")
        .withColumn("verdict", F.coalesce("by_rule", "by_list", F.lit("allow")))
        .select(*names, "host", "path", "rule", "verdict")
    )
