"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Every row looks up its host and the hosts above it, each with the beginnings of its path that some rule is as long as.
The filter is tested where the row was read: rows without a possible hit are done there, and only the others are
exploded, joined with the list, which takes out what the filter passed wrongly, and reduced to one rule each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import with_position
from .common import LOWER, UPPER, materialize

#: Bits of the filter for each listed URL, and bits set for each.
BITS_PER_URL, HASHES = 16, 4
#: Lists of up to this many URLs go to every task (about 100 bytes each); longer ones are joined by shuffle.
BROADCAST_URLS = 100_000
#: A filter of up to this many 64-bit blocks is a constant of the plan (8 MB for four million URLs); a larger one is joined.
FILTER_WORDS = 1 << 20


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (text like ``example.net/en/``, verdict) as a table for :func:`judge`."""
    return spark.createDataFrame([(r, r[: (r + "/").index("/")], r[(r + "/").index("/") :], v) for r, v in rules], "rule string, host string, path string, verdict string")


def _place(h: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask) of the hash of a listed or looked-up (host, path): one 64-bit block for each key, ``HASHES`` bits in it."""
    mask = F.lit(0).cast("long")
    for k in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(h), F.lit(blocks)), mask


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has (rule, host, path, verdict).  A rule fits its host and all hosts below it, if the url's path starts
    with the rule's path; the longest rule wins, of equally long ones the first in order, and of rules that differ in
    their verdicts only the first verdict.  Without one, rule is null and verdict is ``otherwise``.  Null urls and such
    without :// have empty host and path, and no rule; repeated rows and null keys each get a row; an empty list fits
    nothing.  Of a very long url only as many labels and beginnings are looked up as some rule has.  Other columns are
    not read.
    """
    listed = rules.where("host <> '' and path is not null").groupBy("rule", "host", "path").agg(F.min("verdict").alias("verdict"))
    listed = materialize(with_position(listed.withColumn("shorter", -F.length("rule")), "shorter", "rule", "host", "path", name="rank").drop("shorter"))
    n, labels = listed.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1))).first()
    sizes = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # as many as a path has letters
    small = F.broadcast if n <= BROADCAST_URLS else lambda df: df
    blocks = max(1, 1 << max(0, (n * BITS_PER_URL - 1).bit_length() - 6))
    block, mask = _place(F.xxhash64("host", "path"), blocks)
    bloom = listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))
    own = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.monotonically_increasing_id().alias("row"))
    parts = F.split("h", r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = F.filter(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"), lambda x: x <= F.length("p"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda x: F.struct(h.alias("host"), F.substring(F.col("p"), F.lit(1), x).alias("path")))))
    own = own.withColumn("keys", F.when(F.col("h") != "", pairs).otherwise(F.array().cast("array<struct<host:string,path:string>>")))
    if blocks <= FILTER_WORDS:
        words = [0] * blocks
        for r in bloom.collect():
            words[r["block"]] = r["bits"]
        held = F.from_json(F.lit(str(words)), "array<bigint>")  # folded to a constant of the plan

        def possible(k: Column) -> Column:
            at, bits = _place(F.xxhash64(k["host"], k["path"]), blocks)
            return F.get(held, at.cast("int")).bitwiseAND(bits) == bits

        own = own.withColumn("keys", F.filter("keys", possible))
        clear, hit = own.where(F.size("keys") == 0), own.where(F.size("keys") > 0).withColumn("k", F.explode("keys"))
    else:  # the filter is dealt by its blocks; a key of nulls keeps the rows that hit nothing
        at, bits = _place(F.xxhash64("k.host", "k.path"), blocks)
        nothing = F.array(F.struct(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")))
        hit = own.withColumn("k", F.explode(F.concat("keys", nothing))).withColumn("block", F.when(F.col("k.host").isNotNull(), at).otherwise(-1 - F.pmod("row", F.lit(blocks)))).withColumn("mask", bits)
        hit = hit.join(bloom, "block", "left").where((F.col("block") < 0) | (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")))
        clear = own.where(F.lit(False))
    exact = hit.select("row", "key", "h", "p", "k.host", "k.path").join(small(listed.select("host", "path", "rank")), ["host", "path"], "left")
    best = exact.groupBy("row", "key", "h", "p").agg(F.min("rank").alias("rank")).join(small(listed.select("rank", "rule", "verdict")), "rank", "left")
    out = [F.col("key").alias(key), F.col("h").alias("host"), F.col("p").alias("path")]
    none = F.lit(None).cast("string")
    return clear.select(*out, none.alias("rule"), F.lit(otherwise).alias("verdict")).unionByName(best.select(*out, "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")))
