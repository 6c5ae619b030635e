"""Helpers that several operators share: input columns, shared-folder tables, word arrays, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import drop_table, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word contracts of language-model scoring and SimHash.
SPACES = r"[\x20\x09-\x0D]+"
#: Masks of 64 rows that are sent to every task, at most.
BROADCAST_MASKS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df``, whatever letters their names have."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, separators: str = SPACES) -> Column:
    """Words between runs of ``separators``; no empty ones."""
    return F.filter(F.split(text, separators), lambda w: w != "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as decimal text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def only_rows(df: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number in the column ``row`` is in the column of that name of ``ids``; repeats there are harmless.

    Numbers are those of monotonically_increasing_id.  Every task gets a bit for each number, so that the rows of
    ``df``, texts and all, stay where they are; only beyond ``BROADCAST_MASKS`` masks are they joined by shuffle.
    """
    word, mask, number = fresh(df, "word"), fresh(df, "mask"), F.col(row)
    at, bit = F.shiftright(number, 6), number.bitwiseAND(F.lit(63)).cast("int")
    masks = materialize(ids.groupBy(at.alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(mask)))
    small = F.broadcast if masks.count() <= BROADCAST_MASKS else lambda x: x
    return df.join(small(masks), at == F.col(word)).where(F.getbit(mask, bit) == 1).drop(word, mask)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the links ``a``-``b`` in one task: nodes, and the smallest node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, left, right = np.arange(len(nodes)), inverse[: len(a)], inverse[len(a) :]
    while True:
        x, y = parent[left], parent[right]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (parent != (up := parent[parent])).any():
            parent = up


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``links`` has long columns a and b.  Returns (node, root) for every node of a link, root being the component's
    smallest node.  Links with a null end and self-links are ignored; repeated links are harmless; no links give no
    rows.  Each round joins the links with one row per node, which Spark can split where a node is hot, and ends in a
    table in the shared folder.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a <> b").distinct()
    )
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        new = materialize(
            large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
            .unionByName(small.select("hi", F.col("m").alias("lo"))).distinct()
        )
        now = _mark(new)
        if edges.inputFiles():
            drop_table(edges)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]
