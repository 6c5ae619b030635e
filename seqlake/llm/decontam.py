"""Benchmark decontamination by spaced seeds.

A mask says which of a few neighbouring words count and which are ignored.  The hashes of all masked words of all
documents meet those of the benchmark in a join; each hit names an item and a diagonal (document position less item
position), and the words around the hit are compared one by one along it.  Substituted words cost a match, no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted

#: 1: the word counts; 0: it is ignored.  Together they hit every window of 5 to 13 words in which a fifth may differ.
MASKS = ("1101", "1011")
#: Words compared around a hit, and the share of them that must be equal.
WINDOW, SHARE = 13, 0.8
#: Items of fewer words say too little to be looked for.
LEAST_WORDS = 5
#: Seeds of the benchmark up to this number go to every task (24 bytes each); more are joined by shuffle, each repeated
#: this often, so that documents which share a frequent seed or item meet it in as many tasks.
BROADCAST_SEEDS, SALTS = 500_000, 32


def tokens(text: Column) -> Column:
    """Lower-case words of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null stands for itself."""
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]


def _seeds(words: Column, position: Column) -> Column:
    """The hash of each mask's words from ``position`` on, as an array."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(words, position + i) for i, c in enumerate(m) if c == "1"]) for k, m in enumerate(MASKS)])


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(__k1, __k2, item, overlap): for each text that shares a passage with an item, the best share of equal words.

    Equal texts give one row for each item; an overlap is at least ``SHARE`` of a window of ``WINDOW`` words, or of the
    whole item if it is shorter.  Items of fewer than ``LEAST_WORDS`` words, null ones among them, are not looked for:
    a document that holds such an item is not found by it.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("item_words")).where(F.size("item_words") >= LEAST_WORDS)
    items = materialize(items.groupBy("item_words").agg(F.min("item").alias("item")).withColumn("n", F.monotonically_increasing_id()))
    count = len(MASKS)
    span = len(MASKS[0])
    seeds = items.select("n", "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - span)).alias("at"))
    seeds = materialize(seeds.select("n", "at", F.explode(_seeds(F.col("item_words"), F.col("at"))).alias("seed")))
    few = seeds.count() <= BROADCAST_SEEDS
    own = docs.select(*text_key(F.col(text)), tokens(F.col(text)).alias("words")).where(F.size("words") >= LEAST_WORDS)
    w, p = F.col("words"), (F.col("i") / F.lit(count)).cast("int")
    seed = F.lit(None).cast("long")
    for k, m in reversed(list(enumerate(MASKS))):
        seed = F.when(F.pmod(F.col("i"), F.lit(count)) == k, F.xxhash64(F.lit(k), *[F.get(w, F.col("p") + i) for i, c in enumerate(m) if c == "1"])).otherwise(seed)
    own = own.select("*", F.explode(F.sequence(F.lit(0), count * (F.size("words") - span + 1) - 1)).alias("i")).withColumn("p", p).withColumn("seed", seed).drop("i")
    if few:
        hits = own.join(F.broadcast(seeds), "seed").join(F.broadcast(items), "n")
    else:  # words follow by their texts only where a seed was hit, once for each diagonal
        salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
        found = own.select("__k1", "__k2", "p", "seed", salt("__k1", "__k2", "p").alias("salt")).join(salted(seeds), ["seed", "salt"])
        found = found.groupBy("__k1", "__k2", "n", (F.col("p") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("at"))
        found = found.withColumn("at", F.explode("at")).select("__k1", "__k2", "n", "at", (F.col("shift") + F.col("at")).alias("p"), salt("__k1", "__k2").alias("salt"))
        texts = docs.select(*text_key(F.col(text)), tokens(F.col(text)).alias("words")).dropDuplicates(["__k1", "__k2"])
        hits = found.join(salted(items), ["n", "salt"]).join(texts, ["__k1", "__k2"])
    size = F.least(F.size("item_words"), F.lit(WINDOW))
    shift = F.col("p") - F.col("at")
    equal = lambda s: F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda j: F.get(F.col("words"), shift + s + j) == F.get(F.col("item_words"), s + j)))
    windows = F.sequence(F.greatest(F.lit(0), F.col("at") - size + 1), F.least(F.col("at"), F.size("item_words") - size))
    best = F.array_max(F.transform(windows, equal)) / size
    return hits.select("__k1", "__k2", "item", best.alias("overlap")).where(F.col("overlap") >= SHARE).groupBy("__k1", "__k2", "item").agg(F.max("overlap").alias("overlap"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, item_id, overlap) per row of ``docs``.

    item_id is the item with the largest overlap, of those the smallest; null and overlap 0 where there is none.  Null
    and empty texts, and texts of fewer than ``LEAST_WORDS`` words, are clean; an empty benchmark finds nothing; items
    with equal words count once, under their smallest id, which may be of any type that has an order.  Texts of any length
    are read whole.  Repeated rows and null keys each get a row.  Other columns are not read.
    """
    found = overlaps(docs, benchmark, text)
    best = found.groupBy("__k1", "__k2").agg(F.count("*").alias("n_items"), F.min_by("item", F.struct(-F.col("overlap"), F.col("item"))).alias("item_id"), F.max("overlap").alias("overlap"))
    best = materialize(best)
    out = docs.select(F.col(key).alias("__key"), *text_key(F.col(text))).join(best, ["__k1", "__k2"], "left")
    return out.select(F.col("__key").alias(key), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts share no passage with the benchmark; all columns."""
    dirty = materialize(overlaps(docs, benchmark, text).select("__k1", "__k2").distinct())
    names = [fresh(docs, c) for c in ("__k1", "__k2")]
    marked = docs.select("*", *[c.alias(n) for c, n in zip(text_key(F.col(text)), names, strict=True)])
    return marked.join(dirty.toDF(*names), names, "left_anti").select(*quoted(docs))


#: The diagonals again: words joined in place of their hashes, windows compared around each hit.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT min(item_id) AS item_id, iw, len(iw) AS m, least(len(iw), {WINDOW}) AS size
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS iw FROM benchmark) WHERE len(iw) >= {LEAST_WORDS} GROUP BY iw),
t AS (SELECT w, row_number() OVER () AS n FROM (SELECT DISTINCT w FROM d WHERE len(w) >= {LEAST_WORDS})),
tp AS (SELECT n, unnest(range(len(w) - {len(MASKS[0]) - 1})) AS p, w FROM t),
ip AS (SELECT *, unnest(range(m - {len(MASKS[0]) - 1})) AS a FROM i),
ts AS ({" UNION ALL ".join(f"SELECT n, p, {k} AS mask, [{', '.join(f'w[p + {j + 1}]' for j, c in enumerate(x) if c == '1')}] AS seed FROM tp" for k, x in enumerate(MASKS))}),
s AS ({" UNION ALL ".join(f"SELECT item_id, iw, m, size, a, {k} AS mask, [{', '.join(f'iw[a + {j + 1}]' for j, c in enumerate(x) if c == '1')}] AS seed FROM ip" for k, x in enumerate(MASKS))}),
h AS (SELECT DISTINCT ts.n, item_id, iw, m, size, a, p - a AS shift FROM ts JOIN s USING (mask, seed)),
o AS (SELECT n, item_id, list_max(list_transform(range(greatest(0, a - size + 1), least(a, m - size) + 1), lambda b: len(list_filter(range(size), lambda j: shift + b + j >= 0 AND w[shift + b + j + 1] = iw[b + j + 1])))) / size AS overlap FROM h JOIN t USING (n)),
b AS (SELECT n, item_id, max(overlap) AS overlap FROM o WHERE overlap >= {SHARE}::DOUBLE GROUP BY n, item_id),
r AS (SELECT w, count(*) AS n_items, arg_min(item_id, (-overlap, item_id)) AS item_id, max(overlap) AS overlap FROM b JOIN t USING (n) GROUP BY w)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, item_id, coalesce(overlap, 0.0::DOUBLE) AS overlap FROM d LEFT JOIN r USING (w)
"""
