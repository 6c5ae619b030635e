"""Language identification by fusing evidence as Bayes' rule has it.

What a text says (byte triples under each language's distribution), what its markup declares, what its address has for a
suffix (the last label of its host, and the first part of its path), and what its host's other texts are in: each gives
a likelihood or a prior for every language, and their product is the posterior.  Priors of hosts are smoothed by those
of their domain, and those by the whole table; all of them, and how far declarations and suffixes can be trusted, are
grouped counts of what the texts alone say.  A row's own text is taken out of every count before the row is judged, so
that it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, let, materialize, quoted
from .url_filter import host_of, path_of

#: Buckets of byte triples.  The model has that many numbers for each language.
BUCKETS = 1 << 16
#: Languages of the model, at most: those with the most labelled rows.
LANGUAGES = 100
#: Host counts up to this number go to every task; more are joined by shuffle, each repeated this often for hot hosts.
BROADCAST_HOSTS, SALTS = 100_000, 32
#: Triples of a text overlap and repeat, so a text of any length counts as at most so many independent ones.
EFFECTIVE = 60.0
#: Weight of the wider level in the counts of the narrower one.
PRIOR = 4.0
#: Documents with this remainder of crc32 modulo ``FOLDS`` are held out of training.
FOLDS, HELD_OUT = 4, 2


def plain_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; null is empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's number) of every byte triple of the lower-cased texts."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0] : offset[-1]].astype(np.uint32) if texts.buffers()[2] is not None else np.zeros(0, np.uint32)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offset))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    inside = own[:-2] == own[2:]
    return code[inside].astype(np.int64), own[:-2][inside]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of buckets): counts of all labelled rows; a row without language is left out.

    The driver gets ``BUCKETS`` numbers for each of at most ``LANGUAGES`` languages, those with the most rows; rows of
    others are left out.
    """
    own = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and l <> ''")
    known = [r["l"] for r in own.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()]
    own = own.where(F.col("l").isin(known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                code, row = _triples(part.column(0))
                langs = np.array(part.column(1).to_pylist())
                for l in np.unique(langs):  # noqa: E741
                    got = np.bincount(code[(langs == l)[row]], minlength=BUCKETS)
                    total[l] = total.get(l, 0) + got
        for l, n in total.items():  # noqa: E741
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["l", "bucket", "n"])

    rows = own.mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["l"].unique())
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[rows["l"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.int64)
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def with_likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str, out: str) -> DataFrame:
    """``rows`` with log-likelihoods for each language in place of the text; an empty text has equal ones."""
    languages, shared = model[0], rows.sparkSession.sparkContext.broadcast(model[1])  # at most LANGUAGES * BUCKETS numbers
    keep = [c for c in rows.columns if c not in (text, out)]
    schema = rows.select(*keep, F.array().cast("array<double>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for b in batches:
            found = []
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                code, row = _triples(part.column(part.schema.get_field_index(text)))
                n = np.maximum(1, np.bincount(row, minlength=part.num_rows))
                sums = np.stack([np.bincount(row, x[code], minlength=part.num_rows) for x in logs], axis=1) if len(languages) else np.zeros((part.num_rows, 0))
                found += (sums / n[:, None] * np.minimum(n, EFFECTIVE)[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def _code(c: Column) -> Column:
    """A language code of two or three letters, without its region; empty for anything else.  There are 18 252 of them."""
    return F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})?$", 1)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` with (lang, probability, text_lang) in place of their evidence.

    ``rows`` has text, declared (language), suffix (the first part of the address's path) and host, any of which may be
    null or empty: such evidence says nothing, and so do declarations and suffixes that are no codes of two or three
    letters, with or without a region.  Hosts that differ in capital letters are one.  text_lang is what the text alone
    says, null for a text of fewer than three bytes; of equally likely languages the first in order counts.  Texts of any
    length are read whole.  Other columns pass through, but for those named like an output, which are replaced; every
    row gives one row.  Without languages in the model lang is null.
    """
    languages, _ = model
    made = ("lang", "probability", "text_lang")
    ids = [q for c, q in zip(rows.columns, quoted(rows), strict=True) if c not in ("text", "declared", "suffix", "host", *made)]
    host = F.lower(F.coalesce("host", F.lit("")))
    own = rows.select(F.struct(*([F.col(c) for c in ids] or [F.lit(0).alias("none")])).alias("keep"), "text", _code(F.col("declared")).alias("declared"), _code(F.col("suffix")).alias("part"), host.alias("host"))
    kept = ["keep.*"] if ids else []
    if not languages:
        return own.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(made, ("string", "double", "string"), strict=True)])
    k = len(languages)
    labels = F.split("host", r"\.")
    own = own.withColumn("ending", F.when(F.size(labels) > 1, _code(F.element_at(labels, -1))).otherwise(F.lit("")))
    own = materialize(with_likelihoods(own, model, "text", "said"))
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    own = own.withColumn("vote", F.when(F.array_max("said") > F.array_min("said"), best(F.col("said"))))

    def counts(*by: str) -> DataFrame:
        """How many rows of each group are in each language, going by their texts."""
        return own.groupBy(*by).agg(F.array(*[F.count_if(F.col("vote") == i).cast("double") for i in range(k)]).alias("n"))

    add = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + w * y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = lambda a: let(total(a), lambda t: F.transform(a, lambda x: x / t))
    # Counts of hosts and their domains.
    hosts = counts("host").withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))
    hosts = materialize(hosts)
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(k)]).alias("wide"))
    hosts = hosts.join(domains, "domain").select("host", "n", "wide")
    everything = F.array(*[F.lit(float(x)) for x in (counts().first()["n"])])
    if hosts.count() <= BROADCAST_HOSTS:
        found = own.join(F.broadcast(hosts), "host")
    else:
        found = own.withColumn("salt", F.pmod(F.xxhash64("said", "keep"), F.lit(SALTS)).cast("int"))
        found = found.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
    found = found.withColumn("own", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("vote"), F.lit(1.0)).otherwise(F.lit(0.0))))
    others = lambda a: add(a, F.col("own"), F.lit(-1.0))
    smooth = lambda n, wider: let(others(n), lambda x: scaled(add(x, wider, F.lit(PRIOR))))
    log = lambda a: F.transform(a, lambda x: F.log(x))
    prior = let(scaled(F.transform(others(everything), lambda x: x + 1.0)), lambda all_: let(smooth(F.col("wide"), all_), lambda wide: log(smooth(F.col("n"), wide))))
    terms = [F.col("said"), prior]
    # What a code says: how often the other rows of each language have it.
    for c in ("declared", "ending", "part"):
        found = found.join(F.broadcast(counts(c).select(c, F.col("n").alias(f"n_{c}"))), c)  # codes: at most 18 253
        given = F.zip_with(F.col(f"n_{c}"), everything, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        given = F.zip_with(given, F.col("own"), lambda s, o: F.log((s["x"] - o + 0.5) / (s["y"] - o + 1.0)))
        terms.append(F.when(F.col(c) == "", F.array_repeat(F.lit(0.0), k)).otherwise(given))
    posterior = terms[0]
    for t in terms[1:]:
        posterior = add(posterior, t, F.lit(1.0))
    names = F.array(*[F.lit(x) for x in languages])
    found = found.select("keep", "vote", posterior.alias("p"))
    chance = let(F.array_max("p"), lambda top: 1 / total(F.transform("p", lambda x: F.exp(x - top))))
    return found.select(*kept, F.get(names, best(F.col("p"))).alias("lang"), chance.alias("probability"), F.get(names, F.col("vote")).alias("text_lang"))


def languages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, doc_id, page_id, held_out, lang, probability, text_lang) for every document and every page.

    A document has its source for host; a page has its url's host, the language its markup declares, and the first part
    of its url's path where that is a code of two letters, with or without a region.  The model is of the documents that
    aren't held out; document labels are used for nothing else.  Null ids, texts and urls, and repeated rows, each get a
    row; empty tables give none.  Other columns are not read.
    """
    model = train(docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    none = lambda t: F.lit(None).cast(t)
    a = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long"), none("long").alias("page_id"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text"), none("string").alias("declared"), none("string").alias("suffix"), F.col("source").alias("host"))
    b = pages.select(
        F.lit("page").alias("kind"), none("long").alias("doc_id"), F.col("page_id").cast("long"), F.lit(True).alias("held_out"), plain_text(F.col("html")).alias("text"),
        F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang=["']?([a-z]{2,3}(?:-[a-z0-9]{2,8})?)""", 1).alias("declared"), F.regexp_extract(path_of(F.col("url")), r"^/([A-Za-z]{2}(?:[-_][A-Za-z]{2})?)(?:/|$)", 1).alias("suffix"), host_of(F.col("url")).alias("host"),
    )
    return identify(a.unionByName(b), model)
