"""SimHash near-duplicates: exact pairs within a Hamming radius, found through vantage-point trees.

A vantage-point tree splits fingerprints by their distance from a chosen fingerprint.  The top of the tree is grown on
a bounded sample and only says where rows go: every fingerprint has one home shard, and is a query in each shard that
the triangle inequality cannot rule out.  Inside a shard the same split goes on until blocks are small enough to be
compared outright.  No sample decides which pairs are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import with_position
from .common import components, fresh, local_roots, materialize, quoted

#: Fingerprints in the sample that the top of the tree is grown on; the top's size, and so what tasks get, is bounded by it.
TREE_SAMPLE = 20_000
#: Comparisons in one block inside a shard.
BLOCK = 1 << 21
#: 64-bit words of a wide fingerprint; a byte holds the differing bits of three.
WIDE = 3


def _bits_of_bytes() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprints_of(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """SimHash of each text, as uint64.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is ``shingle`` words joined by a space, with
    repeats; fewer words make one shingle, no word gives zero.  A bit is set if it is set in over half of the XXH64
    (seed 42) values.  Null is an empty text.
    """
    out, table, digest = np.zeros(len(texts), np.uint64), _bits_of_bytes(), xxhash.xxh64_intdigest
    texts = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    for at in range(0, len(texts), 256):
        lists = pc.ascii_split_whitespace(texts.slice(at, 256))
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, doc, size = flat.filter(pa.array(size > 0)), doc[size > 0], size[size > 0]
        if not len(doc):
            continue
        joined = " ".join(flat.to_pylist()).encode()
        end = np.cumsum(size + 1) - 1
        start, n = end - size, np.bincount(doc, minlength=len(lists))
        last = np.cumsum(n)
        first = np.arange(len(doc))
        stop = np.minimum(first + shingle, last[doc])  # past the shingle's last word
        keep = (first + shingle <= last[doc]) | (first == (last - n)[doc])
        spans = zip(start[keep].tolist(), end[stop[keep] - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[x:y], 42) for x, y in spans), np.uint64, count=int(keep.sum()))
        doc = doc[keep]
        total, bits = np.bincount(doc, minlength=len(lists)), np.zeros(len(lists), np.uint64)
        for k, byte in enumerate(h.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            ones = np.bincount(doc * 256 + byte, minlength=len(lists) * 256).reshape(-1, 256) @ table
            for j in range(8):
                bits |= (2 * ones[:, j] > total).astype(np.uint64) << np.uint64(8 * k + j)
        out[at : at + len(lists)] = bits
    return out


def wide_fingerprints(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of ``WIDE`` words for each set of the hashes ``h`` that end at ``ends``: SimHash of more hashes made from each one.

    A bit is set if it is set in over half of the set's hashes; an empty set has zeros.
    """
    out, table, total = np.zeros((len(ends), WIDE), np.uint64), _bits_of_bytes().astype(np.float64), np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), total) * 256
    for w in range(WIDE):
        mixed = (h ^ np.uint64(w + 1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        for k, byte in enumerate(mixed.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            ones = np.bincount(doc + byte, minlength=len(ends) * 256).reshape(-1, 256) @ table
            for j in range(8):
                out[:, w] |= (2 * ones[:, j] > total).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """``docs`` with a long column ``out`` of SimHash bits; other columns pass through.  A column of that name is replaced."""
    docs = docs.drop(out)
    schema = docs.select("*", F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = fingerprints_of(b.column(b.schema.get_field_index(text)), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f.view(np.int64))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def _apart(f: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Bits in which each fingerprint of ``f`` differs from ``point``; a row of ``f`` for each 64-bit word."""
    return np.bitwise_count(f ^ point[:, None]).sum(axis=0, dtype=np.int64)


def _split(f: np.ndarray, size: np.ndarray, least: float, points: int, seen: int):
    """(point, bound, which are near) of a split in two; None where no split tells any apart.

    The point that tells most of some fingerprints apart, but while sizes differ by more than linked ones may it is the
    empty set, written None: a set's distance from that is its size.
    """
    point, d = None, size
    if size.max() * least <= size.min():
        some, others = f[:, :: max(1, f.shape[1] // points)][:, :points], f[:, :: max(1, f.shape[1] // seen)]
        point = some[:, np.argmax([_apart(others, x).var() for x in some.T])]  # that tells most apart
        d = _apart(f, point)
    mid = int(np.median(d))
    if not 0 < (d <= mid).sum() < len(d):
        mid -= 1
    near = d <= mid
    return (point, mid, near) if 0 < near.sum() < len(d) else None


def _reach(f: np.ndarray, size: np.ndarray, point, mid: int, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which queries may have links on the near and on the far side.  Of two sizes the larger one is the query."""
    if point is None:
        return size * least <= mid + 1e-6, size > mid
    d = _apart(f, point)
    return d - radius <= mid, d + radius > mid


def _grow(sample: np.ndarray, depth: int, size: np.ndarray | None = None, least: float = 0.0) -> list:
    """The top of a vantage-point tree, a tuple (point, median, near, far) at each node; None is a shard.

    ``sample`` has a number for each fingerprint, or a row for each of its words.
    """

    def grow(f: np.ndarray, size: np.ndarray, depth: int):
        if depth == 0 or f.shape[1] < 4 or (cut := _split(f, size, least, 16, f.shape[1])) is None:
            return None
        point, mid, near = cut
        return (point, mid, *(grow(f[:, m], size[m], depth - 1) for m in (near, ~near)))

    f = np.atleast_2d(sample)
    return grow(f, np.zeros(f.shape[1], np.int64) if size is None else size, depth)


def _route(node, f: np.ndarray, size: np.ndarray, rows: np.ndarray, radius: int, least: float, home: np.ndarray, shard: int, out: list) -> int:
    """Append (shard, rows, is home) for each shard that the rows reach; returns the next shard's number."""
    if node is None:
        out.append((shard, rows, home))
        return shard + 1
    point, mid, near, far = node
    a, b = _reach(f[:, rows], size[rows], point, mid, radius, least)
    own = (size[rows] if point is None else _apart(f[:, rows], point)) <= mid
    shard = _route(near, f, size, rows[a], radius, least, (home & own)[a], shard, out)
    return _route(far, f, size, rows[b], radius, least, (home & ~own)[b], shard, out)


#: What a shard holds of its rows: nodes, sizes, and a row for each word of the fingerprints.
_Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def _some(part: _Part, which: np.ndarray) -> _Part:
    return part[0][which], part[1][which], part[2][:, which]


def _search(home: _Part, query: _Part, radius: int, least: float, links: list) -> None:
    """Links between ``home`` and ``query`` within ``radius``, by a vantage-point tree of ``home``."""
    n, m = len(home[0]), len(query[0])
    if not n or not m:
        return
    if n <= 48 or n * m <= BLOCK // 8 or (cut := _split(home[2], home[1], least, 8, 256)) is None:
        _compare(home, query, radius, least, links)
        return
    point, mid, near = cut
    a, b = _reach(query[2], query[1], point, mid, radius, least)
    _search(_some(home, near), _some(query, a), radius, least, links)
    _search(_some(home, ~near), _some(query, b), radius, least, links)


def _compare(home: _Part, query: _Part, radius: int, least: float, links: list) -> None:
    step = max(1, BLOCK // (1 if len(home[2]) == 1 else 64) // len(home[0]))
    for i in range(0, len(query[0]), step):
        d = np.bitwise_count(query[2][0, i : i + step, None] ^ home[2][0, None, :])
        for x, y in zip(query[2][1:], home[2][1:], strict=True):  # at most WIDE words: a byte holds the sum
            d += np.bitwise_count(x[i : i + step, None] ^ y[None, :])
        q, h = np.nonzero(d <= radius)
        a, b, x, y = query[0][i + q], home[0][h], query[1][i + q], home[1][h]
        ok = (a != b) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-6)
        a, b = a[ok], b[ok]
        if len(a):
            nodes, roots = local_roots(a, b)  # a spanning star says as much as all pairs
            links.append((nodes[nodes != roots], roots[nodes != roots]))


def similar_groups(prints: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """(fingerprint, root) for each distinct fingerprint linked to another one within ``radius`` bits, directly or by steps.

    ``prints`` has a long column fingerprint; nulls are ignored, repeats count once, and an empty input gives no rows.
    root is the group's smallest fingerprint as a signed number.
    """
    unique = prints.select("fingerprint").where("fingerprint is not null").distinct()
    return linked(materialize(unique.withColumn("node", F.col("fingerprint"))), radius, shard_rows).withColumnRenamed("node", "fingerprint")


def linked(unique: DataFrame, radius: int = 4, shard_rows: int = 4096, least: float = 0.0) -> DataFrame:
    """(node, root) for each node linked to another one; root is the smallest node that it is linked to, itself included.

    ``unique`` is a written table of fingerprints, long or of ``WIDE`` 64-bit words in a binary, with a long column
    node, which is distinct; long fingerprints are distinct as well.  With ``least`` it has the sets' sizes, too, in an
    integer column size, and two nodes are linked only if the lesser size is at least that share of the other.
    """
    count, sized, wide = unique.count(), least > 0, unique.schema["fingerprint"].dataType.typeName() == "binary"
    depth = max(0, int(np.ceil(np.log2(max(1, count) / shard_rows))))
    size_of = [F.col("size").cast("long").alias("size")] if sized else []

    def numbers(prints) -> np.ndarray:
        return np.frombuffer(b"".join(prints), np.int64).reshape(-1, WIDE) if wide else np.asarray(prints, np.int64).reshape(-1, 1)

    def part(rows: np.ndarray) -> _Part:
        size = rows[:, 1] if sized else np.zeros(len(rows), np.int64)
        return rows[:, 0], size, np.ascontiguousarray(rows[:, 1 + sized :].T).view(np.uint64)

    # A sample by hash, which says nothing of where a fingerprint lies.  It bounds the tree: nodes of fewer than 4 don't split.
    mark = F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 40))
    sample = unique.select("fingerprint", *size_of, mark.alias("mark")).where(F.col("mark") <= int(min(1.0, 2 * TREE_SAMPLE / max(1, count)) * (1 << 40))).orderBy("mark", "fingerprint").limit(TREE_SAMPLE)
    sample = sample.collect() if depth else []
    top = np.ascontiguousarray(numbers([r["fingerprint"] for r in sample]).T).view(np.uint64)
    tree = _grow(top, depth, np.array([r["size"] for r in sample], np.int64), least) if sized else _grow(top if wide else top[0], depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = numbers(b.column(0).to_pylist() if wide else b.column(0).to_numpy())
            rows = np.column_stack([*(b.column(k).to_numpy() for k in range(1, 2 + sized)), prints])
            (_, size, f), out = part(rows), []
            _route(tree, f, size, np.arange(len(rows)), radius, least, np.ones(len(rows), bool), 0, out)
            out = [(shard, rows[own[home]].tobytes(), rows[own].tobytes()) for shard, own, home in out if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "home", "query"])

    # A row is a block: what a batch of fingerprints, with their nodes, has for a shard.
    routed = materialize(unique.select("fingerprint", "node", *size_of).mapInArrow(route, "shard int, home binary, query binary"))
    width = 8 * (1 + sized + (WIDE if wide else 1))
    # Each shard's home blocks are dealt into parts of bounded size, and each part meets the queries in parts as well.
    sizes = routed.groupBy("shard").agg(F.sum(F.octet_length("home") / width).alias("h"), F.sum(F.octet_length("query") / width).alias("q"))
    parts = sizes.select("shard", F.ceil(F.greatest(F.col("h"), F.lit(1)) / (4 * shard_rows)).cast("int").alias("hs"), F.ceil(F.greatest(F.col("q"), F.lit(1)) / (32 * shard_rows)).cast("int").alias("qs"))
    cells = routed.join(F.broadcast(parts), "shard")  # shards: at most half of TREE_SAMPLE
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(b"")
    as_home = cells.where(F.octet_length("home") > 0).select("shard", deal("home", "hs").alias("i"), all_of("qs").alias("j"), "home", none.alias("query"))
    as_query = cells.select("shard", all_of("hs").alias("i"), deal("query", "qs").alias("j"), none.alias("home"), "query")

    def search(t: pa.Table) -> pa.Table:
        home, query = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("home", "query"))
        links: list = []
        if len(home) and len(query):
            _search(*(part(x.reshape(-1, width // 8)) for x in (home, query)), radius, least, links)
        a, b = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (0, 1))
        if len(a):
            nodes, roots = local_roots(a, b)
            a, b = nodes[nodes != roots], roots[nodes != roots]
        return pa.table({"a": a, "b": b})

    links = as_home.unionByName(as_query).groupBy("shard", "i", "j").applyInArrow(search, "a long, b long")
    return components(links)


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) per row: fingerprint as 16 hex digits, component_id the smallest key reachable
    over links of at most ``radius`` differing bits.

    Empty and null texts have fingerprint zero and link like any other; very long ones are read whole.  Keys are whole
    numbers up to 2**62, or of any type that has an order.  Repeated rows and keys each get a row; a null key gets a row
    and is never a component's smallest key unless all its keys are null.  Other columns are not read.
    """
    prints = materialize(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", shingle=shingle).drop("text"))
    kind = prints.schema["key"].dataType
    unique = prints.groupBy("fingerprint").agg(F.min("key").alias("first"))
    if integral := kind.typeName() in ("byte", "short", "integer", "long"):
        # A fingerprint is a node, named by its smallest key; those without any key come after all others.
        top = prints.agg(F.max("key").cast("long")).first()[0]
        keyless = max(0, (top if top is not None else -1) + 1)
        unique = materialize(unique.withColumn("node", F.coalesce(F.col("first").cast("long"), F.lit(keyless).cast("long") + F.monotonically_increasing_id())))
    else:
        unique = materialize(with_position(unique.withColumn("none", F.col("first").isNull()), "none", "first", "fingerprint", name="node").drop("none"))
    named = unique.join(linked(unique, radius), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if integral:
        named = named.withColumn("component_id", F.when(F.col("root") < keyless, F.col("root")))
    else:
        named = named.join(unique.select(F.col("node").alias("root"), F.col("first").alias("component_id")), "root")
    by_print = named.select("fingerprint", F.col("component_id").cast(kind).alias("component_id"))
    return prints.join(by_print, "fingerprint").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near-copies: that with the smallest key; all columns of ``docs``.

    Rows that repeat the smallest key of a group stay once.  Null keys come after all others.
    """
    mark, row = fresh(docs, "fingerprint"), fresh(docs, "row")
    own = materialize(with_fingerprint(docs, text, mark, shingle).withColumn(row, F.monotonically_increasing_id()))
    prints = own.select(F.col(mark).alias("fingerprint"), F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r")).alias("rank"))
    # One row for each fingerprint first; nodes are in order of these, so a group's smallest node is the one to keep.
    first = prints.groupBy("fingerprint").agg(F.min("rank").alias("rank")).select("fingerprint", "rank.*")
    unique = materialize(with_position(first, "n", "k", "r", name="node"))
    lesser = linked(unique.select("fingerprint", "node"), radius).where("node <> root").select("node")
    winners = unique.join(lesser, "node", "left_anti").select(F.col("r").alias(row))
    return own.join(winners, row, "left_semi").select(*quoted(docs))
