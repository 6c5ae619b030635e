"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of length one with a cosine of at least ``t`` are at most ``2 - 2t`` apart, squared.  After a rotation the
coordinates are dealt into blocks, and each block gets a budget of that squared distance in proportion to its variance;
two vectors within the distance are within budget in one block at least.  In each block a tree of cells, split along
whichever of its axes parts a sample best, is the range join: a vector is at home in one cell, and a query in each later
cell whose box is within the budget of it, over all axes that the box is bounded on.  Candidates are then compared in
double precision over all coordinates, each pair in the first block that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import with_position
from .common import components, local_roots, materialize

#: Vectors that the rotation and the cells are fitted on, and numbers in them, at most; any give the same links.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000
#: Vectors that a cell should hold, and vectors of the sample that it needs at least.
CELL_ROWS, CELL_SAMPLE = 8_192, 8
#: Rows of a cell compared in one task, as the ones and as the others.
HOME_ROWS, QUERY_ROWS = 8_192, 32_768
_SLACK, _SINGLE = 1e-9, 1e-5
#: A cut that leaves a larger share of the sample within reach of it isn't worth its copies.
PAYS = 0.85
#: Pairs compared, and candidates held, at a time.
_TILE = 1 << 19


class Blocks:
    """The rotation of one dimension's vectors, its blocks with their budgets, and the blocks' cells for ``rows`` vectors."""

    def __init__(self, sample: np.ndarray, distance: float, blocks: int, rows: int = 0):
        d = sample.shape[1]
        sample = _scaled(sample)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(np.cov(unit.T).reshape(d, d) + 1e-12 * np.eye(d))
        order = np.argsort(-values)
        values, self.rotation = np.maximum(values[order], 1e-9), np.ascontiguousarray(vectors[:, order])
        blocks = max(1, min(blocks, d))
        turn = np.arange(d) % (2 * blocks)
        own = np.where(turn < blocks, turn, 2 * blocks - 1 - turn)  # dealt to and fro, so that variances even out
        self.axes = [np.flatnonzero(own == b) for b in range(blocks)]
        share = np.array([values[a].sum() for a in self.axes])
        self.budget = distance * (1 + _SLACK) * share / share.sum() + _SLACK / blocks
        depth = max(0, int(np.ceil(np.log2(max(1, rows) / CELL_ROWS))))
        turned = self.turned(unit)
        self.cells = [_split(turned[:, a], np.sqrt(m), depth) for a, m in zip(self.axes, self.budget, strict=True)]

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation

    def first_block(self, difference: np.ndarray) -> np.ndarray:
        """The first block in which each difference is within budget."""
        out = np.zeros(len(difference), np.int64)
        for at in range(0, len(difference), 4096):
            turned = np.einsum("pd,de->pe", difference[at : at + 4096], self.rotation, optimize=False)
            inside = np.stack([(turned[:, a] ** 2).sum(axis=1) <= m for a, m in zip(self.axes, self.budget, strict=True)])
            out[at : at + 4096] = inside.argmax(axis=0)
        return out


def _split(x: np.ndarray, reach: float, depth: int) -> tuple | None:
    """A tree of cells: (axis, cut, cells below it, cells from it on), or None for one cell.

    The cut is the median along the axis that leaves the fewest vectors within reach of it.
    """
    if depth <= 0 or len(x) < 2 * CELL_SAMPLE:
        return None
    cuts = np.median(x, axis=0)
    near = (np.abs(x - cuts) <= reach).mean(axis=0)
    axis = int(near.argmin())
    below = x[:, axis] < cuts[axis]
    if near[axis] > PAYS or not below.any() or below.all():
        return None
    return axis, float(cuts[axis]), _split(x[below], reach, depth - 1), _split(x[~below], reach, depth - 1)


def _deal(tree: tuple | None, x: np.ndarray, budget: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cell its rows: those at home, and those of earlier cells that are within ``budget`` of its box."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    home_of = np.full(len(x), -1, np.int64)

    def walk(node, rows: np.ndarray, home: np.ndarray, over: dict[int, np.ndarray]) -> None:
        if node is None:
            home_of[rows[home]] = len(out)
            out.append((rows[home], rows[~home & (home_of[rows] >= 0)]))  # earlier cells have said what is at home in them
            return
        axis, cut, below, above = node
        side = x[rows, axis] - cut
        for child, beyond, mine in ((below, np.maximum(side, 0), side < 0), (above, np.maximum(-side, 0), side >= 0)):
            new = over | {axis: np.maximum(over[axis], beyond) if axis in over else beyond}
            keep = sum(v**2 for v in new.values()) <= budget
            walk(child, rows[keep], (home & mine)[keep], {k: v[keep] for k, v in new.items()})

    walk(tree, np.arange(len(x)), np.ones(len(x), bool), {})
    return out


def _vectors(data: list[bytes], dim: int, kind: str) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(data), kind).reshape(-1, dim).astype(np.float64))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that squares of large and small components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _compare(home, query, plan: Blocks, block: int, threshold: float, counts: dict, links: list) -> None:
    """Count linked weights and collect spanning links; ``home`` and ``query`` are (node, at home, weight, vectors)."""
    (hn, _, hw, hx), (qn, qh, qw, qx) = home, query
    hu, qu = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (hx, qx))
    # Squared distance in the block less the budget, as one product of single precision, whose error the slack covers.
    axes, limit = plan.axes[block], plan.budget[block] + _SINGLE
    turn = np.ascontiguousarray(plan.rotation[:, axes])
    ht, qt = hu @ turn, qu @ turn
    hs, qs = ((x**2).sum(axis=1, keepdims=True) for x in (ht, qt))
    left = np.concatenate([qt, qs - limit, np.ones_like(qs)], axis=1).astype(np.float32)
    right = np.ascontiguousarray(np.concatenate([-2 * ht, np.ones_like(hs), hs], axis=1).astype(np.float32).T)
    step = max(1, _TILE // max(1, len(hn)))
    gain_h, gain_q = np.zeros(len(hn), np.int64), np.zeros(len(qn), np.int64)
    near: list = []
    held = 0
    for at in range(0, len(qn), step):
        hit = np.flatnonzero(left[at : at + step] @ right <= 0)
        near.append(hit + at * len(hn))
        held += len(hit)
        if held < _TILE and at + step < len(qn):
            continue
        q, h = np.divmod(np.concatenate(near), len(hn))
        near, held = [], 0
        once = ~qh[q] | (hn[h] < qn[q])
        q, h = q[once], h[once]
        found: list = []
        for k in range(0, len(q), 1 << 18):
            a, b = q[k : k + (1 << 18)], h[k : k + (1 << 18)]
            cosine = np.einsum("ij,ij->i", qx[a], hx[b]) / (np.sqrt(np.einsum("ij,ij->i", qx[a], qx[a])) * np.sqrt(np.einsum("ij,ij->i", hx[b], hx[b])))
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            mine = plan.first_block(qu[a] - hu[b]) == block
            a, b = a[mine], b[mine]
            np.add.at(gain_q, a, hw[b])
            np.add.at(gain_h, b, qw[a])
            if len(a):
                found.append(np.stack([qn[a], hn[b]]))
        if found:
            pairs = np.concatenate(found, axis=1)
            nodes, roots = local_roots(pairs[0], pairs[1])
            links.append(np.stack([nodes[nodes != roots], roots[nodes != roots]]))
    for i in np.flatnonzero(gain_q):
        counts[int(qn[i])] = counts.get(int(qn[i]), 0) + int(gain_q[i])
    for i in np.flatnonzero(gain_h):
        counts[int(hn[i])] = counts.get(int(hn[i]), 0) + int(gain_h[i])


def link(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.95, blocks: int = 4) -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``vectors``.

    n_links counts the other rows with a cosine of at least ``threshold`` (0 < threshold <= 1); component_id is the
    smallest key reachable over links, kept whether that is the row's own.  Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, as do those of different lengths with each other.  Equal vectors
    are compared once and counted as often as they occur.  Keys are whole numbers up to 2**62, or of any type that has
    an order.  A null key gets a row; its component_id is null only if all
    keys of its component are.  An empty table gives no rows.  Other columns are not read.
    """
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    own = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    # A vector is a node, named by its smallest key; those without any key come after all others.
    integral = own.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long")
    unique = own.where(good).groupBy("v").agg(F.min("key").alias("first"), F.count("*").alias("weight"))
    if integral:
        top = own.agg(F.max("key").cast("long")).first()[0]
        keyless = max(0, (top if top is not None else -1) + 1)
        unique = materialize(unique.withColumn("node", F.coalesce(F.col("first").cast("long"), F.lit(keyless).cast("long") + F.monotonically_increasing_id())))
    else:
        unique = materialize(with_position(unique.withColumn("none", F.col("first").isNull()), "none", "first", "v", name="node").drop("none"))
    sizes = {r["dim"]: r["n"] for r in unique.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans: dict[int, Blocks] = {}
    if sizes:
        wanted = {d: max(2, min(FIT_ROWS, FIT_NUMBERS // (len(sizes) * d))) for d in sizes}
        marks = F.broadcast(vectors.sparkSession.createDataFrame([(d, int(min(1.0, 2 * wanted[d] / n) * (1 << 20))) for d, n in sizes.items()], "dim int, below long"))  # lengths of vectors
        chosen = unique.withColumn("dim", F.size("v")).join(marks, "dim").where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.col("below"))
        sample: dict[int, list] = {d: [] for d in sizes}
        for r in chosen.select("dim", "v").toLocalIterator():
            if len(sample[r["dim"]]) < wanted[r["dim"]]:
                sample[r["dim"]].append(list(r["v"]))
        for d, rows in sample.items():
            few = rows if len(rows) > 1 else [list(r["v"]) for r in unique.where(F.size("v") == d).limit(2).collect()]
            plans[d] = Blocks(np.array(few if len(few) > 1 else few * 2, float), 2 - 2 * threshold, blocks, sizes[d])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, weight = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            lists = b.column(0)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)
            out: dict[str, list] = {c: [] for c in ("dim", "block", "cell", "home", "n", "nodes", "weights", "vectors")}
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[lists.offsets.to_numpy()[rows][:, None] + np.arange(d)[None, :]].astype(np.float64)
                plan = plans[int(d)]
                scaled = _scaled(x)
                turned = plan.turned(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
                for k, axes in enumerate(plan.axes):
                    for cell, both in enumerate(_deal(plan.cells[k], turned[:, axes], plan.budget[k] * (1 + 1e-6) + 1e-9)):
                        for home, i in zip((True, False), both, strict=True):
                            if len(i):
                                row = (int(d), k, cell, home, len(i), node[rows[i]].astype(np.int64).tobytes(), weight[rows[i]].astype(np.int64).tobytes(), x[i].astype(kind).tobytes())
                                for c, v in zip(out.values(), row, strict=True):
                                    c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    # A row holds what a batch of vectors has for a cell.  Queries are those at home too: pairs within a cell.
    routed = materialize(unique.select("v", "node", "weight").mapInArrow(route, "dim int, block int, cell int, home boolean, n long, nodes binary, weights binary, vectors binary"))
    place, load = ["dim", "block", "cell"], ["home", "nodes", "weights", "vectors"]
    counted = routed.groupBy(*place).agg(F.sum(F.when(F.col("home"), F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m"))
    parts = counted.where("n > 0").select(*place, F.ceil(F.col("n") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("m") / QUERY_ROWS).cast("int").alias("qs"))
    parts = F.broadcast(parts)  # cells: as many as the sample allows, some thousands for each block
    deal = lambda n: F.pmod(F.xxhash64("nodes"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    marked = routed.join(parts, place)
    as_home = marked.where("home").select(*place, deal("hs").alias("i"), every("qs").alias("j"), F.lit(True).alias("one"), *load)
    as_query = marked.select(*place, every("hs").alias("i"), deal("qs").alias("j"), F.lit(False).alias("one"), *load)

    def search(t: pa.Table) -> pa.Table:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        counts: dict[int, int] = {}
        links: list = []
        side = []
        for flag in (True, False):
            rows = t.filter(pa.array(np.asarray(t.column("one").to_numpy(zero_copy_only=False), bool) == flag))
            nodes = [np.frombuffer(x, np.int64) for x in rows.column("nodes").to_pylist()]
            at_home = np.repeat(np.array(rows.column("home").to_pylist(), bool), [len(x) for x in nodes])
            side.append((np.concatenate([*nodes, np.zeros(0, np.int64)]), at_home, np.frombuffer(b"".join(rows.column("weights").to_pylist()), np.int64), _vectors(rows.column("vectors").to_pylist(), dim, kind)))
        if len(side[0][0]) and len(side[1][0]):
            _compare(*side, plans[dim], block, threshold, counts, links)
        a = np.concatenate([x[0] for x in links] or [np.zeros(0, np.int64)])
        b = np.concatenate([x[1] for x in links] or [np.zeros(0, np.int64)])
        if len(a):
            nodes, roots = local_roots(a, b)
            a, b = nodes[nodes != roots], roots[nodes != roots]
        return pa.table({"link": pa.array([False] * len(counts) + [True] * len(a), pa.bool_()), "a": pa.array([*counts, *a.tolist()], pa.int64()), "b": pa.array([*counts.values(), *b.tolist()], pa.int64())})

    found = materialize(as_home.unionByName(as_query).groupBy(*place, "i", "j").applyInArrow(search, "link boolean, a long, b long"))
    groups = components(found.where("link").select("a", "b"))
    linked = found.where("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("partners"))
    named = unique.join(groups, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if integral:  # the smallest node of a component is named by its smallest key
        named = named.withColumn("component_id", F.when(F.col("root") < keyless, F.col("root")))
    else:
        named = named.join(unique.select(F.col("node").alias("root"), F.col("first").alias("component_id")), "root")
    by_vector = named.select("v", (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("component_id").cast(own.schema["key"].dataType).alias("component_id"))
    out = own.withColumn("v", F.when(good, F.col("v"))).join(by_vector, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b AS vec_id, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.vec_id = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id
"""
