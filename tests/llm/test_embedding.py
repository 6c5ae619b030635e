import numpy as np

from seqlake.llm import embedding_dedup


def brute(rows, t):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, ok, strict=True)]
    n = len(rows)
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= t for j in range(n)] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if link[i][j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    comp = [min((rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return sorted(((k, sum(link[i]), comp[i], k == comp[i]) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, rows, **args):
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, node int, weight string")
    out = embedding_dedup.link(df, **args)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=str) == brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows], args.get("threshold", 0.95))


def test_rough_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [2.0, 0.0]),
                  (11, [1.0, 0.0]), (11, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, [0.0, 1.0]), (12, [0.0, 1.0]), (13, [-1.0, 0.001]), (14, [5.0]), (15, [-5.0]), (16, [7.0])])
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_clusters_and_chains(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOME_ROWS", 16)  # many parts
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + rng.normal(size=16) * 0.25).tolist()) for i in range(20)]
    rows += [(1000 + i, [float(np.cos(i / 5)), float(np.sin(i / 5))] + [0.0] * 14) for i in range(31)]  # a chain around a circle
    check(spark, rows)
    check(spark, rows, threshold=0.9, blocks=3)


def test_components_of_any_size(spark):
    rows = [(1, [1e200, 1e198]), (2, [1e-200, 0.0]), (3, [3.0, 0.01]), (4, [5e-324, 0.0]), (5, [0.0, 1e300])]
    out = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, out)) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)]


def test_cells_bring_every_near_pair_together():
    rng = np.random.default_rng(2)
    for centres, noise in ((1, 1.0), (40, 0.05)):
        x = rng.normal(size=(centres, 6))[rng.integers(0, centres, 1500)] + noise * rng.normal(size=(1500, 6))
        tree = embedding_dedup._split(x[:500], 0.2, 6)
        cells = embedding_dedup._deal(tree, x, 0.04)
        assert sorted(np.concatenate([h for h, _ in cells]).tolist()) == list(range(1500))
        met = {(min(a, b), max(a, b)) for home, others in cells for a in home.tolist() for b in [*home.tolist(), *others.tolist()] if a != b}
        d = ((x[:, None] - x[None, :]) ** 2).sum(axis=2)
        near = set(zip(*(v.tolist() for v in np.nonzero(np.triu(d <= 0.04, 1))), strict=True))
        assert near <= met and (len(met) < 1500 * 1499 / 2 * (1 if centres == 1 else 0.3))


def test_many_cells_lengths_and_key_types(spark, monkeypatch):
    """Small cells and parts, vectors of several lengths, text keys, and vectors whose keys are all null."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "HOME_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 24)
    rng = np.random.default_rng(4)
    rows = []
    for d in (3, 8):
        base = rng.normal(size=(60, d))
        for i in range(260):
            rows.append((f"k{len(rows):04d}" if i % 13 else None, (base[i % 60] + rng.normal(size=d) * 0.1 * (i % 5)).tolist()))
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), ("x", None), ("y", [0.0, 0.0])]
    out = embedding_dedup.link(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), blocks=2).collect()
    links, root = [0] * len(rows), list(range(len(rows)))
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    small = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    want = sorted(repr((rows[i][0], links[i], small[i])) for i in range(len(rows)))
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in out) == want
