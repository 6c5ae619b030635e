"""The pipeline's near-dedup stage against brute force: five words a shingle, exact Jaccard of at least 0.8."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from seqlake.llm import common, near_copies, simhash
from seqlake.llm.common import table


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def brute_kept(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {min((rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None), default=None) for r in set(root)}


def test_shingle_sets_are_those_of_brute_force():
    texts = ["a b c d e f a b c d e", "A B\tc", "", None, " \n ", "a", "one two three four five six"]
    h, ends = near_copies.shingles_of(near_copies.lowered(pa.array(texts, pa.string())))
    n = [len(set(h[x:y].tolist())) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert n == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("nodes", [2048, 9])
def test_stage_links_at_eight_tenths(spark, sf_dir, monkeypatch, nodes):
    """Copies with scattered edits are more than four bits apart, and pairs just below the similarity stay."""
    monkeypatch.setattr(near_copies, "PART_NODES", nodes)  # few nodes: many cells
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        w = new(300)
        rows.append(w)
        for edits in (1, 4, 6, 7, 20):
            v = list(w)
            for j in rng.sample(range(300), edits):
                v[j] = f"x{rng.randrange(100_000)}"
            rows.append(v)
    chain = new(300)
    for _ in range(30):  # each is near the one before it, the ends are far apart
        rows.append(list(chain))
        chain[rng.randrange(300)] = "y"
        chain[rng.randrange(300)] = "z"
    rows += [new(3), new(4), []] * 2
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == brute_kept(rows)


def test_stage_on_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.01")
    assert {r.doc_id for r in kept.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_rough_input(spark, rough, sf_dir):
    kept = corpus_pipeline.near_dedup(spark, rough, sf_dir)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == rough.columns and ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 8 in ids
    assert corpus_pipeline.near_dedup(spark, rough.limit(0), sf_dir).collect() == []


def test_candidates_are_those_of_simhash(spark, sf_dir, monkeypatch):
    """Groups that the stage compares come from the trees over fingerprints; what those don't give, nothing else does."""
    given, near = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda *a: (given.append(a), near(*a))[1])
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {1, 3}
    assert len(given) == 1 and given[0][1:] == (near_copies.RADIUS, near_copies.SHARD_ROWS, 0.8)
    monkeypatch.setattr(simhash, "linked", lambda *a: near(*a).where("node is null"))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {1, 2, 3}


@pytest.mark.parametrize("sizes", [(4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (18, 18, 16), (90, 90, 80), (900, 900, 800), (80, 100, 80)])
def test_similar_sets_are_within_the_radius(sizes):
    """Pairs at 0.8, or just above it where sets are too small for that."""
    rng = np.random.default_rng(5)
    a, b, both = sizes
    n = 2000
    h = rng.integers(0, 1 << 64, (n, a + b - both), dtype=np.uint64)
    first, second = (simhash.wide_fingerprints(np.ascontiguousarray(x).ravel(), np.arange(1, n + 1) * x.shape[1]) for x in (h[:, :a], h[:, a - both :]))
    d = np.bitwise_count(first ^ second).sum(axis=1)
    assert 15 < d.mean() < 38 and d.max() <= near_copies.RADIUS


@pytest.mark.parametrize("shard_rows", [64, 4096])
def test_trees_over_wide_fingerprints_and_sizes(spark, shard_rows):
    rng = np.random.default_rng(6)
    sets = []
    for k in range(120):
        base = rng.integers(0, 1 << 64, int(4 * 1.06**k), dtype=np.uint64)
        sets += [base, base[: -max(1, len(base) // 8)], np.append(base, rng.integers(0, 1 << 64, 1 + len(base) // 8, dtype=np.uint64)), base[: len(base) // 2]]
    prints = simhash.wide_fingerprints(np.concatenate(sets), np.cumsum([len(s) for s in sets]))
    rows = [(int(i), len(s), f.tobytes()) for i, (s, f) in enumerate(zip(sets, prints, strict=True))]
    unique = near_copies.materialize(spark.createDataFrame(rows, "node long, size int, fingerprint binary"))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 60 and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.node: r.root for r in simhash.linked(unique, 60, shard_rows, 0.8).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == root and len(set(root)) < 0.6 * len(rows)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_by_their_numbers(spark, monkeypatch, most):
    """By masks that every task gets, and by shuffle beyond their limit."""
    monkeypatch.setattr(common, "BROADCAST_MASKS", most)
    ids = [x for k in (0, 1, 5, (1 << 30) - 1) for x in ((k << 33) + np.array([0, 1, 62, 63, 64, 127, 128, 32767, 32768])).tolist()]
    df = spark.createDataFrame([(x, "t", 1, 2) for x in ids], "row long, word string, mask int, `a.b` int")
    wanted = [x for x in ids if x % 64 in (0, 63) and x >> 33 != 1]
    got = common.only_rows(df, "row", spark.createDataFrame([(x,) for x in wanted * 2], "row long"))
    assert got.columns == df.columns and sorted(r.row for r in got.collect()) == sorted(wanted)
    assert common.only_rows(df, "row", df.select("row").limit(0)).count() == 0


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Neither as sets are made nor in the result, even where no table is small enough for Spark to send it of its own accord."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, plans = near_copies._sets, []
        monkeypatch.setattr(near_copies, "_sets", lambda *a: (out := made(*a), plans.append(out))[0])
        text = " ".join(f"w{i}" for i in range(200))
        docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other")], "doc_id long, text string")
        kept = near_copies.keep_first(docs)
        assert {r.doc_id for r in kept.collect()} == {1, 3} and len(plans) == 1
        for df in (kept, plans[0]):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
