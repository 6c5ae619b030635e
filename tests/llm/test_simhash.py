import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import simhash
from seqlake.llm.common import components, local_roots


def brute_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """prints: (key, fingerprint) -> smallest key of each row's component."""
    n, root = len(prints), list(range(len(prints)))
    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [min((prints[j][0] for j in range(n) if root[j] == root[i] and prints[j][0] is not None), default=None) for i in range(n)]


def test_fingerprints_are_by_the_contract(rough):
    texts = [r.text for r in rough.collect()] + ["A B c", "a\x0bb\x0cc d e", "İ K É"]
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [brute_print(t) for t in texts]
    assert len(simhash.fingerprints_of(pa.array([], pa.string()))) == 0


def test_groups_match_brute_force(spark, rough):
    rows = [(r.doc_id, brute_print(r.text)) for r in rough.collect()]
    out = simhash.simhash_dedup(rough).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = sorted([(k, "%016x" % p, c) for (k, p), c in zip(rows, brute_components(rows), strict=True)], key=key)
    assert sorted(map(tuple, out), key=key) == expected
    assert simhash.simhash_dedup(rough.limit(0)).collect() == []


def test_planted_neighbours_across_shards(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(3000)]
    for p in prints[:150]:
        q = p
        for b in rng.sample(range(64), rng.choice((1, 3, 4, 5))):
            q ^= 1 << b
        prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {}
    for r in simhash.similar_groups(df, 4, shard_rows=64).collect():  # many small shards
        got.setdefault(r.root, set()).add(r.fingerprint & (1 << 64) - 1)
    x = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    nodes, roots = local_roots(x[a], x[b])
    want = {}
    for n, r in zip(nodes.tolist(), roots.tolist(), strict=True):
        want.setdefault(r, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 100


def test_one_of_each_group_stays_with_all_columns(rough):
    kept = simhash.keep_first(rough)
    assert kept.columns == rough.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 8 in ids  # 3, 4 and 5 have no words
    assert simhash.keep_first(rough.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7), (None, 3), (100, 101)]
    df = spark.createDataFrame(links, "a long, b long")
    clean = [(a, b) for a, b in links if a is not None and a != b]
    nodes, roots = local_roots(*(np.array(x) for x in zip(*clean, strict=True)))
    assert sorted(map(tuple, components(df).collect())) == sorted(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert components(df.where(F.lit(False))).collect() == []


def test_keys_of_other_types_and_without_keys(spark, rough):
    """Text keys, and texts whose keys are all null."""
    rows = [("b", "x y z w v"), ("a", "x y z w v"), (None, "x y z w v"), (None, "all alone here now"), (None, "all alone here now"), ("é", None)]
    out = sorted(map(repr, ((r.doc_id, r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())))
    assert out == sorted(map(repr, [("b", "a"), ("a", "a"), (None, "a"), (None, None), (None, None), ("é", "é")]))
    numbers = spark.createDataFrame([(-5, "x y z w v"), (7, "x y z w v"), (None, "all alone here now"), (0, "one more of them")], "doc_id int, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.simhash_dedup(numbers).collect()), key=repr) == sorted([(-5, -5), (7, -5), (None, None), (0, 0)], key=repr)


def test_sample_does_not_follow_values(spark):
    """The top of the tree is grown on fingerprints from all over, not on the lowest ones."""
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), 1 << 63, 20_000)
    grown = []
    grow = simhash._grow
    simhash._grow = lambda sample, depth: (grown.append((sample, depth)), grow(sample, depth))[1]
    size, simhash.TREE_SAMPLE = simhash.TREE_SAMPLE, 500
    try:
        simhash.similar_groups(spark.createDataFrame([(int(x),) for x in prints], "fingerprint long"), 4, 64).count()
    finally:
        simhash._grow, simhash.TREE_SAMPLE = grow, size
    sample, depth = grown[0]
    assert len(sample) == 500 and depth == 9 and 0.4 < (sample >> np.uint64(63)).mean() < 0.6
