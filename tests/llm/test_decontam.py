import itertools
import math
import random
import re

import pytest

from seqlake.llm import decontam

BENCH = "item_id long, text string, words int"


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(text, item):
    """The best share of equal words in a window along any diagonal, if it is enough."""
    w, x = words(text), words(item)
    if len(x) < decontam.LEAST_WORDS or len(w) < decontam.LEAST_WORDS:
        return 0.0
    size, best = min(len(x), decontam.WINDOW), 0.0
    for shift in range(-len(x), len(w)):
        for s in range(len(x) - size + 1):
            n = sum(0 <= shift + s + j < len(w) and w[shift + s + j] == x[s + j] for j in range(size))
            best = max(best, n / size)
    return best if best >= decontam.SHARE else 0.0


def test_masks_hit_every_window_with_a_fifth_substituted():
    for m in range(decontam.LEAST_WORDS, decontam.WINDOW + 1):
        for gone in itertools.combinations(range(m), m - math.ceil(decontam.SHARE * m - 1e-9)):
            assert any(all(p + i not in gone for i, c in enumerate(mask) if c == "1") for mask in decontam.MASKS for p in range(m - len(mask) + 1))


@pytest.mark.parametrize("seeds", [500_000, 0])
def test_passages_are_found_whatever_a_fifth_of_their_words(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", seeds)  # none: the join by shuffle
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n)), 0) for i, n in enumerate((4, 5, 6, 9, 12, 13, 25, 60))] + [(None, None, 0), (50, "", 0), (99, None, 0)]
    items.append((100, items[6][1].upper(), 0))
    docs = [(1000, None), (1001, ""), (1002, "a b c")]
    for i, text, _ in items[:8]:
        for changed in (0, 1, 2, 3, 5, 9):
            w = text.split()
            for j in rng.sample(range(len(w)), min(changed, len(w))):
                w[j] = f"other{j}"
            docs.append((len(docs), " ".join([*rng.choices(vocabulary, k=rng.randrange(30)), *w, *rng.choices(vocabulary, k=rng.randrange(30))]).title()))
    docs += [docs[10], (None, docs[11][1]), (2000, " ".join(rng.choices(vocabulary, k=300)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    expected = []
    for k, t in docs:
        found = {x: (b, i) for i, x, _ in items[:8] if (b := brute(t, x))}
        best = max(((b, -i) for b, i in found.values()), default=(0.0, None))
        expected.append((k, bool(found), len(found), None if not found else -best[1], best[0]))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, decontam.contamination(df, bench).collect()), key=key) == sorted(expected, key=key)
    assert sum(e[1] for e in expected) > 15 and sum(not e[1] for e in expected) > 8
    clean = decontam.clean(df.withColumnRenamed("doc_id", "__k1"), bench)
    assert sorted(map(repr, (tuple(r) for r in clean.collect()))) == sorted(repr((k, t)) for (k, t), e in zip(docs, expected, strict=True) if not e[1])


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x{i} alpha beta gamma delta epsilon zeta {i}") for i in range(5)] + [(9, "nothing to see here at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 0)], BENCH)
    small = sorted(decontam.contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert sorted(decontam.contamination(docs, bench).collect()) == small and sum(r.contaminated for r in small) == 5


def test_nothing_to_compare(spark, rough):
    none = spark.createDataFrame([], BENCH)
    assert not any(r.contaminated for r in decontam.contamination(rough, none).collect())
    assert sorted(map(repr, decontam.clean(rough, none).collect())) == sorted(map(repr, rough.collect()))
    assert decontam.contamination(rough.limit(0), none).collect() == []


def test_items_may_have_text_ids(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta y"), (2, "no")], "doc_id string, text string")
    bench = spark.createDataFrame([("b-2", "alpha beta gamma delta epsilon zeta"), ("b-1", "ALPHA beta gamma delta epsilon"), (None, None)], "item_id string, text string")
    assert [tuple(r) for r in decontam.contamination(docs, bench).orderBy("doc_id").collect()] == [("1", True, 2, "b-1", 1.0), ("2", False, 0, None, 0.0)]
