import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    """The contract's ids: the tokenizer as it is, nothing added."""
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


ENCODER = packing.Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\x1c\x85  ab.,'s1é日\u0301\u200d😀", "'ll", "<|endoftext|>", "<|end", "word", "  "]), max_size=30).map("".join), max_size=8))
def test_encoding_equals_the_tokenizer(texts):
    assert [x.tolist() for x in ENCODER.encode(pa.array([*texts, None], pa.string()))] == [whole(t) for t in [*texts, None]]


def test_every_letter_is_encoded_as_the_tokenizer_does():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x30000 or c % 97 == 0)]
    texts = ["".join(f"a{c}a 1{c}1 .{c}. {c} {c}{c}'{c}x " for c in letters[i : i + 50]) for i in range(0, len(letters), 50)]
    assert all(x.tolist() == e.ids for x, e in zip(ENCODER.encode(pa.array(texts)), TOKENIZER.encode_batch_fast(texts, add_special_tokens=False), strict=True))


def test_every_token_is_reached_by_its_merges_and_special_ones_are_themselves(tmp_path):
    assert ENCODER.quick is not None
    vocab = json.loads(TOKENIZER.to_str())["model"]["vocab"]
    tokens = [TOKENIZER.decode([i]) for i in vocab.values()]
    assert all(ENCODER.ids(t) == whole(t) for t in tokens)
    assert whole("hello <|endoftext|> world") == ENCODER.ids("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    spec = json.loads(TOKENIZER.to_str())
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, theirs = packing.Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert other.quick is None and other.ids("two words, it's") == theirs.encode("two words, it's", add_special_tokens=False).ids


def test_very_long_words_and_texts():
    for t in ("a" * 200_000, "xq9" * 50_000, " " * 50_000, "日本" * 40_000, "word " * 100_000):
        assert ENCODER.ids(t) == whole(t)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def sequences(rows, capacity):
    """How many sequences the placed runs fill; every rank has one place, and places in a sequence follow each other."""
    used, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.length, r.rank)):
        assert r.rank == seen.get(r.length, 0)
        seen[r.length] = r.rank + r.n * r.each
        for k in range(r.n):
            used.setdefault(r.first + k, []).append((r.offset, r.length * r.each))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used), seen


@pytest.mark.parametrize(("capacity", "draw"), [(20, lambda r: r.randint(1, 20)), (100, lambda r: r.choice((3, 34, 51, 66, 97))), (64, lambda r: min(64, int(r.expovariate(1 / 20)) + 1)), (2048, lambda r: r.randint(1, 2048)), (10, lambda r: 4), (1, lambda r: 1)])
def test_places_are_valid_and_as_tight_as_best_fit_decreasing(spark, capacity, draw):
    rng = random.Random(3)
    lengths = [draw(rng) for _ in range(500)]
    counts = Counter(lengths)
    made = packing.place(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity).collect()
    n, seen = sequences(made, capacity)
    assert seen == counts and n <= best_fit_decreasing(lengths, capacity) * 1.01 + 1


def test_no_lengths_no_places(spark):
    assert packing.place(spark.createDataFrame([], "length long, n long"), 10).collect() == []


def test_ranges_swept_apart_and_then_across_give_one_sweep():
    rng = random.Random(7)
    row = lambda kind, size, at, n: dict(zip(packing._RUN, (kind, size, at if kind == packing.GAP else 0, n, 0 if kind == packing.GAP else at, 0, 0, False), strict=True))
    for _ in range(200):
        rows = [row(rng.choice((packing.GAP, packing.DOCUMENT)), rng.randint(33, 64), 1000 * i, rng.randint(1, 9)) for i in range(rng.randint(0, 25))]
        parts = [packing.sweep([r for r in rows if (r["size"] - 33) // 8 == k], 64) for k in range(4)]
        both = packing.sweep([dict(zip(packing._RUN, r, strict=True)) for p in parts for r in p], 64)
        placed = lambda out: Counter(x for r in out if r[0] == packing.PLACED for x in [(r[1], r[6])] * (r[3] * r[5]))
        assert placed(both) == placed(packing.sweep(rows, 64))


def test_pieces():
    got = [list(zip(*(x.tolist() for x in packing.cut(np.array([n]), 8)[2:]), strict=True)) for n in (5, 16, 19)]
    assert got == [[(0, 5)], [(0, 8), (8, 8)], [(0, 3), (3, 8), (11, 8)]]


def test_every_token_has_one_place(rough):
    rows = packing.pack(rough, PATH, capacity=64, keep_ids=True).collect()
    places = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() and sum(n for _, n in p) <= 64
    texts = sorted(whole(r.text) + [0] for r in rough.collect())
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    alone = {r.doc_id: whole(r.text) + [0] for r in rough.collect() if r.doc_id not in (2, None)}
    assert {k: v for k, v in got.items() if k in alone} == alone
    assert sum(map(len, texts)) == sum(r.length for r in rows)
    assert packing.pack(rough.limit(0), PATH).collect() == []
