"""Language-model scores from an n-gram trie in shards.

Documents are read once and become blocks: tokens as numbers into the block's own list of words, and the words' 64-bit
hashes.  Blocks and shards then talk in two rounds, in packed messages of one row for each block and shard:

1. A block sends its words and their training counts to the words' shards, which add up and send the totals back.
2. A block sends its word pairs and their training counts to the shards of their contexts; each shard merges them into
   an Elias-Fano trie of quantised probabilities, looks up in it the pairs it was asked for, and sends their codes back.

Smoothing is absolute discounting: a pair's count less ``DISCOUNT`` over its context's, and what that leaves goes to the
distribution of single words.  A word is counted once for each block before it travels, so a frequent word is no hot
key; the successors of the few contexts that make up a large share of all tokens are spread over several shards.  Counts
cover all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize
from .elias_fano import KEY_BITS, STEPS, VALUE, Trie, decode, encode, quantise

#: Bytes of text in a block, and blocks for each shard.  There is a message for each block and shard, so both should grow
#: with inputs of more than some terabytes; memory in a worker is some ten times either.
BLOCK_BYTES, SHARD_BLOCKS = 4 << 20, 2
#: What each pair's count is lessened by, for the pairs that were not seen.
DISCOUNT = 0.9
#: Documents with this remainder of crc32 modulo ``FOLDS`` are held out of training.
FOLDS, HELD_OUT = 5, 1
_END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space
#: A successor's key is so much of its hash: of ten million successors of a context one in 100 000 unseen ones meets another's.
_KEY = np.uint64((1 << KEY_BITS) - 1)


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of small numbers, planes of equal weight together."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _spread(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, keys, held, lengths, codes, words): documents in blocks; each ends in the end token, code 0."""
    own = docs.select(F.col(key).alias("key"), (crc_mod(F.col(key), FOLDS) == HELD_OUT).alias("held"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            texts = pc.fill_null(t.column("text").combine_chunks(), "").cast(pa.large_string())
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            full = pc.not_equal(flat, "")
            doc, coded = doc[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
            hashes = np.array([_END, *(xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist())], np.uint64)
            n = np.bincount(doc, minlength=len(lists)) + 1
            codes = np.zeros(int(n.sum()), np.int64)
            codes[np.arange(len(doc)) + doc] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            values = [[part << 32 | nth], [t.column("key").to_pylist()], [t.column("held").to_pylist()], [_squeeze(n)], [_squeeze(codes)], [hashes.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], names=[f.name for f in arrow])

        for b in batches:
            step = max(1, min(b.num_rows, int(b.num_rows * BLOCK_BYTES / max(1, b.nbytes))))
            for i in range(0, b.num_rows, step):
                held.append(b.slice(i, step))
                size += held[-1].nbytes if step < b.num_rows else b.nbytes
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = own.schema["key"].dataType
    arrow = [pa.field("block", pa.int64()), pa.field("keys", pa.list_(to_arrow_type(kind))), pa.field("held", pa.list_(pa.bool_())), *(pa.field(c, pa.binary()) for c in ("lengths", "codes", "words"))]
    return own.mapInArrow(run, f"block long, keys array<{kind.simpleString()}>, held array<boolean>, lengths binary, codes binary, words binary")


class _Block:
    def __init__(self, row: dict):
        self.number, self.keys = row["block"], row["keys"]
        self.lengths, self.codes, self.words = _spread(row["lengths"]), _spread(row["codes"]), np.frombuffer(row["words"], np.uint64)
        self.held = np.array(row["held"], bool)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train], minlength=len(self.words))

    def by_shard(self, shards: int) -> list[np.ndarray]:
        """For each shard the words (by their codes) that it counts, in order of their hashes."""
        shard, order = (self.words % np.uint64(shards)).astype(np.int64), np.argsort(self.words)
        order = order[np.argsort(shard[order], kind="stable")]
        return np.split(order, np.cumsum(np.bincount(shard, minlength=shards))[:-1])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, as context code times the number of words plus successor code, and each token's pair."""
        before = np.concatenate([[0], self.codes[:-1]])  # a document's first word follows the end token before it
        return np.unique(before * len(self.words) + self.codes, return_inverse=True)

    def pairs_by_shard(self, pairs: np.ndarray, shards: int, hot: dict[int, int]) -> list[np.ndarray]:
        """For each shard the pairs that it holds, in order of context and successor hash."""
        first, second = self.words[pairs // len(self.words)], self.words[pairs % len(self.words)]
        ways = np.ones(len(self.words), np.uint64)
        if hot:
            keys = np.array(sorted(hot), np.uint64)
            at = np.minimum(np.searchsorted(keys, self.words), len(keys) - 1)
            ways = np.where(keys[at] == self.words, np.array([hot[int(k)] for k in keys], np.uint64)[at], ways)
        shard = ((first % np.uint64(shards) + second % ways[pairs // len(self.words)]) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((second & _KEY, first, shard))
        return np.split(order, np.cumsum(np.bincount(shard, minlength=shards))[:-1])


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], names=list(types))


_MESSAGE = {"shard": pa.int32(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
_ANSWER = {"block": pa.int64(), "shard": pa.int32(), "kind": pa.string(), "data": pa.binary(), "tokens": pa.int64(), "types": pa.int64()}
_MESSAGE_SQL, _ANSWER_SQL = "shard int, block long, a binary, b binary, c binary", "block long, shard int, kind string, data binary, tokens long, types long"


def _word_messages(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                n = b.counts()
                for s, own in enumerate(b.by_shard(shards)):
                    if len(own):
                        yield _rows({"shard": [s], "block": [b.number], "a": [encode(b.words[own])], "b": [_squeeze(n[own])], "c": [None]}, _MESSAGE)

    return run


def _add_words(t: pa.Table) -> pa.Table:
    """One shard: totals of its words, for each block that asked; and the shard's tokens and types."""
    rows = t.to_pylist()
    hashes, counts = [decode(r["a"]) for r in rows], [_spread(r["b"]) for r in rows]
    words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), minlength=len(words)).astype(np.int64)
    parts = np.split(total[inverse], np.cumsum([len(h) for h in hashes])[:-1])
    heavy = np.argsort(-total, kind="stable")
    rest = total.sum() - np.cumsum(total[heavy]) + total[heavy]
    light = np.flatnonzero(8 * total[heavy] <= rest)
    heavy = heavy[: light[0] if len(light) else len(heavy)]  # each an eighth of what is left: as many as a logarithm of the tokens
    out = {"block": [r["block"] for r in rows], "shard": [r["shard"] for r in rows], "kind": ["word"] * len(rows), "data": [_squeeze(p) for p in parts], "tokens": [None] * len(rows), "types": [None] * len(rows)}
    more = {"block": [-1], "shard": [rows[0]["shard"]], "kind": ["total"], "data": [np.stack([words[heavy], total[heavy].astype(np.uint64)]).tobytes()], "tokens": [int(total.sum())], "types": [int((total > 0).sum())]}
    return pa.table({c: pa.array(out[c] + more[c], k) for c, k in _ANSWER.items()})


def _pair_messages(shards: int, hot: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                pairs, each = b.pairs()
                n = np.bincount(each[b.train], minlength=len(pairs))
                for s, own in enumerate(b.pairs_by_shard(pairs, shards, hot)):
                    if len(own):
                        first, second = b.words[pairs[own] // len(b.words)], b.words[pairs[own] % len(b.words)] & _KEY
                        contexts, start = np.unique(first, return_index=True)
                        nth = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(start, len(first))))
                        yield _rows({"shard": [s], "block": [b.number], "a": [encode(contexts)], "b": [encode((nth << np.uint64(KEY_BITS)) | second)], "c": [_squeeze(n[own])]}, _MESSAGE)

    return run


def _shard_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(first, second, count, sizes) of the pairs of all messages, and how many each message has."""
    columns, sizes = tuple(t.column(c).to_pylist() for c in "abc"), []
    for k in columns[1]:
        sizes.append(int(np.frombuffer(k, "<u8", 1)[0]))
    first, second, count = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.uint32)
    at = 0
    for a, b, c, n in zip(*columns, sizes, strict=True):
        keys = decode(b)
        first[at : at + n] = decode(a)[(keys >> np.uint64(KEY_BITS)).astype(np.int64)]
        second[at : at + n], count[at : at + n] = keys & _KEY, _spread(c)
        at += n
    return first, second, count, sizes


def _merged(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count, each): distinct pairs in order with their counts added up, and which of them each entry is."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, bool)
    at, each = np.flatnonzero(new), np.empty(len(order), np.int32)
    each[order] = np.cumsum(new, dtype=np.int32) - 1
    return first[at], second[at], np.add.reduceat(count[order], at, dtype=np.int64) if len(at) else count, each


def _shard_trie(first: np.ndarray, second: np.ndarray, count: np.ndarray, totals: dict[int, int]) -> tuple[bytes, dict[int, int]]:
    """The trie of a shard's distinct pairs in order, and how many successors the contexts of ``totals`` have here.

    A context's total is the sum of its pairs, or given by ``totals`` if they are in several shards; a weight is the
    share of its total that the discounts of its pairs leave, and is not used where pairs are in several shards.
    """
    seen = count > 0
    first, second, count = first[seen], second[seen], count[seen]
    contexts, start = np.unique(first, return_index=True)
    pointers = np.append(start, len(first)).astype(np.int64)
    types = np.diff(pointers)
    own = np.repeat(np.arange(len(contexts)), types)
    total = np.bincount(own, count, minlength=len(contexts)) if len(contexts) else np.zeros(0)
    spread = {}
    for k, n in totals.items():
        i = int(np.searchsorted(contexts, np.uint64(k)))
        if i < len(contexts) and int(contexts[i]) == k:
            total[i], spread[k] = n, int(types[i])
    return Trie.build(contexts, pointers, second, (count - DISCOUNT) / total[own], DISCOUNT * types / np.maximum(total, 1)), spread


def _answer_pairs(totals: dict[int, int]):
    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["block", "shard"]).to_pylist()
        asked, *more, sizes = _shard_pairs(t)
        first, second, count, each = _merged(asked, *more)
        data, spread = _shard_trie(first, second, count, totals)
        del count, more
        trie, codes, weights = Trie.mapped(data), np.zeros(len(first), np.uint8), np.zeros(len(first), np.uint8)
        for at in range(0, len(first), 1 << 18):
            part = slice(at, at + (1 << 18))
            codes[part], weights[part] = trie.find(first[part], second[part])
        out, at = [], 0
        for n in sizes:
            mine, f = each[at : at + n], asked[at : at + n]
            new = np.concatenate([[True], f[1:] != f[:-1]])  # a weight for each context
            out.append(zstandard.compress(np.concatenate([codes[mine], weights[mine][new]]).tobytes(), 1))
            at += n
        none = [None] * len(rows)
        columns = {"block": [r["block"] for r in rows], "shard": [r["shard"] for r in rows], "kind": ["pair"] * len(rows), "data": out, "tokens": none, "types": none}
        more = {"block": [-1], "shard": [rows[0]["shard"]], "kind": ["types"], "data": [np.array([*spread, *spread.values()], np.uint64).tobytes()], "tokens": [None], "types": [None]}
        return pa.table({c: pa.array(columns[c] + more[c], k) for c, k in _ANSWER.items()})

    return run


def _score_block(shards: int, hot: dict[int, int], weights: dict[int, float], tokens: int, types: int, key_type: pa.DataType):
    scale = tokens + 0.5 * (types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("key", "held_out", "n_tokens", "n_known", "base_score", "score")}
        answers = {(r["kind"], r["shard"]): r["data"] for r in right.select(["kind", "shard", "data"]).to_pylist()}
        for row in left.to_pylist():
            b = _Block(row)
            count = np.zeros(len(b.words), np.int64)
            for s, own in enumerate(b.by_shard(shards)):
                if len(own):
                    count[own] = _spread(answers["word", s])
            pairs, each = b.pairs()
            code, left = np.zeros(len(pairs), np.uint8), np.zeros(len(b.words))
            for s, own in enumerate(b.pairs_by_shard(pairs, shards, hot)):
                if len(own):
                    got, context = np.frombuffer(zstandard.decompress(answers["pair", s]), np.uint8), pairs[own] // len(b.words)
                    code[own] = got[: len(own)]
                    left[context[np.concatenate([[True], context[1:] != context[:-1]])]] = VALUE[got[len(own) :]]
            if weights:  # of contexts that are in several shards
                keys = np.array(sorted(weights), np.uint64)
                at = np.minimum(np.searchsorted(keys, b.words), len(keys) - 1)
                left = np.where(keys[at] == b.words, np.array([weights[int(k)] for k in keys])[at], left)
            left[count == 0] = 1.0  # a context without training tokens says nothing
            single = (count + 0.5) / scale
            p = VALUE[code] + left[pairs // len(b.words)] * single[pairs % len(b.words)]
            total = lambda x: np.bincount(b.doc, x, minlength=len(b.lengths))
            out["key"] += b.keys
            out["held_out"] += b.held.tolist()
            out["n_tokens"] += b.lengths.tolist()
            out["n_known"] += total(count[b.codes] > 0).astype(np.int64).tolist()
            out["base_score"] += total(np.log10(single)[b.codes]).tolist()
            out["score"] += total(np.minimum(0.0, np.log10(p))[each]).tolist()
        types_ = (key_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types_, strict=True)})

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", tries: list | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    score is the model's log10 probability of the text: of each token after the one before it, from the trie's
    quantised share of the context's counts plus the one-word probability by what the context leaves it.  A null or
    empty text is its end token alone; very long texts are read whole; without training documents all counts are 0.
    Repeated rows and null keys each get a row.  Other columns are not read.  ``tries``, if given, gets a DataFrame (shard, trie) of the model's bytes,
    which :class:`Trie` reads or maps from a file.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    made = materialize(blocks(docs, key, text))
    shards = max(8, made.count() // SHARD_BLOCKS)
    words = materialize(made.mapInArrow(_word_messages(shards), _MESSAGE_SQL).groupBy("shard").applyInArrow(_add_words, _ANSWER_SQL))
    tokens, types, hot, totals = 0, 0, {}, {}
    for r in words.where("kind = 'total'").select("tokens", "types").groupBy().agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).collect():
        tokens, types = r["n"] or 0, r["v"] or 0
    # Contexts of more than a quarter of a shard's share of the tokens: fewer than four for each shard.
    for r in words.where("kind = 'total'").select("data").toLocalIterator():
        for k, n in np.frombuffer(r["data"], np.uint64).reshape(2, -1).T.tolist():
            if 4 * n * shards > tokens:
                hot[k], totals[k] = min(shards, 1 + 4 * n * shards // tokens), n
    totals = {k: n for k, n in totals.items() if hot[k] > 1}
    messages = made.mapInArrow(_pair_messages(shards, hot), _MESSAGE_SQL)
    if tries is not None:
        model = lambda t: pa.table({"shard": t.column("shard").slice(0, 1), "trie": pa.array([_shard_trie(*_merged(*_shard_pairs(t)[:3])[:3], totals)[0]], pa.binary())})
        tries.append(messages.groupBy("shard").applyInArrow(model, "shard int, trie binary"))
    pairs = materialize(messages.groupBy("shard").applyInArrow(_answer_pairs(totals), _ANSWER_SQL))
    # Successors of the contexts that are in several shards: a number for each of those and each context.
    spread: dict[int, int] = {}
    for r in pairs.where("kind = 'types'").select("data").toLocalIterator():
        for k, n in np.frombuffer(r["data"], np.uint64).reshape(2, -1).T.tolist():
            spread[k] = spread.get(k, 0) + n
    weights = {k: float(VALUE[quantise(np.array([DISCOUNT * n / totals[k]]))[0]]) for k, n in spread.items()}
    answers = words.where("kind = 'word'").unionByName(pairs.where("kind = 'pair'"))
    kind = docs.schema[key].dataType
    run = _score_block(shards, hot, weights, tokens, types, to_arrow_type(kind))
    out = made.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_CODED = f"10.0::DOUBLE ** (-least(round_even(-log10(%s) * {STEPS}, 0), 254) / {STEPS})"
#: The model from counts of words and pairs.  CRC-32 is worked out bit by bit, as the engine has no function for it.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % {FOLDS} = {HELD_OUT} AS held_out,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') || [chr(10)] AS w FROM documents),
p AS (SELECT r, held_out, unnest([chr(10)] || w[:-2]) AS a, unnest(w) AS b FROM d),
c AS (SELECT b AS word, count(*) AS n FROM p WHERE NOT held_out GROUP BY b),
t AS (SELECT sum(n) AS tokens, sum(n) + 0.5::DOUBLE * (count(*) + 1) AS scale FROM c),
c2 AS (SELECT a, b, count(*) AS n FROM p WHERE NOT held_out GROUP BY a, b),
k AS (SELECT a, sum(n) AS total, count(*) AS types FROM c2 GROUP BY a),
s AS (SELECT r, (coalesce(c.n, 0) + 0.5::DOUBLE) / (SELECT scale FROM t) AS single, c.n IS NOT NULL AS known,
  CASE WHEN c2.n IS NULL THEN 0 ELSE {_CODED % f"((c2.n - {DISCOUNT}::DOUBLE) / k.total)"} END AS share, CASE WHEN k.total IS NULL THEN 1 ELSE {_CODED % f"({DISCOUNT}::DOUBLE * k.types / k.total)"} END AS rest
  FROM p LEFT JOIN c ON c.word = p.b LEFT JOIN c2 ON c2.a = p.a AND c2.b = p.b LEFT JOIN k ON k.a = p.a),
x AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(log10(single)) AS base_score, sum(least(0, log10(share + rest * single))) AS score FROM s GROUP BY r)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, (SELECT coalesce(tokens, 0) FROM t)::BIGINT AS train_tokens, round(base_score, 3) AS base_score, round(score, 3) AS score
FROM d JOIN x USING (r)
"""
