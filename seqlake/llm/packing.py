"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best fit.  Lengths are integers up to the capacity, so documents and gaps, sorted by size, are runs: a
document run is a length, its first rank and how many; a gap run is a room, its first sequence and how many.  The runs
are a table in the shared folder.  A superstep deals the runs of a band of lengths, and the gaps that may hold them, by
ranges of size.  Each range is swept from large to small: a document run takes the successor of its length, the smallest
gap not taken yet that holds it, and longer documents come first where several want one gap.  What a range leaves over
is swept once more across the boundaries, which gives what one sweep of all would have given.  Then the gaps shrink, and
the next superstep starts; new sequences are opened only for documents that no gap holds.  The placed runs say where
each document goes by its rank among those of its length, which is counted in parallel.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

PIECE = "piece int, start long, length long, ids_crc32 long"
#: Ranges of size that a superstep's runs are dealt into.
RANGES = 4
#: Texts in Python at a time.
SLICE = 256
#: How byte-level vocabularies write the bytes that are no printable letter, from 256 on in order of the bytes.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The pattern by which byte-level tokenizers split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token and its id, if ``spec`` is a byte-level BPE whose ids are in order of its merges; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or not byte_level or spec.get("normalizer") or spec.get("truncation"):
        return None
    others = [b for b in range(256) if b not in _PLAIN]
    letters = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab, last = model["vocab"], -1
    if any(c not in vocab for c in letters):
        return None
    ranks = {bytes([b]): vocab[c] for c, b in letters.items()}
    last = max(ranks.values())
    for m in model["merges"]:
        token = "".join(m) if isinstance(m, list) else m.replace(" ", "", 1)
        if vocab.get(token, -1) <= last:
            return None
        last = vocab[token]
        ranks[bytes(letters[c] for c in token)] = last
    return ranks


class Encoder:
    """Token ids of texts by a tokenizer file.

    Byte-level BPE files are run by tiktoken from the file's own merges; texts that hold one of its added tokens, and
    all texts of other kinds of files, go to the file's own tokenizer.  Both give the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.tokenizer, self.quick = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if ranks := byte_ranks(spec):
            import tiktoken

            self.quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> list[int]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.quick is None or any(t in text for t in self.added):
            return self._whole(text)
        return self.quick.encode_ordinary(text)

    def encode(self, texts: pa.Array) -> Iterator[array]:
        """Ids of each text; null is empty."""
        for at in range(0, len(texts), SLICE):
            for t in texts.slice(at, SLICE).to_pylist():
                yield array("I", self.ids(t) if t else [])


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of ``n`` ids: all of ``capacity`` but the first."""
    count = np.maximum(1, -(-n // capacity))
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = (n - (count - 1) * capacity)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each entry among those of its length, going on from ``seen``, which is moved on."""
    order = np.argsort(length, kind="stable")
    n = np.bincount(length, minlength=len(seen))
    nth = np.empty(len(length), np.int64)
    nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
    seen += n
    return nth


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], part, nth): pieces of each document's ids and the end id.

    part and nth number the pieces of a length within the task that made them.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, {PIECE}" + ", ids array<long>" * keep_ids + ", part int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sizes, sums, kept = [], [], []
            for ids in encoder.encode(b.column(1)):
                ids.append(end_id)
                n = len(ids)
                sizes.append(n)
                if sys.byteorder == "big":
                    ids.byteswap()
                view, at = memoryview(ids).cast("B"), 0
                while at < n:
                    stop = at + (n - at - 1) % capacity + 1
                    sums.append(zlib.crc32(view[4 * at : 4 * stop]))
                    if keep_ids:
                        kept.append(np.frombuffer(view[4 * at : 4 * stop], "<u4").astype(np.int64))
                    at = stop
            doc, piece, start, length = cut(np.array(sizes, np.int64), capacity)
            t = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            t += [pa.array(kept, pa.list_(pa.int64()))] * keep_ids + [pa.array(np.full(len(doc), part, np.int32)), pa.array(_ranks(length, seen))]
            yield pa.RecordBatch.from_arrays(t, names=["key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "part", "nth"])

    return source.mapInArrow(run, schema)


#: Rows of the table of runs: documents to place, gaps, placed documents, and the note that a superstep leaves.
DOCUMENT, GAP, PLACED, NOTE = range(4)
#: size: a length or a room; first: a sequence; n: documents or sequences; rank: a document's; each: documents in a sequence.
RUN = "kind int, size long, first long, n long, rank long, each long, offset long, done boolean"
_RUN = ("kind", "size", "first", "n", "rank", "each", "offset", "done")


def sweep(rows: list[dict], capacity: int) -> list[tuple]:
    """One sweep from large to small: each document run takes the smallest gaps that hold it, and fills them with its like.

    Rows that are ``done`` have been placed, or were made by placing, in this superstep, and pass.
    """
    out = [tuple(r[c] for c in _RUN) for r in rows if r["done"]]
    stack: list[list[int]] = []
    for r in sorted((r for r in rows if not r["done"]), key=lambda r: (-r["size"], r["kind"] == DOCUMENT, r["rank"], r["first"])):
        if r["kind"] == GAP:
            stack.append([r["size"], r["first"], r["n"]])
            continue
        length, rank, n = r["size"], r["rank"], r["n"]
        while n and stack:
            room, first, have = stack[-1]
            each = min(room // length, n)
            took = min(n // each, have)
            out.append((PLACED, length, first, took, rank, each, capacity - room, True))
            if room > each * length:
                out.append((GAP, room - each * length, first, took, 0, 0, 0, True))
            rank, n = rank + took * each, n - took * each
            if took == have:
                stack.pop()
            else:
                stack[-1] = [room, first + took, have - took]
        if n:
            out.append((DOCUMENT, length, 0, n, rank, 0, 0, False))
    return out + [(GAP, room, first, n, 0, 0, 0, False) for room, first, n in stack]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), *[pa.int64()] * 6, pa.bool_())
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(_RUN, kinds, strict=True))})


def superstep(runs: DataFrame, low: int, band: int, capacity: int) -> DataFrame:
    """Place what the gaps hold of the documents longer than ``low`` and not longer than ``band``; the new table of runs.

    Its NOTE says how many documents of the band are left (n) and how many tokens are in those that no gap holds (size).
    """
    active = (F.col("size") > low) & (((F.col("kind") == DOCUMENT) & (F.col("size") <= band)) | (F.col("kind") == GAP))
    width = -(-(capacity - low) // RANGES)

    def within(t: pa.Table) -> pa.Table:
        return _table(sweep(t.to_pylist(), capacity))

    def across(t: pa.Table) -> pa.Table:
        rows = sweep(t.to_pylist(), capacity)
        left = [r for r in rows if r[0] == DOCUMENT]
        widest = max((r[1] for r in rows if r[0] == GAP), default=0)
        note = (NOTE, sum(r[1] * r[3] for r in left if r[1] > widest), 0, sum(r[3] for r in left), 0, 0, 0, False)
        return _table([(*r[:-1], False) for r in [*rows, note]])

    swept = runs.where(active).groupBy(F.floor((F.col("size") - low - 1) / width).alias("range")).applyInArrow(within, RUN).groupBy(F.lit("all").alias("range")).applyInArrow(across, RUN)
    return runs.where(~active & (F.col("kind") != NOTE)).unionByName(swept).coalesce(1)


def place(lengths: DataFrame, capacity: int) -> DataFrame:
    """(length, rank, n, first, each, offset): runs of placed documents, from (length, n).

    The n * each documents from ``rank`` on, of those of the length, lie in n sequences from ``first`` on.  All lengths
    are from 1 to ``capacity``, so there are at most that many document runs; each placed run uses up a document run or
    a gap run of its superstep, and the number of supersteps grows with the logarithm of the capacity, not with the documents.
    """
    spark = lengths.sparkSession
    empty = [F.lit(0).cast("long").alias(c) for c in ("first", "rank", "each", "offset")]
    runs = materialize(lengths.select(F.lit(DOCUMENT).alias("kind"), F.col("length").cast("long").alias("size"), "n", *empty, F.lit(False).alias("done")).select(*_RUN).coalesce(1))
    left = {r["size"]: r["n"] for r in runs.select("size", "n").collect()}  # at most ``capacity``
    band, sequences, opened = capacity, 0, 0
    while band:
        low = band // 2
        if not any(low < n <= band for n in left):
            band = low
            continue
        if band == capacity:  # two of these never share a sequence
            opened = sum(c for n, c in left.items() if n > low)
        while True:
            new = runs
            if opened:
                new = runs.unionByName(spark.createDataFrame([(GAP, capacity, sequences, opened, 0, 0, 0, False)], RUN))
                sequences += opened
            new = materialize(superstep(new, low, band, capacity))
            drop_table(runs)
            runs, note = new, new.where(F.col("kind") == NOTE).first()
            if not note["n"]:
                break
            opened = -(-note["size"] // capacity)
        band, opened = low, 0
    return runs.where(F.col("kind") == PLACED).select(F.col("size").alias("length"), "rank", "n", "first", "each", "offset")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: (key, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    ``tokenizer`` is the path of a tokenizer file that every executor has; ids are those of its ``encode`` without special
    tokens added, so the string of an added token in a text is that token.  A null or empty text is its end id alone; a
    very long one is cut into pieces.  Rows with the same key are packed each on its own; a null key stays null.  No
    documents give no rows.  Other columns are not read.  Tasks get the runs of placed documents, a few thousand rows for
    2048 lengths whatever the number of documents (see :func:`place`).
    """
    made = materialize(pieces(docs, tokenizer, key, text, capacity, end_id, keep_ids))
    by_part = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = place(by_part.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    rows = np.array([tuple(r) for r in placed.collect()], np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key_of = rows[:, 0] * (1 << 44) + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = rows[np.searchsorted(key_of, length * (1 << 44) + rank, "right") - 1]
            nth, place_ = np.divmod(rank - row[:, 1], np.maximum(1, row[:, 4]))
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(row[:, 3] + nth), pa.array(row[:, 5] + place_ * length)], names=[*keep, "sequence_id", "offset"])

    ranked = made.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    columns = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = ranked.select(*columns, "rank")
    schema = ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema).withColumnRenamed("key", key)
