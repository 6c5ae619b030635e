"""Toxicity by multiple-instance learning.

Only whole documents are labelled, but it is sentences that offend.  A sentence's score is a logistic function of the
words in it, and a document's is the noisy-or of its sentences' scores; the weights are fitted so that the documents'
scores meet their labels.  The fitted sentence scores then say where a document offends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, fresh, materialize, quoted

#: Features: words and their beginnings of these lengths; as many of them as tell labels apart best.
BEGINNINGS, FEATURES = (4, 5), 300
#: A feature is looked at if it is in at least so many of the documents that are fitted on.
LEAST_DOCS = 5
#: The logarithm of how many times likelier a feature is in toxic documents, at least.
LEAST_GAIN = 1.5
#: Toxic documents that the model is fitted on, at most, and half the calm ones: some 100 MB of text at the most common lengths.
TRAIN_DOCS = 10_000
ROUNDS, RATE, PENALTY = 300, 0.5, 1e-4
#: Texts in Python at a time.
SLICE = 256

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(text: str) -> set[str]:
    """Words and word beginnings of a lower-cased text; beginnings end in a star."""
    words = set(_WORD.findall(text))
    return words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) >= k}


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that few texts are in Python at a time."""
    return (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE))


def _texts(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), SLICE):
        yield from column.slice(at, SLICE).to_pylist()


class Model:
    """Feature weights, the bias of sentences that hold a feature, and the score of the others, which is ``quiet`` before the logistic function."""

    def __init__(self, weights: dict[str, float], bias: float, quiet: float | None = None):
        self.weights, self.bias, self.quiet = weights, bias, quiet
        self.cache: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "quiet": self.quiet, "cache": {}}

    def of_word(self, word: str) -> tuple:
        """The word's features that have a weight."""
        if (got := self.cache.get(word)) is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            names = [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]
            got = self.cache[word] = tuple(n for n in names if n in self.weights)
        return got

    def sentences(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, score) of the sentences that hold a weighted feature, and how many others have words."""
        out, others, lower = [], 0, text.lower()
        if len(lower) != len(text):  # a letter that grows when lower-cased would move the places
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in _SENTENCE.finditer(lower):
            found, words = set(), _WORD.findall(m[0])
            for w in words:
                found.update(self.of_word(w))
            if found:
                z = self.bias + sum(self.weights[f] for f in found)
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-z))))
            elif words:
                others += 1
        return out, others

    def joined(self, found: list[tuple[int, int, float]], others: int) -> float:
        """Noisy-or of all sentences' scores."""
        calm = sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        if self.quiet is not None:
            calm -= others * math.log1p(math.exp(self.quiet))  # log(1 - logistic(quiet))
        return float(-math.expm1(calm))

    def score(self, text: str | None) -> float:
        return self.joined(*self.sentences(text or ""))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit the model on the labelled rows of ``docs``.

    At most ``TRAIN_DOCS`` toxic and twice as many calm documents take part, those with the smallest hash of their key;
    how the labels weigh is counted over all of them.  ``FEATURES`` words and beginnings take part, of those that are in
    ``LEAST_DOCS`` of them and ``exp(LEAST_GAIN)`` times likelier in toxic ones.  Equal texts with equal labels count once.  Null labels and rows without a label are left out; without
    labels of both kinds no feature has a weight and all scores are 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.least(F.greatest(F.max(label), F.lit(0)), F.lit(1)).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(key), F.col(key)]
    chosen = known.where("y = 1").orderBy(*order).limit(TRAIN_DOCS).unionByName(known.where("y = 0").orderBy(*order).limit(2 * TRAIN_DOCS))
    own = materialize(docs.select(key, ascii_lower(F.col(text)).alias("t")).join(F.broadcast(chosen), key).select("t", "y").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for part in _slices(b):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for f in features_of(t.lower()):
                        seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > 100_000:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    have = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not have.get(0) or not have.get(1):
        return Model({}, 0.0)
    n0, n1 = have[0], have[1]
    counted = own.mapInArrow(count, "feature string, calm long, toxic long").groupBy("feature").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    # Features by how far they tell the labels apart: the signed root of the likelihood ratio of their shares.
    p1, p0 = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("calm") + 0.5) / (n0 + 1)
    best = counted.where(F.col("calm") + F.col("toxic") >= min(LEAST_DOCS, n1)).withColumn("gain", F.col("toxic") * F.log(p1 / p0)).where(F.log(p1 / p0) > LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
    names = {r["feature"]: i for i, r in enumerate(best)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(dict.fromkeys(names, 0.0), 0.0)
        for b in batches:
            bags, others = [], []
            for t in _texts(b.column(0)):
                bag, quiet = [], 0
                for s in _SENTENCE.findall(t.lower()):
                    words = _WORD.findall(s)
                    found = sorted({names[f] for w in words for f in m.of_word(w)})
                    if found:
                        bag += [*found, -1]
                    quiet += bool(words) and not found
                bags.append(bag)
                others.append(quiet)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(bags, pa.list_(pa.int32())), pa.array(others, pa.int32())], names=["y", "bag", "quiet"])

    rows = own.select("t", "y").mapInArrow(sparse, "y int, bag array<int>, quiet int").collect()  # at most 3 * TRAIN_DOCS
    y = np.array([r["y"] for r in rows], float)
    weights, bias, quiet = _fit(y, [r["bag"] for r in rows], np.array([r["quiet"] for r in rows], float), len(names), total[1] / (total[0] + total[1]))
    return Model({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}, bias, quiet)


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["feature", "calm", "toxic"])


def _fit(y: np.ndarray, bags: list[list[int]], others: np.ndarray, features: int, share: float) -> tuple[np.ndarray, float, float]:
    """Weights, bias and quiet score by gradient ascent (Adam) on the documents' likelihood under the noisy-or.

    ``others`` counts each document's sentences without a feature.  They share one score, which may not be greater than
    that of a sentence with a feature of no weight.
    """
    feature, sentence, doc, s = [], [], [], 0
    for d, bag in enumerate(bags):
        for f in bag:
            if f < 0:
                doc.append(d)
                s += 1
            else:
                feature.append(f)
                sentence.append(s)
    feature, sentence, doc = (np.array(x, np.int64) for x in (feature, sentence, doc))
    w, b, q = np.zeros(features), -3.0, -8.0
    m, v = np.zeros(features + 2), np.zeros(features + 2)
    have = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    pull = (np.array([1 - share, share]) / have)[y.astype(int)]  # as the labels weigh in all documents, not in the sample
    for step in range(1, ROUNDS + 1):
        z = np.clip(b + np.bincount(sentence, w[feature], minlength=s), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-q))
        calm = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + others * np.log1p(-p0))
        # d log-likelihood / dz: p for a toxic document times calm / (1 - calm), and -p for a calm one.
        rate = np.where(y == 1, calm / np.maximum(1 - calm, 1e-6), -1.0) * pull
        dz = rate[doc] * p if s else np.zeros(0)
        grad = np.concatenate([np.bincount(feature, dz[sentence], minlength=features) - PENALTY * w, [dz.sum(), (rate * others).sum() * p0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(0, w + move[:-2]), min(b + move[-2], -1.0)  # no word makes a sentence calmer
        q = min(max(q + move[-1], -20.0), b)
    return w, float(b), float(q)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", spans: str | None = None) -> DataFrame:
    """``docs`` with the document score, a double from 0 to 1; ``spans`` names a column of offending sentences.

    A span is (start, end, score) of a sentence whose score is at least one half, in code points.  Null and empty texts,
    and texts without words, score 0; very long ones are read whole.  A column named like an output is replaced; the
    others pass through, and every row gives one row.
    """
    docs = docs.drop(out, *([spans] if spans else []))
    extra = [F.lit(0.0).alias(out)] + ([F.array().cast("array<struct<start:int,end:int,score:double>>").alias(spans)] if spans else [])
    schema = docs.select("*", *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, places = [], []
            for t in _texts(b.column(b.schema.get_field_index(text))):
                found, others = model.sentences(t or "")
                scores.append(model.joined(found, others))
                places.append([{"start": s, "end": e, "score": float(p)} for s, e, p in found if p >= 0.5])
            more = [pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))] if spans else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), *more], names=[*b.schema.names, out, *([spans] if spans else [])])

    return docs.mapInArrow(run, schema)


#: Documents with this remainder of crc32 modulo ``FOLDS`` are held out of training.
FOLDS, HELD_OUT, CUT = 4, 2, 0.3


def held_out_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, n_spans) per row of ``docs``, with a model of the rows that aren't held out."""
    model = train(docs.where(crc_mod(F.col(key), FOLDS) != HELD_OUT), labels.where(crc_mod(F.col(key), FOLDS) != HELD_OUT), key, text)
    scored = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, spans="spans")
    return scored.select(F.col("key").alias(key), (crc_mod(F.col("key"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def calm(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``CUT``, by the same model; all columns."""
    model = train(docs.where(crc_mod(F.col(key), FOLDS) != HELD_OUT), labels.where(crc_mod(F.col(key), FOLDS) != HELD_OUT), key, text)
    name = fresh(docs, "score")
    return score(docs, model, text, name).where(F.col(name) < CUT).select(*quoted(docs))
