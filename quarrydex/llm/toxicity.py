"""Operator 5: toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their first four and five bytes, hashed.  The
machine has a weight for each term and, through a short vector for each term, one for each pair, so
it learns what a term means beside another one.  It is fitted on a bounded sample of labelled rows.
A term takes part if it says something by itself, or if a pair does that it is in: what one term says among the documents that have the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import spare, strings
from .decontaminate import words
from .language import fold

#: Labelled rows to learn from, about: of label 1 and of label 0, chosen by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
HASH_BITS = 20
#: Terms kept: in this many training documents at least, and with this chi-square value at least.
LEAST_DOCS, LEAST_CHI2 = 3, 10.0
#: Pairs that count too: of terms in this part of the training documents, each with this chi-square value among the documents that have the other.
PAIR_SHARE, PAIR_CHI2 = 0.05, 40.0
FACTORS, EPOCHS, RATE, DECAY = 8, 30, 0.1, 1e-3
#: Documents of a step of the fit, and spread of the vectors at its start.
STEP, SPREAD = 64, 0.01
#: Terms whose pairs are counted at a time.
PAIRS_AT_ONCE = 256
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Entries of a worker's cache from words to terms.
CACHE = 500_000


def terms(word: bytes) -> list[int]:
    """Hashes of a word and of its first four and five bytes."""
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(b"w" + word) & mask]
    if len(word) >= 4:
        out.append(zlib.crc32(b"4" + word[:4]) & mask)
    if len(word) >= 5:
        out.append(zlib.crc32(b"5" + word[:5]) & mask)
    return out


def totals(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over the stretches between the places ``start``."""
    sums = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))
    return sums[start[1:]] - sums[start[:-1]]


def chi_square(toxic, seen, toxic_all, all_):
    """How much the toxic share of the ``seen`` documents differs from that of all; 0 where there is nothing to compare."""
    share = toxic_all / np.maximum(all_, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (toxic - seen * share) ** 2 * all_ / (seen * share * (1 - share) * (all_ - seen))
    return np.where(np.isfinite(out), out, 0)


def paired(docs: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Those of ``terms`` that are in a pair whose terms each say something among the documents that have the other."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    has = np.zeros((len(docs), len(terms)), np.float32)
    for row, d in zip(has, docs):
        own = place[d]
        row[own[own >= 0]] = 1
    seen, toxic = has.sum(axis=0, dtype=np.float64), y @ has
    held = np.zeros(len(terms), bool)
    for a in range(0, len(terms), PAIRS_AT_ONCE):
        some = has[:, a : a + PAIRS_AT_ONCE].T
        both, both_toxic = (some @ has).astype(float), ((some * y.astype(np.float32)) @ has).astype(float)
        own = slice(a, a + len(some))
        effect = np.minimum(chi_square(both_toxic, both, toxic[own, None], seen[own, None]), chi_square(both_toxic, both, toxic, seen))
        held[own] |= (effect >= PAIR_CHI2).any(axis=1)
    return terms[held]


@dataclass
class Machine:
    """Scores of sets of kept terms: bias + sum of w + pairs of v."""

    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes, ascending
    bias: float = -10.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def raw(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """ids: kept terms (positions) of all documents; start: where each document's begin, and the end."""
        v = self.v[ids]
        return self.bias + totals(self.w[ids], start) + 0.5 * (totals(v, start) ** 2 - totals(v * v, start)).sum(axis=1)

    @classmethod
    def fit(cls, docs: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Machine:
        """docs: distinct term hashes of each document.  One class alone: a constant score."""
        n, positive = len(y), int(y.sum())
        if not n or positive in (0, n):
            return cls(bias=10.0 if positive else -10.0)
        flat = np.concatenate(docs)
        seen = np.bincount(flat, minlength=1 << HASH_BITS)
        toxic = np.bincount(flat, weights=np.repeat(y, [len(d) for d in docs]), minlength=1 << HASH_BITS)
        share = positive / n
        often = np.flatnonzero(seen >= LEAST_DOCS)  # few of all hashes
        alone = often[chi_square(toxic[often], seen[often], float(positive), float(n)) >= LEAST_CHI2]
        frequent = np.flatnonzero(seen >= max(LEAST_DOCS, PAIR_SHARE * n))
        del flat, seen, toxic
        kept = np.union1d(alone, paired(docs, y, frequent))
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        rows = [(p := place[d])[p >= 0].astype(np.int32) for d in docs]
        rng = np.random.default_rng(seed)
        m = cls(kept, float(np.log(share / (1 - share))), np.zeros(len(kept)), rng.normal(0, SPREAD, (len(kept), FACTORS)))
        grad = [1e-6, np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6)]
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        steps = [Step.of([rows[i] for i in some], y[some], weight[some]) for some in np.array_split(rng.permutation(n), max(1, n // STEP))]
        for _ in range(EPOCHS):
            for k in rng.permutation(len(steps)).tolist():
                steps[k].take(m, grad, n)
        return m


@dataclass
class Step:
    """Some documents of the fit: terms (each once), which of them each document has, and where each term occurs."""

    terms: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    document: np.ndarray
    order: np.ndarray
    first: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Step:
        size = np.array([len(r) for r in rows])
        terms, ids = np.unique(np.concatenate(rows), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        first = np.searchsorted(ids[order], np.arange(len(terms)))
        return cls(terms, ids.astype(np.int32), np.concatenate(([0], np.cumsum(size))), np.repeat(np.arange(len(rows), dtype=np.int32), size), order.astype(np.int32), first, y, weight)

    def take(self, m: Machine, grad: list, n: int) -> None:
        w, v = m.w[self.terms], m.v[self.terms]
        some = len(self.y)
        sums = totals(v[self.ids], self.start)
        raw = m.bias + totals(w[self.ids], self.start) + 0.5 * (sums**2 - totals((v * v)[self.ids], self.start)).sum(axis=1)
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - self.y) * self.weight / some
        db = err.sum()
        grad[0] += db * db
        m.bias -= RATE * db / np.sqrt(grad[0])
        if not len(self.terms):
            return
        own = err[self.document][self.order]
        hit = np.add.reduceat(own, self.first)
        dw = hit + DECAY * w * some / n
        dv = np.add.reduceat((err[:, None] * sums)[self.document[self.order]], self.first) - hit[:, None] * v + DECAY * v
        grad[1][self.terms] += dw**2
        grad[2][self.terms] += dv**2
        m.w[self.terms] = w - RATE * dw / np.sqrt(grad[1][self.terms])
        m.v[self.terms] = v - 0.2 * RATE * dv / np.sqrt(grad[2][self.terms])


def hashed(texts: pa.Array) -> pa.Array:
    """Distinct term hashes of each text, ascending."""
    return pa.array([sorted({h for w in set(words(t)) for h in terms(w)}) for t in strings(texts)], pa.list_(pa.int32()))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Machine:
    """A machine fitted on about that many labelled documents of each class outside the held-out fold.

    A document with several labels counts as toxic if one of them is 1; labels without id or value don't count.  The sampled
    labels are bounded, so they are broadcast and the documents aren't shuffled; what comes back are term hashes.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = F.col("toxic") == 1
    n1, n0 = known.agg(F.count_if(toxic), F.count_if(~toxic)).first()
    chance = F.when(toxic, int(min(1.0, toxic_rows / max(n1, 1)) * (1 << 20))).otherwise(int(min(1.0, clean_rows / max(n0, 1)) * (1 << 20)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < chance)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.arrow_udf(hashed, "array<int>")("text").alias("terms"), toxic.cast("int").alias("toxic")).toArrow().sort_by("doc_id")
    terms_ = rows["terms"].combine_chunks()
    edges = terms_.offsets.to_numpy()
    docs_ = np.split(terms_.values.to_numpy(), edges[1:-1]) if len(rows) else []  # views of one array
    return Machine.fit(docs_, rows["toxic"].to_numpy().astype(float))


def score_column(spark: SparkSession, machine: Machine):
    """A column function: text -> score between 0 and 1."""
    shared = spark.sparkContext.broadcast((machine.kept, machine.bias, machine.w, machine.v))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Machine(*shared.value)
        place = {int(h): i for i, h in enumerate(m.kept)}
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in strings(batch):
                own: set[int] = set()
                for w in set(words(text)):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= CACHE:
                            known.clear()
                        ids = known[w] = tuple(place[h] for h in terms(w) if h in place)
                    if ids:
                        own.update(ids)
                ids = np.array(sorted(own), np.int64)
                raw = m.raw(ids, np.array([0, len(ids)]))[0]
                out.append(float(1 / (1 + np.exp(-np.clip(raw, -30, 30)))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(score, "double")


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; a null or empty text has none and gets the
    bias alone.  held_out is false where the id is null.  Other columns are ignored.
    """
    return docs.select(
        F.col("doc_id"),
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score_column(docs.sparkSession, machine)("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score_documents`` with a machine learned from ``labels``; nulls, repeats and empty tables as there and in ``train``."""
    return score_documents(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with the columns of ``docs`` whatever their names are.

    Null and empty texts have the score of no words, repeated rows are judged each; without labels of both classes, or
    with one class alone, the score is constant.  An empty table gives an empty result.
    """
    machine, score = train(docs, labels), spare(docs, "_score")
    return docs.withColumn(score, score_column(docs.sparkSession, machine)("text")).where(F.col(score) < THRESHOLD).drop(score)
