"""Operator 3: language identification by prediction by partial matching.

Each language has a tree of byte contexts with frozen counts.  A byte is coded in the longest
known context; where it wasn't seen, an escape leads to the next shorter one, without the bytes
that the longer ones have ruled out (escape estimate C).  The language with the least total code
length wins.  As the statistics are frozen, the code length of a byte depends on its context alone,
so all of them are laid out in one table, and a batch of texts is walked through it at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, list_array, strings

#: Bytes of context at most.
ORDER = 3
#: Training documents of each language, about; they are chosen by a hash of their ids.
TRAIN_ROWS = 600
#: Bytes of a model that goes to the executors at a time; languages beyond it are scored in further passes.
MODEL_BYTES = 128 << 20
#: Contexts whose code lengths are laid out at a time.
AT_ONCE = 4096
FOLDS, HELD_OUT = 5, 0


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def without_last(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The context of each gram of ``n`` bytes; a gram is a number: its length, then its bytes."""
    return (gram >> 8) - (np.int64(1) << (8 * (n - 1)))


def without_first(context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The next shorter one of contexts of ``n`` bytes, n at least 1."""
    return ((n - 1) << (8 * (n - 1))) | context & ((np.int64(1) << (8 * (n - 1))) - 1)


def bytes_in(gram: np.ndarray) -> np.ndarray:
    return np.digitize(gram, [1 << 8, 2 << 16, 3 << 24, 4 << 32])


@dataclass
class Trees:
    languages: list[str]
    symbol: np.ndarray  # of each byte; 0: never seen
    step: list[np.ndarray]  # step[k][node, symbol]: the node one byte further back, or the node itself
    bits: np.ndarray  # [node, symbol, language] in parts of a bit
    unit: int = 1  # parts of a bit: the sums are exact

    @classmethod
    def of(cls, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Trees:
        """From all strings of 1 to ``order`` + 1 bytes in each language, as numbers, and how often each occurs.

        Every context that occurs is a node and every count stays: none is too rare.  A context of a string that occurs
        has all its own ends among the contexts, so the next shorter one is always there.
        """
        languages = sorted(grams)
        length = {language: bytes_in(grams[language][0]) for language in languages}
        one = [grams[language][0][length[language] == 1] & 0xFF for language in languages]
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *one]))
        symbol = np.zeros(256, np.int16)
        symbol[used] = np.arange(1, len(used) + 1)
        contexts = np.unique(np.concatenate([np.zeros(1, np.int64), *(without_last(grams[x][0], length[x]) for x in languages)]))  # by length, then bytes
        n = bytes_in(contexts)
        parent = np.full(len(contexts), -1)
        parent[n > 0] = np.searchsorted(contexts, without_first(contexts[n > 0], n[n > 0]))
        step = []
        for k in range(order):
            shallow, deeper = int((n <= k).sum()), np.flatnonzero(n == k + 1)
            table = np.repeat(np.arange(shallow, dtype=np.int32)[:, None], len(used) + 1, axis=1)
            table[parent[deeper], symbol[contexts[deeper] >> 8 * k & 0xFF]] = deeper
            step.append(table)
        exact = []
        for language in languages:
            gram, many = grams[language]
            counts = np.zeros((len(contexts), len(used) + 1), np.int32)
            counts[np.searchsorted(contexts, without_last(gram, length[language])), symbol[gram & 0xFF]] = many
            exact.append(np.concatenate([cls.lengths(counts, parent, np.arange(a, min(a + AT_ONCE, len(contexts)))) for a in range(0, len(contexts), AT_ONCE)]))
        # as fine a unit as 16 bits hold
        longest = max((float(x.max()) for x in exact), default=1.0)
        unit = 1024
        while longest * unit > np.iinfo(np.uint16).max:
            unit //= 2
        bits = np.stack([np.rint(x * unit).astype(np.uint16) for x in exact], axis=2) if exact else np.zeros((1, 1, 0), np.uint16)
        return cls(languages, symbol, step, bits, unit)

    def size(self) -> int:
        return self.bits.nbytes + sum(t.nbytes for t in self.step)

    @staticmethod
    def size_of(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> int:
        """What ``size`` of the trees of these languages will be, from their contexts and symbols alone."""
        contexts, used = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for gram, _ in grams.values():
            n = bytes_in(gram)
            contexts.append(np.unique(without_last(gram, n)))
            used.append(np.unique(gram[n == 1] & 0xFF))
        of_length = np.bincount(bytes_in(np.unique(np.concatenate(contexts))), minlength=order + 1)
        symbols = len(np.unique(np.concatenate(used))) + 1
        return int(symbols * (2 * len(grams) * of_length.sum() + 4 * np.cumsum(of_length)[:order].sum()))

    @staticmethod
    def lengths(counts: np.ndarray, parent: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each symbol in the contexts ``at``."""
        out = np.zeros((len(at), counts.shape[1]), np.float32)
        coded, ruled_out = np.zeros(out.shape, bool), np.zeros(out.shape, bool)
        while (at >= 0).any():
            own = np.where(ruled_out | (at < 0)[:, None], 0, counts[at])
            all_, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                here = -np.log2(own / (all_ + kinds))
                escape = np.where(kinds > 0, -np.log2(kinds / (all_ + kinds)), 0)
            now = (own > 0) & ~coded
            out = np.where(now, out + here, np.where(coded, out, out + escape)).astype(np.float32)
            coded |= now
            ruled_out |= own > 0
            at = np.where(at >= 0, parent[at], -1)
        left = 256 - ruled_out.sum(axis=1, keepdims=True)
        return np.where(coded, out, out + np.log2(np.maximum(left, 1))).astype(np.float32)

    def code_lengths(self, texts: list[bytes], chunk: int = 1 << 19) -> np.ndarray:
        """[text, language]: code length of each text, in parts of a bit."""
        order = len(self.step)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size
        pad = b"\x00"  # overwritten below by a symbol that no context has
        sym = self.symbol[np.frombuffer(pad + pad.join(texts) + pad, np.uint8)]
        sym[begin - 1] = 0
        sym = np.concatenate((np.zeros(order, np.int16), sym))
        begin = begin + order
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        edges = np.stack((begin, begin + size), axis=1)
        for a in range(order, len(sym), chunk):
            b = min(a + chunk, len(sym))
            node, deep = np.zeros(b - a, np.int32), np.ones(b - a, bool)  # deep: the context still grows
            for k, table in enumerate(self.step):
                new = np.where(deep, table[np.where(deep, node, 0), sym[a - k - 1 : b - k - 1]], node)
                deep = new != node
                node = new
            bits = self.bits[node, sym[a:b]]
            lo, hi = np.clip(edges[:, 0], a, b) - a, np.clip(edges[:, 1], a, b) - a
            rows = np.flatnonzero(hi > lo)
            if len(rows):
                # between two texts stands the pad: sums over [lo, hi) and over the gap behind it
                cut_at = np.stack((lo[rows], hi[rows]), axis=1).ravel()
                short = cut_at[-1] == b - a
                sums = np.add.reduceat(bits, cut_at[:-1] if short else cut_at, axis=0, dtype=np.int64)
                out[rows] += sums[::2]
        return out


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (its length, then its bytes, in one number), n over (lang, text)."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for text in texts:
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                for n in range(1, ORDER + 2):
                    if len(data) >= n:
                        key = np.full(len(data) - n + 1, n, np.int64)
                        for k in range(n):
                            key = key << 8 | data[k : len(data) - n + 1 + k]
                        gram, many = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(many)], names=["lang", "gram", "n"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Strings of up to ORDER + 1 bytes and their numbers, by language, from about ``rows`` documents of each outside the held-out fold, counted on the executors.

    Documents without language, text or id aren't learned from.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(id_col="doc_id", folds=FOLDS) != HELD_OUT))
    many = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return {}
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, int(min(1.0, rows / n) * (1 << 20)))]), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < chance)
    counts = chosen.select("lang", "text").mapInArrow(gram_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = counts["lang"].combine_chunks().dictionary_encode(), counts["gram"].to_numpy(), counts["n"].to_numpy()
    at = lang.indices.to_numpy()
    return {name: (gram[at == k], n[at == k]) for k, name in enumerate(lang.dictionary.to_pylist())}


@dataclass
class Block:
    """Languages whose trees are laid out together, and their counts; the trees exist only while a pass over the texts needs them."""

    grams: dict[str, tuple[np.ndarray, np.ndarray]]

    @property
    def languages(self) -> list[str]:
        return sorted(self.grams)

    def trees(self) -> Trees:
        return Trees.of(self.grams)


def blocks(grams: dict[str, tuple[np.ndarray, np.ndarray]], model_bytes: int = MODEL_BYTES) -> list[Block]:
    """All languages, or halves of them and so on until the trees of each will be within ``model_bytes``; a single language stays whole.

    Sizes are known from the contexts that occur, so nothing is laid out that is too large.
    """
    if len(grams) < 2 or Trees.size_of(grams) <= model_bytes:
        return [Block(grams)]
    names = sorted(grams)
    return [t for part in (names[: len(names) // 2], names[len(names) // 2 :]) for t in blocks({k: grams[k] for k in part}, model_bytes)]


def length_column(spark: SparkSession, trees: Trees):
    """A column function: text -> bits of its code in each of the trees' languages; and what was broadcast for it."""
    shared = spark.sparkContext.broadcast((trees.languages, trees.symbol, trees.step, trees.bits, trees.unit))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = Trees(*shared.value)
        for batch in batches:
            texts = strings(batch)
            parts = [trees.code_lengths(texts[k : k + 256]) / trees.unit for k in range(0, len(texts), 256)]
            flat = np.concatenate([np.zeros((0, len(trees.languages))), *parts])
            yield list_array(pa.array(flat.ravel()), np.full(len(flat), flat.shape[1]))

    return F.arrow_udf(score, "array<double>"), shared


def identify(docs: DataFrame, trees: list[Block], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    A null text, one without a letter, and every text where no language was learned is ``und`` with score 0.  score is
    the best language's probability among the learned ones, all held equally likely before.  Ties go to the first
    language by name.  held_out is false where the id is null.  Other columns are ignored.  Several blocks of trees are
    a pass over the texts each, written to the shared folder in between, so one at a time is held by the driver and the executors.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    languages = [x for t in trees for x in t.languages]
    if not languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    for k, t in enumerate(trees):
        lengths, shared = length_column(docs.sparkSession, t.trees())
        rows = rows.withColumn(f"bits{k}", lengths("text"))
        if len(trees) > 1:
            rows = cut(rows, "code-lengths")
            shared.destroy()
    rows = rows.select("doc_id", "held_out", "letter", F.concat(*[f"bits{k}" for k in range(len(trees))]).alias("bits"))
    rows = rows.withColumn("least", F.array_min("bits"))
    share = F.aggregate("bits", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), F.greatest(F.col("least") - x, F.lit(-1000.0))))
    best = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("bits", F.col("least")).cast("int"))
    return rows.select("doc_id", "held_out", F.when(F.col("letter"), best).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), 1 / share).otherwise(0.0).alias("score"))


def language_report(docs: DataFrame) -> DataFrame:
    """``identify`` with trees learned from the same table; nulls, repeats and empty tables as there and in ``train``."""
    return identify(docs, blocks(train(docs)))
