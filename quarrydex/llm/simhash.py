"""Operator 8: near-duplicates by SimHash, compared in bit slices.

Fingerprints that could be near meet in a bucket.  Within a chunk of buckets they are stored as bit planes; a plane
and its shifted self compare every row with the row ``d`` places on, 64 pairs in a word, and carry-save
counters add up the distances.  Words in which every pair has passed the radius are left out from there on.

Two uses: ``near_duplicates`` links 64-bit fingerprints of four-word shingles at four differing bits; two of six bit
blocks agree then, or three of seven, or four of eight, which makes the buckets.  ``similar`` is for a similarity of texts:
1,024 bits of five-word shingles, with a radius beyond what the similarity comes to, and buckets from pairs of least
shingle hashes, give candidates; the shingle sets of those decide.

Buckets are counted before anything is compared, so none that is large comes to one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, spare, strings
from .components import components
from .decontaminate import words as words_of

SHINGLE, RADIUS, SEED = 4, 4, 42
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Blocks that the bits are cut into, and for how many fingerprints at most: a few fall into one bucket then.  RADIUS fewer blocks than these agree.
BLOCKS = ((RADIUS + 2, 1 << 26), (RADIUS + 3, 1 << 31), (RADIUS + 4, 1 << 62))
#: Rows of a bucket that one task compares, of 64 bits and of wide ones; a larger bucket is dealt out by pairs of parts.
LARGE, LARGE_WIDE = 4096, 1024
#: Rows compared at a time, and words of planes at a time, with as many distances as that takes.
CHUNK, AT_ONCE = 1 << 17, 1 << 11
FOUND = "a bigint, b bigint"


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: bit i is set if over half of the shingles' hashes have it."""
    import xxhash

    hash_ = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n <= 1:
        return hash_(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[SHINGLE - 1 :]
    count = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        h = np.array([hash_(whole[s:e], SEED) for s, e in zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in strings(texts)], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    return F.arrow_udf(_fingerprints, "bigint")(text)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Rows of words, as many as bits: bit i of plane b is bit b of fingerprint i (a row of bytes); a spare word of zeros at the end."""
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    words = -(-len(prints) // 64) + 1
    packed = np.zeros((bits.shape[1], 8 * words), np.uint8)
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    packed[:, : rows.shape[1]] = rows
    return packed.view("<u8")


def near(planes: np.ndarray, distances: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of the pairs (i, i + d) with bit i set in the row of ``lanes`` for d, one of ``distances``, bits for those within ``radius``.

    The words of several distances are compared side by side, so few rows don't mean short arrays.
    """
    out = np.zeros_like(lanes)
    which, word = np.nonzero(lanes)
    count = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]  # a bit of all counters each
    over = np.zeros(len(word), np.uint64)
    for g in range(0, len(planes), 8):
        shift = (distances[which] & 63).astype(np.uint64)
        place = word + (distances[which] >> 6)
        other = planes[g : g + 8, place] >> shift | planes[g : g + 8, place + 1] << (np.uint64(63) - shift) << np.uint64(1)
        for x in planes[g : g + 8, word] ^ other:
            for k, c in enumerate(count):
                carry = c & x
                count[k] = c ^ x
                x = carry
            over |= x
        far, same = over.copy(), ~np.zeros(len(word), np.uint64)
        for k in reversed(range(len(count))):  # counts above the radius
            if radius >> k & 1:
                same &= count[k]
            else:
                far |= same & count[k]
                same &= ~count[k]
        alive = lanes[which, word] & ~far
        keep = np.flatnonzero(alive)
        if len(keep) < len(word):
            which, word, over, count = which[keep], word[keep], over[keep], [c[keep] for c in count]
        if not len(word):
            return out
    out[which, word] = alive[keep]
    return out


def links_in(bucket: np.ndarray, ids: np.ndarray, prints: np.ndarray | None = None, radius: int = RADIUS, alike=None, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) between rows of equal ``bucket`` (sorted): enough of them to join all that are joined by near pairs.  Without prints the ids are the fingerprints.

    ``alike``: a function of the rows i and j of near pairs, which says for each whether it counts.  ``joined``: flags of rows that
    are one piece with all others so flagged in their bucket, so no links between those are looked for.
    """
    if prints is None:
        prints = ids.astype("<i8").view(np.uint8).reshape(-1, 8)
    a, b = [], []
    label = np.arange(len(prints))
    if joined is not None and len(label):
        flagged = np.flatnonzero(joined)
        one = np.unique(bucket[flagged], return_index=True, return_inverse=True)
        label[flagged] = flagged[one[1]][one[2]]
    rows, d = np.arange(len(prints)), 1
    while True:
        # from time to time only the buckets that are still open are packed again: with pairs left, and in several pieces
        first, size = np.unique(bucket[rows], return_index=True, return_counts=True)[1:]
        if len(rows):
            own = label[rows]
            rows = rows[np.repeat((size > d) & (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)), size)]
            size = np.unique(bucket[rows], return_counts=True)[1]
        if not len(rows):
            return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        planes, own = planes_of(prints[rows]), bucket[rows]
        stop, step = min(2 * d, int(size.max())), max(1, AT_ONCE // planes.shape[1])
        for d in range(d, stop, step):
            distances = np.arange(d, min(d + step, stop))
            same = np.zeros((len(distances), 64 * planes.shape[1]), bool)
            for row, e in zip(same, distances.tolist()):
                row[: len(own) - e] = (own[:-e] == own[e:]) & (label[rows[:-e]] != label[rows[e:]])
            d = int(distances[-1])
            if not same.any():
                continue
            hit = near(planes, distances, np.packbits(same, axis=1, bitorder="little").view("<u8"), radius)
            e, i = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
            i, j = rows[i], rows[i + distances[e]]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if alike is not None and len(i):
                counts = alike(i, j)
                i, j = i[counts], j[counts]
            if len(i):
                first = np.unique(np.stack((label[i], label[j]), axis=1), axis=0, return_index=True)[1]
                joins = []
                for k, p, q in zip(first.tolist(), i[first].tolist(), j[first].tolist()):
                    while label[p] != p:
                        p = label[p]
                    while label[q] != q:
                        q = label[q]
                    if p != q:
                        label[max(p, q)] = min(p, q)
                        joins.append(k)
                a.append(ids[i[joins]])
                b.append(ids[j[joins]])
                while (label != (up := label[label])).any():
                    label = up
        d += 1


def compare(radius: int = RADIUS):
    """Over rows (bucket, id[, print]) sorted by bucket: links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket, rows):
            a, b = links_in(bucket, rows[:, 0].copy(), np.ascontiguousarray(rows[:, 1:]).view(np.uint8) if rows.shape[1] > 1 else None, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        bucket, prints = np.zeros(0, np.int64), None
        for batch in batches:
            own = [batch.column(1).to_numpy(zero_copy_only=False)[:, None]]
            if batch.num_columns > 2:
                own.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(len(batch), -1))
            bucket = np.concatenate((bucket, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate([*([] if prints is None else [prints]), np.concatenate(own, axis=1)])
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if last >= CHUNK:
                yield done(bucket[:last], prints[:last])
                bucket, prints = bucket[last:], prints[last:]
        if len(bucket):
            yield done(bucket, prints)

    return run


def block_keys(prints: DataFrame, blocks: int) -> DataFrame:
    """bucket, id: each fingerprint (column print) under every choice of ``blocks`` - RADIUS of its blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    value = lambda k: F.shiftrightunsigned("print", edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1))
    keys = []
    for t, some in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(blocks << 8 | t).cast("bigint")
        for k in some:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(value(k))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), F.col("print").alias("id"))


def large_buckets(dealt: DataFrame, large: int) -> DataFrame:
    """bucket, n of those with more than ``large`` rows, written out, so that joins know how few they are."""
    return cut(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large), "large-buckets")


def near_links(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """Links a, b among the distinct fingerprints of ``prints`` (column print): every near pair is joined by a path of them.

    The number of fingerprints decides how many blocks there are.  Fingerprints of a bucket that is large all the same
    meet in narrower ones.
    """
    if blocks is None:
        number = prints.count()
        blocks = next(b for b, most in BLOCKS if number <= most)
    dealt = block_keys(prints, blocks)
    finest = BLOCKS[-1][0]
    if blocks < finest:
        hot = large_buckets(dealt, LARGE)
        crowded = dealt.join(hot, "bucket", "left_semi").select(F.col("id").alias("print")).distinct()
        dealt = dealt.join(hot, "bucket", "left_anti").union(block_keys(crowded, finest))
    return bucket_links(dealt, RADIUS, LARGE)


def bucket_links(dealt: DataFrame, radius: int, large: int) -> DataFrame:
    """Links a, b among rows (bucket, id[, print]) that share a bucket; without prints the ids are the fingerprints.

    The rows of a bucket with more than ``large`` are dealt to parts, and every two parts meet in a bucket of their own.
    """
    parts = large_buckets(dealt, large).select("bucket", F.ceil(F.col("n") * 2 / large).cast("int").alias("parts"))
    marked = dealt.join(parts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = marked.withColumn("other", other).withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))))
    return met.select(*dealt.columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare(radius), FOUND)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    Fingerprints that differ in at most four bits are linked, and so are rows with equal ones; component_id is the
    smallest id that links lead to.  Null and empty texts have fingerprint zero.  A row with a null id counts as a row
    but never names its component; where no row of a component has an id, component_id is null.  Repeated rows are equal
    rows of the result.  Other columns are ignored, an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprints(F.col(text_col)).alias("print")), "fingerprints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    labels = components(near_links(prints.select("print")))
    labelled = prints.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("print", "component_id"), "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: For a similarity of texts: words of a shingle, similarity (Jaccard), least hashes, and how many of them make a bucket.
WORDS, SIMILARITY, LEAST_HASHES, IN_BUCKET = 5, 0.8, 24, 2
WIDE = 16  # times 64 bits
_RNG = np.random.Generator(np.random.PCG64(8))
_ODD = _RNG.integers(0, 1 << 63, LEAST_HASHES + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Members of a group that meet its smallest id in one part, about: a larger group is dealt to more parts, with its smallest id in each.
PER_PART = 256
#: Members of candidate groups up to which their ids are sent to the texts; of more, texts and ids are dealt out by id.
MOST_SENT = 2_000_000
#: Bytes of shingle sets that one task compares, about; a larger group is dealt out by pairs of parts.
LARGE_SETS = 64 << 20
#: Bytes of shingle sets of whole groups that are compared at a time.
CHUNK_SETS = 16 << 20
#: Sets of a bucket from which on they are compared as bits, and bytes of those at most.
FEW, PACKED_BYTES = 32, 64 << 20


def differing(m: int, n: int, both: int) -> float:
    """Chance that a bit differs between the fingerprints of sets of ``m`` and ``n`` shingles that have ``both`` in common."""
    law = lambda k: functools.reduce(np.convolve, [np.array([0.5, 0.5])] * k, np.ones(1))
    one = lambda own: np.array([law(own - both)[max(0, own // 2 + 1 - c) :].sum() for c in range(both + 1)])
    p, q = one(m), one(n)
    return float((law(both) * (p * (1 - q) + q * (1 - p))).sum())


@functools.lru_cache
def radius_of(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits of candidates: what a Jaccard similarity comes to at most, plus five standard deviations.

    Large shingle sets at that similarity have the cosine 2s / (1 + s); for sets of up to 40 shingles the chance is counted out.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    for m in range(1, 41):
        for n in range(m, min(40, int(m / similarity + 1e-9)) + 1):
            share = max(share, differing(m, n, int(np.ceil(similarity * (m + n) / (1 + similarity) - 1e-9))))
    return int(np.ceil(bits * share + 5 * np.sqrt(bits * share * (1 - share))))


class Sets:
    """Sets of 64-bit numbers, each as its bytes in order; what several sets of a bucket have in common is kept as bits."""

    def __init__(self, sets: list[bytes], bucket: np.ndarray, similarity: float):
        self.sets, self.similarity = sets, similarity
        self.size = np.array([len(x) // 8 for x in sets], np.int64)
        self.bits: dict[int, np.ndarray] = {}
        self.first = np.zeros(len(sets), np.int64)  # of its bucket, for rows whose bucket has bits
        self.packed = np.zeros(len(sets), bool)
        edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            if b - a >= FEW and (bits := self.pack(a, b)) is not None:
                self.bits[a], self.first[a:b], self.packed[a:b] = bits, a, True

    def pack(self, a: int, b: int) -> np.ndarray | None:
        """A row of bits for each set from ``a`` to ``b``: which of the numbers that several of them have; None where that is too much."""
        flat = np.frombuffer(b"".join(self.sets[a:b]), "<u8")
        value, at, many = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(many > 1)
        width = -(-len(shared) // 64) + 1
        if (b - a) * width * 8 > PACKED_BYTES:
            return None
        place = np.full(len(value), -1)
        place[shared] = np.arange(len(shared))
        column, row = place[at], np.repeat(np.arange(b - a), self.size[a:b])
        row, column = row[column >= 0], column[column >= 0]
        out = np.zeros((b - a, width * 8), np.uint8)
        np.bitwise_or.at(out, (row, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
        return out.view(np.uint64)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets i and j, of one bucket each, are that similar (Jaccard)."""
        both = np.zeros(len(i), np.int64)
        for k in np.flatnonzero(~self.packed[i]).tolist():
            both[k] = len(np.intersect1d(np.frombuffer(self.sets[i[k]], "<u8"), np.frombuffer(self.sets[j[k]], "<u8"), assume_unique=True))
        for a in np.unique(self.first[i[self.packed[i]]]).tolist():
            bits, own = self.bits[a], np.flatnonzero(self.packed[i] & (self.first[i] == a))
            step = max(1, (4 << 20) // bits.shape[1])
            for k in range(0, len(own), step):
                some = own[k : k + step]
                both[some] = np.bitwise_count(bits[i[some] - a] & bits[j[some] - a]).sum(axis=1)
        return both >= self.similarity * (self.size[i] + self.size[j] - both)


def shingle_set(text: bytes) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order.

    Words are runs of letters, digits and what is beyond ASCII, whatever their case and punctuation; a text without such words has those between its blanks.
    """
    import xxhash

    words = words_of(text) or text.translate(LOWER).split()
    whole = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    n = max(1, len(words) - WORDS + 1)
    starts, ends = [0, *(e + 1 for e in ends[: n - 1])], ends[WORDS - 1 :] or [len(whole)]
    return np.unique(np.array([xxhash.xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts, ends)], "<u8"))


def wide_print(text: bytes) -> tuple[bytes, list[int], np.ndarray]:
    """1,024-bit SimHash of a text's distinct shingles, its bucket keys and the shingles' hashes; all texts without words are alike."""
    import xxhash

    hashes = shingle_set(text)
    count, least = np.zeros(64 * WIDE, np.int64), np.full(LEAST_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1 << 13):
        some = hashes[k : k + (1 << 13)]
        mixed = some[:, None] * _ODD[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed[:, :LEAST_HASHES].min(axis=0))
        wide = np.ascontiguousarray(mixed[:, LEAST_HASHES:]).astype("<u8")
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # as many as a byte counts
            count += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    keys = [hash_ for k in range(0, LEAST_HASHES, IN_BUCKET) for hash_ in [xxhash.xxh64_intdigest(least[k : k + IN_BUCKET].tobytes(), k)]]
    return np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), keys, hashes


def _wide(texts: pa.Array) -> pa.Array:
    import xxhash

    found = [(p, np.array(k, np.uint64).view(np.int64), xxhash.xxh64_intdigest(h.tobytes())) for p, k, h in map(wide_print, strings(texts))]
    same = pa.array(np.array([x for _, _, x in found], np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([pa.array([p for p, _, _ in found], pa.binary()), pa.array([k for _, k, _ in found], pa.list_(pa.int64())), same], ["print", "keys", "same"])


def _sets(texts: pa.Array) -> pa.Array:
    found = [(p, h.tobytes()) for p, _, h in map(wide_print, strings(texts))]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["print", "shingles"])


def confirm(radius: int, similarity: float):
    """Over rows (bucket, id, print, shingles, covered) sorted by bucket: links (a, b) of rows with similar sets; covered ones are joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket, ids, prints, sets, covered):
            prints = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links_in(bucket, ids, prints, radius, Sets(sets, bucket, similarity).alike, covered)], names=["a", "b"])

        bucket, ids, prints, sets, covered, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], np.zeros(0, bool), 0
        for batch in batches:
            bucket = np.concatenate((bucket, batch.column(0).to_numpy(zero_copy_only=False)))
            ids = np.concatenate((ids, batch.column(1).to_numpy(zero_copy_only=False)))
            prints += batch.column(2).to_pylist()
            sets += batch.column(3).to_pylist()
            covered = np.concatenate((covered, batch.column(4).to_numpy(zero_copy_only=False)))
            size += batch.nbytes
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if size >= CHUNK_SETS and last:
                yield done(bucket[:last], ids[:last], prints[:last], sets[:last], covered[:last])
                bucket, ids, prints, sets, covered = bucket[last:], ids[last:], prints[last:], sets[last:], covered[last:]
                size = sum(map(len, sets))
        if len(bucket):
            yield done(bucket, ids, prints, sets, covered)

    return run


def jaccard(similarity: float):
    """A column function: whether two sets, as their bytes in order, are that similar."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, before, known = [], None, None
        for x, y in zip(a, b):
            if before is None or not y.equals(before):
                before, known = y, np.frombuffer(y.as_py(), "<u8")
            own = np.frombuffer(x.as_py(), "<u8")
            both = len(np.intersect1d(own, known, assume_unique=True))
            out.append(both >= similarity * (len(own) + len(known) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def with_first(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``held`` (root, id, print, shingles) with the part of its group that a row is in (salt), and root, salt, first: the set of each
    group's smallest id for each part.  Only groups of more than PER_PART rows have several parts."""
    parts = large_buckets(held.select(F.col("root").alias("bucket")), PER_PART).select(F.col("bucket").alias("root"), F.ceil(F.col("n") / PER_PART).cast("int").alias("parts"))
    several = F.coalesce("parts", F.lit(1))
    # the texts of an id may be several; the root's first one speaks for it
    first = held.where("id = root").groupBy("root").agg(F.min_by("shingles", "print").alias("first"))
    first = first.join(parts, "root", "left").select("root", F.explode(F.sequence(F.lit(0), several - 1)).alias("salt"), "first")
    salted = held.join(parts, "root", "left").withColumn("salt", F.pmod(F.xxhash64("id", "print"), several).cast("int")).drop("parts")
    return salted, first


def similar_links(rows: DataFrame, candidates: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links a, b between ids of ``rows`` (id, text) that candidate links (a, b) join, by whatever path, and whose shingle sets are that similar.

    Every member of a group that candidates join is compared with the group's smallest id first; those similar to it are one
    piece.  What is left meets itself and that piece, part by part where the group is large: a group of copies of one text,
    however many, costs a comparison each.
    """
    group = cut(components(candidates), "candidate-groups")
    members = group.select(F.col("node").alias("id"), "root").union(group.select(F.col("root").alias("id"), "root").distinct())
    # only candidates' texts are looked at, and the others not dealt out
    members = F.broadcast(members) if 2 * group.count() <= MOST_SENT else members
    sets = F.arrow_udf(_sets, "struct<print:binary,shingles:binary>")
    held = rows.where("id is not null").join(members, "id").select("root", "id", sets("text").alias("x")).select("root", "id", "x.*")
    held = cut(held.groupBy("root", "id", "print").agg(F.first("shingles").alias("shingles")), "candidate-sets")
    salted, first = with_first(held)
    held = cut(salted.join(first, ["root", "salt"]).withColumn("covered", jaccard(similarity)("shingles", "first")).drop("salt", "first"), "candidate-pieces")
    n, size = F.count(F.lit(1)), F.sum(F.octet_length("shingles"))
    many = F.when((n > LARGE_WIDE) | (size > LARGE_SETS), F.ceil(F.greatest(n / LARGE_WIDE, size / LARGE_SETS) * 2)).otherwise(1).cast("int")
    counts = held.groupBy("root", "covered").agg(n.alias("n"), many.alias("parts"))
    pieces = counts.groupBy("root").agg(*[F.coalesce(F.max(F.when(F.col("covered") == c, F.col("parts"))), F.lit(0)).alias(name) for name, c in (("inner", True), ("outer", False))])
    open_ = held.join(pieces.where("outer > 0"), "root").withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("covered"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    columns = ["id", "print", "shingles", "covered"]
    # the rest meets the rest, two parts at a time, and each part of it each part of the piece
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("other")
    rest = open_.where("not covered").select("root", "part", *columns, up_to("outer"))
    rest = rest.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), *columns)
    left = open_.where("not covered and inner > 0").select("root", "part", *columns, up_to("inner")).select(F.xxhash64("root", "part", "other", F.lit("piece")).alias("bucket"), *columns)
    right = open_.where("covered").select("root", "part", *columns, up_to("outer")).select(F.xxhash64("root", "other", "part", F.lit("piece")).alias("bucket"), *columns)
    dealt = rest.union(left).union(right).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(confirm(radius, similarity), "a bigint, b bigint")
    return found.union(held.where("covered and id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))


def similar(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: one row per row of ``docs``; documents whose sets of five-word shingles are that similar (Jaccard) or more are linked.

    Two such documents share one of twelve buckets but for one pair in 200,000 at similarity 0.8, and their fingerprints are
    within the radius but for fewer than that; candidates are then decided by their whole shingle sets.
    Texts without words are alike.  Nulls, repeated rows, ties and empty tables as in ``near_duplicates``, but that
    rows that share an id may be linked through it; component_id is null where only rows without an id are alike.
    """
    wide = F.arrow_udf(_wide, "struct<print:binary,keys:array<bigint>,same:bigint>")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = cut(texts.select(F.col("id").alias("doc_id"), wide("text").alias("x")).select("doc_id", "x.print", "x.keys", "x.same"), "wide-prints")
    # equal sets have equal keys
    prints = cut(rows.groupBy("print", "same").agg(F.min("doc_id").alias("id"), F.min("keys").alias("keys")).where("id is not null"), "distinct-prints")
    dealt = prints.select(F.explode("keys").alias("bucket"), "id", "print")
    candidates = bucket_links(dealt, radius_of(similarity), LARGE_WIDE)
    links = similar_links(texts, candidates, radius_of(similarity), similarity)
    labelled = prints.select("id", "print", "same").join(components(links).withColumnRenamed("node", "id"), "id", "left").select("print", "same", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "print", "same").join(labelled, ["print", "same"], "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component of ``similar`` ones: that with the smallest id.  Rows without an id stay; rows that share an id stay if one of them does."""
    marked = similar(docs, similarity)
    name = spare(docs, "_kept")
    kept = marked.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = kept.union(docs.sparkSession.range(1).select(F.lit(None).cast("bigint").alias(name)))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")
