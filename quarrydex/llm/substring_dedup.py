"""Operator 9: removal of repeated passages with suffix arrays.

A passage is a string of ``LENGTH`` bytes.  The smallest hash of the short strings inside it is its key, so equal
passages share a key, and neighbouring passages with one key form a run.  Four steps, each dealt out by Spark:

1. keys that two documents have are found, key bucket by key bucket;
2. documents meet their shared keys again and cut out the text around those runs;
3. each bucket of these texts gets a suffix array by two-stage sorting, and adjacent common prefixes give the classes
   of equal passages and the smallest document of each;
4. documents meet the places to remove.

Within a task, equal keys and equal texts are combined first, so a passage that a large share of all documents has is
sent once by each task, however many documents it is in.  Steps 2 and 4 read the same shuffle of the texts.

A key may be frequent although the texts around it differ: a short string that very many documents have.  A sample of
documents tells which keys those are, and their passages are dealt out one by one, by their own hash, so no key brings
all of its documents to one task.  That is a matter of work alone: what is removed doesn't depend on it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import strings

LENGTH = 50
#: Bytes of the hashed strings inside a passage; passages of one run at most.
SHORT, RUN = 18, 256
#: Bytes of text that one bucket stands for, and that are hashed at a time, about.
BUCKET_BYTES, SHARD_BYTES = 4 << 20, 2 << 20
#: Bits of a place in a text; those above have the number of the text.
NTH = 32
#: Keys that a task combines before it sends them.
HELD_KEYS = 1 << 20
#: Documents of the sample that frequent keys are looked for in, about; documents with a key from which on it is frequent, and those of the sample at least.
SAMPLE, FREQUENT, LEAST = 200_000, 5000, 16

_RNG = np.random.Generator(np.random.PCG64(50))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
PACK = "bucket int, kind int, a binary, b binary, c binary, d binary"
SPANS = "bucket int, docs binary, low binary, high binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SHORT (18) bytes from each position."""
    base = [_BASE]
    for _ in range(4):
        base.append(base[-1] * base[-1] % (1 << 64))
    h = _BYTE[data]
    for k in range(4):  # 2, 4, 8, 16 bytes
        h = h[: -(1 << k)] * np.uint64(base[k]) + h[1 << k :]
        if k == 0:
            two = h
    return mix(h[:-2] * np.uint64(base[1]) + two[16:][: len(h) - 2])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, text, first passage (byte in its text) and number of passages of each run."""
    size = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if int(size.max(initial=0)) < LENGTH:
        return none.astype(np.uint64), none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = hashes(data)
    for k in (1, 2, 4, 8, 16, 1):  # least of 33 = LENGTH - SHORT + 1
        h = np.minimum(h[:-k], h[k:])
    begin = np.cumsum(size) - size
    many = np.maximum(size - LENGTH + 1, 0)
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    has = np.flatnonzero(many)
    new[begin[has]] = True
    stop = (begin + many)[has]  # passages that would leave their document begin here
    new[stop[stop < len(h)]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    parts = -(-length // RUN)
    if int(parts.max()) > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(length, parts)
        first = np.repeat(first, parts) + nth * RUN
        length = np.minimum(whole - nth * RUN, RUN)
    doc = np.searchsorted(begin + size, first, "right")
    inside = first < (begin + many)[doc]
    first, length, doc = first[inside], length[inside], doc[inside]
    return h[first], doc, first - begin[doc], length


def shards(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SHARD_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def of_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(np.int64) % buckets


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(ids.view(np.uint64) + np.uint64(_BASE))) >> np.uint64(11)).astype(np.int64) % buckets


def nth_texts(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The place of each row's text among the different texts of its id, in the order of their bytes; rows that share an id and a text share it."""
    out = np.zeros(len(ids), np.int64)
    order = np.argsort(ids, kind="stable")
    edge = groups(ids[order])
    for k in np.flatnonzero(np.diff(edge) > 1):
        rows = order[edge[k] : edge[k + 1]].tolist()
        nth = {t: n for n, t in enumerate(sorted({texts[i] for i in rows}))}
        out[rows] = [nth[texts[i]] for i in rows]
    return out


def groups(sorted_: np.ndarray) -> np.ndarray:
    """First places of the equal values of a sorted array, and its end."""
    return np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)])) if len(sorted_) else np.zeros(1, np.int64)


_DENSE, _PLAIN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def dense(data: bytes) -> bytes:
    return _DENSE.compress(data)


def plain(data: bytes) -> bytes:
    return _PLAIN.decompress(data)


def squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte: first the lowest of all, last the highest."""
    return dense(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def packed(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of PACK with the given columns dealt out by bucket."""
    order = np.argsort(bucket, kind="stable")
    edge = groups(bucket[order])
    columns = tuple(c[order] for c in columns)
    for a, b in zip(edge, edge[1:]):
        yield (int(bucket[order[a]]), kind, *(squeezed(c[a:b]) for c in columns), *[None] * (4 - len(columns)))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["bucket", "kind", "a", "b", "c", "d"])


def numbers(blobs: list[bytes], kind=np.int64) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(plain(b), np.uint8).reshape(8, -1).T).reshape(-1) for b in blobs]
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


def find_keys(buckets: int):
    """Step 1, by input task.  Kind 0: keys with a document that has them here, and whether several have; kind 1: for documents, keys shared here."""

    def combined(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        edge = groups(key)
        first, last = edge[:-1], edge[1:] - 1
        shared = own[first] != own[last] if len(first) else np.zeros(0, bool)
        rows = list(packed(of_bucket(key[first], buckets), 0, key[first], own[first], shared.astype(np.int64)))
        again = np.repeat(shared, np.diff(edge))
        rows += packed(doc_bucket(own[again], buckets) + buckets, 1, own[again], key[again])
        return to_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), strings(batch.column(1))
            for lo, hi in shards(texts):
                key, doc, _, _ = runs(texts[lo:hi])
                keys.append(key)
                owners.append(ids[lo:hi][doc])
                held += len(key)
                if held >= HELD_KEYS:
                    yield combined(keys, owners)
                    keys, owners, held = [], [], 0
        if held:
            yield combined(keys, owners)

    return run


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different keys of each document, one after another."""
    for batch in batches:
        texts = strings(batch.column(0))
        for lo, hi in shards(texts):
            key, doc, _, _ = runs(texts[lo:hi])
            own = np.unique(np.stack((doc.astype(np.int64), key.view(np.int64)), axis=1), axis=0)[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own))], names=["key"])


def frequent_keys(rows: DataFrame, number: int) -> np.ndarray:
    """Keys that about FREQUENT of all ``number`` documents have or more, ascending; their number is bounded by the sample's size."""
    part = min(1.0, SAMPLE / max(number, 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text")
    found = chosen.mapInArrow(keys_of, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST, FREQUENT * part))
    return np.sort(np.array(found.select("key").toArrow()["key"].to_numpy(), np.int64))


def share_keys(buckets: int):
    """Step 1, by key bucket: rows (document bucket; documents, keys) of the keys that several documents have."""

    def run(group: pa.Table) -> pa.Table:
        rows = []
        kind = np.array(group["kind"].to_pylist())
        a, b = group["a"].to_pylist(), group["b"].to_pylist()
        if len(kind) and kind[0] == 1:  # found before, by one task
            ids, key = numbers(a), numbers(b, np.uint64)
            rows = list(packed(doc_bucket(ids, buckets), 1, ids, key))
        elif len(kind):
            key, ids, several = numbers(a, np.uint64), numbers(b), numbers(group["c"].to_pylist())
            order = np.lexsort((ids, key))
            key, ids, several = key[order], ids[order], several[order]
            edge = groups(key)
            shared = (ids[edge[:-1]] != ids[edge[1:] - 1]) | (np.maximum.reduceat(several, edge[:-1]) > 0)
            take = np.repeat(shared, np.diff(edge)) & (several == 0)  # those of several were sent by their task
            rows = list(packed(doc_bucket(ids[take], buckets), 1, ids[take], key[take]))
        return pa.Table.from_batches([to_batch(rows)])

    return run


def cut_out(buckets: int, frequent: np.ndarray):
    """Step 2, by document bucket.  Kind 0: (documents, first passages, sizes, bytes) of the texts around shared runs, each once;
    kind 1: (documents, low, high) to remove already, as a smaller document here has the same text.

    A place in a text has the text's number among those of its id (``nth_texts``) above its low 32 bits, here and in all that follows.
    Passages of ``frequent`` keys go by themselves, under their own hash.
    """
    import xxhash

    often = set(frequent.tolist())

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(keys) and len(docs):
            known_doc, known_key = numbers(keys["a"].to_pylist()), numbers(keys["b"].to_pylist(), np.uint64)
            known = np.unique(known_key ^ mix(known_doc.view(np.uint64)))
            docs = docs.sort_by("doc_id")
            ids = docs["doc_id"].to_numpy()
            texts = [t for chunk in docs["text"].chunks for t in strings(chunk)]
            nth = nth_texts(ids, texts)
            seen: dict[bytes, int] = {}
            sent, gone = array("q"), array("q")  # document, first byte, size, key; document, first byte, end
            sent_texts: list[bytes] = []
            for lo, hi in shards(texts):
                key, doc, first, many = runs(texts[lo:hi])
                test = key ^ mix(ids[lo:hi][doc].view(np.uint64))
                place = np.minimum(np.searchsorted(known, test), len(known) - 1)
                hit = np.flatnonzero(known[place] == test)
                for k, d, s, n in zip(key[hit].view(np.int64).tolist(), (doc[hit] + lo).tolist(), first[hit].tolist(), many[hit].tolist()):
                    own, above = int(ids[d]), int(nth[d]) << NTH
                    pieces = [(s, n, k)] if k not in often else [(t, 1, None) for t in range(s, s + n)]
                    for s, n, k in pieces:
                        text = texts[d][s : s + n + LENGTH - 1]
                        s += above
                        least = seen.setdefault(text, own)
                        if own > least:
                            gone.extend((own, s, s + len(text)))
                        else:
                            sent.extend((own, s, len(text), xxhash.xxh64_intdigest(text) - (1 << 63) if k is None else k))
                            sent_texts.append(text)
            seen.clear()
            if sent:
                numbers_ = np.array(sent, np.int64).reshape(-1, 4)
                bucket = of_bucket(numbers_[:, 3].copy().view(np.uint64), buckets)
                order = np.argsort(bucket, kind="stable")
                edge = groups(bucket[order])
                for a, b in zip(edge, edge[1:]):
                    some = order[a:b]
                    rows.append((int(bucket[order[a]]), 0, *(squeezed(numbers_[some, k]) for k in range(3)), dense(b"".join([sent_texts[i] for i in some]))))
            if gone:
                ids, low, high = np.array(gone, np.int64).reshape(-1, 3).T.copy()
                rows += packed(doc_bucket(ids, buckets) + buckets, 1, ids, low, high)
        return pa.Table.from_batches([to_batch(rows)])

    return run


def sort_directly(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes there, compared over ``depth`` bytes at least; word: the 8 bytes from each position."""
    key = word[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        group = np.cumsum(new)[some]
        key = word[at[some] + k]
        order = np.lexsort((key, group))
        at[some] = at[some][order]
        key = key[order]
        differs = np.ones(len(some), bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[some] = differs
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes, the last one 0) in order, compared over ``depth`` bytes at least, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly.  Going through the buckets by first byte, each suffix
    in its place then puts the one before it, if that is the greater, at the next free place of its own bucket.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    word = np.ndarray((n + depth + 8,), ">u8", padded.tobytes(), strides=(1,))
    step = np.sign(np.diff(text.astype(np.int16)))
    # where two bytes are equal, the next ones that differ decide
    decided = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    small = np.zeros(n, bool)
    small[:-1] = np.append(step, -1)[np.minimum(nearest, n - 1)] > 0
    direct = sort_directly(word, np.flatnonzero(small).astype(np.int32), depth)
    by_first = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        own = []
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
        while len(now):  # a run of one byte puts its own suffixes one by one
            own.append(now)
            now = now[now > 0] - 1
            now = now[text[now] == c]
        waiting[c] = []
        own.append(direct[by_first[c] : by_first[c + 1]])
        done = np.concatenate(own)
        out.append(done)
        before = done[done > 0] - 1
        first = text[before]
        before = before[first > c]
        first = text[before]
        order = np.argsort(first, kind="stable")
        edge = groups(first[order])
        for a, b in zip(edge, edge[1:]):
            waiting[first[order[a]]].append(before[order[a:b]])
    return np.concatenate(out)


def equal_before(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares ``length`` bytes with the one before it."""
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8))).tobytes()
    word = np.ndarray((len(text) + length,), ">u8", padded, strides=(1,))
    out = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for k in [*range(0, length - 7, 8), length - 8]:
        live = live[word[order[live] + k] == word[order[live - 1] + k]]
    out[live] = True
    return out


def resolve(buckets: int):
    """Step 3, by bucket of texts: rows (document bucket; documents, low, high) to remove."""

    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_pylist()
        ids, low, high = (numbers([b for b in group[c].to_pylist() if b is not None]) for c in "abc")
        if len(kind) and kind[0] == 0:
            blob, place = b"".join([plain(b) for b in group["d"].to_pylist()]), 0
            of: dict[bytes, int] = {}
            which = np.empty(len(ids), np.int64)
            for i, n in enumerate(high.tolist()):
                which[i] = of.setdefault(blob[place : place + n], len(of))
                place += n
            least = np.full(len(of), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids)
            size = np.array([len(t) for t in of], np.int64)
            begin = np.cumsum(size + 1) - size - 1
            text = np.frombuffer(b"\xff".join([*of, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: 0 after each
            passages = np.zeros(len(text) + 1, np.int32)
            np.add.at(passages, begin, 1)
            np.add.at(passages, begin + size - LENGTH + 1, -1)
            starts = np.cumsum(passages, dtype=np.int32)[:-1] > 0
            order = suffix_array(text, LENGTH)
            order = order[starts[order]]
            edge = np.append(np.flatnonzero(~equal_before(text, order, LENGTH)), len(order))
            owner = least[np.searchsorted(begin, order, "right") - 1]
            first = np.repeat(np.minimum.reduceat(owner, edge[:-1]), np.diff(edge))
            mark = np.zeros(len(text) + 1, np.int8)
            mark[order[first < owner]] = 1
            turn = np.flatnonzero(np.diff(mark, prepend=0))
            up, down = turn[::2], turn[1::2]  # passages in the texts that an even smaller document has
            in_text = np.searchsorted(begin, up, "right") - 1
            later = ids > least[which]
            spans = [(ids[later], low[later], (low + high)[later])]
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(which[mine], kind="stable")]
            a, b = np.searchsorted(in_text, which[mine], "left"), np.searchsorted(in_text, which[mine], "right")
            row = np.repeat(mine, b - a)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            shift = low[row] - begin[which[row]]
            spans.append((ids[row], up[nth] + shift, down[nth] + shift + LENGTH - 1))
            ids, low, high = (np.concatenate(x) for x in zip(*spans))
        rows = [(b, x, y, z) for b, _, x, y, z, _ in packed(doc_bucket(np.ascontiguousarray(ids), buckets), 0, ids, low, high)]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["bucket", "docs", "low", "high"])

    return run


def remove(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Step 4, by document bucket: the rows of docs with n_bytes, n_removed, n_spans and what is left."""
    ids, low, high = (numbers(spans[c].to_pylist()) for c in ("docs", "low", "high"))
    order = np.lexsort((low, ids))
    ids, low, high = ids[order], low[order], high[order]
    out = []
    texts = [t for chunk in docs["text"].chunks for t in strings(chunk)]
    own = docs["doc_id"].to_numpy()
    for doc, nth, null, text in zip(own.tolist(), nth_texts(own, texts).tolist(), docs["no_id"].to_pylist(), texts):
        a, b = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        if b > a:
            a, b = a + np.searchsorted(low[a:b], [nth << NTH, nth + 1 << NTH])
        removed = number = 0
        if b > a:
            turn = np.zeros(len(text) + 1, np.int64)
            np.add.at(turn, low[a:b] - (nth << NTH), 1)
            np.add.at(turn, high[a:b] - (nth << NTH), -1)
            gone = np.cumsum(turn[:-1]) > 0
            removed = int(gone.sum())
            number = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        else:
            kept = text
        out.append((None if null else doc, len(text), removed, number, kept))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that are left) for each row of ``docs``.

    Each byte covered by a LENGTH-byte string that also starts in a document with a smaller id is removed; strings are judged
    on the input, and matches never cross documents.  A null text counts as empty.  Rows that share an id are one document:
    they don't match each other, but each loses the places in its own text only.  A null id counts as the largest 64-bit
    number, so rows without an id share it.  Other columns are ignored, an empty table gives an empty result.
    """
    size, number = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(8, -(-size // bucket_bytes))
    largest = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(largest)).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"))
    deal = F.arrow_udf(lambda ids: pa.array(doc_bucket(ids.to_numpy(zero_copy_only=False), buckets).astype(np.int32)), "int")
    dealt = rows.select(deal("doc_id").alias("bucket"), "doc_id", "text", "no_id")
    shared = rows.select("doc_id", "text").mapInArrow(find_keys(buckets), PACK).groupBy("bucket").applyInArrow(share_keys(buckets), PACK)
    texts = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(cut_out(buckets, frequent_keys(rows, number)), PACK)
    spans = texts.groupBy("bucket").applyInArrow(resolve(buckets), SPANS)
    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE length(h) >= 100)),
least AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS b
         FROM (SELECT p.doc_id, p.i, unnest(range(0, 50)) AS k FROM p JOIN least USING (s) WHERE p.doc_id > least.first)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE b - 1 IS DISTINCT FROM before) AS n_spans
          FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, b, substring(h, 2 * b + 1, 2) AS x
          FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT))) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM spans))),
kept AS (SELECT bytes.doc_id, string_agg(x, '' ORDER BY bytes.b) AS h
         FROM bytes LEFT JOIN gone ON gone.doc_id = bytes.doc_id AND gone.b = bytes.b WHERE gone.b IS NULL GROUP BY bytes.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
