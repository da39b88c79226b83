"""Operator 1: benchmark decontamination with suffix arrays of the training texts.

Each shard of training documents gets a suffix array over its words; every suffix
of the benchmark is looked up in it by binary search, which gives the longest
verbatim match and the places of every window that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, list_array, spare, strings

#: A-Z lower-cased; every byte outside the word class becomes a space.  Bytes above 0x7F stay, as the class has all their code points.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
WINDOW = 10
#: Bytes of benchmark text in one block; a block is broadcast, further blocks are further passes.
BLOCK_BYTES = 32 << 20
#: Words of training text in one shard, about; a document is never split.
SHARD_WORDS = 1 << 21

FOUND = "struct<n_words:bigint,hits:array<int>,items:array<string>,longest:bigint>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Block:
    """Benchmark items as word numbers (from 1), one after the other."""

    vocabulary: dict[bytes, int]
    names: list[str]
    ids: np.ndarray  # words of all items, then padding
    start: np.ndarray  # of each window, in ids; windows that go on alike to their items' ends are one
    window: np.ndarray  # words of each window
    rest: np.ndarray  # words from the window's start to its item's end
    item: np.ndarray  # the items of each window, in names, one window after the other
    first: np.ndarray  # where each window's items begin in item, and the end

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        ends: dict[tuple[int, int], int] = {}  # what is left of an item: its first word, and what is left after that
        known: dict[tuple[int, int], int] = {}  # windows: what is left of the item, words
        names, ids, start, size, rest, items = [], [], [], [], [], []
        for name, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            if own:
                k, left = min(window, len(own)), 0
                for i in reversed(range(len(own))):
                    left = ends.setdefault((own[i], left), len(ends) + 1)
                    if i > len(own) - k:
                        continue
                    at = known.setdefault((left, k), len(known))
                    if at == len(start):
                        start.append(len(ids) + i)
                        size.append(k)
                        rest.append(len(own) - i)
                        items.append([])
                    items[at].append(len(names))
                names.append(name)
                ids += own
        as_array = lambda x: np.array(x, np.int64)
        first = np.concatenate(([0], np.cumsum(as_array([len(x) for x in items]))))
        return cls(vocabulary, names, np.array([*ids, 0], np.int32), as_array(start), as_array(size), as_array(rest), as_array([i for x in items for i in x]), first.astype(np.int64))


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` in the order of their suffixes, compared over ``depth`` words at least (prefix doubling)."""
    rank = x.astype(np.int64)
    step = 1
    while True:
        if step < depth:
            after = np.zeros_like(rank)
            after[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
            step *= 2
            if step < depth and int(rank.max()) + 1 < len(rank):
                continue
        return np.argsort(rank, kind="stable")


def common(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that x from p and y from q share, ``most`` at most; whether x's suffix is the smaller there."""
    n, less = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    live = np.arange(len(p))
    d = 0
    while len(live):
        live = live[most[live] > d]
        at = p[live] + d
        a, b = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], 0), y[q[live] + d]
        less[live] = a < b
        live = live[a == b]
        d += 1
        n[live] = d
    return n, less


def search(x: np.ndarray, order: np.ndarray, block: Block, n: np.ndarray) -> np.ndarray:
    """First place in ``order`` whose suffix isn't smaller than the first ``n`` words of each window's suffix."""
    low, high = np.zeros(len(n), np.int64), np.full(len(n), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        less = common(x, order[mid], block.ids, block.start[open_], n[open_])[1]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def search_end(x: np.ndarray, order: np.ndarray, block: Block, which: np.ndarray) -> np.ndarray:
    """The place in ``order`` after the last suffix that begins with each of these windows."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    n, start = block.window[which], block.start[which]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        same, less = common(x, order[mid], block.ids, start[open_], n[open_])
        up = less | (same == n[open_])
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
    return low


def match_shard(docs: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, hit documents, hit words in them, documents with items, the items, longest match of each document)."""
    get = block.vocabulary.get
    found = [[get(w, 0) for w in words(t)] for t in docs]
    n_words = np.array([len(f) for f in found], np.int64)
    longest = np.zeros(len(docs), np.int64)
    none = np.zeros(0, np.int64)
    ids = np.zeros(int(n_words.sum()) + len(docs) + 1, np.int32)  # a 0 after each document
    begin = np.cumsum(n_words + 1) - n_words - 1
    for b, f in zip(begin.tolist(), found):
        ids[b : b + len(f)] = f
    del found
    if not len(block.start):
        return n_words, none, none, none, none, longest
    # only runs of benchmark words as long as the shortest window can hold one
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
    first, last = edge[::2], edge[1::2]
    keep = last - first >= block.window.min()
    first, size = first[keep], (last - first)[keep] + 1  # with the 0 that follows
    if not len(first):
        return n_words, none, none, none, none, longest
    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    x = ids[place]
    order = suffix_array(x, int(block.rest.max()))
    order = order[x[order] != 0]
    at = search(x, order, block, block.rest)
    best = np.zeros(len(at), np.int64)
    for near in (at - 1, at):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        best[ok] = np.maximum(best[ok], common(x, order[near[ok]], block.ids, block.start[ok], block.rest[ok])[0])
    which = np.flatnonzero(best >= block.window)
    if not len(which):
        return n_words, none, none, none, none, longest
    low = search(x, order, block, block.window)[which]
    many = search_end(x, order, block, which) - low
    row = np.repeat(np.arange(len(which)), many)
    p = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    w = which[row]
    doc = np.searchsorted(begin, place[p], "right") - 1
    np.maximum.at(longest, doc, common(x, p, block.ids, block.start[w], block.rest[w])[0])
    turn = np.zeros(len(ids) + 1, np.int64)
    np.add.at(turn, place[p], 1)
    np.add.at(turn, place[p] + block.window[w], -1)
    hit = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
    hit_doc = np.searchsorted(begin, hit, "right") - 1
    met = np.unique(doc * len(block.start) + w)
    doc, w = met // len(block.start), met % len(block.start)
    of_window = block.first[w + 1] - block.first[w]
    item = block.item[np.repeat(block.first[w] - (np.cumsum(of_window) - of_window), of_window) + np.arange(int(of_window.sum()))]
    pairs = np.unique(np.repeat(doc, of_window) * len(block.names) + item)
    return n_words, hit_doc, hit - begin[hit_doc], pairs // len(block.names), pairs % len(block.names), longest


def shards(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 6 * SHARD_WORDS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def match_column(spark, rows: list[tuple[str, bytes]], window: int):
    """A column function: text -> FOUND for one block of the benchmark."""
    shared = spark.sparkContext.broadcast(Block.of(rows, window))

    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = shared.value
        for batch in batches:
            texts, parts = strings(batch), []
            for a, b in shards(texts):
                n, hit_doc, hit, item_doc, item, longest = match_shard(texts[a:b], block)
                count = lambda x: np.bincount(x, minlength=b - a)  # noqa: B023, E731
                parts.append(
                    pa.StructArray.from_arrays(
                        [
                            pa.array(n),
                            list_array(pa.array(hit.astype(np.int32)), count(hit_doc)),
                            list_array(pa.array([block.names[i] for i in item], pa.string()), count(item_doc)),
                            pa.array(longest),
                        ],
                        ["n_words", "hits", "items", "longest"],
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array([], FOUND_TYPE)

    return F.arrow_udf(match, FOUND)


FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "leak") -> DataFrame:
    """``docs`` with a column ``out``: struct of n_words, hits (numbers of the hit words, ascending), items (ids of the
    items with occurring windows, sorted as strings, each once) and longest (words of the longest verbatim match, 0 if no window occurs).

    Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.  A window is ``window`` consecutive
    words of an item, or the whole item if it has fewer.  Null and empty texts have no words, on either side; an item without
    words has no window, an item whose id is null is named ``null``, items that share an id count once.  Rows and columns of
    ``docs`` stay as they are, repeated rows too.  The benchmark goes to the executors in blocks of about ``block_bytes``:
    one pass over ``docs`` without a shuffle for each block, with the columns cut off in between.
    """
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("item_text")).where("item_text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("name", "item_text"), F.lit(n_blocks)) == k).collect() if n_blocks > 1 else bench.collect()
        found = match_column(spark, sorted((r.name, r.item_text.encode()) for r in rows), window)(F.col(text_col))
        if k == 0:
            docs = docs.withColumn(out, found)
        else:
            fresh = spare(docs, "_new")
            new = docs.withColumn(fresh, found)
            docs = new.withColumn(
                out,
                F.struct(
                    F.col(f"{fresh}.n_words").alias("n_words"),
                    F.array_union(f"{out}.hits", f"{fresh}.hits").alias("hits"),
                    F.array_union(f"{out}.items", f"{fresh}.items").alias("items"),
                    F.greatest(f"{out}.longest", f"{fresh}.longest").alias("longest"),
                ),
            ).drop(fresh)
        if n_blocks > 1:
            docs = cut(docs, "leaks")
    return docs.withColumn(out, F.col(out).withField("hits", F.array_sort(f"{out}.hits")).withField("items", F.array_sort(F.array_distinct(f"{out}.items"))))


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``."""
    return find_leaks(docs.select("doc_id", "text"), items).select(
        "doc_id",
        "leak.n_words",
        F.size("leak.hits").cast("bigint").alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.size("leak.hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with the columns of ``docs`` whatever their names are.

    Null and empty texts stay, repeated rows are judged each, an empty table or benchmark drops nothing; words and windows as in ``find_leaks``.
    """
    leak = spare(docs, "_leak")
    return find_leaks(docs, items, out=leak).where(F.size(f"{leak}.hits") == 0).drop(leak)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM starts),
ks AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT p.doc_id, win.item_id, p.i, p.k
        FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) p JOIN win ON p.k = win.k AND p.s = win.s),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
