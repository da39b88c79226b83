"""Operator 7: token ids in a content-addressed store.

A rolling hash over the id stream of each document cuts it into chunks.  A chunk is
stored once, under the digest of its bytes; a recipe lists the digests of a document.
Merkle trees go up from the entries of a recipe over blocks of documents and parts to one root of the whole store.

Files under one folder, all Parquet:

``pieces/kind=0``    digest, payload (ids, little endian): every chunk once
``recipes``          doc_id, part, block, at, n_tokens, recipe, root; in ascending doc_id order within and across parts
``manifest/blocks``  part, block, docs, tokens, root; a block has at most BLOCK documents of a part
``manifest/parts``   part, base, docs, tokens, root; ``at + base`` is the number of ids before a document
``manifest/whole``   width (bytes of an id), docs, tokens, root

``read_report`` and ``reconstruct`` compute all of these again from what they read, and fail where something differs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import new_path, slices

DIGEST = 16
#: A recipe entry: digest, then the chunk's number of ids.
ENTRY = np.dtype([("digest", f"V{DIGEST}"), ("n", "<u4")])
#: Ids a rolling hash covers; ids in a chunk, at least, about and at most.
SPAN, LEAST, ABOUT, MOST = 16, 64, 256, 1024
#: Documents of a block of the manifest.
BLOCK = 4096
#: Bytes of text that are encoded at a time, about; entries of a worker's cache of encoded pieces, and digests it remembers to have sent.
TEXT_BYTES, CACHE, SENT = 4 << 20, 1_200_000, 50_000
END_ID = 2

PIECES = "kind int, digest binary, payload binary, doc_id bigint, n_tokens bigint, nth bigint"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# How the tokenizer file describes the splitting that the shortcut by parts relies on.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
END_OF_WORD = "</w>"


def stretches(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of ``n`` each, one stretch after another."""
    ends = np.cumsum(n, dtype=np.int32)
    return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(n) else 0, dtype=np.int32)


class Encoder:
    """Encodes texts by way of their parts between ASCII white space.

    The tokenizer's own splitting never joins characters across white space, nor a letter and the punctuation behind it,
    and it ignores case where no mark follows; so a text's ids are those of its parts, and many parts are a word and its punctuation.
    Each distinct piece is encoded once and kept in a bounded cache.
    A tokenizer file that splits in another way gets whole texts.
    """

    #: A part of letters (or any characters beyond ASCII), then punctuation without apostrophes.
    PIECES = r"^(?P<word>[A-Za-z\x80-\xff]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"
    #: A capital before a character from U+0300 on, where combining marks begin: composition comes before lower-casing, and the capital may have no composed form.
    MARKED = r"[A-Z][\xcc-\xff]"
    ASCII = re.compile(rb"[a-z]+")
    LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.by_parts = given["model"].get("end_of_word_suffix") == END_OF_WORD and all(given.get(k) == v for k, v in SPLITTING.items()) and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in given.get("added_tokens", []))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END_OF_WORD)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.flat, self.start, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), 0

    def split(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The pieces of each part (binary), lower-cased unless a capital could compose with a mark; (part, b'') where the whole has to go through the tokenizer."""
        found = pc.extract_regex(parts, self.PIECES)
        word, rest = (found.field(k).fill_null(b"") for k in (0, 1))
        low = pa.Array.from_buffers(pa.binary(), len(word), [None, word.buffers()[1], pa.py_buffer(self.LOWER[np.frombuffer(word.buffers()[2] or b"", np.uint8)].tobytes())], offset=word.offset)
        word = pc.if_else(pc.match_substring_regex(parts, self.MARKED), word, low)
        whole = pc.or_(found.is_null(), pc.match_substring(parts, "<|"))  # where special tokens begin
        # a character beyond ASCII before punctuation may be punctuation too: only a letter is sure to end there
        doubtful = np.flatnonzero(pc.and_(pc.match_substring_regex(word, r"[\x80-\xff]$"), pc.not_equal(pc.binary_length(rest), 0)).to_numpy(zero_copy_only=False))
        if len(doubtful):
            joined = np.zeros(len(parts), bool)
            joined[doubtful] = [not w.decode("utf-8", "replace").lower()[-1].isalpha() for w in word.take(pa.array(doubtful)).to_pylist()]
            whole = pc.or_(whole, pa.array(joined))
        return pc.if_else(whole, parts, word), pc.if_else(whole, b"", rest)

    def learn(self, pieces: list[bytes]) -> None:
        found: dict[bytes, list[int]] = {}
        words, others = [], []
        for p in pieces:
            if self.ASCII.fullmatch(p):
                found[p] = [t.id for t in self.model.tokenize(p.decode())]
            else:
                text = p.decode("utf-8", "replace")
                (words if text.isalpha() else others).append((p, text))
        for k in range(0, len(words), 500):
            # words of letters: each is split at least once, at its end; so as many ends as words are theirs
            some = words[k : k + 500]
            ids = np.array(self.tokenizer.encode(" ".join([t for _, t in some]), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                found.update((p, own.tolist()) for (p, _), own in zip(some, np.split(ids, stops[:-1])))
            else:
                others += some
        for k in range(0, len(others), 2000):
            some = others[k : k + 2000]
            found.update((p, e.ids) for (p, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)))
        ids = [found[p] for p in pieces]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.used + n.sum() > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        first = len(self.known)
        while first + len(pieces) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[self.used : self.used + n.sum()] = np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(n.sum()))
        self.start[first + 1 : first + 1 + len(pieces)] = self.used + np.cumsum(n)
        self.used += int(n.sum())
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """The places of distinct pieces among the known ones, learnt if need be."""
        get = self.known.get
        at = np.fromiter([get(p, -1) for p in pieces], np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.known) + len(missing) > CACHE:
                self.clear()
                missing = np.array([i for i, p in enumerate(pieces) if p], np.int64)
                at[:] = 0
            at[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self.learn([pieces[i] for i in missing.tolist()])
        return at

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one after another, and how many each has."""
        if not len(texts) or not self.by_parts:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False) if len(texts) else []
            return np.array([i for e in found for i in e.ids], self.dtype), np.array([len(e.ids) for e in found], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        parts = lists.flatten().dictionary_encode()
        pieces = pa.concat_arrays(self.split(parts.dictionary.cast(pa.binary()))).dictionary_encode()
        word, rest = self.places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()].reshape(2, -1)
        both = np.stack((word, rest), axis=1).ravel()
        begin = self.start[both]
        n = (self.start[both + 1] - begin).astype(np.int32)
        own = self.flat[stretches(begin.astype(np.int32), n)]  # of each distinct part, one after another
        n = n.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        begin = (np.cumsum(n) - n).astype(np.int32)
        which = parts.indices.to_numpy()
        n = n[which]
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        edges = lists.offsets.to_numpy()
        return own[stretches(begin[which], n)], np.diff(ends[edges - edges[0]])

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all(pa.array([text.decode("utf-8", "surrogateescape")], pa.string()))[0]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's own encoder: its caches last from task to task."""
    return Encoder(path)


_RNG = np.random.Generator(np.random.PCG64(7))
_MIX = _RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(ids: np.ndarray, many: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of documents of ``many`` ids each (one document without), as places in ``ids``.

    They depend on the ids near them alone, but for the least and largest size; a hash that reached into the document
    before would end within the least size, so it never counts.
    """
    if not len(ids):
        return [0]
    h = _MIX[ids & 0xFFFF]
    base, width = 0x9E3779B97F4A7C15, 1
    while width < SPAN:  # h[i] covers the last 2 * width ids
        new = h.copy()
        new[width:] += h[:-width] * np.uint64(base)
        h, base, width = new, base * base % (1 << 64), 2 * width
    ends = np.flatnonzero((h >> np.uint64(40)) % np.uint64(ABOUT - LEAST) == 0) + 1
    stops = np.array([len(ids)]) if many is None else np.cumsum(many)
    both = np.union1d(ends, stops)
    out, last, document = [], 0, 0
    for e, stop in zip(both.tolist(), stops[np.searchsorted(stops, both)].tolist()):
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == stop and e > last:
            last = e
            out.append(last)
    return out


def hashed(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd last node moves up as it is; no leaves: the digest of nothing."""
    level = leaves or [hashed(b"")]
    while len(level) > 1:
        level = [hashed(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def recipe_root(recipe: bytes) -> bytes:
    """Root over the entries of a recipe: digests and numbers of ids."""
    return merkle([recipe[i : i + ENTRY.itemsize] for i in range(0, len(recipe), ENTRY.itemsize)])


def pieces_of(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sent = encoder_of(path), set()
        width = encoder.dtype.itemsize
        nth = TaskContext.get().partitionId() << 40
        schema = pa.schema([("kind", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("nth", pa.int64())])
        for batch in (part for b in batches for part in slices(b, 1, TEXT_BYTES)):
            ids, many = encoder.encode_all(batch.column(1).cast(pa.string()).fill_null(""))
            ids = np.insert(ids, np.cumsum(many), end_id)
            many += 1
            stops = cuts(ids, many)
            whole = ids.tobytes()
            rows: list[tuple] = []
            recipe, first, last = [], 0, 0
            document = zip(batch.column(0).to_pylist(), many.tolist(), np.cumsum(many).tolist())
            doc_id, n, end = next(document)
            for e in stops:
                payload = whole[last * width : e * width]
                digest = hashed(payload)
                recipe.append(digest + (e - last).to_bytes(4, "little"))
                last = e
                if digest not in sent:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(digest)
                    rows.append((0, digest, payload, None, None, None))
                if e == end:
                    nth += 1
                    rows.append((1, None, b"".join(recipe), doc_id, n, nth))
                    recipe = []
                    doc_id, n, end = next(document, (None, 0, -1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def place_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block of each document and the ids before it within its part, and its Merkle root; the rows come sorted."""
    at = nth = 0
    for batch in batches:
        n = np.array(batch.column("n_tokens").to_pylist(), np.int64)
        starts = at + np.cumsum(n) - n
        block = (nth + np.arange(len(n))) // BLOCK
        at, nth = at + int(n.sum()), nth + len(n)
        roots = [recipe_root(r) for r in batch.column("recipe").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(starts, pa.int64()), pa.array(roots, pa.binary())], names=[*batch.schema.names, "block", "at", "root"])


RECIPES = "doc_id bigint, part int, n_tokens bigint, recipe binary, block int, at bigint, root binary"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, block, at, n_tokens, leaf of each document; a recipe that isn't what its own root and length say fails the job.

    The leaf binds the document's id, place, number of ids and recipe.
    """
    for batch in batches:
        out = []
        for doc_id, at, n, recipe, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n_tokens", "recipe", "root"))):
            if len(recipe) % ENTRY.itemsize or recipe_root(recipe) != root or int(np.frombuffer(recipe, ENTRY)["n"].sum()) != n:
                raise ValueError(f"the recipe of document {doc_id} is damaged")
            out.append(hashed(struct.pack("<?qqq", doc_id is None, doc_id or 0, at, n) + root))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "block", "at", "n_tokens")), pa.array(out, pa.binary())], names=["part", "block", "at", "n_tokens", "leaf"])


def _roots(lists: pa.Array) -> pa.Array:
    return pa.array([merkle(x) for x in lists.to_pylist()], pa.binary())


def _tree(rows: DataFrame, keys: list[str], order: str, leaf: str, docs, tokens) -> DataFrame:
    """keys, docs, tokens, root over the leaves of each group in order."""
    held = rows.groupBy(*keys).agg(docs.alias("docs"), F.coalesce(tokens, F.lit(0)).alias("tokens"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(leaf).alias("x")))).alias("leaves"))
    return held.select(*keys, "docs", "tokens", F.arrow_udf(_roots, "binary")(F.transform("leaves", lambda x: x["x"])).alias("root"))


def block_roots(spark: SparkSession, path: str) -> DataFrame:
    """part, block, docs, tokens, root from the recipes as they are stored; a block has at most BLOCK leaves."""
    rows = read_recipes(spark, path).select("doc_id", "part", "block", "at", "n_tokens", "recipe", "root")
    return _tree(rows.mapInArrow(leaves, "part int, block int, at bigint, n_tokens bigint, leaf binary"), ["part", "block"], "at", "leaf", F.count(F.lit(1)), F.sum("n_tokens"))


def part_roots(blocks: DataFrame) -> DataFrame:
    return _tree(blocks, ["part"], "block", "root", F.sum("docs"), F.sum("tokens"))


def whole_root(parts: DataFrame) -> DataFrame:
    """One row: docs, tokens, root over the parts, which are as many as the partitions that wrote them."""
    return _tree(parts, [], "part", "root", F.coalesce(F.sum("docs"), F.lit(0)), F.sum("tokens"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text of ``docs`` and write the store; returns ``path``.

    A null text counts as empty and gives the end id alone.  Rows with a null id come first, rows that share an id follow
    each other; each row has a recipe of its own.  Other columns are ignored.  An empty table gives empty files.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or vocabulary_path()
    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces_of(tokenizer_path, end_id), PIECES)
    # equal chunks meet as whole rows, combined in each task first; recipes differ in nth and stay apart
    pieces.distinct().write.partitionBy("kind").parquet(f"{path}/pieces")
    recipes = (
        read_pieces(spark, path, 1)
        .select("doc_id", "n_tokens", F.col("payload").alias("recipe"), "nth")
        .repartitionByRange("doc_id", "nth")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "nth")
        .select("doc_id", F.spark_partition_id().alias("part"), "n_tokens", "recipe")
    )
    recipes.mapInArrow(place_recipes, RECIPES).write.parquet(f"{path}/recipes")
    block_roots(spark, path).write.parquet(f"{path}/manifest/blocks")
    # one row for each part: a few numbers for a range of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = part_roots(spark.read.parquet(f"{path}/manifest/blocks"))
    parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest/parts")
    width = F.lit(encoder_of(tokenizer_path).dtype.itemsize).alias("width")
    whole_root(spark.read.parquet(f"{path}/manifest/parts")).select(width, "docs", "tokens", "root").write.parquet(f"{path}/manifest/whole")
    return path


def verify(spark: SparkSession, path: str) -> int:
    """Check every recipe, block, part and the whole against the manifest; returns the width of an id in bytes.

    Raises ValueError where a recipe is missing, exchanged, cut or at another place, or where the manifest doesn't agree with itself.
    The roots come from the stored recipes; only those of the whole come to the driver.
    """
    whole = spark.read.parquet(f"{path}/manifest/whole").first()
    blocks, parts = (spark.read.parquet(f"{path}/manifest/{level}") for level in ("blocks", "parts"))

    def same(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
        told = lambda df, name: df.select(*keys, F.struct("docs", "tokens", "root").alias(name))
        return told(found, "found").join(told(stored, "stored"), keys, "full").where(~F.col("found").eqNullSafe(F.col("stored"))).select("part")

    wrong = same(block_roots(spark, path), blocks, ["part", "block"]).union(same(part_roots(blocks), parts, ["part"])).agg(F.min("part")).first()[0]
    if wrong is not None:
        raise ValueError(f"the recipes of part {wrong} don't match the manifest")
    base = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("base", F.coalesce(F.sum("tokens").over(base), F.lit(0)).alias("due")).where("base <> due")
    found = whole_root(parts).first()
    if moved.count() or (found.docs, found.tokens, found.root) != (whole.docs, whole.tokens, whole.root):
        raise ValueError("the manifest doesn't match the root of the whole")
    return whole.width


def read_pieces(spark: SparkSession, path: str, kind: int) -> DataFrame:
    schema = "digest binary, payload binary, doc_id bigint, n_tokens bigint, nth bigint, kind int"
    return spark.read.schema(schema).parquet(f"{path}/pieces").where(F.col("kind") == kind)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document: part, at, doc_id, digest, n, after (ids of the document behind the chunk), pos."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                some = batch.slice(k, 500)
                recipes = [np.frombuffer(r, ENTRY) for r in some.column("recipe").to_pylist()]
                many = np.array([len(r) for r in recipes])
                row = pa.array(np.repeat(np.arange(len(some)), many))
                whole = np.concatenate(recipes)
                n = whole["n"].astype(np.int64)
                after = np.concatenate([np.cumsum(r["n"][::-1].astype(np.int64))[::-1] - r["n"] for r in recipes])
                pos = np.concatenate([np.arange(m) for m in many])
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole["digest"]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(row) for c in ("part", "at", "doc_id")), digest, pa.array(n), pa.array(after), pa.array(pos, pa.int64())], names=["part", "at", "doc_id", "digest", "n", "after", "pos"])

    recipes = read_recipes(spark, path).select("part", "at", "doc_id", "recipe")
    return recipes.mapInArrow(unpack, "part int, at bigint, doc_id bigint, digest binary, n bigint, after bigint, pos bigint")


def read_chunks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """digest, n, crc of each stored chunk, computed from its payload; a payload that doesn't match its digest fails the job."""
    kind = np.dtype(f"<u{width}")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.blake2b(payload, digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(payload, kind)
                out.append((digest, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "stored", "crc"])

    return read_pieces(spark, path, 0).select("digest", "payload").mapInArrow(check, "digest binary, stored bigint, crc bigint")


@functools.cache
def _zero_tables() -> list[np.ndarray]:
    """For each power of two, four tables by byte: the crc register after that many zero bytes."""
    byte = np.zeros(32, np.uint64)
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        byte[i] = c
    out, m = [], byte
    for _ in range(48):
        table = np.zeros((4, 256), np.uint64)
        for k in range(4):
            for b in range(8):
                table[k] ^= np.where(np.arange(256) >> b & 1, m[8 * k + b], 0).astype(np.uint64)
        out.append(table)
        m = _through(table, m)
    return out


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint64(255)
    return table[0][x & byte] ^ table[1][x >> np.uint64(8) & byte] ^ table[2][x >> np.uint64(16) & byte] ^ table[3][x >> np.uint64(24) & byte]


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the crc of a longer string in which ``zeros`` bytes follow: those parts combine by xor."""
    crc = crc.astype(np.uint64)
    for k, table in enumerate(_zero_tables()):
        on = np.flatnonzero(zeros >> k & 1)
        if len(on):
            crc[on] = _through(table, crc[on])
        elif not (zeros >> k).any():
            break
    return crc.astype(np.int64)


def token_report(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the store, then from its files: doc_id, start, n_tokens, ids_crc32 for each row of ``docs``; nulls, repeats and empty tables as in ``write_store``."""
    spark = docs.sparkSession
    path = write_store(docs, new_path(spark, "token-store"), tokenizer_path)
    return read_report(spark, path)


def _bases(spark: SparkSession, path: str) -> DataFrame:
    return F.broadcast(spark.read.parquet(f"{path}/manifest/parts").select("part", "base"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the files of a store, which is verified first.

    A chunk that is missing, damaged or of another length fails the job.
    """
    width = verify(spark, path)

    @F.arrow_udf("bigint")
    def shifted(crc: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array(shift_crc(crc.to_numpy(zero_copy_only=False), 4 * after.to_numpy(zero_copy_only=False)))

    there = F.when(F.col("n").eqNullSafe(F.col("stored")), F.col("stored")).otherwise(F.raise_error(F.concat(F.lit("chunk missing: "), F.hex("digest"))).cast("bigint"))
    docs = (
        entries(spark, path)
        .join(read_chunks(spark, path, width), "digest", "left")
        .select("part", "at", "doc_id", there.alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), "after")
        .select("part", "at", "doc_id", "n", shifted("crc", "after").alias("crc"))
        .groupBy("part", "at", "doc_id")
        .agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    )
    return docs.join(_bases(spark, path), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of each document, put together again from recipe and chunks; the store is verified first, and each chunk by its digest."""
    kind = np.dtype(f"<u{verify(spark, path)}")

    @F.arrow_udf("array<bigint>")
    def ids(digests: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for own, p in zip(digests.to_pylist(), parts.to_pylist()):
            for digest, payload in zip(own, p):
                if payload is None or hashed(payload) != digest:
                    raise ValueError(f"chunk {digest.hex()} is {'missing' if payload is None else 'damaged'}")
            out.append(np.frombuffer(b"".join(p), kind).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    chunks = read_pieces(spark, path, 0).select("digest", "payload")
    docs = (
        entries(spark, path)
        .join(chunks, "digest", "left")
        .groupBy("part", "at", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("x"))
        .select("part", "at", "doc_id", ids(F.transform("x", lambda x: x["digest"]), F.transform("x", lambda x: x["payload"])).alias("ids"))
    )
    return docs.join(_bases(spark, path), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "ids")
