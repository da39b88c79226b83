"""A stored full-text index: blocks of postings by term, Block-Max WAND over them, trigrams of names.

Files are dealt out in the order of their ids and cut into shards, so the order of shards and of places in them is the order of
ids.  What is stored is Parquet: postings in folders by a hash of the term, sorted by term, and the ids of each shard.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.blockmax import Floors, Postings, best, pack
from ..functions.stemming import SPANISH, spanish
from ..functions.text import contains_ignoring_case, glob, query_terms, spaced, token_count

K1, B = 1.5, 0.75
#: Digits that scores have; what is equal then is ordered by id.
DIGITS = 6
#: Bytes of text in a shard, in a part of the terms, and in a file of a part, about.
SHARD_BYTES, PART_BYTES, FILE_BYTES = 16 << 20, 1 << 30, 32 << 20
#: Postings in a shard, and bytes of text whose words are counted at once while a shard is built, about.
SHARD_POSTINGS, STEP_BYTES = 1 << 20, 2 << 20
#: Bytes of text that a task of building sorts, about, and postings that a search gives to a single task.
TASK_BYTES, ONE_TASK = 128 << 20, 1 << 20
#: Files of an index whose searches are one task: their ids and the postings of a query's terms are small then.
FEW_FILES = 100_000
#: Folders of postings at most; beyond that parts have more files.
MOST_PARTS = 4096
KIND, GRAMS, END = "~kind", "~grams", "\0"
GRAM = 3
POSTINGS = "shard bigint, field string, term string, n bigint, last array<int>, most array<double>, width binary, payload binary"
TERMS = "field string, term string, df bigint, part int"
HITS = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("score", pa.float64())])
_ROWS = pa.schema(
    [("shard", pa.int64()), ("field", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("last", pa.list_(pa.int32())), ("most", pa.list_(pa.float64())), ("width", pa.binary()), ("payload", pa.binary())]
)


def grams(name: str) -> set[str]:
    """Runs of three characters of a lower-cased name, with two end marks behind it: every character begins one."""
    padded = name.lower() + END * (GRAM - 1)
    return {padded[i : i + GRAM] for i in range(len(name.lower()))}


def required_grams(parts: list[str], at_end: bool = False) -> tuple[set[str], set[str]]:
    """Trigrams, and beginnings of trigrams, that a name with all of ``parts`` (one after the other) must have."""
    whole, begun = set(), set()
    for k, part in enumerate(parts):
        part = part.lower() + (END * (GRAM - 1) if at_end and k == len(parts) - 1 else "")
        whole |= {part[i : i + GRAM] for i in range(len(part) - GRAM + 1)}
        if 0 < len(part) < GRAM:
            begun.add(part)
    return whole, begun


def glob_parts(pattern: str) -> tuple[list[str], bool]:
    """The literal runs of a glob (*, ?, [seq]), and whether the last one ends it."""
    parts, run, i, last = [], "", 0, False
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else i
        if c in "*?" or (c == "[" and end > 0):
            parts.append(run)
            run, i, last = "", end + 1, False
        else:
            run, i, last = run + c, i + 1, True
    parts.append(run)
    return [p for p in parts if p], last


def saturated(tf, dl, avgdl: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _part(field_: Column, term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(field_, term), F.lit(parts)).cast("int")


class _Counts:
    """The words of a shard's field, file by file, as numbers: a word of a file is eight bytes, whatever its text."""

    def __init__(self, counters: Iterable[Counter] = ()):
        self.vocabulary: dict[str, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.numbers: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        #: Distinct words of each file.
        self.sizes: list[np.ndarray] = []
        self.postings = 0
        for c in counters:
            self.add(c)

    def _add(self, numbers: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers.append(numbers)
        self.times.append(times)
        self.sizes.append(sizes)
        self.postings += len(numbers)

    def add(self, counter: Counter) -> None:
        self._add(np.fromiter(map(self.vocabulary.__getitem__, counter), np.int32, len(counter)), np.fromiter(counter.values(), np.int32, len(counter)), np.array([len(counter)], np.int32))

    def add_sets(self, sets: list[Collection[str]]) -> None:
        """A file for each set, whose words it has once."""
        sizes = np.fromiter(map(len, sets), np.int32, len(sets))
        numbers = np.fromiter(map(self.vocabulary.__getitem__, chain.from_iterable(sets)), np.int32, int(sizes.sum()))
        self._add(numbers, np.ones(len(numbers), np.int32), sizes)

    def add_texts(self, texts: pa.Array, stems: np.ndarray) -> None:
        """A file for each text, words with a space between them; words of those that ``stems`` marks go in by their stems."""
        words = pa.compute.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        spelled, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        file = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
        if "" in spelled:  # of texts without words
            some = code != spelled.index("")
            code, file = code[some], file[some]
        number = np.zeros(len(code), np.int64)
        stemmed = stems[file]
        for own, spell in ((~stemmed, str), (stemmed, spanish)):
            used = np.zeros(len(spelled), bool)
            used[code[own]] = True
            of_code = np.zeros(len(spelled), np.int64)
            of_code[used] = [self.vocabulary[spell(spelled[i])] for i in np.flatnonzero(used).tolist()]
            number[own] = of_code[code[own]]
        key = np.sort(file << 32 | number)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        self._add((key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), np.bincount(key >> 32, minlength=len(texts)).astype(np.int32))


def _field_rows(shard: int, name: str, counts: _Counts, avgdl: float, lengths: np.ndarray | None = None) -> pa.RecordBatch:
    vocabulary, n = counts.vocabulary, counts.postings
    sizes, tf = np.concatenate(counts.sizes), np.concatenate(counts.times)
    names = pa.array(list(vocabulary), pa.string())
    sorted_ = pa.compute.array_sort_indices(names)
    names = names.take(sorted_)
    rank = np.empty(len(names), np.int64)
    rank[sorted_.to_numpy()] = np.arange(len(names))
    key = rank[np.concatenate(counts.numbers)] << 32  # a term's postings in the order of files, by one sort of numbers
    key |= np.arange(n)
    key.sort()
    term, order = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    del key
    place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    lengths = np.bincount(place, tf, len(sizes)).astype(np.int32) if lengths is None else lengths
    place, tf = place[order], tf[order]
    del order
    dl = lengths[place]
    packed = pack(term, place, [tf, dl], saturated(tf, dl, avgdl))
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int64()), pa.array([name] * len(names), pa.string()), names, *packed.values()], schema=_ROWS)


class _Shard:
    """What a task holds of the shard that it builds: ids and names as columns, words, kinds and trigrams as numbers."""

    def __init__(self, fields: list[str]):
        self.ids: list[pa.Array] = []
        self.names: list[pa.Array] = []
        self.texts = [_Counts() for _ in fields]
        self.kinds, self.grams = _Counts(), _Counts()
        self.size = self.files = 0

    @property
    def postings(self) -> int:
        """Of words, kinds and trigrams; a file counts as one too."""
        return self.files + sum(c.postings for c in (*self.texts, self.kinds, self.grams))

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        """Rows (file_id, kind, stems, name, texts) of so many bytes."""
        ids, kinds, stems, names, *texts = rows.columns
        self.size += size
        self.files += len(rows)
        own = pa.array(np.arange(len(rows)))  # copies, as a slice would keep all of its batch
        self.ids.append(ids.take(own))
        self.names.append(names.cast(pa.string()).take(own))
        self.kinds.add_sets([() if k is None else (k,) for k in kinds.to_pylist()])
        self.grams.add_sets([grams(n or "") for n in names.to_pylist()])
        for own, text in zip(self.texts, texts):
            own.add_texts(text, stems.to_numpy(zero_copy_only=False))


@dataclass
class TextIndex:
    """An index under ``path``."""

    spark: SparkSession
    path: str
    files: int
    avgdl: dict[str, float]
    parts: int
    postings: DataFrame = field(repr=False)
    terms: DataFrame = field(repr=False)
    ids: DataFrame = field(repr=False)
    _counted: list = field(default_factory=list, repr=False)

    @classmethod
    def build(cls, docs: DataFrame, path: str, fields: list[str], id_col: str = "file_id", kind: str | None = None, language: str | None = None, name: str | None = None, stop: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> TextIndex:
        """Write the index of ``docs``, one row a file, and open it.

        ``fields`` are columns of text, ``kind`` one that searches may ask for, ``name`` one whose trigrams are indexed too.  Words
        of rows whose ``language`` is Spanish are stemmed, ``stop`` words left out.  Null texts are empty, a file without words
        counts among the files.  Repeated ids are files of their own.  One sort of the rows by id, one shuffle of the postings.
        """
        spark = docs.sparkSession
        text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
        rows = docs.select(F.col(id_col).alias("file_id"), text(kind).alias("kind"), F.coalesce(F.lower(text(language)).isin(*SPANISH), F.lit(False)).alias("stems"), text(name).alias("name"), *[F.col(f).alias(f"text{k}") for k, f in enumerate(fields)])
        measured = docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f), F.lit(0)) for f in fields])), F.lit(0)).alias("bytes"), *[F.coalesce(F.avg(token_count(F.col(f), stop)), F.lit(0.0)).alias(f"avgdl{k}") for k, f in enumerate(fields)]).first()
        avgdl = [measured[f"avgdl{k}"] for k in range(len(fields))]
        parts = min(MOST_PARTS, max(1, -(-measured.bytes // PART_BYTES)))
        salts = max(1, -(-measured.bytes // (parts * FILE_BYTES)))
        schema = StructType([*StructType.fromDDL(POSTINGS), StructField("ids", ArrayType(rows.schema["file_id"].dataType)), StructField("names", ArrayType(StringType()))])

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, shard = TaskContext.get().partitionId() << 33, _Shard(fields)
            for batch in batches:
                sizes = reduce(np.add, [pa.compute.fill_null(pa.compute.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[3:]])
                ends, at = np.cumsum(sizes), 0
                while at < len(batch):
                    done, room = ends[at] - sizes[at], shard_bytes - shard.size
                    to = int(np.searchsorted(ends, done + min(STEP_BYTES, room), "right"))
                    if shard.files and (sizes[at] > room or shard.postings >= SHARD_POSTINGS):
                        yield from flushed(number, shard)
                        number, shard = number + 1, _Shard(fields)
                        continue
                    to = max(to, at + 1)
                    shard.add(batch.slice(at, to - at), int(ends[to - 1] - done))
                    at = to
            if shard.files:
                yield from flushed(number, shard)

        def flushed(shard: int, held: _Shard) -> Iterator[pa.RecordBatch]:
            rows = (_field_rows(shard, f, c, mean) for f, c, mean in zip(fields, held.texts, avgdl) if c.vocabulary)
            ones = np.ones(held.files, np.int64)
            more = (_field_rows(shard, f, c, 1.0, ones) for f, c in ((KIND, held.kinds), (GRAMS, held.grams)) if c.vocabulary)
            ids, own = pa.concat_arrays(held.ids), pa.concat_arrays(held.names)
            for r in chain(rows, more):
                yield pa.RecordBatch.from_arrays([*r.columns, pa.nulls(len(r), pa.list_(ids.type)), pa.nulls(len(r), pa.list_(pa.string()))], names)
            about = [pa.array([shard], pa.int64()), *[pa.nulls(1, f.type) for f in list(_ROWS)[1:]]]
            offsets = pa.array([0, held.files], pa.int32())
            yield pa.RecordBatch.from_arrays([*about, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, own)], names)

        names = [*_ROWS.names, "ids", "names"]
        tasks = max(spark.sparkContext.defaultParallelism, -(-measured.bytes // TASK_BYTES))
        ordered = rows.repartitionByRange(tasks, "file_id").sortWithinPartitions("file_id")
        out = ordered.withColumns({f"text{k}": spaced(F.col(f"text{k}"), stop) for k in range(len(fields))}).mapInArrow(index, schema)
        out = out.withColumn("part", F.when(F.col("term").isNull(), -1).otherwise(_part(F.col("field"), F.col("term"), parts)))
        salted = F.pmod(F.xxhash64("shard"), F.lit(salts))
        out.repartition("part", salted).sortWithinPartitions("part", "field", "term", "shard").write.option("parquet.block.size", 8 << 20).partitionBy("part").parquet(f"{path}/postings")
        stored = StructType([*schema, StructField("part", IntegerType())])
        about = spark.createDataFrame([(measured.files, parts, dict(zip(fields, avgdl)), stored.json())], "files bigint, parts int, avgdl map<string,double>, stored string")
        about.coalesce(1).write.parquet(f"{path}/about")
        spark.read.schema(stored).parquet(f"{path}/postings").where("part >= 0").groupBy("part", "field", "term").agg(F.sum("n").alias("df")).repartition("part").sortWithinPartitions("part", "field", "term").write.partitionBy("part").parquet(f"{path}/terms")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        about = spark.read.parquet(f"{path}/about").first()
        found = spark.read.schema(StructType.fromJson(json.loads(about.stored))).parquet(f"{path}/postings")
        postings = found.where("part >= 0").drop("ids", "names")
        ids = found.where("part = -1").select("shard", "ids", "names")
        return cls(spark, path, about.files, dict(about.avgdl), about.parts, postings, spark.read.schema(TERMS).parquet(f"{path}/terms"), ids)

    def _of(self, table: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
        """The rows of these (field, term)s: constants once they are folded, so they prune folders and row groups."""
        if not keys:
            return table.limit(0)
        by_field: dict[str, list[str]] = {}
        for f, t in keys:
            by_field.setdefault(f, []).append(t)
        rows = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin(t) for f, t in by_field.items()])
        return table.where(F.col("part").isin(*[_part(F.lit(f), F.lit(t), self.parts) for f, t in keys]) & rows)

    @staticmethod
    def words(query: str, language: str | None = None) -> list[str]:
        """The words of a query as the index has them."""
        words = query_terms(query)
        return list(dict.fromkeys(map(spanish, words))) if language is not None and language.lower() in SPANISH else words

    @property
    def blocks(self) -> tuple[int, int]:
        """How many blocks the last search decompressed once its rows were read, of how many its terms have."""
        return tuple(c.value for c in self._counted) or (0, 0)

    def frequencies(self, query: str, fields: list[str], language: str | None = None) -> dict[tuple[str, str], int]:
        """Files that have the query's terms in each field; a term that none has is left out."""
        found = self._of(self.terms, [(f, t) for f in fields for t in self.words(query, language)]).select("field", "term", "df").collect()  # a row a term
        return {(r.field, r.term): r.df for r in found}

    def _by_shard(self, rows: DataFrame, postings: int) -> DataFrame:
        """Rows of a shard one after the other; few postings stay in one task and aren't shuffled."""
        rows = rows.drop("part")
        return (rows.coalesce(1) if postings <= ONE_TASK else rows.repartition("shard")).sortWithinPartitions("shard")

    def top(self, query: str, limit: int = 50, fields: dict[str, float] | None = None, kind: str | None = None, language: str | None = None) -> list[tuple[int, int, float]]:
        """(shard, place, score) of the best ``limit`` hits, a short list: scores of six digits, equal ones in the order of ids."""
        fields = {"name": 10.0, "content": 1.0} if fields is None else fields
        df = self.frequencies(query, [f for f in fields if f in self.avgdl], language)
        self._counted = []
        if not df or limit <= 0:
            return []
        weights = {key: fields[key[0]] * float(np.log(1.0 + (self.files - n + 0.5) / (n + 0.5))) for key, n in df.items()}
        wanted = [*weights, *([(KIND, kind)] if kind is not None else [])]
        counted = [self.spark.sparkContext.accumulator(0) for _ in range(2)]
        avgdl, self._counted = self.avgdl, counted

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors, out = Floors(limit), []
            for shard, lists in shards(batches, avgdl):
                among = None
                documents = 1 + max(int(p.last[-1]) for p in lists.values())
                if kind is not None:
                    among = np.zeros(documents, bool)
                    if (KIND, kind) in lists:
                        among[lists[KIND, kind].places()] = True
                scored = [(p, weights[key]) for key, p in lists.items() if key in weights]
                places, scores = best(scored, documents, limit, floors.of(0), among, DIGITS)
                counted[0].add(sum(len(p.read) for p, _ in scored))
                counted[1].add(sum(len(p.last) for p, _ in scored))
                floors.add(0, scores)
                out += [(shard, p, s) for p, s in zip(places.tolist(), scores.tolist())]
            keep = [x for x in out if x[2] >= floors.of(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.int32()), pa.array([x[2] for x in keep], pa.float64())], ["shard", "place", "score"])

        rows = self._by_shard(self._of(self.postings, wanted), sum(df.values()) + (self.files if kind is not None else 0))
        hits = rows.mapInArrow(search, "shard bigint, place int, score double").orderBy(F.desc("score"), "shard", "place").limit(limit).collect()
        return [tuple(h) for h in hits]

    def search(self, query: str, limit: int = 50, fields: dict[str, float] | None = None, kind: str | None = None, language: str | None = None) -> DataFrame:
        """file_id, score, best first, equal scores by id; a query without words, or words that no file has, has no hits.

        ``fields`` has the weight of each field, ``kind`` leaves only files of that kind (statistics stay those of all files),
        ``language`` says how the query's words are taken.
        """
        if self.files <= FEW_FILES:
            return self._few(query, limit, fields, kind, language)
        return self.with_ids(self.top(query, limit, fields, kind, language))

    def hits(self, query: str, limit: int = 50, fields: dict[str, float] | None = None, kind: str | None = None, language: str | None = None) -> DataFrame | None:
        """The rows of ``search``, which are known already; None if there are none."""
        if self.files > FEW_FILES:
            found = self.top(query, limit, fields, kind, language)
            return self.with_ids(found) if found else None
        found = self._few(query, limit, fields, kind, language)
        rows = found.toArrow()
        return self.spark.createDataFrame(rows).orderBy(F.desc("score"), "file_id") if len(rows) else None

    def _few(self, query: str, limit: int, fields: dict[str, float] | None, kind: str | None, language: str | None) -> DataFrame:
        """A search of an index of few files as one task: the terms' frequencies, the scores and the ids come from the same rows."""
        fields = {"name": 10.0, "content": 1.0} if fields is None else fields
        keys = [(f, t) for f in fields if f in self.avgdl for t in self.words(query, language)]
        out = StructType([StructField("file_id", self.ids.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
        if not keys or limit <= 0:
            return self.spark.createDataFrame([], out)
        kinds, avgdl, files = to_arrow_schema(out), self.avgdl, self.files
        counted = [self.spark.sparkContext.accumulator(0) for _ in range(2)]
        self._counted = counted

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: dict[int, pa.Array] = {}
            rows = []
            for batch in batches:
                for i in np.flatnonzero(pa.compute.is_valid(batch.column("ids")).to_numpy(zero_copy_only=False)).tolist():
                    ids[batch.column("shard")[i].as_py()] = batch.column("ids")[i].values
                rows.append(batch.filter(pa.compute.is_valid(batch.column("term"))).drop_columns(["ids"]))
            held = [(s, dict(lists)) for s, lists in shards(iter(rows), avgdl)]
            df: Counter = Counter()
            for _, lists in held:
                df.update({key: p.n for key, p in lists.items() if key[0] != KIND})
            weights = {key: fields[key[0]] * float(np.log(1.0 + (files - n + 0.5) / (n + 0.5))) for key, n in df.items()}
            floors = Floors(limit)
            for shard, lists in held:
                among = None
                if kind is not None:
                    among = np.zeros(len(ids[shard]), bool)
                    if (KIND, kind) in lists:
                        among[lists[KIND, kind].places()] = True
                scored = [(p, weights[key]) for key, p in lists.items() if key in weights]
                places, scores = best(scored, len(ids[shard]), limit, floors.of(0), among, DIGITS)
                counted[0].add(sum(len(p.read) for p, _ in scored))
                counted[1].add(sum(len(p.last) for p, _ in scored))
                floors.add(0, scores)
                yield pa.RecordBatch.from_arrays([ids[shard].take(pa.array(places)).cast(kinds.field("file_id").type), pa.array(scores, pa.float64())], schema=kinds)

        wanted = [*keys, *([(KIND, kind)] if kind is not None else [])]
        rows = self._of(self.postings, wanted).drop("part").withColumn("ids", F.lit(None).cast(self.ids.schema["ids"].dataType))
        own = self.ids.select("shard", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("shard", "ids")], "ids")
        return rows.unionByName(own).coalesce(1).sortWithinPartitions("shard").mapInArrow(search, out).orderBy(F.desc("score"), "file_id").limit(limit)

    def with_ids(self, hits: list[tuple[int, int, float]]) -> DataFrame:
        own = self.ids.where(F.col("shard").isin(sorted({h[0] for h in hits})))
        listed = self.spark.createDataFrame(pa.table([[h[0] for h in hits], [h[1] for h in hits], [h[2] for h in hits]], schema=HITS))
        return own.join(F.broadcast(listed), "shard").select(F.get("ids", "place").alias("file_id"), "score").orderBy(F.desc("score"), "file_id")

    def name_candidates(self, parts: list[str], at_end: bool = False, kind: str | None = None) -> DataFrame | None:
        """shard, places: files whose names have every trigram that ``parts`` need, and that are of ``kind``; None if all files are."""
        whole, begun = required_grams(parts, at_end)
        keys = [*[(GRAMS, g) for g in sorted(whole)], *([(KIND, kind)] if kind is not None else [])]
        if whole:
            begun = set()  # a short run alone has no whole trigram: those that begin with it then
        if not keys and not begun:
            return None
        rows = self._of(self.postings, keys)
        for b in sorted(begun):
            rows = rows.union(self.postings.where((F.col("field") == GRAMS) & F.col("term").startswith(b)))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, lists in shards(batches, {}):
                held = None
                wanted = [[lists[k]] if k in lists else [] for k in keys]
                wanted += [[p for (f, t), p in lists.items() if f == GRAMS and t.startswith(b)] for b in begun]
                for own in sorted(wanted, key=lambda ps: sum(p.n for p in ps)):
                    places = np.unique(np.concatenate([np.zeros(0, np.int64), *[p.places() for p in own]]))
                    held = places if held is None else np.intersect1d(held, places, assume_unique=True)
                    if not len(held):
                        break
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([held.astype(np.int32).tolist()], pa.list_(pa.int32()))], ["shard", "places"])

        return rows.drop("part").repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "shard bigint, places array<int>")

    def verified(self, candidates: DataFrame | None) -> DataFrame:
        """file_id, name of the candidates, or of all files."""
        if candidates is None:
            both = self.ids.select(F.explode(F.arrays_zip("ids", "names")).alias("x"))
            return both.select(F.col("x.ids").alias("file_id"), F.col("x.names").alias("name"))
        one = self.ids.join(candidates, "shard").select("ids", "names", F.explode("places").alias("place"))
        return one.select(F.get("ids", "place").alias("file_id"), F.get("names", "place").alias("name"))

    def names_containing(self, query: str, limit: int = 50, kind: str | None = None) -> DataFrame:
        """file_id, name of files whose name contains the query in any case, by id; an empty query has no match."""
        query = query.strip()
        found = self.verified(self.name_candidates([query], kind=kind)) if query else self.verified(None).limit(0)
        return found.where(contains_ignoring_case(F.col("name"), query)).orderBy("file_id").limit(limit)

    def names_like(self, pattern: str) -> DataFrame:
        """file_id, name of files whose name is as the glob says (any case); a pattern without a literal looks at every name."""
        parts, at_end = glob_parts(pattern)
        found = self.verified(self.name_candidates(parts, at_end))
        return found.where(F.lower("name").rlike(glob(pattern.lower())))


def shards(batches: Iterator[pa.RecordBatch], avgdl: dict[str, float]) -> Iterator[tuple[int, dict[tuple[str, str], Postings]]]:
    """(shard, postings by field and term), from rows that are sorted by shard."""
    shard, lists = None, {}
    for batch in batches:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ends = np.concatenate(([0], np.cumsum(col["last"].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        last, most = col["last"].flatten().to_numpy(), col["most"].flatten().to_numpy()
        heads = zip(col["shard"].to_pylist(), col["field"].to_pylist(), col["term"].to_pylist(), col["n"].to_pylist())
        for i, (number, name, term, n) in enumerate(heads):
            if number != shard:
                if shard is not None:
                    yield shard, lists
                shard, lists = number, {}
            own = slice(int(ends[i]), int(ends[i + 1]))
            mean = avgdl.get(name, 1.0)
            lists[name, term] = Postings(n, last[own], most[own], col["width"][i].as_py(), col["payload"][i].as_py(), lambda place, tf, dl, mean=mean: saturated(tf, dl, mean), 2)
    if shard is not None:
        yield shard, lists
