"""Operators 1, 4 and 7 against brute force on small tables."""

import hashlib
import re
import zlib

import pytest

from pyspark.sql import functions as F

from quarrydex.llm import decontaminate, exact_dedup, token_store

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, ""), (10, "two three four five six seven eight nine ten eleven"), (None, "éa éb éc")]
TEXTS = [
    (0, "x ONE two, three four five six seven eight nine ten! eleven twelve y"),
    (1, None),
    (2, ""),
    (3, "a Short-item b short item short"),
    (4, "one two three four five six seven eight nine nine ten eleven twelve"),
    (5, "éa éb éc " * 3),
    (5, "éa éb éc " * 3),
    (None, "two three four five six seven eight nine ten eleven twelve"),
    (7, "short item " * 5000),
    (8, " \n\t "),
    (9, "same text"),
    (10, "same  text\n"),
    (11, "sam etext"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(rows, bench, window=10):
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for name, text in bench:
            b = words(text)
            k = min(window, len(b))
            for s in range(len(b) - k + 1 if b else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit |= set(range(p, p + k))
                        items.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_leaks(spark, block_bytes):
    items = spark.createDataFrame(BENCH, "item_id bigint, text string")
    df = docs(spark).repartition(3)
    found = decontaminate.find_leaks(df, items, block_bytes=block_bytes)
    got = [(r.doc_id, r.leak.n_words, len(r.leak.hits), len(r.leak["items"]), hashlib.sha256(",".join(r.leak["items"]).encode()).hexdigest(), bool(r.leak.hits)) for r in found.collect()]
    assert sorted(got, key=str) == leaks(TEXTS, BENCH)
    assert [r.leak.longest for r in found.where("doc_id = 0").collect()] == [12]
    kept = decontaminate.decontaminate(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 8, 9, 10, 11]


def test_equal_items_are_searched_once(spark):
    """A word two hundred thousand times, two hundred items that are that word, and items that end alike."""
    bench = [(i, "the") for i in range(200)] + [(300 + i, f"w{i} the the the the the the the the the the") for i in range(3)] + [(400, "THE the")]
    block = decontaminate.Block.of([(str(i), t.encode()) for i, t in bench], 10)
    assert len(block.start) == 1 + 3 + 1 + 1  # the; each first word's window and the one they share; the the
    rows = [(1, "the " * 200_000), (2, "a the b"), (3, "w1 " + "the " * 10), (4, "the the")]
    found = {r.doc_id: r.leak for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    plain = {i: set() for i, _ in rows}
    for i, t in rows[1:]:
        w = words(t)
        for name, text in bench:
            b = words(text)
            k = min(10, len(b))
            if any(w[p : p + k] == b[s : s + k] for s in range(len(b) - k + 1) for p in range(len(w) - k + 1)):
                plain[i].add(str(name))
    assert {i: set(found[i]["items"]) for i in (2, 3, 4)} == {i: plain[i] for i in (2, 3, 4)}
    assert len(found[1].hits) == 200_000 and len(found[1]["items"]) == 204 and found[1].longest == 10


def test_leaks_of_empty_tables(spark):
    items = spark.createDataFrame(BENCH, "item_id bigint, text string")
    assert decontaminate.leak_report(docs(spark, []), items).count() == 0
    assert [r.n_hit for r in decontaminate.leak_report(docs(spark), items.limit(0)).collect()] == [0] * len(TEXTS)


@pytest.mark.parametrize("salts", [1, 4])
def test_exact_dedup(spark, salts):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for norm, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for n, r in enumerate(rows):
            want.append((r[2], rows[0][2], len(rows), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs(spark), salts=salts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_keeps_python_out(spark):
    plan = exact_dedup.exact_dedup(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_token_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.vocabulary_path())
    rows = [*TEXTS, (20, "It's <|endoftext|> we'LL see Ünḯ don't 12ab ½"), (21, "the cat sat " * 3000), (22, "the cat sat " * 2999 + "zebra")]
    df = docs(spark, rows).repartition(3)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        want.append((i, start, len(ids), crc, ids))
        start += len(ids)
    assert sorted(map(tuple, token_store.token_report(df).collect()), key=str) == sorted((w[:4] for w in want), key=str)
    path = token_store.write_store(df, str(tmp_path / "store"))
    got = token_store.reconstruct(spark, path).orderBy("start").collect()
    assert [list(r.ids) for r in got] == [w[4] for w in want]
    chunks = token_store.read_pieces(spark, path, 0)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"payload": "count"}).first()[0] < sum(len(w[4]) for w in want) / 64 / 2
    assert token_store.token_report(docs(spark, [])).count() == 0


def altered(path, folder, change):
    """Write a table of a store again with ``change`` made to it."""
    import os
    import shutil

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = change(spark.read.parquet(f"{path}/{folder}"))
    (df.write.partitionBy("kind") if folder == "pieces" else df.write).parquet(f"{path}/altered")
    shutil.rmtree(f"{path}/{folder}")
    os.rename(f"{path}/altered", f"{path}/{folder}")


def _recipes(change):
    def run(df):
        rows = [r.asDict() for r in df.orderBy("part", "at").collect()]
        change(rows)
        return df.sparkSession.createDataFrame(rows, token_store.RECIPES)

    return run


def _swap(rows):
    names = ("recipe", "root", "n_tokens")
    a, b = rows[1], rows[-1]
    assert a["recipe"] != b["recipe"]
    for k in names:
        a[k], b[k] = b[k], a[k]


def _swap_equally_long(rows):
    by = {}
    for r in rows:
        other = by.setdefault(r["n_tokens"], r)
        if other["recipe"] != r["recipe"]:
            for k in ("recipe", "root"):
                other[k], r[k] = r[k], other[k]
            return
    raise AssertionError("no two recipes of one length")


def _truncate(rows):
    row = max(rows, key=lambda r: len(r["recipe"]))
    row["recipe"] = row["recipe"][: -token_store.ENTRY.itemsize]
    row["root"] = token_store.recipe_root(row["recipe"])


def _move(rows):
    rows[2]["at"] += 1


def _drop(rows):
    rows.pop(3)


DAMAGE = {
    "chunk changed": ("pieces", lambda df: df.withColumn("payload", F.when(F.col("kind") == 0, F.concat(F.lit(b"\x01\x00"), F.substring("payload", 3, 1 << 20))).otherwise(F.col("payload")))),
    "chunk missing": ("pieces", lambda df: df.where(~((F.col("kind") == 0) & (F.col("digest") == df.where("kind = 0").agg(F.max("digest")).first()[0])))),
    "recipes swapped": ("recipes", _recipes(_swap)),
    "recipes of one length swapped": ("recipes", _recipes(_swap_equally_long)),
    "recipe cut": ("recipes", _recipes(_truncate)),
    "place changed": ("recipes", _recipes(_move)),
    "recipe missing": ("recipes", _recipes(_drop)),
    "base changed": ("manifest/parts", lambda df: df.withColumn("base", F.col("base") + 1)),
    "whole root changed": ("manifest/whole", lambda df: df.withColumn("root", F.sha2("root", 256).cast("binary"))),
}


@pytest.mark.parametrize("kind", sorted(DAMAGE))
def test_damaged_store_is_found(spark, tmp_path, kind):
    rows = [*TEXTS, (20, "one two"), (21, "three four"), (22, "the cat sat " * 900)]
    path = token_store.write_store(docs(spark, rows), str(tmp_path / "store"))
    token_store.read_report(spark, path).collect()
    altered(path, *DAMAGE[kind])
    for read in (token_store.read_report, token_store.reconstruct):
        with pytest.raises(Exception, match="damaged|missing|match"):
            read(spark, path).collect()


def test_another_tokenizer_gets_whole_texts(spark):
    from tokenizers import Tokenizer

    path = token_store.vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.token_report(docs(spark, [(1, "The cat's  tail\n"), (2, None), (3, "ÉCOLE")]), path).collect()}
    for i, t in ((1, "The cat's  tail\n"), (2, ""), (3, "ÉCOLE")):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def test_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    tok, encoder, rng = Tokenizer.from_file(token_store.vocabulary_path()), token_store.Encoder(token_store.vocabulary_path()), random.Random(1)
    bits = ["a", "B", "é", "É", "'s", "'", "...", ",", "!", " ", "\n", "\x1c", "<|endoftext|>", "<|EndOfText|>", "|>", "\u0301", "≠", "…", "1", "½", "ß", "İ", "K", "日", "🎉", "\xa0", "\u200b", "don't", "we'LL", "_", "\x00", "ﬁ"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert encoder.encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_encoder_composes_before_it_lowers():
    import random

    from tokenizers import Tokenizer

    tok, encoder, rng = Tokenizer.from_file(token_store.vocabulary_path()), token_store.Encoder(token_store.vocabulary_path()), random.Random(2)
    capitals = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    for text in ["H\u0331asan", "J\u030cob", "T\u0308a!", "W\u030aa", "aY\u030a."]:
        assert encoder.encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids, text
    bits = [*capitals, *(c.lower() for c in capitals), "a", "B", "ob", "asan", "!", "...", "'s", " ", "é", "\u0301", "\u0338", "=", "1"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        assert encoder.encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids, text
