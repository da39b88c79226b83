"""The stored index: block-max search against plain scoring, trigrams of names against a scan, Spanish stems."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrydex.engine import Engine
from quarrydex.functions import text
from quarrydex.functions.blockmax import Postings, best, pack
from quarrydex.functions.stemming import spanish
from quarrydex.functions.text import glob
from quarrydex.operators import search, text_index
from quarrydex.operators.text_index import TextIndex, glob_parts, grams
from quarrydex.plans import catalog

# Words and stems of the published sample of the Spanish stemmer.
SAMPLE = """cheque chequ chequeo cheque cheques chequ chetumaleños chetumaleñ chía chi chiapaneca chiapanec chica chic chicanos chican
chicharrones chicharron chichimecas chichimec torá tor tórax torax torcer torc toreado tor toreándolo tor torear tor toreara tor torearlo tor
toreó tore torero torer tormentas torment tornado torn tornen torn torneos torne tornillos tornill torniquete torniquet toros tor torpedearon torped
torpeza torpez torralba torralb torrenciales torrencial torreón torreon torres torr""".split()


def test_published_stems():
    assert [spanish(w) for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert {spanish(w) for w in ("nacional", "nacionales", "nacionalidad", "nacionalmente")} == {"nacional"}
    assert spanish("") == "" and spanish("x") == "x" and spanish("2024") == "2024"


@pytest.mark.parametrize("block", [1, 3, 128])
def test_blocks_come_back(block):
    rng = np.random.default_rng(block)
    term, place, tf, dl = [], [], [], []
    for t in range(40):
        own = np.sort(rng.choice(200_000, rng.integers(1, 400), replace=False))
        term += [t] * len(own)
        place += own.tolist()
    tf, dl = rng.integers(1, 300, len(term)), rng.integers(1, 100_000, len(term))
    term, place = np.array(term), np.array(place)
    packed = pack(term, place, [tf, dl], tf / dl, block)
    for t in range(40):
        p = Postings(*[packed[c][t].as_py() for c in ("n", "last", "most", "width", "payload")], lambda place, tf, dl: tf / dl, 2, block)
        own = term == t
        assert p.places().tolist() == place[own].tolist()
        assert np.concatenate([p.decompressed(b)[1] for b in range(len(p.last))]).tolist() == (tf / dl)[own].tolist()
        assert [max(p.decompressed(b)[1]) for b in range(len(p.last))] == list(p.most)


@pytest.mark.parametrize("seed", range(6))
def test_best_is_that_of_plain_scoring(seed):
    rng = np.random.default_rng(seed)
    documents, lists, plain = 3000, [], np.zeros(3000, np.int64)
    for _ in range(6):
        place = np.sort(rng.choice(documents, rng.integers(1, documents), replace=False))
        tf, weight = rng.integers(1, 4 + 40 * seed, len(place)), int(rng.integers(1, 9))
        packed = pack(np.zeros(len(place), np.int64), place, [tf], tf)
        row = [packed[c][0].as_py() for c in ("n", "last", "most", "width", "payload")]
        lists.append((Postings(row[0], np.array(row[1]), np.array(row[2]), row[3], row[4], lambda place, tf: tf), weight))
        plain[place] += weight * tf
    order = np.lexsort((np.arange(documents), -plain))[:25]
    places, scores = best(lists, documents, 25)
    assert places.tolist() == order[plain[order] > 0].tolist() and scores.tolist() == plain[places].tolist()
    among = np.arange(documents) % 7 == 0
    order = [i for i in np.lexsort((np.arange(documents), -plain)) if among[i] and plain[i] > 0][:25]
    assert best(lists, documents, 25, 0, among)[0].tolist() == order
    floor = int(scores[9])
    assert best(lists, documents, 25, floor)[0].tolist() == [p for p in places.tolist() if plain[p] >= floor]


@pytest.mark.parametrize("few", [0, 100_000])
def test_blocks_are_left_compressed(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(text_index, "FEW_FILES", few)
    rows = [(i, "common " * (1 + i % 3) + ("rare " if i == 4321 else "") + "filler " * (i % 50)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "file_id bigint, content string")
    index = TextIndex.build(docs, str(tmp_path / "i"), ["content"])
    got = [tuple(r) for r in index.search("rare common", 5).collect()]
    assert got == [tuple(r) for r in search.text_search(docs, "rare common", 5).collect()] and got[0][0] == 4321
    read, of = index.blocks
    assert 48 <= of <= 56 and read < of  # by the shards that a sample of the ids gives


@pytest.mark.parametrize("few", [0, 100_000])
def test_odd_rows(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(text_index, "FEW_FILES", few)
    schema = "file_id bigint, name string, content string, type string, lang string"
    empty = TextIndex.build(spark.createDataFrame([], schema), str(tmp_path / "none"), ["name", "content"], kind="type", name="name")
    assert empty.search("a").collect() == [] and empty.names_containing("a").collect() == []
    rows = [(3, None, None, None, None), (2, "", "", "", ""), (2, "dup", "dup", "x", "en"), (2, "dup", "dup", "x", "en"), (1, "Straße ÀÉ.txt", "word " * 70_000, "x", None)]
    index = TextIndex.build(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "odd"), ["name", "content"], kind="type", name="name", language="lang")
    assert [r.file_id for r in index.search("dup").collect()] == [2, 2]
    assert [r.file_id for r in index.search("WORD", kind="x").collect()] == [1] and index.search("word", kind="y").count() == 0
    assert [r.file_id for r in index.names_containing("aße àé").collect()] == [1]
    assert index.search("word", 0).count() == 0


def test_spanish_words_meet_by_stem(spark, tmp_path):
    rows = [("1", "los documentos rápidos", "es"), ("2", "un documento", "spanish"), ("3", "documentos", "en"), ("4", None, "es")]
    index = TextIndex.build(spark.createDataFrame(rows, "file_id string, content string, lang string"), str(tmp_path / "es"), ["content"], language="lang")
    assert {r.file_id for r in index.search("DOCUMENTO", language="spanish").collect()} == {"1", "2"}
    assert {r.file_id for r in index.search("documentos").collect()} == {"3"}
    stopped = TextIndex.build(spark.createDataFrame(rows, "file_id string, content string, lang string"), str(tmp_path / "stop"), ["content"], stop=["un", "los"])
    assert stopped.search("los un").count() == 0 and stopped.search("rápidos").count() == 1


def test_grams():
    assert grams("abc") == {"abc", "bc\0", "c\0\0"} and grams("") == set()
    assert glob_parts("*ab?cd[xy]e") == (["ab", "cd", "e"], True)
    assert glob_parts("ab*") == (["ab"], False) and glob_parts("[x") == (["[x"], True) and glob_parts("*") == ([], False)


def test_names_against_a_scan(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdeABC._- ") for _ in range(rng.randrange(0, 24)))) for i in range(3000)]
    rows.append((5000, None))
    names = spark.createDataFrame(rows, "file_id bigint, name string").repartition(3)
    index = TextIndex.build(names, str(tmp_path / "n"), ["name"], name="name", shard_bytes=4000)
    for query in ("abc", "B", "e_", "a.b-c", "c a", "zz", "  ", "%", "abcde"):
        assert index.names_containing(query, 5000).collect() == search.name_matches(names, query, 5000).collect(), query
    for pattern in ("*abc*", "a*e", "?b[ab]*", "[!a]*cd", "*", "", "*.b", "abc*a"):
        want = sorted(r[0] for r in names.where(F.lower("name").rlike(glob(pattern.lower()))).select("file_id").collect())
        assert sorted(r.file_id for r in index.names_like(pattern).collect()) == want, pattern
    looked = index.name_candidates(["abcd"]).select(F.sum(F.size("places"))).first()[0]
    assert looked < 0.05 * len(rows)


def test_an_index_of_replaced_files_is_not_used(spark, tmp_path):
    folder = str(tmp_path)
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    table([(1, "old words", "en"), (2, "the moron", "en")])
    assert [r.file_id for r in catalog.bm25_search(spark, folder).collect()] == [2]
    again = catalog.text_index(spark, folder)
    assert catalog.text_index(spark, folder) is again
    table([(1, "old words", "en"), (7, "the moron", "en")])
    assert [r.file_id for r in catalog.bm25_search(spark, folder).collect()] == [7]


@pytest.mark.parametrize("few, one_task", [(0, 0), (0, 1 << 20), (100_000, 0)])
def test_many_shards(spark, tmp_path, monkeypatch, few, one_task):
    monkeypatch.setattr(text_index, "FEW_FILES", few)
    monkeypatch.setattr(text_index, "ONE_TASK", one_task)
    rng = random.Random(2)
    rows = [(f"f{i:04}", " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randrange(12))), rng.choice("xy")) for i in range(700)]
    docs = spark.createDataFrame(rows, "file_id string, content string, type string").repartition(4)
    index = TextIndex.build(docs, str(tmp_path / "s"), ["content"], kind="type", shard_bytes=500)
    assert index.ids.count() > 20
    for query, limit in (("ab", 5), ("cd ef", 700), ("gh ab nothing", 30)):
        assert index.search(query, limit).collect() == search.text_search(docs, query, limit).collect()
        assert index.search(query, limit, kind="x").collect() == search.text_search(docs, query, limit, where="type = 'x'").collect()
        assert index.hits(query, limit).collect() == index.search(query, limit).collect() and index.hits("nothing") is None


def test_engine_searches_its_index(spark, tmp_path):
    files = spark.createDataFrame([("a", "n1", "Informe.txt", "document", 1), ("a", "n2", "nuevo.txt", "document", 2), ("b", "n1", "foto.png", "image", 1)], "file_id string, node_id string, name string, type string, last_updated int")
    contents = spark.createDataFrame([("a", "hola mundo")], "file_id string, content string")
    engine = Engine(spark, tables={"files": files, "contents": contents})
    plain = [[tuple(r) for r in engine.search(*q).collect()] for q in (("mundo",), ("FOTO",), ("oto",), ("txt", "image"), ("uev", "document"))]
    engine.build_index(str(tmp_path / "i"))
    assert [[tuple(r) for r in engine.search(*q).collect()] for q in (("mundo",), ("FOTO",), ("oto",), ("txt", "image"), ("uev", "document"))] == plain
    assert plain[4] == [("a", 0.0, "name")]  # the name of the replica updated last
    assert [r.name for r in engine.names_like("*.PNG").collect()] == ["foto.png"]


def test_weights_are_bm25(spark, tmp_path):
    texts = ["x y y", "y", "z z z z"]
    index = TextIndex.build(spark.createDataFrame(list(enumerate(texts)), "file_id bigint, content string"), str(tmp_path / "w"), ["content"])
    words = [Counter(t.split()) for t in texts]
    mean = sum(w.total() for w in words) / 3
    want = {i: round(math.log(1 + (3 - 2 + 0.5) / 2.5) * w["y"] * 2.5 / (w["y"] + 1.5 * (0.25 + 0.75 * w.total() / mean)), 6) for i, w in enumerate(words) if w["y"]}
    assert {r.file_id: r.score for r in index.search("y", fields={"content": 1.0}).collect()} == want


def test_a_shard_being_built_holds_numbers_not_words():
    from collections import Counter

    from quarrydex.operators import text_index

    words = text_index._Counts()
    for k in range(50):
        words.add(Counter([f"w{k % 3}", f"w{k % 3}", "all"]))
    words.add(Counter())
    assert len(words.vocabulary) == 4 and sum(n.nbytes + t.nbytes for n, t in zip(words.numbers, words.times)) == 50 * 2 * 8
    rows = text_index._field_rows(7, "text", words, 3.0)
    assert rows.column("term").to_pylist() == ["all", "w0", "w1", "w2"] and rows.column("n").to_pylist() == [50, 17, 17, 16]


def test_a_shard_of_names_ends_by_its_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SHARD_POSTINGS", 20_000, raising=False)
    monkeypatch.setattr(text_index, "STEP_BYTES", 4000, raising=False)
    names = spark.range(9000).selectExpr("id as file_id", "concat('http://', sha2(string(id), 256)) as name").coalesce(1)
    index = TextIndex.build(names, str(tmp_path / "n"), ["name"], name="name")  # 16 MB would be a shard's whole part of the table
    postings = index.postings.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert postings[0] < 25_000 and postings[1] >= 30
    assert index.names_containing("AB0", 9000).collect() == search.name_matches(names, "AB0", 9000).collect()


def test_rows_of_a_shard_take_few_bytes_a_posting():
    import tracemalloc

    words = text_index._Counts()
    for k in range(2000):
        words.add(Counter(f"w{(k * j) % 5003}" for j in range(150)))
    n = sum(map(len, words.numbers))
    tracemalloc.start()
    rows = text_index._field_rows(0, "text", words, 150.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows.column("n").to_pylist()) == n and peak < 90 * n  # 124 with whole columns of 8 bytes


def test_texts_are_counted_as_word_by_word():
    import pyarrow as pa

    texts = ["", "uno dos uno", "documentos documento", "documentos rápidos", "", "ñ 1 ñ"]
    stems = np.array([False, False, True, False, True, True])
    one, many = text_index._Counts(), text_index._Counts()
    for t, s in zip(texts, stems):
        one.add(Counter(map(spanish, t.split(" ")) if s else t.split(" ")) if t else Counter())
    many.add_texts(pa.array(texts[:2]), stems[:2])
    many.add_texts(pa.array(["x", *texts]).slice(3), stems[2:])
    assert text_index._field_rows(3, "text", many, 2.0).equals(text_index._field_rows(3, "text", one, 2.0))


def test_words_without_a_list_are_those_of_tokens(spark):
    odd = [None, "", " ", "¡Hola, MUNDO!", "İstanbul ß ǅ", "áb x\u0000y", "Ⅷ ² ٣4 ١", "--a_b--", "日本 語。", "𝔘 😀 𐐀x", "tab\there\nline end ", "one", "...", "x  y"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for stop in (None, ["one", "x"]):
        want = text.tokens(F.col("t"), stop)
        got = rows.select(text.spaced(F.col("t"), stop).alias("s"), F.array_join(want, " ").alias("w"), text.token_count(F.col("t"), stop).alias("n"), F.size(want).alias("m")).collect()
        assert [r.s for r in got] == [r.w for r in got] and [r.n for r in got] == [r.m for r in got]


def test_postings_are_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(40).selectExpr("id as file_id", "repeat(concat('w', id, ' '), 500000) as content")  # 76 MB
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = TextIndex.build(docs, str(tmp_path / "t"), ["content"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in index.postings.inputFiles() if "part=0" in f]) >= 2  # one before
    assert [r.file_id for r in index.search("w7", 5, {"content": 1.0}).collect()] == [7]
