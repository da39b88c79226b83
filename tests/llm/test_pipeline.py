"""The pipeline's stages on a small corpus with planted cases."""

import random
import re

import corpus_pipeline
from quarrydex.llm import decontaminate, mixing, simhash, toxicity
from quarrydex.llm.registry import QUERIES, SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(12)
    stock = [a + b for a in "ba ce di fo gu ha ki".split() for b in "n r st l m x".split()]
    line = lambda n: " ".join(rng.choice(stock) + rng.choice(stock) for _ in range(n))
    item = line(20)
    docs, labels, near = [], [], {}
    for i in range(300):
        text = line(60)
        toxic = i % 5 == 0
        if toxic:
            text += " idiot " + line(3)
        if i % 7 == 1:
            text = docs[i - 1][1] + "\n"
            toxic = labels[i - 1][2]
        if i % 11 == 4:  # a near copy: a word more at either end, other blanks
            text = line(1) + "  " + docs[i - 2][1] + ", " + line(1)
            toxic = labels[i - 2][2]
            near[i] = i - 2
        elif i % 31 == 2:
            text += " " + item
        docs.append((i, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1"]), len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, {i: t for i, _, t in labels}, item, near


def shingles(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, toxic, item, near = corpus(spark, folder)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_store"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, folder)
        if k < 4:
            assert out.columns == COLUMNS
            out.write.parquet(f"{folder}/stage{k}")
            df = spark.read.parquet(f"{folder}/stage{k}")
            kept[name] = {r.doc_id for r in df.select("doc_id").collect()}
        else:
            rows = out.collect()
    clean = {i for i, *_ in docs if not toxic.get(i, 0)}
    assert kept["toxicity"] == clean
    texts = {i: t for i, t, *_ in docs}
    groups = {i: shingles(texts[i]) for i in sorted(clean)}
    left = {i for i in clean if not any(j < i and similar(groups[i], groups[j]) for j in clean)}
    assert kept["simhash_near_dedup"] == left and sum(i in clean and i not in left for i in near) > 10
    assert kept["benchmark_decontamination"] == {i for i in left if item not in (texts[i] or "")}
    assert kept["source_mixing"] <= kept["benchmark_decontamination"]
    assert {r.doc_id for r in rows} == kept["source_mixing"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, rows))


def test_clashing_names_odd_texts_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path)
    _, _, item, _ = corpus(spark, folder)
    rows = [(500, "word " * 50_000, "en", "s0", 0), (501, None, None, None, None), (501, None, None, None, None), (None, "one two three", "en", "s1", 3), (None, item, "en", "s1", 3)]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    df = df.union(spark.createDataFrame(rows, df.schema))
    names = ["_leak", "_score", "_new", "_kept", "kept", "leak", "id", "print", "topic", "tokens", "probability", "root", "part", "bucket", "score", "held_out", "node_id", "_LEAK_"]
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        out.write.parquet(f"{folder}/wide{k}")
        df = spark.read.parquet(f"{folder}/wide{k}")
    got = df.collect()
    assert got and all(r[name] == f"{name} of {'none' if r.doc_id is None else r.doc_id}" for r in got for name in names)
    assert corpus_pipeline.STAGES[4][1](spark, df, folder).count() == len(got)


def test_empty_tables(spark, tmp_path):
    for name, empty in (("documents", ["documents"]), ("labels", ["labels"]), ("benchmark", ["benchmark"])):
        folder = f"{tmp_path}/{name}"
        corpus(spark, folder)
        for table in empty:
            df = spark.read.parquet(f"{folder}/{table}.parquet")
            df.limit(0).write.parquet(f"{folder}/none/{table}.parquet")
        for table in {"documents", "labels", "benchmark"} - set(empty):
            spark.read.parquet(f"{folder}/{table}.parquet").limit(40).write.parquet(f"{folder}/none/{table}.parquet")
        assert (corpus_pipeline.run(spark, f"{folder}/none").count() == 0) == (name == "documents")


def test_registry_and_stages_share_operators():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert all((decontaminate.decontaminate, mixing.mix, simhash.drop_near_duplicates, toxicity.drop_toxic))
