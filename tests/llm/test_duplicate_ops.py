"""Operators 8 and 9 and the components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarrydex.llm import components, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, component_id string, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def fingerprint(text):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def near_rows():
    rng = random.Random(6)
    rows = []
    for k in range(40):
        words = [rng.choice("lorem ipsum dolor sit amet elit sed do eiusmod".split()) + str(rng.randint(0, 99)) for _ in range(200)]
        for _ in range(rng.choice([1, 1, 3])):
            rows.append((len(rows), " ".join(words)))
            words[rng.randint(0, 199)] = "changed"
    return [*rows, (200, None), (201, ""), (202, "One two"), (203, "one TWO"), (203, "one two"), (None, "one two"), (None, "alone here"), (204, "x " * 50_000)]


def test_simhash(spark):
    rows = near_rows()
    prints = [fingerprint(t) for _, t in rows]
    root = roots(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)]
    got = [tuple(r) for r in simhash.near_duplicates(table(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_documents(spark):
    rng = random.Random(13)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, len(words) // 48, len(words) // 6):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randint(0, len(words) - 1)] = "edited"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (903, "two"), (None, "one"), (None, "alone")]
    sets = {i: shingles(t) for i, t in rows[:240]}
    got = {r.doc_id: r.component_id for r in simhash.similar(table(spark, rows)).collect()}
    for i in sets:
        first = i - i % 4
        likeness = len(sets[i] & sets[first]) / len(sets[i] | sets[first])
        if likeness >= 0.82:
            assert got[i] == first
        assert got[i] in range(first, first + 4)
        if likeness < 0.6:
            assert got[i] == i
    assert (got[900], got[901], got[902]) == (900, 900, 902)
    kept = simhash.drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {i for i, c in got.items() if i is not None and i == c} | {903}
    assert kept.where("doc_id is null").count() == 2
    assert simhash.similar(table(spark, [])).count() == 0


@pytest.mark.parametrize("large", [1024, 12])
def test_large_groups_of_candidates(spark, monkeypatch, large):
    """One group: copies of a text, texts that chains of edits lead to, and templates that are candidates but not similar."""
    monkeypatch.setattr(simhash, "LARGE_WIDE", large)
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [base[:k] + [word()] + base[k + 1 :] for k in range(0, 200, 5)]
    step = list(base)
    for _ in range(30):  # far from the first text in the end, each near the one before
        at = rng.randrange(190)
        step = step[:at] + [word(), word()] + step[at + 2 :]
        texts.append(step)
    texts += [base[:150] + [word() for _ in range(50)] for _ in range(25)]  # 0.6 similar to the first text
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = table(spark, rows)
    sets = [shingles(t) for _, t in rows]
    every = docs.sparkSession.createDataFrame([(0, k) for k in range(1, len(rows))], "a bigint, b bigint")
    found = simhash.similar_links(docs.select(F.col("doc_id").alias("id"), "text"), every, 1024, 0.8).collect()
    similar = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(max(r), min(r)) for r in map(tuple, found)} <= similar

    def pieces(links):
        of = list(range(len(rows)))
        for _ in of:
            for i, j in links:
                of[i] = of[j] = min(of[i], of[j])
        return of

    assert pieces([tuple(r) for r in found]) == pieces(similar)


@pytest.mark.parametrize("large", [None, 20])
def test_links_of_a_large_bucket(large):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 12)
    prints = np.unique(np.concatenate([base] + [base ^ (1 << rng.integers(0, 62, 12)) ^ (1 << rng.integers(0, 62, 12)) for _ in range(30)]))
    bucket = np.sort(rng.integers(0, 3, len(prints)))
    a, b = simhash.links_in(bucket, prints)
    assert len(a) < len(prints)
    for k in range(3):
        own = [int(p) for p in prints[bucket == k]]
        got = list(range(len(own)))
        for x, y in zip(a.tolist(), b.tolist()):
            if x in own and y in own and set((x, y)) <= set(own):
                i, j = got[own.index(x)], got[own.index(y)]
                got = [min(i, j) if g in (i, j) else g for g in got]
        want = roots(own)
        assert len(set(got)) == len(set(want))


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_large_buckets_are_dealt_out(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "LARGE", 8)
    rng = np.random.default_rng(8)
    prints = sorted({int(x) for x in (np.int64(0x1234567) ^ (1 << rng.integers(0, 50, 300)) ^ (1 << rng.integers(0, 50, 300)) ^ (1 << rng.integers(0, 50, 300)))})
    df = spark.createDataFrame([(p,) for p in prints], "print bigint")
    labels = {r.node: r.root for r in components.components(simhash.near_links(df, blocks)).collect()}
    want = roots(prints)
    assert len({labels.get(p, p) for p in prints}) == len(set(want))


def test_bit_slices_count_distances():
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 1 << 62, 300)
    prints[1::2] = prints[::2] ^ (1 << rng.integers(0, 62, 150)) ^ (1 << rng.integers(0, 62, 150))
    planes = simhash.planes_of(prints.view(np.uint8).reshape(-1, 8))
    distances = np.array([1, 2, 63, 64, 65, 130])
    lanes = np.zeros((6, 64 * planes.shape[1]), bool)
    for row, d in zip(lanes, distances):
        row[: 300 - d] = True
    hit = simhash.near(planes, distances, np.packbits(lanes, axis=1, bitorder="little").view("<u8"))
    for row, d in zip(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"), distances.tolist()):
        assert np.flatnonzero(row).tolist() == [i for i in range(300 - d) if int(prints[i] ^ prints[i + d]).bit_count() <= 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 300), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        key = 1 << 62 if i is None else i
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, key), key)
    marks = {}
    for i, t in rows:
        data, key = (t or "").encode(), 1 << 62 if i is None else i
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < key:
                marks.setdefault(i, set()).update(range(p, p + length)) if sum(r[0] == i for r in rows) == 1 else None
    out = []
    for i, t in rows:
        data = (t or "").encode()
        own = marks.get(i, set())
        spans = sum(p - 1 not in own for p in own)
        out.append((i, len(data), len(own), spans, hashlib.sha256(bytes(b for p, b in enumerate(data) if p not in own)).hexdigest()))
    return out


def repeat_rows():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (9, 12, 30)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(4)]
        for s in shared:
            if rng.random() < 0.4:
                parts.insert(rng.randint(0, 4), s if rng.random() < 0.7 else s[rng.randint(0, 5) :])
        rows.append((i, "".join(parts)))
    return [*rows, (50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "a" * 3000), (55, "a" * 60), (56, "b" * 49), (57, "b" * 49), (58, "ab" * 40), (59, "x" + "ab" * 40), (None, rows[5][1]), (60, "é" * 25), (61, "é" * 26)]


@pytest.mark.parametrize("bucket_bytes, frequent", [(1 << 24, 5000), (500, 5000), (500, 2)])
def test_repeats(spark, monkeypatch, bucket_bytes, frequent):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "LEAST", min(frequent, 16))
    rows = repeat_rows()
    # a short string that many documents have, each in other surroundings, and a few in equal ones
    rng = random.Random(31)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, around = "(c) all rights reserved 2024", [line(40) for _ in range(12)]
    rows += [(1000 + k, line(30) + rng.choice(around) + common + rng.choice(around) + line(rng.randint(0, 30))) for k in range(60)]
    random.Random(11).shuffle(rows)
    df = substring_dedup.remove_repeats(table(spark, rows).repartition(3), bucket_bytes=bucket_bytes)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()]
    assert sorted(got, key=str) == sorted(removed(rows), key=str)


def removed_by_row(rows, length=50):
    """As ``removed``, but each row has its own places, whatever rows share its id; ids are compared, null as the largest."""
    first = {}
    for i, t in rows:
        data, key = t.encode(), 1 << 62 if i is None else i
        for p in range(len(data) - length + 1):
            first[data[p : p + length]] = min(first.get(data[p : p + length], key), key)
    out = []
    for i, t in rows:
        data, key = t.encode(), 1 << 62 if i is None else i
        own = {b for p in range(len(data) - length + 1) if first[data[p : p + length]] < key for b in range(p, p + length)}
        out.append((i, len(data), len(own), sum(p - 1 not in own for p in own), bytes(b for p, b in enumerate(data) if p not in own)))
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 500])
def test_repeats_of_rows_that_share_an_id(spark, bucket_bytes):
    rng = random.Random(14)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = line(80), line(90), line(120)
    rows = [(1, line(30) + a + line(9)), (2, b + line(40)), (None, line(200) + a + line(20)), (None, ""), (None, line(300)), (None, b), (None, b)]
    rows += [(7, line(400) + a), (7, line(60)), (7, ""), (7, c + b), (7, c), (8, "x" + c), (None, c + line(7))]
    df = substring_dedup.remove_repeats(table(spark, rows).repartition(3), bucket_bytes=bucket_bytes)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(removed_by_row(rows), key=str)


@pytest.mark.parametrize("first, second", [(-1, 5), (-1, -7), (1, 5), (-(1 << 63), -1), (1 << 62, (1 << 62) + 1), ((1 << 62) + 1, None), (0, (1 << 63) - 2)])
def test_repeats_of_any_ids(spark, first, second):
    """Documents in two partitions; two more make their passage one that several have already."""
    passage = "".join(random.Random(4).choice("abcdefgh ") for _ in range(81))
    rows = [(first, "x " + passage + " yz"), (second, passage + "!"), (77, "other " + passage), (78, passage)]
    for some in (rows[:2], rows):
        df = table(spark, some).repartitionByRange(len(some), "text")
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_repeats(df).collect()]
        want = removed_by_row([(1 << 70 if i is None else i, t) for i, t in some])
        assert sorted(((1 << 70 if i is None else i), *x) for i, *x in got) == sorted(want)


def test_repeats_of_empty_table(spark):
    assert substring_dedup.repeat_report(table(spark, [])).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_two_stage_sorting(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        text = np.append(rng.integers(1, letters + 1, rng.integers(1, 200)), 0).astype(np.uint8)
        data = text.tobytes()
        assert substring_dedup.suffix_array(text, 250).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
