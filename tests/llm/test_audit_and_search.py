"""Operators 11, 12 and 13 against plain code."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrydex.llm import filter_audit, lexical_search, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, words string, host string"
LABELS = "doc_id bigint, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, 7, "clash", "clash") for i, t, lang, source in rows], SCHEMA)


def rows_of_text(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "delta", "é", "x#y", "n&m", "one", "two", "tree"])
    rows = []
    for i in range(120):
        text = " ".join((word() if rng.random() < 0.5 else f"w{rng.randrange(400)}") + rng.choice(["", "", "\n", "\t "]) for _ in range(rng.choice([0, 1, 2, 3, 40, 60, 130, 200])))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None])))
    rows += [(200 + k, rows[7][1], "en", "a") for k in range(9)] + [(3, rows[3][1], rows[3][2], rows[3][3]), (None, rows[7][1], "en", "a"), (None, "x", "xx", None)]
    rows += [(300, None, "en", "a"), (301, "", "de", "a"), (302, " \n\x0b\r\n ", "de", "a"), (303, "very long " * 30_000, "fr", "c"), (-5, rows[9][1], "fr", "c"), (304, "ABC " * 120, "fr", "c")]
    return rows


# ---- operator 11


def audited(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    cells = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        cells[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, docs in cells.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [f, len(left) - len(here), len(here), sum(f in d[0] for d in docs) - len(here), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
                left = [d for d in left if f not in d[0]]
        for (p, _, _), row in out.items():
            if p == part:
                row.append(shapley[row[0]])
    return out


def test_filter_audit(spark):
    rows = rows_of_text()
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 310, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, int(q), int(x)) for i, q, x in labels]
    got = filter_audit.filter_audit(table(spark, rows).repartition(4), spark.createDataFrame(labels, LABELS))
    assert {(r.part, r.filter_order, r.step): [r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == audited(rows, labels)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(table(spark, []), none).count() == 0
    one = filter_audit.filter_audit(table(spark, [(1, None, None, None)]), none).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one} == {0, 120}
    assert all(r.kept == (0 if "A" in r.filter_order[: r.step] else 1) for r in one)


def test_copies_shrink_before_they_meet(spark):
    """Ten thousand copies are a few rows, whatever the number of tasks."""
    rows = [(i, "the same", "en" if i % 2 else "de", None) for i in range(10_000)]
    masks = filter_audit.failure_masks(table(spark, rows), spark.createDataFrame([], LABELS))
    held = {(r.part, r.mask): r.n for r in filter_audit.cells(masks).collect()}
    assert held == {("de", 1): 1, ("de", 17): 4999, ("en", 1): 0, ("en", 17): 5000}


# ---- operator 12


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(set)
    for name, text in items:
        asked[name] |= set(terms(text))
    out = []
    for name, own in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in own if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(name, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "alpha Beta GAMMA"), (2, "w1 w2 w3 w4 one"), (3, None), (4, ""), (5, "unheard of"), (6, "É é ü x#y"), (6, "tree"), (None, "delta"), (7, "alpha alpha alpha")]


@pytest.mark.parametrize("shard_bytes, block_bytes, k", [(1 << 24, 1 << 22, 50), (2000, 30, 7), (1, 1 << 22, 50)])
def test_ranked_search(spark, tmp_path, shard_bytes, block_bytes, k):
    rows = [(i, t) for i, t, *_ in rows_of_text(1)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    lexical_search.build_index(docs, str(tmp_path / "i"), shard_bytes=shard_bytes)
    got = lexical_search.ranked(spark, str(tmp_path / "i"), items, k, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, ITEMS, k)


def test_ranked_search_of_nothing(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.ranked_search(table(spark, []), items).count() == 0
    assert lexical_search.ranked_search(table(spark, [(1, None, None, None), (2, "!", None, None)]), items).count() == 0
    assert lexical_search.ranked_search(table(spark, [(1, "alpha", None, None)]), items.limit(0)).count() == 0


def test_ties_at_the_last_rank(spark):
    rows = [(i, "same words here" if i % 3 else "other text") for i in range(900, 0, -1)]
    got = lexical_search.ranked_search(table(spark, [(i, t, None, None) for i, t in rows]).repartition(5), spark.createDataFrame([("a", "words")], "item_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, [("a", "words")], 50)


# ---- operator 13


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    many = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if many[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def repeating_rows():
    rng = random.Random(6)
    rows = rows_of_text(2) + [(400 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(90))), "en", "b") for k in range(150)]
    rows += [(600, "a a a a", None, None), (601, "a b a b a", None, None), (602, "a b c a b c", None, None), (603, "l\nl\n l\n\nl\r\nl", None, None), (604, "a b c x a b c y b c x", None, None)]
    return rows


def test_measures(spark):
    rows = repeating_rows()
    got = quality_rules.quality_rules(table(spark, rows).repartition(3))
    want = [(i, *measured(t)) for i, t, *_ in rows]
    assert sorted([tuple(r)[:6] for r in got.collect()], key=str) == sorted(want, key=str)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and not r.host_rejected)


def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """With no bits of the hash left, every window is compared as a string."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 63)
    monkeypatch.setattr(quality_rules, "PLACES", (1 << 63) - 1)
    rows = repeating_rows()[:130] + repeating_rows()[-40:]
    got = quality_rules.measures(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *measured(t)) for i, t, *_ in rows], key=str)


def hosts(spark, counts):
    rows, n = [], 0
    for host, (size, bad) in counts.items():
        for k in range(size):
            n += 1
            rows.append((n, " ".join(f"w{j}" for j in range(10 if k < bad else 60)), "en", host))
    return table(spark, rows)


def test_hosts_are_rejected_on_evidence(spark):
    docs = hosts(spark, {f"good{k}": (200, 10) for k in range(8)} | {"spam": (300, 270), "tiny": (2, 2), "half": (200, 100), None: (50, 50)})
    got = quality_rules.quality_rules(docs)
    judged = got.join(docs.select("doc_id", F.col("source").alias("of")), "doc_id")
    assert {r.of for r in judged.where("host_rejected").select("of").distinct().collect()} == {"spam"}
    assert judged.where("of = 'spam' and kept").count() == 0 and judged.where("of = 'half' and kept").count() == 100
    alike = quality_rules.quality_rules(hosts(spark, {f"h{k}": (100, 90) for k in range(5)}))
    assert alike.where("host_rejected").count() == 0 and alike.where("kept").count() == 50


def test_rates_are_shrunk_by_moments(spark):
    counts = {"a": (100, 20), "b": (50, 40), "c": (10, 9), "d": (400, 40)}
    rows = [(h, k < bad) for h, (n, bad) in counts.items() for k in range(n)]
    got = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, bad boolean"), {"bad": F.col("bad")}).collect()}
    m = sum(f for _, f in counts.values()) / sum(n for n, _ in counts.values())
    shares = [f / n for n, f in counts.values()]
    spread = sum((x - sum(shares) / 4) ** 2 for x in shares) / 4 - m * (1 - m) * sum(1 / n for n, _ in counts.values()) / 4
    s = min(max(m * (1 - m) / spread - 1, 1), 10_000)
    for h, (n, f) in counts.items():
        rate = (f + m * s) / (n + s)
        assert got[h].rate == pytest.approx(rate) and got[h].low == pytest.approx(rate - 2 * math.sqrt(rate * (1 - rate) / (n + s + 1)))


def test_quality_of_nothing(spark):
    assert quality_rules.quality_rules(table(spark, [])).count() == 0
    assert [r.kept for r in quality_rules.quality_rules(table(spark, [(None, None, None, None)] * 2)).collect()] == [False, False]
    urls = spark.createDataFrame([("HTTP://News.Example.com:80/a?b",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in urls.select(quality_rules.host_of(F.col("url"))).collect()] == ["news.example.com", None, None]
