"""Operator 11: how filters of documents overlap, from a histogram of failure masks.

Native expressions give each document a mask with a bit for every filter that it
fails; a grouping by text supplies the smallest id of each text.  All orders of
the filters are then told from 32 cells a part, without another look at the
documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the filters; the letter's place is its bit.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
COPIES = 1 << FILTERS.index("E")
LABELS = ("good", "toxic")


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the filters that look at nothing but the text: A, B, C, D."""
    n = F.size(words)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("bigint") < LEAST_DISTINCT * n.cast("bigint"),
        100 * capitals.cast("bigint") > MOST_CAPITALS * F.char_length(text).cast("bigint"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), mask of the text's own filters, good, toxic: one row per row of ``docs``.

    A null text counts as empty, a null part as the empty string.  A document is good (toxic) if any label row of its id has
    quality 1 (toxic 1); one without label, or without id, is neither.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # two columns look at the words, so they are split once and not within the expressions
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text", words.alias("words")).select("doc_id", "part", "digest", text_mask(F.col("text"), F.col("words")).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    return rows.join(marks, "doc_id", "left").fillna(0, list(LABELS))


def cells(masks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and five-bit mask, from ``failure_masks``.

    A document fails E if a smaller id has the same text anywhere in the table; of rows that share the smallest id none does,
    and a document without id neither fails E nor makes others fail.  Repeated ids are counted first, then each text's rows
    shrink within the tasks, so a text that a third of all documents have is a few rows when its parts meet.
    """
    alike = ["digest", "part", "mask", *LABELS]
    one = masks.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    groups = one.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
    )
    # a text has a row for each part and pair of labels here, however many documents have it
    first = F.min("least").over(Window.partitionBy("digest"))
    # what passes E: those without id, and those of the smallest id if it is in this row
    passes = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    counted = groups.withColumn("first", first).select("part", "mask", *LABELS, passes.alias("passes"), (F.col("n") - passes).alias("copies"))
    short = counted.groupBy("part", "mask", *LABELS).agg(F.sum("passes").alias("passes"), F.sum("copies").alias("copies"))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + COPIES).alias("mask"), F.col("copies").alias("n"))))
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in LABELS]]
    return short.select("part", *LABELS, split.alias("x")).select("part", "x.mask", "x.n", *LABELS).groupBy("part", "mask").agg(*sums)


def audit(histogram: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row, zeros included, per part of the ``cells``, order of the filters and step.  A part's cells, two to the number of
    filters at most, are one row; its steps are counted over that.  An empty table has no parts and gives no rows.
    """
    orders = " ".join("".join(p) for p in permutations(filters))
    held = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *LABELS)).alias("cells"))
    bits = {c: 1 << k for k, c in enumerate(filters)}
    steps = held.select("part", "cells", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("k", "filter"))
    bit_of = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    steps = steps.withColumn("bit", F.element_at(bit_of, F.col("filter")))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("k")), F.lit(0), lambda a, c: a.bitwiseOR(F.element_at(bit_of, c)))
    steps = steps.withColumn("before", before)

    def count(where, of: str = "n") -> Column:
        return F.aggregate(F.filter("cells", lambda x: where(x["mask"])), F.lit(0).cast("bigint"), lambda a, x: a + x[of])

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    reached = lambda m: m.bitwiseAND(F.col("before")) == 0
    here = lambda m: fails(m) & reached(m)
    rows = steps.select(
        "part",
        "filter_order",
        (F.col("k") + 1).cast("int").alias("step"),
        "filter",
        count(lambda m: reached(m) & ~fails(m)).alias("kept"),
        count(here).alias("removed"),
        count(lambda m: fails(m) & ~reached(m)).alias("redundant"),
        count(lambda m: m == F.col("bit")).alias("unique_fails"),
        count(here, "good").alias("good_lost"),
        count(here, "toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``audit`` for every ``lang`` of ``docs``."""
    return audit(cells(failure_masks(docs, labels)))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS x
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END)
             || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS failed FROM f),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before
       FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
z AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(failed, filter) AS fails, failed = filter AS alone,
         translate(failed, before, '') <> failed AS gone
  FROM st, c),
r AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM z GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
