"""Operator 6: mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until the marginals of each of the three
match their targets, no cell beyond what it has; the part of a cell's tokens to be kept is the probability of its
documents, and a hash of a document's id decides.  A caller's column gives the topic; where there is none, ``word_group``
takes its place: a grouping of the words by hash, which spreads the draw over vocabularies but has no meaning by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, spare, strings
from .decontaminate import words

#: Topics that words are dealt to, and bytes of a word that counts for a topic.
TOPICS, TOPIC_BYTES = 8, 5
#: Rounds at most, and the largest gap between a marginal and its target, as a part of it, at which raking ends.
ROUNDS, TOLERANCE = 24, 1e-3
#: Rounds in one plan; the gap is looked at behind them.
AT_ONCE = 4
DIMS = ("source", "lang", "topic")
#: Name of the third dimension in results where the documents have no topic of their own.
STAND_IN = "word_group"
#: Without explicit targets a value's share is its share of the tokens to this power: smaller than 1 lifts rare ones.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.5}
NONE = "(none)"
SEED = "mix"
#: Part of all tokens to be kept, as far as the cells allow.
BUDGET = 0.5
#: Entries of a worker's cache of words.
CACHE = 500_000


def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words and topic of each text.  The topic is the one with the most words of at least TOPIC_BYTES bytes, by the first
    hexadecimal digit of a word's MD5; the smaller one on ties, -1 without such words."""
    known: dict[bytes, int] = {}
    for batch in batches:
        n, topic = [], []
        for text in strings(batch):
            own = words(text)
            votes = []
            for w in own:
                t = known.get(w)
                if t is None:
                    if len(known) >= CACHE:
                        known.clear()
                    t = known[w] = hashlib.md5(w).digest()[0] // 16 % TOPICS if len(w) >= TOPIC_BYTES else TOPICS
                votes.append(t)
            count = np.bincount(np.array(votes, np.int64), minlength=TOPICS + 1)[:TOPICS]
            n.append(len(own))
            topic.append(int(count.argmax()) if count.any() else -1)
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(topic, pa.int32())], ["n", "topic"])


def reachable(values: DataFrame, d: str, budget: float) -> DataFrame:
    """``d`` and its target t: shares of ``budget`` in proportion to r, but no more than the a tokens that there are; what some lack goes to the others.

    A row for each value, ordered by how soon it runs out.
    """
    first = Window.orderBy(F.col("a") / F.col("r"), d)
    gone = F.coalesce(F.sum("a").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("r").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = values.where("r > 0 and a > 0").select(d, "a", "r", gone.alias("gone"), left.alias("left"))
    ranked = ranked.withColumn("short", F.col("a") * F.col("left") < (F.lit(budget) - F.col("gone")) * F.col("r"))
    every = Window.partitionBy()
    share = (F.lit(budget) - F.coalesce(F.sum(F.when(F.col("short"), F.col("a"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("short"), F.col("r"))).over(every)
    return ranked.select(d, F.when(F.col("short"), F.col("a")).otherwise(share * F.col("r")).alias("t"))


def largest_gap(cells: DataFrame) -> float:
    """The largest part of its target by which a marginal of w misses it."""
    parts = [F.abs(F.sum("w").over(Window.partitionBy(d)) / F.col(f"t_{d}") - 1) for d in DIMS]
    return cells.where("tokens > 0").select(F.greatest(*[F.when(F.col(f"t_{d}") > 0, p) for d, p in zip(DIMS, parts)]).alias("gap")).agg(F.max("gap")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with a column ``factor``: the part of a cell's tokens to keep, 0 to 1, and the targets t_source, t_lang, t_topic.

    The targets of each marginal add up to ``budget`` times all tokens; a value with too few tokens for its target keeps
    all, and the others share what it lacks.  Raking ends when no marginal misses its target by more than ``tolerance`` of
    it, or after ``rounds``: ``marginals`` tells what was reached.

    ``targets``: for some of the three, a DataFrame of value and weight (of any sum; a value without a target gets weight 0);
    for the others the tempered shares.  Cells without tokens keep factor 0.
    """
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMS:
        values = cells.groupBy(d).agg(F.sum("w").alias("a"))
        if targets and d in targets:
            given = targets[d].select(F.col("value").cast("string").alias(d), F.col("weight").cast("double").alias("r"))
            values = values.join(given, d, "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
        else:
            values = values.withColumn("r", F.pow("a", F.lit(TEMPERATURE[d])))
        due = reachable(values, d, budget * whole).withColumnRenamed("t", f"t_{d}")
        cells = cells.join(due, d, "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)))
    cells = cut(cells, "cells")
    for k in range(rounds):
        for d in DIMS:
            have = F.sum("w").over(Window.partitionBy(d))
            cells = cells.withColumn("w", F.when(have > 0, F.least(F.col("tokens").cast("double"), F.col("w") * F.col(f"t_{d}") / have)).otherwise(F.lit(0.0)))
        if (k + 1) % AT_ONCE == 0 or k + 1 == rounds:
            cells = cut(cells, "cells")
            if largest_gap(cells) <= tolerance:
                break
    return cells.select(*DIMS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0)).alias("factor"), *[f"t_{d}" for d in DIMS])


def marginals(raked: DataFrame) -> DataFrame:
    """dimension, value, target, reached, gap (a part of the target; null without one) of every value of the three, from what ``rake`` returns."""
    out = None
    for d in DIMS:
        own = raked.groupBy(F.col(d).alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum(F.col("factor") * F.col("tokens")).alias("reached")).select(F.lit(d).alias("dimension"), "value", "target", "reached")
        out = own if out is None else out.union(own)
    return out.withColumn("gap", F.try_divide(F.abs(F.col("reached") - F.col("target")), F.col("target")))


def draw(id_col: str, seed: str = SEED):
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def calibrate(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept: one row per row of ``docs``.

    Without ``topic_col`` the column is called ``word_group``, and so it is.

    tokens are the words of the whole text (runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``).  A null source, language or topic is a value of
    its own.  probability is the cell's factor, so the expected marginals of what is kept match the targets; texts without words have probability 1.  kept: a hash of the id is below it, so rows that share an id share the draw.
    """
    measured = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"), (F.lit(None).cast("string") if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE))).alias("topic"), F.arrow_udf(measure, "struct<n:bigint,topic:int>")(F.col(text_col)).alias("m")).select("doc_id", "source", "lang", F.coalesce("topic", F.col("m.topic").cast("string")).alias("topic"), F.col("m.n").alias("tokens")),
        "measured",
    )
    cells = cut(rake(measured.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), targets, rounds), "factors")
    p = F.when(F.col("tokens") > 0, F.col("factor")).otherwise(F.lit(1.0))
    return (
        measured.join(cells.select(*DIMS, "factor"), list(DIMS))
        .select("doc_id", "source", "lang", F.col("topic").alias(STAND_IN if topic_col is None else "topic"), "tokens", F.round(p, 9).alias("probability"))
        .withColumn("kept", draw("doc_id") < F.col("probability"))
    )


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with its columns.  Rows that share an id stay if one of them is drawn."""
    kept = spare(docs, "_kept")
    chosen = calibrate(docs, targets).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[kept]), "left_semi")


def _sql() -> str:
    dims = ("source", "lang", "topic")
    parts = [
        """m AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)""",
        f"""votes AS (SELECT doc_id, CAST('0x' || substring(md5(x), 1, 1) AS BIGINT) % {TOPICS} AS topic, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x FROM m) WHERE strlen(x) >= {TOPIC_BYTES} GROUP BY ALL)""",
        "best AS (SELECT doc_id, arg_min(topic, -n * 100 + topic) AS topic FROM votes GROUP BY doc_id)",
        """d AS (SELECT m.doc_id, source, lang, CAST(coalesce(topic, -1) AS VARCHAR) AS topic, CAST(len(w) AS BIGINT) AS tokens
  FROM m LEFT JOIN best ON best.doc_id = m.doc_id)""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
        "whole AS (SELECT CAST(sum(tokens) AS DOUBLE) * " + str(BUDGET) + " AS b FROM c)",
    ]
    for d in dims:
        parts += [
            f"a_{d} AS (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS a, pow(CAST(sum(tokens) AS DOUBLE), {TEMPERATURE[d]}) AS r FROM c GROUP BY {d} HAVING sum(tokens) > 0)",
            f"b_{d} AS (SELECT {d}, a, r, coalesce(sum(a) OVER (ORDER BY a / r, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(r) OVER (ORDER BY a / r, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a_{d})",
            f"s_{d} AS (SELECT *, a * rest < ((SELECT b FROM whole) - gone) * r AS short FROM b_{d})",
            f"t_{d} AS (SELECT {d}, CASE WHEN short THEN a ELSE ((SELECT b FROM whole) - coalesce((SELECT sum(a) FROM s_{d} WHERE short), 0)) / (SELECT sum(r) FROM s_{d} WHERE NOT short) * r END AS t FROM s_{d})",
        ]
    parts.append("k0 AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CAST(tokens AS DOUBLE) AS w, " + ", ".join(f"coalesce(t_{d}.t, 0) AS t_{d}" for d in dims) + " FROM c " + " ".join(f"LEFT JOIN t_{d} ON t_{d}.{d} = c.{d}" for d in dims) + ")")
    n, done = 0, ""
    for k in range(ROUNDS):
        for d in dims:
            parts.append(f"k{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, CASE {done}WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN least(CAST(tokens AS DOUBLE), w * t_{d} / sum(w) OVER (PARTITION BY {d})) ELSE 0 END AS w FROM k{n})")
            n += 1
        if (k + 1) % AT_ONCE == 0:
            gaps = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) / nullif(t_{d}, 0) - 1)" for d in dims)
            parts.append(f"g{n} AS MATERIALIZED (SELECT coalesce(max(g), 0) AS g FROM (SELECT greatest({gaps}) AS g FROM k{n} WHERE tokens > 0))")
            done = f"WHEN (SELECT g FROM g{n}) <= {TOLERANCE} THEN w "
    parts.append(f"f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS factor FROM k{n})")
    parts.append("p AS (SELECT doc_id, d.source, d.lang, d.topic, tokens, CASE WHEN tokens > 0 THEN round(factor, 9) ELSE 1.0 END AS probability FROM d JOIN f ON f.source = d.source AND f.lang = d.lang AND f.topic = d.topic)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic AS {STAND_IN}, tokens, probability, CAST('0x' || substring(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept FROM p"


SQL = _sql()
