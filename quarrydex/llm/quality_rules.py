"""Operator 13: rules of quality for documents, and for the hosts they come from.

Every document is measured by DataFrame functions; the failures of each rule are
aggregated by host, the hosts' rates are shrunk towards the corpus with a beta
prior fitted to the hosts themselves, and the verdicts on hosts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Places of words below the hash in a sort key.
PLACE_BITS = 31
PLACES = (1 << PLACE_BITS) - 1
#: Share of a host's documents that fail a rule beyond which the host is rejected, and standard deviations to be sure by.
MOST_FAILING, SURE = 0.5, 2.0
#: Documents that the prior counts for, at least and at most.
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Parts that the documents of one host are dealt to where verdicts meet them.
SALTS = 32


def _at(a: str, i: Column) -> Column:
    return F.get(F.col(a), i)


def measures(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: one row per row of ``docs``.

    Words are the runs of ``[^\\x20\\x09-\\x0D]``; a null or empty text has none, and all figures 0.  n_lines counts the
    lines with a word, n_dup_lines those equal to an earlier one, n_repeat_words the words in three-word windows found twice
    or more in the text.  That is settled in the document's own row, without a shuffle: one sort of longs (a hash of the window
    above its place), then a sort of the whole windows that share a hash with another.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # each step names what the next one looks at more than once, so that no lambda computes it again for every element
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "host", F.octet_length(F.regexp_replace("text", SYMBOLS, "")).alias("n_symbols"), words.alias("words"), lines.alias("lines"))
    key = lambda w, i: F.xxhash64(w, _at("words", i + 1), _at("words", i + 2)).bitwiseAND(~PLACES).bitwiseOR(i.cast("bigint"))
    rows = rows.select(
        "doc_id",
        "host",
        F.size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "words",
        F.sort_array(F.slice(F.transform("words", key), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))).alias("keys"),
    )
    # windows whose neighbours in the order of keys have the same hash are compared as strings
    figures = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    met = lambda k, other: F.shiftrightunsigned(k, PLACE_BITS) == F.shiftrightunsigned(other, PLACE_BITS)
    likely = F.filter("keys", lambda k, j: F.coalesce(met(k, _at("keys", j - 1)), F.lit(False)) | F.coalesce(met(k, _at("keys", j + 1)), F.lit(False)))
    window = lambda i: F.concat_ws(" ", _at("words", i), _at("words", i + 1), _at("words", i + 2))
    placed = F.transform(likely, lambda k: F.struct(window(k.bitwiseAND(PLACES).cast("int")).alias("w"), k.bitwiseAND(PLACES).cast("int").alias("i")))
    rows = rows.select(*figures, F.sort_array(placed).alias("placed"))
    again = lambda x, k: (x["w"] == _at("placed", k - 1)["w"]) | (x["w"] == _at("placed", k + 1)["w"])
    starts = F.filter(F.transform("placed", lambda x, k: F.when(again(x, k), x["i"])), lambda i: i.isNotNull())
    rows = rows.select(*figures, F.sort_array(starts).alias("starts"))
    covered = F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(_at("starts", k + 1) - s, F.lit(3))))
    covered = F.when(F.size("starts") > 0, F.aggregate(covered, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return rows.select("doc_id", "host", *[F.col(c).cast("bigint").alias(c) for c in figures[2:]], covered.cast("bigint").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """Failures of a document, over the columns of ``measures``: none of them is ever null."""
    n = F.col("n_words")
    return {
        "base": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n),
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def host_verdicts(measured: DataFrame, failing: dict[str, Column] | None = None, most: float = MOST_FAILING, sure: float = SURE) -> DataFrame:
    """host, rule, n, failures, rate, low, corpus, rejected: a row for each host and rule.

    ``measured`` has a row per document with ``host`` and what the rules look at.  For each rule the rates of all hosts give
    a beta prior by moments: its mean is the corpus's rate, its strength follows from how much more the hosts differ than
    their sizes explain (between 1 and 10,000 documents).  A rule rejects a host if the shrunk rate, less ``sure`` posterior
    deviations (``low``), is above both ``most`` and the corpus's rate: a small host needs more evidence, and hosts that are
    all alike are never rejected.  Rows without a host belong to none.  No rows, no hosts.
    """
    failing = rules() if failing is None else failing
    counted = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(k) for k, x in failing.items()])
    long = counted.select("host", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failures")) for k in failing])).alias("x")).select("host", "n", "x.*")
    share = F.col("failures") / F.col("n")
    moments = long.groupBy("rule").agg((F.sum("failures") / F.sum("n")).alias("corpus"), F.var_pop(share).alias("spread"), F.avg(F.lit(1.0) / F.col("n")).alias("inverse"))
    noise = F.col("corpus") * (1 - F.col("corpus"))
    between = F.col("spread") - noise * F.col("inverse")
    strength = F.when(between > 0, F.greatest(F.least(noise / between - 1, F.lit(STRONGEST)), F.lit(WEAKEST))).otherwise(STRONGEST)
    prior = moments.select("rule", "corpus", strength.alias("strength"))
    shrunk = long.join(prior, "rule").withColumn("rate", (F.col("failures") + F.col("corpus") * F.col("strength")) / (F.col("n") + F.col("strength")))
    shrunk = shrunk.withColumn("low", F.col("rate") - sure * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1)))
    return shrunk.select("host", "rule", "n", "failures", "rate", "low", "corpus", ((F.col("low") > most) & (F.col("low") > F.col("corpus"))).alias("rejected"))


def quality_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", most: float = MOST_FAILING, sure: float = SURE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected: one row per row of ``docs``.

    A document stays unless it fails the base rule itself or its host is rejected (``host_verdicts``); one whose host is null
    is judged by itself alone.  Repeated rows count each, an empty table gives an empty result, other columns are ignored.
    The measures, some sixty bytes a document, are written once: hosts are counted from them and verdicts meet them, salted,
    so that the documents of one host are no single task.
    """
    own = cut(measures(docs, host_col, id_col, text_col), "quality-rules")
    own = own.withColumn("base_failed", rules()["base"])
    rejected = host_verdicts(own, most=most, sure=sure).where("rejected").select("host").distinct()
    bad = rejected.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("host_rejected"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int"))
    judged = salted.join(bad, ["host", "salt"], "left").fillna(False, ["host_rejected"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, null if it has none: the ``host_col`` of pages."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


_RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def _bound(k: str) -> str:
    strength = f"CASE WHEN v_{k} - m_{k} * (1 - m_{k}) * inv > 0 THEN greatest(least(m_{k} * (1 - m_{k}) / (v_{k} - m_{k} * (1 - m_{k}) * inv) - 1, 10000.0), 1.0) ELSE 10000.0 END"
    return f"SELECT host, m, (r - 2 * sqrt(r * (1 - r) / (n + s + 1))) AS l FROM (SELECT host, n, s, m, (f + m * s) / (n + s) AS r FROM (SELECT host, n, f_{k} AS f, m_{k} AS m, {strength} AS s FROM h, mo))"


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
b AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.rid = d.rid),
h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {x}) AS f_{k}" for k, x in _RULES.items())} FROM b WHERE host IS NOT NULL GROUP BY host),
mo AS (SELECT avg(1.0 / n) AS inv, {", ".join(f"sum(f_{k}) / sum(n) AS m_{k}, var_pop(f_{k} / n) AS v_{k}" for k in _RULES)} FROM h),
bad AS (SELECT DISTINCT host FROM ({" UNION ALL ".join(_bound(k) for k in _RULES)}) WHERE l > 0.5 AND l > m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["base"]}) AS base_failed,
       NOT ({_RULES["base"]}) AND bad.host IS NULL AS kept, bad.host IS NOT NULL AS host_rejected
FROM b LEFT JOIN bad ON bad.host = b.host
"""
