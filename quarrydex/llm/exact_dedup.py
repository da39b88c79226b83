"""Operator 4: exact duplicates by sorting the contents.

Sampled splitters deal the normalised texts out by ranges, each range is sorted
externally so that equal texts become neighbours, and a window compares whole
neighbouring texts.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Characters that normalisation deletes.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Code points of the normalised text that lead the sort key; the splitters kept on the driver stay this short.
HEAD = 24
#: Parts that one group of equal texts is dealt into at most.
SALTS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
    a null text counts as empty, so null, empty and blank texts are one group.  Of each group the row
    with the most code points stays, then the smallest id (null ids last).  Of rows that agree in id
    and length too, exactly one is kept.  Columns other than the two named are ignored; an empty table
    gives an empty result.

    The range key is (first code points, hash, salt): equal texts stay adjacent, while ``salt`` lets a
    group with a large share of all rows span many ranges.  The winners of the parts of a group, ``salts``
    rows at most, then meet by SHA-256.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("points"), F.regexp_replace(text, BLANKS, "").alias("norm"))
        .withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
        .repartitionByRange("head", "hash", "salt")
    )
    best = [F.desc("points"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("head", "hash", "salt", "norm").orderBy(*best)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = cut(
        rows.withColumns({"nth": F.row_number().over(part), "part_size": F.count(F.lit(1)).over(whole)}).select(
            "doc_id", "points", "salt", "nth", "part_size", F.sha2("norm", 256).alias("text_sha256")
        ),
        "exact-dedup",
    )
    group = Window.partitionBy("text_sha256").orderBy(*best, "salt")
    all_parts = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    winners = parts.where("nth = 1").select(
        "text_sha256",
        "salt",
        F.first("doc_id").over(all_parts).alias("keep_id"),
        F.sum("part_size").over(all_parts).alias("group_size"),
        (F.row_number().over(group) == 1).alias("wins"),
    )
    return parts.join(winners, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("wins")).alias("kept"), "text_sha256"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM d)
"""
