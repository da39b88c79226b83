"""Fuzzy search of names over an index of deletions: words within an edit distance share a word that both become by deletions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Longer words have too many deletions: they are kept under one key for each length and compared.
LONGEST = 32
PARTS = 64


def _one_less(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def deletions(word: Column, distance: int) -> Column:
    """The word and what it becomes by up to ``distance`` (0, 1 or 2) deletions, each once; for a long word a key of its length."""
    out = F.array(word)
    less = F.when(F.char_length(word) > 0, _one_less(word)).otherwise(F.array().cast("array<string>"))
    if distance >= 1:
        out = F.concat(out, less)
    if distance >= 2:
        out = F.concat(out, F.flatten(F.transform(F.array_distinct(less), lambda w: F.when(F.char_length(w) > 0, _one_less(w)).otherwise(F.array().cast("array<string>")))))
    return F.when(F.char_length(word) > LONGEST, F.array(F.concat(F.lit("~"), F.char_length(word).cast("string")))).otherwise(F.array_distinct(out))


def query_keys(word: str, distance: int) -> list[str]:
    """The keys under which a word within the distance of a query is found."""
    keys = {f"~{n}" for n in range(max(LONGEST + 1, len(word) - distance), len(word) + distance + 1)}
    if len(word) <= LONGEST + distance:
        for k in range(min(distance, len(word)) + 1):
            keys |= {"".join(word[i] for i in range(len(word)) if i not in gone) for gone in map(set, combinations(range(len(word)), k))}
    return sorted(keys)


@dataclass
class FuzzyNames:
    """``keys`` (key, word) of every word of the names, ``words`` (word, file_id, name)."""

    spark: SparkSession
    path: str
    distance: int

    @classmethod
    def build(cls, files: DataFrame, path: str, distance: int = 2, name: str = "name", id_col: str = "file_id") -> FuzzyNames:
        """Write the index of ``files`` for distances up to ``distance``, 2 at most.  A null name has no words."""
        if not 0 <= distance <= 2:
            raise ValueError("distance must be 0, 1 or 2")
        own = files.select(F.col(id_col).alias("file_id"), F.col(name).alias("name"), F.explode(F.array_distinct(tokens(F.col(name)))).alias("word"))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")
        salt = F.pmod(F.xxhash64("file_id"), F.lit(16))  # a word that most names have is several files
        own.select("*", part("word")).repartition("part", salt).sortWithinPartitions("part", "word").write.partitionBy("part").parquet(f"{path}/words")
        keys = own.select("word").distinct().select("word", F.explode(deletions(F.col("word"), distance)).alias("key"))
        keys.select("key", "word", part("key")).repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(f"{path}/keys")
        files.select(F.col(id_col).alias("file_id")).limit(0).write.parquet(f"{path}/kind")
        return cls(files.sparkSession, path, distance)

    def _of(self, table: DataFrame, column: str, values: list[str]) -> DataFrame:
        parts = F.col("part").isin(*[F.pmod(F.xxhash64(F.lit(v)), F.lit(PARTS)).cast("int") for v in values])
        return table.where(parts & F.col(column).isin(values)).drop("part")

    def matching(self, query: str, distance: int) -> DataFrame:
        """word, distance of the indexed words within the distance of a query's word."""
        keys = self.spark.read.schema("key string, word string, part int").parquet(f"{self.path}/keys")
        found = self._of(keys, "key", query_keys(query.lower(), distance)).select("word").distinct()
        return found.withColumn("distance", F.levenshtein(F.col("word"), F.lit(query.lower()))).where(F.col("distance") <= distance)

    def search(self, query: str, distance: int = 2) -> DataFrame:
        """file_id, name, distance of names with a word within the distance of the query: those of ``search.fuzzy_names``, without looking at other names."""
        if distance > self.distance:
            raise ValueError(f"the index has distances up to {self.distance}")
        kind = self.spark.read.parquet(f"{self.path}/kind").schema["file_id"].dataType.simpleString()
        words = self.spark.read.schema(f"file_id {kind}, name string, word string, part int").parquet(f"{self.path}/words")
        near = self.matching(query, distance).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int"))
        hits = words.join(near, ["part", "word"])
        return hits.groupBy("file_id", "name").agg(F.min("distance").alias("distance"))
