"""A stored table in buckets of its key: an upsert writes the buckets it touches, and readers see whole versions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.registry import latest, upsert
from .files import exists

BUCKETS = 64


@dataclass
class BucketTable:
    """A table under ``path``.  ``versions`` says which version holds each bucket; ``version`` is the one that was opened.

    The rows of bucket b as of version v are in ``data/v=v/bucket=b``, and ``manifest/v`` lists where every bucket is.  A writer
    writes data first and the manifest last, so a writer that is lost leaves nothing that readers see, and of two writers that
    began from the same version the second one fails.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    schema: StructType
    version: int
    versions: dict[int, int]
    by: list[str]
    batch: int = -1

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, by: list[str] | None = None) -> BucketTable:
        """Write ``rows``, of equal keys one (any of them; make them unique by ``registry.latest`` where it matters).

        ``by``, some of the keys, deals rows to buckets; all of them do if it isn't given.
        """
        table = cls(rows.sparkSession, path, keys, buckets, rows.schema, -1, {}, keys if by is None else by)
        return table._commit(rows.dropDuplicates(keys))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> BucketTable:
        """The newest version, or an older one as it was."""
        if version is None:
            version = 0
            while exists(spark, f"{path}/manifest/{version + 1}/_SUCCESS"):
                version += 1
        r = spark.read.parquet(f"{path}/manifest/{version}").first()
        return cls(spark, path, list(r["keys"]), r.buckets, StructType.fromJson(json.loads(r.stored)), version, dict(r.versions), list(r.by), r.batch)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _read(self, buckets) -> DataFrame:
        paths = [f"{self.path}/data/v={self.versions[b]}/bucket={b}" for b in sorted(set(buckets) & set(self.versions))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.versions)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with the given keys, or values of ``by``: only their buckets are read."""
        columns = [c for c in self.keys if c in keys.columns]
        wanted = keys.select(*columns).distinct()
        return self._read(self._touched(wanted)).join(wanted, columns, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets

    def upsert(self, new: DataFrame, order: list[Column] | None = None, stored_too: bool = False, batch: int | None = None) -> BucketTable:
        """The next version, with ``new`` rows in place of those of equal keys; of several new ones the first by ``order`` counts.

        With ``stored_too`` a stored row takes part in that, so an older new one doesn't replace it.  Columns that ``new`` lacks
        are null, those that the table lacks are left out.  Null keys are rows of their own.  A ``batch`` that this version has
        seen already changes nothing.
        """
        if batch is not None and batch <= self.batch:
            return self
        touched = self._touched(new)
        old = self._read(touched)
        if stored_too:
            rows = latest(old.unionByName(new, allowMissingColumns=True), self.keys, order)
        else:
            rows = upsert(old, latest(new, self.keys, order) if order else new, self.keys)
        return self._commit(rows.select(*self.schema.names), touched, batch)

    def delete(self, keys: DataFrame) -> BucketTable:
        """The next version without the rows of these keys."""
        touched = self._touched(keys)
        return self._commit(self._read(touched).join(keys.select(*self.keys).distinct(), self.keys, "left_anti"), touched)

    def _commit(self, rows: DataFrame, touched: list[int] | None = None, batch: int | None = None) -> BucketTable:
        batch = self.batch if batch is None else batch
        version, data = self.version + 1, f"{self.path}/data"
        if touched is None or touched:
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{data}/v={version}")
        # a bucket that has no row left has no folder
        filled = [b for b in (range(self.buckets) if touched is None else touched) if exists(self.spark, f"{data}/v={version}/bucket={b}")]
        gone = set(self.versions if touched is None else touched)
        versions = {b: v for b, v in self.versions.items() if b not in gone} | {b: version for b in filled}
        row = [(self.keys, self.buckets, self.schema.json(), versions, self.by, batch)]
        self.spark.createDataFrame(row, "keys array<string>, buckets int, stored string, versions map<int,int>, by array<string>, batch bigint").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/{version}")
        return BucketTable(self.spark, self.path, self.keys, self.buckets, self.schema, version, versions, self.by, batch)
