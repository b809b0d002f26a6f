"""Tables that change in place, as versions: a change writes the touched buckets anew and counts once
its entry is there.

Under a table's folder lie ``data/<write>/_bucket=<n>``, rows by a hash of their key, and
``versions/version=<n>``, one small file that names the folder of each bucket. That file's rename is the
commit: a write that is killed before it leaves the version before, and its files are cleared by
``vacuum``. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from comanda.session import written
from comanda.streaming.incremental import latest

_ENTRY = "bucket int, path string, about string"
Fold = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Head:
    """A version: the folder of each bucket that has rows, and the mark of the last batch in it."""

    version: int
    paths: dict[int, str]
    schema: StructType
    key: tuple[str, ...]
    buckets: int
    mark: int | None = None


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64) -> Table:
        """The table in ``folder``, made empty where there is none. ``buckets`` should grow with the
        table, about one for each GB; a change rewrites those that it touches."""
        table = cls(spark, folder)
        if not table.versions():
            table._commit(Head(0, {}, StructType.fromDDL(schema), tuple(key), buckets))
        return table

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(f"{_ENTRY}, version int").parquet(f"{self.folder}/versions")

    def versions(self) -> list[int]:
        try:
            return sorted(r.version for r in self._entries().filter("bucket is null").select("version").collect())  # one row a version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def head(self, version: int | None = None) -> Head:
        known = self.versions()
        at = known[-1] if version is None and known else version
        if at not in known:
            raise ValueError(f"no version {version} of {self.folder}")
        rows = self._entries().filter(F.col("version") == at).collect()  # as many as buckets
        about = json.loads(next(r.about for r in rows if r.bucket is None))
        return Head(at, {r.bucket: r.path for r in rows if r.bucket is not None}, StructType.fromJson(about["schema"]), tuple(about["key"]), about["buckets"], about["mark"])

    def _commit(self, head: Head) -> None:
        about = json.dumps({"schema": head.schema.jsonValue(), "key": head.key, "buckets": head.buckets, "mark": head.mark})
        rows = [(None, None, about), *[(b, p, None) for b, p in sorted(head.paths.items())]]
        self.spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/version={head.version}")

    def _rows(self, spark: SparkSession, head: Head, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in head.paths.items() if buckets is None or b in buckets]
        return spark.read.schema(head.schema).parquet(*paths) if paths else spark.createDataFrame([], head.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows at a version that was not cleared; at the last one without."""
        return self._rows(self.spark, self.head(version))

    @staticmethod
    def _bucket(head: Head) -> Column:
        return F.pmod(F.xxhash64(*head.key), F.lit(head.buckets)).cast("int")

    def _touched(self, rows: DataFrame, head: Head) -> list[int]:
        return [r.b for r in rows.select(self._bucket(head).alias("b")).distinct().collect()]  # buckets at most

    def near(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets of the keys in ``rows``: all with such a key, and others."""
        head = self.head()
        return self._rows(rows.sparkSession, head, self._touched(rows, head))

    def change(self, changes: DataFrame, fold: Fold, mark: int | None = None) -> int:
        """The version after ``fold(rows of the touched buckets, changes)``, which gives those buckets'
        new rows. With a mark that the table has passed nothing happens, so a batch may come again."""
        head, spark = self.head(), changes.sparkSession
        if mark is not None and head.mark is not None and mark <= head.mark:
            return head.version
        changes = written(changes, "changes", "zstd")
        touched = self._touched(changes, head)
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows = fold(self._rows(spark, head, touched), changes).select(*head.schema.names).withColumn("_bucket", self._bucket(head))
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path, compression="zstd")
        made = spark.read.schema("_bucket int").parquet(path)
        new = {r["_bucket"]: f"{path}/_bucket={r['_bucket']}" for r in made.select("_bucket").distinct().collect()}
        kept = {b: p for b, p in head.paths.items() if b not in touched}
        self._commit(replace(head, version=head.version + 1, paths=kept | new, mark=head.mark if mark is None else mark))
        return head.version + 1

    def upsert(self, changes: DataFrame, version: str, mark: int | None = None) -> int:
        """Puts rows in; of one key the row of the highest ``version`` stays, wherever it was."""
        key = list(self.head().key)
        return self.change(latest(changes, key, version), lambda old, new: latest(old.unionByName(new.select(*old.columns)), key, version), mark)

    def vacuum(self, keep: int = 1) -> None:
        """Clears all but the last ``keep`` versions, and the files that none of these names, such as a
        killed write's."""
        known = self.versions()
        heads = [self.head(v) for v in known[-keep:]]
        used = {p.rsplit("/", 2)[1] for h in heads for p in h.paths.values()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in known[:-keep]:
            fs.delete(hadoop(f"{self.folder}/versions/version={v}"), True)
        data = hadoop(f"{self.folder}/data")
        for write in fs.listStatus(data) if fs.exists(data) else ():
            if write.getPath().getName() not in used:
                fs.delete(write.getPath(), True)


def upsert_stream(source: DataFrame, table: Table, version: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a version of ``table``; its mark is the batch's number, so a batch that is tried
    again changes nothing. One stream to a table."""
    write = lambda batch, number: table.upsert(batch, version, number)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
