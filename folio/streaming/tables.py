"""A keyed table that batches change in place: rows lie in buckets by key, and a batch rewrites only buckets it touches.

Each batch writes its buckets under its own version and then a small manifest that names the version of every bucket.
A batch that is repeated after a failure writes the same version again; readers see a batch when its manifest is there.
Buckets that neither of the last two manifests names are deleted, so neither old generations nor manifests pile up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triage import upsert_latest

BUCKET = "__bucket"


class KeyedTable:
    """Rows by a unique key under a folder that all executors share.

    buckets is fixed for a table's life: enough of them that one holds what a task can rewrite.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema

    # Folders: <path>/rows/version=V/__bucket=B and <path>/manifests/version=V.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        """Of committed manifests, falling."""
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        done = [m for s in fs.listStatus(folder) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName())) and self._exists(f"{self.path}/manifests/{m[0]}/_SUCCESS")]
        return sorted((int(m[1]) for m in done), reverse=True)

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifests/version={version}").collect()
        return {r.bucket: r.version for r in rows}

    def current(self, before: int | None = None) -> dict[int, int]:
        """bucket -> version, as of the newest manifest (of a version below `before`)."""
        known = [v for v in self._versions() if before is None or v < before]
        return self._manifest(known[0]) if known else {}

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/{BUCKET}={b}" for b, v in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of now. Take a new one after each batch: later batches may delete what an old one reads."""
        return self._read(self.current())

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rewrite(self, version: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the rows of the buckets that hold the keys by what `change` makes of them; returns the buckets' number.

        The driver learns the touched buckets and nothing else. change gets all rows of these buckets and returns rows of
        the same schema whose keys belong to them.
        """
        touched = [r.b for r in keys.select(self.bucket_of(F.col(self.key)).alias("b")).filter("b is not null").distinct().collect()]
        places = self.current(before=version)
        if touched:
            rows = change(self._read({b: places[b] for b in touched if b in places}))
            dealt = rows.withColumn(BUCKET, self.bucket_of(F.col(self.key))).repartition(len(touched), BUCKET)
            dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows/version={version}")
        for b in touched:
            places.pop(b, None)
            if self._exists(f"{self.path}/rows/version={version}/{BUCKET}={b}"):
                places[b] = version
        manifest = self.spark.createDataFrame(sorted(places.items()), "bucket int, version long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        self._retire()
        return len(touched)

    def _retire(self) -> None:
        versions = self._versions()
        named = {(b, v) for m in versions[:2] for b, v in self._manifest(m).items()}
        for v in versions[2:]:
            fs, p = self._fs(f"{self.path}/manifests/version={v}")
            fs.delete(p, True)
        fs, folder = self._fs(f"{self.path}/rows")
        for s in fs.listStatus(folder) if fs.exists(folder) else ():
            v = int(s.getPath().getName().removeprefix("version="))
            for b in fs.listStatus(s.getPath()):
                name = b.getPath().getName()
                if name.startswith(BUCKET) and v <= versions[0] and (int(name.removeprefix(f"{BUCKET}=")), v) not in named:
                    fs.delete(b.getPath(), True)

    def upsert(self, version: int, changes: DataFrame, order: str) -> int:
        """The latest row per key by `order`; keys that are new are added. Changes without a key are left out."""
        changes = changes.filter(F.col(self.key).isNotNull())
        return self.rewrite(version, changes, lambda old: upsert_latest(old, upsert_latest(changes.limit(0), changes, self.key, order), self.key, order).select(*old.columns))

    def update(self, version: int, changes: DataFrame, columns: list[str]) -> int:
        """Columns of rows that are still there; a change for a row that was deleted meanwhile is lost, as it should."""
        new = changes.select(self.key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__changed"))
        pick = lambda c: F.when(F.col("__changed"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        return self.rewrite(version, changes, lambda old: old.join(new, self.key, "left").select(*[pick(c) for c in old.columns]))

    def delete(self, version: int, keys: DataFrame) -> int:
        return self.rewrite(version, keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti").select(*old.columns))

    def clear(self, version: int) -> None:
        """No rows from this version on; the rows of the version before stay readable until the next batch."""
        self.spark.createDataFrame([], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        self._retire()


def upsert_batches(df: DataFrame, table: KeyedTable, order: str, checkpoint: str):
    """Start a query that upserts each micro-batch of a stream; returns the query."""

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(number, batch, order)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
