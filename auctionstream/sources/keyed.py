"""Keyed tables that a stream changes: rows cut into buckets by a hash of their keys, one version per micro-batch.

A micro-batch rewrites the buckets that its keys fall into, as new files, and then names them in a new manifest that
appears by one rename. A reader takes the newest manifest and meets complete files only; files that no manifest
of the last ``retain`` names are removed. A batch that is run again finds its manifest and changes nothing, so what is
derived from two versions can be derived again after a failure.
"""

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from auctionstream.operators.topn import top_n

BUCKET = "__bucket"
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``keys`` decide the bucket. With ``buckets`` too few, a bucket is more than a task should rewrite; the number stays
    fixed for the life of the table. One writer, any number of readers."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 8,
        retain: datetime.timedelta = datetime.timedelta(hours=1),
    ):
        self.spark, self.path, self.keys, self.buckets, self.retain = spark, path.rstrip("/"), keys, buckets, retain
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests: bucket -> folder that holds its rows ---------------------------------------

    def versions(self) -> list[int]:
        """The micro-batches whose state can be read, oldest first. Names only."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        names = [x.getPath().getName() for x in found]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if version is None and not found:
            return {"folders": {}, "touched": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/versions/{found[-1] if version is None else version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        draft = self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._hadoop.Path(f"{self.path}/versions/{version:020d}.json")
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(draft, final) and not self._fs.exists(final):
            raise OSError(f"version {version} of {self.path} could not be named")

    def _clean(self) -> None:
        """Remove versions that were replaced longer than ``retain`` ago, and folders that only they name."""
        found = self.versions()
        oldest = int((datetime.datetime.now() - self.retain).timestamp() * 1000)

        def path(version: int):
            return self._hadoop.Path(f"{self.path}/versions/{version:020d}.json")

        # A version is in use until the next one appears.
        stale = [a for a, b in zip(found, found[1:]) if self._fs.getFileStatus(path(b)).getModificationTime() < oldest]
        if not stale:
            return
        used = {f for v in found if v not in stale for f in self._manifest(v)["folders"].values()}
        gone = {f for v in stale for f in self._manifest(v)["folders"].values()} - used
        for version in stale:
            self._fs.delete(path(version), False)
        for folder in gone:
            self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)

    # ---- rows ----------------------------------------------------------------------------------

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        chosen = {b: f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets}
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in chosen.values()])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as a micro-batch left them, the last one if none is named."""
        return self._rows(self._manifest(version))

    def touched(self, version: int, before: bool = False) -> DataFrame:
        """The rows of the buckets that a micro-batch has rewritten; ``before``: those it found there."""
        manifest = self._manifest(version)
        if not before:
            return self._rows(manifest, manifest["touched"])
        earlier = [v for v in self.versions() if v < version]
        return self._rows(self._manifest(earlier[-1]) if earlier else {"folders": {}}, manifest["touched"])

    def merge(self, version: int, changes: DataFrame, combine: Combine) -> None:
        """Rewrite the touched buckets: ``combine`` makes their new rows from their old ones and the changes.

        The changes are computed once, and written by bucket, so that the buckets are known by name.
        """
        if version in self.versions()[-1:]:
            return
        base = self._manifest()
        folder = f"data/{version}-{uuid.uuid4().hex}"
        incoming = f"{self.path}/incoming/{folder}"
        dealt = self._dealt(changes)
        dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(incoming)
        touched = self._written(incoming)
        folders = {b: f for b, f in base["folders"].items() if int(b) not in touched}
        if touched:
            arrived = self.spark.read.schema(dealt.schema).parquet(*[f"{incoming}/{BUCKET}={b}" for b in touched]).drop(BUCKET)
            new = combine(self._rows(base, touched), arrived).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            self._dealt(new).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            folders |= {str(b): f"{folder}/{BUCKET}={b}" for b in self._written(f"{self.path}/{folder}")}
        self._commit(version, {"folders": folders, "touched": touched})
        self._fs.delete(self._hadoop.Path(incoming), True)
        self._clean()

    def _written(self, folder: str) -> list[int]:
        found = self._fs.globStatus(self._hadoop.Path(f"{folder}/{BUCKET}=*")) or []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in found)


# ---- the newest row per key ---------------------------------------------------------------------

DELETED = "__deleted"


def upsert_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], **options) -> KeyedTable:
    """A table for ``upsert``: the stream's columns and whether the key was deleted."""
    return KeyedTable(spark, path, StructType(list(schema)).add(DELETED, "boolean"), keys, **options)


def upsert(table: KeyedTable, version: int, changes: DataFrame, order: list[str] = [], deleted: str | None = None) -> None:
    """Keep the newest row of every key: the greatest in ``order``, among equals the newer batch's.

    A row whose ``deleted`` column is true deletes its key. It stays as a tombstone, so an older row that arrives later
    does not bring the key back; a row newer than the tombstone does.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        return top_n(both, table.keys, [F.col(c).desc_nulls_last() for c in (*order, "__new")], 1).drop("__new")

    columns = [f.name for f in table.schema if f.name != DELETED]
    table.merge(version, changes.withColumn(DELETED, gone).select(*columns, DELETED), newest)


def current(table: KeyedTable, version: int | None = None) -> DataFrame:
    """The rows of a table of upserts whose keys are not deleted."""
    return table.read(version).where(f"NOT {DELETED}").drop(DELETED)
