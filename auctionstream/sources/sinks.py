"""Discarding, partitioned, multi-target and keyed outputs."""

import datetime
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from auctionstream import schemas
from auctionstream.sources import keyed

CSV_TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSS"}
BATCH = "batch_id"


def discard(df: DataFrame) -> None:
    """Compute everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


# ---- log partitioned by day and minute ---------------------------------------------------------


def write_log(log: DataFrame, path: str) -> None:
    """CSV files below dt=…/hm=…, then a success file in every partition.

    The rebalance hint lets AQE join small partitions and split hot ones before files are written.
    """
    log.hint("rebalance", "dt", "hm").write.mode("overwrite").partitionBy("dt", "hm").options(**CSV_TIMES).csv(path)
    commit_partitions(log.sparkSession, path)


def write_log_stream(
    log: DataFrame, path: str, checkpoint: str, delay: datetime.timedelta = datetime.timedelta(minutes=1), **trigger
):
    """The same log from a watermarked stream, exactly once.

    While it runs, a partition is committed once the watermark has passed its minute by ``delay``. Rows that
    come later still go to their partition, as files after its success file.
    """
    committer = LogCommitter(log.sparkSession, path, delay)
    log.sparkSession.streams.addListener(committer)
    query = (
        log.writeStream.format("csv").options(**CSV_TIMES).partitionBy("dt", "hm")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
    committer.query = str(query.id)
    return query


class LogCommitter(StreamingQueryListener):
    """Commits the partitions of a log as the watermark of the query that writes it advances."""

    def __init__(self, spark: SparkSession, path: str, delay: datetime.timedelta):
        self.spark, self.path, self.delay = spark, path, delay
        self.query, self.reached = None, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.query not in (None, str(progress.id)) or "watermark" not in progress.eventTime:
            return
        watermark = datetime.datetime.strptime(progress.eventTime["watermark"][:19], "%Y-%m-%dT%H:%M:%S")
        if watermark.year > 1970 and (self.reached is None or watermark > self.reached):
            # Without a time reached, as after a restart, all days are looked at once.
            commit_partitions(self.spark, self.path, watermark, self.delay, self.reached)
            self.reached = watermark

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.spark.streams.removeListener(self)


def commit_partitions(
    spark: SparkSession, path: str, watermark: datetime.datetime | None = None,
    delay: datetime.timedelta = datetime.timedelta(minutes=1), since: datetime.datetime | None = None,
) -> list[str]:
    """Write a success file into the partitions whose time the watermark has passed by the delay.

    Without a watermark the input is complete and all partitions are committed. With ``since``, the watermark
    of the last call, only the days between the two are listed. Handles names only: one entry per partition
    directory, no rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = ["*"]
    if watermark and since:
        first = (since - delay).date()
        days = [str(first + datetime.timedelta(days=n)) for n in range((watermark.date() - first).days + 1)]
    done = []
    for status in [x for day in days for x in fs.globStatus(hadoop.Path(root, f"dt={day}/hm=*")) or []]:
        folder = status.getPath()
        day, minute = (unquote(p.getName().split("=", 1)[1]) for p in (folder.getParent(), folder))
        start = datetime.datetime.strptime(f"{day} {minute}", "%Y-%m-%d %H:%M")
        marker = hadoop.Path(folder, "_SUCCESS")
        if (watermark is None or watermark >= start + delay) and not fs.exists(marker):
            fs.create(marker).close()
            done.append(f"{day} {minute}")
    return done


def read_log(spark: SparkSession, path: str, log_schema) -> DataFrame:
    reader = spark.read.schema(log_schema).options(**CSV_TIMES)
    return reader.option("basePath", path).csv(path)


# ---- several targets ---------------------------------------------------------------------------


def write_many(targets: dict[str, DataFrame]) -> None:
    """One write per target; each reads only the columns and rows it needs."""
    for path, df in targets.items():
        df.write.mode("overwrite").parquet(path)


def write_many_stream(
    stream: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, **trigger
):
    """Every micro-batch is computed once and written to all targets.

    A batch that is run again replaces its own folder, so each target holds every row once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for path, part in targets.items():
                part(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


# ---- keyed upserts -----------------------------------------------------------------------------


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", per_batch=None, **trigger):
    """The output of every micro-batch in a folder of its own, optionally reduced first."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_upserts(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "update", order: list[str] = [],
    deleted: str | None = None, buckets: int = 8, **trigger
):
    """A keyed table of a stream (sources.keyed): the newest row per key, without the keys whose newest row is a deletion.

    ``order`` says which of two rows is newer; without it, or among equals, the one of the later micro-batch. Storage and
    reading depend on the number of keys, not on that of batches.
    """
    table = _upserts(stream.sparkSession, path, stream.schema, keys, buckets, deleted)

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(table, batch_id, batch, order, deleted)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_upserts(
    spark: SparkSession, path: str, schema, keys: list[str], buckets: int = 8, deleted: str | None = None, version: int | None = None
) -> DataFrame:
    """The rows of the table, as of a micro-batch if one is named. The schema is the stream's."""
    return keyed.current(_upserts(spark, path, schema, keys, buckets, deleted), version)


def _upserts(spark: SparkSession, path: str, schema, keys: list[str], buckets: int, deleted: str | None):
    columns = schemas.StructType([f for f in schema if f.name != deleted])
    return keyed.upsert_table(spark, path, columns, keys, buckets=buckets)
