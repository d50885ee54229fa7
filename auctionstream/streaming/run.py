"""Running a stream over what is available now and reading its result back as a table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from auctionstream.session import work_folder
from auctionstream.sources.sinks import read_upserts, write_upserts

NOW = {"availableNow": True}


def finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_append(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Final rows, written once to Parquet files in the shared folder."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "append")
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(**NOW).start()
    )
    finish(query)
    return plain_times(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))


def run_update(stream: DataFrame, keys: list[str], folder: str | None = None, order: list[str] = []) -> DataFrame:
    """Updated rows of every micro-batch; the newest row per key, the greatest in ``order``, is the result."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "update")
    finish(write_upserts(stream, f"{folder}/rows", f"{folder}/checkpoint", keys, order=order, **NOW))
    return plain_times(read_upserts(spark, f"{folder}/rows", stream.schema, keys))


def run_updating(stream: DataFrame, result, folder: str) -> DataFrame:
    """An updating result (streaming.updating) after all micro-batches. Any output mode that lets rows pass once does."""
    writer = stream.writeStream.foreachBatch(result.apply).outputMode("append")
    finish(writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**NOW).start())
    return plain_times(result.read())


def plain_times(df: DataFrame) -> DataFrame:
    """Event times without zone again, as the tables have them."""
    times = {c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"}
    return df.withColumns(times) if times else df


def stream_files(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def replayed(rows: DataFrame, time: str = "dateTime", parts: int = 4, files: int = 4) -> DataFrame:
    """The rows of a table as a stream that takes them in several micro-batches, in order of time.

    They are written to the shared folder part by part, each a span of time with about as many rows. Rows
    without a time come first.
    """
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "replayed")
    micros = F.unix_micros(time)
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.select(micros.alias("t")).approxQuantile("t", shares, 0.01)
    lows, highs = [None, *bounds], [*bounds, None]
    for low, high in zip(lows, highs):
        after = F.lit(True) if low is None else micros > low
        upto = F.lit(True) if high is None else micros <= high
        if low is None:
            upto = upto | F.col(time).isNull()
        rows.where(after & upto).repartition(files).write.mode("append").parquet(path)
    return stream_files(spark, path, rows.schema, files)
