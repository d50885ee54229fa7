"""JSON topics: the codec between events and (key, value) rows, and the connector options around it.

The codec works on any DataFrame with the right columns; the connector needs Spark's Kafka package.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from auctionstream import schemas


def union_of(person: DataFrame, auction: DataFrame, bid: DataFrame) -> DataFrame:
    """Flat tables as rows of the union event."""
    flat = {"person": (person, schemas.PERSON), "auction": (auction, schemas.AUCTION), "bid": (bid, schemas.UNION_BID)}
    out = None
    for kind, (entity, (df, schema)) in enumerate(flat.items()):
        fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        structs = [
            (fields if name == entity else F.lit(None).cast(other)).alias(name) for name, (_, other) in flat.items()
        ]
        rows = df.select(F.lit(kind).alias("event_type"), *structs)
        out = rows if out is None else out.unionByName(rows)
    return out


def to_topic(union: DataFrame, partition: Column | None = None) -> DataFrame:
    """Union events as JSON values; without a partition the producer goes round-robin."""
    value = F.to_json(F.struct("event_type", "person", "auction", "bid")).alias("value")
    return union.select(value, *([partition.cast("int").alias("partition")] if partition is not None else []))


def from_topic(records: DataFrame) -> DataFrame:
    return records.select(F.from_json(F.col("value").cast("string"), schemas.UNION).alias("e")).select("e.*")


def to_keyed_topic(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns as JSON key, the other columns as JSON value."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct(*rest)).alias("value"))


def from_keyed_topic(records: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """Every record as a row (upserts read as appends)."""
    parts = {
        "k": StructType([f for f in schema if f.name in keys]),
        "v": StructType([f for f in schema if f.name not in keys]),
    }
    sources = {"k": "key", "v": "value"}
    parsed = records.where(F.col("value").isNotNull()).select(
        *[F.from_json(F.col(sources[p]).cast("string"), s).alias(p) for p, s in parts.items()]
    )
    return parsed.select(*[F.col(f"{'k' if f.name in keys else 'v'}.{f.name}").alias(f.name) for f in schema])


def latest_per_key(records: DataFrame, position: str = "offset") -> DataFrame:
    """The current record of every key: the newest by position, unless its value is null (a delete)."""
    newest = records.groupBy("key").agg(F.max_by("value", position).alias("value"))
    return newest.where(F.col("value").isNotNull())


def consumer_options(servers: str, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """Reads from the earliest offset; the cap per trigger also bounds how far topics drift apart."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    return options | ({"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {})


def read_topic_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**consumer_options(servers, topic, max_offsets)).load()


def write_topic(records: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """A batch write, or a started streaming query when the records are a stream."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if records.isStreaming:
        return records.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
    return records.write.format("kafka").options(**options).save()
