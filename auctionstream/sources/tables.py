"""Side table, views over the union event and over flat tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from auctionstream import schemas

ENTITIES = {"person": schemas.PERSON_EVENT, "auction": schemas.AUCTION_EVENT, "bid": schemas.BID_EVENT}
BID_FIELDS = schemas.UNION_BID.fieldNames()


def side_rows(spark: SparkSession, rows: int = 10_000) -> DataFrame:
    """Rows (i, 'i') of the side table; Catalyst knows the size of a range."""
    return spark.range(rows).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value"))


def write_side_csv(spark: SparkSession, path: str, rows: int = 10_000) -> None:
    side_rows(spark, rows).write.mode("overwrite").csv(path)


def read_side_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SIDE).csv(path)


def event_time() -> "F.Column":
    """Event time of a union row: that of the one struct which is set."""
    return F.coalesce("person.dateTime", "auction.dateTime", "bid.dateTime")


def entity_view(union: DataFrame, entity: str) -> DataFrame:
    """The rows of one entity as a flat table. On Parquet only its own fields are read."""
    return union.where(F.col("event_type") == ENTITIES[entity]).select(f"{entity}.*")


def union_views(union: DataFrame) -> dict[str, DataFrame]:
    return {entity: entity_view(union, entity) for entity in ENTITIES}


def typed_views(person: DataFrame, auction: DataFrame, bid: DataFrame) -> dict[str, DataFrame]:
    """Views over flat tables: bid without the event id, bid_modified with it."""
    return {
        "person": person.select(*schemas.PERSON.fieldNames()),
        "auction": auction.select(*schemas.AUCTION.fieldNames()),
        "bid": bid.select(*BID_FIELDS),
        "bid_modified": bid.select("id", *BID_FIELDS),
    }


def with_watermark(df: DataFrame, delay: str = "4 seconds", ts: str = "dateTime") -> DataFrame:
    """Rows may be late by up to the delay; on a table this changes nothing."""
    return df.withWatermark(ts, delay)
