"""Person, auction and bid views over the star-schema tables.

Orders stand for auctions, customers for persons and the event table for bids. Every function maps
one raw table (or stream) to one entity, so batch and streaming share the column rules.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auctionstream.streaming.run import replayed

STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
ENTITY_TABLE = {"person": "customer", "auction": "orders", "bid": "events"}
# Columns the views read; a given schema saves a job that would infer it.
TABLE_SCHEMA = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _after_epoch(hours: str):
    return F.expr(f"{EPOCH} + INTERVAL '1' HOUR * ({hours})")


def person_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, STATES)), F.col("c_nationkey") % len(STATES) + 1)
    key = F.col("c_custkey").cast("string")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_mktsegment"), key, F.lit("@example.com")).alias("emailAddress"),
        F.lpad(key, 16, "0").alias("creditCard"),
        F.col("n_name").alias("city"),
        state.alias("state"),
        _after_epoch("c_custkey % 720").alias("dateTime"),
        F.col("c_mktsegment").alias("extra"),
    )


def auction_from(orders: DataFrame) -> DataFrame:
    total = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("itemName"),
        F.col("o_orderstatus").alias("description"),
        F.floor(total).cast("bigint").alias("initialBid"),
        F.floor(total * 2).cast("bigint").alias("reserve"),
        _after_epoch("o_orderkey % 720").alias("dateTime"),
        _after_epoch("o_orderkey % 720 + 240").alias("expires"),
        F.col("o_custkey").alias("seller"),
        (F.col("o_orderkey") % 5 + 10).alias("category"),
        F.col("o_orderstatus").alias("extra"),
    )


def bid_from(events: DataFrame, auctions: Column) -> DataFrame:
    """Bids on all of ``auctions`` ids; a fourth of them on seven hot ones."""
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    url = F.concat(
        F.lit("https://www.example.com/"), "event_type", F.lit("/u"), user, F.lit("/e"),
        (event % 7).cast("string"), F.lit("/item.htm?query=1"),
        F.when(event % 10 > 0, F.concat(F.lit("&channel_id="), user)).otherwise(""),
    )
    return events.select(
        event.alias("id"),
        F.when(event % 4 == 0, event % 7).otherwise(event * 7919 % auctions).alias("auction"),
        F.col("user_id").alias("bidder"),
        F.floor(F.col("value") * F.col("value") * 100).cast("bigint").alias("price"),
        F.col("event_type").alias("channel"),
        url.alias("url"),
        F.col("ts").alias("dateTime"),
        F.col("props").alias("extra"),
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA[name]).parquet(f"{folder}/{name}.parquet")


def person(spark: SparkSession, folder: str) -> DataFrame:
    return person_from(table(spark, folder, "customer"), table(spark, folder, "nation"))


def auction(spark: SparkSession, folder: str) -> DataFrame:
    return auction_from(table(spark, folder, "orders"))


def bid(spark: SparkSession, folder: str) -> DataFrame:
    # A subquery of the plan: no job runs when the view is built.
    auctions = table(spark, folder, "orders").agg(F.max("o_orderkey") + 1).scalar()
    return bid_from(table(spark, folder, "events"), auctions)


def stream_of(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """The same view as a stream of several micro-batches. Event times become TIMESTAMP, which watermarks need."""
    views = {"person": person, "auction": auction, "bid": bid}
    return replayed(with_event_time(views[entity](spark, folder)))


def with_event_time(rows: DataFrame) -> DataFrame:
    times = {c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(times) if times else rows
