"""Row-wise queries. One scan, no shuffle; they work on tables and on streams alike."""

from pyspark.sql import DataFrame, functions as F

from auctionstream.functions import scalar as S

BID_COLUMNS = ("auction", "bidder", "price", "dateTime", "extra")


def q0_pass_through(bid: DataFrame) -> DataFrame:
    return bid.select(*BID_COLUMNS)


def q1_currency(bid: DataFrame) -> DataFrame:
    return bid.select(*BID_COLUMNS).withColumn("price", S.to_euro(F.col("price")))


def q2_selection(bid: DataFrame, divisor: int = 123) -> DataFrame:
    return bid.where(F.col("auction") % divisor == 0).select("auction", "price")


def q10_log(bid: DataFrame) -> DataFrame:
    """Bids with the two partition columns of the log (see sources.sinks.write_log)."""
    ts = F.col("dateTime")
    return bid.select(*BID_COLUMNS, S.day_of(ts).alias("dt"), S.minute_of(ts).alias("hm"))


def q14_calculation(bid: DataFrame) -> DataFrame:
    euro = S.to_euro(F.col("price"))
    return bid.where((euro > 1_000_000) & (euro < 50_000_000)).select(
        "auction", "bidder",
        euro.alias("price"),
        S.bid_time_type(F.col("dateTime")).alias("bidTimeType"),
        "dateTime", "extra",
        S.count_char(F.col("extra"), "c").alias("c_counts"),
    )


def q21_channel_id(bid: DataFrame) -> DataFrame:
    """Bids whose channel is well known or whose url names a channel id."""
    channel, url = F.col("channel"), F.col("url")
    return bid.where(S.has_channel_id(channel, url)).select(
        "auction", "bidder", "price", "channel", S.channel_id(channel, url).alias("channel_id")
    )


def q22_url_directories(bid: DataFrame) -> DataFrame:
    parts = [S.split_index(F.col("url"), "/", i).alias(f"dir{i - 2}") for i in (3, 4, 5)]
    return bid.select("auction", "bidder", "price", "channel", *parts)
