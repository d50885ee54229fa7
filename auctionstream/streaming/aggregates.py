"""Updating aggregates on streams. Update mode: the newest row per key counts.

The day window carries the watermark, so the state of a day goes when the day is over.
"""

from pyspark.sql import DataFrame, functions as F

from auctionstream.operators.aggregates import auction_statistics

DAY = "1 day"


def _day_window(df: DataFrame) -> DataFrame:
    day = F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day")
    return df.select(day, *[c for c in df.columns if c != "window"])


def auction_report(bid: DataFrame) -> DataFrame:
    """q17."""
    grouped = bid.groupBy("auction", F.window("dateTime", DAY).alias("window"))
    return _day_window(grouped.agg(*auction_statistics(F.col("price"))))


def last_bids(bid: DataFrame) -> DataFrame:
    """q18: the last bid of every bidder on every auction so far."""
    columns = ["price", "channel", "url", "dateTime", "extra"]
    order = F.struct("dateTime", "price", "channel", "url", "extra")
    last = bid.groupBy("auction", "bidder").agg(F.max_by(F.struct(*columns), order).alias("last"))
    return last.select("auction", "bidder", "last.*")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-only keyed stream: repeats within the watermark delay are dropped."""
    return df.dropDuplicatesWithinWatermark(keys)
