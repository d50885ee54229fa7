"""Windowed aggregates and window joins on streams, in append mode: a row is final when it appears.

Inputs carry a watermark on dateTime (sources.tables.with_watermark).
"""

from pyspark.sql import DataFrame, functions as F

from auctionstream.functions.scalar import interval
from auctionstream.operators.windows import hop_counts, tumble, tumble_max, with_bounds


def closed_counts(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    return with_bounds(bid.groupBy(tumble(size).alias("window")).agg(F.count("*").alias("bid_count")))


def tumbling_max(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    return with_bounds(tumble_max(bid, size))


def hopping_counts(bid: DataFrame, size: str = "10 seconds", slide: str = "2 seconds") -> DataFrame:
    return with_bounds(hop_counts(bid, size, slide))


def hot_items(
    bid: DataFrame, bid_again: DataFrame, size: str = "10 seconds", slide: str = "2 seconds"
) -> DataFrame:
    """q5: counts per auction and window, the maximum per window, and the counts that reach it.

    The second aggregate and the join key on the window, so all state goes when the window closes. The
    bids are read twice: with one and the same stream on both sides, Spark does not pass the watermark
    on to the second count.
    """
    counts = hop_counts(bid, size, slide)
    most = hop_counts(bid_again, size, slide).groupBy("window").agg(F.max("num").alias("maxn"))
    joined = counts.join(most, "window").where(F.col("num") >= F.col("maxn"))
    return with_bounds(joined.select("window", "auction", "num"))


def session_counts(bid: DataFrame, gap: str = "10 seconds") -> DataFrame:
    session = F.session_window("dateTime", gap).alias("window")
    return with_bounds(bid.groupBy("bidder", session).agg(F.count("*").alias("bid_count")))


def processing_time_counts(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """q12 in update mode; the window is that of the micro-batch's clock."""
    now = F.window(F.current_timestamp(), size).alias("window")
    return with_bounds(bid.groupBy("bidder", now).agg(F.count("*").alias("bid_count")))


def highest_bids(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """q7: raw bids against the maximum of the windows they touch."""
    most = tumble_max(bid, size).select(
        "maxprice", F.window_time("window").alias("maxtime"), F.col("window.end").alias("endtime")
    )
    bids = bid.select("auction", "price", "bidder", "dateTime", "extra")
    # The bounds on window_time, 1 us before the window's end, let Spark drop old rows of both sides.
    bounds = (F.col("dateTime") >= F.col("maxtime") - interval(size)) & (
        F.col("dateTime") <= F.col("maxtime") + interval("1 second")
    )
    in_window = F.col("dateTime").between(F.col("endtime") - interval(size), F.col("endtime"))
    joined = bids.join(most, (F.col("price") == F.col("maxprice")) & bounds & in_window)
    return joined.select("auction", "price", "bidder", "dateTime", "extra")


def new_sellers(person: DataFrame, auction: DataFrame, size: str = "10 seconds") -> DataFrame:
    """q8: two deduplicated streams meet on person and window."""
    p = person.groupBy("id", "name", tumble(size).alias("window")).count().drop("count")
    a = auction.groupBy("seller", tumble(size).alias("window")).count().drop("count")
    joined = p.join(a, (p["id"] == a["seller"]) & (p["window"] == a["window"]))
    return joined.select("id", "name", p["window.start"].alias("stime"))
