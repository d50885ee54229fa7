"""Tumbling, hopping, session and processing-time windows on tables.

The grouping functions at the end also serve the streams.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from auctionstream.functions.scalar import interval


def tumble(size: str, ts: str = "dateTime") -> Column:
    return F.window(ts, size)


def hop(size: str, slide: str, ts: str = "dateTime") -> Column:
    return F.window(ts, size, slide)


def with_bounds(df: DataFrame, start: str = "starttime", end: str = "endtime") -> DataFrame:
    """Replace the window column by its two ends."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(*rest, F.col("window.start").alias(start), F.col("window.end").alias(end))


def hop_counts(bid: DataFrame, size: str = "10 seconds", slide: str = "2 seconds") -> DataFrame:
    """Bids per auction and hopping window."""
    return bid.groupBy("auction", hop(size, slide).alias("window")).agg(F.count("*").alias("num"))


def tumble_max(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Highest price per tumbling window."""
    return bid.groupBy(tumble(size).alias("window")).agg(F.max("price").alias("maxprice"))


def _pane(size: str, slide: str) -> pd.Timedelta:
    return pd.Timedelta(math.gcd(pd.Timedelta(size).value, pd.Timedelta(slide).value))


def pane_counts(bid: DataFrame, size: str, slide: str, *more: Column) -> DataFrame:
    """Bids per auction and pane, the longest span that every hopping window holds wholly or not at all."""
    pane = f"{_pane(size, slide).value // 1000} microseconds"
    return (
        bid.where(F.col("dateTime").isNotNull())
        .groupBy("auction", tumble(pane)["start"].alias("__pane")).agg(F.count("*").alias("__n"), *more)
    )


def window_counts(panes: DataFrame, size: str, slide: str) -> DataFrame:
    """Counts per pane, repeated for each hopping window of the pane and summed per auction and start of the window."""
    length, step = pd.Timedelta(size), pd.Timedelta(slide)
    first = tumble(slide, "__pane")["start"]
    starts = F.array(*[first - interval(slide) * k for k in range(-(-length // step))])
    rows = panes.select("auction", "__pane", "__n", F.explode(starts).alias("start"))
    if length % step:
        rows = rows.where(F.col("__pane") < F.col("start") + interval(size))
    return rows.groupBy("auction", "start").agg(F.sum("__n").alias("num"))


def hop_start_counts(bid: DataFrame, size: str, slide: str) -> DataFrame:
    """Bids per auction and start of the hopping window.

    Bids are counted per pane first; the few counts, not the bids, are then repeated for each window of their pane.
    """
    return window_counts(pane_counts(bid, size, slide), size, slide)


def q5_hot_items(bid: DataFrame, size: str = "10 seconds", slide: str = "2 seconds") -> DataFrame:
    """The auctions with most bids in every hopping window; ties are all kept.

    Maximum and join rather than a rank: the maximum is combined before its shuffle, and AQE may
    broadcast it or split a window in which most auctions tie. The null-safe comparison adds no filter
    of its own to either side, which would undo the sharing of the counts.
    """
    counts = hop_start_counts(bid, size, slide)
    most = counts.groupBy(F.col("start").alias("__at")).agg(F.max("num").alias("maxn"))
    joined = counts.join(most, F.col("start").eqNullSafe(F.col("__at")) & (F.col("num") >= F.col("maxn")))
    return joined.select("auction", "num")


def q7_highest_bid(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """The bids that reach the maximum of a tumbling window, whose both ends count.

    A bid belongs to the window that contains it. One at a boundary also counts for the window that ends
    there, if it equals that window's maximum, which it does not raise. The rank keeps the highest bids of
    each window, and all those at its end, before the shuffle; then the two meet.
    """
    window = F.struct(F.col("__w.end").alias("end"), F.lit(True).alias("own"))
    before = F.struct(F.col("__w.start").alias("end"), F.lit(False).alias("own"))
    at_boundary = F.col("dateTime") == F.col("__w.start")
    rows = (
        bid.where(F.col("price").isNotNull()).select("auction", "price", "bidder", "dateTime", "extra")
        .withColumn("__w", tumble(size))
        .withColumn("__of", F.explode(F.when(at_boundary, F.array(window, before)).otherwise(F.array(window))))
        .select("*", F.col("__of.end").alias("__end"), F.col("__of.own").alias("__own"))
    )
    highest = Window.partitionBy("__end", "__own").orderBy(F.when(F.col("__own"), F.col("price")).desc())
    best = rows.withColumn("__rank", F.rank().over(highest)).where("__rank = 1")
    maximum = F.max(F.when(F.col("__own"), F.col("price"))).over(Window.partitionBy("__end"))
    return best.withColumn("__max", maximum).where("price = __max").select("auction", "price", "bidder", "dateTime", "extra")


def q8_new_sellers(person: DataFrame, auction: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Persons who registered and opened an auction in the same tumbling window."""
    p = person.select("id", "name", tumble(size).alias("window")).distinct()
    a = auction.select("seller", tumble(size).alias("seller_window")).distinct()
    on = (F.col("id") == F.col("seller")) & (F.col("window") == F.col("seller_window"))
    return p.join(a, on).select("id", "name", F.col("window.start").alias("stime"))


def sessions(bid: DataFrame, gap: str = "10 seconds", key: str = "bidder") -> DataFrame:
    """Sessions per key with their row count; rows exactly one gap apart share a session.

    Rows of one key within one gap-long slice of time always share a session, so they are combined
    before the shuffle. The pass over a whole key then sees one row per slice, however hot the key.
    """
    slices = bid.groupBy(key, F.window("dateTime", gap).alias("__slice")).agg(
        F.count("*").alias("__n"), F.min("dateTime").alias("__first"), F.max("dateTime").alias("__last")
    )
    in_time = Window.partitionBy(key).orderBy("__first")
    fresh = F.col("__first") > F.lag("__last").over(in_time) + interval(gap)
    numbered = slices.withColumn("__fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn(
        "__session", F.sum("__fresh").over(in_time)
    )
    return numbered.groupBy(key, "__session").agg(
        F.sum("__n").alias("bid_count"),
        F.min("__first").alias("starttime"),
        (F.max("__last") + interval(gap)).alias("endtime"),
    ).drop("__session")


def q11_user_sessions(bid: DataFrame, gap: str = "10 seconds") -> DataFrame:
    return sessions(bid, gap)


def q12_processing_windows(bid: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Bids per bidder and window of processing time (the query's or the micro-batch's clock)."""
    now = F.window(F.current_timestamp(), size).alias("window")
    return with_bounds(bid.groupBy("bidder", now).agg(F.count("*").alias("bid_count")))
