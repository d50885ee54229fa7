"""Stream-stream and stream-static joins, append mode.

q3, q13, q20 and q23 run as they are (operators.joins) on streams: without a watermark their state is
unbounded, as the unwindowed joins demand. ``expiring`` bounds it by a time to live.
"""

from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.functions.scalar import interval


def expiring(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str, ttl: str) -> DataFrame:
    """Equi join of two watermarked streams that forgets rows further apart than the time to live."""
    near = F.col(left_time).between(F.col(right_time) - interval(ttl), F.col(right_time) + interval(ttl))
    return left.join(right, on & near)


def auction_side(auction: DataFrame) -> DataFrame:
    return auction.select(
        "id", "itemName", "description", "initialBid", "reserve", F.col("dateTime").alias("start"), "expires",
        "seller", "category", "extra",
    )


def bid_side(bid: DataFrame) -> DataFrame:
    return bid.select(
        "auction", "bidder", "price", F.col("dateTime").alias("bid_dateTime"), F.col("extra").alias("bid_extra")
    )


def open_for(max_open: str | None = None) -> Column:
    """The bid falls into its auction, both ends included."""
    on = (F.col("id") == F.col("auction")) & F.col("bid_dateTime").between(F.col("start"), F.col("expires"))
    return on & (F.col("bid_dateTime") <= F.col("start") + interval(max_open)) if max_open else on


def offers(auction: DataFrame, bid: DataFrame, max_open: str | None = None, salts: int = 1) -> DataFrame:
    """Bids with their open auction (q4, q9). One event-time column is left: the bid's.

    ``max_open`` says how long an auction can last at most, which lets Spark forget auctions and bids;
    without it the state grows as in an unbounded join. ``salts`` spreads the bids of every auction over
    that many state partitions, at the price of as many copies of the (far fewer) auctions.
    """
    a, b, on = auction_side(auction), bid_side(bid), open_for(max_open)
    if salts > 1:
        b = b.withColumn("__salt", F.pmod(F.xxhash64(*b.columns), F.lit(salts)).cast("int"))
        a = a.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = on & (F.col("__salt") == F.col("__copy"))
    return b.join(a, on).drop("start", "__salt", "__copy")
