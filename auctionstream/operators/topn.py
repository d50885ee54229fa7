"""First rows per key: top-N, deduplication, winning bids and the moving average of winners."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from auctionstream.operators.joins import bids_in_auction_time
from auctionstream.plans.ranges import PART, PLACE, Groups, in_ranges, numbers


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows per key. Remaining columns break ties, so the result is deterministic.

    Catalyst limits each group before the shuffle (WindowGroupLimit): a hot key sends at most n rows
    per map task.
    """
    rank_col = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in df.columns if c not in keys])
    ranked = df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= n)
    return ranked.withColumn(rank, F.col(rank).cast("bigint")) if rank else ranked.drop(rank_col)


def q18_last_bid(bid: DataFrame) -> DataFrame:
    """Last bid of every bidder on every auction."""
    columns = ["auction", "bidder", "price", "channel", "url", "dateTime", "extra"]
    # Of bids at one instant the largest remaining columns count, as for the stream's max_by.
    last = [F.col(c).desc() for c in ("dateTime", "price", "channel", "url", "extra")]
    return top_n(bid.select(*columns), ["bidder", "auction"], last, 1)


def q19_top_bids(bid: DataFrame, n: int = 10) -> DataFrame:
    """The n highest bids per auction with their rank."""
    columns = ["auction", "bidder", "price", "channel", "url", "dateTime", "extra"]
    order = [F.col("price").desc(), F.col("dateTime")]
    return top_n(bid.select(*columns), ["auction"], order, n, rank="rank_number")


def q9_winning_bids(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """The highest, then earliest, bid of every auction while it was open, with all auction columns.

    The winner is found on the narrow columns of the auction; the wide ones join afterwards, in the
    partitioning that is already there.
    """
    version = {"id": "__id", "dateTime": "__start", "expires": "__end"}
    narrow = auction.select(*[F.col(c).alias(n) for c, n in version.items()])
    bids = bid.select(
        "auction", "bidder", "price", F.col("dateTime").alias("bid_dateTime"), F.col("extra").alias("bid_extra")
    )
    offers = bids_in_auction_time(bids, narrow, "__id", "__start", "__end")
    best = [F.col("price").desc(), F.col("bid_dateTime")]
    winners = top_n(offers, ["__id"], best, 1)
    same = [F.col(c) == F.col(n) for c, n in version.items()]
    wide = auction.join(winners, same).drop(*version.values())
    # An id that occurs twice still yields one row.
    return top_n(wide, ["id"], best, 1).select(*auction.columns, *bids.columns)


def winners_per_auction(auction: DataFrame, bid: DataFrame) -> DataFrame:
    sellers = auction.select("id", "seller", F.col("dateTime").alias("__start"), "expires")
    bids = bid.select("auction", "price", F.col("dateTime").alias("bid_dateTime"))
    offers = bids_in_auction_time(bids, sellers, "id", "__start", "expires")
    offers = offers.select("id", "seller", "price", F.col("bid_dateTime").alias("dateTime"))
    return top_n(offers, ["id", "seller"], [F.col("price").desc(), F.col("dateTime")], 1)


def moving_average(
    df: DataFrame, key: str, order: list[str], value: str, before: int, alias: str, partitions: int | None = None
) -> DataFrame:
    """Integer average, cut towards zero, over the current and the ``before`` preceding rows of the key.

    ``order`` must be total. Nulls don't count; over nulls alone the average is null. The rows of a hot key
    are averaged in as many range partitions as they fill; only the first ``before`` rows of a partition
    wait for the last ones of the partitions before it. Writes below the shared folder.
    """
    columns, types = df.columns, dict(df.dtypes)

    def kernel(table: pa.Table, groups: Groups) -> dict:
        values, known = numbers(table[value])
        since = np.maximum(groups.first, np.arange(len(values)) - before)
        total, count = (np.append(0, np.cumsum(x)) for x in (values, known.astype(np.int64)))
        here = np.arange(1, len(values) + 1)
        sums, counts = total[here] - total[since], count[here] - count[since]
        cut = np.sign(sums) * (np.abs(sums) // np.maximum(counts, 1))
        done = ~groups.heads(before)
        return {
            **{c: table[c] for c in columns}, PLACE: groups.place, "__done": done, "__end": groups.ends(before),
            alias: pa.array(cut, pa.int64(), mask=~done | (counts == 0)),
        }

    fields = ", ".join(f"`{c}` {types[c]}" for c in columns)
    found = in_ranges(
        df, [key], order, kernel, f"{fields}, {PLACE} long, __done boolean, __end boolean, `{alias}` long", "moving-average", partitions
    )
    frame = Window.partitionBy(key).orderBy(PART, PLACE).rowsBetween(-before, 0)
    heads = found.where("__end").withColumn(alias, _avg_over(value, frame)).where("NOT __done")
    return found.where("__done").union(heads).select(*columns, alias)


def _avg_over(value: str, frame) -> Column:
    return F.call_function("div", F.sum(value).over(frame), F.nullif(F.count(value).over(frame), F.lit(0)))


def q6_seller_average(auction: DataFrame, bid: DataFrame, before: int = 10) -> DataFrame:
    """Moving average of a seller's winning prices in order of bid time: the row and 10 before it."""
    winners = winners_per_auction(auction, bid)
    averages = moving_average(winners, "seller", ["dateTime", "id"], "price", before, "avg_price")
    return averages.select(F.col("seller").cast("string").alias("seller"), "avg_price")
