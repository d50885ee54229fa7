"""Equi, interval, lookup and multi-way joins.

No broadcast hints: Catalyst and AQE broadcast a side when its size, estimated or measured, is below
the session's threshold. AQE splits skewed keys. Joins that are followed by work on the same key (q4, q6,
q9) need spark.sql.adaptive.forceOptimizeSkewedJoin for that, which build_session sets: the work on the
key then gets a shuffle of its own, of rows that were reduced before it.
"""

from pyspark.sql import DataFrame, functions as F

from auctionstream.functions.scalar import integer_avg

Q3_STATES = ("OR", "ID", "CA")
CATEGORY = 10


def q3_local_sellers(auction: DataFrame, person: DataFrame) -> DataFrame:
    a = auction.where(F.col("category") == CATEGORY).select("id", "seller")
    p = person.where(F.col("state").isin(*Q3_STATES)).select(
        F.col("id").alias("person_id"), "name", "city", "state"
    )
    return a.join(p, F.col("seller") == F.col("person_id")).select("name", "city", "state", "id")


def bids_in_auction_time(
    bids: DataFrame, auctions: DataFrame, auction_id: str, start: str, end: str, bid_time: str = "bid_dateTime",
) -> DataFrame:
    """Every bid with its auction if it falls into [start, end], both ends included."""
    open_time = F.col(bid_time).between(F.col(start), F.col(end))
    return bids.join(auctions, (F.col("auction") == F.col(auction_id)) & open_time)


def q4_category_average(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """Average final price of the auctions of a category."""
    a = auction.select("id", "category", F.col("dateTime").alias("__start"), "expires")
    b = bid.select("auction", "price", F.col("dateTime").alias("bid_dateTime"))
    final = (
        bids_in_auction_time(b, a, "id", "__start", "expires")
        .groupBy("id", "category")
        .agg(F.max("price").alias("final"))
    )
    return final.groupBy(F.col("category")).agg(integer_avg(F.col("final")).alias("final"))


def q13_lookup(bid: DataFrame, side: DataFrame, modulus: int = 10_000) -> DataFrame:
    """Enrich bids from a bounded side table; on a stream the side is static."""
    return bid.join(side, F.col("auction") % modulus == F.col("key")).select(
        "auction", "bidder", "price", "dateTime", "value"
    )


def _category_auctions(auction: DataFrame) -> DataFrame:
    return auction.where(F.col("category") == CATEGORY).select(
        F.col("id").alias("auction_id"), "itemName", "description", "initialBid", "reserve",
        F.col("dateTime").alias("auction_dateTime"), "expires", "seller", "category",
        F.col("extra").alias("auction_extra"),
    )


def q20_expand_bids(bid: DataFrame, auction: DataFrame) -> DataFrame:
    """Bids on auctions of one category, with all auction columns."""
    b = bid.select(
        "auction", "bidder", "price", "channel", "url",
        F.col("dateTime").alias("bid_dateTime"), F.col("extra").alias("bid_extra"),
    )
    a = _category_auctions(auction)
    return b.join(a, F.col("auction") == F.col("auction_id")).drop("auction_id")


def q20_mod_expand_bids(bid: DataFrame, auction: DataFrame) -> DataFrame:
    """q20 that also carries the id of the bid."""
    b = bid.select(
        F.col("id").alias("bid_id"), "auction", "bidder", "price", "channel", "url",
        F.col("dateTime").alias("bid_dateTime"), F.col("extra").alias("bid_extra"),
    )
    a = _category_auctions(auction)
    return b.join(a, F.col("auction") == F.col("auction_id")).drop("auction_id")


def q20_by_key(bid: DataFrame, auction: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Key experiments: another bid column is compared with the auction id."""
    b = bid.select(*columns)
    a = auction.where(F.col("category") == CATEGORY).select(F.col("id").alias("auction_id"))
    return b.join(a, F.col(key) == F.col("auction_id"))


def q20_bidder(bid: DataFrame, auction: DataFrame) -> DataFrame:
    return q20_by_key(bid, auction, "bidder", ["bidder"])


def q20_bidder_full(bid: DataFrame, auction: DataFrame) -> DataFrame:
    return q20_by_key(bid, auction, "bidder", ["auction", "bidder", "price", "dateTime"])


def q20_price(bid: DataFrame, auction: DataFrame) -> DataFrame:
    return q20_by_key(bid, auction, "price", ["price"])


def q23_three_way(bid: DataFrame, person: DataFrame, auction: DataFrame) -> DataFrame:
    """Bids with their bidder and all auctions that the bidder sells.

    Persons meet auctions first: both are far fewer than bids, and all three share one key.
    """
    b = bid.select("bidder", "price", "channel", "url", F.col("extra").alias("bid_extra"))
    p = person.select(
        F.col("id").alias("person_id"), "name", "emailAddress", "creditCard", "city", "state",
        F.col("extra").alias("person_extra"),
    )
    a = auction.select(
        "itemName", "description", "initialBid", "reserve", F.col("dateTime").alias("auction_dateTime"),
        "expires", "seller", "category", F.col("extra").alias("auction_extra"),
    )
    sellers = p.join(a, F.col("person_id") == F.col("seller"))
    joined = b.join(sellers, F.col("bidder") == F.col("seller"))
    return joined.select(*b.columns, *p.columns, *a.columns)
