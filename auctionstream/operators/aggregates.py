"""Reports with filtered and distinct counts."""

from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.functions.scalar import integer_avg, minute_number, minute_text, price_bands

BANDS = ("rank1", "rank2", "rank3")
REPORT_COLUMNS = [
    f"{kind}_{what}" for what in ("bids", "bidders", "auctions") for kind in ("total", *BANDS)
]


def band_counts(price: Column) -> list[Column]:
    bands = [F.count_if(cond).alias(f"{band}_bids") for band, cond in price_bands(price).items()]
    return [F.count("*").alias("total_bids"), *bands]


def bid_report(bid: DataFrame, keys: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """Counts of bids, distinct bidders and distinct auctions per key, in total and per price band.

    Two levels instead of eight distinct aggregates: each bid becomes one row for its bidder and one
    for its auction, rows of one (key, who) are combined before the shuffle into band flags, and the
    flags are summed per key. A hot bidder, auction or key costs one row per map task.
    """
    maxima = maxima or {}
    price, key_names = F.col("price"), list(keys)
    who = F.explode(F.array(
        F.struct(F.lit("bidders").alias("kind"), F.col("bidder").alias("who")),
        F.struct(F.lit("auctions").alias("kind"), F.col("auction").alias("who")),
    ))
    rows = bid.select(
        *[c.alias(k) for k, c in keys.items()], *[c.alias(k) for k, c in maxima.items()],
        *[cond.alias(band) for band, cond in price_bands(price).items()], who.alias("w"),
    )
    per_who = rows.groupBy(*key_names, "w.kind", "w.who").agg(
        F.count("*").alias("total"),
        *[F.count_if(band).alias(band) for band in BANDS],
        *[F.max(m).alias(m) for m in maxima],
    )
    is_bidder = F.col("kind") == "bidders"
    bids = [F.sum(F.when(is_bidder, F.col(c))).alias(f"{c}_bids") for c in ("total", *BANDS)]
    distinct = [
        F.count_if((F.col("kind") == kind) & F.col("who").isNotNull() & (F.col(c) > 0)).alias(f"{c}_{kind}")
        for kind in ("bidders", "auctions") for c in ("total", *BANDS)
    ]
    report = per_who.groupBy(*key_names).agg(*[F.max(m).alias(m) for m in maxima], *bids, *distinct)
    return report.select(*key_names, *maxima, *REPORT_COLUMNS)


def distinct_report(bid: DataFrame, keys: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """The same report with Catalyst's own distinct aggregates (one row copy per distinct group)."""
    price = F.col("price")
    distinct = []
    for column, kind in (("bidder", "bidders"), ("auction", "auctions")):
        distinct.append(F.countDistinct(column).alias(f"total_{kind}"))
        for band, cond in price_bands(price).items():
            distinct.append(F.countDistinct(F.when(cond, F.col(column))).alias(f"{band}_{kind}"))
    top = [F.max(c).alias(k) for k, c in (maxima or {}).items()]
    keyed = [c.alias(k) for k, c in keys.items()]
    return bid.groupBy(*keyed).agg(*top, *band_counts(price), *distinct)


def q15_daily_report(bid: DataFrame) -> DataFrame:
    report = bid_report(bid, {"day": F.to_date("dateTime")})
    return report.withColumn("day", F.col("day").cast("string"))


def q16_channel_report(bid: DataFrame) -> DataFrame:
    """Per channel and day, with the latest minute of the day.

    Day and minute stay numbers until the end: a maximum of strings would force a sort aggregate.
    """
    ts = F.col("dateTime")
    report = bid_report(bid, {"channel": F.col("channel"), "day": F.to_date(ts)}, {"minute": minute_number(ts)})
    return report.withColumns({"day": F.col("day").cast("string"), "minute": minute_text(F.col("minute"))})


def auction_statistics(price: Column) -> list[Column]:
    return [
        *band_counts(price),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        integer_avg(price).alias("avg_price"),
        F.sum(price).alias("sum_price"),
    ]


def q17_auction_report(bid: DataFrame) -> DataFrame:
    """Daily statistics of every auction."""
    day = F.to_date("dateTime").alias("day")
    report = bid.groupBy("auction", day).agg(*auction_statistics(F.col("price")))
    return report.withColumn("day", F.col("day").cast("string"))
