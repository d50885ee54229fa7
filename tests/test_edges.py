"""Hand-made rows for the semantic traps."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auctionstream.functions import scalar as S
from auctionstream.operators import aggregates, joins, projections, topn, windows

BASE = datetime.datetime(2024, 1, 1)
BID = "id bigint, auction bigint, bidder bigint, price bigint, channel string, url string, dateTime timestamp_ntz, extra string"


def at(ms=0, **kw):
    return BASE + datetime.timedelta(milliseconds=ms, **kw)


def bid_rows(spark, rows):
    full = [
        (i, r.get("auction", 1), r.get("bidder", 1), r.get("price", 1), r.get("channel", "x"), r.get("url", ""),
         r.get("dateTime", BASE), r.get("extra", ""))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, BID)


def auction_rows(spark, rows):
    schema = ("id bigint, itemName string, description string, initialBid bigint, reserve bigint, dateTime timestamp_ntz, "
              "expires timestamp_ntz, seller bigint, category bigint, extra string")
    full = [(r["id"], "i", "d", 1, 2, r["start"], r["end"], r.get("seller", 1), 10, "") for r in rows]
    return spark.createDataFrame(full, schema)


def test_integer_average_cuts(spark):
    df = spark.createDataFrame([(1,), (2,)], "x bigint")
    assert df.agg(S.integer_avg(F.col("x"))).first()[0] == 1
    assert df.agg(S.integer_avg(-F.col("x"))).first()[0] == -1
    assert df.where("x > 5").agg(S.integer_avg(F.col("x"))).first()[0] is None


def test_euro_has_three_decimals(spark):
    row = projections.q1_currency(bid_rows(spark, [{"price": 1001}])).first()
    assert row.price == Decimal("908.908")


@pytest.mark.parametrize("text, count", [(None, 0), ("", 0), ("abcabc", 2), ("ççc", 1), ("CC", 0)])
def test_count_char(spark, text, count):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(S.count_char(F.col("s"), "c")).first()[0] == count


def test_bid_time_type(spark):
    times = ["06:59", "07:00", "08:00", "18:59", "19:00", "20:00"]
    df = spark.createDataFrame([(datetime.datetime.fromisoformat(f"2024-01-01T{t}"),) for t in times], "t timestamp_ntz")
    kinds = [r[0] for r in df.select(S.bid_time_type(F.col("t"))).collect()]
    assert kinds == ["nightTime", "otherTime", "dayTime", "dayTime", "otherTime", "nightTime"]


URLS = ["https://a/b?query=1", "x&channel_id=7&y", "channel_id=8", "x&channel_id=", "xchannel_id=9", "&channel_id=1&channel_id=2"]


def test_url_parameter_equals_pattern(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    rows = df.select(
        S.url_parameter(F.col("u"), "channel_id"), S.regexp_group(F.col("u"), "(&|^)channel_id=([^&]*)", 2)
    ).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] == [None, "7", "8", "", None, "1"]


def test_known_channels_win_over_url(spark):
    names = ["Apple", "google", "BAIDU", "facebook", "other", "other"]
    urls = ["x&channel_id=9"] * 4 + ["x&channel_id=", "x"]
    out = projections.q21_channel_id(bid_rows(spark, [{"channel": c, "url": u} for c, u in zip(names, urls)]))
    assert [r.channel_id for r in out.collect()] == ["0", "1", "3", "2", ""]


def test_url_directories_out_of_range(spark):
    out = projections.q22_url_directories(bid_rows(spark, [{"url": "https://h/a/b"}])).first()
    assert (out.dir1, out.dir2, out.dir3) == ("a", "b", None)


def test_price_bands(spark):
    out = aggregates.q15_daily_report(bid_rows(spark, [{"price": p} for p in (9999, 10000, 999999, 1000000)])).first()
    assert (out.rank1_bids, out.rank2_bids, out.rank3_bids, out.total_bidders, out.rank2_bidders) == (1, 2, 1, 1, 1)


def test_two_level_report_equals_distinct(spark):
    rows = [
        {"auction": i % 5, "bidder": i * 7 % 11, "price": 10 ** (i % 8), "channel": "ab"[i % 2], "dateTime": at(hours=i * 5)}
        for i in range(300)
    ]
    bid = bid_rows(spark, rows).withColumn("bidder", F.when(F.col("bidder") != 3, F.col("bidder")))
    keys = {"channel": F.col("channel"), "day": S.day_of(F.col("dateTime"))}
    one, two = aggregates.bid_report(bid, keys), aggregates.distinct_report(bid, keys)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_minute_is_the_latest_of_the_day(spark):
    out = aggregates.q16_channel_report(bid_rows(spark, [{"dateTime": at(hours=9, minutes=5)}, {"dateTime": at(minutes=59)}]))
    assert out.first().minute == "09:05"


def test_bid_outside_its_auction(spark):
    auction = auction_rows(spark, [{"id": 1, "start": at(), "end": at(1000)}])
    times = [-1, 0, 1000, 1001]
    bid = bid_rows(spark, [{"price": 10 * (i + 1), "dateTime": at(t)} for i, t in enumerate(times)])
    assert joins.q4_category_average(auction, bid).collect()[0].final == 30
    assert topn.q9_winning_bids(auction, bid).first().price == 30


def test_earlier_bid_wins_a_tie(spark):
    auction = auction_rows(spark, [{"id": 1, "start": at(), "end": at(1000)}])
    bid = bid_rows(spark, [{"price": 5, "bidder": 1, "dateTime": at(20)}, {"price": 5, "bidder": 2, "dateTime": at(10)}])
    assert topn.q9_winning_bids(auction, bid).first().bidder == 2


def test_auction_listed_twice_has_one_winner(spark):
    auction = auction_rows(spark, [{"id": 1, "start": at(), "end": at(1000)}] * 2)
    assert topn.q9_winning_bids(auction, bid_rows(spark, [{"dateTime": at(1)}])).count() == 1


def test_moving_average_covers_eleven_rows(spark):
    auction = auction_rows(spark, [{"id": i, "start": at(), "end": at(10_000)} for i in range(12)])
    bid = bid_rows(spark, [{"auction": i, "price": 11 * (i + 1), "dateTime": at(i)} for i in range(12)])
    out = topn.q6_seller_average(auction, bid)
    assert dict(out.dtypes)["seller"] == "string"
    assert sorted(r.avg_price for r in out.collect())[-1] == 77  # of 22 .. 132, without the first


def test_window_ends_are_closed(spark):
    rows = [{"price": 50, "dateTime": at(3000)}, {"price": 50, "dateTime": at(10_000)}, {"price": 60, "dateTime": at(12_000)}]
    out = windows.q7_highest_bid(bid_rows(spark, rows))
    assert sorted(r.dateTime for r in out.collect()) == [at(3000), at(10_000), at(12_000)]


def test_boundary_bid_that_tops_both_windows(spark):
    rows = [{"price": 50, "dateTime": at(3000)}, {"price": 50, "dateTime": at(10_000)}]
    assert windows.q7_highest_bid(bid_rows(spark, rows)).count() == 3


def test_sessions_one_gap_apart_join(spark):
    for extra_ms, expected in ((0, 1), (1, 2)):
        rows = [{"dateTime": at()}, {"dateTime": at(10_000 + extra_ms)}]
        out = windows.q11_user_sessions(bid_rows(spark, rows)).collect()
        assert len(out) == expected
        assert max(r.endtime for r in out) == at(20_000 + extra_ms)


def test_sessions_equal_builtin(spark, folder):
    from auctionstream.sources import adapter

    bid = adapter.bid(spark, folder)
    own = windows.q11_user_sessions(bid, "2 hours").select("bidder", "bid_count", "starttime", "endtime")
    built = bid.groupBy("bidder", F.session_window("dateTime", "2 hours").alias("window")).agg(F.count("*").alias("bid_count"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, windows.with_bounds(built).collect()))


@pytest.mark.parametrize("size, slide", [("10 seconds", "2 seconds"), ("10 seconds", "4 seconds")])
def test_hop_counts_equal_builtin(spark, size, slide):
    bid = bid_rows(spark, [{"auction": i % 3, "dateTime": at(i * 777)} for i in range(60)])
    own = windows.hop_start_counts(bid, size, slide).select("auction", "start", "num")
    built = windows.hop_counts(bid, size, slide).select("auction", "window.start", "num")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, built.collect()))


def test_top_n_is_deterministic_and_limited_before_the_shuffle(spark):
    bid = bid_rows(spark, [{"price": 5, "extra": e} for e in "dbca"])
    out = topn.q19_top_bids(bid.repartition(3), 2)
    assert sorted((r.rank_number, r.extra) for r in out.collect()) == [(1, "a"), (2, "b")]
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") >= 2  # before and after the exchange
