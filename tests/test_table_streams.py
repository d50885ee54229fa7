"""Streams whose state is kept as tables: no state store, late rows, batches that run again, batches in any cut."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auctionstream import session
from auctionstream.operators import joins, match
from auctionstream.streaming import joins as stream_joins, tables

START = datetime.datetime(2024, 1, 1)
QUERIES = "st_final st_join_agg st_hop st_chain st_join st_join_q3 st_join_q23 st_dedup_last st_cep0 st_cep1 st_cep2 st_cep3"
BIDS = "auction long, bidder long, price long, dateTime timestamp, extra string"
AUCTIONS = """id long, itemName string, description string, initialBid long, reserve long, dateTime timestamp, expires timestamp,
 seller long, category long, extra string"""


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", QUERIES.split())
def test_no_state_store_is_written(spark, small_folder, name):
    """A store looks up every key by itself; at 36 million bids that took more than the time there is."""
    base = spark.conf.get("spark.checkpoint.dir", None) or session._own_base()
    stores = lambda: set(glob.glob(f"{base.removeprefix('file:')}/*/checkpoint/state"))
    before = stores()
    assert entry.queries()[name](spark, small_folder).count() > 0
    assert stores() == before


def bids(spark, *minutes):
    return spark.createDataFrame([(1, i, 10, at(m), "") for i, m in enumerate(minutes)], BIDS)


def test_windows_close_once_and_late_rows_are_left_out(spark, tmp_path):
    counts = tables.HopCounts(spark, str(tmp_path), "1 hour", "30 minutes", delay="0 seconds")
    for n, minutes in enumerate([(10, 40, 70), (20, 80), (200,)]):
        for _ in range(2):  # the second time as after a failure
            counts.apply(bids(spark, *minutes), n)
    found = {(r.starttime - START).total_seconds() / 60: r.num for r in counts.read().collect()}
    # After minute 70 the windows from -30 and 0 are closed; 20 is late for both.
    assert found == {-30: 1, 0: 2, 30: 2 + 1, 60: 2}


def test_joined_equals_the_join_of_all_rows(spark, tmp_path):
    a = [(i, i % 5, i % 2) for i in range(30)]
    parts = {n: spark.createDataFrame([(x, y) for x, y, _ in a], f"k{n} long, v{n} long") for n in "abc"}

    def join(x, y, z):
        return x.join(y, F.col("va") == F.col("vb")).join(z, F.col("va") == F.col("vc"))

    joined = tables.Joined(spark, str(tmp_path), list("abc"), join)
    for n in (0, 1, 1, 2):
        joined.apply(tables.together(**{c: df.where(F.col(f"k{c}") % 3 == n) for c, df in parts.items()}), n)
    assert rows(joined.read()) == rows(join(*parts.values()))


@pytest.mark.parametrize("cuts", [(1,), (20, 50), (5, 30, 31, 70)])
def test_offers_and_winners(spark, tmp_path, cuts):
    """An auction that opens before and one that opens after the bids of other batches."""
    auction = spark.createDataFrame([(i, "", "", 1, 1, at(i * 10), at(i * 10 + 25), 7, 10, "") for i in range(8)], AUCTIONS)
    bid = spark.createDataFrame([(m % 8, m, m % 13, at(m), "") for m in range(100)], BIDS)
    whole = stream_joins.offers(auction, bid, "1 hour")
    seen, winners = [], tables.WinnersAtClose(spark, f"{tmp_path}/winners")

    def result(offers, batch_id, now):
        seen.extend(map(tuple, offers.select("id", "bidder").collect()))
        winners.apply(offers, batch_id, now)

    live = tables.Offers(spark, f"{tmp_path}/offers", "1 hour", result, "0 seconds")
    edges = [-1, *cuts, 200]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        span = (F.col("dateTime") > F.lit(at(low))) & (F.col("dateTime") <= F.lit(at(high)))
        live.apply(tables.together(auction=auction.where(span), bid=bid.where(span)), n)
    assert sorted(seen) == sorted(map(tuple, whole.select("id", "bidder").collect()))
    best = {}
    for r in sorted(whole.collect(), key=lambda r: (-r.price, r.bid_dateTime)):
        best.setdefault(r.id, r.bidder)
    last = min(auction.agg(F.max("dateTime")).first()[0], bid.agg(F.max("dateTime")).first()[0])
    closed = {r.id for r in auction.collect() if r.expires <= last}
    assert {r.id: r.bidder for r in winners.read().collect()} == {k: v for k, v in best.items() if k in closed}


def test_matches_of_a_key_cut_at_any_row(spark, tmp_path):
    prices = [9, 5, 3, 8, 7, 6, 2, 9, 9, 4, 1, 5, 6, 3, 2, 8, 1]
    bid = spark.createDataFrame([(b, at(i), i, p + b) for b in (1, 2) for i, p in enumerate(prices)], "bidder long, dateTime timestamp, id long, price long")
    micros = bid.withColumn("dateTime", F.unix_micros("dateTime"))
    pattern = match.v_shape("dateTime")
    whole = match.match_rows(micros, ["bidder"], ["dateTime", "id"], pattern)
    live = tables.Matches(spark, str(tmp_path), ["bidder"], ["dateTime", "id"], pattern, "0 seconds")
    for n, (low, high) in enumerate([(0, 1), (1, 6), (6, 12), (12, 17)]):
        for _ in range(2):
            live.apply(bid.where((F.col("id") >= low) & (F.col("id") < high)), n)
    assert rows(live.read()) == rows(whole) and whole.count()
