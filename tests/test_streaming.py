"""Streams in several micro-batches: equal to the batch result, late rows, resuming, state operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from auctionstream.operators import match, topn, windows
from auctionstream.session import ROCKSDB, work_folder
from auctionstream.sources import adapter, events, tables
from auctionstream.streaming import aggregates, joins, stateful, windows as stream_windows
from auctionstream.streaming.run import plain_times, run_append, run_update, stream_files


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def bids(spark, small_folder):
    """Driver bids in four files in order of time, one micro-batch each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = work_folder(spark, "stream-bids")
    bid = adapter.with_event_time(adapter.bid(spark, small_folder))
    for part in range(4):
        bid.where(F.floor(F.col("id") / 250) == part).coalesce(1).write.mode("append").parquet(base)
    return base, bid


def stream(spark, bids, delay="4 seconds"):
    return tables.with_watermark(stream_files(spark, bids[0], bids[1].schema), delay)


def test_windows_in_many_batches(spark, bids):
    last = bids[1].agg(F.max("dateTime") - F.expr("INTERVAL 4 SECONDS")).first()[0]
    batch = windows.with_bounds(windows.hop_counts(bids[1], "1 hour", "15 minutes")).where(F.col("endtime") <= F.lit(last))
    out = run_append(stream_windows.hopping_counts(stream(spark, bids), "1 hour", "15 minutes"))
    assert rows(out) == rows(plain_times(batch))


def test_sessions_in_many_batches(spark, bids):
    last = bids[1].agg(F.max("dateTime") - F.expr("INTERVAL 4 SECONDS")).first()[0]
    batch = windows.q11_user_sessions(bids[1], "6 hours").where(F.col("endtime") <= F.lit(last))
    assert rows(run_append(stream_windows.session_counts(stream(spark, bids), "6 hours"))) == rows(plain_times(batch))


def test_updating_top_n_in_many_batches(spark, bids):
    columns = bids[1].drop("id").withColumn("auction", F.col("auction") % 20)
    live = stream(spark, bids).drop("id").withColumn("auction", F.col("auction") % 20)
    top = stateful.top_n(live, ["auction"], [("price", False), ("dateTime", True)], 3)
    assert rows(run_update(top, ["auction", "rank_number"])) == rows(plain_times(topn.q19_top_bids(columns, 3)))


def test_changelog_replays_to_the_result(spark, bids):
    live = stream(spark, bids).select("auction", "price", "dateTime").withColumn("auction", F.col("auction") % 5)
    top = stateful.top_n(live, ["auction"], [("price", False)], 2, changelog=True)
    from auctionstream.sources.sinks import write_batches
    from auctionstream.streaming.run import NOW, finish

    base = work_folder(spark, "changelog")
    finish(write_batches(top, f"{base}/rows", f"{base}/checkpoint", mode="update", **NOW))
    sign = F.when(F.col("op") == "+I", 1).otherwise(-1)
    state = spark.read.parquet(f"{base}/rows").groupBy("auction", "price", "rank_number").agg(F.sum(sign).alias("n"))
    batch = topn.top_n(
        bids[1].select((F.col("auction") % 5).alias("auction"), "price", "dateTime"), ["auction"],
        [F.col("price").desc()], 2, rank="rank_number").select("auction", "price", "rank_number")
    assert rows(state.where("n = 1").drop("n")) == rows(batch)
    assert state.where("n NOT IN (0, 1)").count() == 0


def test_patterns_in_many_batches(spark, bids):
    """Each batch releases rows to the matcher; nothing is lost or matched twice."""
    pattern = match.v_shape("dateTime")
    live = stream(spark, bids).select("bidder", "dateTime", "id", "price")
    out = run_append(stateful.match_rows(live, ["bidder"], ["dateTime", "id"], pattern))
    passed = bids[1].where(F.col("dateTime") <= F.lit(bids[1].agg(F.max("dateTime") - F.expr("INTERVAL 4 SECONDS")).first()[0]))
    whole = match.match_rows(
        passed.select("bidder", F.unix_micros("dateTime").alias("dateTime"), "id", "price"), ["bidder"], ["dateTime", "id"], pattern)
    assert rows(out) == rows(whole)


def open_pattern(spark, ttl):
    """A run that never ends, then, a day later, rows of another bidder that move the watermark on."""
    base = work_folder(spark, "open")
    start = datetime.datetime(2024, 1, 1)
    first = [(1, start + datetime.timedelta(seconds=i), i, p) for i, p in enumerate([100, 50_000, 100, 9_000, 20_000, 100])]
    first[:2] = [(1, start, 0, 1), (1, start + datetime.timedelta(seconds=1), 1, 2)]
    schema = "bidder bigint, dateTime timestamp, id bigint, price bigint"
    for part in (first, [(2, start + datetime.timedelta(days=1), 9, 1)], [(2, start + datetime.timedelta(days=2), 10, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(base)
    live = tables.with_watermark(stream_files(spark, base, spark.read.parquet(base).schema))
    pattern = match.low_average(limit=10_000, time="dateTime")
    return run_append(stateful.match_rows(live, ["bidder"], ["dateTime", "id"], pattern, ttl)).count()


def test_open_attempt_holds_back_until_its_time_to_live(spark):
    assert open_pattern(spark, None) == 0
    assert open_pattern(spark, 3_600_000_000) == 1


def test_late_rows_by_generator(spark):
    """Bids in order of arrival: those more than the allowed delay behind a closed window are dropped."""
    config = events.EventConfig(rate=5, delay_probability=0.2, delay_min=100, delay_max=200)
    base = work_folder(spark, "arrivals")
    bids = events.typed_events(events.numbers(spark, 2000, config), "bid", config, with_arrival=True).coalesce(1)
    bids = bids.select("id", "dateTime", "arrival").orderBy("arrival")
    # Rows count as late against the watermark that the batch before last has set.
    cuts = bids.agg(F.percentile_approx("arrival", [0.2, 0.4, 0.6, 0.8]).alias("p")).first().p
    for low, high in zip([datetime.datetime(2000, 1, 1), *cuts], [*cuts, datetime.datetime(2100, 1, 1)]):
        part = bids.where((F.col("arrival") > F.lit(low)) & (F.col("arrival") <= F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(base)
    counts = {}
    for delay in ("0 seconds", "300 seconds"):
        live = tables.with_watermark(stream_files(spark, base, bids.schema), delay)
        out = run_append(stream_windows.closed_counts(live, "10 seconds"))
        counts[delay] = {r.starttime: r.bid_count for r in out.collect()}
    full = {r.starttime: r.bid_count for r in plain_times(windows.with_bounds(
        bids.groupBy(windows.tumble("10 seconds").alias("window")).agg(F.count("*").alias("bid_count")))).collect()}
    patient, strict = counts["300 seconds"], counts["0 seconds"]
    assert patient and all(full[k] == n for k, n in patient.items())
    assert any(full[k] > n for k, n in strict.items())
    assert all(full[k] >= n for k, n in strict.items())


def test_salted_offers_equal_plain(spark, small_folder):
    def live(entity):
        return tables.with_watermark(adapter.stream_of(spark, small_folder, entity))

    plain = run_append(joins.offers(live("auction"), live("bid"), "10 days"))
    salted = run_append(joins.offers(live("auction"), live("bid"), "10 days", salts=4))
    assert rows(plain) == rows(salted) and plain.count()


def test_expiring_join_forgets(spark, small_folder):
    a = tables.with_watermark(adapter.stream_of(spark, small_folder, "auction")).select("id", F.col("dateTime").alias("at"))
    b = tables.with_watermark(adapter.stream_of(spark, small_folder, "bid")).select("auction", "dateTime")
    out = run_append(joins.expiring(b, a, F.col("auction") == F.col("id"), "dateTime", "at", "2 days"))
    x, y = (adapter.with_event_time(getattr(adapter, n)(spark, small_folder)) for n in ("bid", "auction"))
    whole = x.select("auction", "dateTime").join(y.select("id", F.col("dateTime").alias("at")), F.col("auction") == F.col("id"))
    near = whole.where("dateTime BETWEEN at - INTERVAL 2 DAYS AND at + INTERVAL 2 DAYS")
    assert rows(out) == rows(plain_times(near)) and near.count()


def test_repeats_within_the_delay_are_dropped(spark, bids):
    live = stream_files(spark, bids[0], bids[1].schema)
    twice = tables.with_watermark(live.unionByName(live), "1 day")
    assert rows(run_append(aggregates.unique_rows(twice, ["id"]))) == rows(plain_times(bids[1]))
