"""Event generator, views, codec and sinks."""

import datetime
import glob
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from auctionstream import schemas
from auctionstream.functions import scalar
from auctionstream.operators import joins, projections
from auctionstream.session import work_folder
from auctionstream.sources import events, sinks, tables, topics
from auctionstream.streaming.run import NOW, finish, run_append, stream_files

CONFIG = events.EventConfig()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("config", [
    CONFIG,
    events.EventConfig(person_share=30, auction_share=15, bid_share=5, person_size=1000, auction_size=5000,
                       bid_size=8000, hot_auctions=3, hot_bidders=5, hot_sellers=8, in_flight_auctions=777),
    events.EventConfig(group_size=1000, delay_probability=0.1, person_share=2, auction_share=25, bid_share=73),
])
def test_typed_equals_union(spark, config):
    numbers = events.numbers(spark, 500, config, 1)
    union = tables.union_views(events.union_events(numbers, config))
    typed = {e: events.typed_events(numbers, e, config) for e in tables.ENTITIES}
    views = tables.typed_views(**typed)
    for entity in tables.ENTITIES:
        assert rows(union[entity]) == rows(views[entity])
    assert rows(joins.q20_expand_bids(union["bid"], union["auction"])) == rows(
        joins.q20_expand_bids(views["bid"], views["auction"]))
    assert views["bid_modified"].columns[0] == "id"


def test_no_bids(spark):
    config = events.EventConfig(person_share=1, auction_share=9, bid_share=0)
    union = events.union_events(events.numbers(spark, 100, config), config)
    assert {r.event_type: r["count"] for r in union.groupBy("event_type").count().collect()} == {0: 10, 1: 90}


def test_shares_ids_and_ranges(spark):
    numbers = events.numbers(spark, 50_000, partitions=3)
    union = events.union_events(numbers)
    counts = {r.event_type: r["count"] for r in union.groupBy("event_type").count().collect()}
    assert counts == {0: 1000, 1: 3000, 2: 46_000}
    auction, bid = events.typed_events(numbers, "auction"), events.typed_events(numbers, "bid")
    a = auction.agg(F.min("id"), F.max("id"), F.countDistinct("id"), F.min("category"), F.max("category"),
                    F.min(F.col("expires") > F.col("dateTime"))).first()
    assert (a[1] - a[0] + 1, a[2:]) == (3000, (3000, 10, 14, True))
    b = bid.agg(
        F.min("price"), F.max("price"), F.avg((F.col("auction") % 100 == 0).cast("int")),
        F.avg((F.col("bidder") % 100 == 1).cast("int")), F.min("bidder"), F.avg(F.length("extra")),
        F.avg(F.col("channel").startswith("channel-").cast("int")),
    ).first()
    assert 100 <= b[0] and b[1] <= 10**8 and b[4] >= 2000
    assert (abs(b[2] - 0.5) < 0.02, abs(b[3] - 0.75) < 0.02, abs(b[5] - 68) < 2, abs(b[6] - 0.5) < 0.02) == (True,) * 4
    urls = bid.groupBy("channel").agg(F.countDistinct("url").alias("n"))
    assert urls.agg(F.max("n")).first()[0] == 1
    clean = events.typed_events(numbers, "bid", replace(CONFIG, bidder_offset=events.FIRST_PERSON_ID))
    person = events.typed_events(numbers, "person").select(F.col("id").alias("bidder"))
    unknown = clean.join(person, "bidder", "left_anti").count()
    assert unknown < 0.05 * clean.count()  # only bidders that are still to come


def test_independent_of_partitions(spark):
    one, many = (events.union_events(events.numbers(spark, 700, partitions=p)) for p in (1, 7))
    assert rows(one) == rows(many)


def test_disorder_is_a_permutation_within_groups(spark):
    config = events.EventConfig(group_size=10, first_event_number=0, first_event_id=0)
    ids = events.with_identity(events.numbers(spark, 100, config), config).select("k", "_id").collect()
    assert sorted(r._id for r in ids) == list(range(100))
    assert all(r.k // 10 == r._id // 10 for r in ids) and any(r.k != r._id for r in ids)
    times = events.with_times(events.with_identity(events.numbers(spark, 100, config), config), config)
    assert times.where("dateTime < lowWaterMark").count() == 0


def test_delay_moves_arrival_only(spark):
    config = events.EventConfig(delay_probability=0.3)
    union = events.union_events(events.numbers(spark, 5000, config), config)
    seconds = (F.unix_millis("arrival") - F.unix_millis("dateTime")) / 1000
    r = union.select(
        F.max(F.when(F.col("event_type") == 0, seconds)), F.min(F.when(seconds > 0, seconds)), F.max(seconds),
        F.avg((seconds > 0).cast("int")),
    ).first()
    assert r[0] == 0 and r[1] >= 60 and r[2] <= 240 and abs(r[3] - 0.3) < 0.03


def test_resume_continues_the_sequence(spark):
    whole = events.union_events(events.numbers(spark, 100))
    rest = events.resume_at(CONFIG, 60)
    parts = events.union_events(events.numbers(spark, 60)).union(events.union_events(events.numbers(spark, 40), rest))
    assert rows(whole) == rows(parts)


def test_timelines_run_in_parallel(spark):
    config = events.EventConfig(timelines=4)
    out = events.with_identity(events.numbers(spark, 102, config), config, 102).select("_id", "_millis")
    assert len({r._id for r in out.collect()}) == 102
    assert out.groupBy("_millis").count().agg(F.max("count")).first()[0] >= 4
    with pytest.raises(ValueError):
        events.with_identity(events.numbers(spark, 10, config), config)


def test_estimated_bytes():
    assert CONFIG.estimated_bytes(50) == 200 + 3 * 500 + 46 * 100


def test_micro_batch_source_is_a_stream(spark):
    stream = events.union_events(events.stream_numbers(spark, 50))
    assert stream.isStreaming and stream.columns[0] == "event_type"


def test_topic_round_trip_and_deletes(spark):
    union = events.union_events(events.numbers(spark, 200)).select("event_type", "person", "auction", "bid")
    assert rows(topics.from_topic(topics.to_topic(union))) == rows(union)
    person = events.typed_events(events.numbers(spark, 200), "person")
    keyed = topics.to_keyed_topic(person, ["id"])
    assert "id" not in keyed.first().value.split(":")[0]
    assert rows(topics.from_keyed_topic(keyed, schemas.PERSON, ["id"])) == rows(person)
    log = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "1", 2), ("b", None, 3)], "key string, value string, offset bigint")
    assert rows(topics.latest_per_key(log)) == [("a", "2")]
    assert topics.consumer_options("h:1", "t", 5)["maxOffsetsPerTrigger"] == "5"


def test_log_partitions_and_success_files(spark):
    bid = events.typed_events(events.numbers(spark, 3000, replace(CONFIG, rate=10)), "bid", replace(CONFIG, rate=10))
    log, path = projections.q10_log(bid), work_folder(spark, "log")
    sinks.write_log(log, path)
    folders = glob.glob(f"{path}/dt=*/hm=*")
    assert len(folders) == 6 and all(os.path.exists(f"{f}/_SUCCESS") for f in folders)
    assert any("%3A" in f for f in folders)
    assert rows(sinks.read_log(spark, path, log.schema)) == rows(log)


def test_log_stream_commits_behind_the_watermark(spark):
    base, config = work_folder(spark, "log-stream"), replace(CONFIG, rate=10)
    numbers = events.numbers(spark, 3000, config)
    numbers.write.parquet(f"{base}/numbers")
    stream = events.typed_events(stream_files(spark, f"{base}/numbers", numbers.schema), "bid", config)
    finish(sinks.write_log_stream(projections.q10_log(stream), f"{base}/log", f"{base}/checkpoint", **NOW))
    middle = datetime.datetime(2023, 11, 14, 22, 16)
    done = sinks.commit_partitions(spark, f"{base}/log", middle)
    assert done and max(done) == "2023-11-14 22:15"
    assert len(done) + len(sinks.commit_partitions(spark, f"{base}/log")) == 6


def test_repeated_batch_replaces_its_rows(spark):
    base = work_folder(spark, "batches")
    numbers = events.numbers(spark, 300)
    numbers.write.parquet(f"{base}/numbers")
    stream = stream_files(spark, f"{base}/numbers", numbers.schema)
    for checkpoint in ("a", "b"):  # the same batch ids again
        finish(sinks.write_many_stream(stream, {f"{base}/even": lambda b: b.where("k % 2 = 0")}, f"{base}/{checkpoint}", **NOW))
    assert spark.read.parquet(f"{base}/even").count() == 150


def test_side_table_csv(spark):
    path = work_folder(spark, "side")
    tables.write_side_csv(spark, path, 20)
    assert rows(tables.read_side_csv(spark, path)) == rows(tables.side_rows(spark, 20))


def test_two_sources_one_stream_result(spark):
    base = work_folder(spark, "v2")
    numbers = events.numbers(spark, 400)
    numbers.write.parquet(f"{base}/numbers")
    stream = stream_files(spark, f"{base}/numbers", numbers.schema)
    assert rows(run_append(events.typed_events(stream, "bid"))) == rows(
        events.typed_events(numbers, "bid").withColumn("dateTime", F.col("dateTime").cast("timestamp_ntz")))


def test_log_is_committed_while_the_stream_runs(spark):
    import time

    base = work_folder(spark, "log-watermark")
    begin = datetime.datetime(2024, 1, 1, 23, 50)
    minutes = [[0, 1, 2], [5, 6], [1, 14], [20]]  # the third file brings a late row
    for part in minutes:
        rows_ = [(begin + datetime.timedelta(minutes=m), m) for m in part]
        spark.createDataFrame(rows_, "dateTime timestamp, id long").coalesce(1).write.mode("append").parquet(f"{base}/rows")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = stream_files(spark, f"{base}/rows", "dateTime timestamp, id long").withWatermark("dateTime", "1 minute")
    log = stream.select("id", scalar.day_of(F.col("dateTime")).alias("dt"), scalar.minute_of(F.col("dateTime")).alias("hm"))
    finish(sinks.write_log_stream(log, f"{base}/log", f"{base}/checkpoint", **NOW))

    def committed():
        return len(glob.glob(f"{base}/log/dt=*/hm=*/_SUCCESS"))

    deadline = time.time() + 20
    while committed() < 5 and time.time() < deadline:
        time.sleep(0.2)
    # The watermark reached 00:03 or later: minutes 50, 51, 52, 55 and 56 are done, the last is not.
    assert 5 <= committed() <= 6
    assert not glob.glob(f"{base}/log/dt=2024-01-02/hm=00%3A10/_SUCCESS")
    assert spark.read.schema("id long, dt string, hm string").csv(f"{base}/log").count() == 8
    assert len(sinks.commit_partitions(spark, f"{base}/log")) >= 1
