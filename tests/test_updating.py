"""Keyed tables and the updating results that streams keep in them, after every micro-batch."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from auctionstream.operators import aggregates, joins as batch_joins, topn
from auctionstream.session import work_folder
from auctionstream.sources import adapter, keyed, sinks, tables
from auctionstream.streaming import joins, updating
from auctionstream.streaming.run import plain_times, stream_files


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def batches_of(spark, frames):
    """A stream that takes one frame per micro-batch."""
    path = work_folder(spark, "frames")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return stream_files(spark, path, frames[0].schema)


def run(stream, result, mode="append"):
    query = stream.writeStream.foreachBatch(result.apply).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", work_folder(stream.sparkSession, "check")).start().awaitTermination()


BIDS = "id long, auction long, bidder long, price long, channel string, dateTime timestamp, weight int"


def some_bids(seed, n, live):
    """Bids, a third of them on one auction by one bidder; some that were placed before are taken back."""
    rng, start, out = random.Random(seed), datetime.datetime(2024, 1, 1), []
    for i in range(n):
        if live and rng.random() < 0.3:
            out.append((*live.pop(rng.randrange(len(live))), -1))
            continue
        hot = rng.random() < 0.33
        who = [1, 1] if hot else [rng.choice([*range(12), None]), rng.choice([*range(9), None])]
        price = rng.choice([5, 9_999, 10_000, 999_999, 1_000_000, None])
        bid = (seed * 1000 + i, *who, price, rng.choice(["a", "b", None]), start + datetime.timedelta(minutes=rng.randrange(4_000)))
        if live is not None:
            live.append(bid)
        out.append((*bid, 1))
    return out


@pytest.mark.parametrize("by_channel, taken_back", [(False, False), (True, False), (False, True), (True, True)])
def test_reports_equal_the_batch_query_after_every_batch(spark, by_channel, taken_back):
    live, parts = [], []
    for seed in range(5):
        part = some_bids(seed, 60, live if taken_back else None)
        parts.append(part)
    if taken_back:
        parts.append([(*bid, -1) for bid in live if bid[4] == "a" or bid[1] == 1])  # a channel and a hot auction end
    frames = [spark.createDataFrame(p, BIDS) for p in parts]
    report = updating.BidReport(spark, work_folder(spark, "report"), by_channel, "weight" if taken_back else None, 3)
    run(batches_of(spark, frames), report)
    query = aggregates.q16_channel_report if by_channel else aggregates.q15_daily_report
    sofar = []
    for version, part in enumerate(parts):
        for *bid, weight in part:
            sofar.append(tuple(bid)) if weight > 0 else sofar.remove(tuple(bid))
        batch = query(spark.createDataFrame([(*b, 1) for b in sofar], BIDS))
        assert rows(report.read(version)) == rows(batch), version
    assert report.report.versions() == list(range(len(parts)))


def test_a_batch_that_runs_again_changes_nothing(spark):
    frames = [spark.createDataFrame(some_bids(s, 40, None), BIDS) for s in range(3)]
    report = updating.BidReport(spark, work_folder(spark, "report"), True)
    for n, frame in enumerate(frames):
        report.apply(frame, n)
        report.apply(frame, n)
    # The run stops between the two tables: the second takes its changes from the first one's versions.
    torn = updating.BidReport(spark, work_folder(spark, "report"), True)
    merge = torn.report.merge
    for n, frame in enumerate(frames):
        torn.report.merge = lambda *a: None
        torn.apply(frame, n)
        torn.report.merge = merge
        torn.apply(frame, n)
    assert rows(report.read()) == rows(torn.read()) == rows(aggregates.q16_channel_report(frames[0].union(frames[1]).union(frames[2])))


def test_category_average_equals_the_batch_query_after_every_batch(spark):
    rng = random.Random(4)
    schema = "id long, category long, price long"
    parts = [[(a := rng.randrange(30), a % 4, rng.choice([None, rng.randrange(1000)])) for _ in range(50)] for _ in range(5)]
    parts[2] += [(1, 1, 7)] * 200
    parts.append([(100, 9, None)])  # an offer without a price
    average = updating.CategoryAverage(spark, work_folder(spark, "average"), 3)
    run(batches_of(spark, [spark.createDataFrame(p, schema) for p in parts]), average)
    for version in range(len(parts)):
        best = {}
        for a, c, price in [x for p in parts[: version + 1] for x in p]:
            best[a, c] = max([p for p in (best.get((a, c)), price) if p is not None], default=None)
        finals = {c: [v for (_, k), v in best.items() if k == c and v is not None] for _, c in best}
        assert rows(average.read(version)) == sorted([(c, sum(v) // len(v) if v else None) for c, v in finals.items()], key=str)


def test_category_average_of_joined_streams(spark, small_folder):
    a, b = (tables.with_watermark(adapter.stream_of(spark, small_folder, e)) for e in ("auction", "bid"))
    average = updating.CategoryAverage(spark, work_folder(spark, "average"))
    run(joins.offers(a, b, "10 days"), average)
    batch = batch_joins.q4_category_average(adapter.auction(spark, small_folder), adapter.bid(spark, small_folder))
    assert rows(average.read()) == rows(batch) and len(average.totals.versions()) > 3


def test_top_rows_of_many_keys_after_every_batch(spark):
    """Eight micro-batches over 20,000 keys; a third of the rows have one key. The changes replay to the result."""
    schema = "auction long, bidder long, price long, channel string, url string, dateTime timestamp, extra string"
    bids = spark.range(48_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 10_000).alias("auction"), (F.col("id") % 50).alias("bidder"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 7_919 % 1_000).alias("price"), F.lit("c").alias("channel"), F.lit("u").alias("url"),
        F.timestamp_seconds(F.col("id") * 31 % 9_000).alias("dateTime"), F.col("id").cast("string").alias("extra"),
    )
    parts = [bids.where(F.col("extra").cast("long") % 8 == n) for n in range(8)]
    top = updating.TopRows(spark, work_folder(spark, "top"), bids.schema, ["auction"], [("price", False), ("dateTime", True)], 3, changelog=True)
    run(batches_of(spark, parts), top)
    assert bids.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    for version in (0, 3, 7):
        sofar = bids.where(F.col("extra").cast("long") % 8 <= version)
        assert rows(top.read(version)) == rows(topn.q19_top_bids(sofar, 3))
    sign = F.when(F.col("op") == "+I", 1).otherwise(-1)
    final = top.read()
    replayed = top.changes().groupBy(*final.columns).agg(F.sum(sign).alias("n"))
    assert replayed.where("n NOT IN (0, 1)").count() == 0 and rows(replayed.where("n = 1").drop("n")) == rows(final)


def test_only_touched_buckets_are_rewritten(spark):
    table = keyed.KeyedTable(spark, work_folder(spark, "keyed"), "k long, v long", ["k"], 50)
    add = lambda old, new: old.union(new).groupBy("k").agg(F.sum("v").alias("v"))
    table.merge(0, spark.range(500).selectExpr("id AS k", "1 AS v"), add)
    table.merge(1, spark.createDataFrame([(3, 1), (3, 1), (4, 1)], "k long, v long"), add)
    first, second = (table._manifest(v)["folders"] for v in (0, 1))
    assert len(first) == 50 and sum(first[b] != second[b] for b in first) == 2
    assert dict(map(tuple, table.read().collect())) == {k: {3: 3, 4: 2}.get(k, 1) for k in range(500)}
    assert table.read(0).agg(F.sum("v")).first()[0] == 500
    table.merge(2, spark.createDataFrame([], "k long, v long"), add)
    assert table.read().count() == 500


def test_upserts_and_deletions_with_a_reader_beside_them(spark, tmp_path):
    """Twenty micro-batches with deletions and late rows, while another thread reads: it always meets whole versions."""
    schema = "k long, at long, v long, gone boolean"
    rng, frames, newest, history = random.Random(8), [], {}, []
    for n in range(20):
        part = [(rng.randrange(15), n * 10 - rng.choice([0, 0, 25]), n, rng.random() < 0.2) for _ in range(12)]
        part = list({(k, at): (k, at, v, gone) for k, at, v, gone in part}.values())
        for k, at, v, gone in part:
            if k not in newest or at >= newest[k][0]:
                newest[k] = (at, v, gone)
        frames.append(spark.createDataFrame(part, schema))
        history.append(sorted((k, at, v) for k, (at, v, gone) in newest.items() if not gone))
    stream, table = batches_of(spark, frames), str(tmp_path / "table")
    options = {"keys": ["k"], "order": ["at"], "deleted": "gone"}
    query = sinks.write_upserts(stream, table, str(tmp_path / "check"), mode="append", availableNow=True, **options)
    seen, errors = [], []

    def read():
        while query.isActive:
            try:
                seen.append(sorted(map(tuple, sinks.read_upserts(spark, table, stream.schema, ["k"], deleted="gone").collect())))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    query.awaitTermination()
    reader.join()
    assert not errors and seen and all(x == [] or x in history for x in seen)
    for version in (0, 7, 19):
        found = sinks.read_upserts(spark, table, stream.schema, ["k"], deleted="gone", version=version)
        assert sorted(map(tuple, found.collect())) == history[version]


def test_old_versions_are_removed(spark):
    table = keyed.KeyedTable(spark, work_folder(spark, "keyed"), "k long", ["k"], 2, datetime.timedelta(0))
    for n in range(6):
        table.merge(n, spark.range(n, n + 3).selectExpr("id AS k"), lambda old, new: old.union(new).distinct())
        import time

        time.sleep(1.1)  # times of files may be whole seconds
    assert len(table.versions()) <= 2 and sorted(r.k for r in table.read().collect()) == list(range(8))
    folders = table._fs.listStatus(table._hadoop.Path(f"{table.path}/data"))
    assert len(folders) <= 6
