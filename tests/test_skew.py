"""Results do not change when hot keys are split over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from auctionstream.operators import joins, topn
from auctionstream.sources import adapter
from auctionstream.sources.sinks import discard


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def inputs(spark, small_folder):
    return {n: getattr(adapter, n)(spark, small_folder) for n in ("person", "auction", "bid")}


def hot_bids(bid):
    """A third of all bids on auction 3 and by bidder 3, some of them exact copies."""
    third = F.col("id") % 3 == 0
    hot = bid.withColumns({c: F.when(third, 3).otherwise(F.col(c)).cast("bigint") for c in ("auction", "bidder")})
    return hot.unionByName(hot.where("id < 30"))


SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


@pytest.mark.parametrize("name", ["q4", "q6", "q9", "q23"])
def test_skewed_joins_are_split_and_keep_their_rows(spark, inputs, name):
    person, auction, bid = inputs["person"], inputs["auction"], hot_bids(inputs["bid"]).repartition(8)
    run = {
        "q4": lambda: joins.q4_category_average(auction, bid),
        "q6": lambda: topn.winners_per_auction(auction, bid),
        "q9": lambda: topn.q9_winning_bids(auction, bid),
        "q23": lambda: joins.q23_three_way(bid, person, auction),
    }[name]
    whole = rows(run())
    try:
        for k, v in SPLITTING.items():
            spark.conf.set(k, v)
        split = run()
        assert rows(split) == whole
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in SPLITTING:
            spark.conf.unset(k)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_moving_average_over_ranges(spark, partitions):
    random.seed(4)
    values = [(i % 7 % 3 if i % 11 else None, i * i % 1009, i, random.choice([None, -7, 3, 2**53 + 1, i])) for i in range(400)]
    df = spark.createDataFrame(values, "k long, t long, id long, v long")
    expected = []
    for key in {r[0] for r in values}:
        own = sorted((r for r in values if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            known = [x[3] for x in own[max(0, i - 10) : i + 1] if x[3] is not None]
            total = sum(known)
            expected.append((*r, (abs(total) // len(known)) * (1 if total >= 0 else -1) if known else None))
    found = topn.moving_average(df, "k", ["t", "id"], "v", 10, "m", partitions)
    assert rows(found) == sorted(expected, key=str)


def test_bursts_fill_several_ranges(spark):
    """A key with nearly all rows in an instant is cut by rows, not by time."""
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("k"), (F.col("id") < 9_990).cast("long").alias("t"), "id", F.col("id").alias("v"))
    from auctionstream.plans.ranges import PART, in_ranges

    cut = in_ranges(df, ["k"], ["t", "id"], lambda table, groups: {"n": [table.num_rows]}, "n long", "sizes", 10)
    sizes = [r.n for r in cut.collect()]
    assert len(sizes) > 5 and max(sizes) < 3_000
    assert cut.select(PART).distinct().count() == len(sizes)
    discard(topn.moving_average(df, "k", ["t", "id"], "v", 10, "m", 10))


@pytest.mark.parametrize("portion", [12, 90])
def test_a_task_holds_a_portion_of_its_partition(spark, inputs, monkeypatch, portion):
    """Patterns and the moving average have the same rows, however a partition is cut."""
    from auctionstream.operators import patterns
    from auctionstream.plans import ranges

    bid = hot_bids(inputs["bid"])
    keys = {"keys": ["auction"], "tie": ["id", "bidder"], "partitions": 2}
    kinds = [patterns.cep0_v_shape, patterns.cep1_low_average, patterns.cep2_low_average_overlapping]
    run = lambda: [
        *[rows(f(bid, **keys)) for f in kinds], rows(patterns.cep3_drop(bid, within="10 days", **keys)),
        rows(topn.moving_average(bid.select("auction", "dateTime", "id", "price"), "auction", ["dateTime", "id", "price"], "price", 10, "m", 2)),
    ]
    whole = run()
    assert all(whole)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", max(1, portion // 4))
        monkeypatch.setattr(ranges, "PORTION", portion)
        sizes = ranges.in_ranges(bid, ["auction"], ["id"], lambda table, groups: {"n": [table.num_rows]}, "n long", "sizes", 2)
        assert max(r.n for r in sizes.collect()) <= portion + max(1, portion // 4)
        assert run() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
