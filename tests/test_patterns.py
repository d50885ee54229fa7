"""Named pattern queries, whole and split, against the general matcher and hand-made rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from auctionstream.operators import match, patterns

BASE = datetime.datetime(2024, 1, 1)
PATTERNS = {
    "cep0": (patterns.cep0_v_shape, match.v_shape()),
    "cep1": (patterns.cep1_low_average, match.low_average()),
    "cep2": (patterns.cep2_low_average_overlapping, match.low_average(skip=match.TO_NEXT_ROW)),
    "cep3": (patterns.cep3_drop, match.drop_within()),
}
SCHEMA = "auction bigint, bidder bigint, dateTime timestamp, id bigint, price bigint"


def bids(spark, prices, millis=100, key=1):
    rows = [
        (key, key, BASE + datetime.timedelta(milliseconds=millis * i), i, p) for i, p in enumerate(prices)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_bids(spark, seed, sizes, low, high):
    r, rows, n = random.Random(seed), [], 0
    for key, size in enumerate(sizes):
        ms = 0
        for _ in range(size):
            ms += r.choice([0, 1, 200, 900, 1500, 4000])
            rows.append((key, key % 2, BASE + datetime.timedelta(milliseconds=ms), n, r.randint(low, high)))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def general(df, pattern):
    rows = df.select("auction", "bidder", F.unix_micros("dateTime").alias("micros"), "id", "price")
    out = match.match_rows(rows, ["auction", "bidder"], ["micros", "id"], pattern)
    times = [c for c in out.columns if c.endswith(("tstamp", "time"))]
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


RANGES = {"cep0": (1, 12), "cep1": (1, 20_000), "cep2": (1, 20_000), "cep3": (1, 160)}


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("name", PATTERNS)
def test_whole_and_split_equal_general(spark, name, seed):
    operator, pattern = PATTERNS[name]
    df = random_bids(spark, seed, [1, 2, 3, 40, 0, 150, 400], *RANGES[name]).coalesce(2)
    expected = rows_of(general(df, pattern))
    assert expected
    assert rows_of(operator(df, tie=["id"])) == expected
    for per_task in (5, 29):
        assert rows_of(operator(df, tie=["id"], partitions=600 // per_task)) == expected


@pytest.mark.parametrize("name", PATTERNS)
def test_rows_wider_than_a_batch(spark, name):
    operator, pattern = PATTERNS[name]
    df = random_bids(spark, 9, [30, 30, 200], *RANGES[name])
    expected = rows_of(general(df, pattern))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(operator(df, tie=["id"])) == expected
        assert rows_of(general(df, pattern)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_low_runs_cross_many_slices(spark):
    """Runs that open early and close in the last slice, with the average near the limit."""
    prices = [9_990] * 60 + [10_000] * 20 + [9_000] * 40 + [10_050] * 70 + [500_000] + [1] * 30
    df = bids(spark, prices)
    for name in ("cep1", "cep2"):
        operator, pattern = PATTERNS[name]
        expected = rows_of(general(df, pattern))
        assert expected
        assert rows_of(operator(df, tie=["id"], partitions=len(prices) // 10)) == expected


@pytest.mark.parametrize("name, prices, matches", [
    ("cep0", [10, 8, 6, 9], 1),
    ("cep0", [10, 8, 9], 0),  # one fall only
    ("cep0", [10, 8, 6, 7], 0),  # 7 is not above 8
    ("cep0", [10, 8, 6, 9, 7, 5, 8], 2),  # the rise starts the next run
    ("cep1", [5_000, 9_000, 30_000], 1),
    ("cep1", [5_000, 9_000], 0),  # the run never ends
    ("cep1", [20_000, 5_000, 15_000, 5_000, 40_000], 2),
    ("cep2", [5_000, 9_000, 30_000], 2),
    ("cep3", [100, 60, 40], 1),
    ("cep3", [100, 50], 0),  # equal ends the attempt without a match
    ("cep3", [100, 60, 40, 100, 50, 30], 1),
])
def test_hand_made(spark, name, prices, matches):
    operator, pattern = PATTERNS[name]
    df = bids(spark, prices)
    assert operator(df, tie=["id"]).count() == matches
    assert general(df, pattern).count() == matches


def test_integer_average_and_times(spark):
    out = patterns.cep1_low_average(bids(spark, [1, 2, 50_000])).first()
    assert (out.avg_price, out.end_tstamp - out.start_tstamp) == (1, datetime.timedelta(milliseconds=100))


def test_drop_must_be_within_five_seconds(spark):
    assert patterns.cep3_drop(bids(spark, [100, 40], millis=4_999)).count() == 1
    assert patterns.cep3_drop(bids(spark, [100, 40], millis=5_000)).count() == 0


@pytest.mark.parametrize("name", PATTERNS)
@pytest.mark.parametrize("prices", [
    [5_000, None, 9_000, 30_000, 20], [None, 5_000, None, None, 20_000], [-1, -2, 50_000, -7, None], [None] * 4,
    [2**53 + 3, 2**53 + 1, 2**53, 2**53 + 2, None, 5, 4, 3, 6], [100, 60, None, 40, 30], [-100, -160, -170, -90, 99_999],
    [9_000, None, 9_001, None, None, 10_500, 12_000, 8_000, None],
])
def test_nulls_signs_and_large_prices(spark, name, prices):
    """Operator, split or not, and general matcher agree."""
    operator, pattern = PATTERNS[name]
    df = bids(spark, prices)
    expected = rows_of(general(df, pattern))
    assert rows_of(operator(df, tie=["id"], partitions=3)) == expected


def test_averages_are_cut_towards_zero(spark):
    assert patterns.cep1_low_average(bids(spark, [-1, -2, 50_000])).first().avg_price == -1
    assert patterns.cep1_low_average(bids(spark, [7, None, 50_000])).first().avg_price == 7


def next_lower(values, levels):
    """Brute force: the first later place at or below the level."""
    return [next((j for j in range(i + 1, len(values)) if values[j] <= levels[i]), None) for i in range(len(values))]


def expected_drops(prices, drop):
    out, free = [], 0
    for i, j in enumerate(next_lower(prices, [p - drop for p in prices])):
        if i >= free and j is not None and prices[j] < prices[i] - drop:
            out.append((j, prices[i] - prices[j]))
            free = j + 1
    return out


def expected_runs(prices, limit, overlapping):
    sums = [0]
    for p in prices:
        sums.append(sums[-1] + p - limit)
    out, free = [], 0
    for i, p in enumerate(prices):
        if p < limit and (overlapping or i >= free):
            j = next((j for j in range(i + 1, len(prices)) if sums[j + 1] >= sums[i]), None)
            if j is not None:
                total = sum(prices[i:j])
                out.append((i, j - 1, abs(total) // (j - i) * (1 if total >= 0 else -1)))
                free = j + 1
    return out


SHAPES = {
    "falling": lambda r, n: [3 * (n - i) + r.randint(-40, 40) for i in range(n)],
    "bursts": lambda r, n: [r.choice([1, 20, 9_000, 9_999, 10_001, 12_000]) + (i // 200 % 3) * 300 for i in range(n)],
    "one late end": lambda r, n: [9_000 + i % 7 for i in range(n - 2)] + [10**8, 1],
    "rising": lambda r, n: [i * 11 for i in range(n)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_one_hot_key_over_many_ranges(spark, shape):
    """All rows of one key, half of them at one instant; every partition gets its share, and the rows are the plain ones."""
    n, limit, drop = 1_500, 10_000, 50
    prices = SHAPES[shape](random.Random(7), n)
    rows = [(None, 1, BASE + datetime.timedelta(milliseconds=max(0, i - n // 2)), i, p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, SCHEMA)
    when = [r[2] for r in rows]
    options = {"tie": ["id"], "partitions": 12}
    drops = patterns.cep3_drop(df, drop=drop, within="1 hour", **options).collect()
    assert sorted((r.drop_time, r.drop_diff) for r in drops) == sorted((when[j], d) for j, d in expected_drops(prices, drop))
    for operator, overlapping in ((patterns.cep1_low_average, False), (patterns.cep2_low_average_overlapping, True)):
        runs = operator(df, limit=limit, **options).collect()
        expected = [(when[i], when[j], avg) for i, j, avg in expected_runs(prices, limit, overlapping)]
        assert sorted((r.start_tstamp, r.end_tstamp, r.avg_price) for r in runs) == sorted(expected)
