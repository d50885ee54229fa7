"""The four row-pattern queries, each reduced to something Spark can spread.

Rows of one key (auction and bidder) in order of time. No query gathers a hot key: all work on range partitions
(plans.ranges), at every size alike, and settle what crosses their ends from few rows of each. They run jobs when
called and write their partitions to the shared folder.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from auctionstream.plans.nearest import across, last_of_ends, next_at_or_below, records, same_keys
from auctionstream.plans.ranges import PART, PLACE, Groups, in_ranges, numbers
from auctionstream.plans.skipping import chosen, position

KEYS = ["auction", "bidder"]
LIMIT, DROP, WITHIN = 10_000, 50, "5 seconds"


# ---- a falling run, then a rise ----------------------------------------------------------------


def cep0_v_shape(
    bid: DataFrame, keys: list[str] = KEYS, tie: list[str] = [], partitions: int | None = None
) -> DataFrame:
    """START DOWN+ UP: at least two falls in a row, then a price above the one before the last fall.

    Strictly falling runs do not overlap and the UP row starts the next run, so a match is decided by
    the UP row and the three rows before it. Its start is where the run began. A null price neither falls
    nor rises. ``tie`` makes the order total.

    In a range partition all is known but the first three rows of its first key, and where a run began
    that goes back beyond the partition. The last three rows of the partition before, and the last start of a
    run in each, settle that.
    """
    rows = bid.select(*keys, "dateTime", *[c for c in tie if c not in keys], "price")
    types = dict(rows.dtypes)
    time = types["dateTime"]

    def kernel(table: pa.Table, groups: Groups) -> dict:
        price, known = numbers(table["price"])
        n, at = len(price), np.arange(len(price))
        falls = np.zeros(n, bool)
        falls[1:] = known[1:] & known[:-1] & (price[1:] < price[:-1])
        starts = ~falls | (groups.place == 0)
        starts &= ~((groups.place == 0) & groups.begins_before)  # its predecessor is elsewhere
        up = (groups.place >= 3) & np.roll(falls, 1) & np.roll(falls, 2) & known & (price > np.roll(price, 2))
        last = np.append(-1, np.maximum.accumulate(np.where(starts, at, -1))[:-1])
        begun = last >= groups.first
        final = np.append(groups.group[1:] != groups.group[:-1], True)
        last_start = np.zeros(n, bool)
        newest = np.maximum.accumulate(np.where(starts, at, -1))[final & (groups.begins_before | groups.goes_on)]
        last_start[newest[newest >= 0]] = True
        last_start &= groups.begins_before | groups.goes_on
        kinds = {"match": up & begun, "open": up & ~begun, "start": last_start, "end": groups.ends(3)}
        take = np.concatenate([np.flatnonzero(x) for x in kinds.values()])
        kind = np.repeat(list(kinds), [int(x.sum()) for x in kinds.values()])
        times = table["dateTime"]
        has_start = pa.array((kind == "match"))
        return {
            **{k: table[k].take(take) for k in keys}, "dateTime": times.take(take), "price": table["price"].take(take),
            PLACE: groups.place[take], "__kind": pa.array(kind.astype(object), pa.string()), "__head": groups.heads(3)[take],
            "start_tstamp": pc.if_else(has_start, times.take(np.maximum(last[take], 0)), None),
            "bottom_tstamp": times.take(np.maximum(take - 1, 0)),
        }

    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    found = in_ranges(
        rows, keys, ["dateTime", *tie], kernel,
        f"{fields}, dateTime {time}, price bigint, {PLACE} long, __kind string, __head boolean, start_tstamp {time}, bottom_tstamp {time}",
        "v-shape", partitions,
    )
    along = Window.partitionBy(*keys).orderBy(PART, PLACE)
    one, two, three = (F.lag("price", i).over(along) for i in (1, 2, 3))
    heads = found.where("__kind = 'end'").withColumns({
        "__up": F.coalesce((three > two) & (two > one) & (F.col("price") > two), F.lit(False)),
        "__begins": F.coalesce(F.col("price") >= one, F.lit(True)), "bottom_tstamp": F.lag("dateTime", 1).over(along),
    }).where("__head")
    place = [*keys, PART, PLACE, "dateTime", "bottom_tstamp"]
    begins, seeks = F.lit(True).alias("__begins"), F.lit(False)
    points = (
        found.where("__kind = 'start'").select(*place, begins)
        .union(heads.where("__begins").select(*place, begins))
        .union(heads.where("__up").select(*place, seeks))
        .union(found.where("__kind = 'open'").select(*place, seeks))
    )
    # The last row of a match begins a run itself: not that one is sought, but the newest before it.
    earlier = Window.partitionBy(*keys).orderBy(PART, PLACE, "__begins").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("__begins"), F.struct(PART, PLACE, "dateTime"))).over(earlier)
    late = points.withColumn("start_tstamp", newest["dateTime"]).where("NOT __begins")
    columns = [*keys, "start_tstamp", "bottom_tstamp", F.col("dateTime").alias("end_tstamp")]
    return found.where("__kind = 'match'").select(*columns).union(late.select(*columns))


def divided(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Integer quotient, cut towards zero."""
    return np.sign(total) * (np.abs(total) // np.maximum(count, 1))


# ---- a run of low average, then any row ---------------------------------------------------------


def cep2_low_average_overlapping(
    bid: DataFrame, keys: list[str] = KEYS, tie: list[str] = [], limit: int = LIMIT, partitions: int | None = None
) -> DataFrame:
    """A+ B, skip to next row: from every row, the longest run whose average stays below the limit.

    With S the running sum of price minus limit, a run from row i ends before the first later row j
    with S(j) >= S(i-1): the next greater element of S. A missing price begins no run, and within one it
    counts neither for the sum nor for the number of prices.
    """
    return _low_average(bid, keys, tie, limit, partitions).select(*keys, "start_tstamp", "end_tstamp", "avg_price")


def cep1_low_average(
    bid: DataFrame, keys: list[str] = KEYS, tie: list[str] = [], limit: int = LIMIT, partitions: int | None = None
) -> DataFrame:
    """A+ B, skip past last row.

    The runs of cep2 are nested or apart, never crossing, so the ones found from left to right are the
    outermost: those that start after every earlier run has ended.
    """
    runs = _low_average(bid, keys, tie, limit, partitions)
    inside = Window.partitionBy(*keys, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__covered", F.max("__to").over(inside))
    # Of keys that go over several partitions: where the runs of the earlier ones end. A row per partition at most.
    earlier = Window.partitionBy(*keys).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    reach = runs.groupBy(*keys, F.col(PART).alias("__of")).agg(F.max("__to").alias("__last"))
    carried = reach.withColumn("__carried", F.max("__last").over(earlier)).where("__carried IS NOT NULL").drop("__last")
    named = carried.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    both = runs.join(named, [*same, F.col(PART) == F.col("__of")], "left")
    outermost = both.where(F.col("__from") > F.coalesce(F.greatest("__covered", "__carried"), F.lit(-1)))
    return outermost.select(*keys, "start_tstamp", "end_tstamp", "avg_price")


def _low_average(bid: DataFrame, keys: list[str], tie: list[str], limit: int, partitions: int | None) -> DataFrame:
    """All runs with ``__part`` and ``__place`` of their first row, and the positions of it and of the row that ends them.

    Within a range partition sums start at 0 for every key; the sums of earlier partitions are added where a run crosses
    an end (plans.nearest).
    """
    rows = bid.select(*keys, "dateTime", *[c for c in tie if c not in keys], "price")
    types = dict(rows.dtypes)
    time = types["dateTime"]

    def kernel(table: pa.Table, groups: Groups) -> dict:
        price, known = numbers(table["price"])
        at = np.arange(len(price))
        over = np.where(known, price - limit, 0)
        total = np.cumsum(over)
        sums = total - (total - over)[groups.first]  # of the key, within the partition
        seen = np.cumsum(known) - known
        seen = seen - seen[groups.first]
        before = sums - over
        ends = next_at_or_below(-sums, -before, groups.first)
        starts = over < 0
        lows = np.minimum.reduceat(-sums, np.flatnonzero(groups.place == 0))[groups.group]
        kinds = {
            "run": starts & (ends >= 0), "open": starts & (ends < 0) & groups.goes_on,
            "record": records(-sums, groups), "sum": last_of_ends(groups),
        }
        take = np.concatenate([np.flatnonzero(x) for x in kinds.values()])
        kind = np.repeat(list(kinds), [int(x.sum()) for x in kinds.values()])
        until = np.where(kind == "run", ends[take], 0)
        count = np.maximum(seen[until] - seen[take], 1)
        average = np.where(kind == "run", divided(sums[until - 1] - before[take] + limit * count, count), 0)
        times = table["dateTime"]
        # A record's time is that of the row before it; it may be in an earlier partition.
        shown = np.where(kind == "record", take - 1, take)
        shows = pa.array((kind != "record") | (groups.place[take] > 0))
        return {
            **{k: table[k].take(take) for k in keys}, PLACE: groups.place[take], "__kind": pa.array(kind.astype(object), pa.string()),
            "start_tstamp": pc.if_else(shows, times.take(np.maximum(shown, 0)), None),
            "end_tstamp": pc.if_else(pa.array(kind == "run"), times.take(np.maximum(until - 1, 0)), None),
            "avg_price": average, "__to": groups.place[until], "__low": lows[take], "__over": over[take],
            "__sum": np.where(kind == "open", before[take], sums[take]), "__known": np.where(kind == "sum", (seen + known)[take], seen[take]),
        }

    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    found = in_ranges(
        rows, keys, ["dateTime", *tie], kernel,
        f"{fields}, {PLACE} long, __kind string, start_tstamp {time}, end_tstamp {time}, avg_price bigint, __to long, __low long, "
        "__over long, __sum long, __known long",
        "low-average", partitions,
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.where("__kind = 'sum'").select(
        *keys, PART, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"),
        F.coalesce(F.sum("__known").over(earlier), F.lit(0)).alias("__before"), F.last("start_tstamp").over(earlier).alias("__last_time"), "__low",
    )

    def globally(kind: str) -> DataFrame:
        named = offsets.withColumnRenamed(PART, "__of").drop("__low")
        return same_keys(found.where(F.col("__kind") == kind), named, keys, F.col(PART) == F.col("__of"))

    level, nr = -(F.col("__sum") + F.col("__base")), F.col("__known") + F.col("__before")
    opens = globally("open").select(*keys, PART, PLACE, "start_tstamp", level.alias("level"), nr.alias("__nr"))
    ends = globally("record").select(
        *keys, PART, PLACE, level.alias("value"), F.coalesce("start_tstamp", "__last_time").alias("end_tstamp"),
        nr.alias("__end_nr"), F.col("__over").alias("__end_over"),
    )
    lows = offsets.select(*keys, PART, (F.col("__low") - F.col("__base")).alias("low"))
    closed = across(opens, ends, lows, keys, ["end_tstamp", "__end_nr", "__end_over"])
    count = F.col("__end_nr") - F.col("__nr")
    total = F.col("level") - F.col("end_value") - F.col("__end_over") + limit * count

    inside = found.where("__kind = 'run'").select(
        *keys, "start_tstamp", "end_tstamp", "avg_price", PART, PLACE,
        position(F.col(PART), F.col(PLACE)).alias("__from"), position(F.col(PART), F.col("__to")).alias("__to"),
    )
    over_cuts = closed.select(
        *keys, "start_tstamp", "end_tstamp", F.call_function("div", total, count).alias("avg_price"), PART, PLACE,
        position(F.col(PART), F.col(PLACE)).alias("__from"), position(F.col("target"), F.col("end_place")).alias("__to"),
    )
    return inside.unionByName(over_cuts)


# ---- a drop within a time -----------------------------------------------------------------------

#: Stands for a missing price: at or below every level, so it ends every attempt.
MISSING = -(1 << 62)


def cep3_drop(
    bid: DataFrame, keys: list[str] = KEYS, tie: list[str] = [], drop: int = DROP, within: str = WITHIN,
    partitions: int | None = None,
) -> DataFrame:
    """A B* C within a time, skip past last row: the first price at or below A minus the drop ends the
    attempt; below, it is a match, and equal, it is none. A missing price ends every attempt.

    A range partition knows the matches of the keys that lie in it, and chooses among them. Of the keys at its ends it
    hands on the candidates, and the rows whose attempt is still open; later partitions close those (plans.nearest), and
    the choice along the partitions is one of links between them (plans.skipping).
    """
    rows = bid.select(*keys, "dateTime", *[c for c in tie if c not in keys], "price")
    types = dict(rows.dtypes)
    time, span = types["dateTime"], int(pd.Timedelta(within) / pd.Timedelta("1us"))

    def kernel(table: pa.Table, groups: Groups) -> dict:
        price, known = numbers(table["price"])
        at, micros = np.arange(len(price)), table["dateTime"].cast(pa.int64()).to_numpy()
        value = np.where(known, price, MISSING)
        ends = next_at_or_below(value, np.where(known, price - drop, MISSING - 1), groups.first)
        to = np.maximum(ends, 0)
        good = known & (ends >= 0) & known[to] & (price[to] < price - drop) & (micros[to] - micros < span)
        last = micros[np.minimum(at + groups.from_end, len(at) - 1)]
        elsewhere = groups.begins_before | groups.goes_on
        lows = np.minimum.reduceat(value, np.flatnonzero(groups.place == 0))[groups.group]
        match, group, free = np.zeros(len(price), bool), -1, 0
        inner = np.flatnonzero(good & ~elsewhere)
        for i, end, own in zip(inner.tolist(), ends[inner].tolist(), groups.group[inner].tolist()):
            if own != group or i >= free:
                match[i], group, free = True, own, end + 1
        kinds = {
            "match": match, "candidate": good & elsewhere, "open": known & (ends < 0) & groups.goes_on & (last - micros < span),
            "record": records(value, groups), "sum": last_of_ends(groups),
        }
        take = np.concatenate([np.flatnonzero(x) for x in kinds.values()])
        kind = np.repeat(list(kinds), [int(x.sum()) for x in kinds.values()])
        ended = (kind == "match") | (kind == "candidate")
        shown = np.where(ended, to[take], take)
        return {
            **{k: table[k].take(take) for k in keys}, PLACE: groups.place[take], "__kind": pa.array(kind.astype(object), pa.string()),
            "drop_time": table["dateTime"].take(shown), "drop_diff": np.where(ended, price[take] - price[shown], 0),
            "__to": groups.place[shown], "__value": value[take], "__micros": micros[take], "__low": lows[take],
        }

    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    found = in_ranges(
        rows, keys, ["dateTime", *tie], kernel,
        f"{fields}, {PLACE} long, __kind string, drop_time {time}, drop_diff long, __to long, __value long, __micros long, __low long",
        "drops", partitions,
    )
    of = lambda kind: found.where(F.col("__kind") == kind)
    opens = of("open").select(*keys, PART, PLACE, (F.col("__value") - drop).alias("level"), F.col("__micros").alias("__begun"))
    ends = of("record").select(*keys, PART, PLACE, F.col("__value").alias("value"), "drop_time", "__micros")
    closed = across(opens, ends, of("sum").select(*keys, PART, F.col("__low").alias("low")), keys, ["drop_time", "__micros"])
    drops = (F.col("end_value") > MISSING) & (F.col("end_value") < F.col("level")) & (F.col("__micros") - F.col("__begun") < span)
    crossing = closed.where(drops).select(
        *keys, PART, PLACE, "drop_time", (F.col("level") + drop - F.col("end_value")).alias("drop_diff"),
        (position(F.col("target"), F.col("end_place")) + 1).alias("behind"),
    )
    inside = of("candidate").select(
        *keys, PART, PLACE, "drop_time", "drop_diff", (position(F.col(PART), F.col("__to")) + 1).alias("behind")
    )
    columns = [*keys, "drop_time", "drop_diff"]
    return of("match").select(*columns).union(chosen(inside.unionByName(crossing), keys).select(*columns))
