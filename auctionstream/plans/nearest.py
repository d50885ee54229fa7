"""The first later row at or below a level, along sequences that range partitions cut (plans.ranges).

A partition settles what it can. It hands on the rows whose level nothing in it reached (``open``), the rows below all
rows before them in its first key (``record``: only they can be reached from outside), and per key at its ends the
least value (``sum``). A stack over the least values of a key's partitions, one row per partition, says which partition
reaches which levels; rows then meet only the records between the levels that they need.
"""

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from auctionstream.plans.ranges import PART, PLACE, Groups

NONE = -1


def next_at_or_below(value: np.ndarray, level: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every row the first later row of its group whose value is at or below the row's level, or -1.

    ``first`` is where each row's group begins. From the right, with a stack of the rows below everything before them.
    """
    values, levels, firsts = value.tolist(), level.tolist(), first.tolist()
    found, lows, places, group = [NONE] * len(values), [], [], NONE
    for i in range(len(values) - 1, -1, -1):
        if firsts[i] != group:
            group, lows, places = firsts[i], [], []
        at = bisect_right(lows, levels[i]) - 1
        if at >= 0:
            found[i] = places[at]
        while lows and lows[-1] >= values[i]:
            lows.pop()
            places.pop()
        lows.append(values[i])
        places.append(i)
    return np.array(found, dtype="int64")


def records(value: np.ndarray, groups: Groups) -> np.ndarray:
    """Rows of the first key of a partition that lie below all rows before them."""
    out = np.zeros(len(value), bool)
    head = np.flatnonzero(groups.begins_before)
    if len(head):
        least = np.minimum.accumulate(value[head])
        out[head] = np.append(True, least[1:] < least[:-1])
    return out


def last_of_ends(groups: Groups) -> np.ndarray:
    """The last row of the first and of the last key: where sums per key and partition stand."""
    return (groups.from_end == 0) & (groups.begins_before | groups.goes_on)


def _reaching(keys: list[str]):
    """Which later partition first reaches which levels, per partition with open rows. One row per partition of a key."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values(PART), []
        lows, parts = [], []  # from the farthest to the nearest; the least value rises
        rows = list(zip(part[PART].tolist(), part["low"].tolist(), part["least"].tolist(), part["most"].tolist(), part["opens"].tolist()))
        for number, low, least, most, opens in reversed(rows):
            if opens:
                # The nearest partition at or below the highest level, and then farther ones for lower levels.
                at, above = bisect_right(lows, most) - 1, None
                while at >= 0:
                    out.append((number, parts[at], lows[at], most if above is None else above - 1))
                    if lows[at] <= least:
                        break
                    above, at = lows[at], at - 1
            while lows and lows[-1] >= low:
                lows.pop()
                parts.pop()
            lows.append(low)
            parts.append(number)
        found = pd.DataFrame(out, columns=[PART, "target", "from_level", "to_level"])
        for k in keys:
            found[k] = part[k].iloc[0]
        return found[[*keys, PART, "target", "from_level", "to_level"]]

    return run


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], *more):
    """A join on keys that may be null; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(named, [*on, *more]).drop(*[f"__r_{k}" for k in keys])


def across(opens: DataFrame, records: DataFrame, sums: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The open rows that a later partition reaches, with ``target``, ``end_place``, ``end_value`` and the payload of the row.

    Columns: opens keys, __part, __place, level and others; records keys, __part, __place, value and the payload; sums keys,
    __part, low. Levels and values are whole numbers. Arcs from a row to its end are few per pair of partitions.
    """
    types = dict(sums.dtypes)
    spread = opens.groupBy(*keys, PART).agg(
        F.min("level").alias("least"), F.max("level").alias("most"), F.count("*").alias("opens")
    ).withColumnRenamed(PART, "__of")
    named = spread.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    table = sums.select(*keys, PART, "low").join(named, [*on, F.col(PART) == F.col("__of")], "left").select(
        *keys, PART, "low", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("least", "most", "opens")]
    )
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    pairs = table.groupBy(*keys).applyInPandas(
        _reaching(keys), f"{fields}, {PART} int, target int, from_level long, to_level long"
    ).withColumnRenamed(PART, "__of")
    aimed = same_keys(opens, pairs, keys, F.col(PART) == F.col("__of"), F.col("level").between(F.col("from_level"), F.col("to_level")))
    aimed = aimed.drop("__of", "from_level", "to_level")
    # Of a partition's records the ones between the levels asked of it, and the first at or below the lowest.
    asked = aimed.groupBy(*keys, PART, "target").agg(F.min("level").alias("__least"), F.max("level").alias("__most"))
    along = Window.partitionBy(*keys, PART).orderBy(PLACE)
    falling = records.withColumn("__before", F.lag("value").over(along)).select(
        *keys, F.col(PART).alias("__in"), F.col(PLACE).alias("end_place"), F.col("value").alias("end_value"), "__before", *payload
    )
    wanted = (F.col("__before").isNull() | (F.col("__before") > F.col("__least"))) & (F.col("end_value") <= F.col("__most"))
    useful = same_keys(falling, asked, keys, F.col("__in") == F.col("target"), wanted)
    row = F.struct("end_place", "end_value", *payload)
    both = aimed.withColumns({"__row": F.lit(None).cast(useful.select(row.alias("r")).schema["r"].dataType), "__level": F.col("level")}).unionByName(
        useful.select(*keys, PART, "target", row.alias("__row"), F.col("end_value").alias("__level")), allowMissingColumns=True
    )
    # From low levels to high ones: the last record passed, the highest at or below the level, is the first that reaches it.
    passed = Window.partitionBy(*keys, PART, "target").orderBy("__level", F.col("__row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    closed = both.withColumn("__end", F.last("__row", ignorenulls=True).over(passed)).where("__row IS NULL")
    return closed.select(*aimed.columns, "__end.*")
