"""Choosing matches from left to right along sequences that range partitions cut: the next one starts where the last has ended.

Each candidate knows where the choice goes on behind it (its end), so the chosen ones are the orbit of the first
candidate. Within a partition the orbit of every candidate is followed to the point where it leaves. What is left are
links between the few candidates at which a partition is entered, and pointer doubling finds those that the orbit
meets: as many rounds as the number of partitions has binary digits.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from auctionstream.plans.nearest import same_keys
from auctionstream.plans.ranges import PART, PLACE
from auctionstream.session import stage

#: A position along a key: the number of the part times this, plus the row's place there.
SPAN = 1 << 32
#: Far above the digits of any number of partitions; a loop that doesn't end is an error.
MOST_ROUNDS = 60


def position(part, place):
    return part.cast("long") * SPAN + place


def _taken(columns: list[str]):
    """Of the candidates of one partition that lie behind its entry, the ones taken from left to right."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(PLACE)
        at, free = (rows[PLACE] + int(rows[PART].iloc[0]) * SPAN).tolist(), -1
        keep = np.zeros(len(rows), bool)
        for i, (here, behind) in enumerate(zip(at, rows["behind"].tolist())):
            if here >= free:
                keep[i], free = True, behind
        return rows[keep][columns]

    return run


def chosen(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates taken from left to right. Columns: keys, __part, __place, ``behind`` (the position where the choice goes
    on after it, beyond its own) and others."""
    types = dict(candidates.dtypes)
    fields = ", ".join(f"`{c}` {kind}" for c, kind in types.items())
    columns = candidates.columns

    def leaving(rows: pd.DataFrame) -> pd.DataFrame:
        """Where the orbit of each candidate leaves the partition."""
        rows = rows.sort_values(PLACE).reset_index(drop=True)
        behind, over = rows["behind"].tolist(), (int(rows[PART].iloc[0]) + 1) * SPAN
        after = np.searchsorted(rows[PLACE].to_numpy() + over - SPAN, rows["behind"].to_numpy()).tolist()
        leaves = [0] * len(behind)
        for i in range(len(behind) - 1, -1, -1):
            leaves[i] = behind[i] if behind[i] >= over else leaves[after[i]] if after[i] < len(behind) else over
        return rows.assign(leaves=leaves)

    left = stage(candidates.groupBy(*keys, PART).applyInPandas(leaving, f"{fields}, leaves long"), "candidates")
    if left.isEmpty():
        return candidates
    own = position(F.col(PART), F.col(PLACE))
    if left.where(F.col("leaves") % SPAN != 0).isEmpty():  # no match goes over an end: every partition is entered at its head
        return left.groupBy(*keys, PART).applyInPandas(_taken(columns), fields)
    places = left.select(*keys, own.alias("at"))
    heads = places.groupBy(*keys, F.floor(F.col("at") / SPAN).alias("part")).agg(F.min("at").alias("head"))

    # The first candidate at or behind each point where an orbit goes on: in the same partition, or the head of a later one.
    points = left.select(*keys, F.col("leaves").alias("at")).distinct().withColumn("point", F.lit(True))
    both = points.unionByName(places.withColumn("point", F.lit(False))).withColumn("part", F.floor(F.col("at") / SPAN))
    behind = Window.partitionBy(*keys, "part").orderBy(F.desc("at"), "point").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("to", F.last(F.when(~F.col("point"), F.col("at")), ignorenulls=True).over(behind)).where("point")
    open_parts = near.where("to IS NULL").select(*keys, "part").distinct().withColumn("head", F.lit(None).cast("long"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc("part")).rangeBetween(Window.unboundedPreceding, -1)
    later = open_parts.unionByName(heads.select(*keys, "part", "head")).withColumn("next_head", F.last("head", ignorenulls=True).over(beyond))
    later = later.where("head IS NULL").select(*keys, F.col("part").alias("of"), "next_head")
    named = later.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    targets = near.join(named, [*on, F.col("part") == F.col("of"), F.col("to").isNull()], "left").select(
        *keys, F.col("at").alias("leaving"), F.coalesce("to", "next_head").alias("to")
    ).where("to IS NOT NULL")
    targets = stage(targets, "targets")

    first = heads.groupBy(*keys).agg(F.min("head").alias("at"))
    nodes = targets.select(*keys, F.col("to").alias("node")).union(first).distinct()
    exits = left.select(*keys, own.alias("at"), "leaves")
    links = same_keys(exits, nodes, keys, F.col("at") == F.col("node")).drop("node")
    links = stage(same_keys(links, targets, keys, F.col("leaves") == F.col("leaving")).select(*keys, "at", "to"), "links")
    met, known = stage(first, "met"), 0
    for _ in range(MOST_ROUNDS):
        count = met.count()
        if count == known:
            break
        known = count
        step = links.withColumnsRenamed({"at": "from"})
        met = stage(met.union(same_keys(met, step, keys, F.col("at") == F.col("from")).select(*keys, "to")).distinct(), "met")
        links = stage(same_keys(links, step.withColumnRenamed("to", "on"), keys, F.col("to") == F.col("from")).select(*keys, "at", F.col("on").alias("to")), "links")
    else:
        raise RuntimeError("the choice of matches did not settle")

    # An orbit passes a partition once, so it has one entry there.
    entry = met.select(*keys, F.floor(F.col("at") / SPAN).cast("int").alias("of"), (F.col("at") % SPAN).alias("entry"))

    entered = same_keys(left, entry, keys, F.col(PART) == F.col("of"), F.col(PLACE) >= F.col("entry")).select(*columns)
    return entered.groupBy(*keys, PART).applyInPandas(_taken(columns), fields)
