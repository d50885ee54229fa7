"""Streams whose state is kept as tables: a micro-batch is joined, counted or matched with what earlier ones left over.

Spark's state stores look up every key by itself, in one store per task; these forms read what is still needed as
DataFrames, so that joins and aggregates are Catalyst's and a hot key is split by AQE. Each has ``apply(batch, batch_id)`` for
``foreachBatch`` and ``read``. A micro-batch writes folders of its own and its mark last; one that runs again overwrites them.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from auctionstream.functions.scalar import interval
from auctionstream.operators import match, windows
from auctionstream.operators.topn import top_n
from auctionstream.streaming.joins import auction_side, bid_side, open_for

FINAL = "__final"


def together(**streams: DataFrame) -> DataFrame:
    """Several streams as one, so that a micro-batch has rows of all: a struct per stream, one of them set."""
    out = None
    for name, df in streams.items():
        rows = df.select(*[
            (F.struct(*df.columns) if other == name else F.lit(None).cast(stream.schema)).alias(other)
            for other, stream in streams.items()
        ])
        out = rows if out is None else out.union(rows)
    return out


def only(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col(name).isNotNull()).select(f"{name}.*")


class BatchTables:
    """Tables with a folder per micro-batch, and the watermark that each micro-batch has reached."""

    def __init__(self, spark: SparkSession, path: str, delay: str = "0 seconds"):
        self.spark, self.path, self.delay = spark, path.rstrip("/"), pd.Timedelta(delay).value // 1000
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def done(self, below: int | None = None) -> list[int]:
        """The complete micro-batches, oldest first. Names only."""
        folder = self._hadoop.Path(f"{self.path}/marks")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        names = sorted(int(x.getPath().getName()) for x in found if self._fs.exists(self._hadoop.Path(x.getPath(), "_SUCCESS")))
        return [n for n in names if below is None or n < below]

    def reached(self, batch_id: int) -> int | None:
        """The watermark before a micro-batch, in microseconds."""
        found = self.done(batch_id)
        return self.spark.read.schema("mark long").parquet(f"{self.path}/marks/{found[-1]}").first().mark if found else None

    def passed(self, batch_id: int, latest: list[int | None]) -> int | None:
        """The watermark after a micro-batch: of several streams the slowest counts, and it never goes back."""
        marks = [x for x in (self.reached(batch_id), None if None in latest else min(latest) - self.delay) if x is not None]
        return max(marks, default=None)

    def write(self, name: str, batch_id: int, rows: DataFrame, *partition_by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}/{batch_id}")

    def read(self, name: str, batches: list[int], schema: StructType | str, final: bool | None = None) -> DataFrame:
        part = "" if final is None else f"/{FINAL}={str(final).lower()}"
        paths = [f"{self.path}/{name}/{n}{part}" for n in batches]
        paths = [p for p in paths if self._fs.exists(self._hadoop.Path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def staged(self, name: str, batch_id: int, rows: DataFrame) -> DataFrame:
        """Rows of the micro-batch, computed once."""
        self.write(name, batch_id, rows)
        return self.read(name, [batch_id], rows.schema)

    def commit(self, batch_id: int, mark: int | None, *passing: str) -> None:
        """Name the micro-batch complete. Of ``passing`` tables the folders before the last one are not needed again."""
        self.write("marks", batch_id, self.spark.range(1).select(F.lit(mark).cast("long").alias("mark")).coalesce(1))
        for name in passing:
            for old in self.done(batch_id)[:-1]:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{name}/{old}"), True)


def _latest(rows: DataFrame, time: str) -> int | None:
    return rows.agg(F.max(F.unix_micros(time)).alias("t")).first().t


def _instant(mark: int | None) -> Column:
    return F.timestamp_micros(F.lit(mark).cast("long"))


def _after(time: Column, mark: int | None) -> Column:
    return F.lit(True) if mark is None else time > _instant(mark)


def _upto(time: Column, mark: int | None) -> Column:
    return F.lit(False) if mark is None else time <= _instant(mark)


class Joined:
    """An inner join of streams without watermark, over all their rows: nothing is ever late.

    ``join`` takes a DataFrame per name. Of every combination of rows the last stream whose row is new decides the term that
    makes it: streams before it give all rows, those after it only what came before this micro-batch.
    """

    def __init__(self, spark: SparkSession, path: str, names: list[str], join: Callable[..., DataFrame]):
        self.names, self.join, self.tables, self.schema = names, join, BatchTables(spark, path), None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before, terms = self.tables.done(batch_id), []
        fresh = {n: self.tables.staged(n, batch_id, only(batch, n)) for n in self.names}
        earlier = {n: self.tables.read(n, before, fresh[n].schema) for n in self.names}
        both = {n: self.tables.read(n, [*before, batch_id], fresh[n].schema) for n in self.names}
        for place, name in enumerate(self.names):
            # Without earlier rows only the last term has any.
            if before or name == self.names[-1]:
                inputs = [both[n] for n in self.names[:place]] + [fresh[name]] + [earlier[n] for n in self.names[place + 1 :]]
                terms.append(self.join(*inputs))
        out = terms[0]
        for term in terms[1:]:
            out = out.union(term)
        self.schema = out.schema
        self.tables.write("out", batch_id, out)
        self.tables.commit(batch_id, None)

    def read(self) -> DataFrame:
        return self.tables.read("out", self.tables.done(), self.schema)


class Offers:
    """Bids with their open auction, as ``streaming.joins.offers``, handed to ``result`` batch by batch.

    Takes ``together(auction=…, bid=…)``. Auctions are kept until no bid can fall into them any more, bids until no auction that
    may still come can have begun before them; rows that come later than the watermark are dropped.
    ``result.apply`` gets the offers of the micro-batch, its number, and the watermark in microseconds.
    """

    def __init__(self, spark: SparkSession, path: str, max_open: str, result: Callable, delay: str = "4 seconds"):
        self.max_open, self.result, self.tables = max_open, result, BatchTables(spark, path, delay)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before, done = self.tables.reached(batch_id), self.tables.done(batch_id)[-1:]
        sides = {"auction": (auction_side, "start"), "bid": (bid_side, "bid_dateTime")}
        fresh, held, latest = {}, {}, []
        for name, (side, time) in sides.items():
            rows = self.tables.staged(f"fresh-{name}", batch_id, side(only(batch, name)))
            latest.append(_latest(rows, time))
            fresh[name] = rows.where(_after(F.col(time), before))
            held[name] = self.tables.read(f"held-{name}", done, rows.schema)
        now = self.tables.passed(batch_id, latest)
        on = open_for(self.max_open)
        auctions = held["auction"].union(fresh["auction"])
        found = fresh["bid"].join(auctions, on)
        if done:
            found = found.union(held["bid"].join(fresh["auction"], on))
        self.result(self.tables.staged("offers", batch_id, found.drop("start")), batch_id, now)
        last = F.least("expires", F.col("start") + interval(self.max_open))
        self.tables.write("held-auction", batch_id, auctions.where(_after(last, now)))
        self.tables.write("held-bid", batch_id, held["bid"].union(fresh["bid"]).where(_after(F.col("bid_dateTime"), now)))
        self.tables.commit(batch_id, now, "fresh-auction", "fresh-bid", "offers", "held-auction", "held-bid")


class WinnersAtClose:
    """q9 on offers: one final row per auction with bids, ``patience`` after the watermark has passed its end."""

    def __init__(self, spark: SparkSession, path: str, patience: str = "0 seconds"):
        self.tables, self.patience, self.schema = BatchTables(spark, path), pd.Timedelta(patience).value // 1000, None

    def apply(self, offers: DataFrame, batch_id: int, now: int | None) -> None:
        kept = self.tables.read("best", self.tables.done(batch_id)[-1:], offers.schema, False)
        best = top_n(kept.union(offers), ["id"], [F.col("price").desc(), F.col("bid_dateTime").asc()], 1)
        closed = _upto(F.col("expires"), None if now is None else now - self.patience)
        self.schema = offers.schema
        self.tables.write("best", batch_id, best.withColumn(FINAL, F.coalesce(closed, F.lit(False))), FINAL)
        self.tables.commit(batch_id, now)

    def read(self) -> DataFrame:
        return self.tables.read("best", self.tables.done(), self.schema, True)


class HopCounts:
    """Bids per auction and hopping window, once the window has closed; ``finish`` may reduce the counts of closed windows.

    Kept are counts per pane (operators.windows), of panes that a window still open has.
    """

    def __init__(
        self, spark: SparkSession, path: str, size: str, slide: str, finish: Callable[[DataFrame], DataFrame] | None = None,
        delay: str = "4 seconds",
    ):
        self.size, self.slide, self.finish, self.schema = size, slide, finish or (lambda counts: counts), None
        self.tables = BatchTables(spark, path, delay)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        before = self.tables.reached(batch_id)
        counted = windows.pane_counts(batch, self.size, self.slide, F.max("dateTime").alias("__last"))
        fresh = self.tables.staged("fresh", batch_id, counted)
        now = self.tables.passed(batch_id, [_latest(fresh, "__last")])
        panes = self.tables.read("held", self.tables.done(batch_id)[-1:], counted.schema).union(fresh)
        counts = windows.window_counts(panes, self.size, self.slide).withColumnRenamed("start", "starttime")
        counts = counts.withColumn("endtime", F.col("starttime") + interval(self.size))
        closed = counts.where(_after(F.col("endtime"), before) & _upto(F.col("endtime"), now))
        out = self.finish(closed)
        self.schema = out.schema
        self.tables.write("out", batch_id, out)
        last_end = windows.tumble(self.slide, "__pane")["start"] + interval(self.size)
        self.tables.write("held", batch_id, panes.withColumn("__end", last_end).where(_after(F.col("__end"), now)).drop("__end"))
        self.tables.commit(batch_id, now, "fresh", "held")

    def read(self) -> DataFrame:
        return self.tables.read("out", self.tables.done(), self.schema)


def most_per_window(counts: DataFrame) -> DataFrame:
    """q5 on the counts of closed windows: those that reach their window's maximum."""
    most = counts.groupBy(F.col("starttime").alias("__at")).agg(F.max("num").alias("maxn"))
    return counts.join(most, F.col("starttime").eqNullSafe(F.col("__at")) & (F.col("num") >= F.col("maxn"))).drop("__at", "maxn")


class Matches:
    """Row-pattern matches (operators.match) of rows that the watermark has passed, per key in order of time.

    Kept are the rows that may still begin or join a match. An attempt that may still succeed holds back later ones of its
    key; ``ttl`` (microseconds) lets it fail after that time. The first order column is the event time.
    """

    def __init__(
        self, spark: SparkSession, path: str, partition_by: list[str], order_by: list[str], pattern: match.Pattern,
        delay: str = "4 seconds", ttl: int | None = None,
    ):
        self.keys, self.order, self.pattern, self.ttl = partition_by, order_by, pattern, ttl
        self.tables, self.schema = BatchTables(spark, path, delay), None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        time, before = self.order[0], self.tables.reached(batch_id)
        batch = batch.where(F.col(time).isNotNull() & _after(F.col(time), before))
        fresh = self.tables.staged("fresh", batch_id, batch.withColumn(time, F.unix_micros(time)))
        latest = fresh.agg(F.max(time).alias("t")).first().t
        now = self.tables.passed(batch_id, [latest])
        held = self.tables.read("found", self.tables.done(batch_id)[-1:], fresh.schema, False)
        found = match.match_passed(held.union(fresh), self.keys, self.order, self.pattern, now, self.ttl)
        self.schema = match.match_schema(fresh, self.keys, self.pattern)
        self.tables.write("found", batch_id, found, FINAL)
        self.tables.commit(batch_id, now, "fresh")

    def read(self) -> DataFrame:
        return self.tables.read("found", self.tables.done(), self.schema, True)
