"""Operators Spark's streaming lacks, on transformWithState: updating top-N and the winner at closing.

State needs the RocksDB provider (session.ROCKSDB). Times are kept as microseconds in the state.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auctionstream.operators.match import Pattern, find_matches

Order = list[tuple[str, bool]]


def _micros(df: DataFrame) -> tuple[DataFrame, list[str]]:
    times = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.unix_micros(c) for c in times}), times


def _times(df: DataFrame, times: list[str]) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in times})


def _sorter(columns: list[str], order: Order):
    """Sorts tuples by several columns, each up or down."""
    steps = [(columns.index(c), up) for c, up in reversed(order)]

    def run(rows: list[tuple]) -> list[tuple]:
        for place, up in steps:
            rows = sorted(rows, key=lambda r: (r[place] is not None, r[place]), reverse=not up)
        return rows

    return run


def _rows(part: pd.DataFrame, columns: list[str], state: StructType) -> list[tuple]:
    """Rows as plain Python values, which the state takes. pandas has integers with nulls as floats."""
    def values(name: str) -> list:
        plain = part[name].astype(object).where(part[name].notna(), None).tolist()
        return [None if v is None else int(v) for v in plain] if state[name].dataType == LongType() else plain

    return list(zip(*[values(c) for c in columns]))


class TopN(StatefulProcessor):
    """Keeps the first n rows of a key and emits the list, or its changes, when it changes."""

    def __init__(self, keys: list[str], columns: list[str], order: Order, n: int, rank: str, changelog: bool, state):
        self.keys, self.columns, self.order, self.n = keys, columns, order, n
        self.rank, self.changelog, self.state = rank, changelog, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.state)
        self.sort = _sorter(self.columns, self.order)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.rows.get()]
        after = before
        for part in rows:
            after = self.sort(after + _rows(part, self.columns, self.state))[: self.n]
        if before != after:
            self.rows.put(after)
            yield from self._emit(key, before, after)

    def _emit(self, key, before, after):
        names = [*self.keys, *self.columns, self.rank]
        if not self.changelog:
            yield pd.DataFrame([(*key, *r, i + 1) for i, r in enumerate(after)], columns=names)
            return
        old, new = set(enumerate(before)), set(enumerate(after))
        changes = [("-D", c) for c in sorted(old - new)] + [("+I", c) for c in sorted(new - old)]
        yield pd.DataFrame([(*key, *r, i + 1, op) for op, (i, r) in changes], columns=[*names, "op"])

    def close(self) -> None:
        pass


def top_n(
    stream: DataFrame, keys: list[str], order: Order, n: int, rank: str = "rank_number", changelog: bool = False
) -> DataFrame:
    """The first n rows per key as an updating table keyed by (keys, rank).

    Only rows that are among the first n of their own batch of rows leave the map side, so a hot key
    sends few rows to its state. ``changelog`` adds ``op``: -D for the rank's old row, +I for its new one.
    """
    rows, times = _micros(stream)
    columns = [c for c in rows.columns if c not in keys]
    total = [*order, *[(c, True) for c in columns if c not in dict(order)]]

    def prune(parts):
        names, ascending = [c for c, _ in total], [up for _, up in total]
        for part in parts:
            # As in the state: nulls first where a column ascends, last where it descends.
            for name, up in reversed(list(zip(names, ascending))):
                part = part.sort_values(name, ascending=up, kind="stable", na_position="first" if up else "last")
            yield part.groupby(keys, sort=False, dropna=False).head(n)

    rows = rows.mapInPandas(prune, rows.schema)
    state = StructType([rows.schema[c] for c in columns])
    fields = [rows.schema[c] for c in keys] + state.fields + [StructField(rank, LongType())]
    if changelog:
        fields.append(StructField("op", StringType()))
    processor = TopN(keys, columns, total, n, rank, changelog, state)
    return _times(
        rows.groupBy(*keys).transformWithStateInPandas(processor, StructType(fields), "Update", "None"), times
    )


class WinnerAtClose(StatefulProcessor):
    """Keeps the best offer of an auction and emits it once the watermark reaches its end."""

    def __init__(self, columns: list[str], order: Order, end: str, state):
        self.columns, self.order, self.end, self.state = columns, order, end, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.state)
        self.sort = _sorter(self.columns, self.order)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.best.exists()
        best = [tuple(self.best.get())] if known else []
        for part in rows:
            best = self.sort(best + _rows(part, self.columns, self.state))[:1]
        self.best.update(best[0])
        if not known:
            self.handle.registerTimer(-(-best[0][self.columns.index(self.end)] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = tuple(self.best.get())
        self.best.clear()
        yield pd.DataFrame([(*key, *row)], columns=["id", *self.columns])

    def close(self) -> None:
        pass


def winners_at_close(offers: DataFrame) -> DataFrame:
    """q9 on streams, append mode: one final row per auction with bids, when the auction closes.

    Takes the rows of streaming.joins.offers, whose bid_dateTime carries the watermark. A join that
    keeps auctions for ``max_open`` holds the watermark of its output back by as much, so a winner
    appears that long after the end of its auction.
    """
    times = ["expires", "bid_time"]
    rows = offers.withColumns({"expires": F.unix_micros("expires"), "bid_time": F.unix_micros("bid_dateTime")})
    columns = [c for c in rows.columns if c not in ("id", "bid_dateTime")]
    order = [("price", False), ("bid_time", True)]
    order += [(c, True) for c in columns if c not in dict(order)]
    state = StructType([rows.schema[c] for c in columns])
    processor = WinnerAtClose(columns, order, "expires", state)
    out = rows.groupBy("id").transformWithStateInPandas(
        processor, StructType([rows.schema["id"], *state.fields]), "Append", "EventTime"
    )
    return _times(out, times).withColumnRenamed("bid_time", "bid_dateTime")


class Matcher(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed them, matches them in order of time, and
    drops those that can no longer begin a match."""

    def __init__(self, keys, columns: list[str], order: list[str], pattern: Pattern, ttl: int | None, state):
        self.keys, self.columns, self.order = keys, columns, order
        self.pattern, self.ttl, self.state = pattern, ttl, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for part in rows for r in _rows(part, self.columns, self.state)]
        yield from self._match(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._match(key, [], timerValues)

    def _match(self, key, fresh, timerValues):
        place = {c: i for i, c in enumerate(self.columns)}
        by_time = [place[c] for c in self.order]
        time, now = by_time[0], timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted([tuple(r) for r in self.rows.get()] + fresh, key=lambda r: [r[i] for i in by_time])
        passed = sum(r[time] <= now for r in rows)
        found, start = find_matches(rows[:passed], place, self.order[0], self.pattern, False, now, self.ttl)
        if start < len(rows):
            self.rows.put(rows[start:])
        else:
            self.rows.clear()
        if passed < len(rows):
            self.handle.registerTimer(-(-rows[passed][time] // 1000))
        if found:
            yield pd.DataFrame([(*key, *m) for m in found], columns=[*self.keys, *self.pattern.measures])

    def close(self) -> None:
        pass


def match_rows(
    stream: DataFrame, partition_by: list[str], order_by: list[str], pattern: Pattern, ttl_micros: int | None = None
) -> DataFrame:
    """Row-pattern matches of a watermarked stream, append mode; see operators.match for patterns.

    The first order column is the event time; conditions and measures see it in microseconds under its
    own name. Rows after the watermark wait. An attempt that may still succeed holds back later ones of
    its key, for ever if need be; ``ttl_micros`` lets it fail after that time.
    """
    time = order_by[0]
    rows = stream.withColumnRenamed(time, "__event_time").withColumn(time, F.unix_micros("__event_time"))
    columns = [c for c in rows.columns if c not in (*partition_by, "__event_time")]
    state = StructType([rows.schema[c] for c in columns])
    fields = ", ".join(f"{n} {kind}" for n, (kind, _) in pattern.measures.items())
    schema = StructType([rows.schema[c] for c in partition_by] + list(StructType.fromDDL(fields)))
    processor = Matcher(partition_by, columns, order_by, pattern, ttl_micros, state)
    return rows.groupBy(*partition_by).transformWithStateInPandas(processor, schema, "Append", "EventTime")
