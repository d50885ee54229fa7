"""General row-pattern matching: one row per match over sorted rows of a key.

A pattern is a sequence of variables, each matching one row, one or more (+) or zero or more (*).
Quantifiers are greedy and keep what they took: a variable takes rows while its condition holds, the
next variable starts at the first row it refused. While a condition is tried, the current row already
counts as a row of its variable. Attempts are made from left to right.

``match_rows`` reads the sorted rows of a partition once and holds only those of the attempt at hand.
A key is one sequence and so one task's work; the named queries of operators.patterns also split keys.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAST_LAST_ROW, TO_NEXT_ROW = "past last row", "to next row"


class Mapped:
    """The rows each variable has taken so far."""

    def __init__(self, place: dict[str, int]):
        self._place, self._rows, self._sums = place, {}, {}

    def take(self, variable: str, row: tuple) -> None:
        self._rows.setdefault(variable, []).append(row)

    def give_back(self, variable: str) -> None:
        row = self._rows[variable].pop()
        for (name, column), (count, known, total) in list(self._sums.items()):
            if name == variable and count > len(self._rows[variable]):
                value = row[self._place[column]]
                self._sums[name, column] = (count - 1, known - (value is not None), total - (value or 0))

    def count(self, variable: str) -> int:
        return len(self._rows.get(variable, ()))

    def first(self, variable: str, column: str):
        rows = self._rows.get(variable)
        return rows[0][self._place[column]] if rows else None

    def last(self, variable: str, column: str, back: int = 0):
        rows = self._rows.get(variable, ())
        return rows[-1 - back][self._place[column]] if len(rows) > back else None

    def avg(self, variable: str, column: str):
        """Integer average of the values that are not null, cut towards zero; null if there is none."""
        rows = self._rows.get(variable, [])
        count, known, total = self._sums.get((variable, column), (0, 0, 0))
        values = [v for r in rows[count:] if (v := r[self._place[column]]) is not None]
        known, total = known + len(values), total + sum(values)
        self._sums[variable, column] = (len(rows), known, total)
        return (abs(total) // known) * (1 if total > 0 else -1) if known else None


def below(a, b) -> bool:
    """Whether a < b; a comparison with null does not hold."""
    return a is not None and b is not None and a < b


def minus(a, b):
    return None if a is None or b is None else a - b


@dataclass(frozen=True)
class Pattern:
    """``steps``: (variable, '' | '+' | '*'). ``define``: condition per variable, a missing one always
    holds. ``skip``: where to go on after a match, or the variable whose last row is next. ``within``:
    span in the unit of the first order column that a match must stay below."""

    steps: tuple[tuple[str, str], ...]
    define: dict[str, Callable[[Mapped], bool]]
    measures: dict[str, tuple[str, Callable[[Mapped], object]]]
    skip: str = PAST_LAST_ROW
    within: int | None = None


OPEN, FAILED = object(), object()


def attempt(
    rows: list[tuple], start: int, place: dict[str, int], time: str, pattern: Pattern, final: bool, now: int | None
):
    """The match from this row: (index behind it, index of the last row per variable, mapped rows).

    ``now`` is a time that all further rows exceed.
    """
    mapped, at, lasts = Mapped(place), start, {}
    begin = rows[start][place[time]]

    def fits(variable: str) -> bool:
        condition = pattern.define.get(variable)
        mapped.take(variable, rows[at])
        if condition is None or condition(mapped):
            lasts[variable] = at
            return True
        mapped.give_back(variable)
        return False

    for variable, quantifier in pattern.steps:
        taken = 0
        while True:
            if at >= len(rows):
                # Without more rows a repeated variable cannot know that it is done.
                too_late = pattern.within is not None and now is not None and now - begin >= pattern.within
                return FAILED if final or too_late else OPEN
            if pattern.within is not None and rows[at][place[time]] - begin >= pattern.within:
                return FAILED
            if not fits(variable):
                break
            taken, at = taken + 1, at + 1
            if not quantifier:
                break
        if taken == 0 and quantifier != "*":
            return FAILED
    return at, lasts, mapped


def find_matches(
    rows: list[tuple], place: dict[str, int], time: str, pattern: Pattern, final: bool,
    now: int | None = None, ttl: int | None = None,
):
    """Measures of the matches, and the first row that may still begin one (the end if ``final``).

    An attempt that is still open holds back the later ones, unless it is older than ``ttl``.
    """
    found, start = [], 0
    while start < len(rows):
        result = attempt(rows, start, place, time, pattern, final, now)
        if result is OPEN:
            if ttl is None or now - rows[start][place[time]] <= ttl:
                break
            result = FAILED
        if result is FAILED:
            start += 1
            continue
        behind, lasts, mapped = result
        found.append(tuple(measure(mapped) for _, measure in pattern.measures.values()))
        if pattern.skip == PAST_LAST_ROW:
            start = behind
        elif pattern.skip == TO_NEXT_ROW:
            start += 1
        else:
            start = lasts[pattern.skip]
    return found, start


def match_rows(df: DataFrame, partition_by: list[str], order_by: list[str], pattern: Pattern) -> DataFrame:
    """One row per match: the key columns and the measures. The first order column is an integer time."""
    types = dict(df.dtypes)
    schema = ", ".join(
        [f"{k} {types[k]}" for k in partition_by] + [f"{n} {kind}" for n, (kind, _) in pattern.measures.items()]
    )
    columns = list(df.columns)
    place, time = {c: i for i, c in enumerate(columns)}, order_by[0]
    key_places = [place[k] for k in partition_by]

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.types)]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for part in parts:
            out = []
            # Arrow keeps nulls and large integers as they are.
            for row in zip(*[part.column(c).to_pylist() for c in columns]):
                row_key = tuple(row[i] for i in key_places)
                if row_key != key:
                    out += [(*key, *m) for m in find_matches(rows, place, time, pattern, True)[0]] if key else []
                    key, rows = row_key, []
                rows.append(row)
            # Decide what the rows so far decide, and keep the rest.
            if key:
                matches, start = find_matches(rows, place, time, pattern, False)
                out += [(*key, *m) for m in matches]
                rows = rows[start:]
            yield table(out)
        if key:
            out = [(*key, *m) for m in find_matches(rows, place, time, pattern, True)[0]]
            yield table(out)

    placed = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *order_by)
    return placed.mapInArrow(run, schema)


def match_schema(df: DataFrame, partition_by: list[str], pattern: Pattern) -> StructType:
    measures = StructType.fromDDL(", ".join(f"{n} {kind}" for n, (kind, _) in pattern.measures.items()))
    return StructType([df.schema[k] for k in partition_by] + list(measures))


def match_passed(
    df: DataFrame, partition_by: list[str], order_by: list[str], pattern: Pattern, now: int | None, ttl: int | None = None
) -> DataFrame:
    """The matches among the rows up to ``now``, and all rows that are still needed for later ones.

    The columns of ``df``, the measures, and ``__final``, which is true for matches: they have key columns and measures, the
    rows left have the columns of ``df``. The first order column is an integer time.
    """
    columns, names = list(df.columns), list(pattern.measures)
    place, time = {c: i for i, c in enumerate(columns)}, df.columns.index(order_by[0])
    key_places = [place[k] for k in partition_by]
    measures = [f for f in match_schema(df, partition_by, pattern) if f.name in names]
    schema = StructType([*df.schema, *measures]).add("__final", "boolean")
    kinds = to_arrow_schema(schema)

    def table(matches: list[tuple], left: list[tuple]) -> pa.RecordBatch:
        out = []
        for i, column in enumerate(columns):
            of_key = partition_by.index(column) if column in partition_by else None
            out.append([None if of_key is None else key[of_key] for key, _ in matches] + [r[i] for r in left])
        out += [[m[i] for _, m in matches] + [None] * len(left) for i in range(len(names))]
        out.append([True] * len(matches) + [False] * len(left))
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds.types)], schema=kinds)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, matches, left = None, [], [], []

        def decide(over: bool) -> None:
            nonlocal rows
            passed = sum(r[time] <= now for r in rows) if now is not None else 0
            found, start = find_matches(rows[:passed], place, order_by[0], pattern, False, now if over else None, ttl if over else None)
            matches.extend((key, m) for m in found)
            rows = rows[start:]
            if over:
                left.extend(rows)

        for part in parts:
            for row in zip(*[part.column(c).to_pylist() for c in columns]):
                row_key = tuple(row[i] for i in key_places)
                if row_key != key:
                    if key:
                        decide(True)
                    key, rows = row_key, []
                rows.append(row)
            if key:
                decide(False)
            yield table(matches, left)
            matches, left = [], []
        if key:
            decide(True)
            yield table(matches, left)

    placed = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *order_by)
    return placed.mapInArrow(run, schema)


# ---- the four patterns over rows with a time in microseconds ------------------------------------


def v_shape(time: str = "micros") -> Pattern:
    def down(m: Mapped) -> bool:
        before = m.last("DOWN", "price", 1)
        return below(m.last("DOWN", "price"), m.last("START", "price") if m.count("DOWN") == 1 else before)

    def up(m: Mapped) -> bool:
        before = m.last("DOWN", "price", 1)
        return m.count("DOWN") > 1 and below(before, m.last("UP", "price"))

    return Pattern(
        steps=(("START", ""), ("DOWN", "+"), ("UP", "")),
        define={"DOWN": down, "UP": up},
        measures={
            "start_tstamp": ("bigint", lambda m: m.last("START", time)),
            "bottom_tstamp": ("bigint", lambda m: m.last("DOWN", time)),
            "end_tstamp": ("bigint", lambda m: m.last("UP", time)),
        },
        skip="UP",
    )


def low_average(limit: int = 10_000, skip: str = PAST_LAST_ROW, time: str = "micros") -> Pattern:
    return Pattern(
        steps=(("A", "+"), ("B", "")),
        define={"A": lambda m: below(m.avg("A", "price"), limit)},
        measures={
            "start_tstamp": ("bigint", lambda m: m.first("A", time)),
            "end_tstamp": ("bigint", lambda m: m.last("A", time)),
            "avg_price": ("bigint", lambda m: m.avg("A", "price")),
        },
        skip=skip,
    )


def drop_within(drop: int = 50, within_micros: int = 5_000_000, time: str = "micros") -> Pattern:
    return Pattern(
        steps=(("A", ""), ("B", "*"), ("C", "")),
        define={
            "B": lambda m: below(minus(m.last("A", "price"), drop), m.last("B", "price")),
            "C": lambda m: below(m.last("C", "price"), minus(m.last("A", "price"), drop)),
        },
        measures={
            "drop_time": ("bigint", lambda m: m.last("C", time)),
            "drop_diff": ("bigint", lambda m: m.last("A", "price") - m.last("C", "price")),
        },
        within=within_micros,
    )
