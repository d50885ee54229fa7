"""Sequences of keys over range partitions: one program for short and for very long sequences.

Rows are shuffled once, by range of key and order, so quantiles of the data cut a hot key wherever its
rows are. A kernel reads each partition in order. What a partition cannot know, because its first key began
in an earlier one, is settled afterwards from a few rows of each partition's ends. Both come from the one
output of the kernel, which is written once to the shared folder: bounds of ranges are sampled anew for
every shuffle, so a second one would cut elsewhere.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from auctionstream.session import stage

#: Where a row is: the number of its part, and its place among the rows of its key there. Parts are portions of partitions.
PART, PLACE = "__part", "__place"
#: Rows of a portion, but for the rest of an Arrow batch, and portions that the number of a part has room for in each partition.
PORTION, MOST_PORTIONS = 100_000, 1 << 14


class Groups:
    """The keys of a sorted table: ``group`` numbers them, ``first`` is where each row's key begins."""

    def __init__(self, table: pa.Table, keys: list[str]):
        n = table.num_rows
        change = np.zeros(n, bool)
        change[:1] = True
        for key in keys:
            left, right = table[key].slice(0, max(n - 1, 0)), table[key].slice(1)
            same = pc.or_(
                pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right))
            )
            change[1:] |= ~same.to_numpy()
        self.group = np.cumsum(change) - 1
        self.first = np.flatnonzero(change)[self.group] if n else np.zeros(0, np.int64)
        self.place = np.arange(n) - self.first
        self.begins_before = self.group == 0  # perhaps
        self.goes_on = self.group == (self.group[-1] if n else 0)  # perhaps
        sizes = np.bincount(self.group, minlength=1) if n else np.zeros(1, np.int64)
        self.from_end = sizes[self.group] - 1 - self.place if n else np.zeros(0, np.int64)

    def ends(self, rows: int) -> np.ndarray:
        """The first rows of the first key, and the last rows of the last: the context of other partitions."""
        return self.heads(rows) | (self.goes_on & (self.from_end < rows))

    def heads(self, rows: int) -> np.ndarray:
        return self.begins_before & (self.place < rows)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integers, exact, with 0 for null, and which of them are not null."""
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def in_ranges(
    df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, Groups], dict], schema: str, name: str,
    partitions: int | None = None,
) -> DataFrame:
    """The kernel's output for all range partitions, with ``__part``.

    ``kernel`` gets rows that follow each other, and returns columns of equal length by name. It sees one portion of a
    partition after the other; what crosses the end of a portion is settled like what crosses the end of a partition. So a task holds
    a portion, however large its partition is.
    """
    count, rows_at_once = [partitions] if partitions else [], PORTION
    placed = df.repartitionByRange(*count, *keys, *order).sortWithinPartitions(*keys, *order)

    def of_portion(held: list[pa.RecordBatch], part: int) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        out = kernel(table, Groups(table, keys))
        n = len(next(iter(out.values())))
        return pa.table({**out, PART: pa.array([part] * n, pa.int32())}).to_batches(max_chunksize=PORTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n_held, portion = TaskContext.get().partitionId() * MOST_PORTIONS, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n_held >= rows_at_once:
                yield from of_portion(held, part + portion)
                held, n_held, portion = [], 0, portion + 1
                assert portion < MOST_PORTIONS, "a partition has too many rows"
            held.append(batch)
            n_held += batch.num_rows
        if held:
            yield from of_portion(held, part + portion)

    return stage(placed.mapInArrow(run, f"{schema}, {PART} int"), name)
