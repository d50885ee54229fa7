"""Ranks and running totals within groups, of which one may hold most of the rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 20_000


def buckets_for(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-n_rows // rows_per_bucket))


def running_total(
    df: DataFrame, group: str, bucket: Column, order: list[str], value: Column, name: str, narrow: DataFrame | None = None
) -> DataFrame:
    """Add ``name``: the total of ``value`` over the rows that precede a row in its group.

    ``bucket`` is a number that never decreases in the order and deals the rows of a group evenly; it
    cuts a hot group into pieces that different tasks sort. Rows precede by bucket, then by ``order``,
    which must tell all but identical rows apart. ``group`` must not be null. Only the totals of the
    buckets meet per group; they are taken from ``narrow``, if given: the same rows with the columns that
    ``group``, ``bucket`` and ``value`` need. Columns ``__bucket``, ``__value``, ``__before`` are taken.
    """
    measures = {"__bucket": bucket.cast("long"), "__value": value.cast("long")}
    dealt = df.withColumns(measures)
    totals = (dealt if narrow is None else narrow.withColumns(measures)).groupBy(group, "__bucket").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col(group).alias("__in"), F.col("__bucket").alias("__at"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"),
    )
    within = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn(name, F.coalesce(F.sum("__value").over(within), F.lit(0)))
        .join(before, (F.col(group) == F.col("__in")) & (F.col("__bucket") == F.col("__at")))
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__in", "__at", "__before", "__bucket", "__value")
    )
