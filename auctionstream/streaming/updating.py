"""Updating results of streams as keyed tables: reports with distinct counts, averages of maxima, top-N.

Each has ``apply(batch, batch_id)`` for ``foreachBatch`` and ``read``, keeps what it needs per key in a table of its own (sources.keyed) and turns the changes of a micro-batch's rows
into changes of the result. All of it is joins-free DataFrame work: changes are combined before they meet the state,
of which only the touched buckets are read. After every micro-batch the result equals the batch query over all rows so far.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auctionstream.functions.scalar import minute_number, minute_text, price_bands
from auctionstream.operators.aggregates import REPORT_COLUMNS
from auctionstream.operators.topn import top_n
from auctionstream.sources.keyed import KeyedTable

COUNTS = ("total", "rank1", "rank2", "rank3")
KINDS = ("bidders", "auctions")


def _union_sums(old: DataFrame, new: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Per key: ``{c}_was`` from the old rows and ``c`` with the new ones added."""
    both = old.withColumn("__old", F.lit(1)).unionByName(new.withColumn("__old", F.lit(0)), allowMissingColumns=True)
    was = [F.sum(F.when(F.col("__old") == 1, F.col(c)).otherwise(0)).alias(f"{c}_was") for c in columns]
    return both.groupBy(*keys).agg(*was, *[F.sum(c).alias(c) for c in columns])


# ---- q15 and q16 --------------------------------------------------------------------------------


class BidReport:
    """q15 and q16 as an updating result, exact, of streams that may also take bids back.

    ``references`` counts, per report row, bidder or auction, and price band, the bids that refer to it. A count that
    leaves or reaches zero changes the distinct count by one. ``weight`` names a column with 1 for a bid and -1 for one
    taken back; without it every row is a bid. The minutes of a report row are counted too (1,440 at most), so that the
    latest one can go back.
    """

    def __init__(self, spark: SparkSession, path: str, by_channel: bool = False, weight: str | None = None, buckets: int = 8):
        self.by_channel, self.weight = by_channel, weight
        self.keys = ["channel", "day"] if by_channel else ["day"]
        fields = ("channel string, " if by_channel else "") + "day date"
        counts = ", ".join(f"{c} long, {c}_was long" for c in COUNTS)
        self.references = KeyedTable(
            spark, f"{path}/references", f"{fields}, kind string, who long, {counts}", [*self.keys, "kind", "who"], buckets
        )
        report = ", ".join(f"{c} long" for c in REPORT_COLUMNS)
        self.report = KeyedTable(spark, f"{path}/report", f"{fields}, {report}, minutes map<int, long>", self.keys, buckets)

    def _counted(self, bid: DataFrame) -> DataFrame:
        one = F.col(self.weight).cast("long") if self.weight else F.lit(1).cast("long")
        bands = {"total": F.lit(True), **price_bands(F.col("price"))}
        return bid.select(
            *[F.col(k) for k in self.keys if k != "day"], F.to_date("dateTime").alias("day"), "bidder", "auction",
            minute_number(F.col("dateTime")).alias("minute"), *[F.when(c, one).otherwise(0).alias(n) for n, c in bands.items()],
        )

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        rows = self._counted(batch)
        who = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k[:-1]).alias("who")) for k in KINDS]))
        sums = [F.sum(c).alias(c) for c in COUNTS]
        changes = rows.select(*self.keys, *COUNTS, who.alias("w")).where("w.who IS NOT NULL").groupBy(*self.keys, "w.kind", "w.who").agg(*sums)

        def counted(old: DataFrame, new: DataFrame) -> DataFrame:
            was = ("total_was", "rank1_was", "rank2_was", "rank3_was")
            found = _union_sums(old.drop(*was), new, [*self.keys, "kind", "who"], COUNTS)
            return found.where("total <> 0 OR total_was <> 0")

        self.references.merge(batch_id, changes, counted)
        self.report.merge(batch_id, self._changes(rows, batch_id), self._merged)

    def _changes(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """What the batch adds to every column of the report."""

        def distinct(name: str, kind: str) -> Column:
            step = (F.col(name) > 0).cast("long") - (F.col(f"{name}_was") > 0).cast("long")
            return F.sum(F.when(F.col("kind") == kind, step).otherwise(0)).alias(f"{name}_{kind}")

        touched = self.references.touched(batch_id)
        people = touched.groupBy(*self.keys).agg(*[distinct(c, kind) for kind in KINDS for c in COUNTS])
        people = people.where(" OR ".join(f"{c}_{kind} <> 0" for kind in KINDS for c in COUNTS))
        if self.by_channel:
            per_minute = rows.groupBy(*self.keys, "minute").agg(*[F.sum(c).alias(c) for c in COUNTS])
            entries = F.collect_list(F.struct("minute", "total"))
            sums = [F.sum(c).alias(f"{c}_bids") for c in COUNTS]
            bids = per_minute.groupBy(*self.keys).agg(*sums, F.map_from_entries(entries).alias("minutes"))
        else:
            bids = rows.groupBy(*self.keys).agg(*[F.sum(c).alias(f"{c}_bids") for c in COUNTS])
            bids = bids.withColumn("minutes", F.create_map().cast("map<int, bigint>"))
        both = bids.unionByName(people, allowMissingColumns=True)
        added = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in REPORT_COLUMNS]
        return both.groupBy(*self.keys).agg(*added, F.first("minutes", ignorenulls=True).alias("minutes"))

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("__old", F.lit(True)).unionByName(new.withColumn("__old", F.lit(False)))
        is_old, none = F.col("__old"), F.create_map().cast("map<int, bigint>")
        maps = [F.coalesce(F.first(F.when(c, F.col("minutes")), ignorenulls=True), none) for c in (is_old, ~is_old)]
        summed = F.map_zip_with(*maps, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        found = both.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in REPORT_COLUMNS], summed.alias("minutes"))
        return found.withColumn("minutes", F.map_filter("minutes", lambda k, n: n != 0)).where("total_bids <> 0")

    def read(self, version: int | None = None) -> DataFrame:
        """The report as of a micro-batch, in the columns of the batch query."""
        minute = [minute_text(F.array_max(F.map_keys("minutes"))).alias("minute")] if self.by_channel else []
        keys = [F.col(k).cast("string") for k in self.keys]
        return self.report.read(version).select(*keys, *minute, *REPORT_COLUMNS)


# ---- q4 -----------------------------------------------------------------------------------------


class CategoryAverage:
    """q4 as an updating result: the average over auctions of their highest offer so far, per category.

    A maximum that rises changes its category's sum by the difference, and its count if it is the first. What a
    micro-batch reads is the buckets of its own auctions, however many batches there were before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.maxima = KeyedTable(spark, f"{path}/maxima", "id long, category long, final long, was long, fresh boolean", ["id", "category"], buckets)
        self.totals = KeyedTable(spark, f"{path}/totals", "category long, total long, n long, auctions long", ["category"], 1)

    def apply(self, offers: DataFrame, batch_id: int) -> None:
        highest = offers.groupBy("id", "category").agg(F.max("price").alias("final"))

        def raised(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.select("id", "category", "final", F.col("final").alias("was"), F.lit(False).alias("fresh")).unionByName(
                new.withColumns({"was": F.lit(None).cast("long"), "fresh": F.lit(True)})
            )
            return both.groupBy("id", "category").agg(F.max("final").alias("final"), F.max("was").alias("was"), F.min("fresh").alias("fresh"))

        self.maxima.merge(batch_id, highest, raised)
        known = lambda c: F.col(c).isNotNull().cast("long")
        changes = self.maxima.touched(batch_id).groupBy("category").agg(
            F.sum(F.coalesce("final", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("total"), F.sum(known("final") - known("was")).alias("n"),
            F.count_if("fresh").alias("auctions"),
        )

        def added(old: DataFrame, new: DataFrame) -> DataFrame:
            sums = [F.sum(c).alias(c) for c in ("total", "n", "auctions")]
            return old.unionByName(new).groupBy("category").agg(*sums)

        self.totals.merge(batch_id, changes, added)

    def read(self, version: int | None = None) -> DataFrame:
        """Categories with an auction that has an offer; the average is null if no offer has a price."""
        average = F.call_function("div", F.col("total"), F.nullif(F.col("n"), F.lit(0)))
        return self.totals.read(version).select("category", average.alias("final"))


# ---- q9, q19 ------------------------------------------------------------------------------------


class TopRows:
    """The first n rows per key as an updating result, merged by Catalyst's own top-N.

    The first n of a micro-batch and the n kept per touched key contain the new first n. A hot key sends n rows per map
    task (WindowGroupLimit). Remaining columns break ties. ``changelog`` also writes what each batch changed.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema, keys: list[str], order: list[tuple[str, bool]], n: int,
        rank: str = "rank_number", changelog: bool = False, buckets: int = 8,
    ):
        self.spark, self.path, self.keys, self.n, self.rank, self.changelog = spark, path, keys, n, rank, changelog
        self.columns = [f.name for f in schema]
        self.order = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
        self.table = KeyedTable(spark, f"{path}/rows", schema, keys, buckets)

    def first(self, rows: DataFrame, rank: str | None = None) -> DataFrame:
        return top_n(rows.select(*self.columns), self.keys, self.order, self.n, rank)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.table.merge(batch_id, self.first(batch), lambda old, new: self.first(old.unionByName(new)))
        if self.changelog:
            now, before = (self.first(self.table.touched(batch_id, b), self.rank) for b in (False, True))
            gone, come = before.exceptAll(now).withColumn("op", F.lit("-D")), now.exceptAll(before).withColumn("op", F.lit("+I"))
            gone.unionByName(come).write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")

    def changes(self) -> DataFrame:
        """What every micro-batch changed: rows with their rank, ``op`` (-D or +I) and batch_id."""
        return self.spark.read.parquet(f"{self.path}/changes")

    def read(self, version: int | None = None) -> DataFrame:
        return self.first(self.table.read(version), self.rank)
