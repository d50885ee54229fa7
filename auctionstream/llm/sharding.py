"""Shards that all hold the sources in the proportions of the whole: stratified interleaving."""

from pyspark.sql import DataFrame, functions as F

from auctionstream.llm.common import unsigned
from auctionstream.llm.running import ROWS_PER_BUCKET, buckets_for, running_total


def interleave(
    docs: DataFrame, n_shards: int, stratum: str = "source", seed: int = 7, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row.

    Rows of a stratum are ranked in a seeded pseudorandom order; all rows are sorted by their fractional
    rank ``(rank + 1/2) / rows of the stratum`` and the order is cut into shards. Shards differ by at most
    one row, and a shard holds of every stratum its proportion give or take about one row. ``slot`` counts
    a shard's rows from 0 without gaps.

    A null stratum is a stratum of its own. Null ids and texts are values like others. Identical rows get
    places of their own. An empty table gives no rows. Columns named shard or slot are replaced; names
    starting with ``__`` are reserved.
    """
    n = docs.count()
    buckets = buckets_for(n, rows_per_bucket)
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.withColumns({
        "__stratum": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")),
        "__random": F.xxhash64(F.lit(seed), "doc_id"),
        "__row": F.xxhash64(*columns),
    })
    counts = rows.groupBy("__stratum").agg(F.count("*").alias("__rows")).withColumnRenamed("__stratum", "__s")
    share = unsigned(F.col("__random")) / F.lit(float(2**53))
    ranked = running_total(
        rows, "__stratum", F.floor(share * buckets), ["__random", "__row"], F.lit(1), "__rank"
    )
    fraction = (F.col("__rank") + 0.5) / F.col("__rows")
    spread = (
        ranked.join(counts, F.col("__stratum") == F.col("__s")).drop("__s")
        .withColumns({"__fraction": fraction, "__all": F.lit(0)})
    )
    tie = spread.withColumn("__tie", F.xxhash64(F.lit(seed), "__stratum"))
    placed = running_total(
        tie, "__all", F.floor(F.col("__fraction") * buckets), ["__fraction", "__tie", "__rank"], F.lit(1), "__place"
    )
    shard = F.call_function("div", F.col("__place") * n_shards, F.lit(max(n, 1)))
    first = F.call_function("div", F.col("shard") * F.lit(n) + (n_shards - 1), F.lit(n_shards))
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("__place") - first)
        .select(*columns, "shard", "slot")
    )


def sharded(docs: DataFrame, n_shards: int, **options) -> DataFrame:
    """``interleave`` on the narrow columns: id, size, checksum, shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return interleave(narrow, n_shards, **options)


def write_shards(docs: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write the documents themselves, one folder ``shard=n`` per shard, in the order of their slots."""
    rows = interleave(docs, n_shards, **options)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
