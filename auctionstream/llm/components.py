"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame, functions as F

from auctionstream.session import stage

#: Far above what any graph needs; a loop that doesn't end is an error, not a result.
MOST_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Tie the larger neighbours of every node to the smallest of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "of")
    return both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them. Links are (larger u, smaller v)."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
    moved = links.join(least, F.col("u") == F.col("of")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("of").alias("u"), F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of a link. Columns of links: u, v.

    Large and small stars in turn; the number of rounds is logarithmic in the size of a component, also
    for long chains. Minima are combined before the shuffle and joins split by AQE, so the centre of a
    star with very many links is nobody's single task. Each round is written to the shared folder, which
    cuts the lineage. Links of a node with itself are ignored; no link gives no row.
    """
    larger = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stage(links.where("u <> v").select(*larger).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == before or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        before = state
        now = stage(_small_star(_large_star(now).distinct()).distinct(), "links")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
