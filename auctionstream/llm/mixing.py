"""Mixing sources to target weights with fixed-length blocks of words."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from auctionstream.llm.common import SPACE, WORD, let, unsigned
from auctionstream.llm.running import ROWS_PER_BUCKET, buckets_for, running_total
from auctionstream.session import stage

BLOCK_WORDS = 64
SHARDS = 64
#: Slots that one row of the draws stands for at most, so that hot sources are dealt out.
SLOTS_PER_ROW = 16_384
#: Tasks that write slots out at most; below, one per bucket of documents.
MOST_TASKS = 10_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2


def n_words(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_group(docs: DataFrame) -> DataFrame:
    """``__group``: the source with null as a value of its own that sorts last."""
    return docs.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~")))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: __of, source_size, target.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all sizes. A
    target stops at ``most`` times its source's size; the excess goes to the others by weight. That is the
    level L with the sum of min(most * size, weight * L) right: sources in order of cap / weight are full
    as long as the level over the rest stays above them.
    """
    sizes = sized.groupBy("__group").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("__group")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("__cap") / F.col("__weight"), "__group")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * share - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))
    ) / F.sum("__weight").over(later)
    levels = capped.withColumn("__level", level)
    full = F.col("__level") * F.col("__weight") > F.col("__cap")
    # The level of the first source that isn't full; all are full only if everything is empty.
    final = F.min(F.when(~full, F.struct(F.col("__cap") / F.col("__weight"), F.col("__group"), F.col("__level")))).over(whole)
    return levels.select(
        F.col("__group").alias("__of"), "source_size",
        F.least("__cap", F.col("__weight") * F.coalesce(final["__level"], F.lit(0.0))).alias("target"),
    )


def _drawn(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n slots fall on ``good`` places out of good + bad, each place taken once at most."""
    if good + bad <= 10**9:  # as far as numpy's generator goes
        return int(random.hypergeometric(good, bad, n)) if n else 0
    share = good / (good + bad)
    spread = (n * share * (1 - share) * ((good + bad - n) / (good + bad - 1))) ** 0.5
    return min(max(round(random.normal(n * share, spread)), n - bad, 0), n, good)


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source (columns) each output shard (rows) draws.

    Every shard has the same number of blocks, to one. Its counts are a multinomial draw by the sources' shares, under the
    condition that all shards together draw each source's slots exactly: so sources are dealt one after the other, each
    over the places that the earlier ones have left.
    """
    random, total = np.random.default_rng(seed), sum(slots)
    places = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    counts = np.zeros((shards, len(slots)), np.int64)
    for s, left in enumerate(slots):
        others = sum(places)
        for k in range(shards):
            others -= places[k]
            counts[k, s] = n = _drawn(random, places[k], others, left)
            places[k] -= n
            left -= n
    return counts


def _draws(frames: Iterator[pd.DataFrame], shards: int, seed: int) -> Iterator[pd.DataFrame]:
    """The blocks that each output shard draws of each source, as ranges of the source's slots. One row per source comes in."""
    plan = pd.concat(list(frames), ignore_index=True)
    plan = plan.sort_values("__of", ignore_index=True)
    counts = shard_counts(plan["slots"].tolist(), shards, seed)
    for group, n_blocks, own in zip(plan["__of"], plan["n_blocks"], counts.T):
        ends = np.cumsum(own)
        for shard, (first, end) in enumerate(zip(ends - own, ends)):
            cuts = np.arange(first, end, SLOTS_PER_ROW)
            yield pd.DataFrame({
                "group": group, "n_blocks": n_blocks, "shard": np.int32(shard), "first": cuts,
                "last": np.minimum(cuts + SLOTS_PER_ROW, end) - 1,
            })


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, chosen by the key, applied to each index; all arrays uint64.

    A Feistel network permutes the next even power of two; values at or above n are sent through it again
    until they fall below, which keeps it a permutation.
    """
    half = np.ones(len(n), np.uint64)
    while (open_ := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half += open_.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for step in range(4):
            mixed = (right + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def _blocks_of(frames: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n = frame["n_blocks"].to_numpy(np.uint64)
        slot = frame["slot"].to_numpy(np.uint64)
        round_ = slot // n
        names = {g: zlib.crc32(g.encode()) for g in frame["group"].unique()}
        key = frame["group"].map(names).to_numpy(np.uint64) * np.uint64(1_000_003) + round_ + np.uint64(seed << 40)
        block = permuted(slot % n, n, key)
        yield frame.assign(block=block.astype(np.int64), round=round_.astype(np.int64))[["group", "shard", "slot", "round", "block"]]


def slots(targets: DataFrame, block_words: int, shards: int, seed: int, most: int = MOST, tasks: int = 1) -> DataFrame:
    """The mix: one row per slot of an output shard, with the source's block that fills it.

    Ranges of slots are few bytes, so the number of tasks that write them out is given, not left to AQE.
    """
    n_blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.round(F.col("target") / F.col("source_size") * n_blocks)
    plan = targets.where("source_size > 0").select(
        "__of", n_blocks.cast("long").alias("n_blocks"),
        F.least(wanted, n_blocks * most).cast("long").alias("slots"),
    )
    # One row per source, as in source_targets: shards are drawn over all sources at once.
    ranges = plan.coalesce(1).mapInPandas(
        lambda frames: _draws(frames, shards, seed), "group string, n_blocks long, shard int, first long, last long"
    )
    each = ranges.repartition(tasks, "group", "shard", "first").select(
        "group", "n_blocks", "shard", F.explode(F.sequence("first", "last")).alias("slot")
    )
    return each.mapInPandas(
        lambda frames: _blocks_of(frames, seed), "group string, shard int, slot long, round long, block long"
    )


def packed(rows: DataFrame, narrow: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Add ``__start``: the words of the source before the document, in a seeded pseudorandom order."""
    share = unsigned(F.col("__random")) / F.lit(float(2**53))
    bucket = F.floor(share * buckets)
    mixed, narrow = (df.withColumn("__random", F.xxhash64(F.lit(seed), "doc_id")) for df in (rows, narrow))
    return running_total(mixed, "__group", bucket, ["__random", "size", "__text"], F.col("size"), "__start", narrow)


def mix(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights=WEIGHTS, share: float = SHARE,
    most: int = MOST, seed: int = 11, rows_per_bucket: int = ROWS_PER_BUCKET, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with their place and target, and the pieces of them that the mix takes.

    The words of a source, its documents in a seeded order, are cut into blocks of ``block_words``. A
    source has as many slots as its target asks for, to the nearest block. All output shards hold equally many
    blocks; how many of which source each holds is drawn (shard_counts). Slot j takes block P(j) with P a pseudorandom
    permutation of the blocks, another one in each round over them, so no block is taken twice before all
    are taken once, and none more than ``most`` times.

    Documents: doc_id, source, size, source_size, target, __group, __start and the columns in ``keep``.
    Pieces: group, shard, slot, round, start (__start of the document), first, last (words of the document,
    from 0, both included).

    Null sources form a source of their own, last in order. Null and empty texts have size 0 and are not
    taken. Identical rows have places of their own. An empty table gives none. Reruns agree. Names
    starting with ``__`` are reserved. Runs jobs when called: the sizes are written below the shared folder,
    so that texts are counted once, and once more if they are kept.
    """
    rows = with_group(docs).select(
        "doc_id", "source", "__group", *keep, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("__text")
    )
    narrow = stage(rows.drop(*keep), "sizes")
    buckets = buckets_for(narrow.count(), rows_per_bucket)
    placed = packed(rows if keep else narrow, narrow, seed, buckets)
    targets = source_targets(narrow, weights, share, most)
    block = F.explode(F.sequence(
        F.floor(F.col("__start") / block_words), F.floor((F.col("__start") + F.col("size") - 1) / block_words)
    ))
    begin = F.col("block") * block_words - F.col("__start")
    pieces = (
        placed.where("size > 0").select("__group", "__start", "size", block.alias("block"))
        .select(
            F.col("__group").alias("__of"), F.col("block").alias("__block"), F.col("__start").alias("start"),
            F.greatest(begin, F.lit(0)).alias("first"), F.least(begin + block_words, F.col("size")).alias("end"),
        )
        .select("__of", "__block", "start", "first", (F.col("end") - 1).alias("last"))
    )
    drawn = slots(targets, block_words, shards, seed, most, min(buckets, MOST_TASKS))
    # The slots are made in tasks from a few rows per source, so Catalyst takes them for small: no broadcast.
    taken = drawn.hint("merge").join(pieces, (F.col("group") == F.col("__of")) & (F.col("block") == F.col("__block"))).select(
        "group", "shard", "slot", "round", "start", "first", "last"
    )
    table = placed.join(targets, F.col("__group") == F.col("__of")).select(
        "doc_id", "source", "size", "source_size", "target", "__group", "__start", *keep
    )
    return table, taken


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and ``taken``, the words that the mix takes of it."""
    table, pieces = mix(docs, **options)
    per_doc = pieces.groupBy("group", "start").agg(F.sum(F.col("last") - F.col("first") + 1).alias("taken"))
    # A document without words starts where the next one does, and takes nothing.
    same = (F.col("__group") == F.col("group")) & (F.col("__start") == F.col("start")) & (F.col("size") > 0)
    return table.join(per_doc, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def shard_blocks(docs: DataFrame, **options) -> DataFrame:
    """What the output shards hold: shard, group, slot, round, block and the pieces of documents that fill the block,
    by __start of the document in its source's order."""
    _, pieces = mix(docs, **options)
    filled = F.sort_array(F.collect_list(F.struct("start", "first", "last"))).alias("pieces")
    return pieces.groupBy("shard", "group", "slot", "round").agg(filled)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: per round over its source, a document's words that were taken.

    A document taken whole keeps its exact text; of another one the taken pieces remain, joined by a
    space, each with the white space inside it. ``n_chars`` follows the text; other columns are kept.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("doc_id", "source", "text", F.struct(*columns).alias("__doc"))
    table, pieces = mix(rows, keep=("__doc",), **options)
    per_round = pieces.groupBy("group", "start", "round").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("__taken"),
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__pieces"),
    )
    same = (F.col("__group") == F.col("group")) & (F.col("__start") == F.col("start")) & (F.col("size") > 0)
    # Words with the white space after them: the pieces of a text are then plain concatenations.
    parts = F.regexp_extract_all(F.col("__doc.text"), F.lit(f"({WORD}{SPACE}*)"), 1)
    cut = let(parts, lambda w: F.array_join(
        F.transform("__pieces", lambda p: F.array_join(F.slice(w, p["first"] + 1, p["last"] - p["first"] + 1), "")), ""
    ))
    whole = F.col("__taken") == F.col("size")
    found = table.join(per_round, same).withColumn("__text", F.when(whole, F.col("__doc.text")).otherwise(F.rtrim(cut)))
    values = {"text": F.col("__text"), "n_chars": F.char_length("__text")}
    return found.select(*[
        values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.col(f"__doc.`{f.name}`") for f in docs.schema
    ])
