"""Near-duplicates by SimHash fingerprints, compared in bit-sliced blocks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from auctionstream.llm.common import NO_ID, bytes_of, id_key
from auctionstream.llm.components import components
from auctionstream.session import stage

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints in one bit-sliced block.
BLOCK = 1_024
#: Buckets above this are refined by further bits instead of being compared as they are.
LARGEST_BUCKET = 2_048
ROWS_AT_ONCE = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes. 0 without words."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-1]]]
    last = ends[min(size, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, last)], np.uint64)
    in_bytes = hashes.view(np.uint8).reshape(-1, 8)
    set_ = np.concatenate([np.bincount(in_bytes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in bytes_of(batch.column("text"))], np.uint64).view(np.int64)
        columns = [batch.column(c) for c in ("doc_id", "key", "th")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], ["doc_id", "key", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and th (to know the row by) and fp (the 64 bits as a signed number) per row.

    Null and empty texts have fingerprint 0.
    """
    key = id_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("key"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, key long, th long, fp long")


def sliced_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of a block whose fingerprints differ in at most ``radius`` <= 2 bits.

    The block is stored as 64 bit planes, 64 fingerprints to a word. A fingerprint's differences in one
    plane are added to all its distances at once by a carry-save counter of two bits that stops at three.
    Rows of which every distance has passed the radius are abandoned.
    """
    n = len(prints)
    width = -(-n // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)  # 64 x width
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    lefts, rights = [], []
    for begin in range(0, n, ROWS_AT_ONCE):
        rows = np.arange(begin, min(n, begin + ROWS_AT_ONCE))
        # Partners up to the row itself, and those beyond the block, count as too far from the start.
        past = np.packbits(np.arange(width * 64)[None, :] <= rows[:, None], axis=1, bitorder="little").view(np.uint64)
        if n % 64:
            past[:, -1] |= everything << np.uint64(n % 64)
        ones, twos = np.zeros_like(past), np.zeros_like(past)
        for plane in range(64):
            own = np.where((prints[rows] >> np.uint64(plane)) & np.uint64(1), everything, np.uint64(0))
            differ = planes[plane][None, :] ^ own[:, None]
            carry = ones & differ
            ones ^= differ
            past |= twos & carry  # four; three is ones & twos
            twos |= carry
            if plane % 8 == 7:
                far = _too_far(ones, twos, past, radius)
                alive = ~(far == everything).all(axis=1)
                rows, ones, twos, past = rows[alive], ones[alive], twos[alive], past[alive]
                if not len(rows):
                    break
        if len(rows):
            near = ~_too_far(ones, twos, past, radius)
            found = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(found)
            lefts.append(rows[i])
            rights.append(j)
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(lefts), np.concatenate(rights)


def _too_far(ones: np.ndarray, twos: np.ndarray, past: np.ndarray, radius: int) -> np.ndarray:
    reached = {0: ones | twos, 1: twos, 2: ones & twos}[radius]
    return past | reached


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable for each of n points."""
    label = np.arange(n)
    while True:
        least = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(least, left, low)
        np.minimum.at(least, right, low)
        np.minimum.at(least, label, least.copy())
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a block, reduced to one per fingerprint to the smallest of its component."""
    left, right = sliced_links(prints)
    label = roots(len(prints), left, right)
    moved = label != np.arange(len(prints))
    return prints[moved], prints[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. Whole buckets are gathered into blocks of at least BLOCK rows."""
    held: list[np.ndarray] = []
    n_held, last = 0, None

    def links(prints: np.ndarray) -> pa.RecordBatch:
        a, b = _forest(np.unique(prints))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        mask = batch.column("mask").to_numpy().view(np.uint64)
        prints = batch.column("fp").to_numpy().view(np.uint64)
        bucket = np.stack([mask, prints & mask], axis=1)
        ends = np.flatnonzero((bucket[1:] != bucket[:-1]).any(axis=1)) + 1
        cuts = [0, *ends.tolist(), len(prints)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if n_held >= BLOCK and (last is None or tuple(bucket[begin]) != last):
                yield links(np.concatenate(held))
                held, n_held = [], 0
            held.append(prints[begin:end])
            n_held += end - begin
            last = tuple(bucket[begin])
    if held:
        yield links(np.concatenate(held))


def _masks(free: list[int]) -> list[tuple[int, list[int]]]:
    """Ways to fix two of four parts of the free bits: two prints that differ in at most two bits agree in one."""
    quarter = len(free) // 4
    parts = [free[k * quarter : (k + 1) * quarter] for k in range(4)]
    out = []
    for a in range(4):
        for b in range(a + 1, 4):
            fixed = parts[a] + parts[b]
            out.append((sum(1 << bit for bit in fixed), [x for x in free if x not in fixed]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _next_masks(fixed: int, free: list[int]) -> list[tuple[int, list[int]]]:
    return [(fixed | more, left) for more, left in _masks(free)]


def _explode_masks(masks: Column) -> list[Column]:
    return [F.col("fp"), F.explode(masks).alias("mask")]


def links(prints: DataFrame, largest: int = LARGEST_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all pairs within the radius.

    Fingerprints are dealt into buckets of equal bits: of four quarters of the bits two must agree. A
    bucket with more than ``largest`` fingerprints is dealt again by halves of what is left free, three
    times if need be; then at most 2^8 remain in one. So no bucket is ever cut or compared in one task
    beyond that size, and no pair within the radius is missed.
    """
    level = [(0, list(range(64)))]
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    for depth in range(3):
        following = [(fixed, _next_masks(fixed, free)) for fixed, free in level]
        table = F.create_map(*[
            x for fixed, masks in following
            for x in (F.lit(_signed(fixed)), F.array(*[F.lit(_signed(m)) for m, _ in masks]))
        ])
        dealt = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        level = list({m: (m, free) for _, masks in following for m, free in masks}.values())
        bits = F.col("fp").bitwiseAND(F.col("mask"))
        counts = (
            dealt.groupBy("mask", bits.alias("bits")).agg(F.count("*").alias("n")).where("n > 1")
            .withColumnsRenamed({"mask": "of", "bits": "at"})
        )
        in_bucket = dealt.join(counts, (F.col("mask") == F.col("of")) & (bits == F.col("at"))).drop("of")
        last = depth == 2
        near = in_bucket if last else in_bucket.where(F.col("n") <= largest)
        compared = (
            near.repartition("mask", "at").sortWithinPartitions("mask", "at").select("mask", "fp")
            .mapInArrow(_compare, "u long, v long")
        )
        found = compared if found is None else found.union(compared)
        if last:
            return found
        # A print that sits in several large buckets is refined in each.
        rows = stage(in_bucket.where(F.col("n") > largest).select("fp", "mask"), "large-buckets")
        if rows.isEmpty():
            return found


def classes(docs: DataFrame, largest: int = LARGEST_BUCKET) -> DataFrame:
    """Per row: doc_id, key, th, fp, component_id (the smallest doc_id whose fingerprint is reachable by links)
    and stays (for one document of each component: that of the smallest id, then text hash).

    Texts without words share fingerprint 0 and are linked like others. A null id sorts after all others;
    component_id is null only if all ids of the component are. Ids are below 2^62. Repeated rows are kept.
    An empty table gives no row. Other columns are not read. Runs jobs when called and writes
    fingerprints and links below the shared folder.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct("key", "th")).alias("least"))
    tied = components(links(distinct.select("fp"), largest))
    # Most fingerprints have no link: only those with one are looked up.
    of = tied.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("id"))
    ids = tied.join(of.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "id")
    named = distinct.join(ids, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("own"), F.coalesce("id", "least").alias("first")
    )
    component = F.col("first.key")
    return prints.join(named, F.col("fp") == F.col("own")).select(
        "doc_id", "key", "th", "fp", F.when(component < NO_ID, component).alias("component_id"),
        (F.struct("key", "th") == F.col("first")).alias("stays"),
    )


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each component left: the one that ``classes`` says stays, once if its row
    is repeated. All columns are kept."""
    kept = classes(docs, **options).where("stays").select(F.col("key").alias("__k"), F.col("th").alias("__h")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({"__key": id_key(F.col("doc_id"), F.col("text")), "__th": F.xxhash64("text")})
    same = Window.partitionBy("__key", "__th").orderBy(F.xxhash64(*columns))
    chosen = rows.join(kept, (F.col("__key") == F.col("__k")) & (F.col("__th") == F.col("__h")), "left_semi")
    return chosen.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*columns)
