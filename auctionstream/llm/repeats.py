"""Removal of byte strings that occur more than once, found with suffix arrays of shards."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from auctionstream.llm.common import bytes_of
from auctionstream.llm.suffix_arrays import permuted_prefixes, suffix_array
from auctionstream.session import stage

LENGTH = 400
#: Bytes whose hash chooses the shard of a string; a power of two.
ANCHOR = 64
#: Starts of strings that are looked at together in a long text.
PIECE = 1_000_000
#: Starts of strings in a segment at most; only in periodic text does a run with one key get that long.
MOST_STARTS = 4_096
#: Bytes gathered for one suffix array, and bytes of one shard key before it is split: these take a task some 300 MB.
SHARD_BYTES = 1_000_000
LARGEST_KEY = 3_500_000

SEGMENT = "doc_id long, th long, start int, len int, v long, digest long, again boolean"
SEPARATOR, FIRST_BYTE = 1, 2


def _anchor_hashes(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from every place on, by doubling."""
    h = (body.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    reach = 1
    while reach < ANCHOR:
        h = (h[:-reach] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[reach:] + (h[reach:] >> np.uint64(29)))
        reach *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row, from prefix and suffix minima of blocks."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[: n - width + 1], upto[width - 1 : n])


def segments(text: bytes, length: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """Cut the starts of all strings of ``length`` bytes into runs with one shard key.

    The key of a string is the smallest anchor hash in it, so equal strings have equal keys wherever they
    stand. Yields start, bytes up to the end of the run's last string, key, a hash of these bytes, and whether
    the text has the key's anchor more than once, as only then the run itself can hold a string twice. A run
    of more than MOST_STARTS starts is cut.
    """
    body = np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) - length + 1, PIECE):
        h = _anchor_hashes(body[begin : begin + PIECE + length - 1])
        key = _window_minima(h, length - ANCHOR + 1)
        changes = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        in_run = np.arange(len(key)) - np.repeat(changes, np.diff(np.append(changes, len(key))))
        starts = np.flatnonzero(in_run % MOST_STARTS == 0)
        ends = np.append(starts[1:], len(key)) + length - 1
        values = key[starts]
        small, counts = np.unique(h[h <= values.max()], return_counts=True)
        again = np.isin(values, small[counts > 1])
        for s, e, v, a in zip((begin + starts).tolist(), (begin + ends).tolist(), values.view(np.int64).tolist(), again.tolist()):
            yield s, e - s, v, xxhash.xxh64_intdigest(text[s:e]) - (1 << 63), a


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "th", "start", "len", "v", "digest", "again"]
    for batch in batches:
        rows = []
        for doc_id, th, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "th")], bytes_of(batch.column("text"))):
            rows += [(doc_id, th, *segment) for segment in segments(text, length)]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        bodies = pa.array([press.compress(x) for x in bytes_of(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), bodies], ["doc_id", "th", "body"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    names = ["v", "salt", "split", "digest", "doc_id", "th", "start", "bytes"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = zstandard.ZstdDecompressor().decompress(row["body"])
            rows += [
                (w["v"], w["salt"], w["split"], w["digest"], row["doc_id"], row["th"], w["start"], text[w["start"] : w["start"] + w["len"]])
                for w in row["wanted"]
            ]
            if len(rows) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def repeated_starts(parts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, by start: whether the string of ``length`` bytes also starts elsewhere in the parts, and whether
    it is the first of its equals in the order of suffixes."""
    pieces = []
    for part in parts:
        pieces += [np.frombuffer(part, np.uint8).astype(np.uint16) + FIRST_BYTE, np.array([SEPARATOR], np.uint16)]
    s = np.concatenate([*pieces, np.zeros(1, np.uint16)])
    before, shared = permuted_prefixes(s, suffix_array(s))
    places = np.flatnonzero(shared >= length)
    twice = np.zeros(len(s), bool)
    twice[places] = True
    twice[before[places]] = True
    out, at = [], 0
    for part in parts:
        end = at + len(part) - length + 1
        out.append((twice[at:end], shared[at:end] < length))
        at += len(part) + 1
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and salt. Whole keys are gathered into a suffix array.

    Yields intervals of repeated bytes; for keys that were split over shards also the hash of every
    different string of a suffix array, as intervals to count elsewhere.
    """
    names = ["doc_id", "th", "begin", "end", "v", "window"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def found(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for row, (twice, first) in zip(rows, repeated_starts([r["bytes"] for r in rows], length)):
            at = row["start"]
            out += [(row["doc_id"], row["th"], at + b, at + e + length - 1, row["v"], None) for b, e in _runs(twice)]
            if row["split"]:  # one of a string's equals is enough: those here are found, but may be the partner of one elsewhere
                for p in np.flatnonzero(first).tolist():
                    h = xxhash.xxh64_intdigest(row["bytes"][p : p + length], 7) - (1 << 63)
                    out.append((row["doc_id"], row["th"], at + p, at + p + length, row["v"], h))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    held: list[dict] = []
    n_bytes, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            shard = (row["v"], row["salt"])
            if n_bytes >= SHARD_BYTES and shard != last:
                yield found(held)
                held, n_bytes = [], 0
            held.append(row)
            n_bytes += len(row["bytes"])
            last = shard
    if held:
        yield found(held)


def _stripped(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = zstandard.ZstdDecompressor().decompress(row["body"])
            kept, at, removed, spans = [], 0, 0, []
            for begin, end in sorted((x["begin"], x["end"]) for x in row["intervals"] or []):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            for begin, end in spans:
                kept.append(text[at:begin])
                removed += end - begin
                at = end
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((row["doc_id"], len(text), removed, len(spans), hashlib.sha256(rest).hexdigest(), spans, rest if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)


def _same_document(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b)) & (F.col("th") == F.col("th_"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, largest_key: int = LARGEST_KEY, with_text: bool = False) -> DataFrame:
    """Remove every byte in a string of ``length`` bytes that also starts elsewhere, in any document.

    Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end of what was removed)
    and, if asked for, the kept bytes.

    1. Starts of strings are cut into segments by shard key (``segments``). Keys found once are done: all
       their strings are unique. Most of the text ends here, as a narrow row.
    2. Segments with equal bytes are repeated from end to end. Of the other segments that share a key one
       each goes, with its bytes, to the key's shard, where a suffix array and its common prefixes tell the
       repeated strings.
    3. A key with more than ``largest_key`` bytes of different segments is split over shards. Each sorts its part and
       reports its different strings by hash, and strings reported by two shards are repeated as well.

    ``length`` is above ANCHOR. Strings are compared byte by byte within a shard and by 128 bits of hashes
    elsewhere. Null and shorter texts lose nothing. Equal rows count as different documents. Other columns
    are not read; an empty table gives no row. Runs jobs when called and writes below the shared folder.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    cut = stage(rows.mapInArrow(lambda b: _segment_rows(b, length), SEGMENT), "segments")
    keys = (
        cut.groupBy("v").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("again").alias("any"))
        .where("n > 1 OR any").select(F.col("v").alias("key"), ((F.col("lo") != F.col("hi")) | F.col("any")).alias("mixed"))
    )
    shared = stage(cut.join(keys, F.col("v") == F.col("key")).drop("key", "again"), "shared-segments")
    first = F.min(F.struct("doc_id", "th", "start", "len", "mixed")).alias("f")
    different = stage(shared.groupBy("v", "digest").agg(F.count("*").alias("n"), first), "different-segments")
    whole = different.where("n > 1").select(F.col("v").alias("key"), F.col("digest").alias("same"))
    full = shared.join(whole, (F.col("v") == F.col("key")) & (F.col("digest") == F.col("same"))).select(
        "doc_id", "th", F.col("start").alias("begin"), (F.col("start") + F.col("len")).alias("end")
    )
    contested = different.where("f.mixed").select("v", "digest", "f.doc_id", "f.th", "f.start", "f.len")
    sizes = contested.groupBy("v").agg(F.sum("len").alias("n")).withColumnRenamed("v", "key")
    pieces = F.ceil(F.col("n") / largest_key)
    wanted = contested.join(sizes, F.col("v") == F.col("key")).groupBy("doc_id", "th").agg(
        F.collect_list(F.struct(
            "v", F.pmod("digest", pieces).cast("int").alias("salt"), (pieces > 1).alias("split"), "digest", "start", "len"
        )).alias("wanted")
    ).withColumnsRenamed({"doc_id": "doc", "th": "th_"})
    bodies = rows.mapInArrow(_packed, "doc_id long, th long, body binary")
    parts = bodies.join(wanted, _same_document("doc_id", "doc")).select("doc_id", "th", "body", "wanted").mapInArrow(
        _cut, "v long, salt int, split boolean, digest long, doc_id long, th long, start int, bytes binary"
    )
    found = stage(
        parts.repartition("v", "salt").sortWithinPartitions("v", "salt").mapInArrow(
            lambda b: _sorted_shards(b, length),
            "doc_id long, th long, begin int, end int, v long, window long",
        ),
        "repeats",
    )
    repeated = full.union(found.where("window IS NULL").select("doc_id", "th", "begin", "end"))
    reported = found.where("window IS NOT NULL")
    if not reported.isEmpty():  # only if a key was split
        twice = reported.groupBy("v", "window").agg(F.count("*").alias("n")).where("n > 1").select(
            F.col("v").alias("key"), F.col("window").alias("same")
        )
        across = reported.join(twice, (F.col("v") == F.col("key")) & (F.col("window") == F.col("same")))
        repeated = repeated.union(across.select("doc_id", "th", "begin", "end"))
    intervals = repeated.groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("intervals")).withColumnsRenamed(
        {"doc_id": "doc", "th": "th_"}
    )
    return bodies.join(intervals, _same_document("doc_id", "doc"), "left").select("doc_id", "body", "intervals").mapInArrow(
        lambda b: _stripped(b, with_text),
        """doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>, kept binary""",
    )
