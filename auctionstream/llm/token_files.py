"""Token ids in files of fixed-width bit packing.

A file is Parquet; each row is a block: the ids of whole documents, each in the least number of bits that
the vocabulary needs, with the document ids and the offsets of their first tokens. Any token of a block
can be unpacked without the others.
"""

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK_IDS = 65_536
#: Words and pieces of words whose ids a Python worker remembers.
REMEMBERED = 250_000
#: Bytes of text that are tokenised at once.
AT_ONCE = 2_000_000
BLOCKS = """part int, block int, part_start long, bits int, doc_ids array<long>, offsets array<int>, n_ids int,
 payload binary"""


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, least significant bit first. Eight ids fill ``bits`` whole bytes."""
    eights = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    eights[: len(ids)] = ids
    eights = eights.reshape(-1, 8)
    out = np.zeros((len(eights), bits + 8), np.uint8)
    for place in range(8):
        first, shift = divmod(place * bits, 8)
        value = eights[:, place] << np.uint64(shift)
        for byte in range(-(-(shift + bits) // 8)):
            out[:, first + byte] |= (value >> np.uint64(8 * byte)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """The ``count`` ids from number ``first`` on."""
    begin, end = first * bits // 8, ((first + count) * bits + 7) // 8
    raw = np.zeros(end - begin + 8, np.uint8)
    raw[: end - begin] = np.frombuffer(payload, np.uint8, end - begin, begin)
    position = np.arange(first, first + count, dtype=np.int64) * bits - begin * 8
    byte, shift = position >> 3, (position & 7).astype(np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: A word of plain letters, digits and marks, without what the tokenizer treats apart (apostrophes) or composes.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = f"^[{LETTERS}0-9{MARKS}]+$"
#: Its pieces: the tokenizer splits it into runs of letters, single digits, and runs of marks.
PIECES = f"([{LETTERS}]+|[0-9]|[{MARKS}]+)"


@lru_cache(1)
def shown_bytes() -> list[str]:
    """The character by which a byte-level model knows each byte: its own if it is printed, else the next one from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


def laid(values: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``chosen`` numbers, one after the other, and where each ends. Run i has sizes[i] values."""
    taken = sizes[chosen]
    behind = np.cumsum(taken)
    first = (np.cumsum(sizes) - sizes)[chosen]
    total = int(behind[-1]) if len(behind) else 0
    at = np.arange(total, dtype=np.int32 if max(total, len(values)) < 2**31 else np.int64)
    at += np.repeat((first - (behind - taken)).astype(at.dtype), taken)
    return values[at], behind


class WordIds(dict):
    """Ids of pieces of words as little-endian 32-bit numbers, asked of the library while they are remembered once.

    The tokenizer must split at white space and drop it, as its normaliser and pre-tokeniser show; then
    the ids of a text are those of its words, one after the other. Plain words are split further, and the model is
    asked for their pieces, which far more words share. Of what it remembers it forgets the half that was not asked for lately.
    """

    def __init__(self, library):
        super().__init__()
        self.library, self.model = library, library.model
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.earlier: dict[str, bytes] = {}
        self.table = shown_bytes()
        self.plain = re.compile(PLAIN)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.earlier = dict(self)
            self.clear()
        found = self.earlier.get(piece)
        if found is None:
            if self.plain.match(piece):
                shown = piece if piece.isascii() else "".join([self.table[b] for b in piece.encode()])
                ids = [t.id for t in self.model.tokenize(shown)]
            else:
                ids = self.library.encode(piece, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        self[piece] = found
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        apart = pc.ascii_rtrim(pc.replace_substring_regex(pc.utf8_lower(words), PIECES, "\\1 "), " ")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(words, PLAIN), apart, words))
        coded = split.flatten().dictionary_encode()
        found = [self[p] if p else b"" for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, behind = laid(np.frombuffer(b"".join(found), "<u4"), sizes, coded.indices.to_numpy())
        return ids, np.diff(np.append(0, behind)[split.offsets.to_numpy()])

    def of_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has.

        Arrow splits the texts at white space, numbers their different words and splits those into pieces; Python sees each
        different piece once.
        """
        strange = {
            i: np.array(self.library.encode(t.as_py(), add_special_tokens=False).ids, "<u4")
            for special in self.special for i in pc.indices_nonzero(pc.match_substring(texts, special)).to_pylist() for t in [texts[i]]
        }
        if strange:
            blank = np.zeros(len(texts), bool)
            blank[list(strange)] = True
            texts = pc.if_else(pa.array(blank), "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()  # white space at an end leaves an empty word
        flat, behind = laid(*self._of_words(coded.dictionary), coded.indices.to_numpy())
        edges = np.append(0, behind)[split.offsets.to_numpy()]
        counts = np.diff(edges)
        if strange:
            parts = [flat[a:b] for a, b in zip(edges, edges[1:])]
            for i, found_ids in strange.items():
                parts[i] = found_ids
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, counts

    def of(self, text: str) -> np.ndarray:
        return self.of_many(pa.array([text], pa.large_string()))[0].astype(np.uint32)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(tokenizer(path))


def text_portions(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of portions of at most ``limit`` bytes, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i - begin
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes) - begin


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bits: int) -> Iterator[pa.RecordBatch]:
    library, part = word_ids(path), TaskContext.get().partitionId()
    block = start = 0
    ids, doc_ids, offsets, n_ids = [], [], [], 0
    end_ids = np.array([end_id], np.uint32)

    def flushed() -> pa.RecordBatch:
        nonlocal block, start, ids, doc_ids, offsets, n_ids
        row = [[part], [block], [start], [bits], [doc_ids], [offsets], [n_ids], [pack(np.concatenate(ids), bits)]]
        block, start = block + 1, start + n_ids
        ids, doc_ids, offsets, n_ids = [], [], [], 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        names = ["part", "block", "part_start", "bits", "doc_ids", "offsets", "n_ids", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for at, n_rows in text_portions(batch.column("text"), AT_ONCE):
            texts = pc.fill_null(batch.column("text").slice(at, n_rows).cast(pa.large_string()), "")
            found, counts = library.of_many(texts)
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for doc_id, begin, end in zip(batch.column("doc_id").slice(at, n_rows).to_pylist(), edges, edges[1:]):
                n_own = end - begin + 1
                if n_ids and n_ids + n_own > BLOCK_IDS:
                    yield flushed()
                doc_ids.append(doc_id)
                offsets.append(n_ids)
                ids += [found[begin:end], end_ids]
                n_ids += n_own
    if doc_ids:
        yield flushed()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None) -> None:
    """Write the token ids of all documents in ascending order of their ids, each followed by ``end_id``.

    Null ids come first; documents of one id are ordered by their text's hash. Null and empty texts have
    only the end id. An empty table writes no block. Documents are range-partitioned by id and hash, so an
    id that many rows share is still dealt out, and each task writes the blocks of one range. A document
    is never cut: one longer than a block gets a block of its own.
    """
    bits = width(max(vocabulary or tokenizer(tokenizer_path).get_vocab_size(), end_id + 1))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("__hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash", "text")
    ordered.select("doc_id", "text").mapInArrow(
        lambda batches: _blocks(batches, tokenizer_path, end_id, bits), BLOCKS
    ).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = [*row["offsets"][1:], row["n_ids"]]
            counts = [end - begin for begin, end in zip(row["offsets"], ends)]
            sums = [
                zlib.crc32(unpack(row["payload"], row["bits"], first, count).astype("<u4").tobytes())
                for first, count in zip(row["offsets"], counts)
            ]
            starts = [row["part_start"] + first for first in row["offsets"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(counts), pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """The ids before each part of the files: one row per task that wrote."""
    totals = spark.read.schema(BLOCKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("of"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    found = spark.read.schema(BLOCKS).parquet(path).mapInArrow(
        _documents, "doc_id long, part int, start long, n_tokens long, ids_crc32 long"
    )
    starts = part_starts(spark, path)
    return found.join(starts, F.col("part") == F.col("of")).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each, if several share the id); other blocks are not read."""
    holds = F.array_contains("doc_ids", F.lit(doc_id).cast("long"))
    out = []
    for row in spark.read.schema(BLOCKS).parquet(path).where(holds).toLocalIterator():
        ends = [*row.offsets[1:], row.n_ids]
        for own, begin, end in zip(row.doc_ids, row.offsets, ends):
            if own == doc_id:
                out.append(unpack(row.payload, row.bits, begin, end - begin))
    return out
