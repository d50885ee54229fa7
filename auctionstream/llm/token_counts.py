"""Token counts of whole texts; huge ones are encoded in overlapping chunks."""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auctionstream.llm.common import portions

CHUNK = 32_768
OVERLAP = 256
#: Characters of text that the library gets at once.
PORTION = 1_000_000
SPACE_PIECE = "▁"


@lru_cache(2)
def encoder(path: str):
    """The model, and the pairs of neighbouring characters that some piece of its vocabulary holds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace(SPACE_PIECE, " ")
            pairs.update(zip(piece, piece[1:]))
    return model, frozenset(pairs)


def stable_boundary(text: str, begin: int, end: int, pairs: frozenset) -> int | None:
    """The first place after ``begin`` and before ``end`` that no piece can span.

    A merge joins two symbols only to a piece of the vocabulary. If no piece holds the two characters
    around a place next to each other, no merge ever crosses it, whatever stands on either side. So both
    chunks that cover it have a token boundary there and equal tokens from it on, as far as both reach.
    """
    shown = text[begin:end].replace(SPACE_PIECE, " ")  # the library takes both for one character
    for place in range(1, len(shown)):
        if (shown[place - 1], shown[place]) not in pairs:
            return begin + place
    return None


def count_in_chunks(text: str, model, pairs: frozenset, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The tokens of a text, from chunks of about ``chunk`` characters.

    Neighbouring chunks share ``overlap`` characters. The tokens of the left one count up to a stable
    boundary in the overlap, those of the right one from it on. Where an overlap has none, or a library's
    offsets show no boundary there, it is doubled, at worst to the end of the text.
    """
    total, begin, counted = 0, 0, 0  # the chunk starts at begin; tokens before counted are in the total
    while True:
        reach, shared = chunk, overlap
        while True:
            end = min(len(text), begin + reach + shared)
            starts = _starts(model, text[begin:end], begin)
            if end == len(text):
                return total + sum(1 for s in starts if s >= counted)
            cut = stable_boundary(text, end - shared, end, pairs)
            if cut is not None and cut > counted and cut in set(starts):
                break
            shared *= 2
            reach = max(reach, shared)
        total += sum(1 for s in starts if counted <= s < cut)
        begin, counted = max(end - shared, 0), cut


def _starts(model, text: str, begin: int) -> list[int]:
    """Where each token starts. Bytes of one character that has no piece share its place."""
    return [begin + first for first, _ in model.encode_as_offset_mapping(text)["offsets"]]


def _counts(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    model, pairs = encoder(path)
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        counts = []
        for portion in portions(texts, len, PORTION):
            short = [t if len(t) <= chunk else "" for t in portion]
            found = [len(ids) for ids in model.encode(short, num_threads=1)]
            counts += [
                n if len(t) <= chunk else count_in_chunks(t, model, pairs, chunk, overlap)
                for n, t in zip(found, portion)
            ]
        sizes = [len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens as the library counts the whole text, over_limit.

    Nothing is added to or cut from a text. Null is counted as empty, with 0 tokens. Repeated rows are
    counted each; other columns are not read. No shuffle.
    """
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _counts(batches, model_path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
