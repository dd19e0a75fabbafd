"""Packing by power-of-two decomposition.

Each document (its token ids and one end id) is cut into pieces whose lengths
are powers of two: as many of the sequence length as fit, then the binary
digits of what is left, longest first. A piece is a sequence of its own, so no
sequence crosses documents and none is padded. Sequences of one length form a
bucket; ``sequence_id`` runs through the buckets, longest first, and inside a
bucket by document and start.

Defined cases: a null text equals the empty one and gives one piece, the end
id; rows with equal ids are packed one by one; a null doc_id sorts first; a
very long text only makes more pieces; an empty table gives no pieces; columns
besides id and text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, small_batches, table, two_columns
from .tokens import encoder, release_memory, text_slices, vocabulary_path, with_end

SEQUENCE = 2048
END_ID = 1
# less than the token files take: the pipeline's other stages share the workers
MEMO = 250_000
SLICE_CHARS = 1_500_000
BATCH_ROWS = 500
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Piece lengths of ``n`` ids: powers of two up to ``longest``, falling."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           longest: int = SEQUENCE, end_id: int = END_ID, memo_words: int = MEMO, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per piece, with its ids as little-endian uint32 bytes."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    def cut(batches):
        release_memory()    # what other operators left free in this worker
        enc = encoder(vocabulary, memo_words)
        release_memory()
        for ids, texts in text_slices(batches, slice_chars):
            flat, counts = with_end(*enc.encode_flat(texts), end_id)
            raw, rows, place = flat.tobytes(), [], 0
            for doc, n in zip(ids, counts.tolist()):
                at = 0
                for length in binary_lengths(n, longest):
                    rows.append((doc, at, length, n, raw[4 * place:4 * (place + length)]))
                    at, place = at + length, place + length
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()])],
                ["doc_id", "start", "length", "doc_tokens", "ids"])

    return two_columns(df, id_col, text_col).mapInArrow(cut, PIECES)


def number(cut: DataFrame, payload: list[str]) -> DataFrame:
    """Add sequence_id and offset to pieces; ``payload``: the columns to keep
    besides doc_id, start, length and doc_tokens."""
    keyed = cut.select("doc_id", "start", "length", "doc_tokens", *payload, (-F.col("length")).alias("_bucket"), F.lit(1).alias("_one"))
    with small_batches(cut.sparkSession, BATCH_ROWS):     # the pieces are made and stored in here
        placed = running_total(keyed, ["_bucket", "doc_id", "start"], "_one", "sequence_id", "pieces")
    return placed.select("doc_id", "start", "length", *payload, "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Sequences with their ids: doc_id, start, length, ids, doc_tokens,
    sequence_id, offset."""
    return number(pieces(df, vocabulary, id_col, text_col, longest, end_id), ["ids"])


def digests(documents: DataFrame, memo_words: int = MEMO, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The packed pieces with a checksum in place of their ids; the checksum
    is taken before the pieces are numbered, so ids never travel."""
    cut = pieces(documents, vocabulary_path(), memo_words=memo_words, slice_chars=slice_chars)
    return number(cut.withColumn("ids_crc32", F.crc32("ids")), ["ids_crc32"])


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
