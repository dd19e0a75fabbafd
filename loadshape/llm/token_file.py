"""Token-id output: wavelet-matrix files, one per shard of documents.

``write`` sorts the documents by id over range partitions and turns each run of
some ``shard_tokens`` ids into one compressed file (wavelet.py). The files are
the rows of a Parquet table in the given shared folder, because executors can
only write there through Spark. ``read`` opens the files and gives each
document's ids and its place in the whole output.

Defined cases: a null text equals the empty one, which holds only the end id;
null ids sort first and come back null; rows that repeat an id follow each
other, ordered by text; a document longer than a shard makes a larger shard;
an empty table gives no files; columns besides id and text are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.session import ensure_checkpoint_dir

from . import wavelet
from .common import broadcast_up_to, running_total, table, two_columns
from .tokens import encoder, text_slices, vocabulary_path, with_end

END_ID = 0
SHARD_TOKENS = 1 << 20
NULL_ID = -(1 << 63)
FILES = "part int, shard int, n_docs long, n_tokens long, file binary"
DOCS = "part int, shard int, doc_id long, local_start long, n_tokens long, ids binary"


def write(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    def shards(batches):
        enc, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for doc_ids, texts in text_slices(batches):
            flat, counts = with_end(*enc.encode_flat(texts), end_id)
            docs = np.array([NULL_ID if d is None else d for d in doc_ids], np.int64)
            ends = np.cumsum(counts)
            cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // shard_tokens)) + 1).tolist(), len(docs)]
            for a, b in zip(cuts, cuts[1:]):
                ids = flat[ends[a] - counts[a]:ends[b - 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([b - a], pa.int64()),
                     pa.array([len(ids)], pa.int64()), pa.array([wavelet.encode(ids, docs[a:b], counts[a:b])], pa.binary())],
                    ["part", "shard", "n_docs", "n_tokens", "file"])
                shard += 1

    ordered = two_columns(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, FILES).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document."""
    files = spark.read.schema(FILES).parquet(folder)

    def documents(batches):
        for batch in batches:
            for part, shard, _, _, blob in zip(*(c.to_pylist() for c in batch.columns)):
                m = wavelet.WaveletMatrix(blob)
                raw, lengths, docs = m.decode().astype("<u4").tobytes(), m.lengths, m.doc_ids
                ends = np.cumsum(lengths)
                ids = pa.array([raw[4 * a:4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())], pa.binary())
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)),
                     pa.array(docs, mask=docs == NULL_ID), pa.array(ends - lengths), pa.array(lengths), ids],
                    ["part", "shard", "doc_id", "local_start", "n_tokens", "ids"])

    # one row per file: where its first id lies in the whole output
    starts = running_total(files.select("part", "shard", "n_tokens"), ["part", "shard"], "n_tokens", "before", "token-starts")
    starts = broadcast_up_to(starts.select("part", "shard", "before"), 1_000_000)
    return (files.mapInArrow(documents, DOCS).join(starts, ["part", "shard"])
            .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids"))


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
