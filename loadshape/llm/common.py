"""Helpers shared by the operators: reading, shared-folder tables, numbering."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadshape.session import ensure_checkpoint_dir

# Word separator of every operator: the six ASCII white-space characters.
WORD_SPLIT = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``df``; a null text becomes the empty string."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def stash(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to a fresh folder below the session's shared
    ``spark.checkpoint.dir`` and read it back: cuts the lineage, survives lost
    executors, and fixes the rows of each partition. ``by``: columns whose
    values get folders of their own."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` (a stored table with narrow rows) if it has at most
    ``max_rows`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Inside, Arrow batches that go to Python workers have at most ``rows``
    rows: for whole texts, whose default batches take tens of MB in the JVM and
    again in each worker. What runs later has the session's own size again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of rows that the driver has, made without Python workers (which
    would stay beside those of the operators)."""
    names = StructType.fromDDL(schema).names
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in columns], names), schema)


def running_total(df: DataFrame, order: list[str], amount: str, total: str, what: str) -> DataFrame:
    """Add ``total``: the sum of ``amount`` over all rows before this one in
    ``order``. The rows are stored before the range partitions are sampled, and
    again with the number of their partition; only one subtotal per partition
    reaches the driver, and each window holds one partition."""
    spark = df.sparkSession
    placed = stash(stash(df, what).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), what)
    sums = sorted((r[0], r[1]) for r in placed.groupBy("_part").agg(F.sum(amount)).collect())
    before, rows = 0, []
    for part, subtotal in sums:
        rows.append((part, before))
        before += subtotal or 0
    offsets = few_rows(spark, rows, "_part int, _before long")
    window = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(total, F.col("_before") + F.coalesce(F.sum(amount).over(window), F.lit(0)))
            .drop("_part", "_before"))


def drop_rows(df: DataFrame, losers: DataFrame, keys: list, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` without the rows whose key expressions equal a row of ``losers``
    (narrow, one column per key, null equal to null)."""
    losers = stash(losers.distinct().toDF(*(f"_lost_{i}" for i in range(len(keys)))), "losers")
    match = None
    for expression, column in zip(keys, losers.columns):
        one = expression.eqNullSafe(losers[column])
        match = one if match is None else match & one
    return df.join(broadcast_up_to(losers, max_rows), match, "left_anti")
