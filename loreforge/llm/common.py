"""What the training-data operators share: tables, folds, the shared folder, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import shared_folder

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: space and the control characters 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns, whatever else the table has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def in_fold(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more, so that a job holds only what it still needs."""
    for table in tables:
        delete(table.sparkSession, table.settled_at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, by the file system that Spark writes with."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, mod: int = 4, rest: int = 2) -> DataFrame:
    """Training documents (all columns of docs, and y) outside the held-out fold: the `bound` ids that hash lowest.

    The id list is broadcast; `bound` rows are its proven size.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_labelled"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_y").isNotNull() & F.col("_labelled").isNotNull() & ~in_fold(F.col("_labelled"), mod, rest))
        .groupBy("_labelled")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(bound)
    )
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled"), "inner").drop("_labelled")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that only few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def to_batch(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    """Arrow rows for a Spark schema from lists or arrays, one for each field."""
    kinds = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(), T.FloatType(): pa.float32(),
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], kinds[f.dataType]) for f in schema.fields], names=schema.names)


def read_only(buffer: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(buffer, dtype=dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
