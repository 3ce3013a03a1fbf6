"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: A side with at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000

#: A key with more than one in so many of the rows is hot; there are fewer such keys than this.
HOT_SHARE = 10_000

#: An Arrow batch that goes to Python has at most this many bytes, or one row.
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing (tests on one machine), a temporary folder of the driver is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone: the folder's owner cleans it
            return


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_key_values(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``values`` (one row for each key, none null; _n: rows of the key), without _n.

    The keys that hold more than one in ``HOT_SHARE`` rows, at most that many by construction, are broadcast, so their rows
    stay where they are; rows of other keys are shuffled, and no key of these is a large part of them. ``rows`` and
    ``values`` are read several times: give tables.
    """
    total = values.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * HOT_SHARE > total
    frequent, others = F.broadcast(values.where(hot).drop("_n")), values.where(~hot).drop("_n")
    rest = rows.join(F.broadcast(values.where(hot).select(key)), key, "left_anti")
    return rows.join(frequent, key).unionByName(rest.join(others, key))


def give_back() -> None:
    """Return what is free to the system, as far as the allocators can: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and ``size`` bytes of text (one row if it alone has more).

    This bounds what the Python objects of texts take.
    """
    for batch in batches:
        held = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(held)])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, upto[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()
    give_back()


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` for rows with texts: the session's batches are set to ``BATCH_BYTES``, if it has larger ones.

    A batch is held outside the heap by the executor and again by its Python worker, and both keep freed memory, so batches
    that are bounded by rows alone take more the longer the texts are.
    """
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
