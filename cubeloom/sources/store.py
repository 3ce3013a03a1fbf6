"""Graphs stored as Parquet, sorted within files: a scan for a few predicates reads only their row groups, and plans start at a table."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: How much one task of a table's writing reads. Spark's sizes are of compressed bytes, and terms compress to a few bytes each:
#: at its defaults a task would sort gigabytes of them and spill. A task that writes to a few buckets needn't sort its rows by bucket first.
_SMALL = {
    "spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "1m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}
_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MOST_PARTS = 1000


@contextmanager
def small_tasks(rows: DataFrame) -> Iterator[None]:
    """The session's settings are such that ``rows``, if written now, are made by small tasks. Shuffles have as many parts as files are read, up to ``_MOST_PARTS``."""
    conf = rows.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), min(len(rows.inputFiles()), _MOST_PARTS))
    settings = _SMALL | {_PARTS: str(parts)}
    before = {key: conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _writer(rows: DataFrame) -> DataFrameWriter:
    """Writes sorted terms by what they add to the one before (the second version of Parquet's pages), and compresses that."""
    return rows.write.option("compression", "zstd").option("parquet.writer.version", "v2")


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Rows that a plan reads several times, written as Parquet to the shared folder by small tasks and read back."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_tasks(rows):
        _writer(rows).parquet(path)
    _written.append((rows.sparkSession, path))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone: the folder's owner cleans it
            return


class Path(str):
    """The name of a folder, where a text could be meant."""


def join_files(spark: SparkSession, pieces: list[str], path: str) -> None:
    """One file of texts and of the bytes of folders' parts (``Path``), in order of their names; these folders go.

    Bytes are copied as they are, however many; no row of them is looked at.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    target = of(path)
    out = target.getFileSystem(conf).create(target, True)
    for piece in pieces:
        if not isinstance(piece, Path):
            out.write(bytearray(piece.encode()))
            continue
        fs = of(piece).getFileSystem(conf)
        for name in sorted(f.getPath().toString() for f in fs.listStatus(of(piece)) if f.getPath().getName().startswith("part-")):
            source = fs.open(of(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        fs.delete(of(piece), True)
    out.close()


#: Rows of a predicate lie together in a file; a scan skips the row groups of others.
_ROW_GROUP = 16 << 20


def stored(t: DataFrame, path: str | None = None, *, parts: int = 0) -> DataFrame:
    """Write a graph, each file ordered by predicate and subject, and read it back.

    The rows stay in the parts in which they come, mostly those of the shuffle that made them distinct, so the graph's plan runs once, and a
    predicate with very many triples is spread over all files. Without ``path`` it goes to the shared folder, until the
    program ends. A value key is only written where it isn't the object itself.

    ``parts``: rows come by subject in so many parts, as ``facts_once`` deals them (a few others may come as they like). The table is then
    bucketed by subject, so grouping it by subject shuffles nothing.
    """
    spark = t.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        _written.append((spark, path))
    with small_tasks(t):
        key = F.when(F.col("o_val") != F.col("o"), F.col("o_val"))
        rows = _writer(t.sortWithinPartitions("p", "s").withColumn("o_val", key)).option("parquet.block.size", _ROW_GROUP)
        if parts:
            table = f"graph_{uuid.uuid4().hex}"
            rows.bucketBy(parts, "s").option("path", path).saveAsTable(table)
            out = spark.read.table(table)
        else:
            rows.parquet(path)
            out = spark.read.schema(t.schema).parquet(path)
    return out.withColumn("o_val", F.coalesce("o_val", "o"))
