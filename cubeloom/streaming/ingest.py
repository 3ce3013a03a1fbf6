"""Graphs from a stream of N-Triples files: parsed with built-in functions and appended to a table, partitioned by groups of predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cubeloom.functions.terms import kind, value_key
from cubeloom.sources.rdf import parse_lines


#: Predicates are dealt to so many folders: a folder for each would be as many as rows where a key names predicates.
GROUPS = 64


def stream_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of the N-Triples files that appear in a folder (not made distinct; readers of the table are)."""
    spo = parse_lines(spark.readStream.text(folder))
    return spo.withColumn("o_kind", kind(F.col("o"))).withColumn("o_val", value_key(F.col("o")))


def append(t: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all files that are there to a Parquet table and stop; the checkpoint makes each file count once. A predicate's triples are of one ``p_group``."""
    rows = t.withColumn("p_group", F.pmod(F.xxhash64("p"), F.lit(GROUPS)).cast("int"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("p_group").trigger(availableNow=True).start(table)
