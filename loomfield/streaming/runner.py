"""Runs a stream over all that is there and gives its output as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomfield.session import table


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can write to: below the session's checkpoint folder, or on this machine in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomfield-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's output over all data available now, written as Parquet with exactly-once commits, and read again."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")
