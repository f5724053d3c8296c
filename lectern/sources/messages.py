"""Readers and writers of messages, chunks and segments."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

MESSAGES = "msg_id long, lang string, text string"
CHUNKS = "stream_id long, seq long, chunk string, is_last boolean, ts timestamp"


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; in local mode a temporary one if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-speech-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/speech-{uuid.uuid4().hex}"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MESSAGES) -> DataFrame:
    """Messages from Parquet, JSON or CSV files; text files give one message a line, without id or language."""
    if fmt == "text":
        return spark.read.text(path).selectExpr("cast(null as long) AS msg_id", "cast(null as string) AS lang", "value AS text")
    return spark.read.schema(schema).format(fmt).load(path)


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of chunks from a folder of files."""
    reader = spark.readStream.schema(CHUNKS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_normalized(df: DataFrame, path: str, by: str = "lang") -> None:
    """Messages as Parquet with one folder for each language."""
    df.write.partitionBy(by).mode("overwrite").parquet(path)


def write_segments(segments: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A checkpointed writer of segments, in append mode; start() runs it."""
    return segments.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer partitions than there are cores is dealt anew, before work on its rows.

    Tables of many files or row groups, as large ones are, stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Counted without reading a column: of Parquet the footers alone.
    parts = df.select(F.spark_partition_id().alias("p")).agg(F.countDistinct("p")).first()[0]
    return df.repartition(cores) if parts < cores else df
