"""What several operators share: the shared folder, written tables, words and global ranks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent one temporary folder is set for the session, in local mode alone: on a
    cluster no folder of a single machine can stand in for a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage and survives a lost executor.

    by: a column to keep apart in folders, so that a filter on it reads only its own.
    """
    path = shared_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; of a null text, an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def source_key(source: Column) -> Column:
    """A non-null grouping key that keeps a null source apart from every string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the 0-based rank of each row in the order of the given columns, as a written table.

    The rows are range-partitioned and sorted, numbered within their partition, and shifted by the
    sizes of the partitions before, so that no window and no group holds more than one partition.
    Rows that tie in every column of the order are ranked in any way, so the order should be total.
    """
    spark, (at, part, start) = df.sparkSession, fresh(df, "_at", "_part", "_start")
    low = F.lit((1 << 33) - 1)
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(F.col(at), 33))
    counts = dealt.groupBy(part).agg((F.max(F.col(at).bitwiseAND(low)) + 1).alias("n"))
    # One row for each partition: its count is that of spark.sql.shuffle.partitions at most.
    starts, upto = [], 0
    for p, n in sorted(counts.collect()):
        starts.append((p, upto))
        upto += n
    first = spark.createDataFrame(starts or [(0, 0)], f"{part} long, {start} long")
    return dealt.join(F.broadcast(first), part).withColumn(name, F.col(at).bitwiseAND(low) + F.col(start)).drop(at, part, start)


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 8 << 20


def small(table: DataFrame) -> DataFrame:
    """A written table of fixed-width or short columns, marked for broadcast only if its size is proven.

    Pass only tables that don't grow with the rows (sources, hot keys); the proof is for the day they do.
    """
    width = F.lit(16)
    for f in table.schema.fields:
        text = f.dataType.typeName() in ("string", "binary")
        width = width + (F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 16 if text else F.lit(16))
    return F.broadcast(table) if (table.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else table


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until none of them is a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def runs(batches, key: str):
    """pandas batches of rows sorted by key to batches that never part the rows of a key."""
    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        if held and keys[0] != last:  # noqa: F821
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        last = keys[-1]
        cut = int(np.argmax(keys == last))
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def files(path: str):
    """(file system, path in it) of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
