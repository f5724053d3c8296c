"""Connected components of a table of links, by alternating star contraction.

Every round is two aggregations and two joins over the links; links only ever move towards smaller
ids, and each round is a written table, so no lineage grows and a lost executor costs one round. A node
with very many links is one hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def _star(links: DataFrame, both: DataFrame, larger_only: bool) -> DataFrame:
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    side = links.select(F.col("v").alias("w"), "u") if not larger_only else both.filter("v > u").select(F.col("v").alias("w"), "u")
    moved = side.join(least, "u").select(F.col("w"), F.col("m"))
    if not larger_only:
        moved = moved.union(least.select(F.col("u").alias("w"), "m"))
    return moved.filter("w <> m").select(F.col("m").alias("v"), F.col("w").alias("u")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links to (node, component): the smallest id each linked node reaches.

    Links to itself and repeated links do no harm; nodes without links don't appear.
    """
    now = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = written(_star(now, both, larger_only=True).select("u", "v"))
        now = written(_star(now, now, larger_only=False).select("u", "v"))
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
