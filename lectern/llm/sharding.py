"""Operator 3, sharding: proportional stratified interleaving.

The rows of each source are put into a seeded random order; a row at place r of the n of its source
gets the fractional rank (r + 1/2) / n; all rows are sorted by it and cut into runs whose lengths
differ by one at most. Each run then holds every source in the proportion of the whole.

Edge cases: a null source is a source of its own; a null text has size 1; rows that repeat are kept
and ordered among themselves by size and checksum; fewer rows than shards leave some shards empty; an empty
table gives an empty result; further columns, whatever their names, stay and break ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, global_rank, small, source_key, written


def stratified_shards(rows: DataFrame, shards: int, seed: str = "lectern", key: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with ``shard`` and ``slot``. Pass narrow rows: they are written and sorted twice.

    Both ranks come from range partitions, so a source with any share of the rows is spread evenly.
    """
    src, mix, g, f, low, n = fresh(rows, "_src", "_mix", "_g", "_f", "_first", "_n")
    seeded = rows.withColumns(
        {src: source_key(F.col(source)), mix: F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))}
    )
    ties = [c for c in rows.columns if c != source]
    ranked = global_rank(seeded, [src, mix, *ties], g)
    # One row for each source, broadcast so that a hot source's rows stay where they are.
    per_source = small(written(ranked.groupBy(src).agg(F.min(g).alias(low), F.count("*").alias(n))))
    place = (2 * (F.col(g) - F.col(low)) + 1) / (2 * F.col(n))
    placed = ranked.join(per_source, src).withColumn(f, place).drop(g, low, n)
    final = global_rank(placed, [f, src, mix, *ties], g)
    count = max(final.count(), 1)
    # Shard k starts at the first g with floor(g * shards / count) = k.
    shard = f"((`{g}` * {shards}) div {count})"
    return final.select(
        *rows.columns, F.expr(shard).cast("int").alias("shard"), F.expr(f"`{g}` - ({shard} * {count} + {shards - 1}) div {shards}").alias("slot")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return stratified_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum is folded byte by byte through the table of the reflected polynomial 0xEDB88320.
OP3_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [k::BIGINT FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
base AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN coalesce(text, '') = '' THEN []::BIGINT[] ELSE [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(text)), '..')] END), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32,
  CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, md5('lectern:' || coalesce(doc_id::VARCHAR, '')) AS mix FROM documents, tab),
r1 AS (SELECT *, (2 * (row_number() OVER (PARTITION BY src ORDER BY mix, doc_id, size, text_crc32) - 1) + 1) / (2 * count(*) OVER (PARTITION BY src)) AS f FROM base),
r2 AS (SELECT *, row_number() OVER (ORDER BY f, src, mix, doc_id, size, text_crc32) - 1 AS g, count(*) OVER () AS n FROM r1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((g * 8) // n)::INTEGER AS shard, (g - (((g * 8) // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM r2
"""
