"""Operator 2, WARC archives with a two-level capture index.

Writing: pages are range-partitioned by capture key (reversed host, rest of the URL, page id), and each
task writes one shard: a file of gzip members, one for each record; an index file of compressed blocks
of sorted capture lines; and a sparse directory with each block's first key and place. Which records are
revisits is found on narrow rows of digests; those marks are sorted in among the pages by key, so a
page's text is shuffled once. Looking up: a key finds its shard in the list of shards, its block by
binary search in that shard's directory, its lines by binary search in the one block read, and its record by one
range read. A revisit's payload is that of the record it refers to, read from the archive as well.

Files are named by attempt and listed only in the rows that a task returns, so what a lost or repeated
attempt leaves behind is never read. Edge cases: a null html is an empty payload; a null URL has the
key of an empty one; rows that share page id and URL are records of their own under one key; a row without a
page id revisits an equal payload that has one, and payloads of which no row has one are all responses; rows that share
the largest page id of a payload are all responses; equal payloads below 1000 bytes are never revisits; an
empty table gives an archive of no shards; further columns of pages, whatever their names, are not archived.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from hashlib import sha1

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import files, shared_dir, written

BLOCK = 256
REVISIT_BYTES = 1000
AHEAD = 1 << 18
SHARDS = "shard string, first_key string, last_key string, records long"
#: Ids travel as text: pandas turns whole numbers beside nulls into floats.
RECORDS = "key string, page string, payload_bytes long, payload_digest string, record_type string, refers_page string, refers_key string"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column, page_id: Column) -> Column:
    """com,example,www)/path?query 00000000000000000042; fragments go, white space is escaped."""
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"\s", "%20")
    head = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?]*@)?([^/?]*)"
    host = F.lower(F.regexp_extract(whole, head, 1))
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.regexp_replace(whole, head, ""), F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0"))


def captures(pages: DataFrame) -> DataFrame:
    """(key, page, url, html) of every page, and (key, digest, refers_page, refers_key) marks of those that are revisits."""
    page, html = F.col("page_id").cast("long"), F.coalesce("html", F.lit(""))
    key = capture_key(F.col("url"), page)
    prints = written(
        pages.filter(F.octet_length(html) >= REVISIT_BYTES).select(key.alias("key"), page.alias("page"), F.sha1(html.cast("binary")).alias("digest"))
    )
    groups = written(
        prints.groupBy("digest").agg(F.max("page").alias("first"), F.max_by("key", "page").alias("refers_key"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").drop("n")
    )
    again = prints.join(groups, "digest").filter(~F.col("page").eqNullSafe(F.col("first")))
    marks = again.select("key", F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.col("first").cast("string").alias("refers_page"), "refers_key")
    none = [F.lit(None).cast("string").alias(c) for c in ("digest", "refers_page", "refers_key")]
    rows = pages.select(key.alias("key"), page.cast("string").alias("page"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), *none)
    return rows.union(written(marks.distinct()))


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record(r, mark) -> bytes:
    """One WARC record of a capture, as a gzip member of its own; mark: (refers_page, refers_key) of a revisit."""
    payload = r.html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if mark else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if mark else 'response'}", f"WARC-Record-ID: {record_id(r.key)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {r.url}".replace("\n", "%0A").replace("\r", "%0D"), f"WARC-Payload-Digest: sha1:{sha1(payload).hexdigest()}",
    ]
    if r.page is not None:
        head.append(f"WARC-Page-ID: {r.page}")
    if mark:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(mark[1])}", f"WARC-Refers-To-Page-ID: {mark[0]}", f"WARC-Refers-To-Key: {mark[1]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packed = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packed.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields and payload of a record; of a revisit the payload is empty."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archive(pages: DataFrame) -> DataFrame:
    """Writes the archive of (page_id, url, html) and returns its list of shards, one row for each."""
    path = shared_dir(pages.sparkSession)

    def write(batches):
        fs, base = files(path)
        name, keys, lines, blocks, at, index_at, count = uuid.uuid4().hex, ("", ""), [], [], 0, 0, 0
        out = index = marked = None
        marks: dict[str, tuple[str, str]] = {}

        def flush():
            nonlocal index_at, lines
            packed = zlib.compress("\n".join(lines).encode())
            blocks.append(json.dumps([lines[0].rsplit("\t", 1)[0], index_at, len(packed)]))
            index.write(packed)
            index_at, lines = index_at + len(packed), []

        for pdf in batches:
            for r in pdf.itertuples():
                if r.digest is not None:  # the marks of a key come before its pages
                    if r.key != marked:
                        marked, marks = r.key, {}
                    marks[r.digest] = (r.refers_page, r.refers_key)
                    continue
                if r.key != marked:
                    marked, marks = r.key, {}
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, index = (fs.open_output_stream(f"{base}/{name}.{x}", compression=None) for x in ("warc.gz", "cdx.z"))
                    keys = (r.key, r.key)
                member = record(r, marks.get(sha1(r.html.encode()).hexdigest()) if marks else None)
                out.write(member)
                lines.append(f"{r.key}\t{at} {len(member)}")
                at, keys, count = at + len(member), (keys[0], r.key), count + 1
                if len(lines) == BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            index.close()
            with fs.open_output_stream(f"{base}/{name}.dir") as f:
                f.write("\n".join(blocks).encode())
            yield pd.DataFrame({"shard": [f"{path}/{name}"], "first_key": keys[:1], "last_key": keys[1:], "records": [count]})

    rows = captures(pages).repartitionByRange("key").sortWithinPartitions("key", F.col("digest").isNull())
    return written(rows.mapInPandas(write, SHARDS))


class Shard:
    """One shard opened for range reads; its directory is held, blocks and records are read on demand."""

    def __init__(self, path: str):
        fs, base = files(path)
        self.warc, self.index = fs.open_input_file(f"{base}.warc.gz"), fs.open_input_file(f"{base}.cdx.z")
        with fs.open_input_file(f"{base}.dir") as f:
            self.blocks = [json.loads(x) for x in f.read().decode().split("\n")]
        self.firsts = [b[0] for b in self.blocks]
        self.held, self.lines = -1, []
        self.start, self.buffer = 0, b""

    def block(self, k: int) -> list[list[str]]:
        if k != self.held:
            _, at, size = self.blocks[k]
            self.held, self.lines = k, [x.rsplit("\t", 1) for x in zlib.decompress(self.index.read_at(size, at)).decode().split("\n")]
        return self.lines

    def member(self, at: int, size: int) -> bytes:
        """A range of the archive; neighbours of the last range come with it in one read."""
        if not (self.start <= at and at + size <= self.start + len(self.buffer)):
            self.start, self.buffer = at, self.warc.read_at(max(size, AHEAD), at)
        return self.buffer[at - self.start : at - self.start + size]

    def find(self, key: str):
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            lines = self.block(k)
            for i in range(bisect_left(lines, key, key=lambda x: x[0]), bisect_right(lines, key, key=lambda x: x[0])):
                yield parsed(self.member(*map(int, lines[i][1].split())))


def look_up(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of an archive under each of the distinct capture keys in ``key``."""
    listed = [tuple(r) for r in shards.select("first_key", "last_key", "shard").orderBy("first_key").collect()]  # one row a shard
    firsts = [x[0] for x in listed]

    def find(batches):
        at, shard = -1, None
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                k = bisect_right(firsts, key) - 1
                if k < 0 or key > listed[k][1]:
                    continue
                if k != at:
                    at, shard = k, Shard(listed[k][2])
                for fields, body in shard.find(key):
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and sha1(body).hexdigest() != digest:
                        raise ValueError(f"damaged record under {key}")
                    rows.append((key, fields.get("WARC-Page-ID"), len(body), digest, kind, fields.get("WARC-Refers-To-Page-ID"), fields.get("WARC-Refers-To-Key")))
            yield pd.DataFrame(rows, columns=["key", "page", "payload_bytes", "payload_digest", "record_type", "refers_page", "refers_key"])

    return keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").mapInPandas(find, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Looked-up records with the payload size of revisits, taken from the record each refers to; fails where that is missing."""
    records = written(records)
    # Records of one key and payload are alike, so one stands for them.
    whole = records.filter("record_type = 'response'").select(F.col("key").alias("refers_key"), "payload_digest", F.col("payload_bytes").alias("whole_bytes")).distinct()
    again = records.filter("record_type = 'revisit'").drop("payload_bytes").join(whole, ["refers_key", "payload_digest"], "left")
    size = F.when(F.col("whole_bytes").isNull(), F.raise_error(F.concat(F.lit("no record for the revisit under "), "key"))).otherwise(F.col("whole_bytes"))
    plain = records.filter("record_type = 'response'")
    return again.withColumn("payload_bytes", size).select(*records.columns).union(plain).select(
        "key", F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_page").cast("long").alias("refers_to")
    )


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    shards = write_archive(pages)
    return resolved(look_up(shards, pages.select(capture_key(F.col("url"), F.col("page_id").cast("long")).alias("key")))).drop("key")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""
