"""Operator 6, SimHash near-dedup with vantage-point trees.

Fingerprints: a bit is set where more than half of a text's shingle hashes have it set. Equal
fingerprints are one point. A shallow vantage-point tree, built on the driver from a bounded sample of
points, deals the points to shards by Hamming distance: each point has one home shard and is also sent
to every shard whose ball a link of its own could reach (triangle bound). The home points and the visitors
of a shard are cut into blocks of about SHARD_POINTS; a task searches one block of home points against one
block, with a vantage-point tree of its own, exactly, so it holds two blocks however many visit, and returns a spanning forest of the links
it found, so a group of k copies gives k - 1 links. The forests are joined by ``components``.

With a radius of 4 bits the trees prune; the work grows about as n^1.75 in distinct fingerprints.
``near_copies`` searches wider fingerprints with the same trees and verifies the texts themselves.

Edge cases: a text without words, or null, has fingerprint zero; equal and repeated rows are one
class; a row without an id is linked like any other and gets the class of its fingerprint, null where
the class has no id at all; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.components import components

#: Points from which the driver builds the sharding tree, and home points a shard should have.
SAMPLE = 4096
SHARD_POINTS = 32768
LEAST_SHARDS = 16
LEAF = 128
CELLS = 1 << 21


def shingle_bytes(text: str | None, size: int) -> list[bytes]:
    """UTF-8 shingles of so many lower-cased words, repeats included; fewer words give one shingle."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return []
    whole = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    return [whole[s : e - 1] for s, e in zip(starts, ends[size - 1 :])] or [whole]  # noqa: B905


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from the highest bit down; one row of words for each."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 255):  # so many bits add up within a byte
        part = np.ascontiguousarray(hashes[k : k + 255], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8), axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return total


def fingerprint(text: str | None, size: int, seed: int) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    from xxhash import xxh64_intdigest

    shingles = shingle_bytes(text, size)
    if not shingles:
        return 0
    h = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype=np.uint64)
    return int.from_bytes(np.packbits(2 * ones(h[:, None]) > len(h)).tobytes(), "big", signed=True)


def fingerprints(text: Column, size: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size, seed) for t in texts], dtype="int64")

    return fp(text)


def distance(a, b):
    return np.bitwise_count(a ^ b)


def sharding_tree(sample: np.ndarray, depth: int):
    """Nested (vantage, bound, near side, far side); leaves are numbered from 0."""
    count = iter(range(1 << 30))

    def grow(points: np.ndarray, depth: int):
        if depth == 0 or len(points) < 2:
            return next(count)
        vantage = points[len(points) // 2]
        d = distance(points, vantage)
        bound = int(np.median(d))
        near = d <= bound
        if near.all():
            bound, near = bound - 1, d < bound
        if not near.any():
            return next(count)
        return (int(vantage), bound, grow(points[near], depth - 1), grow(points[~near], depth - 1))

    return grow(sample, depth)


def deal(tree, points: np.ndarray, radius: int):
    """(point index, shard, home) of every shard that a link of radius bits from a point can reach."""
    out = []

    def go(node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, np.full(len(at), node, np.int32), home))
            return
        vantage, bound, near, far = node
        d = distance(points[at], np.uint64(vantage)).astype(np.int16)
        inside = d <= bound
        left, right = d <= bound + radius, d > bound - radius
        go(near, at[left], (home & inside)[left])
        go(far, at[right], (home & ~inside)[right])

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return [np.zeros(0, np.int64)] * 3
    at, shard, home = (np.concatenate(x) for x in zip(*out))  # noqa: B905
    # Reach is mutual, so of two shards that a pair lies in only the lower one need see both.
    own = np.empty(len(points), np.int64)
    own[at[home]] = shard[home]
    once = shard <= own[at]
    return [at[once], shard[once], home[once]]


class Forest:
    """Union-find over the points of a shard; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while not np.array_equal(above := self.parent[up], up):
            up = above
        self.parent[at] = up
        return up

    def join(self, point: int, others: np.ndarray) -> None:
        """Links point with each of the others."""
        roots, first = np.unique(self.roots(np.append(others, point)), return_index=True)
        if len(roots) > 1:
            low, ends = roots[0], np.append(others, point)[first]
            own = self.parent[point]
            self.links += [(point, int(e)) for r, e in zip(roots, ends) if r != own]  # noqa: B905
            self.parent[roots] = low


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which each of the fingerprints p (rows of words) differs from each of q."""
    total = np.bitwise_count(p[:, None, 0] ^ q[None, :, 0]).astype(np.uint16 if p.shape[1] > 3 else np.uint8)
    for k in range(1, p.shape[1]):
        total += np.bitwise_count(p[:, None, k] ^ q[None, :, k])
    return total


def search(points: np.ndarray, home: np.ndarray, radius: int, among: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between home points and all points given, or those marked in among.

    points: one row of 64-bit words for each fingerprint.
    """
    forest = Forest(len(points))

    def block(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(q)))
        for k in range(0, len(p), step):
            rows = p[k : k + step]
            i, j = np.nonzero(apart(points[rows], points[q]) <= radius)
            a, b = rows[i], q[j]
            real = a != b
            a, b = a[real], b[real]
            cuts = np.flatnonzero(np.diff(a)) + 1
            for x, ys in zip(a[np.r_[0, cuts]] if len(a) else (), np.split(b, cuts)):  # noqa: B905
                forest.join(int(x), ys)

    def go(p: np.ndarray, q: np.ndarray) -> None:
        while len(p) > LEAF:
            vantage = points[p[len(p) // 2]][None]
            d, e = apart(vantage, points[p])[0].astype(np.int16), apart(vantage, points[q])[0].astype(np.int16)
            bound = int(np.median(d))
            near = d <= bound
            left, right = e <= bound + radius, e > bound - radius
            if near.all() or left.sum() + right.sum() > 1.9 * len(q):
                break  # no bound prunes here
            go(p[near], q[left])
            p, q = p[~near], q[right]
        block(p, q)

    go(np.flatnonzero(home), np.arange(len(points)) if among is None else np.flatnonzero(among))
    return forest.links


def near_links(points: DataFrame, radius: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) that join all near points of (fp long, rep long), as spanning forests; fp must not repeat."""
    spark = points.sparkSession
    n = points.count()
    depth = max(LEAST_SHARDS.bit_length() - 1, int(np.ceil(np.log2(max(1, n / shard_points)))))
    drawn = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()
    tree = sharding_tree(np.unique(drawn["fp"].to_numpy(dtype=np.int64)).view(np.uint64), depth if n > LEAF else 0)

    def dealt_rows(batches):
        for pdf in batches:
            own = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            step = 2048
            for k in range(0, len(own), step):
                at, shard, home = deal(tree, own[k : k + step], radius)
                yield pdf.iloc[k + at], shard, home

    def counted(batches):
        for _, shard, home in dealt_rows(batches):
            yield pd.DataFrame({"shard": shard, "home": home, "n": np.int64(1)}).groupby(["shard", "home"], as_index=False).sum()

    # Driver state: two counts a shard. Home points and visitors of a shard are cut into blocks by number.
    totals = points.select("fp", "rep").mapInPandas(counted, "shard int, home boolean, n long").groupBy("shard", "home").agg(F.sum("n").alias("n")).collect()
    blocks = {(r.shard, r.home): -(-r.n // shard_points) for r in totals}

    def spread(batches):
        for rows, shard, home in dealt_rows(batches):
            out: list = []
            # Neighbours in the table go to different blocks; which one only has to be the same for every copy of a point.
            mixed = (rows["rep"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for k, (s, h, x) in enumerate(zip(shard.tolist(), home.tolist(), mixed.tolist(), strict=True)):
                homes, visits = blocks.get((s, True), 0), blocks.get((s, False), 0)
                if h:  # its own block, as home to every later block; and as other to every earlier one
                    at = x % homes
                    out += [(k, s, at, c, True) for c in range(at, homes + visits)] + [(k, s, c, at, False) for c in range(at)]
                else:
                    out += [(k, s, c, homes + x % visits, False) for c in range(homes)]
            if out:
                at, s, block, other, own = (np.array(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"shard": s, "block": block, "other": other, "home": own, "rep": rows["rep"].to_numpy()[at], "fp": rows["fp"].to_numpy()[at]})

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        every = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)[:, None]
        rep, home = pdf["rep"].to_numpy(), pdf["home"].to_numpy()
        among = home if pdf["block"].iat[0] == pdf["other"].iat[0] else ~home
        pairs = np.array(search(every, home, radius, among), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": rep[pairs[:, 0]], "b": rep[pairs[:, 1]]})

    dealt = points.select("fp", "rep").mapInPandas(spread, "shard int, block int, other int, home boolean, rep long, fp long")
    return spark.createDataFrame([], "a long, b long") if n == 0 else dealt.groupBy("shard", "block", "other").applyInPandas(find, "a long, b long")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(id long, fp) to (fp, component) for every fingerprint: the smallest id its near links reach, null if it has none."""
    # Links run between points, not ids: an id may be null or stand for several fingerprints.
    points = written(prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    links = written(near_links(points, radius))
    found = written(components(links))
    classed = written(points.join(found, points["rep"] == found["node"], "left").select("fp", "least", F.coalesce("component", "rep").alias("class")))
    ids = written(classed.groupBy("class").agg(F.min("least").alias("component")))
    return classed.join(ids, "class").select("fp", "component")


def simhash_classes(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row of docs, rows with a null key too."""
    prints = written(docs.select(F.col(key).cast("long").alias("id"), fingerprints(F.col(text), size, seed).alias("fp")))
    found = written(classes(prints, radius))
    # A fingerprint may be that of a third of all rows; both sides are written tables, so adaptive
    # execution splits such a key's rows over tasks.
    return prints.join(found, "fp").select("id", "fp", F.col("component").alias("component_id"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_classes(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
