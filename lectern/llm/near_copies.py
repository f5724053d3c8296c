"""Near-dedup of whole texts: SimHash fingerprints find candidates, exact similarity decides.

The similarity of two texts is the cosine of their sets of five-word shingles, the quantity that SimHash
bits estimate: |A and B| / sqrt(|A| |B|), at least 0.8. (Every pair with a Jaccard similarity of 0.8 has it.)

1. Each text gets a digest of its set, a 256-bit fingerprint of it and ``ANCHORS`` anchors, each drawn
   from the least of the set's hashes under two seeded orders. Equal sets are one point from here on.
2. At this similarity a fifth of the bits differ, so no triangle bound of a vantage-point tree prunes: every
   point would visit every shard. Points therefore meet where they share an anchor; two similar
   points share none with a probability of at most (1 - 0.64^2)^16, two in ten thousand. Each group of
   points under an anchor is searched as a shard of operator 6 is (``simhash.search``) with a radius
   that covers the similarity by five deviations (three and a half for texts of six or seven words). A common anchor's group is cut into blocks,
   and a task holds two of them.
3. What the candidate links join is a loose group. Its texts, the only ones read again, are compared exactly,
   block by block, by counting shared shingles; only links that pass are kept.

Texts are shuffled once, narrow rows otherwise; every table is written, so a lost executor costs one step.

Edge cases: texts without words, or null, are copies of each other; of a class the row of least id
stays (a null id counts after all others; ties go by text hash); an id may stand for several texts; repeated
rows are copies; further columns stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, runs, small, written
from lectern.llm.components import components
from lectern.llm.simhash import Forest, ones, search

ANCHORS = 16
WORDS = 4
#: Bits of 256 in which candidates may differ; a cosine of 0.8 means 52.5 +- 6.5 (64 +- 7 for sets of two and
#: three shingles), unrelated texts 128 +- 8.
RADIUS = 88
#: Points, and shingles of their texts, that a block of a group holds.
BLOCK_POINTS = 4096
BLOCK_SHINGLES = 1 << 21
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1 << 16
#: Groups of up to so many points are compared all at once, without a tree.
FEW = 8


def mixed_bits(h: np.ndarray, salt: int) -> np.ndarray:
    """The hashes under another seed."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept for the most recent some."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KEPT_WORDS:
            self.clear()
        found = xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = found
        return found


_words = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of lower-cased words; fewer words give one shingle."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    total = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for k in range(min(size, len(h))):
        total += mixed_bits(h[k : len(h) - size + 1 + k if len(h) >= size else k + 1], k)
    return np.unique(total)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits over a set of hashes."""
    wide = np.stack([mixed_bits(found, k + 1) for k in range(WORDS)], axis=1)
    return np.packbits(2 * ones(wide) > len(found)).view(np.uint64)


_ODD = (mixed_bits(np.arange(2 * ANCHORS, dtype=np.uint64), 77) | np.uint64(1))[None]


def anchors(found: np.ndarray) -> np.ndarray:
    """ANCHORS hashes, each of the least hashes of the set under two orders; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(2 * ANCHORS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 1 << 12):
        least = np.minimum(least, (found[k : k + (1 << 12), None] * _ODD).min(axis=0))
    pairs = mixed_bits(least[0::2], 5) ^ mixed_bits(least[1::2], 6)
    return mixed_bits(pairs + np.arange(ANCHORS, dtype=np.uint64), 7).view(np.int64)


def sketches(text: Column, size: int) -> Column:
    """(h, n, fp, anchors): digest and size of the shingle set, its fingerprint and anchors."""

    @F.pandas_udf("h binary, n int, fp binary, anchors array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = shingle_set(t, size)
            rows.append((blake2b(found.tobytes(), digest_size=16).digest(), len(found), wide_fingerprint(found).tobytes(), anchors(found)))
        return pd.DataFrame(rows, columns=["h", "n", "fp", "anchors"])

    return sketch(text)


def in_blocks(rows: DataFrame, group: str, node: str, blocks: Column) -> DataFrame:
    """rows with ``key`` and ``side``: the rows of a group, or of a pair of its blocks, share a key.

    Sides: 0 where all rows of the key meet each other, else 1 meets 2.
    """
    own = F.pmod(F.xxhash64(node), blocks).cast("int")

    def deal(c: Column) -> Column:
        key = F.xxhash64(F.col(group), F.least(own, c), F.greatest(own, c))
        return F.struct(key.alias("key"), F.when(c == own, 0).when(c > own, 1).otherwise(2).cast("byte").alias("side"))

    whole = F.array(F.struct(F.xxhash64(F.col(group), F.lit(0), F.lit(0)).alias("key"), F.lit(0).cast("byte").alias("side")))
    cut = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), deal)
    return rows.select("*", F.inline(F.when(F.coalesce(blocks, F.lit(1)) <= 1, whole).otherwise(cut)))


def candidate_links(points: DataFrame) -> DataFrame:
    """Links (a, b) between points (node long, fp, anchors) that share an anchor and differ in RADIUS bits at most."""
    met = points.select("node", "fp", F.explode("anchors").alias("anchor"))
    common = met.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_POINTS)
    common = written(common.select("anchor", F.ceil(F.col("n") / F.lit(BLOCK_POINTS)).cast("int").alias("blocks")))
    dealt = in_blocks(met.join(small(common), "anchor", "left"), "anchor", "node", F.col("blocks")).select("key", "side", "node", "fp")

    def find(batches):
        for pdf in runs(batches, "key"):
            key, node, side = pdf["key"].to_numpy(), pdf["node"].to_numpy(), pdf["side"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            fp = pdf["fp"].to_numpy()
            words = np.zeros((len(fp), WORDS), np.uint64)
            met_any = np.flatnonzero(size > 1)
            if not len(met_any):
                continue
            words[met_any] = np.frombuffer(b"".join(fp[met_any]), np.uint64).reshape(-1, WORDS)
            a, b = [], []
            for step in range(1, FEW):
                x = np.flatnonzero((size[:-step] <= FEW) & (key[step:] == key[:-step]))
                x = x[np.bitwise_count(words[x] ^ words[x + step]).sum(axis=1, dtype=np.int64) <= RADIUS]
                ok = (side[x] == 0) | (side[x] != side[x + step])
                a.append(node[x[ok]])
                b.append(node[x[ok] + step])
            for k in np.flatnonzero(sizes > FEW):
                here = slice(starts[k], starts[k] + sizes[k])
                home = side[here] < 2
                links = search(words[here], home, RADIUS, home if home.all() else ~home)
                pairs = np.array(links, dtype=np.int64).reshape(-1, 2) + starts[k]
                a.append(node[pairs[:, 0]])
                b.append(node[pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(find, "a long, b long")


def similar_links(sets: list[np.ndarray], side: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of side 0, or between those of sides 1 and 2.

    Shared shingles are counted through lists of the sets that hold each shingle. Sets of common shingles go
    first: the original of many copies joins them at once, and the search ends when one tree is left.
    """
    num, den = similarity.numerator, similarity.denominator
    n, forest = np.array([len(s) for s in sets], np.int64), Forest(len(sets))
    home, other = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    if not len(home) or not len(other):
        return []
    every = np.concatenate([sets[i] for i in other])
    held, at = np.unique(every, return_inverse=True)
    owner = np.repeat(other, n[other])[np.argsort(at, kind="stable")]
    ends = np.cumsum(np.bincount(at, minlength=len(held)))
    starts = np.r_[0, ends[:-1]] if len(ends) else ends

    def lists(s: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(held, s), max(len(held) - 1, 0))
        return k[held[k] == s] if len(held) else k[:0]

    places = [lists(sets[i]) for i in home]
    length = ends - starts
    rank = np.argsort([-(length[p].sum() / max(len(p), 1)) for p in places], kind="stable")
    for r in rank:
        x, p = int(home[r]), places[r]
        if len(forest.links) == len(sets) - 1:
            break
        size = length[p]
        if size.sum() <= (0 if side[x] else len(p)):
            continue  # shares nothing
        begin = np.repeat(starts[p] - np.r_[0, np.cumsum(size)[:-1]], size)
        common = np.bincount(owner[begin + np.arange(len(begin))], minlength=len(sets))
        ys = np.flatnonzero((common > 0) & (den * den * common * common >= num * num * n * n[x]))
        ys = ys[ys != x]
        if len(ys):
            forest.join(x, ys)
    return forest.links


def verified_links(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between rows (group, node, n, text) of a group whose texts are similar."""
    ratio, most, much = Fraction(str(similarity)), BLOCK_POINTS, BLOCK_SHINGLES
    sizes = texts.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum("n") / F.lit(much))).cast("int").alias("blocks"))
    large = small(written(sizes.filter("blocks > 1")))
    dealt = in_blocks(texts.join(large, "group", "left"), "group", "node", F.col("blocks")).select("key", "side", "node", "text")

    def find(batches):
        for pdf in runs(batches, "key"):
            node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
            sets = [shingle_set(t, size) for t in pdf["text"]]
            key = pdf["key"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for x, y in similar_links(sets[lo:hi], side[lo:hi], ratio):
                    a.append(node[lo + x])
                    b.append(node[lo + y])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(find, "a long, b long")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near copies, the one of least id; columns are as they were."""
    known = lambda c: F.col(c).cast("long")
    prints = written(docs.select(known(key).alias("id"), F.xxhash64(text).alias("mark"), sketches(F.col(text), size).alias("s")).select("id", "mark", "s.*"))
    # A row is known by its id and the hash of its text, for an id may stand for several texts.
    each = prints.groupBy("h", "id", "mark").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "fp", "anchors")))
    order = [F.col("id").isNull().alias("unknown"), "id", "mark"]
    least = each.groupBy("h").agg(F.min(F.struct(*order, "copies", "n", "fp", "anchors")).alias("p"))
    points = written(least.select("p.*", F.monotonically_increasing_id().alias("node")))
    loose = written(components(written(candidate_links(points))))
    grouped = points.join(loose, "node", "left").select("id", "mark", "copies", "node", "n", F.col("component").alias("group"))
    # The one shuffle of texts: copies of equal sets go, and each row learns its group.
    names = dict(zip(("id", "mark", "copies", "node", "n", "group"), fresh(docs, "_id", "_mark", "_copies", "_node", "_n", "_group"), strict=True))
    plan = grouped.select(*(F.col(c).alias(names[c]) for c in names))
    same = known(key).eqNullSafe(F.col(names["id"])) & (F.xxhash64(text) == F.col(names["mark"]))
    rows = docs.join(plan.hint("shuffle_hash"), same).drop(names["id"], names["mark"])
    rows = written(rows.withColumn(names["id"], F.col(names["group"]).isNotNull()), by=names["id"])
    single, repeated = (rows.filter(F.col(names["copies"]) == 1), rows.filter(F.col(names["copies"]) > 1).dropDuplicates([names["node"]]))
    rows = single.union(repeated)
    alone, near = rows.filter(~F.col(names["id"])), rows.filter(names["id"])
    texts = near.select(*(F.col(names[c]).alias(c) for c in ("group", "node", "n")), F.col(text).alias("text"))
    found = written(components(written(verified_links(texts, size, similarity))))
    chosen = grouped.filter("group is not null").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("class"))
    kept = written(chosen.agg(F.min(F.struct(*order, "node")).alias("p")).select(F.col("p.node").alias(names["id"] + "kept")))
    stay = near.join(kept.hint("shuffle_hash"), F.col(names["node"]) == F.col(names["id"] + "kept"), "left_semi")
    return alone.union(stay).select(*docs.columns)
