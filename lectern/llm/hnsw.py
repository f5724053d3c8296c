"""Operator 10, embedding near-dedup with one navigable small-world graph for each shard.

Equal vectors are one point with a multiplicity. Points are dealt by hash to shards of bounded bytes;
each shard's graph is built layer by layer and written to the shared folder. Every point then queries
every shard: a task holds a range of the points and loads one graph after the other, each once. Beams start
narrow. A query whose beam is full of links is widened, and where the widest is full as well the query looks at
every node; the beams of all queries are widened until the links of an audit set, found by brute force in the
shard, have all been found. Links are verified in double precision; a task returns counts and a spanning forest,
not pairs, and ``components`` joins them. Whether both ends of every link have found it shows in a count and a
checksum of either side; vectors for which they differ are compared with every vector.

Edge cases: null, empty and zero vectors and those with null or non-finite components link with
nothing and are their own component, as are rows without an id; vectors of unlike length never link; equal vectors
and repeated rows link with each other; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import files, shared_dir, written
from lectern.llm.components import components
from lectern.llm.simhash import Forest

#: Up to so many shards a table is dealt by so many vectors each, so that building is spread; then by bytes of vectors and links.
SHARDS, SHARD_POINTS = 6, 4096
SHARD_BYTES = 128 << 20
#: Query points of a task.
RANGE = 20_000
#: Links a node is given, beams for building and at the start of a query, and audited queries of a task and shard.
LINKS, BUILD, BEAM, AUDIT = 16, 48, 16, 256
#: The widest beam; a query that fills it with links looks at every node.
WIDEST = 256


#: Similarities compared at once where a query looks at every node.
CELLS = 1 << 22


class Graph:
    """Layers over unit vectors; node order is by falling level, so layer l holds the first n_l nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        level = np.floor(-np.log(r.random(len(vectors)) + 1e-300) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        top = max(0, int(level.max(initial=0)))
        self.sizes = [int((level >= k).sum()) for k in range(top + 1)]
        self.layers: list[np.ndarray] = [None] * (top + 1)
        self.batch = max(16, min(256, (1 << 25) // max(1, len(vectors))))
        for k in range(top, -1, -1):
            self.build(k)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest node found above layer ``to``, for each query."""
        at = np.zeros(len(q), np.int64)
        for k in range(len(self.layers) - 1, to, -1):
            at = self.beam(k, q, at, 8, 1)[0][:, 0]
        return at

    def beam(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``width`` nodes that a best-first walk finds, nearest first; -1 where fewer."""
        near, rows = self.layers[layer], np.arange(len(q))
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -np.inf, np.float32)
        done = np.zeros((len(q), width), bool)
        seen = np.zeros((len(q), self.sizes[layer]), bool)
        ids[:, 0], sims[:, 0] = entry, np.einsum("bd,bd->b", q, self.x[entry])
        seen[rows, entry] = True
        live = rows
        while len(live):
            open_sims = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
            pick = np.argpartition(-open_sims, min(step, width) - 1, axis=1)[:, :step]
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            busy = good.any(1)
            live, pick, good = live[busy], pick[busy], good[busy]
            if not len(live):
                break
            done[live[:, None], pick] |= good
            nodes = np.where(good, ids[live[:, None], pick], 0)
            found = np.where(good[:, :, None], near[nodes], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)
            fresh = found >= 0
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            safe = np.where(fresh, found, 0)
            fresh &= ~seen[live[:, None], safe]
            seen[np.broadcast_to(live[:, None], found.shape)[fresh], found[fresh]] = True
            s = np.where(fresh, np.matmul(self.x[safe], q[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
            all_s = np.concatenate([sims[live], s], 1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            sims[live] = np.take_along_axis(all_s, keep, 1)
            ids[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(np.concatenate([ids[live], safe], 1), keep, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(fresh)], 1), keep, 1)
        return ids, sims

    def chosen(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, cap: int) -> np.ndarray:
        """Up to cap of the candidates (nearest first), nearer to q than to those chosen before; then the nearest others."""
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            closest = np.where(taken, between[:, c, :], -np.inf).max(1)
            taken[:, c] = (ids[:, c] >= 0) & (sims[:, c] > closest) & (taken.sum(1) < cap)
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :cap]
        return np.take_along_axis(ids, order, 1)

    def build(self, layer: int) -> None:
        n, cap = self.sizes[layer], LINKS * (2 if layer == 0 else 1)
        self.layers[layer] = near = np.full((n, cap), -1, np.int32)
        at = 0
        while at < n:
            end = min(n, at + (self.batch if at >= self.batch else max(1, self.batch // 2)))
            q = self.x[at:end]
            mine = np.arange(at, end)
            peers = q @ q.T
            peers[np.triu_indices(len(q))] = -np.inf  # earlier ones of the batch
            k = min(len(q), 16)
            p = np.argsort(-peers, axis=1)[:, :k]
            ids, sims = np.where(np.isfinite(np.take_along_axis(peers, p, 1)), at + p, -1), np.take_along_axis(peers, p, 1)
            if at:
                entry = np.minimum(self.descend(q, layer), at - 1)
                more, s = self.beam(layer, q, entry, BUILD, 4)
                ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, s], 1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            out = self.chosen(q, ids, sims, LINKS)
            near[at:end, : out.shape[1]] = out
            a, b = np.repeat(mine, out.shape[1]), out.ravel()
            self.link_back(near, b[b >= 0], a[b >= 0], cap)
            at = end

    def link_back(self, near: np.ndarray, to: np.ndarray, new: np.ndarray, cap: int) -> None:
        """Adds the new nodes to the lists of those they chose; full lists are chosen anew."""
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        for k in range(0, len(nodes), 1024):
            part, width = nodes[k : k + 1024], int(count[k : k + 1024].max())
            here = slice(first[k], first[k] + int(count[k : k + 1024].sum()))
            extra = np.full((len(part), width), -1, np.int64)
            extra[np.repeat(np.arange(len(part)), count[k : k + 1024]), place[here]] = new[here]
            ids = np.concatenate([near[part], extra], 1)
            sims = np.where(ids >= 0, np.matmul(self.x[np.maximum(ids, 0)], self.x[part][:, :, None])[:, :, 0], -np.inf)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * cap]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            full = (ids >= 0).sum(1) > cap
            near[part[~full]] = ids[~full][:, :cap]
            if full.any():
                near[part[full]] = self.chosen(self.x[part[full]], ids[full], sims[full], cap)

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the nodes found at a similarity of least, and which queries looked at every node."""
        out: list = [None] * len(q)
        scanned = np.zeros(len(q), bool)
        full = []
        for k in range(0, len(q), self.batch):
            todo = np.arange(k, min(len(q), k + self.batch))
            entry, w = self.descend(q[todo], 0), width
            while len(todo) and w <= max(width, WIDEST):
                ids, sims = self.beam(0, q[todo], entry, w, max(4, w // 16))
                hit = sims >= least
                whole = ~hit[:, -1]
                for i, row, h in zip(todo[whole], ids[whole], hit[whole], strict=True):
                    out[i] = row[h]
                todo, entry, w = todo[~whole], ids[~whole, 0], w * 4
            full.append(todo)
        left = np.concatenate(full) if full else np.zeros(0, np.int64)
        scanned[left] = True
        for i, near in zip(left, self.scan(q[left], least), strict=True):
            out[i] = near
        return out, scanned

    def scan(self, q: np.ndarray, least: float):
        """For each query the nodes of a similarity of least, by looking at every node."""
        step = max(1, CELLS // max(1, len(self.x)))
        for k in range(0, len(q), step):
            row, near = np.nonzero(q[k : k + step] @ self.x.T >= least)
            yield from np.split(near, np.searchsorted(row, np.arange(1, len(q[k : k + step]))))


def audited(graph: Graph, q: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """within(), with beams widened until the audited queries miss no link."""
    at = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT)).astype(int))
    # What is found is near enough, so equal counts are equal sets; products differ in the last digits.
    true = [len(near) for near in graph.scan(q[at], least + 1e-6)]
    width = BEAM
    while True:
        got, _ = graph.within(q[at], least, width)
        if all(len(g) >= t for t, g in zip(true, got, strict=True)):
            return graph.within(q, least, width)
        width *= 2


def unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64) if not isinstance(vectors, np.ndarray) else vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # huge and tiny vectors have a finite norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def mixed_bits(ids: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each id, for checksums of sets by exclusive or."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", embedding: str = "embedding", shards: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept, n_walked, n_scanned) of every vector.

    The last two count the shards in which its links were found by a walk, and by looking at every node.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("v", F.when(sound & F.col("id").isNotNull(), F.col("v"))))
    points = written(rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    n, size, path = *points.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first(), shared_dir(spark)
    shards = shards or max(1, min(SHARDS, -(-n // SHARD_POINTS)), -(-(8 * size + 16 * LINKS * n) // SHARD_BYTES))
    graphs = points.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards))).withColumn("dim", F.size("v"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        raw = np.array(list(pdf["v"]))
        g = Graph(unit(raw))
        fs, base = files(path)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"  # what a repeated attempt leaves is never listed
        with fs.open_output_stream(name, compression=None) as f:
            f.write(pickle.dumps((g, raw[g.order], pdf["rep"].to_numpy()[g.order], pdf["m"].to_numpy()[g.order]), protocol=5))
        return pd.DataFrame({"name": [name], "dim": [raw.shape[1]]})

    listed = sorted(tuple(r) for r in written(graphs.groupBy("shard", "dim").applyInPandas(build, "name string, dim int")).collect())

    def query(batches, whole=False):
        fs, _ = files(path)
        every = pd.concat([pd.DataFrame({"rep": pd.Series([], dtype="int64"), "v": pd.Series([], dtype=object)}), *batches], ignore_index=True)
        for dim, own in every.groupby(every["v"].map(len)):
            exact, rep = unit(own["v"]), own["rep"].to_numpy(dtype=np.int64)
            q, total, sums = exact.astype(np.float32), np.zeros(len(own), np.int64), np.zeros((len(own), 4), np.int64)
            for name, d in listed:
                if d != dim:
                    continue
                with fs.open_input_stream(name, compression=None) as f:
                    g, raw, ids, m = pickle.loads(f.read())
                names, place = np.unique(np.concatenate([rep, ids]), return_inverse=True)
                forest, bits, own_bits, met = Forest(len(names)), mixed_bits(ids), mixed_bits(rep), np.zeros((len(ids), 2), np.int64)
                all_near, scanned = (g.scan(q, least - 1e-4), np.ones(len(q), bool)) if whole else audited(g, q, least - 1e-4)
                sums[:, 2] += ~scanned
                sums[:, 3] += scanned
                for i, near in enumerate(all_near):
                    near = near[ids[near] != rep[i]]
                    if len(near):
                        # Single precision decides what is far from the line; what is near it is computed in double.
                        clear = g.x[near] @ q[i] >= least + 1e-4
                        edge = near[~clear]
                        near = np.concatenate([near[clear], edge[unit(raw[edge]) @ exact[i] >= least]]) if len(edge) else near
                    if len(near):
                        total[i] += m[near].sum()
                        sums[i, 0] += len(near)
                        sums[i, 1] ^= np.bitwise_xor.reduce(bits[near])
                        met[near, 0] += 1
                        met[near, 1] ^= own_bits[i]
                        forest.join(int(place[i]), place[len(rep) + near])
                links = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
                yield result(names[links[:, 0]], names[links[:, 1]])
                seen = np.flatnonzero(met[:, 0])
                yield result(ids[seen], ids[seen], back=-met[seen, 0], check=met[seen, 1])
            yield result(rep, rep, total, sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3])

    def result(a, b, n=0, back=0, check=0, walked=0, scanned=0) -> pd.DataFrame:
        """Links, or counts of a vector: back and check come to zero where both ends found the same links."""
        zeros = np.zeros(len(a), np.int64)
        return pd.DataFrame({"a": a, "b": b, "n": zeros + n, "back": zeros + back, "bits": zeros + check, "walked": zeros + walked, "scanned": zeros + scanned})

    kind = "a long, b long, n long, back long, bits long, walked long, scanned long"
    # Every point against every shard is by far the most work: it is spread evenly, whatever the files were.
    found = written(points.repartition(max(12, -(-n // RANGE)), "rep").mapInPandas(query, kind))
    counts = written(found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"), F.sum("back").alias("back"), F.bit_xor("bits").alias("bits"), F.sum("walked").alias("n_walked"), F.sum("scanned").alias("n_scanned")))
    links = found.select("a", "b")
    uneven = written(points.join(counts.filter("back <> 0 or bits <> 0").select("rep"), "rep"))
    if not uneven.isEmpty():
        again = written(uneven.mapInPandas(lambda batches: query(batches, whole=True), kind))
        exact = again.filter("walked + scanned > 0").select(F.col("a").alias("rep"), F.col("n").alias("n_exact"), F.col("scanned").alias("more"))
        counts = counts.join(exact, "rep", "left").withColumns({"n": F.coalesce("n_exact", "n"), "n_scanned": F.coalesce("more", "n_scanned"), "n_walked": F.when(F.col("more").isNull(), F.col("n_walked")).otherwise(0)})
        links = links.union(again.select("a", "b"))
    reach = written(components(links))
    joined = points.join(counts, "rep").join(reach, points["rep"] == reach["node"], "left")
    classes = written(joined.select("v", (F.col("n") + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), "n_walked", "n_scanned"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(classes, "v", "left").select(
        "id", zero("n").alias("n_links"), F.coalesce("c", "id").alias("component_id"), (F.col("id") == F.coalesce("c", "id")).alias("kept"), zero("n_walked").alias("n_walked"), zero("n_scanned").alias("n_scanned")
    )


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM e JOIN comp ON vec_id = comp.a LEFT JOIN deg ON vec_id = deg.a
"""
