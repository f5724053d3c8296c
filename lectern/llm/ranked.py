"""Operator 12, ranked lexical search over frequency-ordered document trees.

The terms of the items are the vocabulary; one pass over the documents keeps of each text its length and
the counts of vocabulary terms, as a written table. Corpus counts come from that table. Each task then
lays its documents, block by block, into a tree: a document is the path of its terms, most frequent in the
corpus first, so that documents share paths; paths without branches are one edge. Every node knows the
largest count of each term below it and the smallest length part ``m``, which together bound the score
of any document below. An item walks the tree depth first, best bounds first, and leaves out what its
tenth score so far excludes. Leaves are bounded by their own score, so what is left is exact. A task
returns at most ``k`` rows for an item; a window over these gives the ranks.

Edge cases: null and empty texts have no terms and no rank, but take nothing from the counts; items
without terms, or whose terms no document has, return no row; equal scores go by ascending id, null ids
last; repeated documents are ranked one by one and an item's repeated rows once; items of one id and
unlike texts are ranked apart; empty tables give an empty result; further columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

#: Bytes to bytes: letters to lower case, what is no part of a term to a blank. Bytes of 128 and more belong to terms.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Bytes of item texts that are searched for in one go; more items take further passes over the documents.
ITEM_BYTES = 32 << 20
#: Cells (leaves times terms) and leaves of a block, and children looked at in one step where a node has no more.
CELLS, LEAVES, STEP = 1 << 24, 4096, 256
NO_ID = np.iinfo(np.int64).max


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The m of documents of n terms."""
    return 100 - 90 + (90 * n * n_docs) // total


def gains(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of rows of counts; counts that are maxima and an m that is a minimum give bounds."""
    tf = tf.astype(np.int64)
    return (w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(axis=1)


class Best:
    """The k best (score, id) of an item so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The least score that can still enter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


class Tree:
    """Documents as paths of terms, most frequent first; leaves come before inner nodes in all arrays.

    rows: (path of term ranks, counts, m, id) of each document. Documents equal in path, counts and m are
    one leaf, which needs the k smallest ids only: no item can return more of them.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int, int]], k: int):
        rows = sorted(((p.astype(">u4").tobytes(), c.astype(">u4").tobytes(), m, i) for p, c, m, i in rows))
        leaves: list[tuple[bytes, bytes, int]] = []
        self.ids: list[list[int]] = []
        for path, counts, m, i in rows:
            if not leaves or leaves[-1] != (path, counts, m):
                leaves.append((path, counts, m))
                self.ids.append([])
            if len(self.ids[-1]) < k:
                self.ids[-1].append(i)
        paths = [np.frombuffer(p, ">u4").astype(np.int64) for p, _, _ in leaves]
        counts = [np.frombuffer(c, ">u4").astype(np.int64) for _, c, _ in leaves]
        self.terms, at = np.unique(np.concatenate(paths), return_inverse=True)
        every = np.concatenate(counts)
        kind = np.uint16 if int(every.max(initial=0)) < 1 << 16 else np.uint32
        leaf = np.zeros((len(leaves), len(self.terms)), kind)
        leaf[np.repeat(np.arange(len(leaves)), [len(p) for p in paths]), at] = every
        self.kids: list[list[int]] = []
        self.root = self._link(paths)
        inner = np.zeros((len(self.kids), len(self.terms)), kind)
        self.most = np.concatenate([leaf, inner])
        self.m = np.array([*(m for _, _, m in leaves), *(0 for _ in self.kids)], np.int64)
        for node, kids in enumerate(self.kids, len(leaves)):  # children are numbered before their parents
            np.maximum.reduce(self.most[kids], axis=0, out=self.most[node])
            self.m[node] = self.m[kids].min()
        self.n_leaves, self.fan = len(leaves), np.array([len(kids) for kids in self.kids])

    def _link(self, paths: list[np.ndarray]) -> int:
        """Lists the children of each inner node, one for every place where sorted paths part; returns the root."""
        open_nodes: list[tuple[int, list[int]]] = [(0, [])]  # (depth, children) from the root to the latest leaf

        def closed(down_to: int, child: int) -> int:
            while open_nodes[-1][0] > down_to:
                kids = open_nodes.pop()[1]
                self.kids.append([*kids, child])
                child = len(paths) + len(self.kids) - 1
            return child

        for i in range(1, len(paths)):
            a, b = paths[i - 1], paths[i]
            size = min(len(a), len(b))
            differs = a[:size] != b[:size]
            shared = int(differs.argmax()) if differs.any() else size
            child = closed(shared, i - 1)
            if open_nodes[-1][0] < shared:
                open_nodes.append((shared, []))
            open_nodes[-1][1].append(child)
        child = closed(0, len(paths) - 1)
        self.kids.append([*open_nodes[0][1], child])
        return len(paths) + len(self.kids) - 1

    def search(self, own: np.ndarray, w: np.ndarray, best: Best) -> int:
        """Adds to best what the tree has for the terms own of weights w; returns how many nodes were looked at."""
        at = np.searchsorted(self.terms, own)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == own[here]
        cols, w = at[here], w[here]
        if not len(cols):
            return 0
        stack, looked = [(np.array([self.root]), np.array([NO_ID]))], 0
        while stack:
            nodes, bounds = stack.pop()
            nodes = nodes[bounds >= best.least]
            if not len(nodes):
                continue
            kids = np.concatenate([self.kids[n - self.n_leaves] for n in nodes])
            looked += len(kids)
            bounds = gains(self.most[np.ix_(kids, cols)], self.m[kids], w)
            good = bounds >= best.least
            kids, bounds = kids[good], bounds[good]
            leaf = kids < self.n_leaves
            if leaf.any():
                ids = [self.ids[n] for n in kids[leaf]]
                best.add(np.repeat(bounds[leaf], [len(x) for x in ids]), np.concatenate(ids).astype(np.int64))
                kids, bounds = kids[~leaf], bounds[~leaf]
            order = np.argsort(-bounds, kind="stable")
            group = np.cumsum(self.fan[kids[order] - self.n_leaves]) // STEP
            for part in reversed(np.split(order, np.flatnonzero(np.diff(group)) + 1)):  # the last pushed, which is taken first, has the highest bounds
                stack.append((kids[part], bounds[part]))
        return looked


def _vectors(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(id, n, terms, counts): places in known and counts of the known terms of each text that has a term."""
    place = {t: i for i, t in enumerate(known)}

    def counted(batches):
        for batch in batches:
            ids, ns, ts, cs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                tf: dict[int, int] = {}
                for t in map(place.get, words):
                    if t is not None:
                        tf[t] = tf.get(t, 0) + 1
                ids.append(i)
                ns.append(len(words))
                ts.append(list(tf))
                cs.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(ts, pa.list_(pa.int32())), pa.array(cs, pa.list_(pa.int32()))], ["id", "n", "terms", "counts"]
            )

    return written(docs.mapInArrow(counted, "id long, n long, terms array<int>, counts array<int>"))


def _searched(docs: DataFrame, items: list[tuple[int, int, list[bytes]]], k: int) -> DataFrame:
    """(row, item_id, id, score): the k best documents of each item in each task. items: (row, id, terms)."""
    known = sorted({t for _, _, own in items for t in own})
    vectors = _vectors(docs, known)
    n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for a term of the items, whose bytes are bounded.
    df = {r.t: r.n for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    by_df = sorted(df, key=lambda t: (-df[t], t))
    rank = np.full(len(known), -1, np.int64)
    rank[by_df] = np.arange(len(by_df))
    w = np.array([weight(n_docs, df[t]) for t in by_df], np.int64)
    place = {t: i for i, t in enumerate(known)}
    asked = []
    for row, item, own in items:
        r = rank[[place[t] for t in own]]
        if len(r := np.sort(r[r >= 0])):
            asked.append((row, item, r))

    def search(batches):
        best = [Best(k) for _ in asked]
        rows, own_terms = [], set()

        def flush():
            if rows:
                tree = Tree(rows, k)
                for (_, _, r), b in zip(asked, best, strict=True):
                    tree.search(r, w[r], b)
                rows.clear()
                own_terms.clear()

        for batch in batches:
            ids, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ms = length_part(ns, n_docs, total)
            (ts, cs), starts = (batch.column(c).flatten().to_numpy() for c in (2, 3)), batch.column(2).offsets.to_numpy()
            starts = starts - starts[0]
            for i, id_ in enumerate(ids):
                r = rank[ts[starts[i] : starts[i + 1]]]
                if not len(r):
                    continue
                order = np.argsort(r)
                own_terms.update(r.tolist())
                rows.append((r[order], cs[starts[i] : starts[i + 1]][order], int(ms[i]), NO_ID if id_ is None else id_))
                if len(rows) >= LEAVES or len(rows) * len(own_terms) >= CELLS:
                    flush()
        flush()
        for (row, item, _), b in zip(asked, best, strict=True):
            if len(b.ids):
                ids = pd.array(b.ids, "Int64")
                ids[b.ids == NO_ID] = pd.NA
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"row": row, "item_id": pd.array([item] * len(ids), "Int64"), "id": ids, "score": b.scores}), preserve_index=False)

    return vectors.filter(F.size("terms") > 0).select("id", "n", "terms", "counts").mapInArrow(search, "row long, item_id long, id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item.

    Items are taken in passes of ITEM_BYTES of text at most, as the terms of a pass travel to every task.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-size // ITEM_BYTES))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).filter("t is not null")
    found = None
    for k_pass in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(passes)) == k_pass).orderBy("item_id", "t").collect()
        own = [(row, r.item_id, sorted(set(terms(r.t)))) for row, r in enumerate(part)]
        own = [x for x in own if x[2]]
        if own:
            out = _searched(texts, own, k).withColumn("pass", F.lit(k_pass))
            found = out if found is None else found.union(out)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("pass", "row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
full_docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM full_docs),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM full_docs) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (SELECT item_id, q.t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df ON q.t = df.t, c),
s AS (SELECT item_id, doc_id, f.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM w JOIN tf ON w.t = tf.t JOIN full_docs f ON f.r = tf.r, c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
