"""Operator 9, a quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by its byte histogram and a few
shape statistics; an encoder layer, gated attention weights over the passages of the document, and a
logistic score of the weighted passage representation are learnt together from document labels.

The classifier is fitted on at most ``TRAIN_DOCS`` labelled documents, those of least seeded hash, with at
most ``TRAIN_PASSAGES`` passages of each, evenly spaced over the whole text, so the driver holds 200 MB at worst;
scoring covers every passage of every document. Edge cases: a text without words,
or null, is one passage of zeros; with no labels at all every score is 0.5; repeated rows get equal
scores; an id of several texts teaches by the least of them, by its highest label; a null id is held out; an empty
table gives an empty result; further columns stay, but one named ``score`` is replaced; labels,
language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 3000
TRAIN_PASSAGES = 64
PASSAGE = 64
WIDTH = 256 + 6
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 40, 64, 0.01


def passages(text: str | None) -> np.ndarray:
    """(passages, WIDTH) features of a whole text."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    out = np.zeros((-(-len(words) // PASSAGE), WIDTH), np.float32)
    for k in range(len(out)):
        part = words[k * PASSAGE : (k + 1) * PASSAGE]
        body = b" ".join(part)
        counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
        out[k, :256] = np.sqrt(counts / len(body))
        n = len(part)
        symbols = counts[33:48].sum() - counts[39] - counts[44:47].sum() + counts[60] + counts[62] + counts[124]
        out[k, 256:] = (len(set(part)) / n, len(body) / n / 10, symbols / n, counts[48:58].sum() / n, n / PASSAGE, np.log1p(len(words)) / 10)
    return out


class Attention:
    """Gated attention over passages; parameters are small arrays that travel with the task."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.p = {"w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE, 1)[:, 0], "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["w"] + p["b"], 0)
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lengths))
        attn = e / np.repeat(np.add.reduceat(e, starts), lengths)
        z = np.add.reduceat(attn[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, t, g, attn, z, s

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(b) for b in bags])
        return self.forward(np.concatenate(bags), np.r_[0, np.cumsum(lengths)[:-1]], lengths)[-1]

    def gradient(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the bags, for each parameter."""
        lengths = np.array([len(b) for b in bags])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        x, h, t, g, attn, z, s = self.forward(np.concatenate(bags), starts, lengths)
        p, ds = self.p, (s - y) / len(bags)
        dz = np.repeat(ds[:, None] * p["c"], lengths, axis=0)
        da = (dz * h).sum(1)
        de = attn * (da - np.repeat(np.add.reduceat(attn * da, starts), lengths))
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (attn[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (h > 0)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (de[:, None] * t * g).sum(0), "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r, m1, m2, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                grad = self.gradient([bags[i] for i in at], y[at])
                step += 1
                for n, d in grad.items():
                    d = d + 1e-4 * self.p[n]
                    m1[n], m2[n] = 0.9 * m1.get(n, 0) + 0.1 * d, 0.999 * m2.get(n, 0) + 0.001 * d * d
                    self.p[n] = self.p[n] - RATE * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning; rows without an id always are."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def spaced(bag: np.ndarray, most: int = TRAIN_PASSAGES) -> np.ndarray:
    """At most so many passages of a bag, evenly spaced over the whole of it."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(int)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> Attention | None:
    """Fits on at most so many labelled documents outside the held-out fold, one text for each id."""
    drawn = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def encode(batches):
        for pdf in batches:
            bags = [spaced(passages(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [b.tobytes() for b in bags]})

    # An id may stand for many rows: the least of its texts is learnt from, whatever order they come in.
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = texts.mapInPandas(encode, "doc_id long, y int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("doc_id", kind="stable")
    model = Attention()
    model.fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got["x"]], got["y"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Attention | None, text: str = "text"):
    """docs with ``score``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        out = [model.score([passages(t) for t in texts.iloc[k : k + 256]]) for k in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out))

    return docs.withColumn("score", score(F.col(text)))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
