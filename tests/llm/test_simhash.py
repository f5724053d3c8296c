"""Operator 6 and the components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lectern.llm import components, simhash


def brute_components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(rnd.randint(2000, 2600), rnd.randint(2000, 2600)) for _ in range(350)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def some_texts(n):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one two É", "a b c d", "x " * 20_000]
    while len(texts) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 80, 300]))]
        for _ in range(rnd.choice([1, 1, 6])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "Edit" + str(rnd.random())
            texts.append(" ".join(copy if rnd.random() < 0.8 else base))
    return texts[:n]


@pytest.mark.parametrize("shard_points", [64, 32768])
def test_simhash_equals_all_pairs(spark, shard_points, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", shard_points)
    texts = some_texts(700)
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_classes(rows).collect()}
    prints = [brute_print(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = brute_components(range(len(texts)), pairs)
    assert got == {i: (prints[i], want[i]) for i in range(len(texts))}
    assert simhash.simhash_classes(rows.limit(0)).count() == 0


def test_search_prunes_without_losing_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, 1500)], dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ flips]))
    links = simhash.search(points[:, None], np.ones(len(points), bool), 4)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 4)
    assert brute_components(range(len(points)), links) == brute_components(range(len(points)), zip(i.tolist(), j.tolist()))
    assert all(np.bitwise_count(points[a] ^ points[b]) <= 4 for a, b in links)


def test_a_task_holds_two_blocks_however_many_visit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 1500)
    found = np.unique(np.concatenate([base, base ^ 5, base ^ 1025]))
    points = spark.createDataFrame([(int(x), i) for i, x in enumerate(found)], "fp long, rep long")
    held = []
    taken = type(points.groupBy("rep")).applyInPandas
    monkeypatch.setattr(type(points.groupBy("rep")), "applyInPandas", lambda self, f, schema: held.append(self.count()) or taken(self, f, schema))
    links = [tuple(r) for r in simhash.near_links(points, 4, shard_points=200).collect()]
    assert max(r["count"] for r in held[0].collect()) <= 600 < len(found)
    values = found.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 4)
    assert brute_components(range(len(found)), links) == brute_components(range(len(found)), zip(i.tolist(), j.tolist()))


def test_rows_without_an_id_keep_their_class(spark):
    rows = [(7, "one two three four five"), (None, "one two three four five"), (9, "x y z"), (None, "quite other words than these"), (9, "green and blue and red")]
    got = [(r.id, r.component_id) for r in simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(7, 7), (None, 7), (9, 9), (None, None), (9, 9)], key=str)
