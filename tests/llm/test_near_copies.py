"""The near-dedup stage against brute force around its similarity."""

import random
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import near_copies


def brute_shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def cosine(a, b):
    return bool(a and b) and 25 * len(a & b) ** 2 >= 16 * len(a) * len(b)


def classes_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def brute_kept(rows):
    """Ids kept of (id, text) rows."""
    sets = [brute_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or cosine(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(root(i), []).append((key, text))
    return sorted(min(k for k, _ in g) for g in groups.values())


def around(n):
    """Texts with edits that leave similarities on both sides of 0.8, and exactly on it."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = ["", " ", "a", "A", "a b c d e f g h", "a b c d e f g h i", "x y " * 300]
    while len(texts) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice([9, 24, 60, 180, 400]))]
        for _ in range(rnd.choice([1, 2, 5])):
            copy, at = list(base), rnd.randrange(len(base))
            for k in range(rnd.choice([0, 1, 2, 3, 5, 8])):
                copy[(at + 7 * k) % len(copy)] = rnd.choice(vocab)
            texts.append(" ".join(copy[: rnd.choice([len(copy), len(copy) * 4 // 5 + 1])]))
    return texts[:n]


@pytest.mark.parametrize("most", [5, 4096])
def test_stage_equals_brute_force_around_the_similarity(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "BLOCK_POINTS", most)
    monkeypatch.setattr(near_copies, "FEW", min(most, 8))
    rows = list(enumerate(around(500)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicated(docs).collect()) == brute_kept(rows)


def test_one_id_with_several_texts(spark):
    far, near = "one two three four five six seven", "red green blue black white brown pink"
    rows = [(1, far), (1, far), (1, near), (2, near), (3, "other words stand here alone"), (3, far), (None, far), (4, None), (5, ""), (None, "no id but a text of its own"), (None, "no id but a text of its own")]
    got = near_copies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, far), (1, near), (3, "other words stand here alone"), (4, ""), (0, "no id but a text of its own")])


def test_links_are_those_of_all_pairs_and_hubs_end_the_search():
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for _ in range(200):
        copy = list(base)
        for k in rnd.sample(range(300), 10):
            copy[k] = "e" + str(rnd.random())
        texts.append(" ".join(copy))
    sets = [near_copies.shingle_set(t, 5) for t in texts]
    everywhere = np.zeros(len(sets), np.int8)
    links = near_copies.similar_links(sets, everywhere, Fraction(4, 5))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if cosine(set(sets[i]), set(sets[j]))}
    assert all((max(p), min(p)) in want for p in links)
    assert classes_of(len(sets), links) == classes_of(len(sets), want)
    sides = np.array([1 + i % 2 for i in range(len(sets))], np.int8)
    across = near_copies.similar_links(sets, sides, Fraction(4, 5))
    assert classes_of(len(sets), across) == classes_of(len(sets), [p for p in want if sides[p[0]] != sides[p[1]]])


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"some words that stand here {i // 2}", i, i, "a", "b") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, id int, _group string, node string")
    got = simhash_rows(docs)
    assert got == [rows[0], rows[2], rows[4]]
    assert near_copies.deduplicated(docs.limit(0)).columns == docs.columns and near_copies.deduplicated(docs.limit(0)).count() == 0


def simhash_rows(docs):
    return sorted(tuple(r) for r in near_copies.deduplicated(docs).collect())
