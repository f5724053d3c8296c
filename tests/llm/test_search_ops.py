"""Operators 11, 12 and 13 against brute force and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import licenses, ranked, whitening

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Whitening.


def whitened(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    return whitening.whiten(table, **options).collect()


def test_whitening_equals_a_dense_decomposition(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 24)) @ np.diag(np.linspace(3, 0.3, 24))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, x[7].tolist(), "x") for i in range(150)]
    rows += [(2000, None, ""), (2001, [math.nan] * 24, ""), (2002, [None] * 24, ""), (2003, [math.inf] * 24, ""), (2004, [], ""), (2005, [1.0], ""), (2006, [1e300] * 24, ""), (None, x[3].tolist(), "")]
    got = whitened(spark, rows)
    assert Counter(r.vec_id for r in got) == {i: 16 for i in [*range(300), *range(1000, 1150), None]}
    g = np.floor(64 * x).astype(int) + 1_000_000
    s, n = g.sum(axis=0), len(g)
    c = (n * g - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, z = e[::-1][:16], c @ q[:, ::-1][:, :16] / np.sqrt(e[::-1][:16])
    own = np.zeros((300, 16))
    for r in got:
        i = 3 if r.vec_id is None else 7 if r.vec_id >= 1000 else r.vec_id
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(g[i], s)) and r.identity_error < 1e-12  # noqa: B905
        assert abs(r.explained * np.trace(v) / e[r.component - 1] - 1) < 1e-10
        own[i, r.component - 1] = r.whitened
    sign = np.sign((own * z).sum(axis=0))
    assert np.abs(own - z * sign).max() < 1e-9


@pytest.mark.parametrize("rows, components", [([(1, [0.5, 0.25], "")] * 3, 0), ([(1, [0.0, 5.0], ""), (2, [1.0, 5.0], "")], 1), ([], 0), ([(1, None, "")], 0)])
def test_whitening_without_variance(spark, rows, components):
    got = whitened(spark, rows)
    assert len(got) == components * len(rows)
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 for r in got)


@pytest.mark.parametrize("d, gap", [(150, 1e-2), (400, 1e-4)])
def test_jacobi_davidson_with_restarts_and_near_equal_values(d, gap):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    values = np.concatenate([[9, 9 - gap, 8, 8, 7, 6, 5, 4], np.linspace(3, 0.01, d - 8)])
    a = q @ np.diag(values) @ q.T
    e, u = whitening.leading_pairs(lambda w: a @ w, d, 10)
    assert np.abs(e - values[:10]).max() < 1e-12 * 9
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * 9 and np.abs(u.T @ u - np.eye(10)).max() < 1e-13


def test_deviations_beyond_long_integers():
    x = np.array([[1 << 50, 0], [0, 0]])
    off = whitening.offsets(x, 1 << 20, [1 << 50, 0])
    assert off[0, 0] == (1 << 70) - (1 << 50) and whitening.deviations(off) == [None, None]
    assert whitening.deviations(whitening.offsets(x, 2, [0, 0])) == [None, 0]


# Ranked search.


def brute_ranks(docs, items, k=10):
    held = [(i, TERM.findall(fold(t))) for i, t in docs]
    held = [(i, Counter(ts), len(ts)) for i, ts in held if ts]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}):
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(fold(text))) if c[t])
            if score > 0:
                scores.append((-score, i is None, i, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[3], r[1]))


def ranks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "'y' as n")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' as rank")
    return sorted((tuple(r) for r in ranked.ranked_search(d, i).collect()), key=lambda r: (r[0], r[3], r[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_brute_force(spark, monkeypatch, seed):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["Ünï", "ABC", "K"]
    text = lambda most: " ".join(draw.choices(names, [1 / (i + 1) for i in range(len(names))], k=draw.randrange(most)))
    docs = [(i, text(60)) for i in range(300)] + [(500 + i, "w1 w2 w50 K" + " pad" * (i % 3)) for i in range(40)]
    docs += [(7, docs[7][1]), (900, None), (901, ""), (902, " ,.;"), (None, "w1 w2 w3 w50"), (903, "w5 " * 70_000 + "w60"), (904, "K w1")]
    items = [(i, text(20)) for i in range(25)] + [(3, "w1 w2 K"), (3, "w1 w2 K"), (40, None), (41, ""), (42, "nowhere"), (43, "w0 w1-W2, ünÏ")]
    monkeypatch.setattr(ranked, "LEAVES", 37)
    assert ranks(spark, docs, items) == brute_ranks(docs, items)
    monkeypatch.setattr(ranked, "ITEM_BYTES", 100)
    assert ranks(spark, docs, items) == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    assert ranks(spark, [], [(1, "a")]) == [] and ranks(spark, [(1, "a")], []) == [] and ranks(spark, [(1, None)], [(1, "a")]) == []


def test_the_tree_prunes_and_shares():
    rows = [(np.array([0, 1, 2 + i % 5]), np.array([1 + i % 3, 1, 2]), 100 + i, i) for i in range(2000)]
    tree, best = ranked.Tree(rows, 10), ranked.Best(10)
    looked = tree.search(np.array([1, 4]), np.array([10, 500]), best)
    want = sorted((-int(ranked.gains(c[None], np.array([m]), np.where(p == 1, 10, np.where(p == 4, 500, 0)))[0]), i) for p, c, m, i in rows)[:10]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want  # noqa: B905
    assert looked < 600  # a fifth of the documents has the term of most weight
    same = ranked.Tree([(np.array([3]), np.array([2]), 50, i) for i in range(500, 0, -1)], 10)
    assert same.n_leaves == 1 and same.ids == [list(range(1, 11))]


# License scans.


def scans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as licenses", "1 as score")
    return [r.licenses for r in licenses.scan_licenses(rows).orderBy("doc_id").collect()]


def distance_within(pattern, text):
    """The least edits between the pattern and any part of the text that begins and ends at words."""
    best = len(pattern)
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
    for a in starts:
        row = list(range(len(pattern) + 1))
        for b, c in enumerate(text[a : a + 2 * len(pattern)], a + 1):
            new = [b - a]
            for j, p in enumerate(pattern, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
            row = new
            if b == len(text) or text[b] == " ":
                best = min(best, row[-1])
    return best


def test_edited_notices_are_found_as_brute_force_finds_them():
    draw = random.Random(4)
    plain = [(label, phrase) for label, phrase, *ends in licenses.NOTICES if not ends and "{" not in phrase]
    hit = miss = 0
    for label, phrase in plain:
        known = licenses.Notices(((label, phrase),), {})
        for _ in range(40):
            text = list(phrase)
            for _ in range(draw.randrange(licenses.edits(phrase) + 3)):
                at = draw.randrange(len(text))
                text[at : at + draw.choice([0, 1, 1])] = draw.choice([[], ["x"], [" "], ["e"]])
            words = licenses.joined_words("so it goes " + "".join(text) + " and so on")
            want = distance_within(phrase, words.strip()) <= licenses.edits(phrase)
            spans = known.spans(words)
            assert bool(spans) == want, (phrase, words)
            hit, miss = hit + want, miss + (not want)
            for a, b, _, wrong, _ in spans:
                assert words[a - 1] == words[b] == " " and distance_within(phrase, words[a:b]) <= wrong <= licenses.edits(phrase)
    assert hit > 50 and miss > 50


def brute_base(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_scans_and_their_edges(spark):
    texts = [
        None, "", " \n", "Under the MIT-License! under THE mit license", "CC BY-NC cc by nc sa", "apache license, version 2.0", "apache license version 20", "under the mit licenses",
        "Relased undr the MIT Licence", "under the bit license", "GNU General Public Licence, version 3", "GNU Lesser General Public License version 3", "word " * 200_000 + "cc by nc",
        " under the mit license", "all rights reserved", "the right to be heard is reserved to all", "x_under.the:mit license_", "licensed under the Apache Licence version 2",
    ]
    got = scans(spark, texts)
    for text, r in zip(texts, got):  # noqa: B905
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
        assert {*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))} and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    labels = [r.labels for r in got]
    assert labels[:3] == ["", "", ""] and labels[4] == "cc-by-nc,cc-by-nc-sa" and labels[6:8] == ["", "mit"] and labels[8:12] == ["mit", "", "gpl-3", "lgpl"]
    assert labels[12:16] == ["cc-by-nc", "mit", "all-rights-reserved", ""] and labels[17] == "apache-2"
    assert got[8].score < 1 and got[8].spans[0].edits == 2
    assert scans(spark, []) == []
