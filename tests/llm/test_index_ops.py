"""Operators 2, 9 and 10, and the pipeline, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, hnsw, mil, near_copies, quality, secrets, warc
from lectern.llm.common import words


def read_back(shards, pages):
    return warc.resolved(warc.look_up(shards, pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))))


def test_archive_of_large_null_and_repeated_ids(spark):
    big, other, at = "x" * 2000, "y" * 1500, 2**53
    rows = [(at + 1, "http://a.com/1", big), (at + 3, "http://a.com/2", big), (None, "http://a.com/3", big), (None, "http://a.com/4", other), (None, "http://a.com/5", other)]
    rows += [(5, "http://b.com", "z" * 1200), (5, "http://b.com", "z" * 1200), (5, "http://b.com", big), (7, None, None)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, digest int")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_back(warc.write_archive(pages), pages).collect()]
    want = [(at + 1, 2000, "revisit", at + 3), (at + 3, 2000, "response", None), (None, 2000, "revisit", at + 3), (None, 1500, "response", None), (None, 1500, "response", None)]
    want += [(5, 1200, "response", None)] * 2 + [(5, 2000, "revisit", at + 3), (7, 0, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_records_are_whole_warc_records():
    from types import SimpleNamespace

    page = SimpleNamespace(key="com,a)/ 1", url="http://a.com", html="<b>é", page="1")
    fields, body = warc.parsed(warc.record(page, None))
    assert fields["WARC-Type"] == "response" and body.decode() == "<b>é" and fields["Content-Type"] == "application/http; msgtype=response"
    fields, body = warc.parsed(warc.record(page, ("2", "com,b)/ 2")))
    assert fields["WARC-Type"] == "revisit" and body == b"" and fields["WARC-Refers-To"] == warc.record_id("com,b)/ 2")


def test_archive_round_trip(spark):
    big = "é" * 700
    html = [None, "", "<p>\r\n\r\nx</p>", big, big, "y" * 999, "y" * 999, "z" * 5000, big, "z" * 5000]
    urls = ["http://a.b.com/x?q=1#f", None, "", "https://U@Www.Example.org:80/p q", "http://a.b.com/x?q=1", "ftp://é/ü", "x", "http://a.b.com", "http://b.com/1\n2", "http://a.b.com"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(100 + i, f"http://h{i % 5}.net/{i}", f"<b>{i}") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shards = warc.write_archive(pages)
    got = {r.page_id: r for r in read_back(shards, pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b]
        want = ("revisit", max(same)) if len(b) >= 1000 and i != max(same) else ("response", None)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == want
    missing = spark.createDataFrame([("com,nowhere)/ 0",), ("zzz",), ("",)], "key string")
    assert warc.look_up(shards, missing).count() == 0
    assert warc.write_archive(pages.limit(0)).count() == 0


def test_classifier_learns_and_holds_out(spark):
    rnd = random.Random(6)
    vocab = ["alpha", "beta", "gamma", "delta", "the", "of"]
    text = lambda good: " ".join(rnd.choice(vocab) if good else rnd.choice(["$$$", "###x", "x"]) for _ in range(rnd.choice([10, 200])))
    rows = [(i, text(i % 3 != 0), 1 if i % 3 else 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = mil.scored(docs, mil.fit(docs, labels)).withColumn("held", mil.held_out()).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < 600]
    assert len(held) > 60 and np.mean([(r.score >= 0.3) == (r.doc_id % 3 != 0) for r in held]) > 0.95
    assert mil.fit(docs, labels.limit(0)) is None
    assert {r.score for r in mil.scored(docs, None).collect()} == {0.5}


def test_forward_pass_and_gradient_of_the_classifier():
    rng = np.random.default_rng(1)
    bags = [mil.passages(" ".join(rng.choice(["alpha", "$$$", "the", "of"], n))) for n in (0, 5, 70, 200)]
    y, model = np.array([0.0, 1.0, 1.0, 0.0]), mil.Attention()
    p = model.p

    def slow(bag):
        h = [np.maximum(x @ p["w"] + p["b"], 0) for x in bag.astype(float)]
        e = [sum(p["a"] * np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) for v in h]
        weights = np.exp(np.array(e)) / sum(np.exp(np.array(e)))
        return 1 / (1 + np.exp(-(sum(w * v for w, v in zip(weights, h, strict=True)) @ p["c"] + p["d"][0])))

    p["c"], p["b"] = rng.standard_normal(len(p["c"])), rng.standard_normal(len(p["b"]))  # off the kink at zero
    assert np.allclose(model.score(bags), [slow(b) for b in bags])
    loss = lambda: -np.mean([t * np.log(slow(b)) + (1 - t) * np.log(1 - slow(b)) for b, t in zip(bags, y, strict=True)])
    for name, grad in model.gradient(bags, y).items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in p[name].shape)
            was = p[name][at]
            p[name][at] = was + 1e-5
            up = loss()
            p[name][at] = was - 1e-5
            down = loss()
            p[name][at] = was
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6, name


def test_classifier_takes_a_bounded_part_and_null_ids(spark):
    rows = [(1, "the same id of many rows", 9)] * 400 + [(2, "x " * 30_000, 9), (None, "no id", 9), (4, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    seen = []
    real = mil.Attention.fit
    try:
        mil.Attention.fit = lambda self, bags, y, seed=7: seen.append((len(bags), max(map(len, bags)))) or real(self, bags, y, seed)
        model = mil.fit(docs, labels)
    finally:
        mil.Attention.fit = real
    assert not seen or (seen[0][0] <= 2 and seen[0][1] <= mil.TRAIN_PASSAGES)
    got = mil.scored(docs, model).withColumn("held", mil.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held is not None for r in got)
    assert mil.scored(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("shards", [2, 6])
def test_near_embeddings_equal_all_pairs(spark, shards):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:60] + 0.1 * rng.standard_normal((60, 16)), np.repeat(base[:1], 40, 0) + 0.02 * rng.standard_normal((40, 16)), np.repeat(base[3:4], 30, 0)]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)]
    got = {r.id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shards=shards).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    comp = list(range(len(u)))
    for _ in comp:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(comp))]
    for i in range(len(u)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), comp[i], comp[i] == i)
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(odd)))


def test_recall_on_many_vectors_with_a_dense_group():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((17_000, 24))
    x = np.concatenate([base, base[:1000] + 0.2 * rng.standard_normal((1000, 24)), base[:1] + 0.15 * rng.standard_normal((2000, 24))])
    u = hnsw.unit(x)
    g = hnsw.Graph(u)
    assert [len(near) for near in g.layers] == g.sizes and len(g.sizes) >= 3
    got, scanned = hnsw.audited(g, u[g.order].astype(np.float32), 0.9)
    assert scanned.sum() < 4000  # the dense group alone
    want = list(g.scan(g.x, 0.9))
    links = sum(map(len, want))
    assert links > 1_000_000 and sum(len(set(a) & set(b)) for a, b in zip(got, want, strict=True)) >= 0.999 * links
    walked, _ = g.within(g.x[:500], 0.9, 64)  # the walk alone, without an audit
    assert sum(map(len, walked)) >= 0.9 * sum(map(len, want[:500]))


@pytest.mark.parametrize("n, shards", [(60, 1), (3000, 1), (3000, 3)])
def test_links_come_through_walks_alone(spark, n, shards):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n // 3, 16))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal(base.shape), base + 0.15 * rng.standard_normal(base.shape)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = {r.id: r for r in hnsw.near_duplicates(rows, shards=shards).collect()}
    u = hnsw.unit(x)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[i].n_links for i in range(n)] == links.tolist() and links.sum() > n
    assert {(r.n_walked, r.n_scanned) for r in got.values()} == {(shards, 0)}


def test_links_seen_from_one_side_are_looked_at_again(spark, monkeypatch):
    real = hnsw.audited

    def forgetful(graph, q, least):
        """Leaves out what every third query has found."""
        found, scanned = real(graph, q, least)
        return [near[:0] if k % 3 == 0 else near for k, near in enumerate(found)], scanned

    monkeypatch.setattr(hnsw, "audited", forgetful)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((50, 12))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape)])
    got = hnsw.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = hnsw.unit(x)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    seen = {r.id: r for r in got}
    whole = [i for i in range(100) if seen[i].n_links == links[i]]
    assert sum(r.n_scanned for r in got) > 0 and len(whole) > 60  # only links that both ends forgot are gone


def test_graphs_link_with_few_nodes_looked_at(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 20_000)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 8))
    x = np.concatenate([base + 0.01 * rng.standard_normal(base.shape) for _ in range(4)])
    rows = [(i, v.tolist(), "a", 1.0, 2) for i, v in enumerate(x)] + [(0, x[0].tolist(), "b", 1.0, 2), (None, x[0].tolist(), "b", 1.0, 2)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v double, rep int")
    got = hnsw.near_duplicates(docs).collect()
    assert len(got) == len(rows) and [r.n_links for r in got if r.id is None] == [0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(r.n_links == links[r.id] + (1 if links[r.id] >= 0 and (u[r.id] @ u[0]) >= 0.9 else 0) for r in got if r.id is not None)
    assert hnsw.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 20
    prose = [" ".join(rnd.choice(vocab) for _ in range(120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(100 + i, prose[i].replace(prose[i].split()[60], "edited", 1), "en", "s0", 1) for i in range(10)]
    rows += [(200, None, "en", None, None), (201, "too short", "en", "s1", 9), (202, "$$$ ### " * 40, "en", "s1", 320), (203, prose[0], "de", None, 1)]
    rows += [(300, prose[59] + " password=hunter2hunter2", "en", "s2", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing", "bpe_encoding"]
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200, 201, 202}
    single = corpus_pipeline.dedup_stage(spark, kept, "")
    assert {r.doc_id for r in single.collect()} == set(range(60)) and single.columns == docs.columns
    clean = corpus_pipeline.secrets_stage(spark, kept.filter("doc_id = 300"), "").first()
    assert clean.text.endswith(secrets.MASK) and clean.n_chars == len(clean.text)
    mixture = corpus_pipeline.mixing_stage(spark, single, "")
    assert 60 <= mixture.count() <= 120 and mixture.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in out) > 0
    code = bpe.loaded(bpe.vocabulary())
    assert all(list(r.token_ids) == code.encode(prose[r.doc_id])[0] for r in out)
    assert quality.quality_rules(docs.limit(0)).count() == 0 and near_copies.deduplicated(docs.limit(0)).count() == 0
    assert docs.select(F.size(words(F.col("text")))).first()[0] == 120
