"""Operators 1, 3 and 8 against brute force and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lectern.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def check_quality(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_rules(rows).collect():
        t = texts[r.doc_id] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(w)
        assert r.base_failed == (len(w) < 20 or 100 * brute_repeats(w) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_edge_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    check_quality(spark, [None, "", " \t\n", "a", "é b c", "the a " * 60, "x\nx\n\nx\ny", long, "*** $$$ " * 30, "a b c d e f g h " * 3])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n#é\x0b", max_size=200), min_size=1, max_size=20))
def test_quality_random(spark, texts):
    check_quality(spark, texts)


def test_quality_keeps_other_columns_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert quality.quality_rules(empty).count() == 0


def test_sharding_law(spark):
    rows = [(i, None if i == 3 else "x" * (i % 7), "en", None if i % 10 == 0 else f"s{i % 3 if i % 2 else 0}", 0) for i in range(203)]
    rows += [rows[5], rows[5]]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "source", F.crc32(F.coalesce("text", F.lit(""))).alias("c"))
    got = sharding.stratified_shards(docs, 8).collect()
    assert len(got) == 205
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    whole = Counter(r.source for r in got)
    for s in sizes:
        part = Counter(r.source for r in got if r.shard == s)
        for src, n in whole.items():
            assert abs(part[src] - n * sizes[s] / len(got)) <= 2
    assert zlib.crc32(b"x") == next(r.c for r in got if r.doc_id == 1)


def test_sharding_of_nothing(spark):
    assert sharding.stratified_shards(spark.createDataFrame([], "doc_id long, source string"), 8).count() == 0


def brute_targets(totals, weights=(5, 2, 1)):
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    weight, budget, out = {s: weights[i % 3] for i, s in enumerate(names)}, 1.5 * sum(totals.values()), {}
    while True:
        live = [s for s in names if s not in out]
        share = {s: (budget - sum(out.values())) * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 2 * totals[s]]
        if not over:
            return out | share
        out |= {s: 2.0 * totals[s] for s in over}


def test_mixing_meets_targets(spark):
    rows = [(i, None if i % 50 == 0 else f"s{min(i % 17, 6)}", (i * 7919) % 400) for i in range(4000)]
    rows += [(9000 + i, "hot", 25) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    totals = defaultdict(int)
    for _, s, n in rows:
        totals[s] += n
    targets, taken = brute_targets(totals), defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == totals[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        taken[r.source] += r.copies * r.size
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 400 + 1e-3 * t, (s, taken[s], t)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mixing_of_nothing_and_of_empty_texts(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, 0), (2, "a", 0), (3, "a", 10)], schema)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}
