"""Extra columns of every operator's own names, and empty tables."""

from lectern.llm import bpe, mil, mixing, quality, secrets, sharding, token_counts

NAMES = ["_src", "_mix", "_g", "_f", "_first", "_n", "_at", "_part", "_start", "_known", "_words", "_copies", "_copy", "_secrets", "secrets", "n_words", "kept", "row", "k", "s", "z", "size", "g", "src"]


def test_callers_columns_come_back(spark):
    text = "the cat of and in the house sat on a mat and it was that the dog is with her for all of them now"
    rows = [(i, text + f" {i}", "a" if i % 3 else None, *[f"{n}{i}" for n in NAMES]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))
    for stage in (quality.passing, secrets.redact_secrets, lambda d: mixing.mixed(d, weights=(1, 1), share_percent=100)):
        got = stage(docs)
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in rows}
        assert stage(docs.limit(0)).count() == 0
    measured = quality.quality_rules(docs.drop("n_words", "kept"))
    assert {tuple(r)[:-2] for r in measured.select(*docs.drop("n_words", "kept").columns, "n_words", "kept").collect()} == {tuple(v for n, v in zip(docs.columns, r, strict=True) if n not in ("n_words", "kept")) for r in rows}
    sharded = sharding.stratified_shards(docs, 4)
    assert {tuple(r)[: len(rows[0])] for r in sharded.collect()} == {tuple(r) for r in rows} and sharded.columns == [*docs.columns, "shard", "slot"]
    assert sharding.stratified_shards(docs.limit(0), 4).count() == 0
    for made in (bpe.encode_texts(docs), token_counts.token_trees(docs), mil.scored(docs, None)):
        assert made.columns[: len(docs.columns)] == docs.columns and made.count() == len(rows)
        assert [r[3] for r in made.orderBy("doc_id").collect()] == [r[3] for r in rows]
