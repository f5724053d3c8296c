"""Operator 8, mixing sources to target weights by entropy balancing.

Document i of source s gets the rate w_i = min(cap, exp(lambda_s * z_i)), z_i being its size over the
mean size of its source: of all rates whose words add up to the source's target these stray least, in
relative entropy, from taking each document once. lambda_s solves the convex dual's stationarity
condition; Newton steps do that, each one an aggregation over the (source, size) counts, kept between
brackets. Rates are then rounded into copies by systematic rounding along the sizes of a source, which
keeps the words taken within about one longest document of the target.

Sums are decimals of fixed scale, so reruns agree to the last copy. Edge cases: a null source is a
source of its own and ranks last; null texts have size 0 and take nothing; a source at its stop takes
every document ``cap`` times; an empty table gives an empty result; equal ids are taken alike; ties of
size go by a seeded hash of the id; ``mixed`` keeps further columns, whatever their names, ``mix`` leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, global_rank, small, source_key, words, written

SCALE = 1 << 26
STEPS = 60


def water_filled(totals: DataFrame, weights=(5, 2, 1), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(src, total) with ``target``: the share dealt by weight, stopped at cap times a source's size.

    totals has one row for each source. What the stopped sources leave is dealt again among the rest;
    in the end the stopped ones are those of least size to weight, so one pass in that order finds them.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("src") == "n", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("stop", F.col("total") * cap)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    stopped = ranked.withColumn("budget", F.sum("total").over(every) * share_percent / 100).withColumn("level", level)
    # The level rises as long as the source before was stopped, and falls from there: its top is the line.
    line = F.max("level").over(every)
    return stopped.withColumn("target", F.least(F.col("stop").cast("double"), line * F.col("weight"))).select(
        "src", "total", "target"
    )


def rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    """A document's rate in units of 1 / SCALE, so that sums of rates are sums of whole numbers."""
    exact = F.least(F.exp(F.least(lam * size / mean, F.lit(20.0))), F.lit(float(cap)))
    return F.when(lam.isNull(), F.lit(cap * SCALE)).otherwise(F.round(exact * SCALE)).cast("long")


def balanced(counts: DataFrame, targets: DataFrame, cap: int = 2, tolerance: float = 1e-5) -> DataFrame:
    """(src, size, m) counts and targets to (src, mean, lam); lam is null where the cap itself is the answer."""
    shape = counts.filter("size > 0").groupBy("src").agg(
        (F.sum(F.col("size") * F.col("m")) / F.sum("m")).alias("mean"), F.min("size").alias("least")
    )
    start = F.log(F.col("target") / F.col("total"))
    edge = start * F.col("mean") / F.col("least")
    free = (F.col("target") < cap * F.col("total") * (1 - 1e-9)) & (F.col("target") > 0)
    state = written(
        targets.join(shape, "src").withColumns(
            {"lam": F.when(free, start), "lo": F.least(edge, F.lit(0.0)), "hi": F.greatest(edge, F.lit(0.0)), "off": F.lit(1.0)}
        )
    )
    for _ in range(STEPS):
        w = rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        mass = F.col("size").cast("decimal(38,0)") * F.col("m")
        slope = F.when(w < cap * SCALE, w * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = counts.join(state, "src").groupBy("src").agg(
            F.sum((mass * w).cast("decimal(38,0)")).alias("got"),
            F.sum((F.col("size") * F.col("m") * slope).cast("decimal(38,3)")).alias("slope"),
        )
        gap = F.col("got").cast("double") / SCALE - F.col("target")
        step = F.col("lam") - gap * SCALE / F.col("slope").cast("double")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        moved = F.when(inside, step).otherwise((lo + hi) / 2)
        state = written(
            state.join(sums, "src", "left").select(
                "src", "total", "target", "mean", "least",
                F.when(F.col("lam").isNotNull(), F.when(F.abs(gap) > tolerance * F.col("target"), moved).otherwise(F.col("lam"))).alias("lam"),
                lo.alias("lo"), hi.alias("hi"),
                F.when(F.col("lam").isNotNull(), F.abs(gap) / F.col("target")).otherwise(F.lit(0.0)).alias("off"),
            )
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state


def mix(docs: DataFrame, weights=(5, 2, 1), share_percent: int = 150, cap: int = 2, key: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """(key, source, size) of docs with ``source_size``, ``target``, ``rate`` and ``copies``."""
    narrow = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), source_key(F.col(source)).alias("src"), F.col(size).alias("z"))
    rows = global_rank(narrow.withColumn("draw", F.xxhash64(F.col("k").cast("string"), F.lit("mix"))), ["src", F.col("z").desc(), "draw", "k"], "g")
    counts = written(
        rows.groupBy("src", F.col("z").alias("size")).agg(F.count("*").alias("m"), F.min("g").alias("first"))
    )
    totals = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("m")).alias("total"))
    targets = written(water_filled(totals, weights, share_percent, cap))
    solved = balanced(counts, targets, cap)
    rated = counts.join(targets, "src").join(solved.select("src", "lam", "mean"), "src", "left")
    w = F.when(F.col("mean").isNull() | (F.col("size") == 0), F.lit(SCALE)).when(F.col("target") <= 0, F.lit(0)).otherwise(
        rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
    )
    # Sizes of a source in falling order: what its rates add up to before each size.
    before = Window.partitionBy("src").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    groups = written(
        rated.withColumn("w", w.cast("long"))
        .withColumn("base", F.coalesce(F.sum(F.col("w") * F.col("m")).over(before), F.lit(0)))
        .select("src", F.col("size").alias("z"), "first", "w", "base", F.col("total").alias("source_size"), "target")
    )
    # Sizes of a source are few; where they are not, both sides are written tables and a hot size is split.
    placed = rows.join(small(groups), ["src", "z"])
    upto = lambda r: F.floor((F.col("base") + r * F.col("w") + SCALE // 2) / F.lit(SCALE))
    r = F.col("g") - F.col("first")
    return placed.select(
        F.col("k").alias(key), F.col("s").alias(source), F.col("z").alias(size), "source_size", "target",
        (upto(r + 1) - upto(r)).cast("long").alias("copies"), (F.col("w") / F.lit(SCALE)).alias("rate"),
    )


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows with a null key are taken once.

    The decisions, narrow rows, are found first; then the texts are shuffled once, at every size alike.
    """
    known, size, copies, copy = fresh(docs, "_known", "_words", "_copies", "_copy")
    sized = docs.filter(F.col(key).isNotNull()).select(key, source, F.size(words(F.col(text))).cast("long").alias(size))
    chosen = mix(sized, key=key, source=source, size=size, **options).groupBy(F.col(key).alias(known)).agg(F.max("copies").cast("int").alias(copies))
    taken = docs.join(written(chosen).hint("shuffle_hash"), F.col(key) == F.col(known), "left")
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(1)))).alias(copy)).drop(copy)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )
