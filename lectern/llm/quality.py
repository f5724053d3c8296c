"""Operator 1, quality rules: a threshold table compiled into one projection of native expressions.

Edge cases: a null or empty text has no words, so every count is 0 and it fails the base rule; long
texts are read whole; repeated rows are judged one by one; an empty table gives an empty result;
further columns are kept; of clashing names the metrics of ``quality_rules`` win, and ``passing`` hands on
the caller's columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, let, words
from lectern.sources.messages import spread

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an have not "
    "der die das und den von zu mit des im ist ein eine auf nicht "
    "le la les de des et un une en que du est pour dans pas "
    "el los las y por con una del se no su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the metric must lie within [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Bounds are wide enough for ordinary prose; each catches one kind of junk.
RULES = (
    Rule("length", "n_words", least=20),
    Rule("repeats", "repeat_percent", most=30),
    Rule("word_length", "mean_word_chars", least=2, most=12),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.005),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.6),
)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur at least twice among the words."""
    starts = F.when(F.size(found) >= window, F.sequence(F.lit(1), F.size(found) - (window - 1))).otherwise(
        F.array().cast("array<int>")
    )
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, window)))

    def covered(pos: Column) -> Column:
        step = lambda acc, x: F.struct(
            x.alias("prev"), (acc["total"] + F.least(F.lit(window), x - acc["prev"])).alias("total")
        )
        first = F.struct(F.lit(-window).alias("prev"), F.lit(0).alias("total"))
        return F.aggregate(pos, first, step, lambda acc: acc["total"])

    def spread(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda st: F.filter(
                st, lambda x, k: (F.get(st, k - 1)["h"] == x["h"]) | (F.get(st, k + 1)["h"] == x["h"])
            ),
        )
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(spread(hs)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each computed once per row.

    A generator of exactly one row: unlike a projection, the planner never copies its expressions into
    the filters and projections above, where each use would compute them anew.
    """
    one = F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.drop(*columns).select("*", one)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and ratios that the threshold table may name."""
    own_words, own_lines = fresh(docs, "_words", "_lines")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    size = lambda a: F.size(a).cast("long")
    counts = {
        "n_words": size(F.col(own_words)),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_lines": size(F.col(own_lines)),
        "n_dup_lines": size(F.col(own_lines)) - size(F.array_distinct(own_lines)),
        "n_repeat_words": repeated_words(F.col(own_words)).cast("long"),
        "n_stop_words": size(F.filter(own_words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_bullet_lines": size(F.filter(own_lines, lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09]*[-*]\x20")))),
        "n_ellipsis_lines": size(F.filter(own_lines, lambda x: x.endswith("...") | x.endswith("…"))),
    }
    return (
        once(once(docs, {own_words: words(F.col(text)), own_lines: lines}), counts)
        .drop(own_words, own_lines)
        .withColumns(
            {
                "repeat_percent": ratio(100 * F.col("n_repeat_words"), F.col("n_words")),
                "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
                "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
                "stop_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
                "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
                "bullet_line_ratio": ratio(F.col("n_bullet_lines"), F.col("n_lines")),
                "ellipsis_line_ratio": ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
            }
        )
    )


def failures(rules=RULES) -> Column:
    """The threshold table as one expression: the names of the rules that a measured row breaks."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.metric) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.metric) > r.most)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with every metric, ``base_failed``, ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measure(docs, text)
        .withColumns({"base_failed": base, "failed_rules": failures(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def passing(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns, whatever their names."""
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return quality_rules(held, rules).filter("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


#: DuckDB: measured documents; the pipeline's SQL builds on the same text.
MEASURED_SQL = rf"""
src AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
tok AS (SELECT rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM tok)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, i - p)) AS n FROM (SELECT rid, i, lag(i, 1, -8) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
counts AS (SELECT tok.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*]\x20'))) AS n_bullet,
        len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis
        FROM tok LEFT JOIN cov ON tok.rid = cov.rid),
ratios AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 100 * n_repeat_words / n_words ELSE 0 END AS repeat_percent,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END AS bullet_line_ratio,
        CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio FROM counts),
judged AS (SELECT *, concat_ws(',', {", ".join("CASE WHEN " + " OR ".join([f"{r.metric} < {r.least}"] * (r.least is not None) + [f"{r.metric} > {r.most}"] * (r.most is not None)) + f" THEN '{r.name}' END" for r in RULES)}) AS failed_rules FROM ratios)
"""
OP1_SQL = f"WITH {MEASURED_SQL.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AS kept, failed_rules FROM judged"
