"""Audit tables: the date, time, number and measurement tokens of each message, accepted or not.

Each job reads the key and the text only and explodes the matches of a row, so it is one narrow stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.regexsub import let, like, numeric_boundary, numeric_left, regex_find, regex_sub, time_boundary
from lectern.operators import dates, times, units
from lectern.operators.numbers import GROUPED, SIGN, SIMPLE, plain_number


def _tokens(df: DataFrame, key: str, text: Column, pattern: str, gate: str) -> DataFrame:
    found = df.select(F.col(key), F.posexplode(regex_find(text, pattern, gate)).alias("pos", "m"))
    return found.select(key, "pos", F.col("m.token").alias("token"), F.col("m.left").alias("_left"), F.col("m.right").alias("_right"))


def parse_number(token: Column, grouped: bool = False, hint: str = "") -> Column:
    """The value of a numeric token as decimal(15,6), or null."""
    parts = plain_number(token, grouped, hint)
    value = F.concat(F.get(parts, F.lit(0)), F.lit("."), F.coalesce(F.get(parts, F.lit(1)), F.lit("0"))).try_cast("decimal(15,6)")
    return F.when(like(token, rf"\A{SIGN}"), -value).otherwise(value)


def extract_numbers(df: DataFrame, key: str, lang: str, grouped: bool = False, text: str = "text") -> DataFrame:
    """(key, pos, token, kind, reason, value): kind is digits, integer, decimal, grouped or rejected."""
    rows = _tokens(df, key, F.col(text), GROUPED if grouped else SIMPLE, r"(?U)\d")
    parts, free = plain_number(F.col("token"), grouped, lang), numeric_boundary(F.col("token"), F.col("_left"), F.col("_right"))
    reason = F.when(~free, F.lit("boundary")).when(parts.isNull(), F.lit("form"))
    bare = F.regexp_replace("token", rf"\A{SIGN}", "")
    kind = (
        F.when(reason.isNotNull(), F.lit("rejected")).when(like(bare, r"\A0\d+\z"), F.lit("digits"))
        .when(like(bare, r"\A\d+\z"), F.lit("integer")).when(F.length(F.regexp_replace(F.get(parts, F.lit(0)), r"\D", "")) > F.length(F.regexp_extract(bare, r"\A(\d+)", 1)), F.lit("grouped"))
        .otherwise(F.lit("decimal"))
    )
    return rows.select(key, "pos", "token", kind.alias("kind"), reason.alias("reason"), F.when(reason.isNull(), parse_number(F.col("token"), grouped, lang)).alias("value"))


def extract_dates(df: DataFrame, key: str, locale: str, formats: list[str] | None = None, text: str = "text") -> DataFrame:
    """(key, format, pos, token, day, month, year) of the accepted dates, in one scan and one explode.

    pos counts the matches of one format. A format sees what the ones before it left: their dates are
    blanked out by a letter, as words would stand there.
    """
    lang, names = dates.normalize_locale(locale).split("-")[0], list(dates.default_formats(locale) if formats is None else formats)
    kind = "array<struct<format:string,pos:int,token:string,day:int,month:int,year:int>>"

    def after(rest: Column, k: int) -> Column:
        if k == len(names):
            return F.array().cast(kind)
        name = names[k]
        pattern = dates.search_pattern(name)

        def ok(x: Column, left: Column, right: Column) -> Column:
            return let(dates.date_parts(x, name, lang), lambda p: dates.accepted(p, left, right, name))

        def one(m: Column, i: Column) -> Column:
            parts = dates.date_parts(m["token"], name, lang)
            return let(parts, lambda p: F.when(dates.accepted(p, m["left"], m["right"], name), F.struct(F.lit(name).alias("format"), i.alias("pos"), m["token"].alias("token"), p["day"].alias("day"), p["month"].alias("month"), p["year"].alias("year"))))

        found = F.array_compact(F.transform(regex_find(rest, pattern, r"(?U)\d"), one)).cast(kind)
        left = regex_sub(rest, pattern, lambda x, a, b: F.when(ok(x, a, b), F.lit("x")), r"(?U)\d")
        return F.concat(F.when(dates.gate(rest, name), found).otherwise(F.array().cast(kind)), let(F.when(dates.gate(rest, name), left).otherwise(rest), lambda t: after(t, k + 1)))

    return df.filter(like(F.col(text), r"(?U)\d")).select(F.col(key), F.explode(let(F.col(text), lambda t: after(t, 0))).alias("_d")).select(key, "_d.*")


def extract_times(df: DataFrame, key: str, locale: str, text: str = "text") -> DataFrame:
    """(key, pos, token, kind, accepted): kind is range, duration or clock."""
    lang = locale.split("-")[0].lower()
    rows = _tokens(df, key, F.col(text), rf"{times.RANGE}|\d+:\d{{2}}:\d{{2}}|\d+:\d{{2}}\s*[hH](?![A-Za-z_])|{times.CLOCK}", r"(?U)\d:\d{2}")
    kind = F.when(like(F.col("token"), rf"\A(?:{times.RANGE})\z"), F.lit("range")).when(like(F.col("token"), r"\A\d+:\d{2}(?::\d{2}|\s*[hH])\z"), F.lit("duration")).otherwise(F.lit("clock"))
    token, left, right = F.col("token"), F.col("_left"), F.col("_right")
    said = F.when(kind == "range", times.range_words(token, lang)).when(kind == "duration", times.duration_said(token, right, lang)).otherwise(times.clock_words(token, lang))
    ok = time_boundary(left, right) & said.isNotNull()
    return rows.select(key, "pos", "token", kind.alias("kind"), ok.alias("accepted"))


def extract_measurements(df: DataFrame, key: str, locale: str, grouped: bool = False, text: str = "text") -> DataFrame:
    """(key, pos, token, unit, value) of every number with a unit that stands free on its left."""
    number = GROUPED if grouped else SIMPLE
    ordered = sorted(units.ALIASES, key=lambda a: -len(a))
    alias = "|".join(re.escape(a) if a in units.EXACT else f"(?iu:{re.escape(a)})" for a in ordered)
    rows = _tokens(df, key, F.col(text), rf"{number}\s*(?:{alias})(?![\w/])", r"(?U)\d")
    name, unit = F.regexp_extract("token", rf"(?U)({alias})\z", 1), F.lit(None).cast("string")
    for a in reversed(ordered):
        unit = F.when(name == a if a in units.EXACT else F.lower(name) == a.lower(), F.lit(units.ALIASES[a])).otherwise(unit)
    value = parse_number(F.regexp_extract("token", rf"(?U)\A({number})", 1), grouped, locale)
    free = numeric_left(F.col("_left")) & units.stands_whole(F.regexp_extract("token", rf"(?U)\A({number})", 1), F.col("_left"), grouped)
    return rows.filter(free & value.isNotNull()).select(key, "pos", "token", unit.alias("unit"), value.alias("value"))


def neighbours(tokens: DataFrame, key: str) -> DataFrame:
    """tokens with the previous and next token of the same message."""
    w = Window.partitionBy(key).orderBy("pos")
    return tokens.withColumns({"previous": F.lag("token").over(w), "next": F.lead("token").over(w)})


def left_alone(tokens: DataFrame, k: int) -> DataFrame:
    """The k tokens most often rejected, with their counts: what still needs a rule."""
    return tokens.filter("kind = 'rejected'").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def token_rollup(df: DataFrame, lang: str, by: list[str], text: str = "text") -> DataFrame:
    """(by, kind, n, n_distinct): numeric tokens by kind under each of the columns, with subtotals."""
    tokens = extract_numbers(df.select(F.struct(*by).alias("_by"), text), "_by", lang, text=text)
    return tokens.select("_by.*", "kind", "token").rollup(*by, "kind").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))
