"""Replacement rules, control tags and line joining."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.regexsub import TAG, by_segment, sealed, unsealed


@dataclass(frozen=True)
class Rule:
    find: str
    replace: str
    mode: str = "literal"
    ignore_case: bool = False
    enabled: bool = True
    name: str = ""


def load_rules(rows: list[dict]) -> list[Rule]:
    """Validated rules in order; errors name the 1-based place of the bad rule."""
    out = []
    for k, row in enumerate(rows, 1):
        if not isinstance(row, dict):
            raise ValueError(f"rule {k}: must be a mapping")
        rule = Rule(str(row.get("find", "")), str(row.get("replace", "")), row.get("mode", "literal"), not row.get("case_sensitive", not row.get("ignore_case", True)), not row.get("disabled", not row.get("enabled", True)), str(row.get("name", "")))
        if rule.mode not in ("literal", "regex") or not rule.find:
            raise ValueError(f"rule {k}: needs a known mode and something to find")
        if rule.mode == "regex":
            if (wrong := pattern_error(rule.find)) is not None:
                raise ValueError(f"rule {k}: {wrong}")
        out.append(rule)
    return out


@lru_cache(1 << 14)
def pattern_error(find: str) -> str | None:
    """Why a regular expression does not compile, else null."""
    try:
        re.compile(find)
    except (re.error, OverflowError, RecursionError) as e:
        return str(e)
    return None


def rule_errors(rules: Column) -> Column:
    """For each rule of an array of (mode, find) what is wrong with it, else null; a worker compiles a pattern once."""
    kinds = {"literal": lambda find: None, "regex": pattern_error}

    @F.pandas_udf("array<string>")
    def wrong(rows: pd.Series) -> pd.Series:
        said = lambda r: "unknown mode" if r["mode"] not in kinds else "nothing to find" if not r["find"] else kinds[r["mode"]](r["find"])
        return pd.Series([None if row is None else [said(r) for r in row] for row in rows])

    return wrong(rules)


@lru_cache(1 << 14)
def java_compiles(pattern: str) -> bool:
    """Whether Java's engine takes a pattern; asked of the running session's JVM, taken as true where there is none."""
    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def java_pattern(rule: Rule) -> str:
    find = re.sub(r"\(\?P<", "(?<", rule.find) if rule.mode == "regex" else r"\Q" + rule.find.replace(r"\E", r"\E\\E\Q") + r"\E"
    return ("(?iuU)" if rule.ignore_case else "(?U)") + find


def python_only(rule: Rule) -> bool:
    """Whether a rule says what Java's expressions cannot say, or say otherwise.

    Those are conditionals, back references and groups named with underscores, ASCII and locale flags,
    brackets or && within a class, ten groups or more, and other escapes than groups in the replacement.
    """
    if rule.mode == "literal":
        return False
    find = re.sub(r"\\[^AZz]", "e", rule.find)
    inner = [c[1:-1].removeprefix("^") for c in re.findall(r"\[\^?\]?[^\]]*\]", find)]
    return bool(
        re.search(r"\(\?\(|\(\?P=|\(\?P<[^>]*_|\(\?[a-z]*[auL]|\\Z", find)
        or any("[" in c or "&&" in c or c.startswith("]") for c in inner)
        or re.compile(rule.find).groups > 9
        or re.search(r"\\(?!\d|g<)", rule.replace)
        or re.search(r"\{,\d", find)  # from nothing on, to Python alone
        or not java_compiles(java_pattern(rule))
    )


def by_python(text: Column, rule: Rule, count: bool = False) -> Column:
    """The rule applied by Python to every stretch between control tags, or its matches counted."""
    flags = re.IGNORECASE if rule.ignore_case else 0

    def parts(t: str) -> list[str]:
        """Stretches of text, with tags at odd places; openers behind the last closer begin none."""
        end = max(t.rfind(">"), t.rfind("]")) + 1
        found = re.split(f"({TAG})", t[:end])
        return [*found[:-1], found[-1] + t[end:]]

    @F.pandas_udf("long" if count else "string")
    def changed(texts: pd.Series) -> pd.Series:
        pattern = re.compile(rule.find, flags)
        if count:
            return texts.map(lambda t: 0 if t is None else sum(1 for x in parts(t)[::2] for _ in pattern.finditer(x)))
        return texts.map(lambda t: None if t is None else "".join(x if k % 2 else pattern.sub(rule.replace, x) for k, x in enumerate(parts(t))))

    return changed(text)


def java_replacement(rule: Rule) -> str:
    if rule.mode == "literal":
        return rule.replace.replace("\\", r"\\").replace("$", r"\$")
    text = rule.replace.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", re.sub(r"\\(\d)", r"$\1", text))


def apply_rule(text: Column, rule: Rule) -> Column:
    if python_only(rule):
        return by_python(text, rule)
    if rule.mode == "literal" and not rule.ignore_case:
        return by_segment(text, lambda t: F.replace(t, F.lit(rule.find), F.lit(rule.replace)))
    return by_segment(text, lambda t: F.regexp_replace(t, java_pattern(rule), java_replacement(rule)))


def count_hits(text: Column, rule: Rule) -> Column:
    """The matches of a rule in the stretches between control tags."""
    if python_only(rule):
        return by_python(text, rule, count=True)
    found = F.transform(unsealed(text, F.split(sealed(text), f"(?:{TAG})", -1)), lambda t: F.regexp_count(t, F.lit(java_pattern(rule))))
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, k: n + k)


def apply_rules(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """df with the rules applied in order, each to what the one before returned."""
    for rule in rules:
        if rule.enabled:
            df = df.withColumn(text, apply_rule(F.col(text), rule))
    return df


def rule_hits(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(rule_no, hits): the matches of each rule in the text that it sees."""
    hits = []
    for k, rule in enumerate(rules, 1):
        if rule.enabled:
            df = df.withColumn(f"_hits{k}", count_hits(F.col(text), rule)).withColumn(text, apply_rule(F.col(text), rule))
            hits.append(k)
    sums = df.agg(*(F.coalesce(F.sum(f"_hits{k}"), F.lit(0)).alias(f"_hits{k}") for k in hits))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule_no"), F.col(f"_hits{k}").alias("hits")) for k in hits))).alias("r")).select("r.*")


def extract_tags(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, tag) of every control tag."""
    return df.select(key, F.posexplode(F.regexp_extract_all(sealed(F.col(text)), F.lit(f"(?:{TAG})"), F.lit(0))).alias("pos", "tag"))


def join_lines(text: Column) -> Column:
    """Each run of line breaks with the blanks around it as one space; tags stay."""
    # A match can begin only where a run of blanks and line breaks does, so long runs are read once.
    broken = r"(?<![ \t\r\n])[ \t]*+[\r\n][ \t\r\n]*+"
    return by_segment(text, lambda t: F.regexp_replace(t, broken, " "))
