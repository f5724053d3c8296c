"""The whole normalisation: rules, markdown, line joining, emoji, dates, times, units, numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import fresh
from lectern.operators import dates, emoji, markdown, numbers, rules, scanner, times, units


@dataclass(frozen=True)
class Profile:
    """What is done for one output language; every stage is off unless set, and speaks ``locale`` unless it has its own."""

    locale: str = "en-US"
    rules: tuple = ()
    markdown: bool = False
    lines: bool = False
    emoji: str | None = None  # "remove" or "spell_out"
    dates: bool = False
    years: bool = False
    times: bool = False
    durations: bool = False
    units: bool = False
    numbers: bool = False
    grouped: bool = False
    formats: tuple[str, ...] | None = field(default=None)
    markdown_skip: tuple[str, ...] = ()  # names of Markdown steps left out
    remove_code: bool = False
    remove_urls: bool = False
    emoji_language: str = ""
    date_locale: str = ""
    date_renderer: str | None = None
    year_min: int = 1900
    year_max: int = 2099
    time_locale: str = ""
    clocks: bool = True
    ranges: bool = True
    unit_locale: str = ""
    number_language: str = ""


def language(locale: str) -> str:
    return dates.normalize_locale(locale).split("-")[0]


def stages(p: Profile, speller=None, emoji_table: dict[str, str] | None = None) -> list[tuple[str, tuple, Callable[[Column], Column]]]:
    """(name, settings, function of a text) of each stage that is on, in the fixed order.

    Equal settings mean equal functions, so that profiles can share a stage. speller and emoji_table
    replace the words of numbers and add names of emoji.
    """
    number = p.number_language or p.locale
    hint = p.number_language or p.unit_locale or p.locale
    date, time, unit = p.date_locale or p.locale, p.time_locale or p.locale, p.unit_locale or p.locale
    said = p.emoji_language or emoji.default_language(p.locale)
    formats = tuple(p.formats) if p.formats is not None else tuple(dates.default_formats(date))
    every = [
        *((True, f"rule{k}", (r,), lambda t, r=r: rules.apply_rule(t, r)) for k, r in enumerate(p.rules) if r.enabled),
        (p.markdown, "markdown", (p.markdown_skip, p.remove_code, p.remove_urls), lambda t: markdown.clean_markdown(t, p.markdown_skip, p.remove_code, p.remove_urls)),
        (p.lines, "lines", (), rules.join_lines),
        (p.emoji == "remove", "emoji", ("remove",), emoji.remove_emoji),
        (p.emoji == "spell_out", "emoji", (said,), lambda t: emoji.spell_emoji(t, said, emoji_table)),
        (p.dates, "dates", (date, formats, p.years, p.date_renderer, p.year_min, p.year_max), lambda t: dates.speak_dates(t, date, list(formats), p.years, p.date_renderer, p.year_min, p.year_max)),
        (p.times, "times", (time, p.clocks, p.ranges, p.durations), lambda t: times.speak_times(t, time, p.clocks, p.ranges, p.durations)),
        (p.units, "units", (unit, p.grouped, hint), lambda t: units.speak_units(t, unit, p.grouped, hint)),
        (p.numbers, "numbers", (language(number), p.grouped, number), lambda t: numbers.speak_numbers(t, language(number), p.grouped, number, speller)),
    ]
    return [(name, settings, f) for on, name, settings, f in every if on]


def tokens(p: Profile) -> scanner.Tokens:
    """What a profile has the scanner speak."""
    number = p.number_language or p.locale
    date = p.date_locale or p.locale
    return scanner.Tokens(
        dates=date if p.dates else "", formats=tuple(p.formats) if p.formats is not None else tuple(dates.default_formats(date)),
        years=p.years, renderer=p.date_renderer, year_min=p.year_min, year_max=p.year_max,
        times=(p.time_locale or p.locale) if p.times else "", clocks=p.clocks, ranges=p.ranges, durations=p.durations,
        units=(p.unit_locale or p.locale) if p.units else "", unit_hint=p.number_language or p.unit_locale or p.locale,
        numbers=language(number) if p.numbers else "", number_hint=number, grouped=p.grouped,
    )


#: The stages that speak tokens, which the scanner does in one go.
SPOKEN = ("dates", "times", "units", "numbers")


def normalize(df: DataFrame, p: Profile, text: str = "text", speller=None, emoji_table: dict[str, str] | None = None) -> DataFrame:
    """df with its text normalised, stage by stage, those that speak tokens as one scan; narrow projections only."""
    every = stages(p, speller, emoji_table)
    for name, _, stage in every:
        if name not in SPOKEN:
            df = df.withColumn(text, stage(F.col(text)))
    # A single stage of one pass has nothing to gain.
    spoken = [stage for name, _, stage in every if name in SPOKEN]
    if len(spoken) > 1 or p.dates:
        return scanner.speak_tokens(df, tokens(p), text, speller)
    for stage in spoken:
        df = df.withColumn(text, stage(F.col(text)))
    return df


def change_rates(df: DataFrame, p: Profile, by: str, text: str = "text") -> DataFrame:
    """(by, stage, n, changed): how many texts each stage of a profile alters, in one scan."""
    names, flags, before = [], [], text
    for name, _, stage in stages(p):
        after, flag = fresh(df, "_after", "_changed")
        df = df.withColumn(after, stage(F.col(before))).withColumn(flag, (~F.col(after).eqNullSafe(F.col(before))).cast("long"))
        names.append(name)
        flags.append(flag)
        before = after
    sums = df.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(f).alias(f) for f in flags))
    each = F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f).alias("changed")) for n, f in zip(names, flags, strict=True)))
    return sums.select(by, "n", F.inline(each)).select(by, "stage", "n", "changed")


def normalize_distinct(df: DataFrame, p: Profile, text: str = "text") -> DataFrame:
    """Like normalize, with each distinct text worked on once and joined back by its 128-bit hash and itself."""
    key, at, own, said = fresh(df, "_text_key", "_text_at", "_text_own", "_text_said")
    hashed = df.withColumn(key, F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))))
    # By hash the copies of a text meet before its stages run; texts that share a hash stay apart.
    once = hashed.filter(F.col(key).isNotNull()).groupBy(key, F.col(text).alias(own)).count().select(key, own, F.col(own).alias(said))
    done = normalize(once, p, said).withColumnRenamed(key, at)
    return hashed.join(done, (F.col(key) == F.col(at)) & (F.col(text) == F.col(own)), "left").withColumn(text, F.col(said)).drop(key, at, own, said)
