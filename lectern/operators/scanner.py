"""One scan for all spoken tokens: dates, years, times, measurements and numbers.

Stage by stage each form has its own passes over the text that the stage before left. The scanner finds the
tokens of all stages by one pattern, parts the text once and renders each token by the one form it has. That
is the same wherever tokens don't meddle with each other, and it is checked for every stretch of text:

* a token stands free: after a blank, an opener or the start, before a blank, a closer, a stop or the end;
* it is taken whole: what the first form that fits takes is not given up for less, or for another form;
* all digits are within tokens, and every token that must change does (a rejected date could be part of
  something else, a rejected number stays what it is);
* between two tokens there is a letter, so that no token is another's context; plain numbers may also be
  parted by stops, unless years are spoken, which look for the last word further away.

Stretches for which any of this fails are left to the stages in their order. What a token must not be is
decided by the same functions as there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import fresh
from lectern.functions.regexsub import CLOSERS, OPENERS, PART, STOPS, by_segment, date_boundary, let, like, numeric_boundary, time_boundary
from lectern.operators import dates, numbers, times, units


@dataclass(frozen=True)
class Tokens:
    """What is spoken: a locale or language of each stage that is on, and its settings."""

    dates: str = ""
    formats: tuple[str, ...] = ()
    years: bool = False
    renderer: str | None = None
    year_min: int = 1900
    year_max: int = 2099
    times: str = ""
    clocks: bool = True
    ranges: bool = True
    durations: bool = False
    units: str = ""
    unit_hint: str = ""
    numbers: str = ""
    number_hint: str = ""
    grouped: bool = False


def _class(chars: str) -> str:
    return "".join(f"\\{c}" if c in "[]" else c for c in chars)


#: What may stand before and after a token. A stop or closer must not be followed by a digit.
BEFORE = rf"(?<![^\s{_class(OPENERS)}])"
AFTER = rf"(?![^\s{_class(CLOSERS + STOPS)}]|[{_class(CLOSERS + STOPS)}]\d)"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def token_pattern(s: Tokens) -> str:
    """The tokens of all stages that are on, in the order of the stages; dates with a year before those without."""
    forms = [dates.search_pattern(name) for name in sorted(s.formats, key=lambda name: "no_year" in name)] if s.dates else []
    forms += [p for on, p in ((s.ranges, times.RANGE), *((s.durations, p) for p in times.DURATIONS), (s.clocks, times.CLOCK)) if on and s.times]
    forms += [units.measurement(s.grouped)] if s.units else []
    return rf"(?U){BEFORE}(?>{'|'.join([*forms, numbers.GROUPED if s.grouped else numbers.SIMPLE])}){AFTER}"


def in_order(s: Tokens, speller=None) -> list[tuple[str, Callable[[Column], Column]]]:
    """(name, function of a text) of the stages that are on, in their order."""
    every = [
        ("dates", s.dates, lambda t: dates.speak_dates(t, s.dates, list(s.formats), s.years, s.renderer, s.year_min, s.year_max)),
        ("times", s.times, lambda t: times.speak_times(t, s.times, s.clocks, s.ranges, s.durations)),
        ("units", s.units, lambda t: units.speak_units(t, s.units, s.grouped, s.unit_hint)),
        ("numbers", s.numbers, lambda t: numbers.speak_numbers(t, s.numbers, s.grouped, s.number_hint, speller)),
    ]
    return [(name, stage) for name, on, stage in every if on]


def _date(x: Column, left: Column, right: Column, s: Tokens) -> Column:
    """The words of a date by the first format that takes it."""
    lang, renderer = dates.normalize_locale(s.dates).split("-")[0], s.renderer or dates.default_renderer(s.dates)
    if not s.formats:
        return F.lit(None).cast("string")

    valid = lambda p: F.when(dates.valid_date(p["date"]["day"], p["date"]["month"], p["date"]["year"]), p)

    def parts(found: Column) -> Column:
        read = lambda name: F.struct(dates.ordered(found, name, lang).alias("date"), F.lit(dates.dotted(name)).alias("dotted"))
        # One after the other: formats behind the one that takes it are not looked at.
        return F.coalesce(*(F.when(like(x, f"(?U){whole(dates.search_pattern(name))}"), let(read(name), valid)) for name in s.formats))

    def said(p: Column) -> Column:
        words = dates.spoken_date(p["date"]["day"], p["date"]["month"], p["date"]["year"], s.dates, left, renderer)
        return F.when(p.isNotNull(), F.concat(words, F.when(p["dotted"], dates.kept_dot(right)).otherwise(F.lit(""))))

    return F.when(date_boundary(left, right), let(let(dates.pieces(x), parts), said))


def _time(x: Column, left: Column, right: Column, s: Tokens) -> Column:
    """The words of a range, a duration or a clock time."""
    lang = s.times.split("-")[0].lower()
    said = F.lit(None).cast("string")
    for on, pattern, words in reversed([
        (s.ranges, times.RANGE, times.range_words), *((s.durations, p, lambda t, lang: times.duration_said(t, right, lang)) for p in times.DURATIONS), (s.clocks, times.CLOCK, times.clock_words),
    ]):
        said = F.when(like(x, f"(?U){whole(pattern)}"), words(x, lang)).otherwise(said) if on else said
    return F.when(time_boundary(left, right), said)


def _rendered(x: Column, left: Column, right: Column, s: Tokens, speller) -> Column:
    """A token in words; null if a form that must change is rejected."""
    number = numbers.GROUPED if s.grouped else numbers.SIMPLE

    def spoken(p: Column) -> Column:
        """A number, perhaps with the words of its unit."""
        if not s.numbers:
            return F.concat(p["number"], p["words"])
        free = numeric_boundary(p["number"], left, F.concat(p["words"], right))
        return F.concat(F.coalesce(F.when(free, numbers.number_words(p["number"], s.numbers, s.grouped, s.number_hint, speller)), p["number"]), p["words"])

    plain = F.when(like(x, f"(?U){whole(number)}"), F.struct(x.alias("number"), F.lit("").alias("words")))
    if s.units:
        unit = let(units.measured(x, left, s.units, s.grouped, s.unit_hint), lambda p: F.struct(p["number"].alias("number"), F.concat(F.lit(" "), p["words"]).alias("words")))
        plain = F.when(like(x, r"(?U)[^\d\s.,:]\z"), unit).otherwise(plain)
    said = let(plain, lambda p: F.when(p.isNotNull(), spoken(p)))
    if s.dates and s.years:
        said = F.coalesce(F.when(like(x, r"(?U)\A\d{4}\z"), dates.spoken_year(x, left, right, s.dates, s.year_min, s.year_max)), said)
    if s.times:
        said = F.when(x.contains(":"), _time(x, left, right, s)).otherwise(said)
    return F.coalesce(said, _date(x, left, right, s)) if s.dates else said


def _scanned(text: Column, s: Tokens, speller) -> Column:
    """The text with every token rendered, or null where the stages have to do it."""
    pattern, number = token_pattern(s), f"(?U){whole(numbers.GROUPED if s.grouped else numbers.SIMPLE)}"

    def apart(found: Column, gaps: Column) -> Column:
        """Whether what parts each token from the next keeps them out of each other's context."""
        inner = F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0)))
        if s.dates and s.years:
            return F.forall(inner, lambda g: like(g, r"\p{L}"))
        # Where a letter is missing both neighbours must be plain numbers, and more than blanks between them.
        loose = F.transform(inner, lambda g, i: ~like(g, r"\p{L}") & (like(g, r"(?U)\A\s*\z") | ~like(F.get(found, i), number) | ~like(F.get(found, i + 1), number)))
        return ~F.exists(loose, lambda x: x)

    def joined(found: Column, gaps: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            sides = F.struct(F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right"))
            return let(sides, lambda c: _rendered(x, c["left"], c["right"], s, speller))

        said = F.transform(found, one)
        fits = ~F.exists(gaps, lambda g: like(g, r"(?U)\d")) & apart(found, gaps)
        whole_text = lambda w: F.when(~F.exists(w, lambda x: x.isNull()), F.concat(F.array_join(F.transform(w, lambda x, i: F.concat(F.get(gaps, i), x)), ""), F.element_at(gaps, -1)))
        return F.when(fits, let(said, whole_text))

    # One search gives both: gaps and tokens take turns. Texts that hold the mark themselves are searched twice.
    turns = lambda m: F.flatten(F.transform(F.split(text, pattern, -1), lambda g, i: F.when(i < F.size(m), F.array(g, F.get(m, i))).otherwise(F.array(g))))
    marked = F.split(F.regexp_replace(text, pattern, f"{PART}$0{PART}"), PART, -1)
    pieces = F.when(text.contains(PART), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), turns)).otherwise(marked)
    nth = lambda ps, odd: F.filter(ps, lambda x, i: i % 2 == odd)
    return let(pieces, lambda ps: let(nth(ps, 1), lambda m: let(nth(ps, 0), lambda g: joined(m, g))))


def scanned(text: Column, s: Tokens, speller=None) -> Column:
    """The text with every token rendered by the scanner; null where it is left to the stages."""
    segment = lambda t: F.when(like(t, r"(?U)\d"), _scanned(t, s, speller)).otherwise(t)
    return F.when(like(text, r"(?U)\d"), by_segment(text, segment)).otherwise(text)


def speak_tokens(df: DataFrame, s: Tokens, text: str = "text", speller=None) -> DataFrame:
    """df with the tokens of all stages that are on in words; equal to the stages one after the other.

    The stages are columns of their own, null for the texts that the scanner has done.
    """
    said, rest = fresh(df, "_said", "_rest")
    out = df.withColumn(said, scanned(F.col(text), s, speller)).withColumn(rest, F.when(F.col(said).isNull(), F.col(text)))
    for _, stage in in_order(s, speller):
        # Where nothing is left, a stage's functions are not entered.
        out = out.withColumn(rest, F.when(F.col(rest).isNotNull(), stage(F.col(rest))))
    return out.withColumn(text, F.coalesce(said, rest)).drop(said, rest)
