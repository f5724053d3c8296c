"""Times: clock times, ranges and durations to words (German and English)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.regexsub import bound, by_segment, let, like, regex_sub, time_boundary
from lectern.functions.words import DE_100, EN_100, de_cardinal, en_cardinal, pick

SUFFIX = r"(?i:uhr|a\.m\.|p\.m\.|am|pm)"
CLOCK = rf"\d{{1,2}}:\d{{2}}(?:\s*{SUFFIX})?"
RANGE = rf"{CLOCK}\s*(?:-|–|—|(?i:bis|to))\s*{CLOCK}"
DURATIONS = (r"\d+:\d{2}:\d{2}", r"\d+:\d{2}\s*[hH](?![A-Za-z_])")


def clock_words(token: Column, lang: str) -> Column:
    """The words of one clock time, or null where it is invalid in the language."""
    read = F.struct(
        F.regexp_extract(token, r"(\d+):", 1).try_cast("int").alias("hour"), F.regexp_extract(token, r":(\d+)", 1).try_cast("int").alias("minute"),
        F.translate(F.lower(F.regexp_extract(token, rf"\d\s*({SUFFIX})\z", 1)), ".", "").alias("suffix"),
    )
    return let(read, lambda t: _clock_said(t["hour"], t["minute"], t["suffix"], lang))


def _clock_said(hour: Column, minute: Column, suffix: Column, lang: str) -> Column:
    ok = minute <= 59
    if lang == "de":
        ok = ok & (hour <= 23) & like(suffix, r"\A(?:uhr)?\z")
        return F.when(ok, F.concat_ws(" ", F.when(hour == 1, F.lit("ein")).otherwise(pick(DE_100, hour)), F.lit("Uhr"), F.when(minute > 0, pick(DE_100, minute))))
    half = like(suffix, r"\A[ap]m\z")
    ok = ok & (suffix != "uhr") & F.when(half, hour.between(1, 12)).otherwise(hour <= 23)
    return F.when(ok, F.concat_ws(" ", pick(EN_100, hour), F.when(minute.between(1, 9), F.lit("oh")), F.when(minute > 0, pick(EN_100, minute)), F.when(half, F.upper(suffix))))


def duration_words(hours: Column, minutes: Column, seconds: Column, lang: str) -> Column:
    de, count = lang == "de", de_cardinal if lang == "de" else en_cardinal
    names = (("Stunde", "Stunden"), ("Minute", "Minuten"), ("Sekunde", "Sekunden")) if de else (("hour", "hours"), ("minute", "minutes"), ("second", "seconds"))
    one = "eine" if de else "one"
    parts = [
        F.when(v == 1, F.lit(f"{one} {s}")).when(v > 1, F.concat(count(v), F.lit(f" {p}")))
        for v, (s, p) in zip((hours, minutes, seconds), names, strict=True)
    ]
    said = F.concat_ws(" ", *parts)
    return F.when((minutes <= 59) & (seconds <= 59), F.when(said == "", F.lit("null Sekunden" if de else "zero seconds")).otherwise(said))


def range_words(token: Column, lang: str) -> Column:
    """The words of a clock range, or null where an end or the word between them is not of the language."""
    word, other = ("bis", "to") if lang == "de" else ("to", "bis")
    head, tail = F.regexp_extract(token, rf"\A({CLOCK})", 1), F.regexp_extract(token, rf"(?:-|–|—|(?i:bis|to))\s*({CLOCK})\z", 1)
    foreign = like(token, rf"(?i)(?<![a-z]){other}(?![a-z])")
    return F.when(~foreign, F.concat(clock_words(head, lang), F.lit(f" {word} "), clock_words(tail, lang)))


def duration_said(token: Column, right: Column, lang: str) -> Column:
    """The words of H:MM:SS or H:MMh, or null; a mark of clock times behind the seconds makes it none."""

    def said(p: Column) -> Column:
        h, m, s = (F.get(p, F.lit(k)).try_cast("int") for k in range(3))
        marked = s.isNotNull() & like(right, rf"(?U)\A\s*+{SUFFIX}(?=\z|[\s,.;:!?)\]}}])")
        return F.when(~marked, duration_words(h, m, F.coalesce(s, F.lit(0)), lang))

    return let(F.split(F.regexp_replace(token, r"(?U)\s*[hH]\z", ""), ":"), said)


@bound
def speak_times(text: Column, locale: str, clocks: bool = True, ranges: bool = True, durations: bool = False) -> Column:
    """text with ranges, then durations, then clock times in words."""
    lang = locale.split("-")[0].lower()

    def free(words):
        return lambda x, left, right: F.when(time_boundary(left, right), words(x, right))

    passes = [(ranges, RANGE, free(lambda x, right: range_words(x, lang)))]
    passes += [(durations, p, free(lambda x, right: duration_said(x, right, lang))) for p in DURATIONS]
    passes += [(clocks, CLOCK, free(lambda x, right: clock_words(x, lang)))]

    def one_pass(pattern: str, render):
        return lambda t: regex_sub(t, pattern, render, tags=False)

    def every(t: Column) -> Column:
        for on, pattern, render in passes:
            if on:
                t = let(t, one_pass(pattern, render))
        return t

    return F.when(text.contains(":") & like(text, r"(?U)\d:\d{2}"), by_segment(text, every)).otherwise(text)
