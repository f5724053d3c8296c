"""Dates: written dates to spoken ones, by input format and locale."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.regexsub import DASHES, bound, by_segment, date_boundary, first, last, let, like, numeric_left, regex_sub
from lectern.functions.words import DE_DAYS, DE_MONTHS, EN_DAYS, EN_MONTHS, listed, pick, small_words, year_words
from lectern.operators import units

YEAR, DAY, MONTH = r"(?:19|20)\d{2}", r"(?:[12]\d|3[01]|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
NAMES = "|".join(sorted({*DE_MONTHS, *EN_MONTHS, "Maerz"}, key=lambda s: (-len(s), s)))
#: Languages with words of their own for days and months.
CURATED = ("de", "en")
#: Format -> (pattern, order of its parts), as the formats' names say.
FORMATS = {
    "ymd_dash": (rf"({YEAR})-({MONTH})-({DAY})", "ymd"),
    "dmy_dot": (rf"({DAY})\.({MONTH})\.({YEAR})", "dmy"),
    "dmy_dot_spaced": (rf"({DAY})\.\s+({MONTH})\.\s*({YEAR})", "dmy"),
    "dmy_dot_no_year": (rf"({DAY})\.({MONTH})\.", "dm"),
    "dmy_dot_spaced_no_year": (rf"({DAY})\.\s+({MONTH})\.", "dm"),
    "dmy_slash": (rf"({DAY})/({MONTH})/({YEAR})", "dmy"),
    "mdy_slash": (rf"({MONTH})/({DAY})/({YEAR})", "mdy"),
    "dmy_slash_no_year": (rf"({DAY})/({MONTH})", "dm"),
    "mdy_slash_no_year": (rf"({MONTH})/({DAY})", "md"),
    "dmy_month_name": (rf"(?i)({DAY})\.?\s+({NAMES})(?:\s+({YEAR}))?", "dny"),
    "mdy_month_name": (rf"(?i)({NAMES})\s+({DAY})(?:,?\s+({YEAR}))?", "ndy"),
}
DMY_REGIONS = {"GB", "AU", "IE", "NZ", "ZA"}
#: Words before a German date that choose its ordinal's ending; other words give -er.
ENDINGS = {
    "e": "der dieser jener welcher".split(),
    "en": "am bis dem den des diesem diesen jenem jenen vom welchem welchen zum".split(),
    "em": "ab nach seit von vor".split(),
}


#: The formats tried for a locale unless others are given, in order.
DEFAULT_FORMATS = {
    "de": "dmy_dot dmy_dot_spaced dmy_dot_no_year dmy_month_name ymd_dash".split(),
    "en-GB": "dmy_slash dmy_slash_no_year dmy_month_name ymd_dash".split(),
    "en-CA": "ymd_dash mdy_month_name".split(),
    "en": "mdy_slash mdy_slash_no_year mdy_month_name ymd_dash".split(),
}


def default_renderer(locale: str) -> str:
    return "curated" if normalize_locale(locale).split("-")[0] in CURATED else "numeric_fallback"


def default_formats(locale: str) -> list[str]:
    lang, _, region = normalize_locale(locale).partition("-")
    if lang == "en" and region in DMY_REGIONS:
        region = "GB"
    return DEFAULT_FORMATS.get(f"{lang}-{region}", DEFAULT_FORMATS.get(lang, ["ymd_dash"]))


def normalize_locale(locale: str) -> str:
    head, *rest = locale.strip().replace("_", "-").split("-")
    return "-".join([head.lower(), *(p.upper() if len(p) == 2 else p for p in rest)])


#: Days of the months of a leap year, two digits each.
MONTH_DAYS = "312931303130313130313031"


def valid_date(day: Column, month: Column, year: Column) -> Column:
    """A calendar check; without a year the 29th of February passes. Days and months below one are not asked for."""
    y = F.coalesce(year, F.lit(2000))
    days = F.substr(F.lit(MONTH_DAYS), month * 2 - 1, F.lit(2)).try_cast("int")
    leap = (y % 400 == 0) | ((y % 4 == 0) & (y % 100 != 0))
    return F.coalesce(day.between(1, days) & month.between(1, 12) & ((day < 29) | (month != 2) | leap), F.lit(False))


#: Letters of the words that are context: of an ordinal's ending, of an identifier.
LETTER = "[A-Za-zÄÖÜäöüß]"
NO_LETTER = LETTER.replace("[", "[^")
#: The last word, behind it only characters of a class. Read from the end, and each word but once: looked for from the
#: left, every letter before it would be a start to try.
LAST_WORD = rf"(?sU)\A(?:.*{NO_LETTER})?({LETTER}++){{}}*+\z"
#: What Java's expressions take for white space in Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ending(left: Column) -> Column:
    """The ending of a German ordinal by the word before it, which only white space may part from it."""

    words = [(w, e) for e, ws in ENDINGS.items() for w in ws]
    at = F.find_in_set(F.lower(F.regexp_extract(last(left, 80), LAST_WORD.format(r"\s"), 1)), F.lit(",".join(w for w, _ in words)))
    # Position 0, of a word that is none of them, has the ending that other words give.
    return F.get(listed(["er", *(e for _, e in words)]), at)


def spoken_date(day: Column, month: Column, year: Column, locale: str, left: Column, renderer: str = "curated") -> Column:
    """A date in words; without words of its own for days and months a language reads numbers."""
    lang, _, region = normalize_locale(locale).partition("-")
    if renderer == "numeric_fallback" or lang not in CURATED:
        return F.concat_ws(" ", small_words(day, lang), small_words(month, lang), year_words(year, lang))
    if lang == "de":
        return F.concat_ws(" ", F.concat(pick(DE_DAYS, day - 1), ending(left)), pick(DE_MONTHS, month - 1), year_words(year, lang))
    name, nth, y = pick(EN_MONTHS, month - 1), pick(EN_DAYS, day - 1), year_words(year, lang)
    return F.concat_ws(" ", nth, F.lit("of"), name, y) if region in DMY_REGIONS else F.concat_ws(" ", name, nth, y)


def month_number(name: Column, lang: str) -> Column:
    """The month of a name in the locale's own language, else null."""
    known = [n.lower() for n in {"de": [*DE_MONTHS, "maerz"], "en": EN_MONTHS}.get(lang, [""])]
    at = F.array_position(listed(known), F.lower(name)).cast("int")
    return F.when(name == "", None).when(at == 13, 3).when(at > 0, at)


def pieces(match: Column) -> Column:
    """The numbers and names of a match."""
    return F.split(F.regexp_replace(match, r"(?U)[^\p{L}\p{N}]+", " "), " ")


def ordered(found: Column, name: str, lang: str) -> Column:
    """(day, month, year) from the pieces of a match of a format; a part is null where the format has none."""
    parts = FORMATS[name][1]

    def number(kind: str) -> Column:
        k = parts.find(kind)
        return F.get(found, F.lit(k)).try_cast("int") if k >= 0 else F.lit(None).cast("int")

    month = month_number(F.get(found, F.lit(parts.find("n"))), lang) if "n" in parts else number("m")
    return F.struct(number("d").alias("day"), month.alias("month"), number("y").alias("year"))


def date_parts(match: Column, name: str, lang: str) -> Column:
    """(day, month, year) of a match of a format."""
    return let(pieces(match), lambda found: ordered(found, name, lang))


def search_pattern(name: str) -> str:
    """The format's pattern without groups, to be part of a larger one."""
    pattern = FORMATS[name][0]
    search = re.sub(r"\((?!\?)", "(?:", pattern.replace("(?i)", ""))
    return f"(?i:{search})" if "(?i)" in pattern else search


def dotted(name: str) -> bool:
    """Whether a format ends with the dot of its month, which may also end a sentence."""
    return name in ("dmy_dot_no_year", "dmy_dot_spaced_no_year")


def accepted(parts: Column, left: Column, right: Column, name: str) -> Column:
    """Whether the parts of a match of a format are those of a date that stands free."""
    ok = valid_date(parts["day"], parts["month"], parts["year"]) & date_boundary(left, right)
    if dotted(name):
        near = rf"{DAY}\.\s*{MONTH}\."
        ok = ok & ~like(left, rf"(?U){near}\s+\z") & ~like(right, rf"(?U)\A\s+{near}")
    return F.coalesce(ok, F.lit(False))


def kept_dot(right: Column) -> Column:
    """The dot of a month that also ends a sentence, else nothing."""
    return F.when(like(right, r"(?U)\A[ \t]*+(?:\z|[\r\n]|\p{Lu})"), F.lit(".")).otherwise(F.lit(""))


#: What a text must hold for a format to occur in it, cheaper to look for than the format.
MARKS = {"slash": "/", "dash": "-", "dot": "."}


def gate(text: Column, name: str) -> Column:
    marks = [m for word, m in MARKS.items() if word in name]
    return text.contains(marks[0]) if marks else like(text, r"(?U)\d")


def speak_format(text: Column, name: str, locale: str, renderer: str = "curated") -> Column:
    """One pass for one input format."""
    lang = normalize_locale(locale).split("-")[0]

    def render(x: Column, left: Column, right: Column) -> Column:
        def spoken(p: Column) -> Column:
            said = spoken_date(p["day"], p["month"], p["year"], locale, left, renderer)
            if dotted(name):
                said = F.concat(said, kept_dot(right))
            return F.when(accepted(p, left, right, name), said)

        return let(date_parts(x, name, lang), spoken)

    # Within a stretch between tags, whose ends are those of a text.
    return F.when(gate(text, name), regex_sub(text, search_pattern(name), render, tags=False)).otherwise(text)


#: Words before a number that make it an identifier.
SKIP_WORDS = "code error fehler fehlercode firmware fw id ids model modell pin port v version".split()
#: Measures that a year is not followed by, beside the units that are spoken and their words.
MORE_MEASURES = "k m cm mm ppm grad degree degrees kelvin millimeter millimeters millimetre millimetres meter meters metre metres kilometre kilometres".split()
_UNIT_WORDS = {w for u in units.ALIASES.values() for lang in ("en-US", "de") for w in units.forms(u, lang) if " " not in w}
_MEASURES = sorted({*map(str.lower, units.ALIASES), *map(str.lower, _UNIT_WORDS), *MORE_MEASURES}, key=lambda w: (-len(w), w))
UNITS_AFTER = rf"(?iuU)\A\s*+(?:{'|'.join(map(re.escape, _MEASURES))})(?=\z|[\s,.;:!?)\]}}])"


def spoken_year(x: Column, left: Column, right: Column, locale: str, least: int = 1900, most: int = 2099) -> Column:
    """The words of four digits that stand as a year, else null."""
    lang, y = normalize_locale(locale).split("-")[0], x.try_cast("int")
    # The last word within 80 characters, whatever else stands between.
    before = F.lower(F.regexp_extract(last(F.rtrim(left, F.lit(BLANKS)), 80), LAST_WORD.format(NO_LETTER), 1))
    ok = y.between(least, most) & numeric_left(left) & ~like(first(right, 2), rf"(?U)\A(?:[\p{{L}}\p{{N}}_]|[.,:/+{DASHES}]\d)")
    return F.when(ok & (F.find_in_set(before, F.lit(",".join(SKIP_WORDS))) == 0) & ~like(right, UNITS_AFTER), year_words(y, lang, least, most))


def speak_years(text: Column, locale: str, least: int = 1900, most: int = 2099) -> Column:
    """Standalone years in words; years that belong to identifiers, versions or measurements stay."""
    return by_segment(text, lambda t: regex_sub(t, r"\d{4}", lambda x, left, right: spoken_year(x, left, right, locale, least, most), r"(?U)\d{4}", tags=False, reach=100))


@bound
def speak_dates(text: Column, locale: str, formats: list[str] | None = None, years: bool = False, renderer: str | None = None, least: int = 1900, most: int = 2099) -> Column:
    """The configured formats in order, each over what the one before returned; years, within least and most, last."""
    renderer = renderer or default_renderer(locale)

    def one_pass(name: str):
        return lambda t: speak_format(t, name, locale, renderer)

    def every(t: Column) -> Column:
        for f in default_formats(locale) if formats is None else formats:
            t = let(t, one_pass(f))
        return t

    spoken = F.when(like(text, r"(?U)\d"), by_segment(text, every)).otherwise(text)
    return let(spoken, lambda t: speak_years(t, locale, least, most)) if years else spoken
