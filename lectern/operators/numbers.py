"""Numbers: tokens to words, with grouping, leading zeros, decimals and structural vetoes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.regexsub import let, like, numeric_boundary, regex_sub
from lectern.functions.words import CARDINAL, MINUS, POINT, digit_words

SIGN = r"[-−–—]"
SPACES = r"[    ]"
SIMPLE = rf"{SIGN}?\d+(?:[.,]\d+)?"


def groups_of_three(mark: str, point: str) -> str:
    """Digits in groups by a mark, perhaps with a fraction behind a point."""
    return rf"\d{{1,3}}(?:{mark}\d{{3}})+(?:{point}\d+)?"


#: Grouped by spaces, by dots before a comma, by commas before a dot; else plain. The leftmost that fits wins.
GROUPED = rf"{SIGN}?(?:" + "|".join([groups_of_three(SPACES, "[.,]"), groups_of_three(r"\.", ","), groups_of_three(",", r"\."), SIMPLE.removeprefix(f"{SIGN}?")]) + ")"
MAX_INTEGER, MAX_FRACTION = 9, 6
#: Characters a text can have.
MOST = 2**31 - 1
#: The mark between thousands.
GROUP_MARK = {"de": ".", "en": ",", "es": "."}


def plain_number(token: Column, grouped: bool = False, hint: str = "") -> Column:
    """A numeric token as [integer digits, fraction digits] without sign and marks; null if it is none.

    The fraction is null where there is no decimal mark.
    """
    mark = GROUP_MARK.get(hint.replace("_", "-").split("-")[0].lower(), "")
    none, digits = F.lit(None).cast("string"), lambda c: F.regexp_replace(c, r"\D", "")

    def parts(integer: Column, fraction: Column) -> Column:
        fits = lambda p: F.when(F.length(p[0]).between(1, MAX_INTEGER) & (p[1].isNull() | F.length(p[1]).between(1, MAX_FRACTION)), p)
        return let(F.array(integer, fraction), fits)

    def read(u: Column) -> Column:
        """The parts of a number without its sign; u is bound, as each form asks for it again."""
        out = F.when(like(u, r"\A\d+\z"), parts(u, none))
        if grouped:
            one_space = F.lit(False)
            for s in (" ", "\\u00a0", "\\u202f", "\\u2009"):
                one_space = one_space | like(u, rf"\A[1-9]\d{{0,2}}(?:{s}\d{{3}})+(?:[.,]\d+)?\z")
            out = out.when(one_space, parts(digits(F.regexp_extract(u, r"\A([^.,]*)", 1)), F.nullif(F.regexp_extract(u, r"[.,](\d+)\z", 1), F.lit(""))))
            for g, d in ((r"\.", ","), (",", r"\.")):
                out = out.when(like(u, rf"\A[1-9]\d{{0,2}}(?:{g}\d{{3}})+{d}\d+\z"), parts(digits(F.regexp_extract(u, rf"\A(.*){d}", 1)), F.regexp_extract(u, rf"{d}(\d+)\z", 1)))
                many = "{2,}" if mark != g.strip("\\") else "+"
                out = out.when(like(u, rf"\A[1-9]\d{{0,2}}(?:{g}\d{{3}}){many}\z"), parts(digits(u), none))
        return out.when(like(u, r"\A\d+[.,]\d+\z"), parts(F.regexp_extract(u, r"\A(\d+)", 1), F.regexp_extract(u, r"(\d+)\z", 1)))

    signed = (token != "") & F.lit(SIGN.strip("[]")).contains(F.left(token, F.lit(1)))
    return let(F.when(signed, F.substring(token, 2, MOST)).otherwise(token), read)


def number_words(token: Column, lang: str, grouped: bool = False, hint: str = "", speller=None) -> Column:
    """The words of one numeric token, or null. speller: whole number to words, in place of the language's own."""
    cardinal = speller or CARDINAL[lang]
    negative = like(token, rf"\A{SIGN}")

    def body(p: Column) -> Column:
        integer, fraction = F.get(p, F.lit(0)), F.rtrim(F.get(p, F.lit(1)), F.lit("0"))
        value = integer.cast("long")
        has = F.coalesce(fraction != "", F.lit(False))
        lead = (F.get(p, F.lit(1)).isNull()) & (F.length(integer) > 1) & integer.startswith("0")
        sign = F.when(negative & (lead | has | (value != 0)), F.lit(MINUS[lang]))
        spoken = F.when(lead, digit_words(integer, lang)).when(has, F.concat_ws(" ", cardinal(value), F.lit(POINT[lang]), digit_words(fraction, lang))).otherwise(cardinal(value))
        return F.when(p.isNotNull(), F.concat_ws(" ", sign, spoken))

    return let(plain_number(token, grouped, hint or lang), body)


def is_ipv4(token: Column) -> Column:
    """Whether a text is an address of four numbers up to 255."""
    parts = F.split(token, r"\.", -1)
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: like(p, r"\A[0-9]{1,9}\z") & (p.try_cast("int") <= 255)), F.lit(False))


def speak_numbers(text: Column, lang: str, grouped: bool = False, hint: str = "", speller=None) -> Column:
    """text with every eligible number in words; identifiers, versions, addresses and dates stay.

    hint: the locale that decides whether 1.342 is grouped; speller: as for number_words, may call a pandas_udf.
    """
    spoken = lambda x, left, right: F.when(numeric_boundary(x, left, right), number_words(x, lang, grouped, hint, speller))
    return regex_sub(text, GROUPED if grouped else SIMPLE, spoken, gate=r"(?U)\d")
