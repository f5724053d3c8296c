"""Number words as expressions over literal arrays: English, German, French and Spanish.

English style: hyphens below one hundred, "and" after hundreds, commas between thousands groups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.regexsub import let

# The irregular number words.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_ORDINAL = {1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth", 20: "twentieth", 30: "thirtieth"}
DE_SMALL = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
DE_TENS = "null zehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
DE_ORDINAL = {1: "erst", 3: "dritt", 7: "siebt", 8: "acht"}
EN_MONTHS = "January February March April May June July August September October November December".split()
DE_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
FR_SMALL = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = "zéro dix vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt".split()
ES_SMALL = (
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
).split()
ES_TENS = "cero diez veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = "cero ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
MINUS = {"en": "minus", "de": "minus", "fr": "moins", "es": "menos"}
POINT = {"en": "point", "de": "Komma", "fr": "virgule", "es": "coma"}


def en_below_100(n: int) -> str:
    return EN_SMALL[n] if n < 20 else EN_TENS[n // 10] + (f"-{EN_SMALL[n % 10]}" if n % 10 else "")


def de_below_100(n: int) -> str:
    if n < 20:
        return DE_SMALL[n]
    return (("ein" if n % 10 == 1 else DE_SMALL[n % 10]) + "und" if n % 10 else "") + DE_TENS[n // 10]


def en_ordinal(n: int) -> str:
    if n in EN_ORDINAL:
        return EN_ORDINAL[n]
    return f"{EN_TENS[n // 10]}-{en_ordinal(n % 10)}" if n > 20 else f"{EN_SMALL[n]}th"


def de_ordinal(n: int) -> str:
    """Stem of a German ordinal; the ending -e, -en, -em or -er follows."""
    return DE_ORDINAL.get(n, DE_SMALL[n] + "t") if n < 20 else f"{de_below_100(n)}st"


EN_100, DE_100 = [en_below_100(n) for n in range(100)], [de_below_100(n) for n in range(100)]
EN_DAYS, DE_DAYS = [en_ordinal(n) for n in range(1, 32)], [de_ordinal(n) for n in range(1, 32)]


def listed(words: list[str]) -> Column:
    """An array of words, made from one literal: a literal for each would take a call to the driver's JVM each."""
    return F.split(F.lit("\n".join(words)), "\n")


def pick(table: list[str], at: Column) -> Column:
    return F.get(listed(table), at.cast("int"))


def _en_group(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    head = F.when(hundreds > 0, F.concat(pick(EN_SMALL, hundreds), F.lit(" hundred")))
    tail = F.when((rest > 0) | (n == 0), pick(EN_100, rest))
    return F.concat_ws(" and ", head, tail)


def en_cardinal(n: Column) -> Column:
    """Words of a whole number from 0 to 999,999,999."""

    def body(v: Column) -> Column:
        millions, thousands, rest = F.floor(v / 1_000_000), F.floor(v / 1000) % 1000, v % 1000
        big = F.concat_ws(
            ", ",
            F.when(millions > 0, F.concat(_en_group(millions), F.lit(" million"))),
            F.when(thousands > 0, F.concat(_en_group(thousands), F.lit(" thousand"))),
            F.when(rest >= 100, _en_group(rest)),
        )
        return F.when(v.between(0, 99), pick(EN_100, v)).when(v < 1000, _en_group(v)).otherwise(
            F.when((rest > 0) & (rest < 100), F.concat(big, F.lit(" and "), pick(EN_100, rest))).otherwise(big)
        )

    return let(n.cast("long"), body)


def _de_group(n: Column, last: bool) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    head = F.when(hundreds > 0, F.concat(F.when(hundreds == 1, F.lit("ein")).otherwise(pick(DE_SMALL, hundreds)), F.lit("hundert")))
    small = pick(DE_100, rest) if last else F.when(rest == 1, F.lit("ein")).otherwise(pick(DE_100, rest))
    return F.concat_ws("", head, F.when((rest > 0) | (n == 0), small))


def de_cardinal(n: Column) -> Column:
    def body(v: Column) -> Column:
        millions, thousands, rest = F.floor(v / 1_000_000), F.floor(v / 1000) % 1000, v % 1000
        head = F.when(millions == 1, F.lit("eine Million")).when(millions > 1, F.concat(_de_group(millions, True), F.lit(" Millionen")))
        tail = F.concat_ws(
            "",
            F.when(thousands > 0, F.concat(_de_group(thousands, False), F.lit("tausend"))),
            F.when((rest > 0) | (v == 0), _de_group(rest, True)),
        )
        return F.when(v.between(0, 99), pick(DE_100, v)).otherwise(F.concat_ws(" ", head, F.when(tail != "", tail)))

    return let(n.cast("long"), body)


def fr_below_1000(n: int, before_thousand: bool = False) -> str:
    """Plural marks of cents and vingts stand at the end of a number, and before millions, only."""
    hundreds, n = divmod(n, 100)
    tens, one = divmod(n, 10)
    if tens in (7, 9):
        tens, one = tens - 1, one + 10
    if n < 20:
        low = FR_SMALL[n] if n or not hundreds else ""
    elif one == 0:
        low = FR_TENS[tens] + ("s" if tens == 8 and not before_thousand else "")
    else:
        low = FR_TENS[tens] + (" et " if one in (1, 11) and tens != 8 else "-") + FR_SMALL[one]
    head = "" if not hundreds else "cent" if hundreds == 1 else f"{FR_SMALL[hundreds]} cent" + ("s" if not n and not before_thousand else "")
    return f"{head} {low}".strip()


def es_below_1000(n: int, short: bool = False) -> str:
    """short: uno before mil and millones."""
    if n == 100:
        return "cien"
    hundreds, n = divmod(n, 100)
    low = "" if hundreds and not n else ES_SMALL[n] if n < 30 else ES_TENS[n // 10] + (f" y {ES_SMALL[n % 10]}" if n % 10 else "")
    if short and low.endswith("uno"):
        low = low[:-3] + ("ún" if n == 21 else "un")
    return f"{ES_HUNDREDS[hundreds] if hundreds else ''} {low}".strip()


def _by_thousands(n: Column, last: list[str], thousands_of: list[str], thousand: str, millions_of: list[str], million: tuple[str, str]) -> Column:
    """Words of 0 to 999,999,999 from tables of the numbers below 1000 by their place."""

    def body(v: Column) -> Column:
        millions, thousands, rest = F.floor(v / 1_000_000), F.floor(v / 1000) % 1000, v % 1000
        return F.concat_ws(
            " ",
            F.when(millions == 1, F.lit(million[0])).when(millions > 1, F.concat(pick(millions_of, millions), F.lit(f" {million[1]}"))),
            F.when(thousands == 1, F.lit(thousand)).when(thousands > 1, F.concat(pick(thousands_of, thousands), F.lit(f" {thousand}"))),
            F.when((rest > 0) | (v == 0), pick(last, rest)),
        )

    return let(n.cast("long"), body)


FR_1000, FR_1000_SHORT = ([fr_below_1000(n, short) for n in range(1000)] for short in (False, True))
ES_1000, ES_1000_SHORT = ([es_below_1000(n, short) for n in range(1000)] for short in (False, True))


def fr_cardinal(n: Column) -> Column:
    return _by_thousands(n, FR_1000, FR_1000_SHORT, "mille", FR_1000, ("un million", "millions"))


def es_cardinal(n: Column) -> Column:
    return _by_thousands(n, ES_1000, ES_1000_SHORT, "mil", ES_1000_SHORT, ("un millón", "millones"))


CARDINAL = {"en": en_cardinal, "de": de_cardinal, "fr": fr_cardinal, "es": es_cardinal}


def digit_words(digits: Column, lang: str) -> Column:
    """Each digit of a string as a word."""
    table = {"en": EN_SMALL, "de": DE_SMALL, "fr": FR_SMALL, "es": ES_SMALL}[lang]
    return F.array_join(F.transform(F.split(digits, ""), lambda d: pick(table, d)), " ")


def en_year(y: Column) -> Column:
    high, low = F.floor(y / 100), y % 100
    return (
        F.when((y >= 2000) & (y < 2010), F.concat_ws(" ", F.lit("two thousand"), F.when(low > 0, pick(EN_SMALL, low))))
        .when(~y.between(1900, 2099), en_cardinal(y))
        .when(low == 0, F.concat(pick(EN_100, high), F.lit(" hundred")))
        .when(low < 10, F.concat_ws(" ", pick(EN_100, high), F.lit("oh"), pick(EN_SMALL, low)))
        .otherwise(F.concat_ws(" ", pick(EN_100, high), pick(EN_100, low)))
    )


def de_year(y: Column) -> Column:
    high, low = F.floor(y / 100), y % 100
    old = F.concat(pick(DE_100, high), F.lit("hundert"), F.when(low > 0, pick(DE_100, low)).otherwise(F.lit("")))
    return F.when(y.between(1100, 1999), old).otherwise(de_cardinal(y))


#: Year words by language; others read a year as a number.
YEAR = {"en": en_year, "de": de_year}
#: The years of dates, whose words are looked up.
YEARS = range(1900, 2100)


def year_text(y: int, lang: str) -> str:
    """The words of one of YEARS."""
    high, low = divmod(y, 100)
    if lang == "en":
        if 2000 <= y < 2010:
            return "two thousand" + (f" {EN_SMALL[low]}" if low else "")
        return EN_100[high] + (" hundred" if not low else f" oh {EN_SMALL[low]}" if low < 10 else f" {EN_100[low]}")
    if lang == "de":
        tail = DE_100[low] if low else ""
        return f"{DE_100[high]}hundert{tail}" if y < 2000 else f"zweitausend{tail}"
    thousand, before, last = ("mille", FR_1000_SHORT, FR_1000) if lang == "fr" else ("mil", ES_1000_SHORT, ES_1000)
    head = thousand if y < 2000 else f"{before[2]} {thousand}"
    return head + (f" {last[y % 1000]}" if y % 1000 else "")


def year_words(y: Column, lang: str, least: int = YEARS[0], most: int = YEARS[-1]) -> Column:
    """The words of years between least and most."""
    if least >= YEARS[0] and most <= YEARS[-1]:
        return pick([year_text(k, lang) for k in YEARS], y - YEARS[0])
    return YEAR.get(lang, CARDINAL[lang])(y)


def small_words(n: Column, lang: str) -> Column:
    """The words of a day or month."""
    return pick({"en": EN_100, "de": DE_100, "fr": FR_1000, "es": ES_1000}[lang][:32], n)
