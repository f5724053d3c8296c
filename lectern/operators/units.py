"""Units: a number and a unit alias to the number and the unit's words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.regexsub import DASHES, GROUP_SPACES, last, let, like, numeric_left, regex_sub
from lectern.functions.words import listed
from lectern.operators.numbers import GROUPED, SIMPLE, plain_number

# Alias -> unit (case matters for V, A, B and %), and the spoken forms.
ALIASES = {
    "Mbit/s": "megabit_per_second", "km/h": "kilometer_per_hour", "kmh": "kilometer_per_hour", "kWh": "kilowatt_hour",
    "hPa": "hectopascal", "mbar": "millibar", "m/s": "meter_per_second", "mA": "milliampere", "Wh": "watt_hour",
    "kW": "kilowatt", "KB": "kilobyte", "MB": "megabyte", "GB": "gigabyte", "°C": "celsius", "°F": "fahrenheit",
    "bar": "bar", "km": "kilometer", "lx": "lux", "lm": "lumen", "W": "watt", "V": "volt", "A": "ampere", "B": "byte", "%": "percent",
}
EXACT = {"V", "A", "B", "%"}
GERMAN = {
    "percent": "Prozent", "watt": "Watt", "kilowatt": "Kilowatt", "watt_hour": "Wattstunde Wattstunden", "kilowatt_hour": "Kilowattstunde Kilowattstunden",
    "volt": "Volt", "ampere": "Ampere", "milliampere": "Milliampere", "kilometer": "Kilometer", "kilometer_per_hour": "Kilometer_pro_Stunde",
    "meter_per_second": "Meter_pro_Sekunde", "hectopascal": "Hektopascal", "millibar": "Millibar", "bar": "Bar", "lux": "Lux", "lumen": "Lumen",
    "byte": "Byte", "kilobyte": "Kilobyte", "megabyte": "Megabyte", "gigabyte": "Gigabyte", "megabit_per_second": "Megabit_pro_Sekunde",
}
#: English forms follow from the unit's name but for these.
UNCHANGED = {"percent", "lux"}


def english_forms(unit: str) -> tuple[str, str]:
    words = unit.split("_")
    head = 1 if words[-1] == "hour" and "per" not in words else 0
    plural = [w + "s" if k == head and unit not in UNCHANGED else w for k, w in enumerate(words)]
    return " ".join(words), " ".join(plural)


def forms(unit: str, locale: str) -> tuple[str, str]:
    lang = locale.split("-")[0].lower()
    if unit in ("celsius", "fahrenheit"):
        if lang == "de":
            name = "Grad" if unit == "celsius" else "Grad Fahrenheit"
            return name, name
        plain = lang == "en" and (unit == "fahrenheit") == (locale == "en-US")
        tail = "" if plain else f" {unit.capitalize()}"
        return f"degree{tail}", f"degrees{tail}"
    if lang == "de":
        one, *many = GERMAN[unit].split(" ")
        return one.replace("_", " "), (many or [one])[0].replace("_", " ")
    return english_forms(unit)


def stands_whole(number: Column, left: Column, grouped: bool) -> Column:
    """Whether a number before a unit is no part of a larger group; without grouping 1.000 is left alone."""
    ok = ~like(last(left, 5), rf"(?U)(?:\A|\D)\d{{1,3}}{GROUP_SPACES}\z")
    return ok if grouped else ok & ~like(number, rf"\A[{DASHES}]?[1-9]\d{{0,2}}[.,]\d{{3}}\z")


#: Longest first: the first that fits is the alias.
ALIAS = "|".join(re.escape(a) if a in EXACT else f"(?iu:{re.escape(a)})" for a in sorted(ALIASES, key=lambda a: -len(a)))


def measurement(grouped: bool) -> str:
    """The pattern of a number with a unit."""
    return rf"{GROUPED if grouped else SIMPLE}\s*(?:{ALIAS})(?![\w/])"


def measured(token: Column, left: Column, locale: str, grouped: bool = False, hint: str = "") -> Column:
    """(number, words) of a measurement: the number's text and the unit in words; null if it does not stand free or is none."""
    # Aliases whose case matters are keys as they are; no other alias has their text in lower case.
    known = {a if a in EXACT else a.lower(): forms(u, locale) for a, u in ALIASES.items()}
    names, spoken = F.lit(",".join(known)), [listed([pair[k] for pair in known.values()]) for k in (0, 1)]

    def of(p: Column) -> Column:
        at = F.coalesce(F.nullif(F.find_in_set(p["unit"], names), F.lit(0)), F.find_in_set(F.lower(p["unit"]), names)) - 1

        def one(parts: Column) -> Column:
            return F.coalesce((F.get(parts, F.lit(0)).cast("long") == 1) & (F.coalesce(F.rtrim(F.get(parts, F.lit(1)), F.lit("0")), F.lit("")) == ""), F.lit(False))

        words = let(plain_number(p["number"], grouped, hint or locale), lambda parts: F.when(parts.isNotNull(), F.when(one(parts), F.get(spoken[0], at)).otherwise(F.get(spoken[1], at))))
        return F.when((p["unit"] != "") & stands_whole(p["number"], left, grouped), F.struct(p["number"].alias("number"), words.alias("words")))

    form = GROUPED if grouped else SIMPLE
    number, unit = F.regexp_extract(token, rf"(?U)\A({form})", 1), F.regexp_extract(token, rf"(?U)\A(?:{form})\s*({ALIAS})\z", 1)
    return F.when(numeric_left(left), let(F.struct(number.alias("number"), unit.alias("unit")), of))


def speak_units(text: Column, locale: str, grouped: bool = False, hint: str = "") -> Column:
    """text with every measurement's unit in words; the number's text stays, one space follows it."""

    def render(x: Column, left: Column, right: Column) -> Column:
        return let(measured(x, left, locale, grouped, hint), lambda p: F.concat(p["number"], F.lit(" "), p["words"]))

    return regex_sub(text, measurement(grouped), render, gate=r"(?U)\d")
