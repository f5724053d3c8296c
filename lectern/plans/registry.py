"""The queries of the speech-text library, by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.words import CARDINAL
from lectern.operators import dates, emoji, extract, markdown, numbers, rules, times, units
from lectern.plans import oracle as O
from lectern.plans.normalize import Profile, change_rates, normalize, normalize_distinct
from lectern.plans.profiles import canonical_profiles, invalid_rules, load_profiles, normalize_by_profile, preview, preview_rejected, profile_rows, profiles_by_name, supported_locales, validate_profiles
from lectern.sources.messages import read_chunks, spread, work_folder, write_segments
from lectern.streaming.cutter import cut_segments, cut_stream

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spoken(name: str, table: str, key: str, sentence: str, say: Callable[[Column], Column], sql: str) -> None:
    """A query over every row of a table: say(sentence) by key; sql is the expected text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(_table(spark, sf_dir, table).select(F.expr(key).alias("id"), F.expr(sentence).alias("text")))
        return rows.select("id", say(F.col("text")).alias("spoken"))

    _QUERIES[name] = query
    _SQL[name] = f"SELECT {key} AS id, {sql} AS spoken FROM {table}"


# Dates: the orders' dates are written in a format, spoken, and compared with words made from their parts.
_MONTH, _DE_MONTH = f"{O.EN_MONTH}[month(o_orderdate)]", f"{O.DE_MONTH}[month(o_orderdate)]"
_DAY, _DE_DAY = f"{O.EN_DAY}[day(o_orderdate)]", f"{O.DE_DAY}[day(o_orderdate)]"
_YEAR, _DE_YEAR = O.en_year("year(o_orderdate)"), O.de_year("year(o_orderdate)")


def _dated(name: str, before: str, form: str, locale: str, formats: list[str] | None, sql: str) -> None:
    _spoken(
        f"date_{name}", "orders", "o_orderkey", f"concat('{before}', date_format(o_orderdate, '{form}'), ', noted')",
        lambda t: dates.speak_dates(t, locale, formats), f"'{before}' || {sql} || ', noted'",
    )


_dated("mdy_us", "Due ", "MM/dd/yyyy", "en-US", None, f"{_MONTH} || ' ' || {_DAY} || ' ' || {_YEAR}")
_dated("dmy_gb", "Due ", "dd/MM/yyyy", "en-GB", None, f"{_DAY} || ' of ' || {_MONTH} || ' ' || {_YEAR}")
_dated("iso_ca", "Due ", "yyyy-MM-dd", "en-CA", None, f"{_MONTH} || ' ' || {_DAY} || ' ' || {_YEAR}")
_dated("month_name_en", "Due ", "MMMM d, yyyy", "en-US", ["mdy_month_name"], f"{_MONTH} || ' ' || {_DAY} || ' ' || {_YEAR}")
for _name, _before, _form, _end in (
    ("iso_de", "Termin ", "yyyy-MM-dd", "er"), ("dot_de_am", "Termin am ", "dd.MM.yyyy", "en"), ("dot_de_der", "der ", "dd.MM.yyyy", "e"),
    ("dot_de_ab", "gilt ab ", "dd.MM.yyyy", "em"), ("spaced_de", "Termin ", "d. M. yyyy", "er"), ("dot_de_colon", "am: ", "dd.MM.yyyy", "er"), ("dot_de_bracket", "am (", "dd.MM.yyyy", "er"),
):
    _dated(_name, _before, _form, "de-DE", None, f"{_DE_DAY} || '{_end} ' || {_DE_MONTH} || ' ' || {_DE_YEAR}")
_dated("no_year_de", "am ", "dd.MM.", "de-DE", None, f"{_DE_DAY} || 'en ' || {_DE_MONTH}")
_dated("left_alone", "v1", "dd.MM.yyyy", "de-DE", None, "strftime(o_orderdate, '%d.%m.%Y')")
_spoken("standalone_year_en", "orders", "o_orderkey", "concat('In ', year(o_orderdate), ' and PIN ', year(o_orderdate))", lambda t: dates.speak_years(t, "en-US"), f"'In ' || {_YEAR} || ' and PIN ' || year(o_orderdate)")
_spoken("standalone_year_de", "orders", "o_orderkey", "concat('Seit ', year(o_orderdate), '.')", lambda t: dates.speak_years(t, "de-DE"), f"'Seit ' || {_DE_YEAR} || '.'")

# Times from the events.
_H, _M = "hour(ts)", "minute(ts)"
_EN_CLOCK = f"{O.en_below_100(_H)} || CASE WHEN {_M} = 0 THEN '' WHEN {_M} < 10 THEN ' oh ' || {O.en_below_100(_M)} ELSE ' ' || {O.en_below_100(_M)} END"
_DE_CLOCK = f"CASE WHEN {_H} = 1 THEN 'ein' ELSE {O.de_below_100(_H)} END || ' Uhr' || CASE WHEN {_M} = 0 THEN '' ELSE ' ' || {O.de_below_100(_M)} END"
_spoken("clock_en", "events", "event_id", "concat('At ', date_format(ts, 'HH:mm'), '.')", lambda t: times.speak_times(t, "en-US"), f"'At ' || {_EN_CLOCK} || '.'")
_spoken("clock_de", "events", "event_id", "concat('Um ', date_format(ts, 'HH:mm'), ' Uhr.')", lambda t: times.speak_times(t, "de"), f"'Um ' || {_DE_CLOCK} || '.'")
_spoken("clock_range_de", "events", "event_id", "concat(date_format(ts, 'HH:mm'), '-', date_format(ts, 'HH:mm'))", lambda t: times.speak_times(t, "de"), f"{_DE_CLOCK} || ' bis ' || {_DE_CLOCK}")
_spoken("clock_range_en", "events", "event_id", "concat(date_format(ts, 'HH:mm'), ' to ', date_format(ts, 'HH:mm'))", lambda t: times.speak_times(t, "en-GB"), f"{_EN_CLOCK} || ' to ' || {_EN_CLOCK}")


def _many(value: str, one: str, name: str, words: Callable[[str], str], plural: str) -> str:
    return f"CASE WHEN {value} = 0 THEN NULL WHEN {value} = 1 THEN '{one} {name}' ELSE {words(value)} || ' {name}{plural}' END"


_spoken("duration_hms_en", "events", "event_id", "date_format(ts, 'HH:mm:ss')", lambda t: times.speak_times(t, "en-US", durations=True),
        f"coalesce(nullif(concat_ws(' ', {_many(_H, 'one', 'hour', O.en_below_100, 's')}, {_many(_M, 'one', 'minute', O.en_below_100, 's')}, {_many('second(ts)', 'one', 'second', O.en_below_100, 's')}), ''), 'zero seconds')")
_spoken("duration_hm_de", "events", "event_id", "date_format(ts, 'HH:mm''h''')", lambda t: times.speak_times(t, "de", durations=True),
        f"coalesce(nullif(concat_ws(' ', {_many(_H, 'eine', 'Stunde', O.de_below_100, 'n')}, {_many(_M, 'eine', 'Minute', O.de_below_100, 'n')}), ''), 'null Sekunden')")

# Numbers and units from parts.
_P = "p_size"
_spoken("number_int_en", "part", "p_partkey", "concat('Size ', p_size, ' and -', p_size)", lambda t: numbers.speak_numbers(t, "en"), f"'Size ' || {O.en_below_100(_P)} || ' and minus ' || {O.en_below_100(_P)}")
_spoken("number_int_de", "part", "p_partkey", "concat('Wert ', p_size, '.')", lambda t: numbers.speak_numbers(t, "de"), f"'Wert ' || {O.de_below_100(_P)} || '.'")
_spoken("number_decimal_de", "part", "p_partkey", "concat(p_size, ',', lpad(p_size, 2, '0'))", lambda t: numbers.speak_numbers(t, "de"),
        f"{O.de_below_100(_P)} || ' Komma ' || {O.DE_TO_19}[{_P} // 10 + 1] || CASE WHEN {_P} % 10 = 0 THEN '' ELSE ' ' || {O.DE_TO_19}[{_P} % 10 + 1] END")
_spoken("number_leading_zero", "part", "p_partkey", "concat('0', lpad(p_size, 2, '0'))", lambda t: numbers.speak_numbers(t, "en"), f"'zero ' || {O.EN_TO_19}[{_P} // 10 + 1] || ' ' || {O.EN_TO_19}[{_P} % 10 + 1]")
_spoken("number_grouped_en", "part", "p_partkey", "concat(p_size, ',', lpad(p_size, 3, '0'))", lambda t: numbers.speak_numbers(t, "en", True), f"{O.en_below_100(_P)} || ' thousand and ' || {O.en_below_100(_P)}")
_spoken("number_left_alone", "part", "p_partkey", "concat('sensor_', p_size, ' 10.0.0.', p_size, ' v', p_size, '.1')", lambda t: numbers.speak_numbers(t, "de"), "'sensor_' || p_size || ' 10.0.0.' || p_size || ' v' || p_size || '.1'")
_spoken("unit_en", "part", "p_partkey", "concat(p_size, 'kWh, ', p_size, ' %')", lambda t: units.speak_units(t, "en-GB"), "p_size || CASE WHEN p_size = 1 THEN ' kilowatt hour, ' ELSE ' kilowatt hours, ' END || p_size || ' percent'")
_spoken("unit_de", "part", "p_partkey", "concat(p_size, '°C und ', p_size, ' Wh')", lambda t: units.speak_units(t, "de"), "p_size || ' Grad und ' || p_size || CASE WHEN p_size = 1 THEN ' Wattstunde' ELSE ' Wattstunden' END")
_spoken("unit_us_temperature", "part", "p_partkey", "concat(p_size, '°F ', p_size, '°C')", lambda t: units.speak_units(t, "en-US"), "p_size || CASE WHEN p_size = 1 THEN ' degree ' ELSE ' degrees ' END || p_size || CASE WHEN p_size = 1 THEN ' degree Celsius' ELSE ' degrees Celsius' END")
_spoken("unit_grouped", "part", "p_partkey", "concat(p_size, '.000W')", lambda t: units.speak_units(t, "de"), "p_size || '.000W'")

# Rules, tags and lines over whole texts.
_spoken("rules_literal", "documents", "doc_id", "text", lambda t: rules.apply_rule(t, rules.Rule("the", "THE")), r"replace(text, 'the', 'THE')")
_spoken("rules_ci", "part", "p_partkey", "p_name", lambda t: rules.apply_rule(t, rules.Rule("a", "$1", ignore_case=True)), r"regexp_replace(p_name, 'a', '$1', 'gi')")
_spoken("rules_regex", "part", "p_partkey", "p_name", lambda t: rules.apply_rule(t, rules.Rule(r"(\w+) (\w+)", r"\2 \1", "regex")), r"regexp_replace(p_name, '(\w+) (\w+)', '\2 \1', 'g')")
_spoken("tags_opaque", "part", "p_partkey", "concat('[', p_size, 'W] ', p_size, 'W')", lambda t: units.speak_units(t, "de"), "'[' || p_size || 'W] ' || p_size || ' Watt'")
_spoken("join_lines", "conversations", "concat(conv_id, '-', turn)", "text", rules.join_lines, r"regexp_replace(text, '[ \t]*[\r\n]+([ \t]*[\r\n]+)*[ \t]*', ' ', 'g')")

# Markdown built from columns.
_spoken("md_headings", "part", "p_partkey", r"concat('## ', p_size, ' ##\nbody')", markdown.headings, "p_size || chr(10) || 'body'")
_spoken("md_list_markers", "part", "p_partkey", r"concat('- [x] ', p_size, '\n', p_size, '. b')", markdown.list_markers, "p_size || chr(10) || 'b'")
_spoken("md_tables", "part", "p_partkey", r"concat('| Size | Key |\n| --- | --- |\n| ', p_size, ' | ', p_partkey, ' |')", markdown.tables, "'Size. Key.' || chr(10) || p_size || '. ' || p_partkey || '.'")
_spoken("md_links", "part", "p_partkey", "concat('[', p_size, '](https://x.y/', p_size, ')')", markdown.links, "p_size::VARCHAR")
_spoken("md_images", "part", "p_partkey", "concat('![', p_size, '](https://x.y/', p_size, ')')", markdown.images, "p_size::VARCHAR")
_spoken("md_emphasis", "part", "p_partkey", "concat('**', p_size, '** _b_')", markdown.emphasis, "p_size || ' b'")
_spoken("md_code", "part", "p_partkey", "concat('`', p_size, '` ~~x~~')", lambda t: markdown.strikethrough(markdown.inline_code(t)), "p_size || ' x'")
_spoken("md_dividers", "part", "p_partkey", r"concat(p_size, '\n***\n- - -')", markdown.dividers, "p_size::VARCHAR")
_spoken("md_blockquotes", "part", "p_partkey", r"concat('> ', p_size)", markdown.blockquotes, "p_size::VARCHAR")
_spoken("md_code_blocks", "part", "p_partkey", r"concat(p_size, '\n```\ncode\n```\nend')", markdown.code_blocks, "p_size || chr(10) || 'end'")
_spoken("md_clean_guarded", "part", "p_partkey", r"concat('# **', p_size, '** [*w*]\n```\n# *', p_partkey, '*\n```\n- [x] <a *b*> _c_')", markdown.clean_markdown, "p_size || ' [*w*]' || chr(10) || '```' || chr(10) || '# *' || p_partkey || '*' || chr(10) || '```' || chr(10) || '<a *b*> c'")
_spoken("md_clean_code_removed", "part", "p_partkey", r"concat(p_size, '\n~~~\n*code*\n~~~\nsee https://x.y/', p_partkey, ' *now*')", lambda t: markdown.clean_markdown(t, remove_code=True, remove_urls=True), "p_size || chr(10) || 'see  now'")
_spoken("rules_python_condition", "part", "p_partkey", "concat('(', p_size, ') [(', p_size, ')] ', p_name)", lambda t: rules.apply_rule(t, rules.Rule(r"(\()?\b(\d+)(?(1)\))", r"size \2", "regex")), "'size ' || p_size || ' [(' || p_size || ')] ' || p_name")
_spoken("md_plain_urls", "part", "p_partkey", "concat('see https://x.y/', p_size, ' now')", markdown.plain_urls, "'see  now'")

# Emoji.
_spoken("emoji_remove", "part", "p_partkey", "concat('A ', p_size, ' 🔥 B')", emoji.remove_emoji, "'A ' || p_size || ' B'")
_spoken("emoji_spell", "part", "p_partkey", "concat('Wert ', p_size, ' 🔥👍')", lambda t: emoji.spell_emoji(t, "de"), "'Wert ' || p_size || ', feuer, thumbs up'")

def _vocabulary(spark: SparkSession) -> DataFrame:
    """The built-in names and a language of its own, in the raw form that emoji tables have."""
    own = [("🔥", "nl", ":vuur:"), ("👩‍💻", "nl", ":vrouwelijke_programmeur:"), ("🇳🇱", "nl", ":vlag_Nederland:"), ("☁️", "nl", ":wolk:")]
    return emoji.emoji_names(spark).unionByName(spark.createDataFrame(own, "seq string, lang string, name string"))


_SIGNS = "CASE p_size % 5 WHEN 0 THEN '🔥' WHEN 1 THEN '👩‍💻' WHEN 2 THEN '🇳🇱' WHEN 3 THEN '☁️' ELSE '🚀' END"
_SPOKEN_SIGNS = "CASE p_size % 5 WHEN 0 THEN 'vuur' WHEN 1 THEN 'vrouwelijke programmeur' WHEN 2 THEN 'vlag Nederland' WHEN 3 THEN 'wolk' ELSE 'rocket' END"
_QUERIES["emoji_vocabulary"] = lambda spark, sf_dir: _written(spark, sf_dir, "part", "p_partkey", f"concat('Maat ', p_size, ' ', {_SIGNS}, '!')").select("id", emoji.spell_emoji(F.col("text"), "nl", emoji.names_of(_vocabulary(spark), "nl")).alias("spoken"))
_SQL["emoji_vocabulary"] = f"SELECT p_partkey AS id, 'Maat ' || p_size || ', ' || {_SPOKEN_SIGNS} || '!' AS spoken FROM part"
_QUERIES["emoji_named"] = lambda spark, sf_dir: emoji.named(_table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_size % 3 WHEN 0 THEN '🔥' WHEN 1 THEN '🚀' ELSE '⛺x' END").alias("seq")), emoji.emoji_names(spark), "de")
_SQL["emoji_named"] = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '🔥' WHEN 1 THEN '🚀' ELSE '⛺x' END AS seq, CASE p_size % 3 WHEN 0 THEN 'feuer' WHEN 1 THEN 'rakete' END AS name FROM part"
_spoken("emoji_joined", "part", "p_partkey", "concat(p_size, ' 👩‍💻 👩🏽‍🚒 x')", lambda t: emoji.spell_emoji(t, "en"), "p_size || ', woman personal computer, woman medium skin tone fire engine, x'")

# More of the rules, beyond one sentence each: wide values, all of a century's years, vetoes, rejected forms.
_BIG = "(o_orderkey * 99991 % 1000000000)"
_spoken("number_wide_en", "orders", "o_orderkey", f"concat('n ', {_BIG}, ' and ', {_BIG} % 1000, ' or ', {_BIG} % 1000000)", lambda t: numbers.speak_numbers(t, "en"),
        f"'n ' || {O.en_number(_BIG)} || ' and ' || {O.en_number(f'({_BIG} % 1000)')} || ' or ' || {O.en_number(f'({_BIG} % 1000000)')}")
_spoken("number_wide_de", "orders", "o_orderkey", f"concat('n ', {_BIG}, ' und ', {_BIG} % 1000, ' oder ', {_BIG} % 1000000)", lambda t: numbers.speak_numbers(t, "de"),
        f"'n ' || {O.de_number(_BIG)} || ' und ' || {O.de_number(f'({_BIG} % 1000)')} || ' oder ' || {O.de_number(f'({_BIG} % 1000000)')}")
_spoken("number_digits_left_alone", "part", "p_partkey", "concat('n ', 1000000000 + p_size, ' ', p_size, '.1234567 ', '0,', p_size, ',', p_size)", lambda t: numbers.speak_numbers(t, "en"), "'n ' || (1000000000 + p_size) || ' ' || p_size || '.1234567 0,' || p_size || ',' || p_size")
_spoken("number_negative", "part", "p_partkey", "concat('-', p_size, ' −0 –00 -0,', p_size)", lambda t: numbers.speak_numbers(t, "de"),
        f"'minus ' || {O.de_below_100(_P)} || ' null minus null null minus null Komma ' || {O.spelled('rtrim(p_size::VARCHAR, chr(48))', O.DE_TO_19)}")
_spoken("number_grouped_forms", "part", "p_partkey", "concat(p_size, '.222.333 ', p_size, ' 222 ', p_size, '.222,5 ', p_size, ',222.5')", lambda t: numbers.speak_numbers(t, "de", True),
        f"{O.de_number('(p_size * 1000000 + 222333)')} || ' ' || {O.de_number('(p_size * 1000 + 222)')} || ' ' || {O.de_number('(p_size * 1000 + 222)')} || ' Komma fünf ' || {O.de_number('(p_size * 1000 + 222)')} || ' Komma fünf'")
_spoken("number_ambiguous", "part", "p_partkey", "concat(p_size, '.342 ', p_size, ',342')", lambda t: numbers.speak_numbers(t, "de", True), f"{O.de_number('(p_size * 1000 + 342)')} || ' ' || {O.de_below_100(_P)} || ' Komma drei vier zwei'")
_CENTURY = "(1900 + o_orderkey % 200)"
_spoken("years_en", "orders", "o_orderkey", f"concat('since ', {_CENTURY}, ', v', {_CENTURY}, '.1, port ', {_CENTURY}, ', ', {_CENTURY}, ' lux and ', {_CENTURY}, ' meters, PIN 5 ', {_CENTURY}, ', version 2.0, ', {_CENTURY})", lambda t: dates.speak_years(t, "en-US"),
        f"'since ' || {O.en_year(_CENTURY)} || ', v' || {_CENTURY} || '.1, port ' || {_CENTURY} || ', ' || {_CENTURY} || ' lux and ' || {_CENTURY} || ' meters, PIN 5 ' || {_CENTURY} || ', version 2.0, ' || {_CENTURY}")
_spoken("years_de", "orders", "o_orderkey", f"concat('Seit ', {_CENTURY}, ' und 1899 und 2100')", lambda t: dates.speak_years(t, "de-DE"), f"'Seit ' || {O.de_year(_CENTURY)} || ' und 1899 und 2100'")
_spoken("years_bounds", "orders", "o_orderkey", f"concat('in ', {_CENTURY}, '!')", lambda t: dates.speak_years(t, "en-US", 1950, 2050), f"'in ' || CASE WHEN {_CENTURY} BETWEEN 1950 AND 2050 THEN {O.en_year(_CENTURY)} ELSE {_CENTURY}::VARCHAR END || '!'")
_dated("month_name_de", "Am ", "d. MMMM yyyy", "en-US", ["dmy_month_name"], f"{_MONTH} || ' ' || {_DAY} || ' ' || {_YEAR}")
_dated("spaced_no_year_de", "der ", "d. M.", "de-DE", ["dmy_dot_spaced_no_year"], f"{_DE_DAY} || 'e ' || {_DE_MONTH}")
_dated("dmy_slash_no_year", "on ", "dd/MM", "en-GB", None, f"{_DAY} || ' of ' || {_MONTH}")
_dated("mdy_slash_no_year", "on ", "MM/dd", "en-US", None, f"{_MONTH} || ' ' || {_DAY}")
_dated("fallback_fr", "Date ", "dd.MM.yyyy", "fr-FR", ["dmy_dot"], f"{O.FR_DAY}[day(o_orderdate)] || ' ' || {O.FR_DAY}[month(o_orderdate)] || CASE WHEN year(o_orderdate) >= 2000 THEN ' deux mille' || CASE WHEN year(o_orderdate) = 2000 THEN '' ELSE ' ' || {O.FR_DAY}[year(o_orderdate) - 2000] END ELSE ' mille neuf cent ' || {O.FR_90S}[year(o_orderdate) - 1989] END")
_spoken("date_neighbours_left", "orders", "o_orderkey", "concat('am ', date_format(o_orderdate, 'dd.MM.'), ' ', date_format(o_orderdate, 'dd.MM.'), ' und am ', date_format(o_orderdate, 'dd.MM.'), ' bis ', date_format(o_orderdate, 'dd.MM.'))", lambda t: dates.speak_dates(t, "de-DE"),
        f"'am ' || strftime(o_orderdate, '%d.%m. %d.%m.') || ' und am ' || {_DE_DAY} || 'en ' || {_DE_MONTH} || ' bis ' || {_DE_DAY} || 'en ' || {_DE_MONTH} || '.'")
_spoken("date_dot_kept", "orders", "o_orderkey", r"concat('am ', date_format(o_orderdate, 'dd.MM.'), '\nab ', date_format(o_orderdate, 'dd.MM.'), ' Haus, vor ', date_format(o_orderdate, 'dd.MM.'), ' oder')", lambda t: dates.speak_dates(t, "de-DE"),
        f"'am ' || {_DE_DAY} || 'en ' || {_DE_MONTH} || '.' || chr(10) || 'ab ' || {_DE_DAY} || 'em ' || {_DE_MONTH} || '. Haus, vor ' || {_DE_DAY} || 'em ' || {_DE_MONTH} || ' oder'")
_spoken("date_invalid_left", "orders", "o_orderkey", "concat('31.02.', year(o_orderdate), ' 29.02.1900 30.02. x', date_format(o_orderdate, 'dd.MM.yyyy'), ' 29.02.2000')", lambda t: dates.speak_dates(t, "de-DE"),
        "'31.02.' || year(o_orderdate) || ' 29.02.1900 30.02. x' || strftime(o_orderdate, '%d.%m.%Y') || ' neunundzwanzigster Februar zweitausend'")
_spoken("clock_rejected", "events", "event_id", "concat('24:00 Uhr, ', date_format(ts, 'HH:mm:ss'), ' Uhr, 7:75, ', hour(ts), ':', minute(ts) % 10, ', 8:30 am, 1.', date_format(ts, 'HH:mm'), ' 25:00-26:00')", lambda t: times.speak_times(t, "de", durations=True),
        "'24:00 Uhr, ' || strftime(ts, '%H:%M:%S') || ' Uhr, 7:75, ' || hour(ts) || ':' || minute(ts) % 10 || ', 8:30 am, 1.' || strftime(ts, '%H:%M') || ' 25:00-26:00'")
_spoken("clock_half_days", "events", "event_id", "concat('at ', date_format(ts, 'h:mm'), CASE WHEN hour(ts) < 12 THEN ' am' ELSE ' p.m.' END, '!')", lambda t: times.speak_times(t, "en-US"),
        f"'at ' || {O.en_below_100(f'(({_H} + 11) % 12 + 1)')} || CASE WHEN {_M} = 0 THEN '' WHEN {_M} < 10 THEN ' oh ' || {O.en_below_100(_M)} ELSE ' ' || {O.en_below_100(_M)} END || CASE WHEN {_H} < 12 THEN ' AM!' ELSE ' PM!' END")
_spoken("unit_aliases", "part", "p_partkey", "concat(p_size, 'kwh ', p_size, ' HPA ', p_size, ' v ', p_size, 'V ', p_size, ' m/s, x', p_size, 'W')", lambda t: units.speak_units(t, "de"),
        "p_size || CASE WHEN p_size = 1 THEN ' Kilowattstunde ' ELSE ' Kilowattstunden ' END || p_size || ' Hektopascal ' || p_size || ' v ' || p_size || ' Volt ' || p_size || ' Meter pro Sekunde, x' || p_size || 'W'")
_spoken("emoji_skin_and_tags", "part", "p_partkey", "concat('<a 🔥> ', p_size, ' 👍🏽! 1️⃣')", lambda t: emoji.spell_emoji(t, "en"), "'<a 🔥> ' || p_size || ', thumbs up medium skin tone!, keycap 1'")
_spoken("documents_left_alone", "documents", "doc_id", "text", lambda t: emoji.remove_emoji(times.speak_times(dates.speak_dates(t, "en-US", ["mdy_slash", "ymd_dash", "dmy_dot"]), "en-US", durations=True)), "text")


# The whole chain.
_GERMAN = Profile("de-DE", dates=True, times=True, units=True, numbers=True, lines=True)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(r"concat('Termin ', date_format(o_orderdate, 'dd.MM.yyyy'), '\n um 13:40 Uhr mit 30W.')").alias("text")
    return spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text))


_FULL = f"SELECT o_orderkey AS id, 'Termin ' || {_DE_DAY} || 'er ' || {_DE_MONTH} || ' ' || {_DE_YEAR} || ' um dreizehn Uhr vierzig mit dreißig Watt.' AS text FROM orders"
_QUERIES["normalize_full"] = lambda spark, sf_dir: normalize(_sentences(spark, sf_dir), _GERMAN)
_QUERIES["normalize_distinct"] = lambda spark, sf_dir: normalize_distinct(_sentences(spark, sf_dir), _GERMAN)
_SQL["normalize_full"] = _SQL["normalize_distinct"] = _FULL


# Tokens of every stage in one text, those that are looked at one by one and those that the stages must do.
_TOKENS = Profile("de-DE", dates=True, years=True, times=True, units=True, numbers=True)


def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sentences with dates, times, measurements, years and numbers; every third with a date that none of it is."""
    date = "date_format(o_orderdate, 'dd.MM.yyyy')"
    text = F.expr(f"concat('Ab ', {date}, ' sind ', o_orderkey % 50 + 2, ' kWh und ', o_orderkey % 50, ', ', o_orderkey % 50 + 1, ' im Jahr ', year(o_orderdate), ' von 8:00 bis 9:30 da', CASE WHEN o_orderkey % 3 = 0 THEN ' x1.2.3' ELSE '' END)")
    return normalize(spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))), _TOKENS)


_K = "o_orderkey % 50"
_QUERIES["normalize_tokens"] = normalize_tokens
_SQL["normalize_tokens"] = f"SELECT o_orderkey AS id, 'Ab ' || {_DE_DAY} || 'em ' || {_DE_MONTH} || ' ' || {_DE_YEAR} || ' sind ' || {O.de_below_100(f'({_K} + 2)')} || ' Kilowattstunden und ' || {O.de_below_100(f'({_K})')} || ', ' || {O.de_below_100(f'({_K} + 1)')} || ' im Jahr ' || {_DE_YEAR} || ' von acht Uhr bis neun Uhr dreißig da' || CASE WHEN o_orderkey % 3 = 0 THEN ' x1.2.3' ELSE '' END AS text FROM orders"


# Audits.
_QUERIES["rule_hits"] = lambda spark, sf_dir: rules.rule_hits(_table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), [rules.Rule("a", "e"), rules.Rule("e", "i")])
_SQL["rule_hits"] = "SELECT 1 AS rule_no, sum(length(p_name) - length(replace(p_name, 'a', '')))::BIGINT AS hits FROM part UNION ALL SELECT 2, sum(length(p_name) - length(replace(replace(p_name, 'a', 'e'), 'e', '')))::BIGINT FROM part"
_QUERIES["extract_tags"] = lambda spark, sf_dir: rules.extract_tags(_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id").groupBy("page_id").agg(F.count("*").alias("n_tags"))
_SQL["extract_tags"] = r"SELECT page_id, len(regexp_extract_all(html, '<[^>]*>|\[[^\]]*\]'))::BIGINT AS n_tags FROM pages WHERE len(regexp_extract_all(html, '<[^>]*>|\[[^\]]*\]')) > 0"


def token_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric tokens by language, source and kind, with subtotals."""
    return extract.token_rollup(spread(_table(spark, sf_dir, "documents").select("lang", "source", "text")), "de", ["lang", "source"])


_QUERIES["token_counts_rollup"] = token_counts_rollup
_SQL["token_counts_rollup"] = f"WITH {O.TOKENS_SQL} SELECT lang, source, kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM kinds GROUP BY ROLLUP (lang, source, kind)"
_QUERIES["ipv4_tokens"] = lambda spark, sf_dir: _written(spark, sf_dir, "part", "p_partkey", "concat_ws('.', p_size, p_size * 6, '0', '255')").select("id", numbers.is_ipv4(F.col("text")).alias("address"))
_SQL["ipv4_tokens"] = "SELECT p_partkey AS id, p_size * 6 <= 255 AS address FROM part"


def change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of texts that joining lines alters, by role."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum((rules.join_lines(F.col("text")) != F.col("text")).cast("long")).alias("changed"))


_QUERIES["change_rate"] = change_rate
_QUERIES["change_rate_by_stage"] = lambda spark, sf_dir: change_rates(_table(spark, sf_dir, "conversations"), Profile("en-US", (rules.Rule("the", "THE"), rules.Rule("THE", "tHe")), lines=True, emoji="remove"), "role")
_SQL["change_rate_by_stage"] = r"SELECT role, stage, count(*) AS n, sum(CASE WHEN stage = 'lines' THEN regexp_matches(text, '[\r\n]') WHEN stage = 'rule1' THEN contains(replace(text, 'the', 'THE'), 'THE') WHEN stage = 'rule0' THEN contains(text, 'the') ELSE false END::BIGINT)::BIGINT AS changed FROM conversations, (VALUES ('rule0'), ('rule1'), ('lines'), ('emoji')) AS v(stage) GROUP BY role, stage"
_SQL["change_rate"] = r"SELECT role, count(*) AS n, sum(regexp_matches(text, '[\r\n]')::BIGINT)::BIGINT AS changed FROM conversations GROUP BY role"


def unsupported_lang_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a language without words of our own."""
    known = spark.createDataFrame([(x,) for x in CARDINAL], "lang string")
    return _table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(known), "lang", "left_anti")


_QUERIES["unsupported_lang_anti"] = unsupported_lang_anti
_SQL["unsupported_lang_anti"] = "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es') OR lang IS NULL"


def reassemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


_QUERIES["reassemble_chunks"] = reassemble_chunks
_SQL["reassemble_chunks"] = "SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, text), '') AS text FROM conversations GROUP BY conv_id"


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).cast("long").alias("upto"))


_QUERIES["chunk_offsets"] = chunk_offsets
_SQL["chunk_offsets"] = "SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM conversations"


# Segments: the turns of a conversation are the chunks of a stream. Cuts have no SQL form; what the segments join to has.
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    seq = turns.select(F.col("conv_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("text").alias("chunk"), F.lead("turn").over(w).isNull().alias("is_last"))
    # A day after the epoch: a watermark starts at the epoch, and rows at or before it count as late.
    return seq.withColumn("ts", F.timestamp_seconds(F.col("seq") + 86400))


def _rejoined(segments: DataFrame) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("seg_no", "segment")))
    return segments.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))


def segments_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut by a checkpointed stream that runs until its input is read."""
    folder = work_folder(spark)
    _chunks(spark, sf_dir).write.parquet(f"{folder}/chunks")
    run = write_segments(cut_stream(read_chunks(spark, f"{folder}/chunks")), f"{folder}/segments", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return _rejoined(spark.read.schema("stream_id long, seg_no long, segment string, late boolean").parquet(f"{folder}/segments").filter("not late"))


_QUERIES["segments_cut"] = lambda spark, sf_dir: cut_segments(_chunks(spark, sf_dir))
_QUERIES["segments_rejoined"] = lambda spark, sf_dir: _rejoined(cut_segments(_chunks(spark, sf_dir)))
_QUERIES["segments_streamed"] = segments_streamed
_SQL["segments_rejoined"] = _SQL["segments_streamed"] = "SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id HAVING string_agg(text, '') <> ''"


# Segments normalised before they are joined again, in a table and in a stream: one rule, which no cut at white space divides.
_LOUD = Profile("en-US", (rules.Rule("the", "THE"),))
_QUERIES["segments_normalized"] = lambda spark, sf_dir: _rejoined(normalize(cut_segments(_chunks(spark, sf_dir)), _LOUD, "segment"))


def segments_streamed_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpointed stream that cuts segments and normalises each as it is cut."""
    folder = work_folder(spark)
    _chunks(spark, sf_dir).write.parquet(f"{folder}/chunks")
    spoken = normalize(cut_stream(read_chunks(spark, f"{folder}/chunks")), _LOUD, "segment")
    run = write_segments(spoken, f"{folder}/segments", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return _rejoined(spark.read.schema("stream_id long, seg_no long, segment string, late boolean").parquet(f"{folder}/segments").filter("not late"))


_QUERIES["segments_streamed_normalized"] = segments_streamed_normalized
_QUERIES["reassembled_normalized"] = lambda spark, sf_dir: normalize(reassemble_chunks(spark, sf_dir), _LOUD)
_SQL["segments_normalized"] = _SQL["segments_streamed_normalized"] = _SQL["segments_rejoined"].replace("string_agg(text, '' ORDER BY turn, text) AS text", "replace(string_agg(text, '' ORDER BY turn, text), 'the', 'THE') AS text")
_SQL["reassembled_normalized"] = "SELECT conv_id, replace(coalesce(string_agg(text, '' ORDER BY turn, text), ''), 'the', 'THE') AS text FROM conversations GROUP BY conv_id"


def segments_streamed_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sentences a part, sent in three chunks that divide a date: segments as cut, each spoken under a full profile."""
    folder, size = work_folder(spark), "cast(p_size as string)"
    text = f"concat('Am 14.05.2026 wurden ', {size}, ' kWh gemessen. Danach um 13:40 Uhr waren es ', {size}, '°C bei gutem Wetter und leichtem Wind aus dem Westen und ohne Regen.')"
    whole = spread(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream_id"), F.expr(text).alias("t")))
    chunk = "CASE seq WHEN 0 THEN substr(t, 1, 7) WHEN 1 THEN substr(t, 8, 30) ELSE substr(t, 38) END"
    rows = whole.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr("stream_id", "cast(seq as long) AS seq", f"{chunk} AS chunk", "seq = 2 AS is_last", "timestamp_seconds(seq + 86400) AS ts")
    rows.write.parquet(f"{folder}/chunks")
    spoken = normalize(cut_stream(read_chunks(spark, f"{folder}/chunks")), _TOKENS, "segment")
    write_segments(spoken, f"{folder}/segments", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id long, seg_no long, segment string, late boolean").parquet(f"{folder}/segments").filter("not late").drop("late")


_QUERIES["segments_streamed_spoken"] = segments_streamed_spoken
_SQL["segments_streamed_spoken"] = f"SELECT p_partkey AS stream_id, k::BIGINT AS seg_no, CASE k WHEN 0 THEN 'Am vierzehnten Mai zweitausendsechsundzwanzig wurden ' || {O.de_below_100(_P)} || CASE WHEN p_size = 1 THEN ' Kilowattstunde' ELSE ' Kilowattstunden' END || ' gemessen. ' ELSE 'Danach um dreizehn Uhr vierzig waren es ' || {O.de_below_100(_P)} || ' Grad bei gutem Wetter und leichtem Wind aus dem Westen und ohne Regen.' END AS segment FROM part, (VALUES (0), (1)) AS v(k)"


# Token tables; sentences are written from columns, and the SQL takes the same columns.
def _written(spark: SparkSession, sf_dir: str, table: str, key: str, sentence: str) -> DataFrame:
    return spread(_table(spark, sf_dir, table).select(F.expr(key).alias("id"), F.expr(sentence).alias("text")))


_QUERIES["extract_numbers"] = lambda spark, sf_dir: extract.extract_numbers(_written(spark, sf_dir, "part", "p_partkey", "concat('a ', p_size, ' b 0', p_size, ' v', p_size, ' ', p_size, ',5')"), "id", "de").withColumn("value", F.col("value").cast("double"))
_SQL["extract_numbers"] = "SELECT id, pos::INTEGER AS pos, token, kind, reason, value FROM (" + " UNION ALL ".join(f"SELECT p_partkey AS id, {k} AS pos, {t} AS token, '{kind}' AS kind, {why}::VARCHAR AS reason, {v}::DOUBLE AS value FROM part" for k, t, kind, why, v in (
    (0, "p_size::VARCHAR", "integer", "NULL", "p_size"), (1, "'0' || p_size", "digits", "NULL", "p_size"), (2, "p_size::VARCHAR", "rejected", "'boundary'", "NULL"), (3, "p_size || ',5'", "decimal", "NULL", "p_size + 0.5"))) + ")"
_QUERIES["extract_measurements"] = lambda spark, sf_dir: extract.extract_measurements(_written(spark, sf_dir, "part", "p_partkey", "concat(p_size, 'kWh und ', p_size, ' °C')"), "id", "de").groupBy("unit").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))
_SQL["extract_measurements"] = "SELECT unit, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part, (VALUES ('kilowatt_hour'), ('celsius')) AS u(unit) GROUP BY unit"
_QUERIES["extract_dates"] = lambda spark, sf_dir: extract.extract_dates(_written(spark, sf_dir, "orders", "o_orderkey", "concat('am ', date_format(o_orderdate, 'dd.MM.yyyy'), ' und ', date_format(o_orderdate, 'yyyy-MM-dd'))"), "id", "de-DE")
_SQL["extract_dates"] = "SELECT o_orderkey AS id, f AS format, 0::INTEGER AS pos, CASE f WHEN 'dmy_dot' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS token, day(o_orderdate)::INTEGER AS day, month(o_orderdate)::INTEGER AS month, year(o_orderdate)::INTEGER AS year FROM orders, (VALUES ('dmy_dot'), ('ymd_dash')) AS v(f)"
_QUERIES["extract_times"] = lambda spark, sf_dir: extract.extract_times(_written(spark, sf_dir, "events", "event_id", "concat(date_format(ts, 'HH:mm'), ' und ', date_format(ts, 'HH:mm:ss'), ' 10.', date_format(ts, 'HH:mm'))"), "id", "de")
_SQL["extract_times"] = "SELECT event_id AS id, p::INTEGER AS pos, CASE p WHEN 1 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M') END AS token, kind, ok AS accepted FROM events, (VALUES (0, 'clock', true), (1, 'duration', true), (2, 'clock', false)) AS v(p, kind, ok)"
_QUERIES["tokens_left_alone"] = lambda spark, sf_dir: extract.left_alone(extract.extract_numbers(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "de"), 20)
_SQL["tokens_left_alone"] = f"WITH {O.TOKENS_SQL} SELECT token, count(*) AS n FROM kinds WHERE kind = 'rejected' GROUP BY token ORDER BY n DESC, token LIMIT 20"
_QUERIES["neighbour_tokens"] = lambda spark, sf_dir: extract.neighbours(extract.extract_measurements(_written(spark, sf_dir, "part", "p_partkey", "concat(p_size, 'W und ', p_size, ' V')"), "id", "de"), "id").select("id", "pos", "previous", "next")
_SQL["neighbour_tokens"] = "SELECT p_partkey AS id, k::INTEGER AS pos, CASE k WHEN 1 THEN p_size || 'W' END AS previous, CASE k WHEN 0 THEN p_size || ' V' END AS next FROM part, (VALUES (0), (1)) AS v(k)"


# Messages by the profile of their language; configuration rows are checked first.
def messages_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(lang, {"language": {"output_language": lang}, "rules": [{"find": a, "replace": a.upper(), "case_sensitive": True}]}, {}) for lang, a in (("en", "the"), ("de", "und"))]
    known = profiles_by_name(validate_profiles(canonical_profiles(load_profiles(profile_rows(spark, rows)))))
    return normalize_by_profile(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), known)


_QUERIES["messages_by_profile"] = messages_by_profile
_SQL["messages_by_profile"] = "SELECT doc_id, lang, CASE lang WHEN 'en' THEN replace(text, 'the', 'THE') WHEN 'de' THEN replace(text, 'und', 'UND') ELSE text END AS text FROM documents"


def profile_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by a profile with a locale of its own for each stage, and bounds for its years."""
    data = {"output_language": "en-US", "date": {"date_enabled": True, "date_locale": "de-DE", "standalone_years": True, "year_max": 2300}, "time": {"time_enabled": True, "time_locale": "de"}, "number": {"number_enabled": True, "number_language": "fr"}}
    known = profiles_by_name(validate_profiles(canonical_profiles(load_profiles(profile_rows(spark, [("x", data, {})])))))
    rows = _written(spark, sf_dir, "orders", "o_orderkey", "concat('am ', date_format(o_orderdate, 'dd.MM.yyyy'), ' um 13:40 Uhr, 2250, ', o_orderkey % 31 + 1)").withColumn("lang", F.lit("x"))
    return normalize_by_profile(rows, known).select("id", "text")


_QUERIES["profile_locales"] = profile_locales
_SQL["profile_locales"] = f"SELECT o_orderkey AS id, 'am ' || {_DE_DAY} || 'en ' || {_DE_MONTH} || ' ' || {_DE_YEAR} || ' um dreizehn Uhr vierzig, zweitausendzweihundertfünfzig, ' || {O.FR_DAY}[o_orderkey % 31 + 1] AS text FROM orders"


def profiles_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a profile for each part: buffers, rules, languages and bounds taken from its size."""
    size = F.col("p_size")
    data = F.to_json(
        F.struct(
            F.when(size % 10 != 1, F.lit("en-US")).alias("output_language"), F.when(size % 10 == 0, size).alias("safety_tail_chars"), F.when(size % 10 == 0, size).alias("max_buffer_chars"),
            F.when(size % 10 == 2, F.array(F.struct(F.lit("odd").alias("mode"), F.lit("a").alias("find")))).alias("rules"), (size % 10 == 3).alias("emoji_enabled"), F.lit("sing").alias("emoji_handling"),
            (size % 10).isin(4, 5, 9).alias("date_enabled"), F.when(size % 10 == 4, "xx").when(size % 10 == 9, "fr-FR").alias("date_locale"), F.when(size % 10 == 5, F.array(F.lit("ymd"))).alias("date_formats"),
            (size % 10 == 6).alias("time_enabled"), F.lit("fr").alias("time_locale"), (size % 10 == 7).alias("number_enabled"), F.lit("xx").alias("number_language"),
        )
    )
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("profile"), data.alias("data"), F.lit("{}").alias("options"))
    return validate_profiles(canonical_profiles(load_profiles(rows))).select("profile", "error")


_QUERIES["profiles_invalid"] = profiles_invalid
_SQL["profiles_invalid"] = "SELECT p_partkey::VARCHAR AS profile, CASE p_size % 10 WHEN 0 THEN 'invalid_buffer_config' WHEN 1 THEN 'invalid_buffer_config' WHEN 2 THEN 'invalid_rule' WHEN 3 THEN 'invalid_emoji_normalizer' WHEN 4 THEN 'invalid_date_normalizer' WHEN 5 THEN 'invalid_date_normalizer' WHEN 6 THEN 'invalid_time_normalizer' WHEN 7 THEN 'invalid_number_normalizer' END AS error FROM part"
def rules_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unusable rules of a profile for each part, three rules each; beside the first is one for the whole profile."""
    size = F.col("p_size")
    first = F.when(size % 5 == 0, "(a").when(size % 5 == 1, "[b").otherwise("(?P<n>c)(?P=n)")
    rule = lambda mode, find: F.struct(mode.alias("mode"), find.alias("find"))
    each = F.array(rule(F.lit("regex"), first), rule(F.when(size % 5 == 2, "odd").otherwise("literal"), F.lit("(a")), rule(F.lit("regex"), F.when(size % 5 == 3, "").otherwise("x{,3}")))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("profile"), F.to_json(F.struct(F.lit("en-US").alias("output_language"), each.alias("rules"))).alias("data"), F.lit("{}").alias("options"))
    bad = invalid_rules(canonical_profiles(load_profiles(rows)))
    return bad.select("profile", "rule_no", "find", F.regexp_extract("error", r"^\w+", 0).alias("error"))


_QUERIES["rules_invalid"] = rules_invalid
_SQL["rules_invalid"] = "SELECT p_partkey::VARCHAR AS profile, CASE p_size % 5 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END::INTEGER AS rule_no, CASE p_size % 5 WHEN 0 THEN '(a' WHEN 1 THEN '[b' WHEN 2 THEN '(a' ELSE '' END AS find, CASE p_size % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unterminated' WHEN 2 THEN 'unknown' ELSE 'nothing' END AS error FROM part WHERE p_size % 5 < 4"
_QUERIES["documents_by_stage_support"] = lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(supported_locales(spark)).withColumnRenamed("locale", "lang"), "lang").groupBy("lang").agg(F.countDistinct("stage").alias("stages"), F.countDistinct("doc_id").alias("docs"))
_SQL["documents_by_stage_support"] = "SELECT lang, CASE WHEN lang IN ('de', 'en') THEN 4 ELSE 2 END::BIGINT AS stages, count(DISTINCT doc_id) AS docs FROM documents WHERE lang IN ('de', 'en', 'fr', 'es') GROUP BY lang"
_QUERIES["preview_rejected"] = lambda spark, sf_dir: preview_rejected(_table(spark, sf_dir, "documents"), "doc_id")
_SQL["preview_rejected"] = "SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents WHERE length(text) > 2000"
_QUERIES["preview"] = lambda spark, sf_dir: preview(_table(spark, sf_dir, "documents"), Profile("en-US", lines=True), 20, "doc_id")
_SQL["preview"] = r"SELECT doc_id, text AS before, regexp_replace(text, '[ \t]*[\r\n]+([ \t]*[\r\n]+)*[ \t]*', ' ', 'g') AS after FROM documents WHERE length(text) <= 2000 ORDER BY doc_id LIMIT 20"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by spoken due date."""
    spoken = _QUERIES["date_mdy_us"](spark, sf_dir)
    return spoken.groupBy("spoken").agg(F.count("*").alias("n_orders"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
