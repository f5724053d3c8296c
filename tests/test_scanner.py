"""The scanner against the stages one after the other, and whole sentences through all of them."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import dates, numbers, scanner
from lectern.plans.normalize import Profile, normalize, normalize_distinct

PARTS = (
    "14.05.2026|14.05.|14. 5. 2026|2026-05-14|05/14/2026|5/6|14. Mai|May 5, 2021|5 May 2020|3. März|1942|2025|007|-5|–12,5|1.342|1,000|1 234|12|3|30W|5 kWh|5 kWh-x|20°C|1%|"
    "13:40|13:40 Uhr|8:30 am|8:30 amx|14:30-15:30|8:00 bis 9:00|8:00 to 25:00|01:02:03|1:30h|1:30 h-|24:00|v2.1.3|192.168.1.1|sensor_30W|und|am|der|PIN|Version|Haus|W|meters|"
    "(|)|[b]|<i>|,|.|!|;|:|-|*|**|\n|  |1.|2)|a1|000|²|٣|"
).split("|")
APART = [" "] * 6 + [", ", " und ", ". ", "", "-", "/", ". Ein ", "\n"]
PROFILES = [
    scanner.Tokens("de-DE", ("dmy_dot", "dmy_dot_spaced", "dmy_dot_no_year", "dmy_month_name", "ymd_dash"), True, times="de", durations=True, units="de", unit_hint="de", numbers="de", number_hint="de"),
    scanner.Tokens("en-US", ("mdy_slash", "mdy_slash_no_year", "mdy_month_name", "dmy_month_name"), times="en-US", units="en-US", unit_hint="en", numbers="en", number_hint="en", grouped=True),
    scanner.Tokens(times="de", durations=True, units="de", unit_hint="de"),
]


@pytest.mark.parametrize("k", range(len(PROFILES)))
def test_scanner_equals_the_stages(spark, k):
    draw = random.Random(k)
    texts = ["".join(draw.choice(PARTS) + draw.choice(APART) for _ in range(draw.randrange(1, 9))) for _ in range(600)] + [None, "", "no digits <b> at all", "<5> 5 [6]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    both = scanner.speak_tokens(rows.withColumns({"a": F.col("t"), "b": F.col("t"), "fast": scanner.scanned(F.col("t"), PROFILES[k]).isNotNull() & F.col("t").rlike(r"\d")}), PROFILES[k], "a")
    for _, stage in scanner.in_order(PROFILES[k]):
        both = both.withColumn("b", stage(F.col("b")))
    got = both.collect()
    assert [(r.t, r.a) for r in got if r.a != r.b] == []
    assert sum(bool(r.fast) for r in got) > 60


ALL = Profile("de-DE", dates=True, years=True, times=True, durations=True, units=True, numbers=True)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Am 14.05.2026 um 13:40 Uhr mit 30W.", "Am vierzehnten Mai zweitausendsechsundzwanzig um dreizehn Uhr vierzig mit dreißig Watt."),
        ("am 14.05. und 14.05°C", "am vierzehnten Mai und vierzehn Komma null fünf Grad"), ("1, 2 und 3", "eins, zwei und drei"), ("PIN 5 1942", "PIN fünf eintausendneunhundertzweiundvierzig"),
        ("14:30-15:30, 1942 W, 1942", "vierzehn Uhr dreißig bis fünfzehn Uhr dreißig, eintausendneunhundertzweiundvierzig Watt, neunzehnhundertzweiundvierzig"),
    ],
)
def test_sentences(spark, text, want):
    rows = spark.createDataFrame([(text, "x")], "text string, _said string")
    assert [tuple(r) for r in normalize(rows, ALL).collect()] == [(want, "x")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("PIN 5 1942", "PIN 5 1942"), ("Version 2.0, 1942", "Version 2.0, 1942"), ("PIN 1234 1943", "PIN 1234 1943"), ("Port: 1942 in 1943", "Port: 1942 in nineteen forty-three"),
        ("PIN " + "1 " * 45 + "1942", "PIN " + "1 " * 45 + "nineteen forty-two"), ("PIN é 1942", "PIN é 1942"),
    ],
)
def test_identifiers_before_years(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(dates.speak_years(F.col("t"), "en-US")).first()[0] == want


@pytest.mark.parametrize("text, want", [("am (14.05.2026)", "am (vierzehnter"), ("am: 14.05.2026", "am: vierzehnter"), ("am \n 14.05.2026", "am \n vierzehnten"), ("Team 14.05.2026", "Team vierzehnter")])
def test_only_blanks_part_a_date_from_its_word(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(dates.speak_dates(F.col("t"), "de-DE")).first()[0].startswith(want)


def test_distinct_keeps_the_callers_columns(spark):
    rows = spark.createDataFrame([(i, f"{i % 3} W", "k", "s") for i in range(9)] + [(9, None, "k", "s")], "id long, text string, _text_key string, _text_said string")
    got = normalize_distinct(rows, Profile("en-US", units=True))
    assert got.columns == rows.columns
    assert {r.id: (r.text, r._text_key, r._text_said) for r in got.collect()} == {i: ("1 watt" if i % 3 == 1 else f"{i % 3} watts", "k", "s") for i in range(9)} | {9: (None, "k", "s")}


def test_a_sign_is_taken_off_without_a_search(spark):
    """It was searched for anew wherever the number behind it is asked for, four times for plain digits."""
    texts = {"-5": ["5", None], "−−5": None, "": None, "12,50": ["12", "50"], "–1.5": ["1", "5"], "0123456789": None, "-": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numbers.plain_number(F.col("t"), False, "de").alias("p"))
    assert {r.t: r.p for r in rows.collect()} == texts
    assert "regexp_replace" not in rows._jdf.queryExecution().analyzed().toString().lower()


@pytest.mark.parametrize("text, want", [("am 14.05.2026 \ue004 um 8:00", "am vierzehnten Mai zweitausendsechsundzwanzig \ue004 um acht Uhr"), ("\ue0045 W", "\ue004fünf Watt"), ("5 W, 7", "fünf Watt, sieben")])
def test_texts_that_hold_the_mark(spark, text, want):
    assert normalize(spark.createDataFrame([(text,)], "text string"), ALL).first()[0] == want
