"""Golden cases of the speech-text operators: input and exact output, must-not-change cases included."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import dates, emoji, markdown, numbers, rules, times, units

CASES = []


def chk(name, say, cases):
    CASES.append(pytest.param(say, cases, id=name))


chk("num de",lambda x:numbers.speak_numbers(x,"de"),[("Wert 123 und -5.","Wert einhundertdreiundzwanzig und minus fünf."),("53.4 53,4","dreiundfünfzig Komma vier dreiundfünfzig Komma vier"),("007 -09","null null sieben minus null neun"),("192.168.1.1 v2.1.3 1:20 ESP32 sensor_007 1,2,3","192.168.1.1 v2.1.3 1:20 ESP32 sensor_007 1,2,3"),("<a 5> 7","<a 5> sieben"),("07.70","sieben Komma sieben"),("1 234","1 234"),("1,000","eins"),(None,None),("1001000","eine Million eintausend")])
chk("num gr",lambda x:numbers.speak_numbers(x,"de",True),[("20.222,2","zwanzigtausendzweihundertzweiundzwanzig Komma zwei"),("1 234","eintausendzweihundertvierunddreißig"),("1.342","eintausenddreihundertzweiundvierzig"),("1,342","eins Komma drei vier zwei"),("20,222.2","zwanzigtausendzweihundertzweiundzwanzig Komma zwei")])
chk("num en",lambda x:numbers.speak_numbers(x,"en"),[("1234 105 42","one thousand, two hundred and thirty-four one hundred and five forty-two"),("1.50","one point five")])
chk("date us",lambda x:dates.speak_dates(x,"en-US"),[("on 03/15/2026.","on March fifteenth twenty twenty-six."),("114.05.2026 13/15/2026","114.05.2026 13/15/2026"),("02/30/2024","02/30/2024")])
chk("date gb",lambda x:dates.speak_dates(x,"en-GB"),[("15/03/2026","fifteenth of March twenty twenty-six")])
chk("date de",lambda x:dates.speak_dates(x,"de-DE"),[("14.05.2026","vierzehnter Mai zweitausendsechsundzwanzig"),("am 14.05.2026","am vierzehnten Mai zweitausendsechsundzwanzig"),("ab 2026-05-14","ab vierzehntem Mai zweitausendsechsundzwanzig"),("23.05. 27.05.","23.05. 27.05."),("der 14.05.\n","der vierzehnte Mai.\n"),("14. 5. 1984","vierzehnter Mai neunzehnhundertvierundachtzig"),("114.05.2026","114.05.2026")])
chk("date name",lambda x:dates.speak_dates(x,"en-US",["mdy_month_name","dmy_month_name"]),[("May 5, 2021 and 3 june","May fifth twenty twenty-one and June third")])
chk("year",lambda x:dates.speak_dates(x,"en-US",[],True),[("in 1942, 1942 W PIN 1942 v2025.1 2005 in 2005","in nineteen forty-two, 1942 W PIN 1942 v2025.1 2005 in two thousand five")])
chk("clock de",lambda x:times.speak_times(x,"de"),[("13:40 Uhr","dreizehn Uhr vierzig"),("1:05 Uhr","ein Uhr fünf"),("24:00 Uhr 16:9 192.168.1.1:8123","24:00 Uhr 16:9 192.168.1.1:8123"),("14:30-15:30","vierzehn Uhr dreißig bis fünfzehn Uhr dreißig"),("13:40:05 Uhr","13:40:05 Uhr")])
chk("clock en",lambda x:times.speak_times(x,"en-US",durations=True),[("08:05","eight oh five"),("12:00 PM","twelve PM"),("2:30pm-3:30pm","two thirty PM to three thirty PM"),("02:01:05","two hours one minute five seconds"),("1:30h","one hour thirty minutes")])
chk("unit de",lambda x:units.speak_units(x,"de"),[("Temp 25°C und -5°F, Wolken 92%.","Temp 25 Grad und -5 Grad Fahrenheit, Wolken 92 Prozent."),("5m 25C sensor_30W 30Wert","5m 25C sensor_30W 30Wert"),("1.000W","1.000W")])
chk("unit en",lambda x:units.speak_units(x,"en-GB"),[("1kWh, 2kWh","1 kilowatt hour, 2 kilowatt hours"),("5 km/h","5 kilometers per hour"),("20°C 20°F","20 degrees 20 degrees Fahrenheit")])
chk("rules",lambda x:rules.apply_rule(x,rules.Rule("°C","Grad")),[("[23°C] 24°C","[23°C] 24Grad")])
chk("rx",lambda x:rules.apply_rule(x,rules.Rule(r"(\d+(?:,\d+)?) °C",r"\1 Grad","regex")),[("Temp ist 23,5 °C.","Temp ist 23,5 Grad.")])
chk("join",rules.join_lines,[("a \r\n\tb\rc\nd","a b c d")])
chk("md",markdown.clean_markdown,[("# Head\n\n- **a** _b_\n1. c\n> q\n***\n~~x~~ `y` [l](http://z) ![i](https://p)","Head\n\na b\nc\nq\nx y l i"),("| Tag | Höchst | Tiefst |\n| --- | --- | --- |\n| Mo | 1 | 2 |\nend","Tag. Höchst. Tiefst.\nMo. 1. 2.\nend")])
chk("md guard",markdown.clean_markdown,[("# H\n```\n# *a*\n```\n# *b*","H\n```\n# *a*\n```\nb"),("[whispers] **x** <say *y*> [*z*]\n- [x] t\n> [l](http://z)","[whispers] x <say *y*> [*z*]\nt\nl"),("a \ue000 *b* \ue0000\ue001","a \ue000 b \ue0000\ue001"),("see http://a_b_c <\n~~~\n<b> *x*","see http://a_b_c <\n~~~\n<b> *x*"),("",""),(None,None)])
chk("md remove",lambda x:markdown.clean_markdown(x,remove_code=True,remove_urls=True),[("a\n```\n*b*\n```\nc http://x.y/z d","a\nc  d")])
chk("rx python",lambda x:rules.apply_rule(x,rules.Rule(r"(?P<a_b>\w)(?P=a_b)",r"\g<a_b>2","regex")),[("aab [cc] dd","a2b [cc] d2"),("",""),(None,None)])
chk("rx condition",lambda x:rules.apply_rule(x,rules.Rule(r"(\()?x(?(1)\))",r"y","regex",True)),[("(X) x (x","y y (y")])
chk("rx class",lambda x:rules.apply_rule(x,rules.Rule(r"[[&]",r"\\-","regex")),[("a&b","a\\-b")])
chk("hits",lambda x:rules.count_hits(x,rules.Rule("ab","")).cast("string"),[("ab a<t>b ab","2"),("a[ab]b","0")])
chk("hits python",lambda x:rules.count_hits(x,rules.Rule(r"(.)(?(1)b|c)","","regex")).cast("string"),[("ab a<t>b ab","2")])
chk("emo",lambda x:emoji.spell_emoji(x,"de"),[("Super 😀🔥","Super, grinsendes gesicht, feuer"),("Gut 👍","Gut, thumbs up"),("3,5","3,5")])
chk("emr",emoji.remove_emoji,[("A 😀 B","A B")])


@pytest.mark.parametrize("say, cases", CASES)
def test_golden(spark, say, cases):
    rows = spark.createDataFrame(cases, "text string, want string").select("text", "want", say(F.col("text")).alias("got"))
    assert [(r.text, r.got) for r in rows.collect()] == [(r.text, r.want) for r in rows.collect()]


def test_rules_are_validated():
    assert [r.find for r in rules.load_rules([{"find": "a", "replace": "b"}])] == ["a"]
    for bad in ({"find": ""}, {"find": "(", "mode": "regex"}, {"find": "a", "mode": "x"}, "a"):
        with pytest.raises(ValueError, match="rule 2"):
            rules.load_rules([{"find": "a"}, bad])


def test_python_takes_only_what_java_cannot_say():
    own = [rules.Rule(f, r, "regex") for f, r in ((r"(\d+)\s*°C", r"\1 Grad"), (r"[^\]\[]+x", "y"), (r"(?P<n>a)|(?i:b)(?:c)", r"\g<n>"))]
    assert not any(map(rules.python_only, own)) and not rules.python_only(rules.Rule("(?(1)", "\\n"))


def test_queries_match_their_sql_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_written_sentences_are_dealt_over_all_cores(spark):
    """A table of a single file, however many rows it has, is not left to one task."""
    from lectern.plans import registry

    rows = registry._written(spark, "/root/testdata/sf0.01", "part", "p_partkey", "cast(p_size as string)")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 2000
