"""Profiles: overlay, canonical form, the first failing check, and messages by profile."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import rules
from lectern.plans.normalize import Profile
from lectern.plans.profiles import canonical_profiles, invalid_rules, load_profiles, normalize_by_profile, preview, profile_rows, profiles_by_name, validate_profiles

GOOD = {"language": {"output_language": " de_de "}, "number": {"number_enabled": True}, "preview_text": "x"}


def checked(spark, *rows):
    return validate_profiles(canonical_profiles(load_profiles(profile_rows(spark, list(rows)))))


def test_options_win_and_defaults_hold(spark):
    row = checked(spark, ("a", GOOD, {"buffer": {"max_buffer_chars": 90}, "rules": [{"find": "x", "ignore_case": False, "enabled": False}]})).first()
    assert (row.output_language, row.safety_tail_chars, row.max_buffer_chars, row.number_language, row.error) == ("de-DE", 64, 90, "de-DE", None)
    assert row.rules[0].asDict() == {"name": "", "mode": "literal", "find": "x", "replace": "", "case_sensitive": True, "disabled": True}


@pytest.mark.parametrize(
    "change, error",
    [({"max_buffer_chars": 64}, "invalid_buffer_config"), ({"rules": [{"find": ""}]}, "invalid_rule"), ({"rules": [{"find": "a", "mode": "x"}]}, "invalid_rule"),
     ({"date_enabled": True, "date_formats": ["odd"]}, "invalid_date_normalizer"), ({"date_enabled": True, "date_formats": []}, "invalid_date_normalizer"),
     ({"date_enabled": True, "standalone_years": True, "year_min": 2000, "year_max": 1999}, "invalid_date_normalizer"), ({"emoji_enabled": True, "emoji_handling": "x"}, "invalid_emoji_normalizer"),
     ({"time_enabled": True, "time_locale": "xx"}, "invalid_time_normalizer"), ({"number_language": "xx"}, "invalid_number_normalizer"),
     ({"max_buffer_chars": 1, "rules": [{"find": ""}]}, "invalid_buffer_config"), ({"date_enabled": True, "unit_enabled": True, "time_enabled": True}, None)],
)
def test_first_failing_check(spark, change, error):
    assert checked(spark, ("a", GOOD, change)).first().error == error


def test_broken_json_is_an_empty_profile(spark):
    rows = spark.createDataFrame([("a", "{", None)], "profile string, data string, options string")
    assert validate_profiles(canonical_profiles(load_profiles(rows))).first().error == "invalid_buffer_config"


def test_messages_by_profile(spark):
    known = profiles_by_name(checked(spark, ("de", GOOD, {}), ("en", {"output_language": "en-US", "number_enabled": True, "rules": [{"find": "A", "replace": "B"}]}, {}), ("bad", {}, {})))
    assert set(known) == {"de", "en"}
    rows = spark.createDataFrame([(1, "de", "a 2"), (2, "en", "a 2"), (3, "fr", "a 2"), (4, None, "2"), (5, "de", None)], "id long, lang string, text string")
    assert {r.id: r.text for r in normalize_by_profile(rows, known).collect()} == {1: "a zwei", 2: "B two", 3: "a 2", 4: "2", 5: None}


def test_a_bad_pattern_stops_its_own_profile_alone(spark):
    bad = {**GOOD, "rules": [{"find": "ok"}, {"find": "(", "mode": "regex"}, {"find": "[", "mode": "regex"}]}
    rows = canonical_profiles(load_profiles(profile_rows(spark, [("de", GOOD, {}), ("bad", bad, {}), ("none", {**GOOD, "rules": []}, {})])))
    assert set(profiles_by_name(validate_profiles(rows))) == {"de", "none"}
    assert [(r.profile, r.rule_no, r.find) for r in invalid_rules(rows).orderBy("rule_no").collect()] == [("bad", 2, "("), ("bad", 3, "[")]
    assert {r.profile: r.error for r in validate_profiles(rows).collect()} == {"de": None, "bad": "invalid_rule", "none": None}


def test_what_java_does_not_take_goes_to_python(spark):
    rule = rules.Rule("a{,2}b", "x", "regex")
    assert rules.python_only(rule) and not rules.python_only(rules.Rule("a{0,2}b", "x", "regex"))
    assert spark.createDataFrame([("aab b",)], "t string").select(rules.apply_rule(F.col("t"), rule)).first()[0] == "x x"


def test_markdown_switches(spark):
    some = {"markdown": {"markdown_enabled": True, "strip_emphasis": False, "remove_plain_urls": True}}
    known = profiles_by_name(checked(spark, ("all", {"output_language": "en", "markdown_enabled": True}, {}), ("some", {"output_language": "en"}, some)))
    assert (known["all"].markdown_skip, known["some"].markdown_skip, known["some"].remove_urls, known["some"].remove_code) == ((), ("emphasis",), True, False)
    rows = spark.createDataFrame([(1, "all", "# *a* http://x.y/z"), (2, "some", "# *a* http://x.y/z")], "id long, lang string, text string")
    assert {r.id: r.text for r in normalize_by_profile(rows, known).collect()} == {1: "a http://x.y/z", 2: "*a* "}


def test_preview_leaves_out_long_texts(spark):
    rows = spark.createDataFrame([(1, "x" * 2001), (2, "7"), (3, "8")], "id long, text string")
    assert [tuple(r) for r in preview(rows, Profile("en-US", numbers=True), 1, "id").collect()] == [(2, "7", "seven")]
