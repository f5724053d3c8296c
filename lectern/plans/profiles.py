"""Profiles as a table: overlay, canonical form, validation, and messages normalised by their own profile.

A profile is a row (profile string, data string, options string) of two JSON objects; options win over
data, and sections inside either are laid flat. Profiles are configuration, a few rows a language; what is
done with messages is one scan whatever their number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.words import CARDINAL
from lectern.operators import rules
from lectern.operators.dates import CURATED, FORMATS, default_formats, normalize_locale
from lectern.plans.normalize import Profile, normalize, stages
from lectern.streaming.cutter import BUFFER, TAIL

PROFILES = "profile string, data string, options string"
#: Configuration rows up to which profiles are read to the driver.
MOST_PROFILES = 10_000
PREVIEW_CHARS = 2000
#: Regions of the languages with words for dates, or numbers, of their own.
REGIONS = {"de": ("AT", "CH", "DE"), "en": ("AU", "CA", "GB", "IE", "NZ", "US", "ZA"), "es": ("ES",), "fr": ("FR",)}
#: Switches of the Markdown steps, on unless set otherwise.
MARKDOWN_SWITCHES = {
    "remove_divider_lines": "dividers", "strip_headings": "headings", "strip_blockquotes": "blockquotes", "strip_list_markers": "list_markers", "strip_tables": "tables",
    "strip_images": "images", "strip_links": "links", "strip_inline_code": "inline_code", "strip_strikethrough": "strikethrough", "strip_emphasis": "emphasis",
}
#: The fields of a flat profile and what holds where they are absent.
FIELDS = {
    "output_language": "string", "safety_tail_chars": "int", "max_buffer_chars": "int", "markdown_enabled": "boolean", "replace_line_breaks": "boolean",
    "emoji_enabled": "boolean", "emoji_handling": "string", "emoji_language": "string", "date_enabled": "boolean", "date_locale": "string", "date_formats": "array<string>", "date_renderer": "string",
    "standalone_years": "boolean", "year_min": "int", "year_max": "int", "time_enabled": "boolean", "time_locale": "string", "clock_times": "boolean", "ranges": "boolean", "durations": "boolean",
    "unit_enabled": "boolean", "unit_locale": "string", "number_enabled": "boolean", "number_language": "string", "allow_grouped": "boolean",
    "remove_code_blocks": "boolean", "remove_plain_urls": "boolean", **dict.fromkeys(MARKDOWN_SWITCHES, "boolean"),
    "rules": "array<struct<name:string,mode:string,find:string,replace:string,case_sensitive:boolean,ignore_case:boolean,disabled:boolean,enabled:boolean>>",
}
DEFAULTS = {"safety_tail_chars": TAIL, "max_buffer_chars": BUFFER, "emoji_handling": "remove", "year_min": 1900, "year_max": 2099, "clock_times": True, "ranges": True, **dict.fromkeys(MARKDOWN_SWITCHES, True)}
SECTIONS = ("language", "buffer", "markdown", "cleanup", "emoji", "date", "time", "unit", "number", "rule")


def load_profiles(rows: DataFrame) -> DataFrame:
    """(profile, one column for each of FIELDS): options over data, sections laid flat, absent fields null.

    Broken JSON counts as an empty object; fields that are not known, such as preview text, go.
    """
    flat = ", ".join(f"{n}: {t}" for n, t in FIELDS.items())
    kind = f"struct<{flat}, " + ", ".join(f"{s}: struct<{flat}>" for s in SECTIONS) + ">"
    for side in ("data", "options"):
        rows = rows.withColumn(f"_{side}", F.from_json(side, kind))
    places = [f"_{side}{part}" for side in ("options", "data") for part in ("", *(f".{s}" for s in SECTIONS))]
    return rows.select("profile", *(F.coalesce(*(F.col(f"{p}.{n}") for p in places)).alias(n) for n in FIELDS))


def canonical_profiles(profiles: DataFrame) -> DataFrame:
    """Loaded profiles with defaults filled in, text trimmed, locales in one spelling, rules in one form."""
    def clean(name: str):
        return F.nullif(F.trim(name), F.lit(""))

    def locale(name: str):
        parts = F.split(F.translate(clean(name), "_", "-"), "-")
        return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p)), "-")

    out = profiles.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in DEFAULTS.items()})
    out = out.withColumns({n: F.coalesce(n, F.lit(False)) for n, t in FIELDS.items() if t == "boolean"})
    out = out.withColumns({"output_language": locale("output_language"), "number_language": locale("number_language")})
    for n in ("date_locale", "time_locale", "unit_locale"):
        out = out.withColumn(n, F.coalesce(locale(n), "output_language", "number_language"))
    out = out.withColumn("number_language", F.coalesce("number_language", "output_language"))
    own = F.split("date_locale", "-")[0].isin(*CURATED)
    out = out.withColumns({"date_renderer": F.coalesce(clean("date_renderer"), F.when(own, "curated").otherwise("numeric_fallback")), "emoji_language": clean("emoji_language")})

    def rule(r):
        return F.struct(
            F.coalesce(r["name"], F.lit("")).alias("name"), F.coalesce(r["mode"], F.lit("literal")).alias("mode"), F.coalesce(r["find"], F.lit("")).alias("find"), F.coalesce(r["replace"], F.lit("")).alias("replace"),
            F.coalesce(r["case_sensitive"], ~r["ignore_case"], F.lit(False)).alias("case_sensitive"), F.coalesce(r["disabled"], ~r["enabled"], F.lit(False)).alias("disabled"),
        )

    return out.withColumn("rules", F.transform(F.coalesce("rules", F.array().cast(FIELDS["rules"])), rule))


def _rule_errors():
    return rules.rule_errors(F.transform("rules", lambda r: F.struct(r["mode"].alias("mode"), r["find"].alias("find"))))


def invalid_rules(profiles: DataFrame) -> DataFrame:
    """(profile, rule_no, find, error) of the rules of canonical profiles that cannot be used; rules count from 1."""
    each = profiles.select("profile", F.posexplode(F.arrays_zip("rules", _rule_errors().alias("error"))).alias("k", "r"))
    return each.filter("r.error is not null").select("profile", (F.col("k") + 1).alias("rule_no"), F.col("r.rules.find").alias("find"), F.col("r.error").alias("error"))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Canonical profiles with ``error``: the code of the first check that fails, else null."""
    def language(name: str):
        return F.split(name, "-")[0]

    spoken = list(CARDINAL)
    buffer = (F.col("safety_tail_chars") < 0) | (F.col("max_buffer_chars") <= 0) | (F.col("max_buffer_chars") <= F.col("safety_tail_chars"))
    bad_rule = F.exists(_rule_errors(), lambda e: e.isNotNull())
    formats = F.size(F.array_except(F.coalesce("date_formats", F.array().cast("array<string>")), F.array(*map(F.lit, FORMATS)))) > 0
    nothing = (F.size(F.coalesce("date_formats", F.array(F.lit("")))) == 0) & ~F.col("standalone_years")
    years = F.col("standalone_years") & (F.col("year_min") > F.col("year_max"))
    renderer = ~F.col("date_renderer").isin("curated", "numeric_fallback") | ((F.col("date_renderer") == "curated") & ~F.coalesce(language("date_locale").isin(*CURATED), F.lit(False)))
    off = lambda name: ~F.coalesce(language(name).isin(spoken), F.lit(False))
    checks = [
        (buffer, "invalid_buffer_config"), (F.col("output_language").isNull(), "invalid_buffer_config"), (bad_rule, "invalid_rule"),
        (F.col("emoji_enabled") & ~F.col("emoji_handling").isin("remove", "spell_out"), "invalid_emoji_normalizer"),
        (F.col("date_enabled") & (formats | nothing | years | renderer | off("date_locale")), "invalid_date_normalizer"),
        (F.col("time_enabled") & ~F.coalesce(language("time_locale").isin(*CURATED), F.lit(False)), "invalid_time_normalizer"), (F.col("unit_enabled") & F.col("unit_locale").isNull(), "invalid_unit_normalizer"),
        (F.col("number_enabled") & off("number_language"), "invalid_number_normalizer"),
    ]
    return profiles.withColumn("error", F.coalesce(*(F.when(bad, F.lit(code)) for bad, code in checks)))


def as_profile(row) -> Profile:
    """The Profile of a canonical row; raises ValueError for a rule that does not compile."""
    return Profile(
        locale=normalize_locale(row.output_language), rules=tuple(rules.load_rules([r.asDict() for r in row.rules])), markdown=row.markdown_enabled, lines=row.replace_line_breaks,
        emoji=row.emoji_handling if row.emoji_enabled else None, dates=row.date_enabled, years=row.standalone_years, times=row.time_enabled, durations=row.durations,
        units=row.unit_enabled, numbers=row.number_enabled, grouped=row.allow_grouped,
        formats=tuple(row.date_formats if row.date_formats is not None else default_formats(row.date_locale or row.output_language)),
        markdown_skip=tuple(step for switch, step in MARKDOWN_SWITCHES.items() if not row[switch]), remove_code=row.remove_code_blocks, remove_urls=row.remove_plain_urls,
        emoji_language=row.emoji_language or "", date_locale=row.date_locale or "", date_renderer=row.date_renderer, year_min=row.year_min, year_max=row.year_max,
        time_locale=row.time_locale or "", clocks=row.clock_times, ranges=row.ranges, unit_locale=row.unit_locale or "", number_language=row.number_language or "",
    )


def profile_from_json(spark: SparkSession, data: str, options: str = "{}") -> Profile:
    """The Profile of an unsaved configuration; raises ValueError with the code of the first check that fails."""
    row = validate_profiles(canonical_profiles(load_profiles(spark.createDataFrame([("given", data, options)], PROFILES)))).first()
    if row.error:
        raise ValueError(row.error)
    return as_profile(row)


def profiles_by_name(checked: DataFrame) -> dict[str, Profile]:
    """The valid profiles of a checked table."""
    rows = checked.filter("error is null").limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    return {r.profile: as_profile(r) for r in rows}


def normalize_by_profile(messages: DataFrame, profiles: dict[str, Profile], by: str = "lang", text: str = "text") -> DataFrame:
    """messages, each normalised by the profile its column ``by`` names; those without one go unchanged.

    One scan whatever the number of profiles: a stage is a choice among its distinct settings, each with the
    profiles that share them. Rules keep their own order within a profile, as the k-th rule is the k-th stage.
    """
    order = ["markdown", "lines", "emoji", "dates", "times", "units", "numbers"]
    every = {name: stages(p) for name, p in profiles.items()}
    most = max((sum(s.startswith("rule") for s, _, _ in x) for x in every.values()), default=0)
    for place in [*range(most), *order]:
        choices: dict[tuple, tuple[list[str], object]] = {}
        for name, own in every.items():
            mine = [x for x in own if x[0].startswith("rule")][place : place + 1] if isinstance(place, int) else [x for x in own if x[0] == place]
            for _, settings, f in mine:
                choices.setdefault(settings, ([], f))[0].append(name)
        if choices:
            said = None
            for names, f in choices.values():
                on = F.col(by).isin(names)
                said = F.when(on, f(F.col(text))) if said is None else said.when(on, f(F.col(text)))
            messages = messages.withColumn(text, said.otherwise(F.col(text)))
    return messages


def supported_locales(spark: SparkSession, output_languages: tuple[str, ...] = ()) -> DataFrame:
    """(stage, locale): what each stage can speak; units speak any output language in their generic form."""
    fixed = {
        "date": [*CURATED, *(f"{lang}-{region}" for lang, regions in REGIONS.items() for region in regions), *CARDINAL], "time": CURATED, "number": CARDINAL,
        "unit": [*CURATED, *(f"{lang}-{region}" for lang in CURATED for region in REGIONS[lang]), *map(normalize_locale, filter(None, output_languages))],
    }
    tables = [spark.createDataFrame([(stage, x) for x in locales], "stage string, locale string") for stage, locales in fixed.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def preview_rejected(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_chars) of the messages that are too long to preview."""
    return messages.filter(F.length(text) > PREVIEW_CHARS).select(key, F.length(text).alias("n_chars"))


def preview(messages: DataFrame, profile: Profile, n: int, key: str, text: str = "text") -> DataFrame:
    """(key, before, after) of the n first messages by key that are short enough to preview."""
    short = messages.filter(F.length(text) <= PREVIEW_CHARS).orderBy(key).limit(n).select(key, F.col(text).alias("before"), F.col(text).alias("after"))
    return normalize(short, profile, "after")


def profile_rows(spark: SparkSession, rows: list[tuple[str, dict, dict]]) -> DataFrame:
    """A table of profiles from plain records."""
    return spark.createDataFrame([(n, json.dumps(d), json.dumps(o)) for n, d, o in rows], PROFILES)
