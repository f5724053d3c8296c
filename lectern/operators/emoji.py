"""Emoji: removed, or replaced by their spoken names.

Which characters are emoji, alone or in sequences, follows Unicode's property; names come from a table
(sequence, language, name) with English as the fallback. Control tags are opaque. Unknown sequences stay.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.regexsub import by_segment, last, let, like, regex_sub
from lectern.functions.words import listed

#: The code points with Unicode's property Emoji, in hexadecimal; digits, # and * are emoji in keycaps only.
EMOJI = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE "
    "2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 "
    "2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 "
    "26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 "
    "2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 "
    "3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 "
    "1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 "
    "1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 "
    "1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC "
    "1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD 1FABF-1FAC5 "
    "1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8"
)
SPANS = [tuple(int(x, 16) for x in (span.split("-") * 2)[:2]) for span in EMOJI.split()]
_LISTED = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SPANS)
#: Four spans around all of these. A class tries its spans one by one, so that letters and digits are turned away by few
#: comparisons instead of by one for each span listed.
_AROUND = r"\xA9\xAE\x{203C}-\x{2B55}\x{3030}-\x{303D}\x{3297}-\x{3299}\x{1F004}-\x{1FAF8}"
ONE = f"[{_AROUND}&&[{_LISTED}]]"
STYLE, TONES = r"\x{FE0F}", r"[\x{1F3FB}-\x{1F3FF}]"
#: A picture with its style, skin tone and tag letters; joined pictures; keycaps; flags.
PICTURE = rf"{ONE}{STYLE}?{TONES}?(?:[\x{{E0020}}-\x{{E007E}}]+\x{{E007F}})?"
SEQUENCE = rf"(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]{STYLE}?\x{{20E3}}|{PICTURE}(?:\x{{200D}}{PICTURE})*)"
#: Any character that an emoji can begin with, but for the signs of keycaps, which need their cap.
GATE = rf"[{_AROUND}&&[{_LISTED}\x{{1F1E6}}-\x{{1F1FF}}\x{{20E3}}]]"
#: Names that differ from those of the Unicode characters, and the names in other languages.
ENGLISH = {
    "⚡": "high voltage", "❤": "red heart", "☀": "sun", "✅": "check mark button", "⭐": "star", "🙏": "folded hands", "💡": "light bulb", "🏠": "house",
    "☕": "hot beverage", "☔": "umbrella with rain drops", "✔": "check mark", "👏": "clapping hands", "📧": "e-mail",
}
NAMES = {
    "de": {
        "😀": "grinsendes gesicht", "🔥": "feuer", "🎉": "konfettibombe", "🚀": "rakete", "☀": "sonne", "⭐": "stern", "❤": "rotes herz", "☁": "wolke",
        "❄": "schneeflocke", "🏠": "haus", "☕": "heißgetränk", "🔋": "batterie", "🌡": "thermometer",
    }
}
TONE_NAMES = dict(zip("🏻🏼🏽🏾🏿", ("light", "medium-light", "medium", "medium-dark", "dark"), strict=True))


@cache
def english_names() -> dict[str, str]:
    """The English name of each single emoji and keycap, by rule from its Unicode name."""
    names = {}
    for a, b in SPANS:
        for c in map(chr, range(a, b + 1)):
            name = unicodedata.name(c, "").lower()
            if name:
                names[c] = name.removesuffix(" sign").removesuffix(" symbol")
    return names | {f"{c}⃣": f"keycap {c}" for c in "0123456789#*"} | ENGLISH


def emoji_names(spark: SparkSession) -> DataFrame:
    """(seq, lang, name): the vocabulary as a table; callers may add rows of their own."""
    rows = [(s, "en", n) for s, n in english_names().items()] + [(s, lang, n) for lang, names in NAMES.items() for s, n in names.items()]
    return spark.createDataFrame(rows, "seq string, lang string, name string")


#: Rows of one language that a vocabulary may have, several times what Unicode has sequences.
MOST_NAMES = 50_000


def names_of(vocabulary: DataFrame, lang: str) -> dict[str, str]:
    """The names of a language in a vocabulary table, for ``spell_emoji``; English ones where it has none.

    Names may be written with colons and underscores; of two for a sequence the greater holds. A language of
    more than MOST_NAMES rows is refused, as the names travel with the plan.
    """
    rows = vocabulary.filter(F.col("lang").isin(lang, "en") & F.col("seq").isNotNull() & F.col("name").isNotNull())
    clean = F.trim(F.regexp_replace(F.translate(F.trim("name", F.lit(":")), "_", " "), r"\s+", " "))
    each = rows.groupBy(F.translate("seq", "\ufe0f", "").alias("seq")).agg(F.coalesce(F.max(F.when(F.col("lang") == lang, clean)), F.max(clean)).alias("name"))
    found = each.filter("seq <> '' and name <> ''").limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of emoji")
    return {r.seq: r.name for r in found}


def named(sequences: DataFrame, vocabulary: DataFrame, lang: str, seq: str = "seq") -> DataFrame:
    """sequences with ``name``: the one in the language, else the English one, else null. The vocabulary is bounded by Unicode."""
    own, english = (vocabulary.filter(F.col("lang") == x).groupBy(F.col("seq").alias("_seq")).agg(F.max("name").alias(c)) for x, c in ((lang, "_own"), ("en", "_en")))
    bare = F.translate(seq, "️", "")
    out = sequences
    for table in (own, english):
        out = out.join(F.broadcast(table), bare == F.col("_seq"), "left").drop("_seq")
    return out.withColumn("name", F.coalesce("_own", "_en")).drop("_own", "_en")


def default_language(output: str, languages=("de", "en")) -> str:
    """The emoji language for an output locale: the locale, its language, English, else the first there is."""
    locale = output.replace("-", "_")
    return next((x for x in (locale, locale[:2], "en") if x in languages), languages[0] if languages else "")


def remove_emoji(text: Column) -> Column:
    """Emoji go, and with them doubled blanks and white space before punctuation; texts without any stay untouched."""

    def bare(t: Column) -> Column:
        left = F.regexp_replace(F.regexp_replace(t, SEQUENCE, ""), r"(?<![ \t])[ \t]{2,}+", " ")
        return F.regexp_replace(left, r"(?U)(?<!\s)\s++(?=[.!?:;,])", "")

    return by_segment(text, lambda t: F.when(like(t, GATE) & like(t, SEQUENCE), bare(t)).otherwise(t))


def tidied(said: Column, text: Column) -> Column:
    """said with one comma and blank between its parts, none at the ends of lines' starts or before punctuation.

    The outer white space is that of text.
    """

    def trimmed(parts: Column):
        def one(p: Column, i: Column) -> Column:
            right = F.when(i + 1 < F.size(parts), F.rtrim(p, F.lit(" \t"))).otherwise(p)
            return F.when(i > 0, F.ltrim(right, F.lit(" \t"))).otherwise(right)

        return F.filter(F.transform(parts, one), lambda p: like(p, r"(?U)\S"))

    def glued(parts: Column) -> Column:
        """The parts with a comma between them, but none behind a line end."""
        comma = lambda i: F.when((i == 0) | last(F.get(parts, i - 1)).isin("\r", "\n"), F.lit("")).otherwise(F.lit(", "))
        return F.array_join(F.transform(parts, lambda p, i: F.concat(comma(i), p)), "")

    whole = let(F.split(said, ",", -1), lambda ps: let(trimmed(ps), glued))
    pointed = F.regexp_replace(whole, r"(?U)(?:,\s*+|(?<!\s)\s++)(?=[.!?:;])", "")
    edge = lambda pattern: F.regexp_extract(text, pattern, 1)

    def framed(t: Column) -> Column:
        before, after = edge(r"(?U)\A(\s*+)"), edge(r"(?U)(?<!\s)(\s*+)\z")
        return F.when(t == "", t).otherwise(F.concat(F.when(t.startswith(before), F.lit("")).otherwise(before), t, F.when(t.endswith(after), F.lit("")).otherwise(after)))

    return let(pointed, framed)


def spell_emoji(text: Column, lang: str, names: dict[str, str] | None = None) -> Column:
    """Known emoji as ", name,", with the commas tidied; stretches without any stay untouched.

    names: sequences and names that win over those built in, such as ``names_of`` a vocabulary table. The whole
    sequence is looked up first, then without its skin tone, then pictures joined into one by their parts.
    """
    known = english_names() | NAMES.get(lang, {}) | {s.replace("\ufe0f", ""): n for s, n in (names or {}).items()}
    table = F.map_from_arrays(listed(list(known)), listed(list(known.values())))
    tones = F.map_from_arrays(listed(list(TONE_NAMES)), listed(list(TONE_NAMES.values())))

    def single(bare: Column) -> Column:
        tone = F.regexp_extract(bare, f"({TONES})\\z", 1)
        toned = F.concat(F.try_element_at(table, F.regexp_replace(bare, f"{TONES}\\z", "")), F.lit(" "), F.try_element_at(tones, tone), F.lit(" skin tone"))
        return F.coalesce(F.try_element_at(table, bare), toned)

    def name(x: Column) -> Column:
        def of(bare: Column) -> Column:
            parts = F.transform(F.split(bare, "\u200d"), single)
            together = let(parts, lambda ps: F.when(~F.exists(ps, lambda p: p.isNull()), F.array_join(ps, " ")))
            return F.coalesce(single(bare), F.when(bare.contains("\u200d"), together))

        return let(F.translate(x, "\ufe0f", ""), of)

    def spoken(t: Column) -> Column:
        said = regex_sub(t, SEQUENCE, lambda x, left, right: F.concat(F.lit(", "), name(x), F.lit(",")), tags=False)
        return let(said, lambda s: F.when(s == t, t).otherwise(tidied(s, t)))

    return by_segment(text, lambda t: F.when(like(t, GATE), spoken(t)).otherwise(t))
