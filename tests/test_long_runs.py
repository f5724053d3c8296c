"""Long runs of one character, unclosed marks and awkward edges: right, and in little time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import dates, emoji, markdown, numbers, rules, times

N = 30_000


def said(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize("text, want", [(" \n" * N, " "), (" " * N + "x", " " * N + "x"), ("a" + "\r\n \t" * N + "b", "a b"), ("<" * N, "<" * N), ("x [" * N + "\n", "x [" * N + " ")])
def test_lines_of_long_runs_are_joined(spark, text, want):
    began = time.time()
    assert said(spark, [text], rules.join_lines(F.col("t"))) == [(want,)]
    assert time.time() - began < 30


def test_long_runs_pass_every_stage(spark):
    texts = ["-" * N, "<" * N, ", " * N + "🔥", "*" * N, "[" * N + " 1", "`" * N, "1 " * 2000 + " " * N, "| a\n" * 20_000 + "|-|\n", "# " * N, "<a" * 3000 + ">" + "<" * N]
    began = time.time()
    t = F.col("t")
    got = said(spark, texts, markdown.clean_markdown(t), emoji.spell_emoji(t, "en"), emoji.remove_emoji(t), dates.speak_dates(t, "de-DE", None, True), times.speak_times(t, "de"), numbers.speak_numbers(t, "en"))
    assert time.time() - began < 240
    assert got[0][0] == "" and got[1][0] == texts[1] and got[2][1] == "fire" and got[4][5] == "[" * N + " one"


@pytest.mark.parametrize("text", ["**a " * 50_000, "_a " * 60_000, "~~a ~~" * 30_000, "*a* **b" * 20_000, "**a " * 40_000 + "b**", "*" * 100_000 + "a*", "* a" * 60_000 + "*", "__a__ _" * 20_000 + "\n_b_"])
def test_unmatched_marks_take_little_time(spark, text):
    began = time.time()
    got = said(spark, [text], markdown.strikethrough(markdown.emphasis(F.col("t"))))[0][0]
    assert time.time() - began < 20
    assert got == text if text.startswith("_a ") else len(got) <= len(text)


def slow_pairs(line, mark, outside):
    """Tries every opener with every closer behind it."""
    out, at, n = "", 0, len(mark)
    adjoins = lambda k: 0 <= k < len(line) and bool(outside) and re.match(outside, line[k]) is not None
    while at < len(line):
        opens = line.startswith(mark, at) and not adjoins(at - 1) and not line[at + n : at + n + 1].isspace()
        close = next((k for k in range(at + n + 1, len(line)) if line.startswith(mark, k) and not line[k - 1].isspace() and not adjoins(k + n)), None) if opens else None
        if close is None:
            out, at = out + line[at], at + 1
        else:
            out, at = out + line[at + n : close], close + n
    return out


def test_marks_against_a_slow_version(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice("**__~~ab \r\u2028") for _ in range(draw.randrange(14))) for _ in range(1500)]
    for mark, outside in (("**", r"\*"), ("__", "_"), ("*", r"\*"), ("_", "[A-Za-z0-9_]"), ("~~", "")):
        assert [r[0] for r in said(spark, texts, markdown.paired(F.col("t"), mark, outside))] == [slow_pairs(t, mark, outside) for t in texts]


def test_tables_of_many_rows(spark):
    text = "| A | B |\n| --- | --- |\n" + "| 1 | 2 |\n" * 30_000 + "end"
    assert said(spark, [text], markdown.tables(F.col("t"))) == [("A. B.\n" + "1. 2.\n" * 30_000 + "end",)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\n```", "a"), ("a\n```\ncode", "a"), ("a\n~~~\ncode\n~~~\nb", "a\nb"), ("    ```\nx", "    ```\nx"),
    ],
)
def test_fences(spark, text, want):
    assert said(spark, [text], F.rtrim(markdown.code_blocks(F.col("t")), F.lit("\n"))) == [(want,)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("- - -\n ***\n--\n_ _ _ _\n    ---", "--\n    ---"), ("## Title ##\n#no\n####### seven\n# a#\n# ###", "Title\n#no\n####### seven\na#\n###"), ("Head\n===\nb", "Head\nb"),
        ("> a\n>b\n   > c\n    > d", "a\nb\nc\n    > d"), ("- [ ] a\n* b\n12) c\n+ 3. d\n-e\n1234567890. f", "a\nb\nc\nd\n-e\n1234567890. f"),
        ("**a** __b__ *c* _d_ a_b_c 2 * 3 * 4 ~~e~~ `f`", "a b c d a_b_c 2 * 3 * 4 e f"),
        ("[l](https://x.y \"t\") ![i](mailto:a) [n](x) [whispers] [e](http://)", "l i [n](x) [whispers] [e](http://)"),
        ("x\n| A | B |\n|---|:-:|\n| 1. | |\n||\nplain\n|-|\n", "x\nA. B.\n1.\n\nplain\n|-|"),
        ("- [x] done [x] <b *k*> [*t*]", "done [x] <b *k*> [*t*]"),
    ],
)
def test_markdown_by_line(spark, text, want):
    assert said(spark, [text], markdown.clean_markdown(F.col("t"))) == [(want,)]


@pytest.mark.parametrize(
    "text, spelled, removed",
    [
        ("Super 😀🔥", "Super, grinsendes gesicht, feuer", "Super "), ("Gut 👍", "Gut, thumbs up", "Gut "), (" 🔥 hot ", " feuer, hot ", " hot "), ("<say 🔥 loud> 🔥", "<say 🔥 loud> feuer", "<say 🔥 loud> "),
        ("3,5 👍🏽!", "3, 5, thumbs up medium skin tone!", "3,5!"), ("1️⃣ ©️ ▶️ ⬛ 🅰️ 🃏", None, " "), ("✓ ☆ ➀ 12 # *", "✓ ☆ ➀ 12 # *", "✓ ☆ ➀ 12 # *"),
        ("a,  b", "a,  b", "a,  b"), ("x\n🔥 y", "x\nfeuer, y", "x\n y"), ("🇩🇪 x", "🇩🇪 x", " x"), (None, None, None),
    ],
)
def test_emoji(spark, text, spelled, removed):
    got = said(spark, [text], emoji.spell_emoji(F.col("t"), "de"), emoji.remove_emoji(F.col("t")))[0]
    assert got[1] == removed
    assert spelled is None or got[0] == spelled


def test_last_word_is_read_from_the_end(spark):
    """The word before a date or year, as a search from the left finds it, in time that grows with the text alone."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("aüZ   \n,.7-") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for behind, plain in ((dates.NO_LETTER, rf"(?s)({dates.LETTER}+){dates.NO_LETTER}*\z"), (r"\s", rf"(?U)({dates.LETTER}+)\s*\z")):
        assert df.filter(F.regexp_extract("t", dates.LAST_WORD.format(behind), 1) != F.regexp_extract("t", plain, 1)).count() == 0
    assert df.filter(F.rtrim("t", F.lit(dates.BLANKS)) != F.regexp_replace("t", r"(?U)\s+\z", "")).count() == 0
    long = spark.createDataFrame([("a" * 20_000 + ".",)] * 8, "t string")
    began = time.time()
    assert long.select(F.regexp_extract("t", dates.LAST_WORD.format(r"\s"), 1)).distinct().count() == 1
    assert time.time() - began < 5


def test_emoji_are_the_listed_characters_and_plain_text_is_passed_quickly(spark):
    """Plain text was compared with each span of the emoji, at some hundred times the cost of a look for one character."""
    signs = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    listed = {c for a, b in emoji.SPANS for c in range(a, b + 1)}
    assert {r.id for r in signs.filter(F.col("c").rlike(emoji.ONE)).collect()} == listed
    assert {r.id for r in signs.filter(F.col("c").rlike(emoji.GATE)).collect()} == listed | {*range(0x1F1E6, 0x1F200), 0x20E3}

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.concat("id", F.lit(" Übung, a „quoted“ word – and more. ")), 100).alias("t"))

    def took(column):
        began = time.time()
        assert texts.select(column.alias("x")).agg(F.count("x")).first()[0] == 4000
        return time.time() - began

    once = lambda column: min(took(column) for _ in range(3))
    assert once(emoji.remove_emoji(F.col("t"))) < 12 * once(F.col("t").rlike("[\x01-\x02]")) + 1
