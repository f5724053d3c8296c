"""Operator 4, secret scans: fixed patterns, and guess costs of values in credential contexts.

The base patterns (assignments, access keys, long hex runs) are always reported. Beside them every
value that follows a credential word, and is not wholly in a base span, gets the least number of guesses that finds it, by dynamic
programming over segmentations into words (a fixed list, then the words of the corpus by frequency), dates, repeats, sequences, keyboard walks and brute force;
values that cost at least 10^8 guesses are reported as kind ``guess``. The words of the corpus are those of at least
LEAST_TEXTS of its texts, so whether a value of rare words is reported depends on the other texts of the table.

Edge cases: a null text is an empty text and has no spans; texts are scanned whole, whatever their
length; repeated rows are scanned one by one; other columns pass through untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache, reduce
from itertools import accumulate
from math import inf, log10

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import files, fresh, shared_dir, small, written
from lectern.sources.messages import spread

KINDS = ("assign", "access", "hex", "guess")
LEAST_LOG10 = 8.0
MASK = "[secret]"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A value ends at white space, quotes, list marks and the next parameter of a URL.
_VALUE = r"((?:[^\s\"',;<>&]|&(?![A-Za-z_][A-Za-z0-9_]*=)){6,})"
_AFTER_WORD = (
    r"(?:(?<![A-Za-z])(?:passphrase|pass|pwd|credentials?|bearer|auth|authorization|private_?key|access_?key|login)|password|passwd|secret|token|api_?key)"
    r"[\"']?\x20*[:=]\x20*[\"']?(?:bearer\x20+)?" + _VALUE
)
_AFTER_BEARER = r"(?<![A-Za-z])bearer\x20+" + _VALUE
#: In prose a value is one that holds a digit or a mark that words have not.
_AFTER_IS = (
    r"(?:(?<![A-Za-z])(?:passphrase|pass|pwd|private_?key|access_?key|login)|password|passwd|secret|token|api_?key)"
    r"[\"']?(?:\x20+is:?\x20+|\x20*[-=]>\x20*)[\"']?(?=[^\s\"',;<>&]*[0-9#$%^*~_])" + _VALUE
)
_CONTEXTS = [re.compile(p, re.ASCII | re.IGNORECASE) for p in (_AFTER_WORD, _AFTER_BEARER, _AFTER_IS)]
#: For Spark's filters: values to the next blank, quote or list mark. A loop over one class does not recurse, however long.
_JAVA_VALUES = f"(?i)(?:{_AFTER_WORD}|{_AFTER_BEARER}|{_AFTER_IS})".replace(_VALUE, r"[^\s\"',;<>]{6,}+")
#: One of these is in every credential context and every assignment, in either case: what a text is searched for first.
KEYWORDS = ("pass", "pwd", "credential", "bearer", "auth", "key", "login", "secret", "token")
#: A word counts as ordinary if so many texts have it outside credential contexts; longer words are brute force.
LEAST_TEXTS = 3
LONGEST_WORD = 32
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?[0-3]\d|[0-3]?\d[-/.](?:0?[1-9]|1[0-2])[-/.](?:(?:19|20)?\d\d)|(?:19|20)\d\d")
_LEET = str.maketrans("430157$@!", "aeoistsai")
#: Common passwords and words, most common first; rank is guess cost.
WORDS = (
    "password qwerty admin welcome login letmein dragon monkey master hello freedom shadow sunshine princess "
    "football baseball superman batman trustno iloveyou secret token default changeme guest root test user pass "
    "example sample demo none null true false please summer winter spring autumn love access server system "
    "database account private public service company manager january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday the and you for"
).split()
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}


def _near(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


#: Guesses for a run of k characters: 40 k, and for a keyboard walk twice as many with each step.
RUNS = (
    (lambda a, b: a == b, 0.0),
    (lambda a, b: ord(b) - ord(a) == 1, 0.0),
    (lambda a, b: ord(a) - ord(b) == 1, 0.0),
    (_near, 0.3),
)
DATE_CHARS = range(4, 11)


def guess_cost(value: str, rank: dict[str, int]) -> float:
    """log10 of the fewest guesses over all segmentations of value into words, dates, runs and single characters.

    Each further piece but single characters also costs the attacker the place where it starts. Of a run
    every part of three characters or more is a piece; a start that another start of its run
    beats stays beaten as the run goes on, so few are kept and the work is about linear in the length.
    """
    n = len(value)
    low = "".join([s if len(s := c.lower()) == 1 else c for c in value])  # one letter for one letter
    plain = low.translate(_LEET)
    longest = max(map(len, rank), default=0)
    best, dates = [0.0], {}
    for i in range(n):
        if low[i].isdigit():
            for size in DATE_CHARS:
                if i + size <= n and _DATE.fullmatch(low, i, i + size):
                    dates.setdefault(i + size, []).append(i)
    enter = lambda i: best[i] + (log10(2) if i else 0.0)
    open_runs: list[list[int]] = [[] for _ in RUNS]
    for j in range(1, n + 1):
        least = best[j - 1] + 1.0  # brute force: ten guesses a character
        for i in range(max(0, j - longest), j - 2):
            if (r := rank.get(low[i:j])) is not None:
                least = min(least, enter(i) + log10(r + 1) + (log10(2) if low[i:j] != value[i:j] else 0))
            elif (r := rank.get(plain[i:j])) is not None:
                least = min(least, enter(i) + log10(r + 1) + log10(4))
        for i in dates.get(j, ()):
            least = min(least, enter(i) + (log10(119) if j - i == 4 else log10(365 * 119)))
        for k, (follows, step) in enumerate(RUNS):
            if j > 1 and not follows(low[j - 2], low[j - 1]):
                open_runs[k] = []
            costs = {i: enter(i) + log10(40 * (j - i)) + step * (j - i) for i in open_runs[k]}
            least = min([least, *(c for i, c in costs.items() if j - i >= 3)])
            kept, low_cost = [], inf
            for i, c in costs.items():  # from the earliest start; a later one must be cheaper by now, or too new to tell
                if c < low_cost or j - i < 3:
                    kept.append(i)
                low_cost = min(low_cost, c)
            open_runs[k] = [*kept, j - 1]
        best.append(least)
    return best[n]


def has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if has_keyword(text) else []
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def open_values(text: str, base: list) -> list[tuple[int, int, str]]:
    """(start, end, value) of the credential contexts whose value no base span covers to its end."""
    found: dict[int, tuple[int, int, str]] = {}
    if not has_keyword(text):
        return []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for pattern in _CONTEXTS:
        for m in pattern.finditer(text):
            k = bisect_right(starts, m.start(1)) - 1
            if k < 0 or reach[k] < m.end():
                found.setdefault(m.end(), (m.start(), m.end(), m[1]))
    return sorted(found.values())


def all_spans(text: str, base: list, rank: dict[str, int], least: float) -> list[tuple[int, int, int]]:
    """base and the costly values of credential contexts, whole, also where a base span ends inside them."""
    more = [(s, 3, e) for s, e, value in open_values(text, base) if guess_cost(value, rank) >= least]
    return sorted(base + more)


def masked(text: str, spans: list) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _within_values(words: DataFrame, values: str) -> DataFrame:
    """The rows of words (w, rank) whose word occurs in a value, or in its plain letters.

    values is a folder of written values (v). Each batch of words becomes one automaton, and every value is read
    past it, so a task holds a batch of words and a value however long a value is.
    """

    def met(batches):
        import ahocorasick
        import pyarrow.dataset as ds

        fs, base = files(values)
        for pdf in batches:
            tree, seen = ahocorasick.Automaton(), set()
            for w in pdf["w"]:
                tree.add_word(w, w)
            tree.make_automaton()
            if len(pdf):
                for batch in ds.dataset(base, filesystem=fs, format="parquet").to_batches(columns=["v"], batch_size=64):
                    for v in batch.column(0):
                        low = v.as_py().lower()
                        for form in (low, low.translate(_LEET)):
                            seen.update(w for _, w in tree.iter(form))
            yield pdf[pdf["w"].isin(seen)]

    return words.mapInPandas(met, "w string, rank long")


def corpus_ranks(docs: DataFrame, text: str, rank: dict[str, int], least: float) -> str | None:
    """A written table of (w, rank): words of the corpus by number of texts, as far as they occur in costly values.

    Ranks are over the whole of docs. Credential values are cut out before the words are counted, so a secret
    does not vouch for itself. None where no value is costly by the given ranks alone.
    """

    @F.pandas_udf("array<string>")
    def costly(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({v for _, _, v in open_values(t, base_spans(t)) if guess_cost(v, rank) >= least}) for t in texts])

    spark, values, ranks = docs.sparkSession, shared_dir(docs.sparkSession), shared_dir(docs.sparkSession)
    texts = docs.select(F.col(text).alias("t")).filter("t is not null")
    low = F.lower("t")
    keyed = reduce(lambda a, b: a | b, (low.contains(k) for k in KEYWORDS))
    texts.filter(keyed & F.col("t").rlike(_JAVA_VALUES)).select(F.explode(costly("t")).alias("v")).distinct().write.parquet(values)
    if spark.read.schema("v string").parquet(values).isEmpty():
        return None
    plain = F.when(keyed, F.lower(F.regexp_replace("t", F.lit(_JAVA_VALUES), F.lit(" ")))).otherwise(low)
    each = F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"(\p{{L}}{{3,{LONGEST_WORD}}}+)(?!\p{{L}})"), F.lit(1)))
    counts = written(texts.select(F.explode(each).alias("w")).groupBy("w").count().filter(F.col("count") >= LEAST_TEXTS))
    # Rank: how many words are at least as frequent; words share counts, so the table by count is short.
    sizes, place, at = sorted(counts.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True), 0, []
    for c, n in sizes:
        place += n
        at.append((c, place))
    ranked = counts.join(small(spark.createDataFrame(at or [(0, 0)], "count long, rank long")), "count").select("w", "rank")
    _within_values(ranked, values).write.parquet(ranks)
    return ranks


@lru_cache(2)
def loaded_ranks(path: str | None, words: tuple[str, ...]) -> dict[str, int]:
    """The given words in order, then those of a written table behind them; read once by a worker."""
    import pyarrow.dataset as ds

    rank = {w: i + 1 for i, w in enumerate(words)}
    if path is None:
        return rank
    fs, base = files(path)
    rows = ds.dataset(base, filesystem=fs, format="parquet").to_table(columns=["w", "rank"])
    return {w: r + len(rank) for w, r in zip(rows["w"].to_pylist(), rows["rank"].to_pylist(), strict=True)} | rank


def scan_secrets(docs: DataFrame, text: str = "text", words=tuple(WORDS), least_log10: float = LEAST_LOG10, into: str = "secrets") -> DataFrame:
    """docs with ``secrets`` (in place of any column so named): counts by kind, base spans and all spans as text, and the masked text.

    words are ranked first; the words of the corpus come after them, in the order of corpus_ranks.
    """
    words = tuple(words)
    path = corpus_ranks(docs, text, {w: i + 1 for i, w in enumerate(words)}, least_log10)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base string, spans string, masked string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows, rank = [], loaded_ranks(path, words)
        for t in texts:
            t = t or ""
            base = base_spans(t)
            every = all_spans(t, base, rank, least_log10)
            kinds = [k for _, k, _ in every]
            rows.append((*(kinds.count(k) for k in range(4)), joined(base), joined(every), masked(t, every) if every else t))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base", "spans", "masked"])

    return docs.withColumn(into, scan(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every reported span replaced by a mask; null texts stay null."""
    (into,) = fresh(docs, "_secrets")
    found = scan_secrets(docs, text, into=into, **options)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.col(f"{into}.masked"))).drop(into)


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    s = scan_secrets(docs)
    return s.select(
        "doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex",
        F.sha2(F.col("secrets.base"), 256).alias("base_sha256"), "secrets.spans",
    )

