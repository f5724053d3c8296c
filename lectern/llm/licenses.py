"""Operator 13, license scans: notices found whole or with a few edits.

A text is its words, lower-cased and joined by single blanks. Base phrases are found as they are. A notice
may differ by as many edits (characters changed, left out or put in) as its length allows. It is split
into one piece more than that: of any place within so many edits at least one piece is whole, so the exact
places of all pieces, found by one automaton, lead to every candidate. Each candidate is verified by
bounded-error matching, which gives the span and its edits. What tells notices of one family apart (a
version, "sa", "nc") must stand behind the edited part exactly, words in braces must be among those found,
and of overlapping spans the one of fewest edits, then the longest, stays.

Edge cases: null and empty texts have no words, no labels and a score of 0; long texts are scanned whole;
repeated rows are scanned one by one; an empty table gives an empty result; further columns stay, but one
named as the result is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices: label, the part that may be edited but for words in braces, and what must follow it exactly (several: any of them).
NOTICES = (
    ("mit", "under the {mit} license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version", "2"),
    ("apache-2", "apache license version", "2"),
    ("apache-2", "under the apache license", "2"),
    ("gpl-2", "gnu general public license version", "2"),
    ("gpl-2", "gnu general public license", "v2"),
    ("gpl-3", "gnu general public license version", "3"),
    ("gpl-3", "gnu general public license", "v3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version", "2"),
    ("mpl-2", "mozilla public license", "v 2", "2 0"),
    ("epl", "eclipse public license"),
    ("bsd-2", "redistribution and use in source and binary forms"),
    ("bsd-2", "{bsd} {2} clause license"),
    ("bsd-3", "{bsd} {3} clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("boost", "boost software license version", "1"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("cc0", "creative commons zero", "1 0", "v1 0", "universal"),
    ("cc0", "", "cc0 1 0"),
    ("cc-by", "", "cc by 2 0", "cc by 3 0", "cc by 4 0"),
    ("cc-by", "creative commons attribution", "2 0", "2 5", "3 0", "4 0", "international"),
    ("cc-by-sa", "", "cc by sa"),
    ("cc-by-sa", "creative commons attribution", "sharealike", "share alike"),
    ("cc-by-nc", "creative commons attribution", "noncommercial", "non commercial"),
    ("cc-by-nc-sa", "", "cc by nc sa"),
    ("cc-by-nc-nd", "", "cc by nc nd"),
    ("cc-by-nd", "", "cc by nd"),
    ("cc-by-nd", "creative commons attribution", "noderivatives", "no derivatives", "noderivs"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Characters of a notice for each edit that it may have.
EDIT_SHARE = 10

#: Bytes to bytes: letters to lower case, what is no part of a word to a blank. Bytes of 128 and more belong to words.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def joined_words(text: str) -> str:
    """The words of a text between single blanks, with a blank on both sides; of a text without words, one blank."""
    words = b" ".join(text.encode().translate(_FOLD).split()).decode()
    return f" {words} " if words else " "


def edits(phrase: str) -> int:
    return len(phrase) // EDIT_SHARE


def pieces(phrase: str, exact: str) -> list[tuple[str, int]]:
    """(piece, its place in the phrase): one more than the edits allowed, so that one of them is whole in any match."""
    if not phrase:
        return [(exact, 0)]
    n = edits(phrase) + 1
    cuts = [len(phrase) * k // n for k in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Notices:
    """Notices compiled once for a worker: an automaton of all pieces, and a bounded-error pattern for each notice."""

    def __init__(self, notices: tuple, base: dict[str, str]):
        import ahocorasick

        self.rows, self.patterns, seeds = [], [], {}
        for label, written, *ends in notices:
            phrase, must = written.translate({123: None, 125: None}), regex.findall(r"\{(.*?)\}", written)
            for end in ends or [""]:
                k = len(self.rows)
                self.rows.append((label, phrase, must, len(f"{phrase} {end}".strip())))
                tail = f"(?: {end})" if phrase and end else end
                body = rf"(?:{regex.escape(phrase, literal_spaces=True)}){{e<={edits(phrase)}}}" if phrase else ""
                self.patterns.append(regex.compile(rf"(?e)(?<= ){body}{tail}(?= )"))
                for piece, at in pieces(phrase, end):
                    seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, known in seeds.items():
            self.seeds.add_word(piece, (len(piece), known))
        self.seeds.make_automaton()
        self.base = [(f" {p} ", label) for p, label in base.items()]

    def base_places(self, text: str) -> list[tuple[int, str]]:
        """(offset, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                out.append((at + 1, label))
                at = text.find(phrase, at + 1)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of the notices in joined words, by place, without overlaps."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, known) in self.seeds.iter(text):
            for k, at in known:
                _, phrase, _, length = self.rows[k]
                slack = edits(phrase)
                start = last + 1 - size - at - slack
                # One character more on each side: the blanks around the words.
                low, high = max(0, start - 1), min(len(text), start + length + 3 * slack + 1)
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = set()
        for k, own in windows.items():
            label, _, must, length = self.rows[k]
            for low, high in own:
                for m in self.patterns[k].finditer(text, low, high, overlapped=True):
                    if all(f" {w} " in f" {m[0]} " for w in must):
                        a, b = m.span()
                        found.add((sum(m.fuzzy_counts), a - b, a, b, label, length))
        out: list[tuple[int, int, str, int, int]] = []
        taken: list[tuple[int, int]] = []
        for wrong, _, a, b, label, length in sorted(found):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((a, b, label, wrong, length))
        return sorted(out)


@lru_cache(maxsize=2)
def compiled(notices: tuple, base: tuple) -> Notices:
    return Notices(notices, dict(base))


def scan_licenses(docs: DataFrame, text: str = "text", notices: tuple = NOTICES, base: dict[str, str] | None = None, into: str = "licenses") -> DataFrame:
    """docs with ``licenses``: n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    A span is (label, first word, last word, edits) of a notice. The score is the greatest share of a found
    notice that is unedited, 1 for a base phrase, 0 where nothing is found.
    """
    phrases = tuple((BASE if base is None else base).items())
    span = "array<struct<label:string,first:long,last:long,edits:int>>"

    @F.pandas_udf(f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        known, rows = compiled(notices, phrases), []
        for t in texts:
            words = joined_words(t or "")
            places, spans = known.base_places(words), known.spans(words)
            at = lambda offset: words.count(" ", 0, offset) - 1  # noqa: B023, E731
            starts = [at(a) for a, _ in places]
            plain = {label for _, label in places}
            score = 1.0 if places else max((1 - wrong / length for *_, wrong, length in spans), default=0.0)
            rows.append((
                max(0, words.count(" ") - 1), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(plain)),
                ",".join(sorted(plain | {label for _, _, label, _, _ in spans})), score, [(label, at(a), at(b), wrong) for a, b, label, wrong, _ in spans],
            ))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(into, scan(F.col(text)))


def op13_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = "n_words n_base first_word last_word base_labels labels score".split()
    return scan_licenses(docs).select("doc_id", *(f"licenses.{n}" for n in names))
