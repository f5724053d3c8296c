"""Operator 5, edit-aware token counts.

A document's pre-tokens are the leaves, sixteen each, of a segment tree with sums of characters and
tokens at every node. ``token_trees`` keeps the leaf sums as a table; ``count_edited`` reads them beside the text.
An edit finds its leaves by descending the character sums, re-encodes them together with as much
context as can change their pre-tokens, and updates the sums on the paths to the root; everything else keeps its
counts and is not encoded again. A leaf that grows is split.

Edge cases: a null text is empty and counts 0, as one empty leaf; edits are (start, end, replacement) in places of the
unedited text; an edit with a null start or end is left out, one that overlaps the next is cut at the next one's start,
all are clipped to the text, a null replacement is empty; texts are counted whole; repeated rows are counted one by
one; an empty table gives an empty result; other columns stay, but one named as a result is replaced.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

LEAF = 16
CACHE = 1 << 17
EDIT = "array<struct<start:int,end:int,replacement:string>>"


class Counter:
    """Pre-tokens and their token counts for one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.wide = regex.compile(pattern).findall
        # For texts of ASCII alone the same pattern with its classes written out, where it has no others.
        plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        plain = re.sub(r"(?<!\[)(a-zA-Z|0-9)(?=[+*?])", r"[\1]", plain)
        self.narrow = self.wide if "\\p" in plain or "(?" in plain.replace("(?!", "") else re.compile(plain, re.ASCII).findall
        self.count = lru_cache(CACHE)(lambda piece: len(self.encoding.encode_ordinary(piece)))

    def split(self, text: str) -> list[str]:
        return self.narrow(text) if text.isascii() else self.wide(text)


@lru_cache(2)
def loaded(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class TokenTree:
    """Segment tree over the leaves of one text: characters and tokens of every node.

    Built from a whole text, or from kept leaf sums beside that text, of which then only what edits touch is read.
    """

    def __init__(self, text: str, counter: Counter, chars=None, tokens=None):
        self.counter, self.text = counter, text
        self.encoded = 0  # pre-tokens counted again by edits
        if chars is None:
            pieces = counter.split(text)
            cut = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
            chars, tokens = [sum(map(len, x)) for x in cut], [sum(map(counter.count, x)) for x in cut]
        # A leaf's text: where it begins in the given text, or a text of its own once it was edited.
        self.place: list[int | str] = [0, *accumulate(chars)][:-1]
        self.grow(list(map(int, chars)), list(map(int, tokens)))

    def grow(self, chars: list[int], tokens: list[int]) -> None:
        """All sums anew from those of the leaves; nothing is encoded."""
        self.n, self.width = len(chars), 1 << (len(chars) - 1).bit_length()
        spare = [0] * (self.width - self.n)
        self.chars, self.tokens = [0] * self.width + chars + spare, [0] * self.width + tokens + spare
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def leaf_sums(self) -> tuple[list[int], list[int]]:
        return self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n]

    def leaf(self, k: int) -> str:
        at = self.place[k]
        return at if isinstance(at, str) else self.text[at : at + self.chars[self.width + k]]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one, past the end), and where it starts."""
        k, start = 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return min(k - self.width, self.n - 1), start

    def put(self, k: int, pieces: list[str]) -> None:
        """New contents of a leaf; the sums on its path to the root follow."""
        self.place[k], at = "".join(pieces), self.width + k
        self.chars[at], self.tokens[at] = len(self.place[k]), sum(map(self.counter.count, pieces))
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    def spread(self, first: int, last: int, pieces: list[str]) -> None:
        """The pieces in place of the leaves first..last; more leaves are made where these would grow too large."""
        slots, need = last - first + 1, -(-len(pieces) // LEAF)
        if len(pieces) > 2 * LEAF * slots:
            chars, tokens = self.leaf_sums
            for old in (chars, tokens, self.place):
                old[first + 1 : last + 1] = [0 if old is not self.place else ""] * (need - 1)
            self.grow(chars, tokens)
            slots = need
        each = max(1, -(-len(pieces) // slots))
        for k in range(slots):
            part = pieces[k * each : (k + 1) * each]
            if part or self.chars[self.width + first + k]:
                self.put(first + k, part)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start..end and counts anew what that can change."""
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        # A pre-token's match looks at most two characters past its end.
        first, begins = self.find(start - 2)
        last, _ = self.find(max(start, end - 1))
        text = "".join([self.leaf(k) for k in range(first, last + 1)])
        body = text[: start - begins] + new + text[end - begins :]
        while True:
            follow, k = "", last + 1
            while k < self.n and len(follow) < 3:
                follow += self.leaf(k)
                k += 1
            pieces, size, n = self.counter.split(body + follow), 0, 0
            while n < len(pieces) and size < len(body):
                size += len(pieces[n])
                n += 1
            # Only where a pre-token ends with the body is all that follows cut as before.
            if size == len(body) and (k >= self.n or n < len(pieces) or not body):
                break
            body, last = body + follow, k - 1
        self.encoded += n
        self.spread(first, last, pieces[:n])


def applicable(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits from the last to the first, each clipped to the text and to the start of the one after it."""
    found, limit = [], size
    known = lambda x: x is not None and x == x  # noqa: E731  beside nulls numbers arrive as floats, nulls as NaN
    given = [(int(c["start"]), int(c["end"]), c["replacement"] or "") for c in ([] if edits is None else edits) if c is not None and known(c["start"]) and known(c["end"])]
    for begin, end, new in sorted(given, key=lambda c: c[:2], reverse=True):
        start = max(0, min(begin, limit))
        found.append((start, max(start, min(end, limit)), new))
        limit = start
    return found


def ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def pattern_edits(pattern: str, replacement: str, text: Column) -> Column:
    """The edits that replace each match of a Python pattern, as an array column."""
    found = re.compile(pattern)

    @F.pandas_udf(EDIT)
    def edits(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"start": m.start(), "end": m.end(), "replacement": replacement} for m in found.finditer(t or "")] for t in texts]
        )

    return edits(text)


def token_trees(docs: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None, into: str = "tree") -> DataFrame:
    """docs with ``tree``: characters and tokens of each leaf of its segment tree. Write it; later edits need no more of a text than they touch."""
    path, pattern = vocabulary or ranks()

    @F.pandas_udf("chars array<int>, tokens array<int>")
    def trees(texts: pd.Series) -> pd.DataFrame:
        counter = loaded(path, pattern)
        return pd.DataFrame([TokenTree(t or "", counter).leaf_sums for t in texts], columns=["chars", "tokens"])

    return docs.withColumn(into, trees(F.col(text)))


def count_edited(docs: DataFrame, text: str = "text", edits: str = "edits", vocabulary: tuple[str, str] | None = None, tree: str = "tree", into: str = "counts") -> DataFrame:
    """docs of token_trees() with ``counts``: tokens before and after the edits, the tree after them, and the pre-tokens counted again."""
    path, pattern = vocabulary or ranks()

    @F.pandas_udf("n_tokens long, n_edits long, n_tokens_edited long, n_pieces_recounted long, chars array<int>, tokens array<int>")
    def counts(texts: pd.Series, changes: pd.Series, chars: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        counter, rows = loaded(path, pattern), []
        for t, cs, c, k in zip(texts, changes, chars, tokens, strict=True):
            kept = TokenTree(t or "", counter, c, k)
            before, cs = kept.total, applicable(cs, len(t or ""))
            for change in cs:  # from the end, so that the places of the others hold
                kept.edit(*change)
            rows.append((before, len(cs), kept.total, kept.encoded, *kept.leaf_sums))
        return pd.DataFrame(rows, columns=["n_tokens", "n_edits", "n_tokens_edited", "n_pieces_recounted", "chars", "tokens"])

    return docs.withColumn(into, counts(F.col(text), F.col(edits), F.col(f"{tree}.chars"), F.col(f"{tree}.tokens")))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its lines are joined: one job keeps the trees, the next edits them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = written(token_trees(docs))
    edited = kept.withColumn("edits", pattern_edits(r"[ \t]*[\r\n]+[ \t]*", " ", F.col("text")))
    return count_edited(edited).select("doc_id", *(f"counts.{c}" for c in ("n_tokens", "n_edits", "n_tokens_edited", "n_pieces_recounted")))
