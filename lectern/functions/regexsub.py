"""Callback-style substitution as native expressions: match first, validate second.

A candidate that its renderer rejects is emitted unchanged and consumed, so no shorter match inside it
is ever tried. Provider control tags (<...> and [...]) are opaque: they pass through and count as the
start or end of text for their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"<[^>]*>|\[[^\]]*\]"
#: Stand for openers < and [ behind the last closer, which can begin no tag.
SEALS = "\ue002\ue003"
#: Stands for a match where a text is parted.
PART = "\ue004"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(stage):
    """A function of a text whose text is computed once, so that stages can be nested."""

    @wraps(stage)
    def on(text: Column, *args, **kwargs) -> Column:
        return let(text, lambda t: stage(t, *args, **kwargs))

    return on


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def sealed(text: Column) -> Column:
    """text for the search of tags: each opener that has no closer behind it is a seal instead.

    Every opener left then has a closer, so a search reads no stretch twice; else many unclosed ones would
    each be followed to the end of the text. Texts that hold seals themselves stay as they are.
    """

    def closed(t: Column, opener: str, closer: str, seal: str) -> Column:
        tail = F.substring_index(t, closer, -1)
        return F.when(tail.contains(opener), F.concat(F.left(t, F.length(t) - F.length(tail)), F.translate(tail, opener, seal))).otherwise(t)

    both = lambda t: let(closed(t, "<", ">", SEALS[0]), lambda u: closed(u, "[", "]", SEALS[1]))
    return F.when((text.contains("<") | text.contains("[")) & ~_has_seals(text), both(text)).otherwise(text)


def _has_seals(text: Column) -> Column:
    return text.contains(SEALS[0]) | text.contains(SEALS[1])


def unsealed(text: Column, parts: Column) -> Column:
    """Parts of sealed(text) with the openers back in place."""
    back = lambda s: F.when(s.contains(SEALS[0]) | s.contains(SEALS[1]), F.translate(s, SEALS, "<[")).otherwise(s)
    return F.when(_has_seals(text), parts).otherwise(F.transform(parts, back))


def parted(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, as split gives it.

    Substitution keeps its compiled pattern from row to row, which a split does not; so matches become one
    character of private use, at which a split needs no pattern. Texts with that character are split plainly.
    """
    return F.when(text.contains(PART), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, PART), PART, -1))


@bound
def by_segment(text: Column, change: Callable[[Column], Column]) -> Column:
    """change(plain text) on every stretch between control tags; the tags stay as they are.

    Null where change gives null for any stretch.
    """
    whole, closed = f"(?U)(?:{TAG})", sealed(text)
    closers = text.contains(">") | text.contains("]")
    gaps = F.when(closers, unsealed(text, parted(closed, whole))).otherwise(F.array(text))
    tags = F.when(closers, F.regexp_extract_all(closed, F.lit(whole), F.lit(0)))
    joined = lambda parts: F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))
    done = let(tags, lambda m: let(F.transform(gaps, lambda s, i: F.concat(change(s), F.coalesce(F.get(m, i), F.lit("")))), joined))
    return F.when(text.isNotNull(), done)


def is_tag(match: Column) -> Column:
    return match.startswith("<") | match.startswith("[")


def sides(m: Column, g: Column, i: Column, tags: bool = True, reach: int = 0) -> tuple[Column, Column]:
    """The original text left and right of match i, given all matches and the gaps around them.

    Each side ends with the neighbouring match; with reach, the left holds that many characters, however
    many matches are among them.
    """

    def beyond(k: Column) -> Column:
        if not tags:
            return F.coalesce(F.get(m, k), F.lit(""))
        return F.when(F.coalesce(is_tag(F.get(m, k)), F.lit(True)), F.lit("")).otherwise(F.get(m, k))

    left = F.concat(beyond(i - 1), F.get(g, i))
    if reach and not tags:
        pairs = lambda first: F.array_join(F.transform(F.slice(g, first + 1, i - first), lambda x, k: F.concat(x, F.get(m, first + k))), "")
        far = let(F.greatest(i - reach, F.lit(0)), pairs)
        left = F.when((F.length(left) < reach) & (i > 0), F.concat(far, F.get(g, i))).otherwise(left)
    return left, F.concat(F.get(g, i + 1), beyond(i + 1))


@bound
def regex_find(text: Column, pattern: str, gate: str | None = None) -> Column:
    """The matches that regex_sub would render, as array<struct<token, left, right>>; tags are left out."""
    whole = f"(?U)(?:{TAG}|{pattern})"
    kind = "array<struct<token:string,left:string,right:string>>"

    def listed(m: Column, g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            left, right = sides(m, g, i)
            return F.struct(x.alias("token"), left.alias("left"), right.alias("right"))

        return F.filter(F.transform(m, one), lambda x: ~is_tag(x["token"])).cast(kind)

    closed = sealed(text)
    found = F.regexp_extract_all(closed, F.lit(whole), F.lit(0))
    done = let(found, lambda m: F.when(F.size(m) > 0, let(unsealed(text, parted(closed, whole)), lambda g: listed(m, g))))
    return F.coalesce(F.when(like(text, gate), done) if gate else done, F.array().cast(kind))


@bound
def regex_sub(text: Column, pattern: str, render: Callable[[Column, Column, Column], Column], gate: str | None = None, tags: bool = True, reach: int = 0) -> Column:
    """text with every match replaced by render(match, left, right).

    left and right are the original text next to the match: the gap and the match beyond it, cut at
    tags; with reach and without tags, that many characters on the left. Rows without the gate pattern, or without a match, are passed on without being split.
    """
    whole = f"(?U)(?:{TAG}|{pattern})" if tags else f"(?U)(?:{pattern})"

    def rebuilt(m: Column, g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            left, right = sides(m, g, i, tags, reach)
            # Bound once: what surrounds a match is asked for many times.
            spoken = let(F.struct(left.alias("left"), right.alias("right")), lambda c: render(x, c["left"], c["right"]))
            return F.concat(F.get(g, i), F.when(is_tag(x), x).otherwise(F.coalesce(spoken, x)) if tags else F.coalesce(spoken, x))

        return F.concat(F.array_join(F.transform(m, one), ""), F.element_at(g, -1))

    closed = sealed(text) if tags else text
    found = F.regexp_extract_all(closed, F.lit(whole), F.lit(0))
    gaps = lambda: unsealed(text, parted(closed, whole)) if tags else parted(closed, whole)
    done = let(found, lambda m: F.when(F.size(m) > 0, let(gaps(), lambda g: rebuilt(m, g))).otherwise(text))
    return F.when(like(text, gate), done).otherwise(text) if gate else F.when(text.isNotNull(), done)



def last(text: Column, n: int = 1) -> Column:
    return F.right(text, F.lit(n))


def first(text: Column, n: int = 1) -> Column:
    return F.left(text, F.lit(n))


#: Dashes that may stand for a minus: hyphen, minus, en dash, em dash.
DASHES = "\\-−–—"
GROUP_SPACES = "[ \u00a0\u202f\u2009]"
OPENERS, CLOSERS, STOPS = "([{\"'„“", ")]}\"'“”", ".,;:!?"


def numeric_left(left: Column) -> Column:
    """Whether no character on the left takes a number into an identifier, a version, an address or a sign."""
    return ~like(last(left), rf"(?U)[\p{{L}}\p{{N}}_.,:/+{DASHES}]")


def numeric_boundary(match: Column, left: Column, right: Column) -> Column:
    """Whether a numeric token stands free: not within identifiers, versions, addresses or larger groups."""
    joined_left = like(last(left, 5), rf"(?U)(?:\A|\D)\d{{1,3}}{GROUP_SPACES}\z") & like(match, r"(?U)\A\d{3}(?!\d)")
    joined_right = like(first(right, 5), rf"(?U)\A{GROUP_SPACES}\d{{3}}(?!\d)") & like(match, r"(?U)(?:\A|\D)\d{1,3}\z")
    bad_right = like(first(right, 2), rf"(?U)\A(?:[\p{{L}}\p{{N}}_:/+{DASHES}]|[.,]\d)")
    return numeric_left(left) & ~(joined_left | joined_right | bad_right)


def date_boundary(left: Column, right: Column) -> Column:
    """Whether a date stands between blanks, brackets, quotes, punctuation behind it, or emphasis marks beside those."""

    def beside(side: Column, trim, end, ok: str, within_marks: str) -> Column:
        near = end(side)
        free = lambda c, chars: F.lit(chars).contains(c) | like(c, r"(?U)\s")  # noqa: E731  (c is one character or none)
        # Marks are looked behind only where there are any.
        marked = (near != "") & F.lit("*_").contains(near)
        return F.when(marked, free(end(trim(side, F.lit("*_"))), within_marks)).otherwise(free(near, ok))

    return beside(left, F.rtrim, last, OPENERS, OPENERS + STOPS) & beside(right, F.ltrim, first, CLOSERS + STOPS, CLOSERS + STOPS)


def time_boundary(left: Column, right: Column) -> Column:
    return ~(like(last(left), r"(?U)[\p{L}\p{N}_.:/+]") | like(first(right, 2), r"(?U)\A(?:[\p{L}\p{N}_:/+]|[.,]\d)"))
