"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.constants import WHITESPACE


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    """Last ``n`` characters, or the whole of a shorter text."""
    return F.substring(text, -n, n)


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


SPAN_GROUP = 256  # matches whose offsets one fold adds up
NO_SPANS = "cast(array() as array<struct<hit: string, start_pos: int, end_pos: int>>)"


def once(value: Column, of) -> Column:
    """of(value), with the value computed once: in a lambda's body an expression is computed at each call."""
    return F.transform(F.array(value), of)[0]


def cut_every(text: Column, n: int) -> Column:
    """The text in parts of ``n`` characters, the last one shorter, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{n}}}"), F.lit(0))


def running(values: Column) -> Column:
    """0 and the running sums of a few integers."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` with 0-based start and end offsets, in order.

    The text splits into gaps around the same matches that ``regexp_extract_all``
    lists, so offsets are running sums of the two lengths. A fold copies what it has
    made at each step, so matches are added up in groups of SPAN_GROUP, and the groups'
    lengths after that: time grows in proportion to the matches. The text is searched twice,
    or once where nothing matches. No UDF is needed.
    """
    empty = F.expr(f"named_struct('pos', 0, 'out', {NO_SPANS})")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        row = F.struct(
            pair["hit"].alias("hit"), start.alias("start_pos"), end.alias("end_pos")
        )
        return F.struct(
            end.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out")
        )

    def shifted(group: Column, by: Column) -> Column:
        return F.transform(
            group["out"],
            lambda s: F.struct(s["hit"].alias("hit"), (s["start_pos"] + by).alias("start_pos"), (s["end_pos"] + by).alias("end_pos")),
        )

    def grouped(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(SPAN_GROUP))
        return F.transform(starts, lambda at: F.aggregate(F.slice(pairs, at, F.lit(SPAN_GROUP)), empty, step))

    def joined(groups: Column) -> Column:
        offsets = running(F.transform(groups, lambda g: g["pos"]))
        return F.flatten(F.zip_with(groups, F.slice(offsets, F.lit(1), F.size(groups)), shifted))

    def pairs(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        return F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def added(all_: Column) -> Column:
        few = F.aggregate(all_, empty, step, lambda acc: acc["out"])
        return F.when(F.size(all_) <= SPAN_GROUP, few).otherwise(once(grouped(all_), joined))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return once(found, lambda hits: F.when(F.size(hits) > 0, once(pairs(hits), added)).otherwise(F.expr(NO_SPANS)))


def between(text: Column, start: Column, end: Column) -> Column:
    """Characters from 0-based ``start`` up to ``end`` (exclusive), clipped to the text."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(end - first, F.lit(0)))


def chars_of(text: Column) -> Column:
    """The different characters of a text, as a text: the set that similarity compares."""
    return F.regexp_replace(text, r"(?s)(.)(?=.*\1)", "")


def compact(text: Column) -> Column:
    """Lower case without blanks, dots and parentheses: the form similarity compares."""
    return F.translate(F.lower(text), " .()", "")


def similarity(a: Column, b: Column, a_chars: Column | None = None, b_chars: Column | None = None) -> Column:
    """1 for equal compact texts, 0.85 if one holds the other, else overlap of characters.

    ``a`` and ``b`` are compact texts; pass their character sets when they are
    stored already, so that a join does not rebuild them per pair.
    """
    a_chars = chars_of(a) if a_chars is None else a_chars
    b_chars = chars_of(b) if b_chars is None else b_chars
    n_a, n_b = F.length(a_chars), F.length(b_chars)
    only_a = F.length(F.call_function("translate", a_chars, b_chars, F.lit("")))
    # |A and B| / |A or B|, from what is left of A without the characters of B
    return (
        F.when(a == b, F.lit(1.0))
        .when(F.contains(b, a) | F.contains(a, b), F.lit(0.85))
        .when((n_a == 0) | (n_b == 0), F.lit(0.0))
        .otherwise((n_a - only_a) / (n_b + only_a))
    )


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed table; null for unknown keys. An expression, so no join."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)
