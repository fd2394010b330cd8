"""Text functions as Column expressions.

Patterns get ``(?Ud)``: Unicode classes and only ``\\n`` as a line end, as the
patterns expect.  All functions take a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<text:string,start:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def rx(pattern: str, flags: str = "") -> str:
    return f"(?Ud{flags}){pattern}"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(text, rx(r"^\s+"), ""), rx(r"\s+\z"), "")


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(rx(r"\S")), F.lit(False))


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def count_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, flags)))


def count_of(text: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rx(r"\s+")), lambda w: w != "")


def word_count(text: Column) -> Column:
    """At least 1."""
    return F.greatest(F.size(words(text)), F.lit(1))


#: Elements in a block of :func:`before`, and characters in one of :func:`blocks`.
_RUN, _BLOCK = 100, 1024


def before(values: Column, add: Callable[[Column, Column], Column], zero: Column, kind: str) -> Column:
    """For each element what ``add`` (associative, ``zero`` being neutral) makes of all before it.

    A fold that gathers an array copies it at every step.  Here blocks are
    added up, then the blocks before each, then the elements before each in
    its block.
    """

    def run(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda b: F.slice(v, b * _RUN + 1, F.lit(_RUN)))

        def heads(c: Column) -> Column:
            whole = F.transform(c, lambda x: F.aggregate(x, zero, add))
            return let(whole, lambda w: F.zip_with(c, F.transform(w, lambda _, b: F.aggregate(F.slice(w, F.lit(1), b), zero, add)), lambda x, h: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i), h, add))))

        return F.flatten(let(cut, heads))

    return let(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array().cast(f"array<{kind}>")))


def clusters(found: Column) -> Column:
    """Spans sorted by start, in runs that do not touch each other's characters."""

    def cut(f: Column) -> Column:
        reach = before(F.transform(f, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0), "int")
        fresh = let(reach, lambda r: F.filter(F.transform(f, lambda x, i: F.when(x["start"] >= F.get(r, i), i)), lambda i: i.isNotNull()))
        return let(fresh, lambda c: F.transform(c, lambda a, k: F.slice(f, a + 1, F.coalesce(F.get(c, k + 1), F.size(f)) - a)))

    return let(found, cut)


def blocks(text: Column) -> Column:
    """``text`` in blocks of equal size, from which :func:`piece` takes parts without counting from the first character on."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of the text that :func:`blocks` cut."""
    first = F.floor(start / _BLOCK).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * _BLOCK + 1, end - start)).otherwise("")


def spans(text: Column, pattern: str, flags: str = "") -> Column:
    """All matches with their half-open code-point offsets.

    The text between the matches and the matches' own lengths give the
    offsets, as a running sum.  ``pattern`` must not match the empty string.
    Texts without a match, the usual case, cost one search.
    """
    full = rx(pattern, flags)
    parts = F.struct(F.split(text, full, -1).alias("between"), F.regexp_extract_all(text, F.lit(full), 0).alias("hits"))

    def all_spans(p: Column) -> Column:
        sizes = F.transform(p["hits"], lambda hit, i: F.length(F.get(p["between"], i)) + F.length(hit))

        def span(hit: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(p["between"], i))
            return F.struct(hit.alias("text"), start.alias("start"), (start + F.length(hit)).alias("end"))

        return let(before(sizes, lambda a, x: a + x, F.lit(0), "int"), lambda at: F.transform(p["hits"], lambda hit, i: span(hit, i, at)))

    return F.when(text.rlike(full), let(parts, all_spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def round4(x: Column) -> Column:
    """Four decimal places, exact halves of the binary value resolved as by correct decimal rounding; never -0."""
    return F.call_function("format_number", x, F.lit("0.0000")).cast("double") + 0.0


def joined(parts: list[Column]) -> Column:
    """Concatenation of arrays of one type, at least one."""
    return F.concat(*parts) if len(parts) > 1 else parts[0]
