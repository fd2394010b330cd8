"""Checks of matched strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.functions.text import rx


def digits(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"\D"), "")


def luhn(text: Column) -> Column:
    """The Luhn sum of the digits is a multiple of ten; at least two digits."""
    found = F.reverse(F.split(digits(text), ""))
    value = lambda d, i: F.when(i % 2 == 0, d).when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    numbers = F.transform(F.filter(found, lambda d: d != ""), lambda d, i: value(d.try_cast("int"), i))
    return (F.size(numbers) >= 2) & (F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0)


def ssn(text: Column) -> Column:
    d = digits(text)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")


def ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    good = lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)) & ((F.length(p) == 1) | ~p.startswith("0"))
    return (F.size(parts) == 4) & F.forall(parts, good)


VALIDATORS = {"luhn": luhn, "ssn": ssn, "ipv4": ipv4}
