"""Printed units: decares, kilometres, percents, Roman categories, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DKA = "decimal(18,3)"


def sqm_to_dka(c: Column) -> Column:
    """Square metres to decares, three decimals, half away from zero; decimal arithmetic from the written value on."""
    return F.round(c.cast("decimal(24,6)") * F.lit("0.001").cast("decimal(4,3)"), 3).cast(DKA)


def to_km(metres: Column) -> Column:
    return F.round(metres.cast("decimal(24,6)") * F.lit("0.001").cast("decimal(4,3)"), 3).cast(DKA)


def format_dka(c: Column) -> Column:
    return c.cast(DKA).cast("string")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals half away; null where the whole is zero."""
    return F.when(whole != 0, F.round(part.cast("decimal(20,3)") * 100 / whole.cast("decimal(20,3)"), 2).cast("decimal(9,2)"))


def roman_category(c: Column) -> Column:
    """1 to 3999 in Roman numerals; 0 and empty give an empty text; anything else stays as written."""
    text = F.trim(F.coalesce(c, F.lit("")))
    n = F.when(F.regexp_like(text, F.lit("^[0-9]{1,9}$")), text.cast("int"))
    digits = ("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M")

    def place(value: Column, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), value + 1)

    at = lambda k: F.floor(n / k).cast("int") % 10
    roman = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(at(100), *digits[2]), place(at(10), *digits[1]), place(at(1), *digits[0]))
    return F.when((text == "") | F.regexp_like(text, F.lit("^0+$")), F.lit("")).when(n.between(1, 3999), roman).otherwise(text)


def share(above: Column, below: Column) -> Column:
    """above/below; -2 stands for no share, an empty part leaves the other one."""
    a, b = (F.trim(F.coalesce(x, F.lit(""))) for x in (above, below))
    none = lambda x: (x == "") | (x == "-2")
    return F.when(none(a), F.lit("")).when(none(b), a).otherwise(F.concat(a, F.lit("/"), b))
