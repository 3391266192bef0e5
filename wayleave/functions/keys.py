"""Identifiers, codes and their orders as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLE_PREFIX = "Стълб №"
OWNERSHIP = "1"


def _digits(s: Column) -> Column:
    """A sort key of a run of digits of any length: its length without leading zeros, then the digits."""
    d = F.regexp_replace(s, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(d).cast("string"), 4, "0"), d)


def parcel_key(parcel_id: Column) -> Column:
    """Natural order of parcel identifiers: dotted parts, numbers before texts, texts without case first."""
    return F.transform(F.split(parcel_id, r"\."), lambda s: F.when(F.regexp_like(s, F.lit("^[0-9]+$")), F.concat(F.lit("0"), _digits(s))).otherwise(F.concat(F.lit("1"), F.lower(s), F.lit("\x01"), s)))


def control_key(parcel_id: Column) -> Column:
    """Order of the control report: parts that fit a long before all others, those by their code points."""
    return F.transform(F.split(parcel_id, r"\."), lambda s: F.when(s.try_cast("bigint").isNotNull() & F.regexp_like(s, F.lit("^[0-9]+$")), F.concat(F.lit("0"), _digits(s))).otherwise(F.concat(F.lit("1"), s)))


def pole_key(pole: Column) -> Column:
    """Whole numbers first, by value, then texts without case."""
    n = pole_number(pole)
    return F.struct(n.isNull().alias("text"), n.alias("number"), F.lower(pole).alias("lower"), pole.alias("raw"))


def pole_number(pole: Column) -> Column:
    s = F.trim(strip_pole_prefix(pole))
    return F.when(F.regexp_like(s, F.lit("^[+-]?[0-9]+$")), s.try_cast("bigint"))


def strip_pole_prefix(pole: Column) -> Column:
    return F.trim(F.regexp_replace(pole, f"(?iu)^\\s*{POLE_PREFIX}\\s*", ""))


def ekatte_of(parcel_id: Column) -> Column:
    """The settlement code: what stands before the first dot, empty without one."""
    return F.when(F.instr(parcel_id, ".") > 0, F.substring_index(parcel_id, ".", 1)).otherwise(F.lit(""))


def has_settlement(parcel_id: Column) -> Column:
    """Whether an identifier begins with a settlement's code."""
    return F.instr(parcel_id, ".") > 1


def full_parcel_id(ekatte: Column, ident: Column) -> Column:
    prefix = F.concat(ekatte, F.lit("."))
    return F.when(F.startswith(ident, prefix), ident).otherwise(F.concat(prefix, ident))


def parcel_label(parcel_id: Column) -> Column:
    """The identifier without its settlement."""
    dot = F.instr(parcel_id, ".")
    return F.when(dot > 0, F.substr(parcel_id, dot + 1)).otherwise(parcel_id)


def normal_code(code: Column) -> Column:
    """A code without white space around it and, if it is digits only, without leading zeros; all zeros are 0."""
    c = F.trim(code)
    return F.when(F.regexp_like(c, F.lit("^[0-9]+$")), F.regexp_replace(c, "^0+(?=.)", "")).otherwise(c)


def is_ownership(kind: Column) -> Column:
    return F.regexp_replace(F.trim(kind), "^0+", "") == OWNERSHIP


def hex_handle(handle: Column) -> Column:
    """Handles as numbers; what is not hexadecimal is null and goes last."""
    return F.when(F.regexp_like(handle, F.lit("^[0-9A-Fa-f]{1,15}$")), F.conv(handle, 16, 10).cast("bigint"))


def unescaped_quotes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\"), F.lit('"'))
