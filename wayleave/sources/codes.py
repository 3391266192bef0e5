"""Code lists and settlement lists: semicolon-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.functions.keys import normal_code


def _unquoted(c):
    t = F.trim(c)
    return F.when(F.regexp_like(t, F.lit('^".*"$')) & (F.length(t) > 1), F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)


def code_list(lines: DataFrame) -> DataFrame:
    """(code, text) of lines (line_no, value) `code;text`: blank lines, comments and the header are skipped, the first of repeated codes counts. The text may hold semicolons."""
    v = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = lines.select("line_no", v.alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("#")) & F.contains("v", F.lit(";")))
    rows = rows.select("line_no", _unquoted(F.substring_index("v", ";", 1)).alias("code"), _unquoted(F.substr("v", F.instr("v", ";") + 1)).alias("text"))
    rows = rows.where((F.lower("code") != "code") & (F.col("code") != ""))
    return rows.groupBy(normal_code(F.col("code")).alias("code")).agg(F.min_by("text", "line_no").alias("text"))


def overlaid(defaults: DataFrame, own: DataFrame, key: str = "code") -> DataFrame:
    """Defaults with a list on top: equal keys are replaced, the others stay."""
    both = defaults.withColumn("_p", F.lit(0)).unionByName(own.withColumn("_p", F.lit(1)))
    return both.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_p").desc()))).where("_i = 1").drop("_p", "_i")


def settlement_list(lines: DataFrame) -> DataFrame:
    """(ekatte, kind, name, municipality, province) of lines with five columns; codes are digits only, the last of repeated codes counts."""
    c = F.split("value", ";")
    rows = lines.where(F.size(c) >= 5).select("line_no", *(F.trim(F.get(c, i)).alias(n) for i, n in enumerate(("ekatte", "kind", "name", "municipality", "province"))))
    rows = rows.where(F.regexp_like("ekatte", F.lit("^[0-9]+$")))
    return rows.groupBy("ekatte").agg(F.max_by(F.struct("kind", "name", "municipality", "province"), "line_no").alias("l")).select("ekatte", "l.*")
