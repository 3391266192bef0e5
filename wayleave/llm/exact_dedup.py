"""Exact dedup by content sort.

Normalised texts are range-partitioned (Spark samples the splitters), each range is sorted externally, equal texts
stand next to each other, and every row is compared in full with its neighbour; the smallest identifier of a run of
equals stays. The range key is a short prefix and a 64-bit hash of the text, so that the sample the driver gets stays
small and many texts with one beginning still spread over many ranges; the sort and the comparison use the whole text.

A group of copies may hold a large part of all rows. Counts by hash (pre-aggregated in every task) name those hashes
that have more than a partition's fair share; their rows get a salt from the identifier and the runs of each salt are
found apart. What these runs have in common, the smallest identifier and the count, comes from a second read of the rows
with those hashes, grouped by hash and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import partitions, text_or_empty

WHITE = r"[\x20\x09\x0A\x0B\x0C\x0D]+"
PREFIX = 48
SALTS = 32


def normalised(c="text"):
    return F.regexp_replace(text_or_empty(c), WHITE, " ")


def _compared(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Each row with _id, keep_id, group_size, kept, text_sha256, and with the input's columns in _row if they are carried."""
    n = partitions(docs.sparkSession)
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(text_col).alias("_t"), *whole).withColumn("_h", F.xxhash64("_t"))

    # Hashes with more rows than half a partition's fair share: at most 2 n of them, and as many texts.
    fair = int(docs.count() / (2 * n)) + 16
    hot = [r["_h"] for r in rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fair).collect()]
    salt = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("_s", F.when(F.col("_h").isin(hot), salt).otherwise(F.lit(0)) if hot else F.lit(0)).withColumn("_p", F.substring("_t", 1, PREFIX))

    cell = ["_p", "_h", "_s"]
    ranged = (rows.drop("_t") if carry else rows).repartitionByRange(n, *cell)
    if carry:  # one text goes through the exchange, not two
        ranged = ranged.withColumn("_t", normalised(F.col("_row")[text_col]))
    order = Window.partitionBy(*cell).orderBy("_t", F.col("_id").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lag("_t").over(order)
    runs = ranged.withColumn("_new", last.isNull() | (last != F.col("_t")))
    first = F.last(F.when(F.col("_new"), F.struct("_id")), ignorenulls=True).over(so_far)
    runs = runs.withColumn("_lead", first["_id"]).withColumn("_run", F.sum(F.col("_new").cast("long")).over(so_far))
    runs = runs.withColumn("text_sha256", F.sha2(F.encode("_t", "UTF-8"), 256)).drop("_t")
    if carry:  # sizes need one more sort, which whole rows are spared
        runs = runs.where("_new").withColumn("_size", F.lit(None).cast("long"))
    else:
        runs = runs.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*cell, "_run")))
    if hot:
        met = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(text_col).alias("_t")).withColumn("_h", F.xxhash64("_t")).where(F.col("_h").isin(hot))
        met = met.groupBy("_h", "_t").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_all"))
        met = met.select("_h", F.sha2(F.encode("_t", "UTF-8"), 256).alias("text_sha256"), F.struct("_keep", "_all").alias("_met"))
        runs = runs.join(F.broadcast(met), ["_h", "text_sha256"], "left")
        lead, size = F.when(F.col("_met").isNotNull(), F.col("_met._keep")).otherwise(F.col("_lead")), F.coalesce("_met._all", "_size")
    else:
        lead, size = F.col("_lead"), F.col("_size")
    return runs.withColumn("keep_id", lead).withColumn("group_size", size).withColumn("kept", F.col("_new") & F.col("_lead").eqNullSafe(lead))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of white space became one space. Null text counts as
    empty. Of rows that repeat an identifier and a text, one is kept. A null identifier ranks after all others; a
    group of rows without any identifier has a null keep_id and keeps one row. An empty table gives an empty result.
    Other columns of the input are not looked at.
    """
    return _compared(docs, id_col, text_col, False).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    return _compared(docs, id_col, text_col, True).where("kept").select("_row.*")
