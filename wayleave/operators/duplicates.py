"""Shapes and footprints drawn more than once: pairs by joins, then in each group the lowest kept, as rounds over the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayleave.functions.keys import hex_handle
from wayleave.operators.lines import CLOSE_M, same_footprint
from wayleave.operators.overlay import by_cell, overlap_areas
from wayleave.sources.saved import saved

SAME_SHARE, PARTLY_SQM = 0.99, 0.01


def is_duplicate_shape(area_a: Column, area_b: Column, shared: Column) -> Column:
    """Whether two shapes are one: areas within a hundredth of a square metre, and nearly all of the smaller one shared."""
    return (F.abs(area_a - area_b) < CLOSE_M) & (shared >= SAME_SHARE * F.least(area_a, area_b))


def greedy_twins(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (by, a, b) of like items, a before b -> (by, b, a): each item that is dropped, and the first kept one that it is like.

    Items are taken in order, and one is dropped if it is like one that was kept before. In each round those with no like one before them among
    the items left are kept, and all that are like them dropped; what remains are pairs of undecided items. A chain a~b~c keeps a and c and takes two
    rounds; the number of rounds is that of the longest such chain, whatever the number of items.
    """
    alike = left = saved(pairs.select(*by, "a", "b"), "alike")
    dropped = left.select(*by, F.col("b").alias("a")).limit(0)
    while not left.isEmpty():
        first = left.join(left.select(*by, F.col("b").alias("a")).distinct(), [*by, "a"], "left_anti")
        gone = saved(first.select(*by, F.col("b").alias("a")).distinct(), "dropped")
        dropped = dropped.unionByName(gone)
        left = saved(left.join(gone, [*by, "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), [*by, "b"], "left_anti"), "alike")
    twins = alike.join(dropped, [*by, "a"], "left_anti").join(dropped.withColumnRenamed("a", "b"), [*by, "b"], "left_semi")
    return twins.groupBy(*by, "b").agg(F.min("a").alias("a"))


def dedup_shapes(shapes: DataFrame, cell: float = 50.0) -> DataFrame:
    """shapes (parcel_id, handle, area, ring) -> (parcel_id, handle, kept_handle, partly): the kept shape that each one repeats (null: it stays), and whether it partly covers another one.

    In each parcel lower handles (as hexadecimal numbers; others last, as texts) come first. partly is said of shapes that share more than PARTLY_SQM with a kept one
    of a lower handle without repeating it; of a dropped one only as far as such come before the one it repeats. Shapes with the very same vertices are
    compared once. Repeated handles count as one shape.
    """
    turn = F.struct(F.coalesce(hex_handle(F.col("handle")), F.lit((1 << 63) - 1)).alias("n"), F.col("handle").alias("h"))
    rows = saved(shapes.select("parcel_id", turn.alias("turn"), "area", "ring").dropDuplicates(["parcel_id", "turn"]), "shapes")
    one = saved(rows.groupBy("parcel_id", "ring", "area").agg(F.min("turn").alias("first")), "unlike")
    a, b = (one.select("parcel_id", F.col("first").alias(n), F.col("area").alias(f"area_{n}"), "ring") for n in ("a", "b"))
    met = saved(overlap_areas(a, b, ["a", "area_a"], ["b", "area_b"], ["parcel_id"], cell, where=F.col("a") < F.col("b")), "overlaps")
    same = is_duplicate_shape(F.col("area_a"), F.col("area_b"), F.col("sqm"))
    twins = greedy_twins(met.where(same), ["parcel_id"])
    kept = F.col("_twin").isNull()
    told = one.join(twins.select("parcel_id", F.col("b").alias("first"), F.col("a").alias("_twin")), ["parcel_id", "first"], "left")
    other = met.where(~same & (F.col("sqm") > PARTLY_SQM)).join(twins.select("parcel_id", F.col("b").alias("a")), ["parcel_id", "a"], "left_anti")
    other = other.groupBy("parcel_id", F.col("b").alias("first")).agg(F.min("a").alias("_partly"))
    told = told.join(other, ["parcel_id", "first"], "left").withColumn("partly", F.col("_partly").isNotNull() & (kept | (F.col("_partly") < F.col("_twin"))))
    # Of the same vertices all but the first repeat the first, or what the first repeats.
    all_ = rows.join(told.select("parcel_id", "ring", "area", "first", "_twin", "partly"), ["parcel_id", "ring", "area"])
    repeats = F.when(F.col("turn") > F.col("first"), F.coalesce("_twin", "first")).otherwise(F.col("_twin"))
    return all_.select("parcel_id", F.col("turn.h").alias("handle"), repeats["h"].alias("kept_handle"), "partly")


def dedup_structures(footprints: DataFrame, by: list[str], tolerance: float = CLOSE_M) -> DataFrame:
    """footprints (by, take, area_sqm, x0, y0, x1, y1) without those that repeat a kept one of a lower `take`: the same key, areas and boxes within tolerance.

    Boxes meet in an equi-join on the key and the cell of their lower corner, each with its own cell and the eight about it, so corners on both sides of a line between
    cells meet too. Equal boxes are compared once. take must tell the footprints of a key apart.
    """
    box = ["area_sqm", "x0", "y0", "x1", "y1"]
    rows = saved(footprints, "footprints")
    one = saved(rows.groupBy(*by, *box).agg(F.min("take").alias("take")), "unlike")
    cell = 2 * tolerance
    at = lambda c: F.floor(F.col(c) / cell)
    about = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
    a = one.select(*by, F.col("take").alias("a"), *(F.col(c).alias(f"{c}_a") for c in box)).withColumn("_cx", at("x0_a")).withColumn("_cy", at("y0_a"))
    b = one.select(*by, F.col("take").alias("b"), *box).withColumn("_cx", about("x0")).withColumn("_cy", about("y0"))
    sides = [[F.col(f"{c}{s}") for c in box[1:]] for s in ("_a", "")]
    alike = by_cell(a, b, [*by, "_cx", "_cy"]).where((F.col("a") < F.col("b")) & same_footprint(F.col("area_sqm_a"), F.col("area_sqm"), *sides))
    twins = greedy_twins(alike, by)
    first = one.join(twins.select(*by, F.col("b").alias("take")), [*by, "take"], "left_anti").select(*by, "take")
    return rows.join(first, [*by, "take"], "left_semi")
