"""Shapes that repeat, nearest neighbours, distances, and walks along points that need the last kept one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.operators.lines import containing
from wayleave.operators.overlay import by_cell


def nearest_centroid(points: DataFrame, targets: DataFrame, keys: list[str], reach: float = 50.0, ratio: float = 0.5) -> DataFrame:
    """(keys, target, dist): the nearest target within reach whose area is like the point's; of equals the one with the least `ord`.

    Targets go to their cell and its neighbours, points to their own: an equi-join.
    """
    p = points.withColumn("_cx", F.floor(F.col("x") / reach)).withColumn("_cy", F.floor(F.col("y") / reach))
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / reach) - 1, F.floor(F.col(c) / reach) + 1))
    t = targets.select("target", "ord", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("area").alias("tarea")).withColumn("_cx", near("tx")).withColumn("_cy", near("ty"))
    dist = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    met = by_cell(p, t, ["_cx", "_cy"]).withColumn("dist", dist).where((F.col("dist") < reach) & (F.least("area", "tarea") >= ratio * F.greatest("area", "tarea")))
    return met.groupBy(*keys).agg(F.min_by(F.struct("target", "dist"), F.struct("dist", "ord")).alias("m")).select(*keys, "m.target", "m.dist")


def ring_edges(shapes: DataFrame) -> DataFrame:
    """shapes with a ring -> its other columns and one row for each edge (ax, ay, bx, by), the last to the first vertex too."""
    n = F.size("ring")
    at = F.posexplode("ring").alias("_i", "_p")
    to = F.element_at("ring", F.when(F.col("_i") + 1 == n, F.lit(1)).otherwise(F.col("_i") + 2))
    rows = shapes.select("*", at).select("*", to.alias("_q"))
    return rows.select(*(F.col(c) for c in shapes.columns if c != "ring"), F.col("_p.x").alias("ax"), F.col("_p.y").alias("ay"), F.col("_q.x").alias("bx"), F.col("_q.y").alias("by"))


def distance_to_settlements(points: DataFrame, shapes: DataFrame, keys: list[str], reach: float, cell: float = 50.0) -> DataFrame:
    """(keys, ekatte, dist): distance of each point to the nearest shape of each settlement within reach, 0 inside. Shapes need a ring.

    Edges are cut into pieces no longer than a cell (or than reach, if that is more), each of which goes to the few cells
    about it: an equi-join, whatever the length of edges and rings.
    """
    cell = max(cell, reach)
    e = ring_edges(shapes.select("ekatte", "ring"))
    k = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / cell), F.lit(1)).cast("int")
    e = e.withColumn("_k", k).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cut = lambda c, j: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * j / F.col("_k")
    e = e.select("ekatte", *(cut(c, F.col("_j") + n).alias(f"{c}{n}") for n in (0, 1) for c in ("x", "y")))
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"{c}0", f"{c}1") - reach) / cell), F.floor((F.greatest(f"{c}0", f"{c}1") + reach) / cell)))
    e = e.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    p = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(length > 0, length)))).otherwise(F.lit(0.0))
    near = by_cell(p, e, ["_cx", "_cy"]).select(*keys, "ekatte", F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy).alias("dist")).where(F.col("dist") <= reach)
    inside = containing(points, shapes.select("ekatte", "ring"), cell).select(*keys, "ekatte", F.lit(0.0).alias("dist"))
    return near.unionByName(inside).groupBy(*keys, "ekatte").agg(F.min("dist").alias("dist"))


RUNS = 1000


def merged_close(points: DataFrame, by: list[str], gap: float = 0.01) -> DataFrame:
    """Points in order without those closer than gap to the last kept one, whose settlements they join.

    A point further from the one before it than twice the gap (three times, for rounding) is kept whatever came before, so
    an edge is worked off in runs between such points, RUNS at a time.
    """
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        kept: list[dict] = []
        for r in pdf.to_dict("records"):
            if kept and np.hypot(r["x"] - kept[-1]["x"], r["y"] - kept[-1]["y"]) < gap:
                kept[-1]["ekattes"] = sorted({*kept[-1]["ekattes"], *r["ekattes"]})
            else:
                kept.append(r | {"ekattes": list(r["ekattes"])})
        return pd.DataFrame(kept, columns=pdf.columns)

    order = Window.partitionBy(*by).orderBy("ord")
    far = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)) >= 3 * gap, F.lit(True))
    runs = points.withColumn("_far", far).withColumn("_run", F.floor(F.sum(F.col("_far").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) / RUNS)).drop("_far")
    return runs.groupBy(*by, "_run").applyInPandas(lambda pdf: run(pdf.drop(columns="_run")), ", ".join(f"{c} {k}" for c, k in kinds.items()))
