"""The walk along corridor edges: each vertex with its settlement, a point wherever an edge passes into another one, shared points.

What a vertex inherits from those before it is a prefix maximum: which settlement was set last, and whether a vertex since then lost it.
Such prefixes are taken in two steps (`running`), within spans of an edge and over the spans' totals, so one long edge is
work for many tasks. Everything else looks at a segment's own pieces or at a point's neighbour, by joins on place numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.functions import geometry
from wayleave.operators.edges import SAME_M, boundary_hits, classified_pieces, point_at
from wayleave.operators.lines import boundary_crossings, containing
from wayleave.operators.shapes import distance_to_settlements
from wayleave.sources.saved import saved

CLUSTER_M, SNAP_M, GAP_M = 0.5, 0.05, 2.0
#: Place numbers of an edge that one task looks at together.
SPAN = 4096


def running(rows: DataFrame, by: list[str], at: str, totals: dict[str, tuple[str, Column]], before: bool = False, span: int = SPAN) -> DataFrame:
    """rows with `name` = the "max" or "sum" of an expression over all rows of the group up to this one (`before`: without it), in order of the whole number `at`.

    rows should be saved: they are read twice. A span's rows meet in one task, and a group's totals by span, not its rows.
    """
    how = {"max": F.max, "sum": F.sum}
    rows = rows.withColumn("_span", F.floor(F.col(at) / span))
    each = {n: (kind, expr) for n, (kind, expr) in totals.items()}
    ends = rows.groupBy(*by, "_span").agg(*(how[kind](expr).alias(f"_{n}") for n, (kind, expr) in each.items()))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_span", *(how[kind](f"_{n}").over(earlier).alias(f"_{n}") for n, (kind, _) in each.items()))
    within = Window.partitionBy(*by, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = rows.select("*", *(how[kind](expr).over(within).alias(n) for n, (kind, expr) in each.items()))
    met = here.join(carry, [*by, "_span"], "left")
    for n, (kind, _) in each.items():
        met = met.withColumn(n, F.greatest(n, f"_{n}") if kind == "max" else F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)))
    return met.drop("_span", *(f"_{n}" for n in each))


def beside(rows: DataFrame, by: list[str], at: str, step: int, **columns: str) -> DataFrame:
    """rows with columns (name=column) of the row whose number is `step` more."""
    other = rows.select(*by, (F.col(at) - step).alias(at), *(F.col(c).alias(n) for n, c in columns.items()))
    return rows.join(other, [*by, at], "left")


def settled(points: DataFrame, shapes: DataFrame, keys: list[str], cell: float, gap: float) -> DataFrame:
    """points with own (settlement that holds them) and near (settlements within gap)."""
    own = containing(points.select(*keys, "x", "y"), shapes.select("ring", F.col("ord").alias("_ord"), "ekatte"), cell).groupBy(*keys).agg(F.min_by("ekatte", "_ord").alias("own"))
    near = distance_to_settlements(points.select(*keys, "x", "y"), shapes, keys, gap, cell).groupBy(*keys).agg(F.collect_set("ekatte").alias("near"))
    return points.join(own, keys, "left").join(near, keys, "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))


def inherited(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, ord, own, near, passes, changes) with `ekatte`: a point's own settlement, else the one before it if that lies near, else null.

    passes is the settlement that the way to the next point ends in (null: none), changes whether it is certain to change on the way. What comes
    before a point is the last settlement set, by a way or a point; it is lost at a point that has none of its own and does not lie near it, until a point or
    a change sets one again.
    """
    set_ = F.coalesce("passes", "own")
    rows = running(points, by, "ord", {"_set": ("max", F.when(set_.isNotNull(), F.struct("ord", set_.alias("e"))))}, before=True)
    rows = rows.withColumn("_was", F.col("_set.e")).drop("_set")
    near = F.coalesce(F.array_contains("near", F.col("_was")), F.lit(False))
    anew = F.col("own").isNotNull() | F.col("changes")
    rows = rows.withColumn("_near", near).withColumn("_anew", anew)
    rows = running(saved(rows, "inherited"), by, "ord", {"_lost": ("max", F.when(~F.col("_anew") & ~F.col("_near"), F.col("ord"))), "_found": ("max", F.when(F.col("_anew"), F.col("ord")))}, before=True)
    alive = F.col("_found").isNotNull() & (F.col("_lost").isNull() | (F.col("_lost") < F.col("_found")))
    return rows.withColumn("ekatte", F.coalesce("own", F.when(alive & F.col("_near"), F.col("_was")))).drop("_was", "_near", "_anew", "_lost", "_found")


def resolve_with_gap(points: DataFrame, shapes: DataFrame, by: list[str], cell: float = 50.0, gap: float = GAP_M) -> DataFrame:
    """points (by, ord, x, y) with `ekatte`: that of the first shape (ekatte, ord, ring) that holds the point, else that of the point before if one of its shapes lies within gap, else null."""
    keys = [*by, "ord"]
    known = saved(settled(points, shapes, keys, cell, gap).withColumns({"passes": F.lit(None).cast("string"), "changes": F.lit(False)}), "settled")
    return inherited(known, by).select(*keys, "ekatte")


def _heading(start: bool) -> Column:
    """Direction of a segment (x0, y0, x1, y1, bulge) at its start or end."""
    turn = 2 * F.atan("bulge")
    return F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) + (-turn if start else turn)


def _met(ways: DataFrame, pieces: DataFrame, hits: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Where each segment passes from one settlement into another: (keys, at, a, b, merged_hits, span_m, x, y, mid_x, mid_y, direction, here, there, to), `to` says what takes it: the vertex before, the one behind, or a point of its own."""
    metres = lambda c: F.col(c) * F.col("length")
    parts = pieces.join(states.select(*keys, F.col("ekatte").alias("start_ekatte")), keys).select(*keys, metres("a").alias("a"), metres("b").alias("b"), "ekatte", "start_ekatte")
    lengths = pieces.groupBy(*keys).agg(F.first("length").alias("length"))
    cuts = hits.join(lengths, keys).select(*keys, F.explode("cuts").alias("m"), "length").select(*keys, metres("m").alias("m"))
    found = boundary_crossings(parts, cuts, keys, CLUSTER_M).join(ways, keys).join(lengths, keys)
    place = lambda c: point_at(F.col(c) / F.col("length"))
    (x, y), (mx, my) = place("at"), place("middle")
    found = found.withColumns({"x": x, "y": y, "mid_x": mx, "mid_y": my})
    found = found.withColumn("direction", F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) + (2 * F.col("at") / F.col("length") - 1) * 2 * F.atan("bulge"))
    found = found.withColumn("here", F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).withColumn("there", F.hypot(F.col("x") - F.col("x1"), F.col("y") - F.col("y1")))
    even = F.abs(F.col("here") - F.col("there")) < SAME_M
    first = (F.col("here") < F.col("there")) | (even & (F.struct("x0", "y0") <= F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"))))
    to = F.when((F.col("here") <= SNAP_M) & first, "before").when((F.col("there") <= SNAP_M) & (~first | (F.col("here") > SNAP_M)), "behind").otherwise("own")
    return found.select(*keys, "at", F.col("from_ekatte").alias("a"), F.col("to_ekatte").alias("b"), "merged_hits", F.col("span").alias("span_m"), "x", "y", "mid_x", "mid_y", "direction", "here", "there", to.alias("to"))


WALKED = ["x", "y", "direction", "is_boundary", "ekattes", "own", "outside", "snap_m", "snapped", "nearest_vertex_m", "merged_hits", "span_m", "mid_x", "mid_y"]


def _walked(edges: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """(corridor_id, side, ord, WALKED): vertices and inserted points, numbered along each edge."""
    side = ["corridor_id", "side"]
    keys = [*side, "ord"]
    ways = beside(edges, side, "ord", 1, x1="x", y1="y").where("x1 is not null").select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", "bulge")
    ways = saved(ways, "ways")
    hits = saved(boundary_hits(ways, shapes, keys, cell), "hits")
    crossed = ways.join(hits.select(*keys), keys, "left_semi")
    pieces = saved(classified_pieces(crossed, hits, shapes, keys, "ekatte", cell), "pieces")

    order = Window.partitionBy(*keys).orderBy("a")
    ends = (F.row_number().over(order) == 1) | F.lead("a").over(order).isNull()
    kept = pieces.withColumn("_ends", ends).where(F.col("_ends") | ((F.col("b") - F.col("a")) * F.col("length") >= CLUSTER_M)).where("ekatte is not null")
    passes = kept.groupBy(*keys).agg(F.max_by("ekatte", "a").alias("passes"), (F.min("ekatte") != F.max("ekatte")).alias("changes"))
    states = settled(edges, shapes, keys, cell, GAP_M).join(passes, keys, "left").na.fill(False, ["changes"])
    states = saved(inherited(saved(states, "states"), side), "states").drop("near", "passes", "changes")
    met = saved(_met(ways, pieces, hits, states, keys), "met")

    before = met.where("to = 'before'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "here"))).alias("_before"))
    behind = met.where("to = 'behind'").groupBy(*keys).agg(F.max_by(F.struct("a", "b", "there"), "at").alias("_behind"), F.count(F.lit(1)).alias("_sent"))
    waiting = behind.select(*side, (F.col("ord") + 1).alias("ord"), F.col("_behind"))
    own = met.where("to = 'own'")
    inserted = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    come = ways.select(*side, (F.col("ord") + 1).alias("ord"), _heading(False).alias("_come"))
    go = ways.select(*keys, _heading(True).alias("_go"))
    v = states
    for other in (before, behind.select(*keys, "_sent"), waiting, inserted, come, go):
        v = v.join(other, keys, "left")
    shared = F.flatten(F.transform(F.coalesce("_before", F.array().cast("array<struct<at:double,a:string,b:string,here:double>>")), lambda s: F.array(s["a"], s["b"])))
    v = v.withColumn("ekattes", F.array_distinct(F.array_compact(F.concat(F.array("_behind.a", "_behind.b", "ekatte"), shared))))
    v = v.withColumn("snap_m", F.coalesce(F.try_element_at("_before", F.lit(-1))["here"], F.col("_behind.there"), F.lit(0.0)))
    v = v.withColumn("snapped", (F.coalesce(F.size("_before"), F.lit(0)) * F.col("_before").isNotNull().cast("int") + F.coalesce("_sent", F.lit(0))).cast("long"))
    v = v.withColumn("direction", F.when(F.col("_come").isNull(), F.col("_go")).when(F.col("_go").isNull(), F.col("_come")).otherwise(geometry.bisector(F.col("_come"), F.col("_go"))))
    v = v.withColumn("outside", F.col("_behind").isNull() & F.col("ekatte").isNull())
    v = running(saved(v, "vertices"), side, "ord", {"_to": ("sum", F.lit(1) + F.coalesce("_more", F.lit(0)))}, before=True).withColumn("_number", F.col("_to") + 1)
    # Points of its own stand behind the vertex that their segment begins at.
    inner = own.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).join(v.select(*keys, "_number"), keys)
    none = lambda kind: F.lit(None).cast(kind)
    vertices = v.select(*side, F.col("_number").cast("long").alias("ord"), "x", "y", "direction", F.lit(False).alias("is_boundary"), "ekattes", F.col("ekatte").alias("own"), "outside", "snap_m", "snapped",
                        none("double").alias("nearest_vertex_m"), F.lit(0).cast("long").alias("merged_hits"), F.lit(0.0).alias("span_m"), none("double").alias("mid_x"), none("double").alias("mid_y"))
    points = inner.select(*side, (F.col("_number") + F.col("_i")).cast("long").alias("ord"), "x", "y", "direction", F.lit(True).alias("is_boundary"), F.array_distinct(F.array("a", "b")).alias("ekattes"), none("string").alias("own"), F.lit(False).alias("outside"), F.lit(0.0).alias("snap_m"), F.lit(0).cast("long").alias("snapped"),
                          F.least("here", "there").alias("nearest_vertex_m"), F.col("merged_hits").cast("long").alias("merged_hits"), "span_m", "mid_x", "mid_y")
    return vertices.unionByName(points)


def _merged(points: DataFrame, side: list[str]) -> DataFrame:
    """points with ekattes and `merged`: of neighbouring shared points of one pair, all within their own settlements, one stays shared."""
    sets = F.array_sort("ekattes")
    rows = beside(points.withColumn("_set", sets), side, "ord", -1, _px="x", _py="y", _pset="_set")
    linked = (F.size("_set") > 1) & (F.col("_set") == F.col("_pset")) & (F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")) <= CLUSTER_M)
    rows = saved(rows.withColumn("_linked", F.coalesce(linked, F.lit(False))).drop("_px", "_py", "_pset", "_set"), "linked")
    rows = saved(running(rows, side, "ord", {"_from": ("max", F.when(~F.col("_linked"), F.col("ord")))}), "groups")
    group = [*side, "_from"]
    home = F.coalesce(F.array_contains("ekattes", F.col("own")), F.lit(False))
    told = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(home).alias("_home"), F.min_by("ord", F.struct(~F.col("is_boundary"), "snap_m", "x", "y", "ord")).alias("_best"))
    told = told.where("_n > 1 and _home").select(*group, "_best")
    rows = rows.join(told, group, "left").withColumn("merged", F.coalesce(F.col("_best") != F.col("ord"), F.lit(False)))
    return rows.withColumn("ekattes", F.when(F.col("merged"), F.array("own")).otherwise(F.col("ekattes"))).drop("_linked", "_from", "_best")


def _bridged(points: DataFrame, side: list[str]) -> DataFrame:
    """points (saved) with ekattes, snap_m and `bridged`: of two neighbours with nothing in common the one nearer to the other's settlement shares it.

    A point that took over its predecessor's settlement meets its successor with it. So pairs without common settlements are judged in
    rounds: in each, a pair knows what its first point had taken over after the round before, until nothing changes. A chain of such
    pairs of length n takes n rounds at most; usually pairs stand alone and the second round confirms the first.
    """
    nxt = {f"n_{c}": c for c in ("x", "y", "ekattes", "far")}
    pairs = beside(points.select(*side, "ord", "x", "y", "ekattes", "far"), side, "ord", 1, **nxt)
    pairs = saved(pairs.where((F.size("ekattes") > 0) & (F.size("n_ekattes") > 0) & ~F.arrays_overlap("ekattes", "n_ekattes")), "apart")
    took = pairs.select(*side, "ord").limit(0).withColumn("took", F.lit("")).withColumn("snap", F.lit(0.0))
    mark = None
    to = F.element_at("n_ekattes", 1)
    far = lambda m, e: F.coalesce(F.try_element_at(m, e), F.lit(math.inf))
    while True:
        now = pairs.join(took.select(*side, "ord", "took"), [*side, "ord"], "left")
        now = now.where(F.col("took").isNull() | ~F.array_contains("n_ekattes", F.col("took")))
        from_ = F.coalesce("took", F.element_at("ekattes", -1))
        now = now.withColumn("_from", from_).withColumn("_to", to).withColumn("_a", far(F.col("far"), to)).withColumn("_b", far(F.col("n_far"), from_))
        first = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.struct("x", "y") <= F.struct(F.col("n_x").alias("x"), F.col("n_y").alias("y"))))
        now = saved(now.select(*side, "ord", first.alias("_first"), "_from", "_to", F.least("_a", "_b").alias("snap")), "bridges")
        took = now.where("not _first").select(*side, (F.col("ord") + 1).alias("ord"), F.col("_from").alias("took"), "snap")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*side, "ord", "_first", "_from").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    gave = now.where("_first").select(*side, "ord", F.col("_to").alias("gave"), F.col("snap").alias("_snap"))
    rows = points.join(took, [*side, "ord"], "left").join(gave, [*side, "ord"], "left")
    rows = rows.withColumn("bridged", F.col("took").isNotNull() | F.col("gave").isNotNull()).withColumn("snap_m", F.coalesce("_snap", "snap", "snap_m"))
    return rows.withColumn("ekattes", F.concat("ekattes", F.array_compact(F.array("took", "gave")))).drop("took", "gave", "snap", "_snap")


def walk_edges(edges: DataFrame, shapes: DataFrame, cell: float = 50.0, reach: float = 50.0) -> DataFrame:
    """All points of corridor edges with their settlements: vertices, and a point wherever an edge goes from one settlement into another.

    edges (corridor_id, side, ord, x, y, bulge) with consecutive numbers `ord` along each edge, shapes (ekatte, ord, ring). A crossing within SNAP_M of a vertex
    makes the nearer vertex a shared one instead; neighbouring shared points of one pair within CLUSTER_M are one; neighbours in
    different settlements with nothing shared make the one nearer to the other's parcels (looked for within reach) a shared
    one. Adds merged (given back to its own settlement) and bridged (made shared).
    """
    side = ["corridor_id", "side"]
    keys = [*side, "ord"]
    edges = saved(edges.select(F.col("corridor_id").cast("long"), "side", F.col("ord").cast("long"), "x", "y", "bulge"), "edges")
    first = saved(_walked(edges, shapes, cell), "walk")
    # Hits of one crossing that lie apart: an overlap where their middle is in more than one settlement, else a gap.
    middle = first.where("span_m > 0").select(*keys, F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
    over = containing(middle, shapes.select("ring", "ekatte"), cell).groupBy(*keys).agg((F.countDistinct("ekatte") > 1).alias("is_overlap"))
    merged = saved(_merged(first.drop("mid_x", "mid_y").join(over, keys, "left").na.fill(False, ["is_overlap"]), side), "merged")
    far = distance_to_settlements(merged.select(*keys, "x", "y"), shapes, keys, reach, cell).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ekatte", "dist"))).alias("far"))
    rows = saved(merged.join(far, keys, "left").withColumn("far", F.coalesce("far", F.create_map().cast("map<string,double>"))), "known")
    return _bridged(rows, side).select(*keys, *WALKED[:-2], "is_overlap", "merged", "bridged")


def walk_stats(points: DataFrame, by: list[str]) -> DataFrame:
    """What walk_edges() met on the way: vertices, those outside, inserted points, snapped crossings, gaps, overlaps, hits, merged and bridged points."""
    n = lambda c: F.sum(c.cast("long"))
    b, span = F.col("is_boundary"), F.col("span_m") > 0
    return points.groupBy(*by).agg(
        n(~b).alias("vertices"), n(F.col("outside")).alias("outside"), n(b).alias("boundary"), F.sum("snapped").alias("snapped"), n(span & ~F.col("is_overlap")).alias("gaps"),
        n(span & F.col("is_overlap")).alias("overlaps"), F.sum("merged_hits").alias("merged_hits"), n(F.col("merged")).alias("merged"), n(F.col("bridged")).alias("bridged"),
    )
