"""Registered queries on corridor edges: axes from pieces, outlines to edges, the walk along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayleave.operators import edges, lines, walk
from wayleave.plans import lattice as la
from wayleave.plans.registry import query, ringed

# A strip in the second row of each band, 12 m wide about an axis of three pieces; odd corridors run backwards.
STATIONS = [5, 105, 205, 305, 405, 505, 605, 700]
STRIP = f"""strip AS (SELECT DISTINCT p_partkey//400 AS corridor_id, 200.0*(p_partkey//400) AS y0 FROM part),
at_ AS (SELECT unnest({STATIONS}) AS x),
vertex AS (SELECT corridor_id, s.side, CAST(CASE WHEN corridor_id%2=0 THEN x-5 ELSE 700-x END AS DOUBLE) AS station, CAST(x AS DOUBLE) AS x, y0 + CASE WHEN (s.side='left') = (corridor_id%2=0) THEN 35 ELSE 23 END AS y FROM strip, at_, (SELECT unnest(['left','right']) AS side) s),
edge_ AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, side ORDER BY station) AS ord FROM vertex),
row_ AS (SELECT num//400 AS corridor_id, x0, x1, ekatte, parcel_id FROM parcel WHERE gy%10 = 1)"""


def _at(x, y):
    return F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("bulge"))


def strips(spark: SparkSession, d: str) -> DataFrame:
    return la.bands(spark, d).select("corridor_id", (200 * F.col("corridor_id")).alias("y"))


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """(corridor_id, verts): the strip's outline, with a vertex drawn twice and the first one again at the end."""
    low, high = F.col("y") + 23, F.col("y") + 35
    there = [_at(x, low) for x in STATIONS]
    return strips(spark, d).select("corridor_id", F.array(*there[:2], there[1], *there[2:], *(_at(x, high) for x in reversed(STATIONS)), there[0]).alias("verts"))


def axis_pieces(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y") + 29
    piece = lambda i, *xs: F.struct(F.lit(i).alias("ord"), F.array(*(_at(x, y) for x in xs)).alias("verts"))
    return strips(spark, d).select("corridor_id", F.explode(F.array(piece(0, 5, 205), piece(1, 700, 405), piece(2, 405, 205))).alias("p")).select("corridor_id", "p.*")


def axes(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.lit("9").alias("pole_no"), F.lit(600.0).alias("a")), F.struct(F.lit("10").alias("pole_no"), F.lit(100.0).alias("a")))).alias("e")
    poles = strips(spark, d).select("corridor_id", "y", ends).select("corridor_id", "e.pole_no", F.when(F.col("corridor_id") % 2 == 1, F.col("e.a")).otherwise(700 - F.col("e.a")).alias("x"), (F.col("y") + 29).cast("double").alias("y"))
    return edges.orient_axis(edges.chain_axis(axis_pieces(spark, d)), poles)


def split(spark: SparkSession, d: str) -> DataFrame:
    return edges.split_edges(outlines(spark, d), axes(spark, d))[0]


def listed(verts):
    return F.array_join(F.transform(verts, lambda p: p["x"].cast("long").cast("string")), ",")


@query("O12_dedupe_vertices", f", {STRIP} SELECT corridor_id, '{','.join(map(str, STATIONS + STATIONS[::-1]))}' AS xs FROM strip")
def _(spark, d):
    return outlines(spark, d).select("corridor_id", listed(edges.dedupe_vertices(F.col("verts"))).alias("xs"))


@query("O14_chain_axis", f", {STRIP} SELECT corridor_id, '5,205,405,700' AS xs FROM strip")
def _(spark, d):
    return edges.chain_axis(axis_pieces(spark, d)).select("corridor_id", listed(F.col("verts")).alias("xs"))


@query("O13_orient_axis", f", {STRIP} SELECT corridor_id, corridor_id%2=1 AS reversed, CASE WHEN corridor_id%2=1 THEN '700,405,205,5' ELSE '5,205,405,700' END AS xs FROM strip")
def _(spark, d):
    return axes(spark, d).select("corridor_id", "reversed", listed(F.col("verts")).alias("xs"))


@query("O07_split_edges", f", {STRIP} SELECT corridor_id, side, ord, x, CAST(y AS DOUBLE) AS y, station FROM edge_")
def _(spark, d):
    return split(spark, d).select("corridor_id", "side", "ord", "x", "y", F.round("station", 6).alias("station"))


@query("O07_outlines_without_edges", f", {STRIP} SELECT corridor_id, CASE WHEN corridor_id%3=1 THEN 1 ELSE 0 END AS left_runs, CASE WHEN corridor_id%3=1 THEN 0 ELSE 1 END AS right_runs FROM strip WHERE corridor_id%3 > 0")
def _(spark, d):
    # The axis of every third corridor stays; the others lie beside their strip.
    beside = F.when(F.col("corridor_id") % 3 == 1, -20.0).when(F.col("corridor_id") % 3 == 2, 20.0).otherwise(0.0)
    moved = strips(spark, d).select("corridor_id", F.array(_at(5, F.col("y") + 29 + beside), _at(700, F.col("y") + 29 + beside)).alias("verts"))
    return edges.split_edges(outlines(spark, d), moved)[1]


def segments(spark: SparkSession, d: str) -> DataFrame:
    lines_ = split(spark, d).groupBy("corridor_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "bulge"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["bulge"].alias("bulge"))).alias("verts"))
    return edges.line_segments(lines_, ["corridor_id", "side"])


HITS = """way AS (SELECT corridor_id, side, ord-1 AS ord, x AS xa, lead(x) OVER (PARTITION BY corridor_id, side ORDER BY ord) AS xb FROM edge_),
hit AS (SELECT DISTINCT w.corridor_id, w.side, w.ord, (m - xa)/(xb - xa) AS t FROM way w JOIN (SELECT corridor_id, unnest([x0, x1]) AS m FROM row_) USING (corridor_id) WHERE xb IS NOT NULL AND m > least(xa, xb) AND m < greatest(xa, xb))"""


@query("J23_segment_boundary_hits", f", {STRIP}, {HITS} SELECT corridor_id, side, ord, round(t, 6) AS t FROM hit")
def _(spark, d):
    hits = edges.boundary_hits(segments(spark, d), ringed(spark, d), ["corridor_id", "side", "ord"], la.CELL)
    return hits.select("corridor_id", "side", "ord", F.explode("cuts").alias("t")).withColumn("t", F.round("t", 6))


WALK = f"""{STRIP}, homed AS (SELECT e.*, r.ekatte FROM edge_ e LEFT JOIN row_ r ON r.corridor_id = e.corridor_id AND e.x >= r.x0 AND e.x < r.x1),
met AS (SELECT v.corridor_id, v.side, CAST(CASE WHEN v.corridor_id%2=0 THEN a.x1-5 ELSE 700-a.x1 END AS DOUBLE) AS station, a.x1 AS x, v.y, CASE WHEN v.corridor_id%2=0 THEN a.ekatte ELSE b.ekatte END AS f, CASE WHEN v.corridor_id%2=0 THEN b.ekatte ELSE a.ekatte END AS t
  FROM (SELECT DISTINCT corridor_id, side, y FROM edge_) v JOIN row_ a USING (corridor_id) JOIN row_ b ON b.corridor_id = a.corridor_id AND b.x0 = a.x1 WHERE a.ekatte <> b.ekatte AND a.x1 < 700),
walked AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, side ORDER BY station) AS ord FROM (
  SELECT corridor_id, side, station, x, y, false AS is_boundary, coalesce(ekatte, '') AS ekattes FROM homed UNION ALL SELECT corridor_id, side, station, x, y, true, f || ',' || t FROM met))"""


def walked(spark: SparkSession, d: str) -> DataFrame:
    return walk.walk_edges(split(spark, d), ringed(spark, d), la.CELL)


@query("O09_walk_edge", f", {WALK} SELECT corridor_id, side, ord, x, CAST(y AS DOUBLE) AS y, is_boundary, ekattes, CASE WHEN is_boundary THEN 1 ELSE 0 END AS merged_hits, CASE WHEN corridor_id%2=0 THEN 0.0 ELSE 3.141593 END AS direction FROM walked")
def _(spark, d):
    return walked(spark, d).select("corridor_id", "side", "ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "is_boundary", F.array_join("ekattes", ",").alias("ekattes"), "merged_hits", F.round(F.abs("direction"), 6).alias("direction"))


@query("A21_walk_stats", f", {WALK} SELECT corridor_id, side, count(*) FILTER (NOT is_boundary) AS vertices, count(*) FILTER (NOT is_boundary AND ekattes = '') AS outside, count(*) FILTER (is_boundary) AS boundary, 0 AS snapped, 0 AS gaps, 0 AS overlaps, count(*) FILTER (is_boundary) AS merged_hits, 0 AS merged, 0 AS bridged FROM walked GROUP BY ALL")
def _(spark, d):
    return walk.walk_stats(walked(spark, d), ["corridor_id", "side"])


@query("P12_listed_points", f", {WALK} SELECT corridor_id, side, ord, ekattes FROM walked WHERE ekattes <> ''")
def _(spark, d):
    return lines.listed_points(walked(spark, d)).select("corridor_id", "side", "ord", F.array_join("ekattes", ",").alias("ekattes"))


@query(
    "K09_corridor_print_rows",
    f", {WALK}, numbered AS (SELECT *, split_part(ekattes, ',', 1) AS e1, nullif(split_part(ekattes, ',', 2), '') AS e2, row_number() OVER (PARTITION BY corridor_id, side ORDER BY ord) + CASE WHEN side='left' THEN 5000 ELSE 0 END AS number FROM walked WHERE ekattes <> ''), "
    "each_ AS (SELECT corridor_id, side, number, x, y, e1 AS ekatte FROM numbered UNION ALL SELECT corridor_id, side, number, x, y, e2 FROM numbered WHERE e2 IS NOT NULL), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, ekatte, side ORDER BY number) AS row_ord FROM each_) "
    "SELECT coalesce(l.corridor_id, r.corridor_id) AS corridor_id, coalesce(l.ekatte, r.ekatte) AS ekatte, coalesce(l.row_ord, r.row_ord) AS row_ord, l.number AS left_no, CAST(l.y AS DOUBLE) AS left_north, l.x AS left_east, r.number AS right_no, CAST(r.y AS DOUBLE) AS right_north, r.x AS right_east "
    "FROM (SELECT * FROM placed WHERE side='left') l FULL JOIN (SELECT * FROM placed WHERE side='right') r ON l.corridor_id=r.corridor_id AND l.ekatte=r.ekatte AND l.row_ord=r.row_ord",
)
def _(spark, d):
    return lines.corridor_print_rows(walked(spark, d))


@query("J10_resolve_with_gap", ", p AS (SELECT num//400 AS corridor_id, x0, ekatte, y1-20*gy >= 19.75 AS own FROM parcel WHERE gy%10 = 1) SELECT corridor_id, CAST(x0 AS BIGINT)//20 AS ord, CASE WHEN max(own) OVER (PARTITION BY corridor_id, ekatte ORDER BY x0) THEN ekatte END AS ekatte FROM p")
def _(spark, d):
    # Points half a metre below the upper end of cells, where two of three parcels leave a gap.
    p = la.parcels(spark, d).where("floor(num / 40) % 10 = 1")
    points = p.select(F.floor(F.col("num") / 400).alias("corridor_id"), F.floor(F.col("x0") / 20).alias("ord"), (F.col("x0") + 10).alias("x"), (F.col("y0") + 19.5).alias("y"))
    return walk.resolve_with_gap(points, ringed(spark, d), ["corridor_id"], la.CELL)


# Scenes for the walk, one after another along x in each corridor: settlement A up to x = 10, B from there, and an edge through them.
# (case, where B begins, the edge's vertices)
SCENES = [
    ("snap", 10.0, [(2, 0), (10.03, 0), (18, 0)]),
    ("gap", 11.0, [(2, 0), (18, 0)]),
    ("overlap", 9.7, [(2, 0), (18, 0)]),
    ("bridge", 10.0, [(5, 0), (10, 0), (15, 0)]),
    ("merge", 10.0, [(2, 0), (10.02, 0), (10.03, 0), (2, 1)]),
    ("carried", 12.5, [(2, 0), (11, 0), (11.5, 0), (18, 0)]),
]
SAID = """said AS (SELECT * FROM (VALUES
  ('snap', 1, 2.0, false, 'A', 0.0, 1, 0, 0.0, false, false, false), ('snap', 2, 10.03, false, 'A,B', 0.03, 0, 0, 0.0, false, false, false), ('snap', 3, 18.0, false, 'B', 0.0, 0, 0, 0.0, false, false, false),
  ('gap', 1, 2.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false), ('gap', 2, 10.0, true, 'A,B', 0.0, 0, 2, 1.0, false, false, false), ('gap', 3, 18.0, false, 'B', 0.0, 0, 0, 0.0, false, false, false),
  ('overlap', 1, 2.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false), ('overlap', 2, 9.7, true, 'A,B', 0.0, 0, 2, 0.3, true, false, false), ('overlap', 3, 18.0, false, 'B', 0.0, 0, 0, 0.0, false, false, false),
  ('bridge', 1, 5.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false), ('bridge', 2, 10.0, false, 'B,A', 0.0, 0, 0, 0.0, false, false, true), ('bridge', 3, 15.0, false, 'B', 0.0, 0, 0, 0.0, false, false, false),
  ('merge', 1, 2.0, false, 'A', 0.0, 1, 0, 0.0, false, false, false), ('merge', 2, 10.02, false, 'A,B', 0.02, 0, 0, 0.0, false, false, false), ('merge', 3, 10.03, false, 'B,A', 0.03, 1, 0, 0.0, false, true, true), ('merge', 4, 2.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false),
  ('carried', 1, 2.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false), ('carried', 2, 11.0, false, 'A', 0.0, 0, 0, 0.0, false, false, false), ('carried', 3, 11.5, false, 'A,B', 0.0, 1, 0, 0.0, false, false, false), ('carried', 4, 18.0, false, 'B', 0.0, 0, 0, 0.0, false, false, false)
) v("case", ord, x, is_boundary, ekattes, snap_m, snapped, merged_hits, span_m, is_overlap, merged, bridged)), strip AS (SELECT DISTINCT p_partkey//400 AS corridor_id FROM part)"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """The walk through the scenes of every corridor; x counts from the scene's beginning."""
    rows = strips(spark, d)
    pair = lambda x, y: F.struct(F.lit(float(x)).alias("x"), (F.col("y") + y).cast("double").alias("y"))
    box = lambda a, b: F.array(pair(a, -5), pair(b, -5), pair(b, 5), pair(a, 5))
    shapes, edge = [], []
    for i, (name, begin, verts) in enumerate(SCENES):
        at = 100 * i
        shapes += [F.struct(F.lit(f"A{i}").alias("e"), F.lit(0).alias("ord"), box(at, at + 10).alias("ring")), F.struct(F.lit(f"B{i}").alias("e"), F.lit(1).alias("ord"), box(at + begin, at + 20).alias("ring"))]
        edge += [F.struct(F.lit(name).alias("side"), F.lit(k + 1).alias("ord"), F.lit(float(at + x)).alias("x"), (F.col("y") + y).cast("double").alias("y")) for k, (x, y) in enumerate(verts)]
    s = rows.select("corridor_id", "y", F.explode(F.array(*shapes)).alias("s")).select(F.concat("s.e", F.lit("-"), F.col("corridor_id").cast("string")).alias("ekatte"), "s.ord", "s.ring")
    e = rows.select("corridor_id", F.explode(F.array(*edge)).alias("v")).select("corridor_id", "v.*", F.lit(0.0).alias("bulge"))
    begin = F.element_at(F.create_map(*(F.lit(v) for i, (name, _, _) in enumerate(SCENES) for v in (name, 100.0 * i))), F.col("case"))
    walked_ = walk.walk_edges(e, s, la.CELL).withColumnRenamed("side", "case")
    return walked_.withColumn("x", F.round(F.col("x") - begin, 6)).withColumn("ekattes", F.array_join(F.transform("ekattes", lambda c: F.substr(c, F.lit(1), F.lit(1))), ","))


@query("O09_walk_cases", f'WITH {SAID} SELECT corridor_id, "case", ord, x::DOUBLE AS x, is_boundary, ekattes, snap_m::DOUBLE AS snap_m, snapped, merged_hits, span_m::DOUBLE AS span_m, is_overlap, merged, bridged FROM strip, said', lattice=False)
def _(spark, d):
    """Vertices that take a crossing near them, a gap and an overlap of settlements, neighbours with nothing in common, shared neighbours that become one, a settlement carried over a gap."""
    w = scenes(spark, d)
    return w.select("corridor_id", "case", "ord", "x", "is_boundary", "ekattes", F.round("snap_m", 3).alias("snap_m"), "snapped", "merged_hits", F.round("span_m", 6).alias("span_m"), "is_overlap", "merged", "bridged")


@query(
    "A21_walk_case_stats",
    f"""WITH {SAID} SELECT corridor_id, "case", count(*) FILTER (NOT is_boundary) AS vertices, 0 AS outside, count(*) FILTER (is_boundary) AS boundary, sum(snapped)::BIGINT AS snapped, count(*) FILTER (span_m > 0 AND NOT is_overlap) AS gaps, count(*) FILTER (span_m > 0 AND is_overlap) AS overlaps, sum(merged_hits)::BIGINT AS merged_hits, count(*) FILTER (merged) AS merged, count(*) FILTER (bridged) AS bridged FROM strip, said GROUP BY ALL""",
    lattice=False,
)
def _(spark, d):
    return walk.walk_stats(scenes(spark, d), ["corridor_id", "case"])
