"""Registered queries on drawn outlines: retraced ends, arcs, sanitised shapes, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayleave.operators import outlines as ol
from wayleave.operators import overlay
from wayleave.plans import lattice as la
from wayleave.plans import routes
from wayleave.plans.registry import query

STATIONS = routes.STATIONS


def _at(x, y, bulge=0.0):
    bulge = F.lit(bulge) if isinstance(bulge, float) else bulge
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), bulge.cast("double").alias("bulge"))


def retraced(spark: SparkSession, d: str) -> DataFrame:
    """A line for each parcel, bent to one side, that starts num % 2 vertices late and goes back num % 3 vertices at its end; every seventh is closed."""
    k, m = F.col("num") % 2, (F.col("num") % 3).cast("int")
    xs = [F.lit(float(x)) for x in STATIONS]
    head = F.when(k == 1, F.array(_at(xs[1], F.col("y0"), -0.1))).otherwise(F.slice(F.array(_at(xs[1], F.col("y0"), -0.1)), 1, 0))
    line = [_at(x, F.col("y0"), 0.1) for x in xs[:-1]]
    tip = _at(xs[-1], F.col("y0"), F.when(m > 0, -0.1).otherwise(0.0))
    back = F.transform(F.slice(F.array(*reversed(xs[:-1])), F.lit(1), m), lambda x, i: _at(x, F.col("y0"), F.when(i + 1 < m, -0.1).otherwise(0.0)))
    return la.parcels(spark, d).select("num", (F.col("num") % 7 == 0).alias("closed"), F.concat(head, F.array(*line, tip), back).alias("verts"))


@query(
    "O15_remove_retraced_ends",
    f", line_ AS (SELECT num, num%2 AS k, num%3 AS m, num%7=0 AS closed, {STATIONS} AS s FROM parcel) SELECT num, CAST(CASE WHEN closed THEN 0 ELSE k END AS BIGINT) AS removed_start, CAST(CASE WHEN closed THEN 0 ELSE m END AS BIGINT) AS removed_end, "
    "array_to_string(CASE WHEN closed THEN list_concat(s[2:1+k], s, list_reverse(s)[2:1+m]) ELSE s END, ',') AS xs, CAST(0 AS DOUBLE) AS last_bulge FROM line_",
)
def _(spark, d):
    out = ol.remove_retraced_ends(retraced(spark, d))
    last = F.round(F.element_at("verts", -1)["bulge"], 6)
    return out.select("num", F.col("removed_start").cast("long").alias("removed_start"), F.col("removed_end").cast("long").alias("removed_end"), routes.listed(F.col("verts")).alias("xs"), last.alias("last_bulge"))


def domes(spark: SparkSession, d: str) -> DataFrame:
    """A half circle for each parcel, of radius 5 to 44 m, and a third vertex; two of three are closed."""
    r = 5 + F.col("num") % 40
    verts = F.array(_at(F.col("x0"), F.col("y0"), 1.0), _at(F.col("x0") + 2 * r, F.col("y0")), _at(F.col("x0") + (F.col("num") % 6) / 2, F.col("y0")))
    return la.parcels(spark, d).select("num", (F.col("num") % 3 != 0).alias("closed"), verts.alias("verts"))


DOME = """dome AS (SELECT num, x0, y0, 5+num%40 AS r, pi()*(5+num%40) AS len, num%3<>0 AS closed FROM parcel),
cuts AS (SELECT *, CASE WHEN len <= 20 THEN [0.5] ELSE list_transform(list_filter(range(1, 20), lambda k: k*20 < len - 0.000001 AND (len - k*20 >= 20.0/3 OR (k+1)*20 < len - 0.000001)), lambda k: k*20/len) END AS c0 FROM dome),
cut_ AS (SELECT * EXCLUDE (c0), CASE WHEN len(c0) = 0 THEN [0.5] ELSE c0 END AS c FROM cuts)"""


@query(
    "G13_segment_arcs",
    f", {DOME}, v AS (SELECT num, unnest(list_concat([0.0], c)) AS t, unnest(list_concat(c, [1.0])) AS e, x0, y0, r FROM cut_) "
    "SELECT num, round(x0 + r + r*cos(pi()*(1+t)), 6) AS x, round(y0 + r*sin(pi()*(1+t)) + 0.0, 6) AS y, round(tan(pi()*(e-t)/4), 6) AS bulge, t > 0 AS inserted FROM v "
    "UNION ALL SELECT num, x0 + 2*r, y0, 0.0, false FROM dome UNION ALL SELECT num, x0 + (num%6)/2.0, y0, 0.0, false FROM dome",
)
def _(spark, d):
    p = ol.segment_arcs(domes(spark, d)).select("num", F.explode("verts").alias("p"))
    return p.select("num", *(F.round(f"p.{c}", 6).alias(c) for c in ("x", "y", "bulge")), "p.inserted")


@query(
    "G15_segmentation_check",
    f", {DOME} SELECT num, num%5<>0 AS same_length, 3 AS n_source, CAST(3 AS BIGINT) AS n_kept, CAST(CASE WHEN num%5=0 THEN len(c) ELSE 0 END AS BIGINT) AS n_off, CAST(CASE WHEN num%10=1 AND len(c) > 1 THEN 1 ELSE 0 END AS BIGINT) AS n_backwards, CASE WHEN num%6=3 THEN CAST(1.5 AS DOUBLE) END AS gap FROM cut_",
)
def _(spark, d):
    """Every fifth result has its added vertices moved; of others, every tenth has the first two of several exchanged."""
    made = ol.segment_arcs(domes(spark, d))
    moved = F.transform("verts", lambda p: F.when(p["inserted"], p.withField("y", p["y"] + 0.5)).otherwise(p))
    at = lambda i: F.get("verts", F.lit(i))
    place = lambda i, j: at(i).withField("x", at(j)["x"]).withField("y", at(j)["y"])
    swapped = F.concat(F.array(at(0), place(1, 2), place(2, 1)), F.slice("verts", F.lit(4), F.size("verts")))
    several = F.size("verts") > 4
    made = made.withColumn("verts", F.when(F.col("num") % 5 == 0, moved).when((F.col("num") % 10 == 1) & several, swapped).otherwise(F.col("verts")))
    told = ol.segmentation_check(domes(spark, d), made, ["num"])
    # Exchanged vertices may or may not change the sum of lengths; the flag is shown for the others.
    return told.withColumn("same_length", F.when(F.col("num") % 10 == 1, F.lit(True)).otherwise(F.col("same_length")))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A closed box for each parcel, 30 to 229 m wide, its first corner drawn a second time 2 cm on."""
    w = 30 + F.col("num") % 200
    c = lambda dx, dy: _at(F.col("x0") + dx, F.col("y0") + dy)
    return la.parcels(spark, d).select("num", F.lit(True).alias("closed"), F.array(c(F.lit(0), F.lit(0)), c(F.lit(0.02), F.lit(0)), c(w, F.lit(0)), c(w, F.lit(8)), c(F.lit(0), F.lit(8))).alias("verts"))


@query(
    "G14_sanitize_shape",
    """, box_ AS (SELECT num, x0, y0, 30+num%200 AS w FROM parcel),
there AS (SELECT num, y0, x0+0.02 AS s, w-0.02 AS len, x0, w FROM box_),
way AS (SELECT num, y0 AS y, s AS a, 1 AS dir, len FROM there UNION ALL SELECT num, y0+8, x0+w, -1, CAST(w AS DOUBLE) FROM there)
SELECT num, round(a + dir*50*j, 6) AS x, y FROM way, range(0, 6) t(j) WHERE j = 0 OR (50*j < len - 0.000001 AND len - 50*j >= 10)
UNION ALL SELECT num, x0 + w, y0 FROM box_ UNION ALL SELECT num, x0, y0+8 FROM box_""",
)
def _(spark, d):
    p = ol.sanitized(boxes(spark, d)).select("num", F.explode("verts").alias("p"))
    return p.select("num", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("J04_legacy_corridor_areas", " SELECT corridor_id, parcel_id, CASE WHEN num%4=0 AND half > 0.001 THEN half ELSE gross_sqm END AS sqm FROM (SELECT g.*, p.num, greatest(0, least(p.x0+10,700)-greatest(p.x0,5))*greatest(0, least(p.y1,b+12)-greatest(p.y0,b)) + CASE WHEN p.x0+10 > 688 AND p.x0 < 700 THEN greatest(0, least(p.x0+10,700)-greatest(p.x0,688))*greatest(0, least(p.y1,200*g.corridor_id+110)-greatest(p.y0,b+12)) ELSE 0 END AS half FROM gross g JOIN parcel p USING (parcel_id) JOIN band USING (corridor_id))")
def _(spark, d):
    """Every fourth parcel has a second, later shape: its left half."""
    bent = lambda ring: F.transform(ring, lambda p: p.withField("bulge", F.lit(0.0)))
    p = la.parcels(spark, d)
    whole = p.select("parcel_id", F.lit(1).alias("pick"), F.lit(True).alias("closed"), bent(la.ring()).alias("verts"))
    half = p.where("num % 4 = 0").withColumn("x1", F.col("x0") + 10).select("parcel_id", F.lit(2).alias("pick"), F.lit(True).alias("closed"), bent(la.ring()).alias("verts"))
    corridors = la.corridors(spark, d).select("corridor_id", F.lit(True).alias("closed"), bent(F.col("ring")).alias("verts"))
    return ol.legacy_corridor_areas(corridors, whole.unionByName(half), la.CELL).withColumn("sqm", F.round("sqm", 6))


@query(
    "O18_corridor_markers",
    f""", {routes.STRIP}, k_ AS (SELECT unnest(range(1, 35)) AS k)
SELECT corridor_id, 'left' AS side, 5000 + k AS number, CAST(5 + 20*k AS DOUBLE) AS x, CAST(y0 + 23 AS DOUBLE) AS y, round(pi()/2, 6) AS text_angle FROM strip, k_
UNION ALL SELECT corridor_id, 'right', k, CAST(20*k - 7 AS DOUBLE), CAST(y0 + 35 AS DOUBLE), round(pi()/2, 6) FROM strip, k_""",
)
def _(spark, d):
    m = ol.corridor_markers(routes.outlines(spark, d), ["corridor_id"])
    return m.select("corridor_id", "side", "number", *(F.round(c, 6).alias(c) for c in ("x", "y", "text_angle")))


def _under(x: str, y: str, r: str) -> str:
    """Area between 0 and x that lies below both y and the half circle of radius r about 0, in SQL; odd in x."""
    x, y = f"greatest(-{r}, least({r}, {x}))", f"greatest(0, least({r}, {y}))"
    s = lambda z: f"(({z})*sqrt(greatest(0, {r}*{r} - ({z})*({z}))) + {r}*{r}*asin(least(1, ({z})/{r})))/2"
    c = f"sqrt({r}*{r} - {y}*{y})"
    return f"sign({x})*({y}*least(abs({x}), {c}) + {s(f'greatest(abs({x}), {c})')} - {s(c)})"


@query(
    "J01_curved_corridors",
    ", bow AS (SELECT corridor_id, b, 60.0 + 10*(corridor_id%3) AS r FROM band), "
    "cell_ AS (SELECT corridor_id, parcel_id, r, x0-350 AS xa, x1-350 AS xb, y0-b AS ya, y1-b AS yb FROM bow JOIN parcel ON gy//10 = corridor_id) "
    f"SELECT * FROM (SELECT corridor_id, parcel_id, round({_under('xb', 'yb', 'r')} - {_under('xa', 'yb', 'r')} - {_under('xb', 'ya', 'r')} + {_under('xa', 'ya', 'r')}, 5) AS gross_sqm FROM cell_) WHERE gross_sqm > 0.001",
)
def _(spark, d):
    """Corridors that are half discs, written as two vertices, over the parcels."""
    r = 60 + 10 * (F.col("corridor_id") % 3)
    bows = la.bands(spark, d).select("corridor_id", F.array(_at(350 - r, F.col("b")), _at(350 + r, F.col("b"), 1.0)).alias("ring"))
    met = overlay.overlap_areas(bows, la.parcels(spark, d).select("parcel_id", la.ring().alias("ring")), ["corridor_id"], ["parcel_id"], cell=la.CELL)
    return met.select("corridor_id", "parcel_id", F.round("sqm", 5).alias("gross_sqm")).where("gross_sqm > 0.001")


@query(
    "J01_curved_shapes",
    """, disc AS (SELECT corridor_id, parcel_id, 40.0 + corridor_id%7 AS r, 6.0 + num%4 AS s, sqrt((x0 - 342)*(x0 - 342) + (y0 - 200*corridor_id - 90)*(y0 - 200*corridor_id - 90)) AS d FROM band JOIN parcel ON gy//10 = corridor_id),
lens AS (SELECT corridor_id, parcel_id, CASE WHEN d >= r + s THEN 0 WHEN d <= r - s THEN pi()*s*s ELSE r*r*acos((d*d+r*r-s*s)/(2*d*r)) + s*s*acos((d*d+s*s-r*r)/(2*d*s)) - sqrt((r+s-d)*(d+r-s)*(d-r+s)*(d+r+s))/2 END AS sqm FROM disc)
SELECT corridor_id, parcel_id, round(sqm, 5) AS sqm FROM lens WHERE sqm > 0.001""",
)
def _(spark, d):
    """Discs over discs: a round place for each corridor, and a disc in each parcel."""
    ring = lambda x, y, r: F.array(_at(x - r, y, 1.0), _at(x + r, y, 1.0)).alias("ring")
    places = la.bands(spark, d).select("corridor_id", ring(F.lit(352), 200 * F.col("corridor_id") + 100, 40 + F.col("corridor_id") % 7))
    discs = la.parcels(spark, d).select("parcel_id", ring(F.col("x0") + 10, F.col("y0") + 10, 6 + F.col("num") % 4))
    return overlay.overlap_areas(places, discs, ["corridor_id"], ["parcel_id"], cell=la.CELL).select("corridor_id", "parcel_id", F.round("sqm", 5).alias("sqm")).where("sqm > 0.001")
