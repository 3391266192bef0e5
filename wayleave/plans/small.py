"""Registered queries for the small functions by themselves: units, identifiers, rings, angles, groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayleave.functions import geometry, keys, units
from wayleave.operators import balances, lines, overlay, registers
from wayleave.plans import lattice as la
from wayleave.plans.registry import SECTION, areas, cad_lines, pieces, query
from wayleave.sources import cad
from wayleave.sources.saved import saved


@query("F02_to_km", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(24,6))*0.001, 3) AS DOUBLE) AS km FROM lineitem", lattice=False)
def _(spark, d):
    return la.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", units.to_km(F.col("l_extendedprice")).alias("km"))


@query("F04_full_parcel_id", "SELECT num, parcel_id FROM parcel")
def _(spark, d):
    """From identifiers with and without the settlement's code."""
    p = la.parcels(spark, d)
    ident = F.when(F.col("num") % 2 == 0, keys.parcel_label(F.col("parcel_id"))).otherwise(F.col("parcel_id"))
    return p.select("num", keys.full_parcel_id(F.col("ekatte"), ident).alias("parcel_id"))


@query("F05_parcel_label", "SELECT num, CASE WHEN num%3=0 THEN CAST(num AS VARCHAR) ELSE regexp_replace(parcel_id, '^[^.]*[.]', '') END AS label FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("num", keys.parcel_label(F.when(F.col("num") % 3 == 0, F.col("num").cast("string")).otherwise(F.col("parcel_id"))).alias("label"))


@query("F06_unescape_quotes", "SELECT c_custkey, 'ЕТ \"' || c_name || '\" \"x' AS name FROM customer", lattice=False)
def _(spark, d):
    return la.t(spark, d, "customer").select("c_custkey", keys.unescaped_quotes(F.concat(F.lit('ЕТ \\"'), F.col("c_name"), F.lit('\\" \\x'))).alias("name"))


@query("F11_format_subdivisions", "SELECT parcel_id, CASE num%4 WHEN 0 THEN '45/а, 46' WHEN 1 THEN '45/а' WHEN 2 THEN '46' END AS subdivisions FROM parcel WHERE in_register AND num%4 < 3")
def _(spark, d):
    """Department and subdivision, one of them, or neither; a parcel with neither has none."""
    rows = cad_lines(spark, d)
    at, part = F.col("line_no") % SECTION, F.floor(F.col("line_no") / SECTION)
    ident = F.regexp_extract("text", "^D ([^,]+),", 1)
    own = rows.where((part == 3) & F.startswith("text", F.lit("D ")))
    line = lambda when, n, rest: own.where(when).select("path", "modified", (F.lit(9 * SECTION + 10 + n).cast("long") + 10 * at).alias("line_no"), F.concat(F.lit("D "), ident, F.lit(rest)).alias("text"))
    head = [rows.select("path", "modified").distinct().select("path", "modified", F.lit(9 * SECTION + i).cast("long").alias("line_no"), F.lit(t).alias("text")) for i, t in enumerate(["TABLE GORIMOTI", "F IDENT C 20", "F OTDEL C 5", "F PODOTDEL C 5"])]
    more = [*head, line((at % 4 < 2), 1, ",45,а,"), line((at % 4 == 0) | (at % 4 == 2), 2, ",46,,"), line(at % 4 == 3, 1, ", ,,")]
    for m in more:
        rows = rows.unionByName(m)
    parts = saved(cad.sections(rows), "parts")
    return cad.subdivisions(cad.good_rows(cad.table_rows(parts)), parts).select("parcel_id", "subdivisions")


@query("F15_percent", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber <> 3 THEN CAST(round(CAST(l_quantity AS DECIMAL(20,3))*100/CAST(l_extendedprice AS DECIMAL(20,3)), 2) AS DOUBLE) END AS percent FROM lineitem", lattice=False)
def _(spark, d):
    whole = F.when(F.col("l_linenumber") == 3, F.lit(0)).otherwise(F.col("l_extendedprice"))
    return la.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", units.percent(F.col("l_quantity"), whole).alias("percent"))


def _listed(ring):
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ",")


@query("F17_clockwise", "SELECT pole_no, concat_ws(',', a || ' ' || b, a || ' ' || d, c || ' ' || d, c || ' ' || b) AS ring FROM (SELECT pole_no, CAST(x0 AS BIGINT) AS a, CAST(y0 AS BIGINT) AS b, CAST(x1 AS BIGINT) AS c, CAST(y1 AS BIGINT) AS d FROM footprint)")
def _(spark, d):
    """Every second ring is drawn against the clock; the first corner stays."""
    ring = la.ring()
    drawn = F.when(F.col("pole_no").cast("long") % 2 == 0, ring).otherwise(F.concat(F.slice(ring, 1, 1), F.reverse(F.slice(ring, 2, 3))))
    return la.footprints(spark, d).select("pole_no", _listed(geometry.clockwise(drawn)).alias("ring"))


@query("F20_sample_arc", ", a AS (SELECT num, x0, y0, 5.0+num%40 AS r, 1+num%16 AS n FROM parcel) SELECT num, k, round(x0 + r - r*cos(pi()*k/n), 6) AS x, round(y0 - r*sin(pi()*k/n) + 0.0, 6) AS y FROM a, range(0, 16) t(k) WHERE k < n")
def _(spark, d):
    """Half circles in one to sixteen steps."""
    r, n = 5.0 + F.col("num") % 40, (1 + F.col("num") % 16).cast("int")
    points = geometry.arc_points(F.col("x0"), F.col("y0"), F.col("x0") + 2 * r, F.col("y0"), F.lit(1.0), n)
    rows = la.parcels(spark, d).select("num", F.posexplode(points).alias("k", "p"))
    return rows.select("num", F.col("k").cast("long").alias("k"), F.round("p.x", 6).alias("x"), F.round(F.col("p.y") + 0.0, 6).alias("y"))


@query("F20_arc_parts", "SELECT num, CAST(least(greatest(ceil(pi()/(2*acos(1 - 0.001/(5.0+num%40)))), 1), 4096) AS BIGINT) AS parts FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("num", geometry.arc_parts(2 * (5.0 + F.col("num") % 40), F.lit(1.0)).cast("long").alias("parts"))


@query("F24_bisector", "SELECT num, round(atan2(sin(a)+sin(b), cos(a)+cos(b)), 6) AS angle FROM (SELECT num, (num%100)/16.0 AS a, (num%37)/6.0 AS b FROM parcel)")
def _(spark, d):
    return la.parcels(spark, d).select("num", F.round(geometry.bisector((F.col("num") % 100) / 16, (F.col("num") % 37) / 6), 6).alias("angle"))


@query("F26_polygon_contains", "SELECT num, (x0+px < x0+12 AND y0+py < y0+4) OR (x0+px < x0+4 AND y0+py < y0+12) AS inside FROM (SELECT *, num%13 + 0.5 AS px, num%7 + 0.5 AS py FROM parcel)")
def _(spark, d):
    """A point against an L in each parcel."""
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    ell = F.array(at(0, 0), at(12, 0), at(12, 4), at(4, 4), at(4, 12), at(0, 12))
    inside = lines.crossings(ell, F.col("x0") + F.col("num") % 13 + 0.5, F.col("y0") + F.col("num") % 7 + 0.5) % 2 == 1
    return la.parcels(spark, d).select("num", inside.alias("inside"))


@query("A17_shape_box", "SELECT num, x0, y0, x1, y1 FROM parcel")
def _(spark, d):
    turned = F.concat(F.slice(la.ring(), 3, 2), F.slice(la.ring(), 1, 2))
    return la.parcels(spark, d).select("num", geometry.box(turned).alias("b")).select("num", "b.*")


@query("P06_drop_slivers", ", m AS (SELECT corridor_id, pole_no, x0, y0, x1, y1, x1 - 0.0003*(CAST(pole_no AS BIGINT)%4) AS xa FROM footprint) SELECT pole_no, round((x1-xa)*(y1-y0), 6) AS sqm FROM m WHERE (x1-xa)*(y1-y0) > 0.001")
def _(spark, d):
    """Footprints against strips along their sides, 0 to 0.9 mm wide and 4 to 8 m long."""
    f = la.footprints(spark, d)
    strip = f.select(F.col("pole_no").alias("strip"), (F.col("x1") - 0.0003 * (F.col("pole_no").cast("long") % 4)).alias("x0"), "y0", (F.col("x1") + 1).alias("x1"), "y1").select("strip", la.ring().alias("ring"))
    met = overlay.overlap_areas(f.select("pole_no", la.ring().alias("ring")), strip, ["pole_no"], ["strip"], cell=la.CELL, where=F.col("pole_no") == F.col("strip"))
    return met.select("pole_no", F.round("sqm", 6).alias("sqm"))


@query("P08_is_ownership", "SELECT parcel_id, right_ord, kind = '1' AS owns FROM rights")
def _(spark, d):
    """Kinds with blanks and leading zeros."""
    said = F.concat(F.lit(" "), F.repeat(F.lit("0"), (F.col("right_ord") % 3).cast("int")), F.col("kind"), F.lit(" "))
    return la.rights(spark, d).select("parcel_id", "right_ord", F.coalesce(keys.is_ownership(said), F.lit(False)).alias("owns"))


@query("P13_control_difference", "SELECT num, CASE WHEN num%5 <> 0 THEN CAST(round(CAST((x1-x0)*(y1-y0) AS DECIMAL(24,6)) - CAST(area_sqm AS DECIMAL(24,6)), 2) AS DOUBLE) END AS difference_sqm FROM parcel")
def _(spark, d):
    """Null where the register has no area."""
    p = la.parcels(spark, d)
    drawn = p.select("parcel_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("drawn_sqm"))
    official = p.withColumn("area_sqm", F.when(F.col("num") % 5 != 0, F.col("area_sqm")))
    report = registers.control_report(drawn, official, la.rights(spark, d), la.persons(spark, d))
    return report.join(p.select("parcel_id", "num"), "parcel_id").select("num", "difference_sqm").distinct()


@query("O02_row_flags", "SELECT corridor_id, parcel_id, pole_no, row_number() OVER w = 1 AS first, CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY corridor_id, parcel_id) ELSE 0 END AS parcel_rows FROM piece WINDOW w AS (PARTITION BY corridor_id, parcel_id ORDER BY CAST(pole_no AS BIGINT))")
def _(spark, d):
    t = registers.steps_table(pieces(spark, d), areas(spark, d).select("corridor_id", "parcel_id", "drawn_sqm"))
    return t.select("corridor_id", "parcel_id", "pole_no", (F.col("turn") == 1).alias("first"), "parcel_rows")


@query(
    "T04_balance_order",
    """, code_ AS (SELECT num, ekatte, in_register AS found, CASE num%4 WHEN 0 THEN ' ' || CAST(num%29 AS VARCHAR) WHEN 1 THEN vids WHEN 2 THEN ' ' ELSE lower(vids) END AS code FROM parcel),
g AS (SELECT *, trim(code) AS k, regexp_full_match(trim(code), '[0-9]+') AS digits FROM code_)
SELECT num, row_number() OVER (PARTITION BY ekatte ORDER BY CASE WHEN NOT found THEN 3 WHEN k = '' THEN 2 WHEN digits THEN 0 ELSE 1 END, CASE WHEN found AND digits THEN CAST(k AS BIGINT) ELSE 0 END, CASE WHEN found THEN k ELSE '' END, num) AS place FROM g""",
)
def _(spark, d):
    """Numbers before texts before no code before what the register does not know, in each settlement."""
    k = F.col("num") % 4
    code = F.when(k == 0, F.concat(F.lit(" "), (F.col("num") % 29).cast("string"))).when(k == 1, F.col("vids")).when(k == 2, F.lit(" ")).otherwise(F.lower("vids"))
    rows = la.parcels(spark, d).select("num", "ekatte", balances.balance_group(code, F.col("in_register")).alias("g"))
    return rows.select("num", F.row_number().over(Window.partitionBy("ekatte").orderBy("g.class", "g.number", "g.key", "num")).alias("place"))


@query("U01_union_parcels", "SELECT corridor_id, parcel_id FROM areas")
def _(spark, d):
    """The parcels that a corridor touches and those that its structures stand on."""
    return areas(spark, d).select("corridor_id", "parcel_id")
