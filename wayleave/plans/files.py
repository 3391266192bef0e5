"""Registered queries on files, drawn inputs, sinks and checks that have something to find."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayleave.functions import geometry, keys
from wayleave.operators import balances, overlay, printing, registers, report
from wayleave.plans import lattice as la
from wayleave.plans.registry import AXIS, BALANCE, CONTROL, DKA, MATH, MUNICIPAL, QUERIES, RECAP, REGISTER, ROMAN, STEP_ROWS, STEPS, areas, balance, body, cad_lines, pieces, query, registered, route
from wayleave.sources import cad
from wayleave.sources import shapes as drawn
from wayleave.sources.saved import saved, shared_dir, write_files

# --- bytes ---------------------------------------------------------------------------------------------------------------


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: a table of a few MB is read in one task, which much work on each row would keep to itself."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "num")


def encoded(text: Column) -> Column:
    """Text in the files' code page."""
    return F.encode(F.translate(text, cad.LETTERS[:64] + "№", cad.HIGH[:64] + "\xd5"), "ISO-8859-1")


def small_files(spark: SparkSession, d: str) -> DataFrame:
    """(name, content): one file of parcels and subdivisions for each settlement of a band, one without a code, one without parcels, and the template library."""
    p = registered(spark, d).select("ekatte", F.floor(F.col("num") / 400).alias("band"), "num", keys.parcel_label(F.col("parcel_id")).alias("ident"))
    fields = lambda *names: [f"F {n} C 20" for n in names]
    ordered = F.array_sort(F.collect_list(F.struct("num", "ident")))
    g = p.groupBy("ekatte", "band").agg(ordered.alias("rows"))
    line = lambda f: F.transform("rows", f)
    some = F.filter("rows", lambda r: r["num"] % 2 == 0)
    parts = [
        F.array(*map(F.lit, ["HEADER", "VERSION 4.02"])), F.array(F.concat(F.lit("EKATTE "), F.col("ekatte"))), F.array(*map(F.lit, ["NAME с. Пример № 1", "END_HEADER", "TABLE POZEMLIMOTI", *fields("IDENT", "VIDT")])),
        line(lambda r: F.concat(F.lit("D "), r["ident"], F.lit(',"Земя "А"",'))), F.array(*map(F.lit, ["END_TABLE", "TABLE GORIMOTI", *fields("IDENT", "OTDEL", "PODOTDEL"), "D 0.0,1,я,"])),
        F.transform(some, lambda r: F.concat(F.lit("D "), r["ident"], F.lit(",45,а,"))), F.transform(some, lambda r: F.concat(F.lit("D "), r["ident"], F.lit(",46,,"))), F.array(F.lit("END_TABLE")),
    ]
    files = g.select(F.concat_ws("-", F.col("band").cast("string"), "ekatte").alias("stem"), encoded(F.array_join(F.concat(*parts), "\r\n")).alias("content"))
    one = lambda name, text: spark.range(1).select(F.lit(name).alias("name"), encoded(F.lit(text)).alias("content"))
    rest = one("no-code.cad", "HEADER\nVERSION 4.02\nEND_HEADER\n").unionByName(one("no-parcels.cad", "HEADER\nEKATTE 00001\nEND_HEADER\n")).unionByName(one("Template.CAD", "HEADER\nEKATTE 00001\nEND_HEADER\n"))
    return files.select(F.concat("stem", F.lit(".CAD")).alias("name"), "content").unionByName(rest)


def read_back(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/cad-{uuid.uuid4().hex}"
    write_files(small_files(spark, d), folder)
    return cad.scan_cad_dir(spark, folder)


def file_name() -> Column:
    return F.substring_index("path", "/", -1).alias("file")


FILES = "file AS (SELECT num//400 AS band, ekatte, num//400 || '-' || ekatte || '.CAD' AS file, count(*) AS n FROM parcel WHERE in_register GROUP BY ALL)"


@query("S01_scan_cad_dir", f", {FILES} SELECT file FROM file UNION ALL SELECT 'no-code.cad' UNION ALL SELECT 'no-parcels.cad'")
def _(spark, d):
    return read_back(spark, d).select(file_name())


@query("S02_decode_mik", "SELECT num, 'Имот № ' || num || ' ряЯ' || chr(65533) AS text, 1 AS bad FROM parcel")
def _(spark, d):
    content = F.concat(encoded(F.concat(F.lit("Имот № "), F.col("num").cast("string"), F.lit(" ряЯ"))), F.unhex(F.lit("C1")))
    text = cad.decode_mik(content)
    return la.parcels(spark, d).select("num", text.alias("text"), cad.undecodable(text).alias("bad"))


SECTIONS = """counted AS (SELECT f.band, f.ekatte, f.n, coalesce(r.rights, 0) AS rights, coalesce(r.persons, 0) AS persons FROM (SELECT num//400 AS band, ekatte, count(*) AS n FROM parcel WHERE in_register GROUP BY ALL) f
  LEFT JOIN (SELECT p.num//400 AS band, p.ekatte, count(*) AS rights, count(DISTINCT person_id) AS persons FROM rights JOIN parcel p USING (parcel_id) WHERE p.in_register GROUP BY ALL) r USING (band, ekatte))"""


@query("S03_cad_sections", f", {SECTIONS} SELECT band, ekatte, s.section, s.name, s.n AS lines FROM counted c, LATERAL (VALUES ('HEADER', '', 3), ('CONTROL', 'CADASTER', c.n), ('CONTROL', 'OTHER', 1), ('TABLE', 'POZEMLIMOTI', 6 + c.n), ('TABLE', 'MESTNOSTI', 4), ('TABLE', 'PERSONS', 3 + c.persons), ('TABLE', 'PRAVA', 6 + c.rights)) s(section, name, n)")
def _(spark, d):
    parts = cad.sections(cad_lines(spark, d)).where("section <> ''")
    word = lambda i: F.get(F.split("path", "[/.]"), F.lit(i))
    return parts.groupBy(word(1).cast("long").alias("band"), word(2).alias("ekatte"), "section", "name").agg(F.count(F.lit(1)).alias("lines"))


@query("S04_cad_rows_by_field_name", "SELECT regexp_replace(parcel_id, '^[^.]*[.]', '') AS ident, kat, vids, '1' AS mestnost FROM parcel WHERE in_register")
def _(spark, d):
    good = cad.good_rows(cad.table_rows(cad.sections(cad_lines(spark, d)))).where(F.col("table") == "POZEMLIMOTI")
    at = lambda f: F.element_at("row", F.lit(f))
    return good.select(at("IDENT").alias("ident"), at("KAT").alias("kat"), at("VIDS").alias("vids"), at("MESTNOST").alias("mestnost"))


@query("S05_split_cad_csv", "SELECT num, 4 AS n, CAST(num AS VARCHAR) AS first, 14 + 1000*(1 + num%100) AS quoted, '' AS third, 'б' AS last FROM parcel")
def _(spark, d):
    # Long quoted values with quotes, commas and escapes inside.
    long = F.concat(F.lit('"ЕТ "А" b \\"c\\"'), F.repeat(F.lit("x, y\\\"z\"w "), (100 * (1 + F.col("num") % 100)).cast("int")), F.lit('"'))
    values = cad.split_values(F.concat_ws(",", F.col("num").cast("string"), long, F.lit(" "), F.lit(" б ")))
    rows = spread(la.parcels(spark, d)).select("num", values.alias("v"))
    return rows.select("num", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"), F.length(F.get("v", F.lit(1))).alias("quoted"), F.get("v", F.lit(2)).alias("third"), F.get("v", F.lit(3)).alias("last"))


@query("S11_cad_subdivisions", "SELECT parcel_id, '45/а, 46' AS subdivisions FROM parcel WHERE in_register AND num%2=0")
def _(spark, d):
    parts = cad.sections(cad.lines(read_back(spark, d)))
    return cad.subdivisions(cad.good_rows(cad.table_rows(parts)), parts).select("parcel_id", "subdivisions")


@query("S14_load_register_set", f", {FILES} SELECT file, n AS parcels, CAST(NULL AS VARCHAR) AS reason FROM file UNION ALL SELECT 'no-code.cad', NULL, 'no settlement code' UNION ALL SELECT 'no-parcels.cad', NULL, 'no parcels'")
def _(spark, d):
    reg = cad.load_registers(saved(cad.lines(read_back(spark, d)), "lines"))
    kept = reg["parcels"].groupBy(file_name()).agg(F.count(F.lit(1)).alias("parcels"))
    return kept.unionByName(reg["skipped"].select(file_name(), "reason"), allowMissingColumns=True)


HELD = "SELECT DISTINCT p.ekatte, r.person_id FROM rights r JOIN parcel p USING (parcel_id) WHERE p.in_register"


def people(spark: SparkSession, d: str) -> DataFrame:
    good = cad.good_rows(cad.table_rows(cad.sections(cad_lines(spark, d))))
    return cad.union_persons(cad.persons(good).select(F.get(F.split("path", "[/.]"), F.lit(2)).alias("ekatte"), "person_id"))


@query("U02_union_persons", HELD)
def _(spark, d):
    return people(spark, d)


@query("A15_person_count", f"SELECT ekatte, count(*) AS persons FROM ({HELD}) GROUP BY ekatte")
def _(spark, d):
    return people(spark, d).groupBy("ekatte").agg(F.count(F.lit(1)).alias("persons"))


# --- drawn inputs -----------------------------------------------------------------------------------------------------------


@query("S21_scan_shapes", "SELECT CASE WHEN num%4=0 THEN 'h' || num ELSE parcel_id END AS parcel_id, num%4=0 AS from_handle, 4 AS vertices FROM parcel WHERE num%5 <> 0 AND num%3 <> 2")
def _(spark, d):
    # Every fifth shape lies on a layer of the tool, every third is left open.
    verts = F.transform(la.ring(), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("bulge")))
    xdata, layer = F.when(F.col("num") % 4 == 0, F.lit(" ")).otherwise(F.col("parcel_id")), F.when(F.col("num") % 5 == 0, F.lit("servitude_POINTS")).otherwise(F.lit("имоти"))
    rows = la.parcels(spark, d).select(F.concat(F.lit("h"), F.col("num").cast("string")).alias("shape_id"), xdata.alias("xdata_id"), layer.alias("layer"), (F.col("num") % 3 != 2).alias("closed"), verts.alias("verts"))
    return drawn.scan_shapes(rows).select("parcel_id", "from_handle", F.size("verts").alias("vertices"))


@query("S23_scan_axis", "SELECT corridor_id, 0 AS ord, 2 AS vertices FROM band")
def _(spark, d):
    at = lambda x: F.struct(F.lit(float(x)).alias("x"), F.col("b").alias("y"), F.lit(0.0).alias("bulge"))
    rows = la.bands(spark, d).select("corridor_id", F.explode(F.array(F.lit("axis"), F.lit("parcel"))).alias("kind"), F.lit(0).alias("ord"), F.array(at(5), at(694)).alias("verts"))
    return drawn.scan_axis(rows).select("corridor_id", "ord", F.size("verts").alias("vertices"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Structures as drawn blocks: corners by state for every third, plain for the others; every fifth lacks one; every seventh is a marker."""
    f = la.footprints(spark, d).withColumn("k", F.col("pole_no").cast("long"))
    digits = lambda x: F.when(F.col("k") % 4 == 0, x.cast("decimal(18,2)").cast("string")).otherwise(x.cast("decimal(18,3)").cast("string"))
    text = lambda x, y: F.concat(digits(x), F.lit(", "), y.cast("decimal(18,3)").cast("string"))
    corners = [text(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    tag = lambda i: F.when(F.col("k") % 3 == 0, F.lit(f"P{i}-STATE B")).otherwise(F.lit(f"P{i}"))
    pairs = [F.struct(tag(i + 1).alias("key"), c.alias("value")) for i, c in enumerate(corners)]
    kept = F.when(F.col("k") % 5 == 0, F.array(*pairs[:3])).otherwise(F.array(*pairs))
    number = F.array(F.struct(F.lit("NUMBER").alias("key"), F.when(F.col("k") % 2 == 0, F.lit(" ")).otherwise(F.col("pole_no")).alias("value")), F.struct(F.lit("TP1").alias("key"), F.lit("0, 0").alias("value")))
    return f.select(F.concat(F.lit("h"), "pole_no").alias("structure_id"), F.when(F.col("k") % 7 == 0, F.lit("gbp032")).otherwise(F.lit("СТЪЛБ")).alias("block_name"), F.lit("State b").alias("visibility"), F.map_from_entries(F.concat(number, kept)).alias("attrs"), F.lit("").alias("xdata_id"), "k")


POLE = "CASE WHEN CAST(pole_no AS BIGINT)%2=0 THEN 'h' || pole_no ELSE pole_no END"
BLOCKS = f"block_ AS (SELECT {POLE} AS pole_no, CAST(pole_no AS BIGINT) AS k, x0, y0, x1, y1 FROM footprint WHERE CAST(pole_no AS BIGINT)%7 <> 0)"


@query("S22_scan_structures", f", {BLOCKS} SELECT pole_no, CASE WHEN k%5=0 THEN NULL ELSE x0 END AS x, CASE WHEN k%5=0 THEN NULL ELSE y1 END AS y, CASE WHEN k%5=0 THEN 'fewer than four corners' END AS error FROM block_")
def _(spark, d):
    s = drawn.scan_structures(blocks(spark, d))
    last = F.element_at("corners", 4)
    return s.select("pole_no", last["x"].alias("x"), last["y"].alias("y"), "error")


@query("P04_resolve_structure_id", f", {BLOCKS} SELECT pole_no FROM block_")
def _(spark, d):
    return drawn.scan_structures(blocks(spark, d)).select("pole_no")


@query("F21_footprint_corners", f", {BLOCKS} SELECT pole_no, u.i AS corner, CASE WHEN u.i IN (1,4) THEN x0 ELSE x1 END AS x, CASE WHEN u.i IN (1,2) THEN y0 ELSE y1 END AS y FROM block_, (SELECT unnest([1,2,3,4]) AS i) u WHERE k%5 <> 0")
def _(spark, d):
    s = drawn.scan_structures(blocks(spark, d)).where("corners is not null")
    return s.select("pole_no", F.posexplode("corners").alias("i", "p")).select("pole_no", (F.col("i") + 1).alias("corner"), "p.x", "p.y")


@query("V06_rounded_by_units", f", {BLOCKS} SELECT pole_no FROM block_ WHERE k%4=0 AND k%5 <> 0")
def _(spark, d):
    return drawn.rounded_by_units(drawn.scan_structures(blocks(spark, d)))


@query("G16_footprint_diagonals", f", {BLOCKS} SELECT pole_no, count(*) AS lines, round(sum(l), 6) AS metres FROM (SELECT pole_no, unnest([x1-x0, y1-y0, x1-x0, y1-y0, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))]) AS l FROM block_ WHERE k%5 <> 0) GROUP BY ALL")
def _(spark, d):
    lines_ = drawn.footprint_diagonals(drawn.scan_structures(blocks(spark, d)))
    return lines_.groupBy("pole_no").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6).alias("metres"))


@query("F18_start_forward_left", "SELECT parcel_id, x1 AS east_x, y1 AS east_y, x0 AS north_x, y1 AS north_y FROM parcel")
def _(spark, d):
    corners = spread(la.parcels(spark, d)).select("parcel_id", geometry.clockwise(la.ring()).alias("ring"))
    east, north = (F.element_at(drawn.forward_left(F.col("ring"), F.lit(theta)), 1).alias(n) for n, theta in (("east", 0.1), ("north", 1.7)))
    return corners.select("parcel_id", east, north).select("parcel_id", *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("east", "north") for c in ("x", "y")))


# --- sinks ------------------------------------------------------------------------------------------------------------------


@query("K01_write_report", "SELECT a.corridor_id, s.municipality, count(*) AS n, CAST(sum(drawn_sqm) AS DOUBLE) AS sqm FROM areas a JOIN settlement s USING (ekatte) GROUP BY ALL")
def _(spark, d):
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    rows = areas(spark, d).withColumn("ekatte", keys.ekatte_of(F.col("parcel_id"))).join(la.settlements(spark, d).select("ekatte", "municipality"), "ekatte")
    printing.write_report(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("corridor_id", "municipality").agg(F.count(F.lit(1)).alias("n"), F.sum("drawn_sqm").alias("sqm"))


@query("K05_balance_print_rows", f", {BALANCE}, printed_ AS (SELECT corridor_id, ekatte, table_ord, \"group\", class, number, key, parcels, CAST(area_dka AS DOUBLE) AS area_dka, false AS total FROM sums UNION ALL SELECT corridor_id, ekatte, table_ord, 'Общо', NULL, NULL, NULL, sum(parcels), CAST(sum(area_dka) AS DOUBLE), true FROM sums GROUP BY ALL) SELECT corridor_id, ekatte, table_ord, row_number() OVER (PARTITION BY corridor_id, ekatte ORDER BY table_ord, total, class, number, key) AS row_ord, \"group\", CAST(parcels AS BIGINT) AS parcels, area_dka FROM printed_")
def _(spark, d):
    return printing.balance_print_rows(balance(spark, d)).select("corridor_id", "ekatte", "table_ord", "row_ord", "group", "parcels", "area_dka")


@query("K08_coords_print_rows", ", u AS (SELECT f.*, w.parcel_id FROM footprint f JOIN winner w USING (corridor_id, pole_no)) SELECT corridor_id, pole_no, 1 AS row_ord, 'Стълб №' || pole_no || ', попадащ в имот ' || regexp_replace(parcel_id, '^[^.]*[.]', '') AS label, CAST(NULL AS DOUBLE) AS north, CAST(NULL AS DOUBLE) AS east FROM u UNION ALL SELECT corridor_id, pole_no, 2, 'Център', (y0+y1)/2, (x0+x1)/2 FROM u UNION ALL SELECT corridor_id, pole_no, 2+i, pole_no || '-' || i, CASE WHEN i IN (1,4) THEN y0 ELSE y1 END, CASE WHEN i IN (1,2) THEN x0 ELSE x1 END FROM u, (SELECT unnest([1,2,3,4]) AS i) UNION ALL SELECT corridor_id, pole_no, 7, 'Площ на стъпката: ' || CAST(CAST(area_sqm AS DECIMAL(24,1)) AS VARCHAR) || 'кв.м', NULL, NULL FROM u")
def _(spark, d):
    w = registers.winning_parcels(pieces(spark, d)).select("corridor_id", "pole_no", "parcel_id")
    f = la.footprints(spark, d).select("corridor_id", "pole_no", "area_sqm", geometry.clockwise(la.ring()).alias("ring")).join(w, ["corridor_id", "pole_no"])
    c = geometry.centre(F.col("ring"))
    corners = F.transform("ring", lambda p: F.struct(p["y"].alias("north"), p["x"].alias("east")))
    return printing.coordinate_print_rows(f.select("corridor_id", "pole_no", "parcel_id", "area_sqm", c["y"].alias("north"), c["x"].alias("east"), corners.alias("corners")))


TEXT = "CAST(CAST(round(CAST({0} AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3)) AS VARCHAR)"


@query(
    "K10_math_test_print_rows",
    f", {MATH}, m AS (SELECT a.corridor_id, a.parcel_id, drawn_sqm, gross_sqm, gross_sqm - coalesce(sqm, 0) AS net, coalesce(pole, 0) AS pole FROM areas a LEFT JOIN covered USING (corridor_id, parcel_id)), "
    "j AS (SELECT m.*, p.pole_no, p.piece_sqm, row_number() OVER (PARTITION BY corridor_id, parcel_id ORDER BY CAST(p.pole_no AS BIGINT)) AS turn FROM m LEFT JOIN piece p USING (corridor_id, parcel_id)) "
    f"SELECT corridor_id, parcel_id, turn, CASE WHEN turn=1 THEN parcel_id ELSE '' END AS parcel, CASE WHEN turn=1 THEN {TEXT.format('drawn_sqm')} ELSE '' END AS area, CASE WHEN turn=1 THEN {TEXT.format('gross_sqm')} ELSE '' END AS gross, CASE WHEN turn>1 THEN '' WHEN pole > 0.001 THEN {TEXT.format('net')} ELSE '0.000' END AS net, "
    f"{TEXT.format('coalesce(piece_sqm, pole)')} AS pole_area, CASE WHEN turn=1 THEN {TEXT.format('greatest(drawn_sqm - net - pole, 0)')} ELSE '' END AS remainder, CASE WHEN turn=1 THEN {TEXT.format('(gross_sqm - (net + pole))')} || CASE WHEN abs(gross_sqm - (net + pole)) <= 0.001 THEN ' - ОК' ELSE ' - ГРЕШКА' END ELSE '' END AS difference, coalesce(pole_no, '') AS pole FROM j",
)
def _(spark, d):
    return printing.math_test_print_rows(QUERIES["J03_math_test_areas"](spark, d), pieces(spark, d))


@query("K11_legacy_report_sheets", "SELECT f.corridor_id, row_number() OVER (PARTITION BY f.corridor_id ORDER BY CAST(f.pole_no AS BIGINT), p.parcel_id NULLS FIRST) AS no, f.pole_no, p.parcel_id, CAST(coalesce(p.piece_sqm, 0) AS DOUBLE) AS sqm FROM footprint f LEFT JOIN piece p USING (corridor_id, pole_no)")
def _(spark, d):
    return printing.pole_sheet(la.footprints(spark, d), pieces(spark, d))


@query("K12_legacy_coord_lists", "SELECT pole_no, u.i AS point, CASE WHEN u.i = 0 THEN (x0+x1)/2 WHEN u.i IN (1,4) THEN x0 ELSE x1 END AS x, CASE WHEN u.i = 0 THEN (y0+y1)/2 WHEN u.i IN (1,2) THEN y0 ELSE y1 END AS y FROM footprint, (SELECT unnest([0,1,2,3,4]) AS i) u")
def _(spark, d):
    return printing.coordinate_list(la.footprints(spark, d).select("pole_no", la.ring().alias("verts")), ["pole_no"])


@query("K13_issue_log", "SELECT 'not_found' AS issue, parcel_id AS key, count(*) AS n FROM body WHERE NOT found GROUP BY ALL UNION ALL SELECT 'uncovered', pole_no, 1 FROM (SELECT f.pole_no, f.area_sqm - coalesce(sum(p.piece_sqm), 0) AS missing FROM footprint f LEFT JOIN piece p USING (corridor_id, pole_no) GROUP BY f.pole_no, f.area_sqm) WHERE missing > 0.001")
def _(spark, d):
    lost = body(spark, d).where("not found").select(F.col("parcel_id").alias("key"))
    open_ = registers.uncovered(la.footprints(spark, d), pieces(spark, d)).select(F.col("pole_no").alias("key"))
    return printing.issue_log(not_found=lost, uncovered=open_)


@query("F12_settlement_title", "SELECT k AS ekatte, CASE WHEN s.ekatte IS NULL THEN 'НА ТЕРИТОРИЯТА НА НЯКЪДЕ, ЕКАТТЕ ' || k ELSE upper('на територията на ' || kind || ' ' || name || ', екатте ' || k || ', общ. ' || municipality || ', обл. ' || province) END AS title FROM (SELECT DISTINCT ekatte AS k FROM parcel) LEFT JOIN (SELECT * FROM settlement WHERE ekatte <> '00003') s ON s.ekatte = k")
def _(spark, d):
    s = la.settlements(spark, d).where("ekatte <> '00003'")
    rows = la.parcels(spark, d).select("ekatte").distinct().join(s, "ekatte", "left")
    return rows.select("ekatte", printing.settlement_title(*(F.col(c) for c in ("kind", "name", "ekatte", "municipality", "province")), F.lit(" някъде ")).alias("title"))


@query("F13_section_titles", "SELECT DISTINCT municipality, province, 'НА ТЕРИТОРИЯТА НА ОБЩИНА ' || upper(municipality) || ', ОБЛ. ' || province AS title FROM settlement UNION ALL SELECT 'Неизвестна община', '', 'НА ТЕРИТОРИЯТА НА НЕИЗВЕСТНА ОБЩИНА'")
def _(spark, d):
    rows = la.settlements(spark, d).select("municipality", "province").distinct()
    rows = rows.unionByName(rows.limit(1).select(F.lit("Неизвестна община").alias("municipality"), F.lit("").alias("province")))
    return rows.select("municipality", "province", printing.municipality_subtitle(F.col("municipality"), F.col("province")).alias("title"))


# --- checks on tampered tables ------------------------------------------------------------------------------------------------


@query("V01_tampered_balance", "SELECT DISTINCT corridor_id, ekatte FROM body WHERE CAST(ekatte AS INTEGER)%3=1")
def _(spark, d):
    b = body(spark, d)
    wrong = F.when(F.col("ekatte").cast("int") % 3 == 1, F.col("area_dka") + F.lit("0.001").cast("decimal(4,3)")).otherwise(F.col("area_dka"))
    return balances.unequal_totals(balances.territory_balance(b), registers.register_totals(b).withColumn("area_dka", wrong.cast("decimal(28,3)"))).select("corridor_id", "ekatte")


@query("T02_mixed_identifiers", "SELECT ekatte, u.label, u.t1 AS natural_place, u.t2 AS control_place FROM settlement, (SELECT unnest(['10','9','B','a']) AS label, unnest([2,1,4,3]) AS t1, unnest([2,1,3,4]) AS t2) u")
def _(spark, d):
    rows = la.settlements(spark, d).select("ekatte", F.explode(F.array(*map(F.lit, ["10", "9", "B", "a"]))).alias("label"))
    id_ = F.concat_ws(".", "ekatte", "label")
    place = lambda key: F.row_number().over(Window.partitionBy("ekatte").orderBy(key(id_)))
    return rows.select("ekatte", "label", place(keys.parcel_key).alias("natural_place"), place(keys.control_key).alias("control_place"))


# --- one run for all reports, and print rows --------------------------------------------------------------------------------


def run_reports(spark: SparkSession, d: str, which: str = "true") -> dict[str, DataFrame]:
    f = la.footprints(spark, d).where(which).select("corridor_id", "pole_no", "area_sqm", la.ring().alias("ring"))
    drawn = la.parcels(spark, d).select("parcel_id", la.ring().alias("ring"))
    shared = report.shared_tables(la.corridors(spark, d).where(which), f.select("corridor_id", "pole_no", "ring"), drawn, registered(spark, d), la.CELL)
    metres = route(spark, d).where(which).select("corridor_id", "ekatte", "metres")
    return report.reports(shared, f, registered(spark, d), la.rights(spark, d), la.persons(spark, d), la.settlements(spark, d), metres)


@query(
    "K01_report_run",
    f""", {BALANCE}, {REGISTER}, {STEPS}, {STEP_ROWS}, {CONTROL}, {MUNICIPAL}, {AXIS}, {RECAP}
SELECT 'affected_register' AS report, corridor_id, count(*) AS n, CAST(sum(CASE WHEN first THEN area_dka END) AS DOUBLE) AS total FROM register GROUP BY corridor_id
UNION ALL SELECT 'register_totals', corridor_id, count(DISTINCT ekatte), CAST(sum(area_dka) AS DOUBLE) FROM body GROUP BY corridor_id
UNION ALL SELECT 'steps_register', corridor_id, count(*), CAST(sum(CASE WHEN first THEN piece_dka END) AS DOUBLE) FROM steps GROUP BY corridor_id
UNION ALL SELECT 'steps_table', corridor_id, count(*), CAST(sum(step_dka) AS DOUBLE) FROM rows_ GROUP BY corridor_id
UNION ALL SELECT 'coordinates', w.corridor_id, 7*count(*), CAST(5*sum((f.x0+f.x1)/2) AS DOUBLE) FROM winner w JOIN footprint f USING (corridor_id, pole_no) GROUP BY w.corridor_id
UNION ALL SELECT 'balance', corridor_id, count(*) + count(DISTINCT ekatte || table_ord), 2*CAST(sum(area_dka) AS DOUBLE) FROM sums GROUP BY corridor_id
UNION ALL SELECT 'municipality_balance', corridor_id, count(*) + count(DISTINCT province || municipality || table_ord), 2*CAST(sum(area_dka) AS DOUBLE) FROM municipal GROUP BY corridor_id
UNION ALL SELECT 'recapitulation', corridor_id, count(*) + count(DISTINCT province || municipality) + count(DISTINCT province), 3*CAST(sum(area_dka) AS DOUBLE) FROM recap_m GROUP BY corridor_id
UNION ALL SELECT 'control', a.corridor_id, count(*), CAST(sum(c.area_sqm) AS DOUBLE) FROM areas a JOIN control c USING (parcel_id) GROUP BY a.corridor_id
UNION ALL SELECT 'not_found', corridor_id, count(*), 0.0 FROM body WHERE NOT found GROUP BY corridor_id""",
)
def _(spark, d):
    """All reports of all corridors written and read back; then every second corridor again, which must leave everything as it was."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    report.write_reports(run_reports(spark, d), folder)
    there = report.write_reports(run_reports(spark, d, "corridor_id % 2 = 0"), folder)
    measure = {"affected_register": "area_dka", "register_totals": "area_dka", "steps_register": "piece_dka", "steps_table": "step_dka", "coordinates": "east", "balance": "area_dka", "municipality_balance": "area_dka", "recapitulation": "area_dka", "control": "cad_sqm"}
    out = None
    for name, rows in there.items():
        value = F.coalesce(F.sum(measure[name]).cast("double"), F.lit(0.0)) if name in measure else F.lit(0.0)
        one = rows.groupBy(F.lit(name).alias("report"), "corridor_id").agg(F.count(F.lit(1)).alias("n"), F.round(value, 6).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


PLACES = "place AS (SELECT corridor_id, ekatte, (CAST(ekatte AS INTEGER)*7)%25 AS place FROM (SELECT DISTINCT corridor_id, ekatte FROM body) WHERE CAST(ekatte AS INTEGER)%4 <> 0)"


@query(
    "K06_recap_print_rows",
    f""", {BALANCE}, {AXIS}, {RECAP}, {PLACES},
own AS (SELECT r.*, s.kind || ' ' || s.name AS name, p.place, (p.place IS NULL)::INT AS last FROM recap_m r JOIN settlement s USING (ekatte) LEFT JOIN place p USING (corridor_id, ekatte)),
turn AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, province ORDER BY last, place, ekatte) AS t FROM own),
muni AS (SELECT corridor_id, province, municipality, min(t) AS f FROM turn GROUP BY ALL), no_ AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, province ORDER BY f) AS no FROM muni),
all_ AS (SELECT corridor_id, province, 0 AS level, no, t, CASE WHEN t = f THEN no END AS shown, province AS province_name, municipality AS municipality_name, name AS settlement, ekatte, '' AS label, parcels, area_dka, poles, affected_dka, m FROM turn JOIN no_ USING (corridor_id, province, municipality)
  UNION ALL SELECT corridor_id, province, 1, no, 0, NULL, '', '', '', '', 'Общо за общ. ' || municipality || ':', sum(parcels), sum(area_dka), sum(poles), sum(affected_dka), sum(m) FROM turn JOIN no_ USING (corridor_id, province, municipality) GROUP BY corridor_id, province, municipality, no
  UNION ALL SELECT corridor_id, province, 2, 1000, 0, NULL, '', '', '', '', 'Общо за обл. ' || province || ':', sum(parcels), sum(area_dka), sum(poles), sum(affected_dka), sum(m) FROM turn GROUP BY corridor_id, province)
SELECT corridor_id, province, row_number() OVER (PARTITION BY corridor_id, province ORDER BY no, level, t) AS row_ord, CASE level WHEN 0 THEN 'row' WHEN 1 THEN 'municipality' ELSE 'province' END AS row_kind, shown AS no, province_name, municipality_name, settlement, ekatte, label,
  CAST(parcels AS BIGINT) AS parcels, CAST(area_dka AS DOUBLE) AS area_dka, CAST(poles AS BIGINT) AS poles, CAST(affected_dka AS DOUBLE) AS affected_dka, CAST(round(m*0.001, 3) AS DOUBLE) AS route_km FROM all_""",
)
def _(spark, d):
    """Three of four settlements have a place along the route."""
    s = la.settlements(spark, d)
    bal = balance(spark, d)
    code = F.col("ekatte").cast("int")
    places = bal.select("corridor_id", "ekatte").distinct().where(code % 4 != 0).withColumn("place", (code * 7) % 25)
    rows = printing.recap_print_rows(balances.recapitulation(bal, s, route(spark, d)), s, places)
    return rows.drop("restricted_dka", "step_dka")


@query(
    "K07_control_print_rows",
    f""", {CONTROL} SELECT row_number() OVER (PARTITION BY split_part(parcel_id,'.',1) ORDER BY {la.ORDER}, right_ord NULLS FIRST) AS row_ord, parcel_id, p.vidt, p.ntp, '' AS locality, coalesce({ROMAN.replace("CASE kat", "CASE control.kat")}, '') AS category, control.area_sqm AS cad_sqm, drawn_sqm,
  CAST(round(CAST(drawn_sqm AS DECIMAL(24,6)) - CAST(control.area_sqm AS DECIMAL(24,6)), 2) AS DOUBLE) AS difference_sqm, p.vids AS ownership, coalesce(control.kind, '') AS right_kind, '' AS term, CASE WHEN doc1 IS NULL OR doc1 IN ('', '-2') THEN '' WHEN doc2 IN ('', '-2') THEN doc1 ELSE doc1 || '/' || doc2 END AS share, coalesce(person_id, '') AS person_id, coalesce(control.name, '') AS person_name FROM control JOIN parcel p USING (parcel_id)""",
)
def _(spark, d):
    drawn = la.parcels(spark, d).select("parcel_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("drawn_sqm"))
    p = registered(spark, d)
    return printing.control_print_rows(registers.control_report(drawn, p, la.rights(spark, d), la.persons(spark, d)), p)


# --- checks that find something ----------------------------------------------------------------------------------------------


@query("V02_tampered_combined", f", {BALANCE}, {MUNICIPAL} SELECT DISTINCT corridor_id, province, municipality, 2 AS table_ord FROM municipal WHERE province = '1'")
def _(spark, d):
    """In every municipality of one province one group of the third table has a parcel too many."""
    bal, s = saved(balance(spark, d), "balance"), la.settlements(spark, d)
    combined = balances.municipality_balance(bal, s)
    wrong = (F.col("province") == "1") & (F.col("table_ord") == 2) & (F.col("row_kind") == "total")
    told = balances.unequal_combined(bal, combined.withColumn("parcels", F.col("parcels") + wrong.cast("long")), s)
    return told.select("corridor_id", "province", "municipality", "table_ord")


@query("V03_tampered_recap", f", {BALANCE}, {MUNICIPAL} SELECT DISTINCT corridor_id, province, municipality FROM municipal WHERE province = '0'")
def _(spark, d):
    """In one province the subtotals are a thousandth too large."""
    bal, s = saved(balance(spark, d), "balance"), la.settlements(spark, d)
    recap = balances.recapitulation(bal, s)
    wrong = F.when((F.col("level") == 1) & (F.col("province") == "0"), F.lit("0.001").cast("decimal(4,3)")).otherwise(F.lit(0).cast("decimal(4,3)"))
    kind = dict(recap.dtypes)["area_dka"]
    return balances.unequal_municipalities(recap.withColumn("area_dka", (F.col("area_dka") + wrong).cast(kind)), balances.municipality_balance(bal, s))


@query("V05_overdrawn_parcels", f", o AS (SELECT a.corridor_id, a.parcel_id, {DKA.format('a.drawn_sqm')} - {DKA.format('2*a.gross_sqm')} AS r FROM areas a JOIN parcel p USING (parcel_id) WHERE p.num%2=0) SELECT corridor_id, parcel_id, CAST(r AS DOUBLE) AS remainder_dka FROM o WHERE r < 0")
def _(spark, d):
    """Corridors drawn twice over every second parcel: what remains of it is negative where more than half was taken."""
    a = areas(spark, d)
    even = F.element_at(F.split("parcel_id", r"[.]"), -1).cast("long") % 2 == 0
    again = a.where(even).withColumn("drawn_sqm", F.lit(0.0))
    b = registers.register_body(a.where(even).unionByName(again), pieces(spark, d), registered(spark, d))
    return b.where("remainder_dka < 0").select("corridor_id", "parcel_id", "remainder_dka")


@query("J06_moved_footprints", ", m AS (SELECT corridor_id, pole_no, x0+1 AS x0, y0+2 AS y0, x1+1 AS x1, y1+2 AS y1 FROM footprint) SELECT a.pole_no AS a, b.pole_no AS b, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS sqm FROM footprint a JOIN m b ON a.x0<b.x1 AND a.x1>b.x0 AND a.y0<b.y1 AND a.y1>b.y0")
def _(spark, d):
    """Every footprint against all others moved by a metre and two."""
    f = la.footprints(spark, d)
    moved = f.select("pole_no", *((F.col(c) + by).alias(c) for c, by in (("x0", 1), ("y0", 2), ("x1", 1), ("y1", 2))))
    a, b = f.select(F.col("pole_no").alias("a"), la.ring().alias("ring")), moved.select(F.col("pole_no").alias("b"), la.ring().alias("ring"))
    return overlay.overlap_areas(a, b, ["a"], ["b"], cell=la.CELL).select("a", "b", F.round("sqm", 6).alias("sqm"))
