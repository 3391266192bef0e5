"""Registered queries over the given tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayleave.functions import geometry, keys, units
from wayleave.operators import balances, duplicates, edges, lines, overlay, registers, shapes
from wayleave.plans import lattice as la
from wayleave.sources import cad, codes, flat
from wayleave.sources.saved import saved

FLAGSHIP = "A07_territory_balance"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare with any engine's."""
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if k.startswith("decimal") else F.col(f"`{c}`") for c, k in df.dtypes))


def query(name: str, sql: str | None = None, lattice: bool = True):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"WITH {la.SQL.strip()}\n{sql.strip()}" if lattice else sql
        return f

    return add


D = "CAST({0} AS DOUBLE) AS {0}"


def dbl(*names: str) -> str:
    return ", ".join(D.format(n) for n in names)


DKA = "CAST(round(CAST({0} AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3))"


# --- areas -----------------------------------------------------------------------------------------------------------


def pieces(spark: SparkSession, d: str) -> DataFrame:
    f = la.footprints(spark, d).withColumnRenamed("pole_no", "pole_no")
    return overlay.box_overlaps(f, la.parcels(spark, d), ["corridor_id", "pole_no"], ["parcel_id"], la.CELL).withColumnRenamed("sqm", "piece_sqm")


def gross(spark: SparkSession, d: str) -> DataFrame:
    """Corridor areas by parcel; the lattice's areas are whole numbers."""
    parcels = la.parcels(spark, d).select("parcel_id", la.ring().alias("ring"))
    met = overlay.overlap_areas(la.corridors(spark, d), parcels, ["corridor_id"], ["parcel_id"], cell=la.CELL)
    return met.select("corridor_id", "parcel_id", F.round("sqm", 6).alias("gross_sqm"))


def areas(spark: SparkSession, d: str, cut: DataFrame | None = None) -> DataFrame:
    """(corridor_id, parcel_id, drawn_sqm, gross_sqm) of every parcel that a corridor or one of its structures touches. cut: pieces(), where they are there already."""
    key = ["corridor_id", "parcel_id"]
    touched = (pieces(spark, d) if cut is None else cut).select(*key).distinct().join(gross(spark, d), key, "full").withColumn("gross_sqm", F.coalesce("gross_sqm", F.lit(0.0)))
    p = la.parcels(spark, d).select("parcel_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("drawn_sqm"))
    return touched.join(p, "parcel_id").select(*key, "drawn_sqm", "gross_sqm")


def registered(spark: SparkSession, d: str) -> DataFrame:
    return la.parcels(spark, d).where("in_register")


def body(spark: SparkSession, d: str) -> DataFrame:
    """The register, computed once for all that reads it in a query."""
    cut = saved(pieces(spark, d), "pieces")
    return saved(registers.register_body(areas(spark, d, cut), cut, registered(spark, d)), "body")


def owners(spark: SparkSession, d: str) -> DataFrame:
    return registers.parcel_owners(la.rights(spark, d), la.persons(spark, d))


def balance(spark: SparkSession, d: str) -> DataFrame:
    return balances.territory_balance(body(spark, d))


@query("J01_corridor_parcel_areas", "SELECT corridor_id, parcel_id, CAST(gross_sqm AS DOUBLE) AS gross_sqm FROM gross")
def _(spark, d):
    return gross(spark, d)


@query("J02_footprint_parcel_pieces", "SELECT corridor_id, pole_no, parcel_id, CAST(piece_sqm AS DOUBLE) AS piece_sqm FROM piece WHERE piece_sqm > 0.001")
def _(spark, d):
    f = la.footprints(spark, d).select("corridor_id", "pole_no", la.ring().alias("ring"))
    met = overlay.overlap_areas(f, la.parcels(spark, d).select("parcel_id", la.ring().alias("ring")), ["corridor_id", "pole_no"], ["parcel_id"], cell=la.CELL)
    return met.select("corridor_id", "pole_no", "parcel_id", F.round("sqm", 6).alias("piece_sqm"))


@query("J05_structure_parcels", "SELECT f.corridor_id, f.pole_no, p.parcel_id, coalesce(p.piece_sqm, 0.0) AS piece_sqm, (f.x0+f.x1)/2 AS cx, (f.y0+f.y1)/2 AS cy FROM footprint f LEFT JOIN piece p USING (corridor_id, pole_no)")
def _(spark, d):
    centre = la.footprints(spark, d).select("corridor_id", "pole_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return centre.join(pieces(spark, d), ["corridor_id", "pole_no"], "left").withColumn("piece_sqm", F.coalesce("piece_sqm", F.lit(0.0)))


@query("J06_shape_overlap", "SELECT a.pole_no AS a, b.pole_no AS b, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS sqm FROM footprint a JOIN footprint b ON a.pole_no < b.pole_no AND a.x0<b.x1 AND a.x1>b.x0 AND a.y0<b.y1 AND a.y1>b.y0")
def _(spark, d):
    f = la.footprints(spark, d)
    a, b = f.select(F.col("pole_no").alias("a"), la.ring().alias("ring")), f.select(F.col("pole_no").alias("b"), la.ring().alias("ring"))
    return overlay.overlap_areas(a, b, ["a"], ["b"], cell=la.CELL, where=F.col("a") < F.col("b")).select("a", "b", F.round("sqm", 6).alias("sqm"))


@query("A01_sum_areas_by_parcel", "SELECT corridor_id, parcel_id, CAST(sum(drawn_sqm) AS DOUBLE) AS drawn_sqm, CAST(sum(gross_sqm) AS DOUBLE) AS gross_sqm FROM (SELECT corridor_id, parcel_id, drawn_sqm, gross_sqm FROM areas UNION ALL SELECT corridor_id, parcel_id, drawn_sqm/2, gross_sqm FROM areas WHERE drawn_sqm = 400) GROUP BY ALL")
def _(spark, d):
    a = areas(spark, d)
    again = a.where("drawn_sqm = 400").withColumn("drawn_sqm", F.col("drawn_sqm") / 2)
    return registers.sum_by_parcel(a.unionByName(again))


@query("A02_sum_rounded_pieces", "SELECT corridor_id, parcel_id, CAST(step_dka AS DOUBLE) AS step_dka FROM step")
def _(spark, d):
    return registers.printed_steps(pieces(spark, d)).drop("pole_numbers")


@query("A03_poles_of_parcel", "SELECT corridor_id, parcel_id, pole_numbers FROM step")
def _(spark, d):
    return registers.printed_steps(pieces(spark, d)).drop("step_dka")


@query("A05_winning_parcel", "SELECT corridor_id, pole_no, parcel_id, piece_sqm FROM winner")
def _(spark, d):
    return registers.winning_parcels(pieces(spark, d))


@query("A06_poles_per_parcel", "SELECT corridor_id, parcel_id, poles FROM poles")
def _(spark, d):
    return registers.poles_per_parcel(registers.winning_parcels(pieces(spark, d)))


@query("A11_lowest_pole", "SELECT corridor_id, split_part(parcel_id,'.',1) AS ekatte, CAST(min(CAST(pole_no AS BIGINT)) AS VARCHAR) AS lowest_pole FROM piece GROUP BY ALL")
def _(spark, d):
    return registers.lowest_pole(pieces(spark, d).withColumn("ekatte", keys.ekatte_of(F.col("parcel_id"))), "corridor_id", "ekatte")


@query("A13_uncovered_footprints", "SELECT * FROM (SELECT f.corridor_id, f.pole_no, f.area_sqm, coalesce(s, 0.0) AS covered_sqm, f.area_sqm - coalesce(s, 0.0) AS missing_sqm FROM footprint f LEFT JOIN (SELECT corridor_id, pole_no, sum(piece_sqm) AS s FROM piece GROUP BY ALL) USING (corridor_id, pole_no)) WHERE missing_sqm > 0.001")
def _(spark, d):
    return registers.uncovered(la.footprints(spark, d), pieces(spark, d))


STEP_ROWS = f"""rows_ AS (SELECT p.corridor_id, p.parcel_id, {DKA.format('drawn_sqm')} AS area_dka, p.pole_no, {DKA.format('piece_sqm')} AS step_dka FROM piece p JOIN areas a USING (corridor_id, parcel_id))"""


@query("A14_steps_table", f", {STEP_ROWS} SELECT corridor_id, parcel_id, {dbl('area_dka')}, pole_no, {dbl('step_dka')}, CAST(area_dka - sum(step_dka) OVER w AS DOUBLE) AS remainder_dka, row_number() OVER (w ORDER BY CAST(pole_no AS BIGINT)) AS turn, CASE WHEN row_number() OVER (w ORDER BY CAST(pole_no AS BIGINT)) = 1 THEN count(*) OVER w ELSE 0 END AS parcel_rows FROM rows_ WINDOW w AS (PARTITION BY corridor_id, parcel_id)")
def _(spark, d):
    return registers.steps_table(pieces(spark, d), areas(spark, d).select("corridor_id", "parcel_id", "drawn_sqm"))


@query("K04_steps_table_print_rows", f", {STEP_ROWS} SELECT corridor_id, 'row' AS row_kind, parcel_id, {dbl('area_dka')}, pole_no, {dbl('step_dka')}, CAST(area_dka - sum(step_dka) OVER (PARTITION BY corridor_id, parcel_id) AS DOUBLE) AS remainder_dka FROM rows_ UNION ALL SELECT corridor_id, 'total', NULL, NULL, NULL, CAST(sum(step_dka) AS DOUBLE), NULL FROM rows_ GROUP BY corridor_id")
def _(spark, d):
    t = registers.steps_table(pieces(spark, d), areas(spark, d).select("corridor_id", "parcel_id", "drawn_sqm"))
    rows = t.select("corridor_id", F.lit("row").alias("row_kind"), "parcel_id", "area_dka", "pole_no", "step_dka", "remainder_dka")
    return rows.unionByName(t.groupBy("corridor_id").agg(F.sum("step_dka").alias("step_dka")).withColumn("row_kind", F.lit("total")), allowMissingColumns=True)


# --- registers -------------------------------------------------------------------------------------------------------

ROMAN = "CASE kat WHEN '0' THEN '' WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' WHEN '5' THEN 'V' WHEN '6' THEN 'VI' WHEN '7' THEN 'VII' WHEN '8' THEN 'VIII' WHEN '9' THEN 'IX' WHEN '10' THEN 'X' END"
REGISTER = f"""register AS (SELECT b.corridor_id, b.ekatte, row_number() OVER (PARTITION BY b.corridor_id, b.ekatte ORDER BY split_part(b.parcel_id,'.',1)::BIGINT, split_part(b.parcel_id,'.',2)::BIGINT, split_part(b.parcel_id,'.',3)::BIGINT, coalesce(owner_ord, 1)) AS row_ord,
  coalesce(owner_ord, 1) = 1 AS first, b.parcel_id AS id, b.*, person_id, person_name FROM body b LEFT JOIN owner o ON o.parcel_id = b.parcel_id AND b.found)"""


@query("J14_parcel_owners", "SELECT parcel_id, owner_ord, person_id, person_name FROM owner")
def _(spark, d):
    return owners(spark, d)


@query("J15_affected_register", f", {REGISTER} SELECT corridor_id, ekatte, row_ord, CASE WHEN first THEN id END AS parcel_id, {', '.join(f'CAST(CASE WHEN first THEN {c} END AS DOUBLE) AS {c}' for c in ('area_dka', 'restricted_dka', 'remainder_dka', 'step_dka'))}, CASE WHEN first THEN pole_numbers END AS pole_numbers, CASE WHEN first AND found THEN {ROMAN} END AS category, vids AS ownership, person_id, person_name FROM register")
def _(spark, d):
    return registers.affected_register(body(spark, d), owners(spark, d))


@query("A04_register_totals", f"SELECT corridor_id, ekatte, count(*) AS parcels, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in ('area_dka', 'restricted_dka', 'remainder_dka'))}, CAST(sum(coalesce(step_dka, 0)) AS DOUBLE) AS step_dka FROM body GROUP BY ALL")
def _(spark, d):
    return registers.register_totals(body(spark, d))


@query("K02_register_print_rows", f", {REGISTER} SELECT corridor_id, ekatte, 'row' AS row_kind, row_ord, CASE WHEN first THEN id END AS parcel_id, {', '.join(f'CAST(CASE WHEN first THEN {c} END AS DOUBLE) AS {c}' for c in ('area_dka', 'restricted_dka', 'remainder_dka', 'step_dka'))} FROM register UNION ALL SELECT corridor_id, ekatte, 'total', NULL, NULL, {', '.join(f'CAST(sum({c}) AS DOUBLE)' for c in ('area_dka', 'restricted_dka', 'remainder_dka'))}, CAST(sum(coalesce(step_dka, 0)) AS DOUBLE) FROM body GROUP BY corridor_id, ekatte")
def _(spark, d):
    b = body(spark, d)
    rows = registers.affected_register(b, owners(spark, d)).select("corridor_id", "ekatte", F.lit("row").alias("row_kind"), "row_ord", "parcel_id", "area_dka", "restricted_dka", "remainder_dka", "step_dka")
    return rows.unionByName(registers.register_totals(b).drop("parcels").withColumn("row_kind", F.lit("total")), allowMissingColumns=True)


STEPS = f"""block AS (SELECT corridor_id, pole_no, parcel_id, sum({DKA.format('piece_sqm')}) AS piece_dka FROM piece GROUP BY ALL),
steps AS (SELECT b.corridor_id, b.pole_no, b.parcel_id, b.piece_dka, {DKA.format('a.drawn_sqm')} AS area_dka, c.kat, c.vids, o.owner_ord, o.person_id, o.person_name, coalesce(o.owner_ord, 1) = 1 AS first, c.parcel_id IS NOT NULL AS found,
  row_number() OVER (PARTITION BY b.corridor_id ORDER BY b.pole_no::BIGINT, split_part(b.parcel_id,'.',1)::BIGINT, split_part(b.parcel_id,'.',2)::BIGINT, split_part(b.parcel_id,'.',3)::BIGINT, coalesce(o.owner_ord, 1)) AS row_ord
  FROM block b JOIN areas a USING (corridor_id, parcel_id) LEFT JOIN (SELECT * FROM parcel WHERE in_register) c ON c.parcel_id = b.parcel_id LEFT JOIN owner o ON o.parcel_id = b.parcel_id AND c.parcel_id IS NOT NULL)"""


@query("J16_steps_register", f", {STEPS} SELECT corridor_id, row_ord, CASE WHEN first THEN 'Стълб №' || pole_no END AS pole_label, CAST(CASE WHEN first THEN piece_dka END AS DOUBLE) AS piece_dka, CASE WHEN first THEN parcel_id END AS parcel_id, CAST(CASE WHEN first THEN area_dka END AS DOUBLE) AS area_dka, CASE WHEN first AND found THEN {ROMAN} END AS category, CASE WHEN first THEN vids END AS ownership, person_id, person_name FROM steps")
def _(spark, d):
    return registers.steps_register(pieces(spark, d), areas(spark, d), registered(spark, d), owners(spark, d))


@query("K03_steps_register_totals", f", {STEPS} SELECT corridor_id, count(DISTINCT pole_no) AS poles, CAST(sum(CASE WHEN first THEN piece_dka END) AS DOUBLE) AS piece_dka FROM steps GROUP BY ALL")
def _(spark, d):
    rows = registers.steps_register(pieces(spark, d), areas(spark, d), registered(spark, d), owners(spark, d))
    return rows.groupBy("corridor_id").agg(F.countDistinct("pole_label").alias("poles"), F.sum("piece_dka").alias("piece_dka"))


CONTROL = """control AS (SELECT p.parcel_id, r.right_ord, p.kat, p.area_sqm, (p.x1-p.x0)*(p.y1-p.y0) AS drawn_sqm, r.kind, r.doc1, r.doc2, r.person_id, n.name FROM parcel p LEFT JOIN rights r USING (parcel_id) LEFT JOIN person n USING (person_id) WHERE p.in_register)"""


@query("J13_control_report", f", {CONTROL} SELECT parcel_id, row_number() OVER (PARTITION BY split_part(parcel_id,'.',1) ORDER BY {la.ORDER}, right_ord NULLS FIRST) AS row_ord, {ROMAN} AS category, area_sqm AS cad_sqm, drawn_sqm, CAST(round(CAST(drawn_sqm AS DECIMAL(24,6)) - CAST(area_sqm AS DECIMAL(24,6)), 2) AS DOUBLE) AS difference_sqm, kind AS right_kind, CASE WHEN doc1 IS NULL OR doc1 IN ('', '-2') THEN '' WHEN doc2 IN ('', '-2') THEN doc1 ELSE doc1 || '/' || doc2 END AS share, person_id, name AS person_name FROM control")
def _(spark, d):
    drawn = la.parcels(spark, d).select("parcel_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("drawn_sqm"))
    return registers.control_report(drawn, registered(spark, d), la.rights(spark, d), la.persons(spark, d))


@query("J27_unmatched_keys", "SELECT 'not_found' AS issue, parcel_id AS key, count(*) AS n FROM body WHERE NOT found GROUP BY ALL UNION ALL SELECT 'without_owners', parcel_id, count(*) FROM body WHERE found AND parcel_id NOT IN (SELECT parcel_id FROM owner) GROUP BY ALL UNION ALL SELECT 'negative_remainder', parcel_id, count(*) FROM body WHERE remainder_dka < 0 GROUP BY ALL")
def _(spark, d):
    b = body(spark, d)
    issue = lambda name, rows: rows.groupBy(F.lit(name).alias("issue"), F.col("parcel_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    lost = issue("not_found", b.where("not found")).unionByName(issue("without_owners", b.where("found").join(owners(spark, d), "parcel_id", "left_anti")))
    return lost.unionByName(issue("negative_remainder", b.where("remainder_dka < 0")))


# --- balances --------------------------------------------------------------------------------------------------------

GROUPS = "CASE WHEN NOT found THEN 3 WHEN {e} THEN 2 WHEN {n} THEN 0 ELSE 1 END AS class, CASE WHEN found AND NOT {e} AND {n} THEN CAST({c} AS BIGINT) ELSE 0 END AS number, CASE WHEN NOT found THEN 'Няма данни в .cad' WHEN {e} THEN '{none}' ELSE {c} END AS key, CASE WHEN NOT found THEN 'Няма данни в .cad' WHEN {e} THEN '{none}' ELSE {t} END AS \"group\""
BALANCE = (
    "grouped AS ("
    + " UNION ALL ".join(
        f"SELECT corridor_id, ekatte, {i} AS table_ord, {GROUPS.format(c=c, e=e, n=n, none=none, t=t)}, area_dka, restricted_dka, coalesce(step_dka, 0) AS step_dka, poles FROM body"
        for i, (c, e, n, none, t) in enumerate([("kat", "kat = '0'", "true", "Без категория", ROMAN + " || ' категория'"), *((c, f"{c} = ''", "false", "Без код", c) for c in ("vids", "vidt", "ntp"))])
    )
    + """),
sums AS (SELECT corridor_id, ekatte, table_ord, class, number, key, min("group") AS "group", count(*) AS parcels, sum(area_dka) AS area_dka, sum(restricted_dka) AS restricted_dka, sum(poles) AS poles, sum(step_dka) AS step_dka, sum(restricted_dka)+sum(step_dka) AS affected_dka FROM grouped GROUP BY ALL)"""
)
SUMMED = "sum(parcels) AS parcels, sum(area_dka) AS area_dka, sum(restricted_dka) AS restricted_dka, sum(poles) AS poles, sum(step_dka) AS step_dka, sum(affected_dka) AS affected_dka"


def finished(table: str, section: str) -> str:
    share = "CASE WHEN {w} <> 0 THEN CAST(round(affected_dka * 100 / {w}, 2) AS DOUBLE) END"
    w = f"sum(affected_dka) OVER (PARTITION BY {section}, table_ord)"
    return f"""SELECT {section}, table_ord, class, number, key, "group", CAST(parcels AS BIGINT) AS parcels, {dbl('area_dka', 'restricted_dka')}, CAST(poles AS BIGINT) AS poles, {dbl('step_dka', 'affected_dka')}, CAST(row_number() OVER (PARTITION BY {section}, table_ord ORDER BY class, number, key) AS INTEGER) AS no, {share.format(w=w)} AS percent, 'group' AS row_kind FROM {table}
UNION ALL SELECT {section}, table_ord, NULL, NULL, NULL, 'Общо', CAST(sum(parcels) AS BIGINT), CAST(sum(area_dka) AS DOUBLE), CAST(sum(restricted_dka) AS DOUBLE), CAST(sum(poles) AS BIGINT), CAST(sum(step_dka) AS DOUBLE), CAST(sum(affected_dka) AS DOUBLE), NULL, CASE WHEN sum(affected_dka) <> 0 THEN 100.0 END, 'total' FROM {table} GROUP BY {section}, table_ord"""


@query("A07_territory_balance", f", {BALANCE} {finished('sums', 'corridor_id, ekatte')}")
def _(spark, d):
    return balance(spark, d)


MUNICIPAL = f"""municipal AS (SELECT corridor_id, province, municipality, table_ord, class, number, key, min("group") AS "group", {SUMMED} FROM sums JOIN settlement USING (ekatte) GROUP BY ALL)"""


@query("A08_municipality_balance", f", {BALANCE}, {MUNICIPAL} {finished('municipal', 'corridor_id, province, municipality')}")
def _(spark, d):
    return balances.municipality_balance(balance(spark, d), la.settlements(spark, d))


AXIS = """axis AS (SELECT corridor_id, p.parcel_id, p.ekatte, least(x1, 694)-greatest(x0, 5) AS metres FROM band JOIN parcel p ON gy//10 = corridor_id AND p.y0 < b+6 AND p.y1 > b+6 AND p.x0 < 694 AND p.x1 > 5)"""


def axis(spark: SparkSession, d: str) -> DataFrame:
    """(corridor_id, ord, x0, y0, x1, y1, bulge): each corridor's straight axis."""
    y = (F.col("b") + 6).alias
    return la.bands(spark, d).select("corridor_id", F.lit(0).alias("ord"), F.lit(5.0).alias("x0"), y("y0"), F.lit(694.0).alias("x1"), y("y1"), F.lit(0.0).alias("bulge"))


def ringed(spark: SparkSession, d: str) -> DataFrame:
    """Parcels as shapes: (parcel_id, ekatte, ord, ring)."""
    return la.parcels(spark, d).select("parcel_id", "ekatte", F.col("num").alias("ord"), la.ring().alias("ring"))


def route(spark: SparkSession, d: str) -> DataFrame:
    """Metres of each corridor's axis in each parcel."""
    met = edges.axis_lengths(axis(spark, d), ringed(spark, d), ["corridor_id"], la.CELL).where("parcel_id is not null")
    return met.select("corridor_id", "parcel_id", keys.ekatte_of(F.col("parcel_id")).alias("ekatte"), F.round("metres", 6).alias("metres"))


@query("A10_route_metres_by_settlement", f", {AXIS} SELECT corridor_id, ekatte, CAST(sum(metres) AS DOUBLE) AS metres, CAST(round(CAST(sum(metres) AS DECIMAL(24,6))*0.001, 3) AS DOUBLE) AS km FROM axis GROUP BY ALL")
def _(spark, d):
    return balances.route_metres(route(spark, d))


RECAP = f"""recap AS (SELECT corridor_id, ekatte, {SUMMED} FROM sums WHERE table_ord = 0 GROUP BY ALL),
recap_m AS (SELECT r.*, s.province, s.municipality, coalesce(m, 0) AS m FROM recap r JOIN settlement s USING (ekatte) LEFT JOIN (SELECT corridor_id, ekatte, CAST(sum(metres) AS DECIMAL(24,6)) AS m FROM axis GROUP BY ALL) USING (corridor_id, ekatte))"""


@query("A09_recapitulation", f", {BALANCE}, {AXIS}, {RECAP} SELECT corridor_id, province, municipality, ekatte, CASE WHEN ekatte IS NOT NULL THEN 0 WHEN municipality IS NOT NULL THEN 1 ELSE 2 END AS level, CAST(sum(parcels) AS BIGINT) AS parcels, CAST(sum(area_dka) AS DOUBLE) AS area_dka, CAST(sum(restricted_dka) AS DOUBLE) AS restricted_dka, CAST(sum(poles) AS BIGINT) AS poles, CAST(sum(step_dka) AS DOUBLE) AS step_dka, CAST(sum(affected_dka) AS DOUBLE) AS affected_dka, CAST(round(sum(m)*0.001, 3) AS DOUBLE) AS route_km FROM recap_m GROUP BY GROUPING SETS ((corridor_id, province, municipality, ekatte), (corridor_id, province, municipality), (corridor_id, province))")
def _(spark, d):
    return balances.recapitulation(balance(spark, d), la.settlements(spark, d), route(spark, d))


@query("V01_verify_balance", "SELECT corridor_id, ekatte FROM body WHERE false")
def _(spark, d):
    b = body(spark, d)
    return balances.unequal_totals(balances.territory_balance(b), registers.register_totals(b))


@query("V03_recap_matches", "SELECT corridor_id, '' AS province, '' AS municipality FROM body WHERE false")
def _(spark, d):
    bal, s = balance(spark, d), la.settlements(spark, d)
    return balances.unequal_municipalities(balances.recapitulation(bal, s), balances.municipality_balance(bal, s))


@query("V04_pole_counts_agree", f", {BALANCE} SELECT w.corridor_id, w.winners, CAST(s.counted AS BIGINT) AS counted FROM (SELECT corridor_id, count(*) AS winners FROM winner GROUP BY ALL) w JOIN (SELECT corridor_id, sum(poles) AS counted FROM sums WHERE table_ord = 0 GROUP BY ALL) s USING (corridor_id)")
def _(spark, d):
    w = registers.winning_parcels(pieces(spark, d)).groupBy("corridor_id").agg(F.count(F.lit(1)).alias("winners"))
    s = balance(spark, d).where("row_kind = 'total' and table_ord = 0").groupBy("corridor_id").agg(F.sum("poles").alias("counted"))
    return w.join(s, "corridor_id")


@query("V05_negative_remainder", "SELECT corridor_id, parcel_id, CAST(remainder_dka AS DOUBLE) AS remainder_dka FROM body WHERE remainder_dka < 0")
def _(spark, d):
    return body(spark, d).where("remainder_dka < 0").select("corridor_id", "parcel_id", "remainder_dka")


# --- orders and scalars ----------------------------------------------------------------------------------------------


@query("T01_parcel_id_order", f"SELECT ekatte, parcel_id, row_number() OVER (PARTITION BY ekatte ORDER BY {la.ORDER}) AS ord FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("ekatte", "parcel_id", F.row_number().over(Window.partitionBy("ekatte").orderBy(keys.parcel_key(F.col("parcel_id")))).alias("ord"))


@query("T02_control_id_order", f"SELECT ekatte, parcel_id, row_number() OVER (PARTITION BY ekatte ORDER BY {la.ORDER}) AS ord FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("ekatte", "parcel_id", F.row_number().over(Window.partitionBy("ekatte").orderBy(keys.control_key(F.col("parcel_id")))).alias("ord"))


@query("T03_pole_order", "SELECT corridor_id, pole_no, row_number() OVER (PARTITION BY corridor_id ORDER BY TRY_CAST(pole_no AS BIGINT) NULLS LAST, lower(pole_no), pole_no) AS ord FROM (SELECT corridor_id, CASE WHEN CAST(pole_no AS BIGINT)%7=0 THEN 'ПС-' || pole_no ELSE pole_no END AS pole_no FROM footprint)")
def _(spark, d):
    p = la.footprints(spark, d).select("corridor_id", F.when(F.col("pole_no").cast("long") % 7 == 0, F.concat(F.lit("ПС-"), F.col("pole_no"))).otherwise(F.col("pole_no")).alias("pole_no"))
    return p.select("corridor_id", "pole_no", F.row_number().over(Window.partitionBy("corridor_id").orderBy(keys.pole_key(F.col("pole_no")))).alias("ord"))


@query("T06_limit_list", f"SELECT ekatte, string_agg(parcel_id, ', ' ORDER BY {la.ORDER}) FILTER (rn <= 5) || CASE WHEN count(*) > 5 THEN ' …' ELSE '' END AS ids FROM (SELECT *, row_number() OVER (PARTITION BY ekatte ORDER BY {la.ORDER}) AS rn FROM parcel) GROUP BY ekatte")
def _(spark, d):
    ranked = la.parcels(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("ekatte").orderBy(keys.parcel_key(F.col("parcel_id")))))
    first = ranked.groupBy("ekatte").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "parcel_id")))).alias("l"), F.count(F.lit(1)).alias("n"))
    return first.select("ekatte", F.concat(F.array_join(F.transform("l", lambda x: x["parcel_id"]), ", "), F.when(F.col("n") > 5, F.lit(" …")).otherwise(F.lit(""))).alias("ids"))


@query("T07_hex_handle_order", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_partkey%13=0 THEN NULL ELSE l_partkey END AS handle_no FROM lineitem", lattice=False)
def _(spark, d):
    li = la.t(spark, d, "lineitem")
    handle = F.when(F.col("l_partkey") % 13 == 0, F.lit("X?")).otherwise(F.hex("l_partkey"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", keys.hex_handle(handle).alias("handle_no"))


@query("F01_sqm_to_dka", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3)) AS DOUBLE) AS dka, CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3)) AS VARCHAR) AS text FROM lineitem", lattice=False)
def _(spark, d):
    dka = units.sqm_to_dka(F.col("l_extendedprice"))
    return la.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", dka.alias("dka"), units.format_dka(dka).alias("text"))


@query("F03_ids", "SELECT parcel_id, split_part(parcel_id,'.',1) AS ekatte, parcel_id AS \"full\", regexp_replace(parcel_id, '^[^.]*[.]', '') AS label FROM parcel")
def _(spark, d):
    p = la.parcels(spark, d)
    return p.select("parcel_id", keys.ekatte_of(F.col("parcel_id")).alias("ekatte"), keys.full_parcel_id(F.col("ekatte"), keys.parcel_label(F.col("parcel_id"))).alias("full"), keys.parcel_label(F.col("parcel_id")).alias("label"))


@query("F08_normalize_code", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS code FROM supplier", lattice=False)
def _(spark, d):
    padded = F.concat(F.lit("  "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" "))
    return la.t(spark, d, "supplier").select("s_suppkey", keys.normal_code(padded).alias("code"))


@query("F09_roman_category", f"SELECT parcel_id, kat, {ROMAN} AS roman FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("parcel_id", "kat", units.roman_category(F.col("kat")).alias("roman"))


@query("F10_format_share", "SELECT parcel_id, right_ord, CASE WHEN doc2 = '-2' THEN doc1 ELSE doc1 || '/' || doc2 END AS share FROM rights")
def _(spark, d):
    return la.rights(spark, d).select("parcel_id", "right_ord", units.share(F.col("doc1"), F.col("doc2")).alias("share"))


@query("J12_describe_codes", "SELECT parcel_id, kat, CASE WHEN kat = '0' THEN 'код 0' ELSE kat || ' – ' || r_name END AS kat_text FROM (SELECT parcel_id, kat, CASE WHEN CAST(kat AS INTEGER) BETWEEN 1 AND 5 THEN CAST(kat AS INTEGER)-1 END AS k FROM parcel) LEFT JOIN region ON r_regionkey = k WHERE k IS NOT NULL OR kat = '0' UNION ALL SELECT parcel_id, kat, 'код ' || kat FROM parcel WHERE CAST(kat AS INTEGER) > 5")
def _(spark, d):
    texts = la.t(spark, d, "region").select(F.lit("kat").alias("nomenclature"), F.concat(F.lit("00"), (F.col("r_regionkey") + 1).cast("string")).alias("code"), F.col("r_name").alias("text"))
    return registers.described(la.parcels(spark, d), texts, "kat", "kat", both=True).select("parcel_id", "kat", "kat_text")


# --- differences of two snapshots ------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = la.t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    after = before.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return before, after


SNAP = "WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders), b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey%89=0 THEN o_totalprice+1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey%97<>0) "


@query("U04_multiset_diff", SNAP + "SELECT 'before' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'after', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)", lattice=False)
def _(spark, d):
    a, b = snapshots(spark, d)
    return a.exceptAll(b).select(F.lit("before").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("after").alias("side"), "*"))


@query("U05_count_diff_by_group", SNAP + "SELECT o_orderpriority, x.n AS before, y.n AS after, coalesce(y.n,0)-coalesce(x.n,0) AS difference FROM (SELECT o_orderpriority, count(*) AS n FROM a GROUP BY ALL) x FULL JOIN (SELECT o_orderpriority, count(*) AS n FROM b GROUP BY ALL) y USING (o_orderpriority)", lattice=False)
def _(spark, d):
    a, b = snapshots(spark, d)
    n = lambda df, name: df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias(name))
    j = n(a, "before").join(n(b, "after"), "o_orderpriority", "full")
    return j.withColumn("difference", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


@query("U06_cell_diff", SNAP + "SELECT * FROM (SELECT o_orderkey, col, x.v AS before, y.v AS after FROM (SELECT o_orderkey, 'status' AS col, o_orderstatus AS v FROM a UNION ALL SELECT o_orderkey, 'price', CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS VARCHAR) FROM a) x FULL JOIN (SELECT o_orderkey, 'status' AS col, o_orderstatus AS v FROM b UNION ALL SELECT o_orderkey, 'price', CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS VARCHAR) FROM b) y USING (o_orderkey, col)) WHERE before IS DISTINCT FROM after", lattice=False)
def _(spark, d):
    a, b = snapshots(spark, d)

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.select("o_orderkey", F.expr(f"stack(2, 'status', o_orderstatus, 'price', cast(cast(o_totalprice as decimal(18,3)) as string)) as (col, {name})"))

    return cells(a, "before").join(cells(b, "after"), ["o_orderkey", "col"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query("U07_table_diff", SNAP + "SELECT o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only before' WHEN a.o_orderkey IS NULL THEN 'only after' ELSE 'changed' END AS state FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus", lattice=False)
def _(spark, d):
    a, b = snapshots(spark, d)
    row = lambda df, name: df.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority", "o_totalprice").alias(name))
    j = row(a, "x").join(row(b, "y"), "o_orderkey", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return j.select("o_orderkey", F.when(F.col("y").isNull(), "only before").when(F.col("x").isNull(), "only after").otherwise("changed").alias("state"))


# --- .cad files: the given tables written as lines of such files, and parsed back --------------------------------------

# Lines of a file are numbered by section, then by row; a parcel's rights by parcel and place. Sections are apart by more than any row's number times RIGHTS.
SECTION, RIGHTS = 10**14, 10**6


def cad_lines(spark: SparkSession, d: str) -> DataFrame:
    """(path, modified, line_no, text): one file for each settlement of a band of parcels; names hold quotes, localities are by ownership."""
    p = registered(spark, d).withColumn("band", F.floor(F.col("num") / 400))
    at = lambda part, i: (F.lit(part * SECTION).cast("long") + i).alias("line_no")
    every = p.select("ekatte", "band").distinct()
    blocks = [
        (0, ["HEADER", "VERSION 4.02", None, "NAME с. Пример", "END_HEADER", "", "CONTROL CADASTER"]),
        (2, ["END_CONTROL", "CONTROL OTHER", "CONTUR_AREA 0.0 7777", "END_CONTROL", "TABLE POZEMLIMOTI", *(f"F {f} C 20 0 1" for f in ("IDENT", "VIDT", "NTP", "VIDS", "KAT", "MESTNOST"))]),
        (4, ["END_TABLE", "TABLE MESTNOSTI", "F MESTNOST C 5", "F NAME C 40", 'D 1,"м. "ЛЪКИТЕ"",', 'D 1,"втора",', "END_TABLE", "TABLE PERSONS", "F PERSON C 12", "F NAME C 90", "F FLAG C 1"]),
        (6, ["END_TABLE", "TABLE PRAVA", *(f"F {f} C 20" for f in ("IDENT", "PERSON", "PRAVOVID", "DOCID1", "DOCID2"))]),
        (8, ["D 1,2,3,", "END_TABLE"]),
    ]
    fixed = None
    for part, texts in blocks:
        text = F.posexplode(F.array(*(F.lit(t) if t is not None else F.concat(F.lit("EKATTE "), F.col("ekatte")) for t in texts))).alias("i", "text")
        rows = every.select("ekatte", "band", text).select("ekatte", "band", at(part, F.col("i")), "text")
        fixed = rows if fixed is None else fixed.unionByName(rows)
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    ident = keys.parcel_label(F.col("parcel_id"))
    area = p.select("ekatte", "band", at(1, F.col("num")), F.concat(F.lit("CONTUR_AREA "), ident, F.lit(" "), F.replace(F.col("area_sqm").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).alias("text"))
    parcel = p.select("ekatte", "band", at(3, F.col("num")), F.concat(F.lit("D "), F.concat_ws(",", ident, q("vidt"), q("ntp"), q("vids"), F.col("kat"), F.lit("1")), F.lit(",")).alias("text"))
    r = la.rights(spark, d).join(p.select("parcel_id", "ekatte", "band", "num"), "parcel_id")
    right = r.select("ekatte", "band", at(7, F.col("num") * RIGHTS + F.col("right_ord")), F.concat(F.lit("D "), F.concat_ws(",", ident, F.col("person_id"), F.col("kind"), F.col("doc1"), F.col("doc2"))).alias("text"))
    who = r.select("ekatte", "band", "person_id").distinct().join(la.persons(spark, d), "person_id")
    named = F.concat(F.lit('"ЕТ \\"'), F.col("name"), F.lit('\\" ООД"'))
    person = who.select("ekatte", "band", at(5, F.col("person_id").cast("long")), F.concat(F.lit("D "), F.concat_ws(",", "person_id", named, F.when(F.col("heirs"), F.lit("T")).otherwise(F.lit(""))), F.lit(",")).alias("text"))
    all_ = fixed.unionByName(area).unionByName(parcel).unionByName(right).unionByName(person)
    return all_.select(F.concat(F.lit("/"), F.col("band").cast("string"), F.lit("/"), F.col("ekatte"), F.lit(".cad")).alias("path"), F.lit("2026-01-01").cast("timestamp").alias("modified"), "line_no", "text")


@query("S08_cad_parcels", "SELECT parcel_id, ekatte, vidt, ntp, vids, kat, 'м. \"ЛЪКИТЕ\"' AS locality, area_sqm FROM parcel WHERE in_register")
def _(spark, d):
    return cad.load_registers(cad_lines(spark, d))["parcels"].select("parcel_id", "ekatte", "vidt", "ntp", "vids", "kat", "locality", "area_sqm")


@query("S12_cad_rights", "SELECT r.parcel_id, row_number() OVER (PARTITION BY r.parcel_id ORDER BY right_ord) AS ord, kind, r.person_id, 'ЕТ \"' || n.name || '\" ООД' AS person_name, n.heirs, doc1, doc2 FROM rights r JOIN (SELECT * FROM parcel WHERE in_register) p USING (parcel_id) JOIN person n USING (person_id)")
def _(spark, d):
    r = cad.load_registers(cad_lines(spark, d))["rights"]
    return r.select("parcel_id", F.row_number().over(Window.partitionBy("parcel_id").orderBy("right_ord")).alias("ord"), "kind", "person_id", "person_name", "heirs", "doc1", "doc2")


@query("S10_cad_persons", "SELECT ekatte, person_id, name, heirs FROM (SELECT DISTINCT p.ekatte, p.num//400 AS band, r.person_id, 'ЕТ \"' || n.name || '\" ООД' AS name, n.heirs FROM rights r JOIN (SELECT * FROM parcel WHERE in_register) p USING (parcel_id) JOIN person n USING (person_id))")
def _(spark, d):
    good = cad.good_rows(cad.table_rows(cad.sections(cad_lines(spark, d))))
    return cad.persons(good).select(F.regexp_extract("path", "([0-9]+)[.]cad", 1).alias("ekatte"), "person_id", "name", "heirs")


@query("S13_cad_bad_records", "SELECT ekatte, 'PRAVA' AS \"table\", 'wrong number of values' AS reason, count(*) AS n FROM (SELECT DISTINCT ekatte, num//400 AS band FROM parcel WHERE in_register) GROUP BY ALL")
def _(spark, d):
    bad = cad.load_registers(cad_lines(spark, d))["bad_records"]
    return bad.groupBy(F.regexp_extract("path", "([0-9]+)[.]cad", 1).alias("ekatte"), "table", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("S06_cad_header", "SELECT ekatte, '4.02' AS version, 'с. Пример' AS settlement FROM (SELECT DISTINCT ekatte, num//400 AS band FROM parcel WHERE in_register)")
def _(spark, d):
    return cad.headers(cad.sections(cad_lines(spark, d))).select("ekatte", "version", "settlement")


@query("S07_cad_contour_areas", "SELECT ekatte, regexp_replace(parcel_id, '^[^.]*[.]', '') AS ident, area_sqm FROM parcel WHERE in_register")
def _(spark, d):
    return cad.contour_areas(cad.sections(cad_lines(spark, d))).select(F.regexp_extract("path", "([0-9]+)[.]cad", 1).alias("ekatte"), "ident", "area_sqm")


@query("S09_cad_localities", "SELECT ekatte, '1' AS code, 'м. \"ЛЪКИТЕ\"' AS locality FROM (SELECT DISTINCT ekatte, num//400 AS band FROM parcel WHERE in_register)")
def _(spark, d):
    good = cad.good_rows(cad.table_rows(cad.sections(cad_lines(spark, d))))
    return cad.localities(good).select(F.regexp_extract("path", "([0-9]+)[.]cad", 1).alias("ekatte"), F.col("mestnost").alias("code"), "locality")


@query("O01_newest_parcel_wins", "SELECT parcel_id, ekatte, CASE WHEN num%3=0 THEN 'new' ELSE vids END AS vids, CASE WHEN num%3=0 THEN 'b' ELSE 'a' END AS file FROM parcel WHERE in_register")
def _(spark, d):
    won, _ = newest_of(spark, d)
    return won.select("parcel_id", "ekatte", "vids", F.when(F.startswith("path", F.lit("/b")), F.lit("b")).otherwise(F.lit("a")).alias("file"))


@query("O01_newest_rights", "SELECT r.parcel_id, r.person_id, kind, 'a' AS file, right_ord FROM rights r JOIN (SELECT * FROM parcel WHERE in_register) p USING (parcel_id) WHERE num%3 <> 0 UNION ALL SELECT r.parcel_id, r.person_id, 'new', 'b', right_ord FROM rights r JOIN (SELECT * FROM parcel WHERE in_register) p USING (parcel_id) WHERE num%3 = 0 AND right_ord%2 = 0")
def _(spark, d):
    """A parcel's rights come from the file that it comes from: of the newer file's parcels every second right, though the older one has them all."""
    _, held = newest_of(spark, d)
    file = F.when(F.startswith("path", F.lit("/b")), F.lit("b")).otherwise(F.lit("a")).alias("file")
    return held.where("person_id <> '2'").select("parcel_id", "person_id", "kind", file, (F.col("right_ord") % RIGHTS).alias("right_ord"))


def newest_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each file again, a day later, with every third parcel and every second of its rights changed."""
    rows = cad_lines(spark, d)
    parts = saved(cad.sections(rows), "parts")
    good = cad.good_rows(cad.table_rows(parts))
    third = F.element_at(F.split("parcel_id", r"\."), -1).try_cast("long") % 3 == 0
    later = F.concat(F.lit("/b"), F.col("path")).alias("path")
    p, r = cad.parcels(good, parts), cad.rights(good, parts)
    again = p.where(third).withColumn("vids", F.lit("new")).withColumn("path", later)
    held = r.where(third & (F.col("right_ord") % 2 == 0)).withColumn("kind", F.lit("new")).withColumn("path", later)
    ages = rows.select("path").distinct().withColumn("modified", F.lit(1)).unionByName(again.select("path").distinct().withColumn("modified", F.lit(2)))
    return cad.newest(p.unionByName(again), r.unionByName(held), ages)


SPOILT = """f AS (SELECT DISTINCT num//400 AS band, ekatte FROM parcel WHERE in_register), file AS (SELECT band, ekatte, '/' || band || '/' || ekatte || '.cad' AS path FROM f),
own AS (SELECT p.*, num//400 AS band FROM parcel p WHERE in_register),
lost AS (SELECT o.band, o.ekatte, count(*) AS n FROM rights r JOIN own o USING (parcel_id) WHERE CAST(r.person_id AS BIGINT)%13=0 GROUP BY ALL)"""


@query(
    "S13_cad_warnings",
    f""", {SPOILT} SELECT path, '' AS "table", 'other format version' AS reason, 1 AS n FROM file WHERE band%3=0
UNION ALL SELECT path, '', 'no settlement code', 1 FROM file WHERE band%3=1
UNION ALL SELECT path, '', 'undecodable characters', 2 FROM file WHERE band%3=2
UNION ALL SELECT path, '', 'bad contour area', count(*) FROM own JOIN file USING (band, ekatte) WHERE num%7=0 GROUP BY path
UNION ALL SELECT path, 'PRAVA', 'wrong number of values', 1 FROM file
UNION ALL SELECT path, 'PRAVA', 'person not listed', n FROM lost JOIN file USING (band, ekatte)
UNION ALL SELECT path, 'POZEMLIMOTI', 'repeated parcel', count(*) FROM own JOIN file USING (band, ekatte) WHERE num%17=0 GROUP BY path
UNION ALL SELECT path, 'PERSONS', 'repeated with another name', count(DISTINCT r.person_id) FROM rights r JOIN own o USING (parcel_id) JOIN file USING (band, ekatte) WHERE CAST(r.person_id AS BIGINT)%19=0 AND CAST(r.person_id AS BIGINT)%13<>0 GROUP BY path""",
)
def _(spark, d):
    """Files with another version, without a code or with bytes outside the code page; areas that are no numbers, persons that are missing or named twice, parcels listed twice."""
    told = cad.warnings(spoilt_lines(spark, d))
    return told.groupBy("path", "table", "reason").agg(F.sum("n").cast("long").alias("n"))


@query("S07_bad_contour_areas", f", {SPOILT} SELECT path, num FROM own JOIN file USING (band, ekatte) WHERE num%7=0")
def _(spark, d):
    bad = cad.warnings(spoilt_lines(spark, d)).where("reason = 'bad contour area'")
    return bad.select("path", (F.col("line_no") - SECTION).alias("num"))


def spoilt_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = cad_lines(spark, d)
    band, part, at = F.get(F.split("path", "/"), F.lit(1)).cast("long") % 3, F.floor(F.col("line_no") / SECTION), F.col("line_no") % SECTION
    text = F.col("text")
    spoilt = (
        F.when((text == "VERSION 4.02") & (band == 0), F.lit("VERSION 4.03"))
        .when(F.startswith("text", F.lit("NAME ")) & (band == 2), F.lit("NAME с. ��"))
        .when((part == 1) & (at % 7 == 0), F.concat(F.substring_index("text", " ", 2), F.lit(" n,n")))
        .otherwise(text)
    )
    person = part == 5
    rows = rows.withColumn("text", spoilt).where(~(F.startswith("text", F.lit("EKATTE ")) & (band == 1))).where(~(person & F.startswith("text", F.lit("D ")) & (at % 13 == 0)))
    twice = rows.where((part == 3) & (at % 17 == 0))
    named = rows.where(person & F.startswith("text", F.lit("D ")) & (at % 19 == 0)).withColumn("text", F.concat(F.substring_index("text", ",", 1), F.lit(',"another",,')))
    later = lambda df, by: df.withColumn("line_no", F.col("line_no") + by)
    return rows.unionByName(later(twice, SECTION // 10)).unionByName(later(named, SECTION // 10))


@query("A22_register_summary", "SELECT p.ekatte, count(DISTINCT p.parcel_id) AS parcels, count(r.parcel_id) AS rights, count(DISTINCT r.person_id) AS persons FROM parcel p LEFT JOIN rights r USING (parcel_id) WHERE in_register GROUP BY ALL")
def _(spark, d):
    reg = cad.load_registers(cad_lines(spark, d))
    n = reg["parcels"].groupBy("ekatte").agg(F.count(F.lit(1)).alias("parcels"))
    r = reg["rights"].groupBy(keys.ekatte_of(F.col("parcel_id")).alias("ekatte")).agg(F.count(F.lit(1)).alias("rights"), F.countDistinct("person_id").alias("persons"))
    return n.join(r, "ekatte", "left").select("ekatte", "parcels", F.coalesce("rights", F.lit(0)).alias("rights"), F.coalesce("persons", F.lit(0)).alias("persons"))


# --- points, axes, numbering ------------------------------------------------------------------------------------------

EDGE = """edge AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, side ORDER BY x, pole::BIGINT) AS ord FROM (
  SELECT corridor_id, pole_no AS pole, (x0+x1)/2 AS x, (y0+y1)/2 AS y, CASE WHEN (y0+y1)/2 > 200*corridor_id+16+18*(corridor_id%5) THEN 'left' ELSE 'right' END AS side, CAST(pole_no AS BIGINT)%4<>0 AS inside FROM footprint)),
home AS (SELECT e.*, p.ekatte FROM edge e LEFT JOIN parcel p ON x >= p.x0 AND x < p.x1 AND y >= p.y0 AND y < p.y1)"""


def edge(spark: SparkSession, d: str) -> DataFrame:
    """Structure centres as points of a corridor's left or right edge, in order along it."""
    e = la.footprints(spark, d).select("corridor_id", F.col("pole_no").alias("pole"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    e = e.withColumn("side", F.when(F.col("y") > la.base(F.col("corridor_id")) + 6, "left").otherwise("right")).withColumn("inside", F.col("pole").cast("long") % 4 != 0)
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("corridor_id", "side").orderBy("x", F.col("pole").cast("long"))))


def points(spark: SparkSession, d: str) -> DataFrame:
    parcels = la.parcels(spark, d).select("ekatte", F.col("num").alias("shape_ord"), la.ring().alias("ring"))
    met = lines.containing(edge(spark, d), parcels, la.CELL).groupBy("corridor_id", "pole").agg(F.min_by("ekatte", "shape_ord").alias("ekatte"))
    return edge(spark, d).join(met, ["corridor_id", "pole"], "left")


@query("J08_point_settlement", f", {EDGE} SELECT corridor_id, pole, ekatte FROM home WHERE ekatte IS NOT NULL")
def _(spark, d):
    return points(spark, d).where("ekatte is not null").select("corridor_id", "pole", "ekatte")


@query("J09_point_settlements_all", f", {EDGE} SELECT corridor_id, pole, string_agg(DISTINCT ekatte, ',' ORDER BY ekatte) AS ekattes FROM home WHERE ekatte IS NOT NULL GROUP BY ALL")
def _(spark, d):
    parcels = la.parcels(spark, d).select("ekatte", la.ring().alias("ring"))
    return lines.all_settlements(edge(spark, d), parcels, ["corridor_id", "pole"], la.CELL)


@query("J22_axis_length_by_parcel", f", {AXIS} SELECT corridor_id, parcel_id, CAST(metres AS DOUBLE) AS metres FROM axis WHERE metres > 0")
def _(spark, d):
    return route(spark, d).select("corridor_id", "parcel_id", "metres")


@query("J24_locate_on_axis", ", p AS (SELECT corridor_id, pole_no, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM footprint), q AS (SELECT *, greatest(5, least(694, x)) AS c, 200*corridor_id+16+18*(corridor_id%5) AS ay FROM p WHERE corridor_id IN (SELECT corridor_id FROM band)) SELECT corridor_id, pole_no, round(c-5.0, 6) AS station, CASE WHEN sqrt((x-c)*(x-c)+(y-ay)*(y-ay)) <= 1e-6 THEN 0.0 ELSE round(sign(y-ay)*sqrt((x-c)*(x-c)+(y-ay)*(y-ay)), 6) END AS \"offset\" FROM q")
def _(spark, d):
    p = la.footprints(spark, d).select("corridor_id", "pole_no", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    y = F.col("ring")[0]["y"] + 6
    part = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for i, (a, b) in enumerate(((5, 200), (200, 350), (350, 694)))))).alias("s")
    axis = la.corridors(spark, d).select("corridor_id", y.alias("y0"), y.alias("y1"), part).select("corridor_id", "y0", "y1", "s.*")
    return lines.located(p, axis, ["corridor_id"], ["pole_no"]).select("corridor_id", "pole_no", F.round("station", 6).alias("station"), F.round("offset", 6).alias("offset"))


@query("J25_section_poles", "SELECT corridor_id, split_part(parcel_id,'.',1) AS ekatte, count(*) AS poles FROM winner GROUP BY ALL")
def _(spark, d):
    return registers.section_poles(registers.winning_parcels(pieces(spark, d)))


@query("J26_coordinate_register", "SELECT f.corridor_id, f.pole_no, w.parcel_id, (f.x0+f.x1)/2 AS east, (f.y0+f.y1)/2 AS north, f.area_sqm, u.i AS corner, CASE WHEN u.i IN (1,2) THEN f.x0 ELSE f.x1 END AS corner_east, CASE WHEN u.i IN (1,4) THEN f.y0 ELSE f.y1 END AS corner_north FROM footprint f JOIN winner w USING (corridor_id, pole_no), (SELECT unnest([1,2,3,4]) AS i) u")
def _(spark, d):
    w = registers.winning_parcels(pieces(spark, d)).select("corridor_id", "pole_no", "parcel_id")
    f = la.footprints(spark, d).withColumn("ring", la.ring()).withColumn("ring", geometry.clockwise(F.col("ring")))  # the corner with least x and y first, then with the clock
    f = f.select("corridor_id", "pole_no", "area_sqm", "ring").join(w, ["corridor_id", "pole_no"])
    c = geometry.centre(F.col("ring"))
    f = f.select("*", c["x"].alias("east"), c["y"].alias("north")).select("*", F.posexplode("ring").alias("i", "p"))
    return f.select("corridor_id", "pole_no", "parcel_id", "east", "north", "area_sqm", (F.col("i") + 1).alias("corner"), F.col("p.x").alias("corner_east"), F.col("p.y").alias("corner_north"))


@query("O03_number_points", f", {EDGE} SELECT corridor_id, side, pole, CAST(CASE WHEN side = 'left' THEN 5001 ELSE 1 END + ord - 1 AS INTEGER) AS number FROM edge")
def _(spark, d):
    e = edge(spark, d)
    both = lines.numbered(e.where("side = 'left'"), ["corridor_id"], 5001).unionByName(lines.numbered(e.where("side = 'right'"), ["corridor_id"], 1))
    return both.select("corridor_id", "side", "pole", F.col("number").cast("int").alias("number"))


INSIDE = f"{EDGE}, kept AS (SELECT e.*, CAST(5000 + row_number() OVER (PARTITION BY corridor_id, side ORDER BY ord) AS INTEGER) AS number FROM edge e JOIN (SELECT corridor_id, side, min(ord) AS a, max(ord) AS b FROM edge WHERE inside GROUP BY ALL) USING (corridor_id, side) WHERE ord BETWEEN a AND b)"


def inside(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered_inside(edge(spark, d), ["corridor_id", "side"], 5001).withColumn("number", F.col("number").cast("int"))


@query("O04_number_inside", f", {INSIDE} SELECT corridor_id, side, pole, number FROM kept")
def _(spark, d):
    return inside(spark, d).select("corridor_id", "side", "pole", "number")


@query("O05_number_ranges", f", {INSIDE}, runs AS (SELECT corridor_id, side, min(number) AS a, max(number) AS b FROM (SELECT *, number - row_number() OVER (PARTITION BY corridor_id, side ORDER BY number) AS i FROM kept WHERE inside) GROUP BY corridor_id, side, i) SELECT corridor_id, side, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM runs GROUP BY ALL")
def _(spark, d):
    return lines.number_ranges(inside(spark, d).where("inside"), ["corridor_id", "side"])


@query("J18_pair_edges", f", {INSIDE} SELECT coalesce(l.corridor_id, r.corridor_id) AS corridor_id, coalesce(l.i, r.i) AS row_ord, l.number AS left_number, l.x AS left_x, l.y AS left_y, r.number AS right_number, r.x AS right_x, r.y AS right_y FROM (SELECT *, row_number() OVER (PARTITION BY corridor_id ORDER BY number) AS i FROM kept WHERE side='left') l FULL JOIN (SELECT *, row_number() OVER (PARTITION BY corridor_id ORDER BY number) AS i FROM kept WHERE side='right') r ON l.corridor_id=r.corridor_id AND l.i=r.i")
def _(spark, d):
    e = inside(spark, d)
    return lines.paired_edges(e.where("side = 'left'"), e.where("side = 'right'"), ["corridor_id"])


@query("A12_route_order", f", {EDGE} SELECT corridor_id, ekatte, min(round(place, 9)) AS place FROM (SELECT *, (ord-1)/greatest(count(*) OVER (PARTITION BY corridor_id, side)-1, 1) AS place FROM home) WHERE ekatte IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return lines.route_order(points(spark, d), ["corridor_id", "side"]).select("corridor_id", "ekatte", F.round("place", 9).alias("place"))


@query("O16_stations", f", {EDGE} SELECT corridor_id, side, pole, round(coalesce(sum(len) OVER (PARTITION BY corridor_id, side ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS station FROM (SELECT *, sqrt((lead(x) OVER w-x)*(lead(x) OVER w-x)+(lead(y) OVER w-y)*(lead(y) OVER w-y)) AS len FROM edge WINDOW w AS (PARTITION BY corridor_id, side ORDER BY ord))")
def _(spark, d):
    w = Window.partitionBy("corridor_id", "side").orderBy("ord")
    s = edge(spark, d).select("*", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).withColumnsRenamed({"x": "x0", "y": "y0"})
    return lines.stations(s, ["corridor_id", "side"]).select("corridor_id", "side", "pole", F.round("station", 6).alias("station"))


@query("O11_route_sort", "SELECT corridor_id, ekatte, dense_rank() OVER (PARTITION BY corridor_id ORDER BY lowest NULLS LAST, ekatte) AS place FROM (SELECT DISTINCT corridor_id, ekatte FROM areas) LEFT JOIN (SELECT corridor_id, split_part(parcel_id,'.',1) AS ekatte, min(pole_no::BIGINT) AS lowest FROM piece GROUP BY ALL) USING (corridor_id, ekatte)")
def _(spark, d):
    cut = saved(pieces(spark, d), "pieces")
    return registers.route_sort(areas(spark, d, cut), cut)


@query("J17_group_by_municipality", "SELECT corridor_id, coalesce(municipality, 'Неизвестна община') AS municipality, coalesce(province, '') AS province, count(DISTINCT ekatte) AS settlements, count(*) AS parcels FROM areas LEFT JOIN (SELECT * FROM settlement WHERE ekatte <> '00003') s USING (ekatte) GROUP BY ALL")
def _(spark, d):
    return registers.municipality_groups(areas(spark, d), la.settlements(spark, d).where("ekatte <> '00003'"))


@query("J20_dedup_structures", "SELECT corridor_id, pole_no, area_sqm, CAST(unnest(CASE WHEN CAST(pole_no AS BIGINT)%3=0 THEN [0, 2] ELSE [0] END) AS INTEGER) AS take FROM footprint")
def _(spark, d):
    """Every third structure is drawn three times, each time 8 mm further on: the second repeats the first, and the third only the second. On whole metres such corners lie on both sides of a line between cells."""
    f = la.footprints(spark, d)
    moved = lambda i: f.select("corridor_id", "pole_no", *((F.col(c) + 0.008 * i - 0.004).alias(c) for c in ("x0", "y0", "x1", "y1")), "area_sqm", F.lit(i).alias("take"))
    third = F.col("pole_no").cast("long") % 3 == 0
    all_ = moved(0).unionByName(moved(1).where(third)).unionByName(moved(2).where(third))
    return duplicates.dedup_structures(all_, ["corridor_id", "pole_no"]).select("corridor_id", "pole_no", "area_sqm", "take")


SHIFTED = "SELECT num, d, (x1-x0)*(y1-y0) AS a, (x1-x0)*(y1-y0) + d AS b, (x1-x0)*(y1-y0)*(1 - d) AS s FROM (SELECT *, (num%5)*0.004 AS d FROM parcel)"


@query("P10_is_duplicate_shape", f", s AS ({SHIFTED}) SELECT num, abs(a-b) < 0.01 AND s >= 0.99*least(a, b) AS same FROM s")
def _(spark, d):
    size, more = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("num") % 5) * 0.004
    p = la.parcels(spark, d).select("num", size.alias("a"), (size + more).alias("b"), (size * (1 - more)).alias("s"))
    return p.select("num", duplicates.is_duplicate_shape(F.col("a"), F.col("b"), F.col("s")).alias("same"))


@query("P11_same_footprint", "SELECT pole_no, CAST(pole_no AS BIGINT)%5 <= 2 AS same FROM footprint")
def _(spark, d):
    f, more = la.footprints(spark, d), (F.col("pole_no").cast("long") % 5) * 0.0045
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return f.select("pole_no", lines.same_footprint(F.col("area_sqm"), F.col("area_sqm") + more / 2, box, [box[0], box[1], box[2] + more, box[3]]).alias("same"))


@query("F22_corners_match", "SELECT pole_no, CAST(pole_no AS BIGINT)%4 < 3 AS same FROM footprint")
def _(spark, d):
    """The corners, turned about and each moved by 0, 4, 8 or 12 mm, against the outline."""
    more = (F.col("pole_no").cast("long") % 4) * 0.004
    moved = F.transform(F.reverse(la.ring()), lambda p: p.withField("x", p["x"] + more))
    return la.footprints(spark, d).select("pole_no", geometry.corners_match(moved, la.ring()).alias("same"))


@query("P01_closed_shapes", "SELECT pole_no FROM footprint WHERE CAST(pole_no AS BIGINT)%3 <> 2")
def _(spark, d):
    k = F.col("pole_no").cast("long") % 3
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    near = F.when(k == 1, F.col("x0") + 0.005).otherwise(F.col("x0") + 1)
    verts = F.array(at(F.col("x0"), F.col("y0")), at(F.col("x1"), F.col("y0")), at(F.col("x1"), F.col("y1")), at(near, F.col("y0")))
    return lines.closed_shapes(la.footprints(spark, d).select("pole_no", (k == 0).alias("closed"), verts.alias("verts"))).select("pole_no")


@query("P02_exclude_own_layers", "SELECT parcel_id FROM parcel WHERE num%5 <> 0")
def _(spark, d):
    layer = F.when(F.col("num") % 5 == 0, F.lit("Servitude_Points")).otherwise(F.lit("cadaster"))
    return lines.exclude_layers(la.parcels(spark, d).select("parcel_id", layer.alias("layer"))).select("parcel_id")


@query("P03_resolve_shape_id", "SELECT num, CASE WHEN num%4=0 THEN upper(to_hex(num)) ELSE parcel_id END AS id FROM parcel")
def _(spark, d):
    xdata = F.when(F.col("num") % 4 == 0, F.lit(" ")).otherwise(F.col("parcel_id"))
    return la.parcels(spark, d).select("num", lines.resolved_id(xdata, F.hex("num")).alias("id"))


@query("P05_exclude_marker_blocks", "SELECT pole_no FROM footprint WHERE CAST(pole_no AS BIGINT)%5 NOT IN (1, 2)")
def _(spark, d):
    k = F.col("pole_no").cast("long") % 5
    named = la.footprints(spark, d).select("pole_no", F.when(k == 1, F.lit(" gbp032 ")).when(k == 2, F.lit("Serv_Tochka")).otherwise(F.lit("STALB")).alias("block_name"))
    return lines.exclude_markers(named).select("pole_no")


@query("P07_has_settlement", "SELECT num, num%6 <> 0 AS has FROM parcel")
def _(spark, d):
    p = la.parcels(spark, d).select("num", F.when(F.col("num") % 6 == 0, F.replace("parcel_id", F.lit("."), F.lit("-"))).otherwise(F.col("parcel_id")).alias("id"))
    return p.select("num", keys.has_settlement(F.col("id")).alias("has"))


@query("P09_box_may_overlap", "SELECT f.pole_no, p.parcel_id FROM footprint f JOIN parcel p ON f.x0 <= p.x1+0.01 AND p.x0 <= f.x1+0.01 AND f.y0 <= p.y1+0.01 AND p.y0 <= f.y1+0.01")
def _(spark, d):
    return lines.touching_boxes(la.footprints(spark, d), la.parcels(spark, d), "pole_no", "parcel_id", la.CELL)


@query("F07_pole_numbers", "SELECT pole_no, 'Стълб №' || pole_no AS label, pole_no AS stripped, CAST(pole_no AS BIGINT) AS number FROM footprint")
def _(spark, d):
    label = F.concat(F.lit("Стълб №"), F.col("pole_no"))
    return la.footprints(spark, d).select("pole_no", label.alias("label"), keys.strip_pole_prefix(label).alias("stripped"), keys.pole_number(F.lower(label)).alias("number"))


@query("F14_balance_group", f"SELECT parcel_id, CASE WHEN NOT in_register THEN 3 WHEN kat='0' THEN 2 ELSE 0 END AS class, CASE WHEN in_register AND kat<>'0' THEN CAST(kat AS BIGINT) ELSE 0 END AS number, CASE WHEN NOT in_register THEN 'Няма данни в .cad' WHEN kat='0' THEN 'Без категория' ELSE {ROMAN} || ' категория' END AS text FROM parcel")
def _(spark, d):
    g = balances.balance_group(F.col("kat"), F.col("in_register"), category=True)
    return la.parcels(spark, d).select("parcel_id", g.alias("g")).select("parcel_id", "g.class", "g.number", "g.text")


@query("F16_signed_area", "SELECT parcel_id, (x1-x0)*(y1-y0) AS ccw, -(x1-x0)*(y1-y0) AS cw FROM parcel")
def _(spark, d):
    return la.parcels(spark, d).select("parcel_id", geometry.signed_area(la.ring()).alias("ccw"), geometry.signed_area(geometry.clockwise(la.ring())).alias("cw"))


@query("A16_centroid", "SELECT parcel_id, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, x0 AS minx, y1 AS maxy FROM parcel")
def _(spark, d):
    c, b = geometry.centre(la.ring()), geometry.box(la.ring())
    return la.parcels(spark, d).select("parcel_id", c["x"].alias("cx"), c["y"].alias("cy"), b["x0"].alias("minx"), b["y1"].alias("maxy"))


@query("T05_ccw_corners", "SELECT parcel_id, u.i AS corner, CASE WHEN u.i IN (1,4) THEN x0 ELSE x1 END AS x, CASE WHEN u.i IN (1,2) THEN y0 ELSE y1 END AS y FROM parcel, (SELECT unnest([1,2,3,4]) AS i) u")
def _(spark, d):
    return la.parcels(spark, d).select("parcel_id", F.posexplode(geometry.by_angle(F.shuffle(la.ring()))).alias("i", "p")).select("parcel_id", (F.col("i") + 1).alias("corner"), "p.x", "p.y")


@query("F19_arc_length", "SELECT pole_no, round(pi()/2*(x1-x0), 6) AS half, round(4*atan(0.5)*(x1-x0)/(2*sin(2*atan(0.5))), 6) AS flat, x1-x0 AS straight FROM footprint")
def _(spark, d):
    chord = F.col("x1") - F.col("x0")
    return la.footprints(spark, d).select("pole_no", F.round(geometry.arc_length(chord, F.lit(1.0)), 6).alias("half"), F.round(geometry.arc_length(chord, F.lit(0.5)), 6).alias("flat"), geometry.arc_length(chord, F.lit(0.0)).alias("straight"))


@query("F23_decimal_places", "SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 2 ELSE 0 END AS places FROM part", lattice=False)
def _(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("decimal(18,2)").cast("string")).otherwise(F.col("p_partkey").cast("string"))
    return la.t(spark, d, "part").select("p_partkey", geometry.decimal_places(text).alias("places"))


@query("P14_balance_check", "SELECT corridor_id, parcel_id, gross_sqm, pole_sqm, CASE WHEN abs(gross_sqm - (net_sqm + pole_sqm)) <= 0.001 THEN 'ОК' ELSE 'ГРЕШКА' END AS check_text FROM (SELECT corridor_id, parcel_id, CAST(gross_sqm AS DOUBLE) AS gross_sqm, coalesce(p, 0.0) AS pole_sqm, greatest(gross_sqm - coalesce(p, 0.0), 0.0) AS net_sqm FROM areas LEFT JOIN (SELECT corridor_id, parcel_id, sum(piece_sqm) AS p FROM piece GROUP BY ALL) USING (corridor_id, parcel_id))")
def _(spark, d):
    cut = saved(pieces(spark, d), "pieces")
    return registers.balance_check(areas(spark, d, cut), cut)


# --- code lists, legacy tables, nearest shapes ------------------------------------------------------------------------


@query("S15_scan_code_list", "SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name || '; \"x\"' AS text FROM region", lattice=False)
def _(spark, d):
    r = la.t(spark, d, "region")
    code = F.concat(F.lit("00"), F.col("r_regionkey").cast("string"))
    row = lambda no, v: r.select((F.col("r_regionkey") * 10 + no).alias("line_no"), v.alias("value"))
    lines_ = row(0, F.lit("# code;text")).unionByName(row(1, F.concat(code, F.lit(";"), F.col("r_name"), F.lit('; "x"')))).unionByName(row(2, F.concat(code, F.lit(";again")))).unionByName(row(3, F.lit("code;text"))).unionByName(row(4, F.lit("  ")))
    return codes.code_list(lines_)


@query("S16_overlay_defaults", "SELECT n_nationkey AS code, CASE WHEN n_nationkey%3=0 THEN 'own' ELSE n_name END AS text FROM nation", lattice=False)
def _(spark, d):
    n = la.t(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("text"))
    return codes.overlaid(n, n.where("code % 3 = 0").withColumn("text", F.lit("own")))


@query("S17_scan_settlements", "SELECT * FROM settlement")
def _(spark, d):
    s = la.settlements(spark, d)
    text = lambda no, name: s.select((F.col("ekatte").cast("long") * 10 + no).alias("line_no"), F.concat_ws(";", "ekatte", "kind", name, "municipality", "province").alias("value"))
    bad = s.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(";", F.lit("x1"), "kind", "name", "municipality", "province").alias("value"))
    return codes.settlement_list(text(1, F.lit("old")).unionByName(text(2, F.col("name"))).unionByName(bad))


MATH = """three AS (SELECT f.corridor_id, p.parcel_id, greatest(f.x0,p.x0) AS x0, least(f.x1,p.x1) AS x1, greatest(f.y0,p.y0) AS y0, least(f.y1,p.y1) AS y1 FROM footprint f JOIN parcel p ON f.x0<p.x1 AND f.x1>p.x0 AND f.y0<p.y1 AND f.y1>p.y0),
covered AS (SELECT corridor_id, parcel_id, sum(h+v-hv) AS sqm, sum((x1-x0)*(y1-y0)) AS pole FROM (SELECT *, greatest(0, least(x1,700)-greatest(x0,5))*greatest(0, least(y1,b+12)-greatest(y0,b)) AS h,
    greatest(0, least(x1,700)-greatest(x0,688))*greatest(0, least(y1,200*corridor_id+110)-greatest(y0,b)) AS v, greatest(0, least(x1,700)-greatest(x0,688))*greatest(0, least(y1,b+12)-greatest(y0,b)) AS hv FROM three LEFT JOIN band USING (corridor_id)) GROUP BY ALL)"""


@query("J03_math_test_areas", f", {MATH} SELECT corridor_id, parcel_id, CAST(drawn_sqm AS DOUBLE) AS area_sqm, CAST(gross_sqm AS DOUBLE) AS gross_sqm, CAST(gross_sqm - coalesce(sqm, 0) AS DOUBLE) AS net_sqm, CAST(coalesce(pole, 0) AS DOUBLE) AS pole_sqm, CAST(greatest(drawn_sqm - (gross_sqm - coalesce(sqm, 0)) - coalesce(pole, 0), 0) AS DOUBLE) AS remainder_sqm FROM areas LEFT JOIN covered USING (corridor_id, parcel_id)")
def _(spark, d):
    part = overlay.box_parts(la.footprints(spark, d), la.parcels(spark, d), ["corridor_id", "pole_no"], ["parcel_id"], la.CELL)
    inside = overlay.overlap_areas(la.corridors(spark, d), part.select("corridor_id", "parcel_id", "pole_no", la.ring().alias("ring")), [], ["parcel_id", "pole_no"], ["corridor_id"], la.CELL)
    inside = inside.groupBy("corridor_id", "parcel_id").agg(F.sum("sqm").alias("in_sqm"))
    pole = part.groupBy("corridor_id", "parcel_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("pole_sqm"))
    rows = areas(spark, d).join(inside, ["corridor_id", "parcel_id"], "left").join(pole, ["corridor_id", "parcel_id"], "left")
    net, poles = F.round(F.col("gross_sqm") - F.coalesce("in_sqm", F.lit(0.0)), 6), F.coalesce("pole_sqm", F.lit(0.0))
    return rows.select("corridor_id", "parcel_id", F.col("drawn_sqm").alias("area_sqm"), "gross_sqm", net.alias("net_sqm"), poles.alias("pole_sqm"), F.greatest(F.round(F.col("drawn_sqm") - net - poles, 6), F.lit(0.0)).alias("remainder_sqm"))


@query("J07_nearest_centroid_match", "SELECT pole_no, parcel_id, round(dist, 6) AS dist FROM (SELECT f.pole_no, p.parcel_id, sqrt(pow((f.x0+f.x1)/2-(p.x0+p.x1)/2, 2)+pow((f.y0+f.y1)/2-(p.y0+p.y1)/2, 2)) AS dist, row_number() OVER (PARTITION BY f.pole_no ORDER BY sqrt(pow((f.x0+f.x1)/2-(p.x0+p.x1)/2, 2)+pow((f.y0+f.y1)/2-(p.y0+p.y1)/2, 2)), p.num) AS rn FROM footprint f JOIN parcel p ON abs((f.x0+f.x1)/2-(p.x0+p.x1)/2) < 50 AND abs((f.y0+f.y1)/2-(p.y0+p.y1)/2) < 50 WHERE least(10*f.area_sqm, (p.x1-p.x0)*(p.y1-p.y0)) >= 0.5*greatest(10*f.area_sqm, (p.x1-p.x0)*(p.y1-p.y0))) WHERE rn = 1 AND dist < 50")
def _(spark, d):
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    p = la.footprints(spark, d).select("pole_no", mid("x0", "x1").alias("x"), mid("y0", "y1").alias("y"), (10 * F.col("area_sqm")).alias("area"))
    t = la.parcels(spark, d).select(F.col("parcel_id").alias("target"), F.col("num").alias("ord"), mid("x0", "x1").alias("x"), mid("y0", "y1").alias("y"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return shapes.nearest_centroid(p, t, ["pole_no"]).select("pole_no", F.col("target").alias("parcel_id"), F.round("dist", 6).alias("dist"))


@query("J11_distance_to_settlement", "SELECT pole_no, ekatte, round(min(dist), 6) AS dist FROM (SELECT pole_no, ekatte, sqrt(pow(greatest(p.x0-x, 0, x-p.x1), 2)+pow(greatest(p.y0-y, 0, y-p.y1), 2)) AS dist FROM (SELECT pole_no, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM footprint) f JOIN parcel p ON x BETWEEN p.x0-30 AND p.x1+30 AND y BETWEEN p.y0-30 AND p.y1+30) WHERE dist <= 30 GROUP BY ALL")
def _(spark, d):
    p = edge(spark, d).select(F.col("pole").alias("pole_no"), "x", "y")
    return shapes.distance_to_settlements(p, la.parcels(spark, d).select("ekatte", la.ring().alias("ring")), ["pole_no"], 30.0).select("pole_no", "ekatte", F.round("dist", 6).alias("dist"))


@query(
    "J19_dedup_shapes",
    """, h AS (SELECT parcel_id, num, unnest(range(0, 4)) AS k FROM parcel WHERE num%3 < 2)
SELECT parcel_id, printf('%X', 4*num+k+1) AS handle, CASE WHEN num%3=0 AND k IN (1, 2) THEN printf('%X', 4*num+1) WHEN num%3=1 AND k=1 THEN printf('%X', 4*num+1) WHEN num%3=1 AND k=3 THEN printf('%X', 4*num+3) END AS kept_handle, num%3=0 AND k=3 AS partly FROM h""",
)
def _(spark, d):
    """Of every third parcel three shapes with the same outline, one of them begun at another corner, and one moved by 5 m; of the next a chain of four, 0.9 % of their width apart: each repeats the one before it, not the one before that."""
    p = la.parcels(spark, d).where("num % 3 < 2").withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    step = F.when(F.col("num") % 3 == 1, F.col("k") * 0.18).when(F.col("k") == 3, 5.0).otherwise(0.0)
    ring = la.ring()
    turned = F.when(F.col("k") == 2, F.concat(F.slice(ring, 2, 3), F.slice(ring, 1, 1))).otherwise(ring)
    moved = p.select("parcel_id", F.hex(4 * F.col("num") + F.col("k") + 1).alias("handle"), F.col("num"), "k", *((F.col(c) + step).alias(c) for c in ("x0", "x1")), "y0", "y1")
    s = moved.select("parcel_id", "handle", turned.alias("ring")).withColumn("area", F.round(F.abs(geometry.signed_area(F.col("ring"))), 6))
    out = duplicates.dedup_shapes(s, la.CELL)
    # Neighbours of a chain share much without being the same; that is shown for the others.
    three = F.element_at(F.split("parcel_id", r"[.]"), -1).cast("long") % 3
    return out.withColumn("partly", F.col("partly") & (three == 0))


@query("O06_merge_close_points", f", {EDGE} SELECT corridor_id, side, pole, 'a,b' AS ekattes FROM edge")
def _(spark, d):
    e = edge(spark, d).select("corridor_id", "side", "pole", "x", "y", (2 * F.col("ord")).alias("ord"), F.array(F.lit("b")).alias("ekattes"))
    again = e.select("corridor_id", "side", "pole", (F.col("x") + 0.005).alias("x"), "y", (F.col("ord") + 1).alias("ord"), F.array(F.lit("a")).alias("ekattes"))
    return shapes.merged_close(e.unionByName(again), ["corridor_id", "side"]).select("corridor_id", "side", "pole", F.array_join("ekattes", ",").alias("ekattes"))


LEGACY = "raw AS (SELECT a.corridor_id, a.parcel_id, a.ekatte, a.drawn_sqm, a.gross_sqm, coalesce(s.q, 0) AS pole_sqm, coalesce(nullif(p.vidt, ''), '(без вид)') AS territory, coalesce(nullif(p.vids, ''), '(без собственост)') AS ownership FROM areas a JOIN parcel p USING (parcel_id) LEFT JOIN (SELECT corridor_id, parcel_id, sum(piece_sqm) AS q FROM piece GROUP BY ALL) s USING (corridor_id, parcel_id))"


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    cut = saved(pieces(spark, d), "pieces")
    return saved(balances.legacy_rows(areas(spark, d, cut), cut, la.parcels(spark, d)), "legacy")


def once(c: str) -> str:
    return f"CAST(round(CAST(sum({c}) AS DECIMAL(24,6))*0.001, 3) AS DOUBLE)"


ONCE = f"count(*) AS parcels, {once('drawn_sqm')} AS area_dka, {once('gross_sqm')} AS gross_dka, {once('pole_sqm')} AS step_dka"


@query("A18_legacy_balances", f", {LEGACY} SELECT corridor_id, 0 AS table_ord, territory AS \"group\", {ONCE} FROM raw GROUP BY ALL UNION ALL SELECT corridor_id, 1, ownership, {ONCE} FROM raw GROUP BY corridor_id, ownership")
def _(spark, d):
    return balances.legacy_balances(raw_rows(spark, d))


@query("A19_legacy_settlement_balance", f", {LEGACY} SELECT corridor_id, ekatte, {ONCE} FROM raw GROUP BY GROUPING SETS ((corridor_id, ekatte), (corridor_id))")
def _(spark, d):
    return balances.legacy_totals(raw_rows(spark, d), "ekatte")


@query("A20_legacy_recap", f", {LEGACY} SELECT corridor_id, territory, {ONCE} FROM raw GROUP BY GROUPING SETS ((corridor_id, territory), (corridor_id))")
def _(spark, d):
    return balances.legacy_totals(raw_rows(spark, d), "territory")


@query("J21_legacy_merge_rows", "SELECT k.corridor_id, k.parcel_id, CASE WHEN p.in_register THEN p.vidt ELSE 'NO DATA' END AS territory, coalesce(s.poles, 0) AS poles, CAST(coalesce(g.gross_sqm, 0) AS DOUBLE) AS gross_sqm FROM (SELECT corridor_id, parcel_id FROM gross UNION SELECT corridor_id, parcel_id FROM piece) k JOIN parcel p USING (parcel_id) LEFT JOIN (SELECT corridor_id, parcel_id, count(*) AS poles FROM piece GROUP BY ALL) s USING (corridor_id, parcel_id) LEFT JOIN gross g USING (corridor_id, parcel_id)")
def _(spark, d):
    return registers.merged_rows(gross(spark, d), pieces(spark, d), registered(spark, d).select("parcel_id", "vidt"))


@query("V02_verify_combined", "SELECT corridor_id, '' AS province, '' AS municipality, 0 AS table_ord FROM body WHERE false")
def _(spark, d):
    bal, s = balance(spark, d), la.settlements(spark, d)
    return balances.unequal_combined(bal, balances.municipality_balance(bal, s), s)


@query("U03_shared_settlement", f", {EDGE} SELECT a.corridor_id, a.pole, coalesce(a.ekatte = b.ekatte, false) AS shared FROM home a JOIN home b ON a.corridor_id=b.corridor_id AND a.side=b.side AND b.ord=a.ord+1")
def _(spark, d):
    p = points(spark, d).withColumn("ekattes", F.array_compact(F.array("ekatte")))
    w = Window.partitionBy("corridor_id", "side").orderBy("ord")
    return p.select("corridor_id", "pole", F.arrays_overlap("ekattes", F.lead("ekattes").over(w)).alias("shared")).where("shared is not null")


@query("F25_angles", "SELECT pole_no, round(CASE WHEN atan2(y0, x0) < 0 THEN atan2(y0, x0)+2*pi() ELSE atan2(y0, x0) END, 9) AS normal, round(atan2(sin(atan2(y0, x0))+sin(atan2(y1, x1)), cos(atan2(y0, x0))+cos(atan2(y1, x1))), 9) AS bisector FROM footprint")
def _(spark, d):
    a, b = F.atan2("y0", "x0"), F.atan2("y1", "x1")
    return la.footprints(spark, d).select("pole_no", F.round(geometry.normal_angle(a), 9).alias("normal"), F.round(geometry.bisector(a, b), 9).alias("bisector"))


@query("F27_vertex_labels", "SELECT parcel_id, u.i AS vertex, num || '-' || u.i AS label FROM parcel, (SELECT unnest([1,2,3,4]) AS i) u")
def _(spark, d):
    v = la.parcels(spark, d).select("parcel_id", "num", F.posexplode(la.ring()).alias("i", "p"))
    return v.select("parcel_id", (F.col("i") + 1).alias("vertex"), F.concat_ws("-", F.col("num").cast("string"), (F.col("i") + 1).cast("string")).alias("label"))


@query("S18_scan_flat_register", "SELECT parcel_id, vids AS owner, ekatte, area_sqm, '' AS subdivision, CASE WHEN num%2=0 THEN vidt ELSE '' END AS territory FROM parcel")
def _(spark, d):
    p = la.parcels(spark, d)
    area = F.col("area_sqm").cast("decimal(18,2)").cast("string")
    short, long = [F.col("parcel_id"), F.col("vids"), F.col("ekatte"), area], [F.lit(""), F.col("vidt")]
    value = F.when(F.col("num") % 2 == 0, F.concat_ws(";", *short, *long)).otherwise(F.concat_ws("\t", *short))
    rows = p.select(F.col("num").alias("line_no"), value.alias("value")).unionByName(p.select((F.col("num") + 10**9).alias("line_no"), F.concat_ws(",", *short[:3], F.lit("7")).alias("value")))
    rows = rows.unionByName(p.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(",", *short[:3], F.lit("bad")).alias("value")))
    return flat.flat_register(rows).select("parcel_id", "owner", "ekatte", "area_sqm", "subdivision", "territory")


def features(spark: SparkSession, d: str) -> DataFrame:
    p = la.parcels(spark, d)
    name = flat.PROPERTIES
    props = F.struct(
        keys.parcel_label(F.col("parcel_id")).alias(name["ident"]), F.concat(F.col("ekatte"), F.lit(" - гр. Пример")).alias(name["place"]), F.col("area_sqm").cast("decimal(18,2)").cast("string").alias(name["area"]),
        F.when(F.col("num") % 2 == 0, F.concat(F.lit('[{"person_name":"'), F.col("vids"), F.lit('"}]'))).otherwise(F.lit("no json")).alias(name["rights"]), F.col("ntp").alias(name["tenant"]), F.col("vidt").alias(name["territory"]),
    )
    at = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    geo = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return p.select(F.col("num").alias("ord"), F.to_json(F.struct(props.alias("properties"), geo.alias("geometry"))).alias("feature"))


@query("S19_scan_geojson_attrs", "SELECT parcel_id, ekatte, area_sqm, CASE WHEN num%2=0 THEN vids ELSE ntp END AS owner, vidt AS territory FROM parcel")
def _(spark, d):
    return flat.geojson_attributes(features(spark, d)).select("parcel_id", "ekatte", "area_sqm", "owner", "territory")


@query("S20_scan_geojson_centroids", "SELECT parcel_id, (3*x0+2*x1)/5 AS x, (3*y0+2*y1)/5 AS y, area_sqm FROM parcel")
def _(spark, d):
    return flat.geojson_centroids(features(spark, d))


PARTS = f"""{AXIS}, cut AS (SELECT DISTINCT a.corridor_id, m FROM axis a JOIN parcel p USING (parcel_id), unnest([greatest(p.x0, 5)-5, least(p.x1, 694)-5]) AS u(m) WHERE a.metres > 0),
bound AS (SELECT corridor_id, m AS a, lead(m) OVER (PARTITION BY corridor_id ORDER BY m) AS b FROM (SELECT corridor_id, m FROM cut UNION SELECT corridor_id, 0 FROM band UNION SELECT corridor_id, 689 FROM band)),
part_ AS (SELECT b.corridor_id, b.a, b.b, p.ekatte FROM bound b LEFT JOIN parcel p ON gy//10 = corridor_id AND p.y0 < 200*corridor_id+16+18*(corridor_id%5) AND p.y1 > 200*corridor_id+16+18*(corridor_id%5) AND p.x0 <= (a+b)/2+5 AND p.x1 > (a+b)/2+5 WHERE b.b IS NOT NULL),
seq AS (SELECT *, lag(ekatte) OVER w AS f, coalesce(lag(b) OVER w, 0) AS upto FROM part_ WHERE ekatte IS NOT NULL WINDOW w AS (PARTITION BY corridor_id ORDER BY a))"""


@query("O08_boundary_crossings", f", {PARTS} SELECT s.corridor_id, CAST(upto AS DOUBLE) AS \"at\", f AS from_ekatte, ekatte AS to_ekatte, greatest(count(c.m), 1) AS merged_hits, CAST(coalesce(max(c.m)-min(c.m), 0) AS DOUBLE) AS span FROM seq s LEFT JOIN cut c ON c.corridor_id=s.corridor_id AND c.m BETWEEN upto-0.5 AND a+0.5 WHERE f <> ekatte GROUP BY s.corridor_id, upto, a, f, ekatte")
def _(spark, d):
    key = ["corridor_id", "ord"]
    hits = edges.boundary_hits(axis(spark, d), ringed(spark, d), key, la.CELL)
    pieces = edges.classified_pieces(axis(spark, d), hits, ringed(spark, d), key, "ekatte", la.CELL)
    metres = lambda c: F.round(F.col(c) * F.col("length"), 6)
    cuts = hits.select("corridor_id", F.explode("cuts").alias("t")).select("corridor_id", F.round(F.col("t") * 689.0, 6).alias("m"))
    parts = pieces.select("corridor_id", metres("a").alias("a"), metres("b").alias("b"), "ekatte", F.lit(None).cast("string").alias("start_ekatte"))
    return lines.boundary_crossings(parts, cuts, ["corridor_id"]).drop("middle")


@query("O10_split_parameters", f", {PARTS}, inner_ AS (SELECT corridor_id, m FROM cut WHERE m > 0.0000001 AND m < 689-0.0000001) SELECT corridor_id, string_agg(CAST(CAST(m AS INTEGER) AS VARCHAR), ',' ORDER BY m) AS cuts FROM inner_ GROUP BY ALL")
def _(spark, d):
    r = route(spark, d).join(la.parcels(spark, d).select("parcel_id", "x0", "x1"), "parcel_id")
    cuts = r.select("corridor_id", F.explode(F.array(F.greatest("x0", F.lit(5.0)) - 5, F.least("x1", F.lit(694.0)) - 5, F.col("x0") - 5 + 5e-8)).alias("m"))
    kept = cuts.groupBy("corridor_id").agg(lines.split_parameters(F.collect_list("m"), 0.0, 689.0).alias("kept"))
    return kept.select("corridor_id", F.array_join(F.transform("kept", lambda m: m.cast("int").cast("string")), ",").alias("cuts"))


from wayleave.plans import drawn, files, routes, small  # noqa: E402, F401  registers the queries of these modules too
