"""Territory balances, their sums by municipality, the recapitulation, and the checks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.functions.units import DKA, percent, roman_category, sqm_to_dka, to_km

TABLES = ["category", "ownership", "territory", "land use"]
SUMS = ["parcels", "area_dka", "restricted_dka", "poles", "step_dka", "affected_dka"]
NOT_FOUND, NO_CATEGORY, NO_CODE = "Няма данни в .cad", "Без категория", "Без код"


def balance_group(code: Column, found: Column, category: bool = False) -> Column:
    """(class, number, key, text): 0 numeric code, 1 other code, 2 no code, 3 not in the register."""
    c = F.trim(F.coalesce(code, F.lit("")))
    n = F.when(F.regexp_like(c, F.lit("^[0-9]+$")), c.try_cast("bigint"))
    empty = roman_category(c) == "" if category else c == ""
    text = F.concat(roman_category(c), F.lit(" категория")) if category else c
    none = F.lit(NO_CATEGORY if category else NO_CODE)
    group = lambda k, number, key, said: F.struct(F.lit(k).alias("class"), number.cast("bigint").alias("number"), key.alias("key"), said.alias("text"))
    return F.when(~found, group(3, F.lit(0), F.lit(NOT_FOUND), F.lit(NOT_FOUND))).when(empty, group(2, F.lit(0), none, none)).when(n.isNotNull(), group(0, n, n.cast("string"), text)).otherwise(group(1, F.lit(0), c, text))


def territory_balance(body: DataFrame) -> DataFrame:
    """Four tables for each corridor and settlement, from one pass over the register: groups in order, then the total (row_kind)."""
    found = F.col("found")
    groups = F.array(*(F.struct(F.lit(i).alias("table_ord"), balance_group(F.col(c), found, c == "kat").alias("g")) for i, c in enumerate(("kat", "vids", "vidt", "ntp"))))
    step = F.coalesce("step_dka", F.lit(0).cast(DKA))
    rows = body.select("corridor_id", "ekatte", "area_dka", "restricted_dka", step.alias("step_dka"), "poles", F.explode(groups).alias("t"))
    rows = rows.select("*", "t.table_ord", "t.g.class", "t.g.number", "t.g.key", F.col("t.g.text").alias("group")).drop("t")
    sums = rows.groupBy("corridor_id", "ekatte", "table_ord", "class", "number", "key").agg(F.min("group").alias("group"), *_sums(F.count(F.lit(1))))
    return _finished(sums, ["corridor_id", "ekatte"])


def _sums(parcels: Column) -> list[Column]:
    return [parcels.alias("parcels"), F.sum("area_dka").alias("area_dka"), F.sum("restricted_dka").alias("restricted_dka"), F.sum("poles").alias("poles"), F.sum("step_dka").alias("step_dka"), (F.sum("restricted_dka") + F.sum("step_dka")).alias("affected_dka")]


def _finished(sums: DataFrame, section: list[str]) -> DataFrame:
    """Numbers, totals and percents of tables that are grouped already. Groups are few, whatever the number of parcels."""
    table = Window.partitionBy(*section, "table_ord")
    body = sums.withColumn("no", F.row_number().over(table.orderBy("class", "number", "key"))).withColumn("percent", percent(F.col("affected_dka"), F.sum("affected_dka").over(table))).withColumn("row_kind", F.lit("group"))
    total = sums.groupBy(*section, "table_ord").agg(*_sums(F.sum("parcels")))
    total = total.withColumn("percent", F.when(F.col("affected_dka") != 0, F.lit(100).cast("decimal(9,2)"))).withColumn("group", F.lit("Общо")).withColumn("row_kind", F.lit("total"))
    return body.unionByName(total, allowMissingColumns=True)


def municipality_balance(balance: DataFrame, settlements: DataFrame) -> DataFrame:
    """The settlements' tables of each municipality added up; percents anew."""
    rows = balance.where("row_kind = 'group'").join(settlements.select("ekatte", "municipality", "province"), "ekatte", "left")
    rows = rows.withColumn("municipality", F.coalesce("municipality", F.lit("Неизвестна община"))).withColumn("province", F.coalesce("province", F.lit("")))
    section = ["corridor_id", "province", "municipality"]
    sums = rows.groupBy(*section, "table_ord", "class", "number", "key").agg(F.min("group").alias("group"), *_sums(F.sum("parcels")))
    return _finished(sums, section)


def recapitulation(balance: DataFrame, settlements: DataFrame, route: DataFrame | None = None) -> DataFrame:
    """A row for each settlement, a subtotal for each municipality, a total for each province (level 0, 1, 2).

    With a route (corridor_id, ekatte, metres), settlements that it misses have 0 km; without one, km are null. Metres are added before they
    are rounded.
    """
    rows = balance.where("row_kind = 'total' and table_ord = 0").join(settlements.select("ekatte", "municipality", "province"), "ekatte", "left")
    rows = rows.withColumn("municipality", F.coalesce("municipality", F.lit("Неизвестна община"))).withColumn("province", F.coalesce("province", F.lit("")))
    if route is None:
        rows = rows.withColumn("metres", F.lit(None).cast("decimal(24,6)"))
    else:
        rows = rows.join(route.groupBy("corridor_id", "ekatte").agg(F.sum(F.col("metres").cast("decimal(24,6)")).alias("metres")), ["corridor_id", "ekatte"], "left").withColumn("metres", F.coalesce("metres", F.lit(0).cast("decimal(24,6)")))
    cube = rows.rollup("corridor_id", "province", "municipality", "ekatte").agg(*_sums(F.sum("parcels")), F.sum("metres").alias("metres"), F.grouping_id().alias("g")).where("g in (0, 1, 3)")
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2)
    km = F.round(F.col("metres").cast("decimal(24,6)") * F.lit("0.001").cast("decimal(4,3)"), 3).cast(DKA)
    return cube.select("corridor_id", "province", "municipality", "ekatte", level.alias("level"), *SUMS, km.alias("route_km"))


def unequal_totals(balance: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections whose four totals differ from each other or from the register's: empty if all is well."""
    t = balance.where("row_kind = 'total'").groupBy("corridor_id", "ekatte").agg(*(F.countDistinct(c).alias(f"n_{c}") for c in SUMS), *(F.min(c).alias(c) for c in SUMS))
    r = totals.select("corridor_id", "ekatte", *(F.col(c).alias(f"r_{c}") for c in ("parcels", "area_dka", "restricted_dka", "step_dka")))
    j = t.join(r, ["corridor_id", "ekatte"], "full")
    bad = F.lit(False)
    for c in SUMS:
        bad = bad | (F.col(f"n_{c}") != 1)
    for c in ("parcels", "area_dka", "restricted_dka", "step_dka"):
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return j.where(bad).select("corridor_id", "ekatte")


def unequal_municipalities(recap: DataFrame, combined: DataFrame) -> DataFrame:
    """Municipalities whose subtotal differs from their combined balance: empty if all is well."""
    section = ["corridor_id", "province", "municipality"]
    a = recap.where("level = 1").select(*section, F.struct(*SUMS).alias("a"))
    b = combined.where("row_kind = 'total' and table_ord = 0").select(*section, F.struct(*SUMS).alias("b"))
    return a.join(b, section, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*section)


def unequal_combined(balance: DataFrame, combined: DataFrame, settlements: DataFrame) -> DataFrame:
    """(corridor_id, province, municipality, table_ord): tables whose total differs from the sum of their settlements' totals: empty if all is well."""
    section = ["corridor_id", "province", "municipality", "table_ord"]
    own = combined.where("row_kind = 'total'").select(*section, F.struct(*SUMS).alias("a"))
    rows = balance.where("row_kind = 'total'").join(settlements.select("ekatte", "municipality", "province"), "ekatte", "left")
    rows = rows.withColumn("municipality", F.coalesce("municipality", F.lit("Неизвестна община"))).withColumn("province", F.coalesce("province", F.lit("")))
    sums = rows.groupBy(*section).agg(*(F.sum(c).alias(c) for c in SUMS)).select(*section, F.struct(*SUMS).alias("b"))
    differ = F.lit(False)
    for c in SUMS:
        differ = differ | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return own.join(sums, section, "full").where(differ).select(*section)


def route_metres(route: DataFrame) -> DataFrame:
    """(corridor_id, ekatte, metres, km): a route's length in each settlement; metres are added before they are rounded."""
    return route.groupBy("corridor_id", "ekatte").agg(F.sum("metres").alias("metres")).withColumn("km", to_km(F.col("metres")))


# --- the older tables: square metres are added up as they are and rounded once -------------------------------------------------

# How empty texts are called.
NO_TERRITORY, NO_OWNERSHIP = "(без вид)", "(без собственост)"


def legacy_rows(areas: DataFrame, pieces: DataFrame, parcels: DataFrame) -> DataFrame:
    """areas with pole_sqm, ekatte, territory and ownership of each parcel, empty texts named."""
    q = pieces.groupBy("corridor_id", "parcel_id").agg(F.sum("piece_sqm").alias("pole_sqm"))
    named = lambda c, none: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(none))
    p = parcels.select("parcel_id", "ekatte", named("vidt", NO_TERRITORY).alias("territory"), named("vids", NO_OWNERSHIP).alias("ownership"))
    return areas.join(p, "parcel_id").join(q, ["corridor_id", "parcel_id"], "left").withColumn("pole_sqm", F.coalesce("pole_sqm", F.lit(0.0)))


def _rounded_once(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("parcels"), *(sqm_to_dka(F.sum(c)).alias(n) for c, n in (("drawn_sqm", "area_dka"), ("gross_sqm", "gross_dka"), ("pole_sqm", "step_dka"))))


def legacy_balances(rows: DataFrame) -> DataFrame:
    """(corridor_id, table_ord, group, sums): legacy_rows() by territory (0) and by ownership (1), from one pass."""
    t = F.explode(F.array(*(F.struct(F.lit(i).alias("table_ord"), F.col(c).alias("group")) for i, c in enumerate(("territory", "ownership"))))).alias("t")
    return _rounded_once(rows.select("*", t), "corridor_id", F.col("t.table_ord").alias("table_ord"), F.col("t.group").alias("group"))


def legacy_totals(rows: DataFrame, by: str) -> DataFrame:
    """(corridor_id, by, sums): legacy_rows() by a column, and each corridor's total, with a null there; the total is rounded on its own."""
    return _rounded_once(rows, "corridor_id", by).unionByName(_rounded_once(rows, "corridor_id"), allowMissingColumns=True)
