"""Registers: what a corridor does to each parcel, who owns it, and the tables by structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.functions.keys import POLE_PREFIX, control_key, ekatte_of, is_ownership, normal_code, parcel_key, pole_key, strip_pole_prefix
from wayleave.functions.units import DKA, roman_category, share, sqm_to_dka
from wayleave.operators.order import placed

# Fixed values, as printed.
HEIRS = "н-ци на "
UNKNOWN_MUNICIPALITY = "Неизвестна община"


def sum_by_parcel(shapes: DataFrame) -> DataFrame:
    """(corridor_id, parcel_id, drawn_sqm, gross_sqm): several shapes of one parcel are one."""
    return shapes.groupBy("corridor_id", "parcel_id").agg(F.sum("drawn_sqm").alias("drawn_sqm"), F.sum("gross_sqm").alias("gross_sqm"))


def printed_steps(pieces: DataFrame) -> DataFrame:
    """(corridor_id, parcel_id, step_dka, pole_numbers): printed pieces added up, structures in their order."""
    rows = pieces.select("corridor_id", "parcel_id", strip_pole_prefix(F.col("pole_no")).alias("pole"), sqm_to_dka(F.col("piece_sqm")).alias("dka"))
    named = F.array_sort(F.collect_set(F.struct(pole_key(F.col("pole")).alias("key"), F.col("pole"))))
    return rows.groupBy("corridor_id", "parcel_id").agg(F.sum("dka").cast(DKA).alias("step_dka"), F.array_join(F.transform(named, lambda p: F.concat(F.lit(POLE_PREFIX), p["pole"])), ", ").alias("pole_numbers"))


def winning_parcels(pieces: DataFrame) -> DataFrame:
    """(corridor_id, pole_no, parcel_id, piece_sqm): the parcel that has most of a structure; of equals the smaller identifier."""
    summed = pieces.groupBy("corridor_id", "pole_no", "parcel_id").agg(F.sum("piece_sqm").alias("piece_sqm"))
    best = F.min_by(F.struct("parcel_id", "piece_sqm"), F.struct((-F.col("piece_sqm")).alias("a"), parcel_key(F.col("parcel_id")).alias("k")))
    return summed.groupBy("corridor_id", "pole_no").agg(best.alias("b")).select("corridor_id", "pole_no", "b.parcel_id", "b.piece_sqm")


def poles_per_parcel(winners: DataFrame) -> DataFrame:
    return winners.groupBy("corridor_id", "parcel_id").agg(F.count(F.lit(1)).alias("poles"))


def lowest_pole(pieces: DataFrame, *by: str) -> DataFrame:
    return pieces.groupBy(*by).agg(F.min_by("pole_no", pole_key(F.col("pole_no"))).alias("lowest_pole"))


def parcel_owners(rights: DataFrame, persons: DataFrame) -> DataFrame:
    """(parcel_id, owner_ord, person_id, person_name): ownership rights, one row for each person in order of the file."""
    own = rights.where(is_ownership(F.col("kind"))).groupBy("parcel_id", "person_id").agg(F.min("right_ord").alias("ord"))
    named = own.join(persons, "person_id", "left")
    name = F.concat(F.when(F.col("heirs"), F.lit(HEIRS)).otherwise(F.lit("")), F.coalesce("name", F.lit("")))
    return named.select("parcel_id", F.row_number().over(Window.partitionBy("parcel_id").orderBy("ord")).alias("owner_ord"), "person_id", name.alias("person_name"))


def described(rows: DataFrame, codes: DataFrame, nomenclature: str, column: str, both: bool = False) -> DataFrame:
    """rows with the text of a code in `column`: `code N` if it is unknown, empty if it is empty; with both, `code - text`."""
    names = codes.where(F.col("nomenclature") == nomenclature).select(normal_code(F.col("code")).alias("_code"), F.col("text").alias("_text"))
    joined = rows.withColumn("_code", normal_code(F.col(column))).join(names, "_code", "left")
    text = F.when(F.coalesce("_code", F.lit("")) == "", F.lit("")).when(F.col("_text").isNull(), F.concat(F.lit("код "), F.trim(column)))
    known = F.concat(F.trim(column), F.lit(" – "), F.col("_text")) if both else F.col("_text")
    return joined.withColumn(f"{column}_text", text.otherwise(known)).drop("_code", "_text")


def register_body(areas: DataFrame, pieces: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row for each corridor and parcel with printed values. restricted = gross - steps, remainder = area - gross; both may be negative.

    A parcel that is not in `parcels` stays, with found = false.
    """
    printed = sum_by_parcel(areas).select("corridor_id", "parcel_id", sqm_to_dka(F.col("drawn_sqm")).alias("area_dka"), sqm_to_dka(F.col("gross_sqm")).alias("gross_dka"))
    poles = poles_per_parcel(winning_parcels(pieces))
    rows = printed.join(printed_steps(pieces), ["corridor_id", "parcel_id"], "left").join(poles, ["corridor_id", "parcel_id"], "left")
    rows = rows.join(parcels.select("parcel_id", "kat", "vids", "vidt", "ntp", F.lit(True).alias("found")), "parcel_id", "left")
    step = F.coalesce("step_dka", F.lit(0).cast(DKA))
    return rows.select(
        "corridor_id", "parcel_id", ekatte_of(F.col("parcel_id")).alias("ekatte"), "area_dka", (F.col("gross_dka") - step).cast(DKA).alias("restricted_dka"), (F.col("area_dka") - F.col("gross_dka")).cast(DKA).alias("remainder_dka"),
        "pole_numbers", "step_dka", F.coalesce("poles", F.lit(0)).alias("poles"), F.coalesce("found", F.lit(False)).alias("found"), "kat", "vids", "vidt", "ntp",
    )


def affected_register(body: DataFrame, owners: DataFrame) -> DataFrame:
    """The register: a parcel's row, then one row for each further owner with the parcel's columns empty and its ownership repeated."""
    rows = body.join(owners, (body.parcel_id == owners.parcel_id) & body.found, "left").drop(owners.parcel_id).withColumn("owner_ord", F.coalesce("owner_ord", F.lit(1)))
    first = F.col("owner_ord") == 1
    order = Window.partitionBy("corridor_id", "ekatte").orderBy(parcel_key(F.col("parcel_id")), "parcel_id", "owner_ord")
    only = lambda c: F.when(first, F.col(c)).alias(c)
    return rows.select(
        "corridor_id", "ekatte", F.row_number().over(order).alias("row_ord"), only("parcel_id"), only("area_dka"), only("restricted_dka"), only("remainder_dka"), only("pole_numbers"), only("step_dka"),
        F.when(first & F.col("found"), roman_category(F.col("kat"))).alias("category"), F.col("vids").alias("ownership"), "person_id", "person_name",
    )


def register_totals(body: DataFrame) -> DataFrame:
    step = F.coalesce("step_dka", F.lit(0).cast(DKA))
    return body.groupBy("corridor_id", "ekatte").agg(F.count(F.lit(1)).alias("parcels"), *(F.sum(c).alias(c) for c in ("area_dka", "restricted_dka", "remainder_dka")), F.sum(step).alias("step_dka"))


def steps_register(pieces: DataFrame, areas: DataFrame, parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """One block for each structure and parcel; further owners fill only their own two columns."""
    block = pieces.groupBy("corridor_id", strip_pole_prefix(F.col("pole_no")).alias("pole_no"), "parcel_id").agg(F.sum(sqm_to_dka(F.col("piece_sqm"))).cast(DKA).alias("piece_dka"))
    drawn = areas.groupBy("corridor_id", "parcel_id").agg(F.sum("drawn_sqm").alias("drawn_sqm"))
    rows = block.join(drawn, ["corridor_id", "parcel_id"], "left").join(parcels.select("parcel_id", "kat", "vids", F.lit(True).alias("found")), "parcel_id", "left")
    rows = rows.join(owners, (rows.parcel_id == owners.parcel_id) & rows.found, "left").drop(owners.parcel_id).withColumn("owner_ord", F.coalesce("owner_ord", F.lit(1)))
    first = F.col("owner_ord") == 1
    rows = placed(rows, ["corridor_id"], [pole_key(F.col("pole_no")), parcel_key(F.col("parcel_id")), F.col("parcel_id"), F.col("owner_ord")])
    only = lambda c, n: F.when(first, c).alias(n)
    return rows.select(
        "corridor_id", "row_ord", only(F.concat(F.lit(POLE_PREFIX), F.col("pole_no")), "pole_label"), only(F.col("piece_dka"), "piece_dka"), only(F.col("parcel_id"), "parcel_id"),
        only(sqm_to_dka(F.col("drawn_sqm")), "area_dka"), F.when(first & F.col("found"), roman_category(F.col("kat"))).alias("category"), only(F.col("vids"), "ownership"), "person_id", "person_name",
    )


def steps_table(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows by parcel and structure; the remainder is the printed area without the parcel's printed pieces."""
    rows = pieces.join(drawn, ["corridor_id", "parcel_id"]).select("corridor_id", "parcel_id", sqm_to_dka(F.col("drawn_sqm")).alias("area_dka"), strip_pole_prefix(F.col("pole_no")).alias("pole_no"), sqm_to_dka(F.col("piece_sqm")).alias("step_dka"))
    whole = Window.partitionBy("corridor_id", "parcel_id")
    turn = F.row_number().over(whole.orderBy(pole_key(F.col("pole_no"))))
    return rows.select("*", (F.col("area_dka") - F.sum("step_dka").over(whole)).cast(DKA).alias("remainder_dka"), turn.alias("turn"), F.when(turn == 1, F.count(F.lit(1)).over(whole)).otherwise(F.lit(0)).alias("parcel_rows"))


def uncovered(footprints: DataFrame, pieces: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Structures whose pieces do not make up their footprint."""
    covered = pieces.groupBy("corridor_id", "pole_no").agg(F.sum("piece_sqm").alias("covered_sqm"))
    rows = footprints.join(covered, ["corridor_id", "pole_no"], "left").withColumn("covered_sqm", F.coalesce("covered_sqm", F.lit(0.0)))
    return rows.withColumn("missing_sqm", F.col("area_sqm") - F.col("covered_sqm")).where(F.col("missing_sqm") > tolerance).select("corridor_id", "pole_no", "area_sqm", "covered_sqm", "missing_sqm")


def control_report(drawn: DataFrame, parcels: DataFrame, rights: DataFrame, persons: DataFrame) -> DataFrame:
    """Drawn parcels against the register: one row for each right, one row for a parcel without any; with a right's term where rights have one."""
    sums = drawn.groupBy("parcel_id").agg(F.sum("drawn_sqm").alias("drawn_sqm"))
    rows = sums.join(parcels.select("parcel_id", "kat", "area_sqm"), "parcel_id").join(rights, "parcel_id", "left").join(persons, "person_id", "left")
    order = Window.partitionBy(ekatte_of(F.col("parcel_id"))).orderBy(control_key(F.col("parcel_id")), "right_ord")
    difference = F.round(F.col("drawn_sqm").cast("decimal(24,6)") - F.col("area_sqm").cast("decimal(24,6)"), 2)
    return rows.select("parcel_id", F.row_number().over(order).alias("row_ord"), roman_category(F.col("kat")).alias("category"), F.col("area_sqm").alias("cad_sqm"), "drawn_sqm", difference.alias("difference_sqm"), F.col("kind").alias("right_kind"), share(F.col("doc1"), F.col("doc2")).alias("share"), "person_id", F.col("name").alias("person_name"), *(c for c in ["term"] if c in rights.columns))


def merged_rows(gross: DataFrame, pieces: DataFrame, parcels: DataFrame, none: str = "NO DATA") -> DataFrame:
    """(corridor_id, parcel_id, territory, poles, gross_sqm): parcels that a corridor or one of its structures touches, with what the register says of them (the older merge)."""
    key = ["corridor_id", "parcel_id"]
    rows = gross.select(*key).union(pieces.select(*key)).distinct().join(parcels, "parcel_id", "left")
    rows = rows.join(pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("poles")), key, "left").join(gross, key, "left")
    return rows.select(*key, F.coalesce("vidt", F.lit(none)).alias("territory"), F.coalesce("poles", F.lit(0)).alias("poles"), F.coalesce("gross_sqm", F.lit(0.0)).alias("gross_sqm"))


def section_poles(winners: DataFrame) -> DataFrame:
    """(corridor_id, ekatte, poles): how many structures stand in each settlement, each where winning_parcels() puts it."""
    return winners.groupBy("corridor_id", ekatte_of(F.col("parcel_id")).alias("ekatte")).agg(F.count(F.lit(1)).alias("poles"))


def municipality_groups(areas: DataFrame, settlements: DataFrame) -> DataFrame:
    """(corridor_id, municipality, province, settlements, parcels): the settlements that a corridor touches by municipality; those that are not in the register are of an unknown one."""
    rows = areas.withColumn("ekatte", ekatte_of(F.col("parcel_id"))).join(settlements.select("ekatte", "municipality", "province"), "ekatte", "left")
    named = [F.coalesce("municipality", F.lit(UNKNOWN_MUNICIPALITY)).alias("municipality"), F.coalesce("province", F.lit("")).alias("province")]
    return rows.groupBy("corridor_id", *named).agg(F.countDistinct("ekatte").alias("settlements"), F.count(F.lit(1)).alias("parcels"))


def route_sort(areas: DataFrame, pieces: DataFrame) -> DataFrame:
    """(corridor_id, ekatte, place): a corridor's settlements in order of their lowest structure; those without one last, by their code."""
    code = ekatte_of(F.col("parcel_id")).alias("ekatte")
    low = lowest_pole(pieces.select("*", code), "corridor_id", "ekatte")
    rows = areas.select("corridor_id", code).distinct().join(low, ["corridor_id", "ekatte"], "left")
    order = Window.partitionBy("corridor_id").orderBy(F.col("lowest_pole").isNull(), pole_key(F.col("lowest_pole")), "ekatte")
    return rows.select("corridor_id", "ekatte", F.dense_rank().over(order).alias("place"))


def balance_check(areas: DataFrame, pieces: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(corridor_id, parcel_id, gross_sqm, pole_sqm, check_text): whether what a corridor takes of a parcel is what is left of it beside structures, and these."""
    p = pieces.groupBy("corridor_id", "parcel_id").agg(F.sum("piece_sqm").alias("pole_sqm"))
    rows = areas.join(p, ["corridor_id", "parcel_id"], "left").withColumn("pole_sqm", F.coalesce("pole_sqm", F.lit(0.0)))
    net = F.greatest(F.col("gross_sqm") - F.col("pole_sqm"), F.lit(0.0))
    ok = F.abs(F.col("gross_sqm") - (net + F.col("pole_sqm"))) <= tolerance
    return rows.select("corridor_id", "parcel_id", "gross_sqm", "pole_sqm", F.when(ok, "ОК").otherwise("ГРЕШКА").alias("check_text"))
