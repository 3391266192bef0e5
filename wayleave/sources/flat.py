"""Older inputs: a flat register in delimited text, and parcels as GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the flat register, and the property names of the features.
FLAT = ["parcel_id", "owner", "ekatte", "area_sqm", "subdivision", "territory", "land_use", "locality", "category", "ownership", "owner_id", "owner_name"]
PROPERTIES = {"ident": "Идентификатор", "place": "ЕКАТТЕ / Населено място", "area": "Площ по КК (кв.м)", "rights": "rights_data", "tenant": "Арендатори / Ползватели", "territory": "Вид територия (ЗСПЗЗ)", "land_use": "Нов НТП по ЗКИР", "locality": "Местност", "category": "Категория земя", "ownership": "Вид собственост"}


def flat_register(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) with 4 to 12 columns: missing ones are empty, rows with a bad area are skipped, the first of repeated parcels counts."""
    c = F.split("value", "[,;\t]")
    rows = lines.where((F.trim("value") != "") & (F.size(c) >= 4)).select("line_no", *(F.coalesce(F.trim(F.get(c, i)), F.lit("")).alias(n) for i, n in enumerate(FLAT)))
    rows = rows.withColumn("area_sqm", F.col("area_sqm").try_cast("double")).where("area_sqm is not null")
    return rows.groupBy("parcel_id").agg(F.min_by(F.struct(*FLAT[1:]), "line_no").alias("r")).select("parcel_id", "r.*")


def _property(feature: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(feature, f"$.properties['{PROPERTIES[name]}']"), F.lit(""))


def _identified(features: DataFrame, feature: str) -> DataFrame:
    """features (ord, feature as JSON text) with parcel_id and ekatte, the settlement's code put before the identifier once."""
    j = F.col(feature)
    code = F.regexp_extract(_property(j, "place"), "^[ -]*([^ -]*)", 1)
    ident = _property(j, "ident")
    id_ = F.when((code != "") & ~F.startswith(ident, code), F.concat(code, F.lit("."), ident)).otherwise(ident)
    return features.withColumn("ekatte", code).withColumn("parcel_id", id_).where(F.col("parcel_id") != "")


def geojson_attributes(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Parcels of GeoJSON features: the owner is the first person in the nested rights, else the tenant; the first of repeated parcels counts."""
    j = F.col(feature)
    owner = F.coalesce(F.when(F.trim(F.get_json_object(_property(j, "rights"), "$[0].person_name")) != "", F.get_json_object(_property(j, "rights"), "$[0].person_name")), _property(j, "tenant"))
    rows = _identified(features, feature).select("ord", "parcel_id", "ekatte", F.coalesce(_property(j, "area").try_cast("double"), F.lit(0.0)).alias("area_sqm"), owner.alias("owner"), *(_property(j, n).alias(n) for n in ("territory", "land_use", "locality", "category", "ownership")))
    names = [c for c in rows.columns if c not in ("ord", "parcel_id")]
    return rows.groupBy("parcel_id").agg(F.min_by(F.struct(*names), "ord").alias("r")).select("parcel_id", "r.*")


def geojson_centroids(features: DataFrame, feature: str = "feature") -> DataFrame:
    """(parcel_id, x, y, area_sqm): mean of the outer ring's vertices, the closing one counted too; first polygon of several."""
    j = F.col(feature)
    ring = F.coalesce(F.from_json(F.get_json_object(j, "$.geometry.coordinates[0]"), "array<array<double>>"), F.array().cast("array<array<double>>"))
    many = F.coalesce(F.from_json(F.get_json_object(j, "$.geometry.coordinates[0][0]"), "array<array<double>>"), F.array().cast("array<array<double>>"))
    kind = F.get_json_object(j, "$.geometry.type")
    rows = _identified(features, feature).withColumn("ring", F.when(kind == "Polygon", ring).when(kind == "MultiPolygon", many)).where(F.size("ring") > 0)
    mean = lambda i: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[i]) / F.size("ring")
    return rows.select("parcel_id", mean(0).alias("x"), mean(1).alias("y"), F.coalesce(_property(j, "area").try_cast("double"), F.lit(0.0)).alias("area_sqm"))
