"""The cadastral tables as derived from the given TPC-H-like tables.

Parcels stand on a lattice of 20 m, so that every overlap area is exact; see SQL below for the same in DuckDB. Ten rows of parcels
make a band; each band has a corridor of its own and the structures of one supplier in twenty parts, so that corridors,
structures and what they touch grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = 20


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel_id, ekatte, x0, y0, x1, y1, kat, vids, vidt, ntp, area_sqm, in_register, num)"""
    p = t(spark, sf_dir, "part").withColumn("gx", F.col("p_partkey") % 40).withColumn("gy", F.floor(F.col("p_partkey") / 40))
    p = p.withColumn("sk", F.floor(F.col("gx") / 8) + 5 * (F.floor(F.col("gy") / 10) % 5))
    p = p.withColumn("ekatte", F.lpad(F.col("sk").cast("string"), 5, "0"))
    return p.select(
        F.concat_ws(".", "ekatte", F.col("gy").cast("string"), F.col("p_partkey").cast("string")).alias("parcel_id"),
        "ekatte",
        *((F.col(g) * CELL).cast("double").alias(n) for g, n in (("gx", "x0"), ("gy", "y0"))),
        (F.col("gx") * CELL + CELL).cast("double").alias("x1"),
        (F.col("gy") * CELL + CELL - F.col("p_size") % 3).cast("double").alias("y1"),
        (F.col("p_size") % 11).cast("string").alias("kat"),
        F.col("p_brand").alias("vids"),
        F.col("p_type").alias("vidt"),
        F.substring_index("p_name", " ", 1).alias("ntp"),
        F.col("p_retailprice").alias("area_sqm"),
        (F.col("p_partkey") % 11 != 0).alias("in_register"),
        F.col("p_partkey").alias("num"),
    )


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ekatte, kind, name, municipality, province): nations, regions, and two provinces."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("ekatte"), F.lit("с.").alias("kind"), F.col("n_name").alias("name"), F.col("r_name").alias("municipality"), (F.col("r_regionkey") % 2).cast("string").alias("province")
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corridor_id, pole_no, x0, y0, x1, y1, area_sqm)"""
    k = F.floor(F.col("s_suppkey") / 20)
    s = t(spark, sf_dir, "supplier").select(k.alias("corridor_id"), F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37) % 800).cast("double").alias("x"), (200 * k + (F.col("s_suppkey") * 53) % 100).cast("double").alias("y"), (2 + F.col("s_suppkey") % 3).cast("double").alias("h"))
    return s.select("corridor_id", F.col("k").cast("string").alias("pole_no"), (F.col("x") - F.col("h")).alias("x0"), (F.col("y") - F.col("h")).alias("y0"), (F.col("x") + F.col("h")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), (4 * F.col("h") * F.col("h")).alias("area_sqm"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corridor_id, b): the bands of parcel rows and where their corridors begin."""
    k = F.floor(F.col("p_partkey") / 400)
    return t(spark, sf_dir, "part").select(k.alias("corridor_id")).distinct().select("corridor_id", base(F.col("corridor_id")).alias("b"))


def base(corridor_id: Column) -> Column:
    return (200 * corridor_id + 10 + 18 * (corridor_id % 5)).cast("double")


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corridor_id, ring): one concave L for each band."""
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    low, top, end = F.col("b"), F.col("b") + 12, 200 * F.col("corridor_id") + 110
    return bands(spark, sf_dir).select("corridor_id", F.array(at(5, low), at(700, low), at(700, end), at(688, end), at(688, top), at(5, top)).alias("ring"))


def ring(x0="x0", y0="y0", x1="x1", y1="y1"):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))


def rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel_id, right_ord, kind, person_id, doc1, doc2), and persons below."""
    li, o, p = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders"), parcels(spark, sf_dir)
    r = li.where("l_partkey % 7 <> 0").join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == F.col("o_orderkey"))
    r = r.withColumn("right_ord", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")))
    return r.join(p.select("num", "parcel_id"), F.col("l_partkey") == F.col("num")).select(
        "parcel_id", "right_ord", (F.col("l_linenumber") % 3).cast("string").alias("kind"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("person_id"), F.col("l_quantity").cast("int").cast("string").alias("doc1"), F.when(F.col("l_linenumber") == 7, F.lit("-2")).otherwise(F.col("l_linenumber").cast("string")).alias("doc2")
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, name, heirs)"""
    return t(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("person_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 10 == 0).alias("heirs"))


#: The same tables in DuckDB's SQL.
SQL = """
parcel AS (
  SELECT lpad(CAST(sk AS VARCHAR), 5, '0') AS ekatte, lpad(CAST(sk AS VARCHAR), 5, '0') || '.' || gy || '.' || p_partkey AS parcel_id,
         CAST(gx*20 AS DOUBLE) AS x0, CAST(gy*20 AS DOUBLE) AS y0, CAST(gx*20+20 AS DOUBLE) AS x1, CAST(gy*20+20-p_size%3 AS DOUBLE) AS y1,
         CAST(p_size%11 AS VARCHAR) AS kat, p_brand AS vids, p_type AS vidt, split_part(p_name, ' ', 1) AS ntp, p_retailprice AS area_sqm,
         p_partkey%11<>0 AS in_register, p_partkey AS num, gy
  FROM (SELECT *, p_partkey%40 AS gx, p_partkey//40 AS gy, (p_partkey%40)//8 + 5*((p_partkey//400)%5) AS sk FROM part)),
settlement AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS ekatte, 'с.' AS kind, n_name AS name, r_name AS municipality, CAST(r_regionkey%2 AS VARCHAR) AS province FROM nation JOIN region ON n_regionkey = r_regionkey),
band AS (SELECT DISTINCT p_partkey//400 AS corridor_id, CAST(200*(p_partkey//400) + 10 + 18*((p_partkey//400)%5) AS DOUBLE) AS b FROM part),
footprint AS (SELECT k AS corridor_id, CAST(s_suppkey AS VARCHAR) AS pole_no, CAST(x-h AS DOUBLE) AS x0, CAST(y-h AS DOUBLE) AS y0, CAST(x+h AS DOUBLE) AS x1, CAST(y+h AS DOUBLE) AS y1, CAST(4*h*h AS DOUBLE) AS area_sqm
  FROM (SELECT s_suppkey, s_suppkey//20 AS k, (s_suppkey*37)%800 AS x, 200*(s_suppkey//20) + (s_suppkey*53)%100 AS y, 2+s_suppkey%3 AS h FROM supplier)),
piece AS (SELECT f.corridor_id, f.pole_no, p.parcel_id, (least(f.x1,p.x1)-greatest(f.x0,p.x0))*(least(f.y1,p.y1)-greatest(f.y0,p.y0)) AS piece_sqm
  FROM footprint f JOIN parcel p ON f.x0<p.x1 AND f.x1>p.x0 AND f.y0<p.y1 AND f.y1>p.y0),
gross AS (SELECT corridor_id, parcel_id, h+v-hv AS gross_sqm FROM (
  SELECT corridor_id, parcel_id,
    greatest(0, least(x1,700)-greatest(x0,5))*greatest(0, least(y1,b+12)-greatest(y0,b)) AS h,
    greatest(0, least(x1,700)-greatest(x0,688))*greatest(0, least(y1,200*corridor_id+110)-greatest(y0,b)) AS v,
    greatest(0, least(x1,700)-greatest(x0,688))*greatest(0, least(y1,b+12)-greatest(y0,b)) AS hv
  FROM band JOIN parcel ON gy//10 = corridor_id) WHERE h+v-hv > 0.001),
areas AS (SELECT k.corridor_id, k.parcel_id, p.ekatte, (p.x1-p.x0)*(p.y1-p.y0) AS drawn_sqm, coalesce(g.gross_sqm, 0) AS gross_sqm
  FROM (SELECT corridor_id, parcel_id FROM gross UNION SELECT corridor_id, parcel_id FROM piece) k JOIN parcel p USING (parcel_id) LEFT JOIN gross g USING (corridor_id, parcel_id)),
rights AS (SELECT p.parcel_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS right_ord,
    CAST(l_linenumber%3 AS VARCHAR) AS kind, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS person_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS doc1, CASE WHEN l_linenumber=7 THEN '-2' ELSE CAST(l_linenumber AS VARCHAR) END AS doc2
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN parcel p ON p.num=l_partkey WHERE l_partkey%7<>0),
person AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS person_id, c_name AS name, c_custkey%10=0 AS heirs FROM customer),
printed AS (SELECT a.*, CAST(round(CAST(drawn_sqm AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3)) AS area_dka, CAST(round(CAST(gross_sqm AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3)) AS gross_dka FROM areas a),
step AS (SELECT corridor_id, parcel_id, sum(CAST(round(CAST(piece_sqm AS DECIMAL(24,6))*0.001, 3) AS DECIMAL(18,3))) AS step_dka, string_agg('Стълб №' || pole_no, ', ' ORDER BY CAST(pole_no AS BIGINT)) AS pole_numbers, count(*) AS n FROM piece GROUP BY ALL),
winner AS (SELECT corridor_id, pole_no, parcel_id, piece_sqm FROM (SELECT *, row_number() OVER (PARTITION BY corridor_id, pole_no ORDER BY piece_sqm DESC, split_part(parcel_id,'.',1)::BIGINT, split_part(parcel_id,'.',2)::BIGINT, split_part(parcel_id,'.',3)::BIGINT) AS rn FROM piece) WHERE rn=1),
poles AS (SELECT corridor_id, parcel_id, count(*) AS poles FROM winner GROUP BY ALL),
body AS (SELECT p.corridor_id, p.parcel_id, p.ekatte, p.area_dka, p.gross_dka - coalesce(s.step_dka, 0) AS restricted_dka, p.area_dka - p.gross_dka AS remainder_dka, s.pole_numbers, s.step_dka, coalesce(w.poles, 0) AS poles,
    c.parcel_id IS NOT NULL AS found, c.kat, c.vids, c.vidt, c.ntp
  FROM printed p LEFT JOIN step s USING (corridor_id, parcel_id) LEFT JOIN poles w USING (corridor_id, parcel_id) LEFT JOIN (SELECT * FROM parcel WHERE in_register) c ON c.parcel_id = p.parcel_id),
owner AS (SELECT parcel_id, person_id, CASE WHEN heirs THEN 'н-ци на ' ELSE '' END || coalesce(name, '') AS person_name, row_number() OVER (PARTITION BY parcel_id ORDER BY ord) AS owner_ord
  FROM (SELECT parcel_id, person_id, min(right_ord) AS ord FROM rights WHERE kind = '1' GROUP BY ALL) LEFT JOIN person USING (person_id))
"""

#: Sort key of a lattice parcel identifier in DuckDB.
ORDER = "split_part(parcel_id,'.',1)::BIGINT, split_part(parcel_id,'.',2)::BIGINT, split_part(parcel_id,'.',3)::BIGINT"
