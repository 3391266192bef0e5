"""Cadastral exchange files (.cad): from bytes to register tables, with built-in expressions only.

A file is text in a one-byte code page: sections (HEADER, LAYER, CONTROL, TABLE), in tables F lines that name fields and D
lines with comma-separated values. All functions take a DataFrame of lines (path, modified, line_no, text), so that any
number of files is one job; what needs the order of lines works per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayleave.functions.geometry import bound
from wayleave.functions.keys import full_parcel_id, unescaped_quotes
from wayleave.sources.saved import saved

VERSION = "4.02"
TEMPLATES = "template.cad"
# The code page. 0x80 to 0xBF are the Cyrillic letters from capital A on, 0xD5 is the numero sign.
HIGH = "".join(map(chr, range(0x80, 0x100)))
LETTERS = "".join(chr(0x410 + i) for i in range(64)) + "".join("№" if b == 0xD5 else "�" for b in range(0xC0, 0x100))
MARKS = ["HEADER", "LAYER", "CONTROL", "TABLE", "END_HEADER", "END_LAYER", "END_CONTROL", "END_TABLE"]
KEYS = {"POZEMLIMOTI": "IDENT", "MESTNOSTI": "MESTNOST", "PRAVA": "IDENT", "PERSONS": "PERSON", "GORIMOTI": "IDENT"}
# One value and its comma: quoted, where only a quote before a comma or the end closes; or plain.
VALUE = r'\s*+(?:"(?:[^"\\]++|\\(?!"\s*+(?:,|$))|\\"|"(?!\s*+(?:,|$)))*+"\s*+|[^,]*+)(?:,|$)'


def scan_cad_dir(spark: SparkSession, folder: str, library: str = TEMPLATES) -> DataFrame:
    """(path, modified, content) of all .cad files below a folder, without the template library."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][aA][dD]").load(folder)
    return files.where(F.lower(F.substring_index("path", "/", -1)) != library.lower()).select("path", F.col("modificationTime").alias("modified"), "content")


def decode_mik(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), HIGH, LETTERS)


def undecodable(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^�]", ""))


def lines(files: DataFrame) -> DataFrame:
    text = decode_mik(F.col("content"))
    return files.select("path", "modified", F.posexplode(F.split(text, "\n")).alias("i", "text")).select("path", "modified", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def sections(rows: DataFrame) -> DataFrame:
    """(path, line_no, section, name, block, keyword, rest): each line with the section that it stands in; block numbers a file's sections."""
    t = F.trim(F.regexp_replace("text", r"[\r\t]", " "))
    rows = rows.select("path", "line_no", t.alias("t")).where("t <> ''")
    rows = rows.select("path", "line_no", F.substring_index("t", " ", 1).alias("keyword"), F.when(F.instr("t", " ") > 0, F.trim(F.substr(F.col("t"), F.instr("t", " ")))).otherwise(F.lit("")).alias("rest"))
    mark = F.when(F.col("keyword").isin(MARKS), F.struct(F.when(F.startswith("keyword", F.lit("END_")), F.lit("")).otherwise(F.col("keyword")).alias("section"), F.substring_index("rest", " ", 1).alias("name"), F.col("line_no").alias("block")))
    at = F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", at).where(~F.col("keyword").isin(MARKS))
    return rows.select("path", "line_no", F.coalesce("at.section", F.lit("")).alias("section"), F.coalesce("at.name", F.lit("")).alias("name"), F.coalesce("at.block", F.lit(0)).alias("block"), "keyword", "rest")


def split_values(rest: Column) -> Column:
    """Values of a D line; the match of nothing at the end of the line is no value."""
    found = bound(F.regexp_extract_all(rest, F.lit(VALUE), F.lit(0)), lambda v: F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))))
    bare = F.transform(found, lambda v: F.trim(F.regexp_replace(v, ",$", "")))
    return F.transform(bare, lambda v: F.when(F.regexp_like(v, F.lit('^".*"$')) & (F.length(v) > 1), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def table_rows(parts: DataFrame) -> DataFrame:
    """(path, line_no, table, fields, values): D lines of the known tables with the fields that stand before them."""
    t = parts.where((F.col("section") == "TABLE") & F.col("name").isin(list(KEYS)))
    names = t.where("keyword = 'F'").groupBy("path", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.upper(F.substring_index("rest", " ", 1)).alias("f")))), lambda x: x["f"]).alias("fields"), F.min("line_no").alias("from"))
    rows = t.where("keyword = 'D'").select("path", "block", "line_no", F.col("name").alias("table"), split_values(F.col("rest")).alias("values"))
    joined = rows.join(names, ["path", "block"], "left")
    fields = F.when(F.col("from") < F.col("line_no"), F.col("fields"))
    return joined.select("path", "line_no", "table", F.coalesce(fields, F.array().cast("array<string>")).alias("fields"), "values")


def good_rows(rows: DataFrame) -> DataFrame:
    """(path, line_no, table, row): the rows whose values fit their fields and whose key is not empty, as maps."""
    key = F.element_at(F.create_map(*(F.lit(x) for kv in KEYS.items() for x in kv)), F.col("table"))
    fits = rows.where((F.size("values") == F.size("fields")) & (F.size("fields") > 0)).select("path", "line_no", "table", F.map_from_arrays(F.array_distinct("fields"), "values").alias("row"), key.alias("key"))
    return fits.where(F.coalesce(F.element_at("row", F.col("key")), F.lit("")) != "").drop("key")


def bad_records(rows: DataFrame) -> DataFrame:
    """(path, line_no, table, reason): never what the row holds."""
    key = F.element_at(F.create_map(*(F.lit(x) for kv in KEYS.items() for x in kv)), F.col("table"))
    at = F.array_position("fields", key)
    reason = (
        F.when(F.size("fields") == 0, "data before fields")
        .when(F.size("values") != F.size("fields"), "wrong number of values")
        .when(at == 0, "no key field")
        .when(F.get("values", (at - 1).cast("int")) == "", "empty key")
    )
    return rows.select("path", "line_no", "table", reason.alias("reason")).where("reason is not null")


def headers(parts: DataFrame) -> DataFrame:
    """(path, version, ekatte, settlement); the last of repeated lines counts."""
    h = parts.where("section = 'HEADER'")
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("keyword") == k, F.col("rest")), F.when(F.col("keyword") == k, F.col("line_no"))), F.lit(""))
    return h.groupBy("path").agg(last("VERSION").alias("version"), last("EKATTE").alias("ekatte"), last("NAME").alias("settlement"))


def contour_areas(parts: DataFrame) -> DataFrame:
    """(path, line_no, ident, area_sqm): anywhere but in tables, headers and another layer's CONTROL; a null area is a bad record."""
    c = parts.where("keyword = 'CONTUR_AREA' and section not in ('TABLE', 'HEADER') and (section <> 'CONTROL' or name = 'CADASTER')")
    word = F.split("rest", r"\s+")
    return c.select("path", "line_no", F.get(word, 0).alias("ident"), F.replace(F.get(word, 1), F.lit(","), F.lit(".")).try_cast("double").alias("area_sqm"))


def _of(good: DataFrame, name: str, *fields: str) -> DataFrame:
    return good.where(F.col("table") == name).select("path", "line_no", *(F.coalesce(F.element_at("row", f), F.lit("")).alias(f.lower()) for f in fields))


def localities(good: DataFrame) -> DataFrame:
    return _of(good, "MESTNOSTI", "MESTNOST", "NAME").groupBy("path", "mestnost").agg(unescaped_quotes(F.min_by("name", "line_no")).alias("locality"))


def persons(good: DataFrame) -> DataFrame:
    """(path, person_id, name, heirs, repeats, names): the first row of a person counts."""
    p = _of(good, "PERSONS", "PERSON", "NAME", "FLAG").withColumn("name", unescaped_quotes(F.col("name")))
    first = F.min_by(F.struct("name", (F.upper("flag") == "T").alias("heirs")), "line_no")
    return p.groupBy("path", F.col("person").alias("person_id")).agg(first.alias("f"), (F.count(F.lit(1)) - 1).alias("repeats"), F.countDistinct("name").alias("names")).select("path", "person_id", "f.name", "f.heirs", "repeats", "names")


def parcels(good: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, parcel_id, ekatte, vidt, ntp, vids, kat, mestnost, locality, area_sqm): the first row of a parcel, the last contour area."""
    h = headers(parts).select("path", "ekatte")
    p = _of(good, "POZEMLIMOTI", "IDENT", "VIDT", "NTP", "VIDS", "KAT", "MESTNOST").join(h, "path").withColumn("parcel_id", full_parcel_id(F.col("ekatte"), F.col("ident")))
    p = p.groupBy("path", "parcel_id", "ekatte").agg(F.min_by(F.struct("vidt", "ntp", "vids", "kat", "mestnost"), "line_no").alias("f")).select("path", "parcel_id", "ekatte", "f.*")
    a = contour_areas(parts).where("area_sqm is not null").join(h, "path").withColumn("parcel_id", full_parcel_id(F.col("ekatte"), F.col("ident")))
    a = a.groupBy("path", "parcel_id").agg(F.max_by("area_sqm", "line_no").alias("area_sqm"))
    return p.join(localities(good), ["path", "mestnost"], "left").join(a, ["path", "parcel_id"], "left").select("path", "parcel_id", "ekatte", "vidt", "ntp", "vids", "kat", "mestnost", F.coalesce("locality", F.lit("")).alias("locality"), "area_sqm")


def subdivisions(good: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, parcel_id, subdivisions): of known parcels, in order of the file, as "45/а, 46/б"."""
    g = _of(good, "GORIMOTI", "IDENT", "OTDEL", "PODOTDEL").join(headers(parts).select("path", "ekatte"), "path")
    text = F.concat_ws("/", *(F.when(F.trim(c) != "", F.trim(c)) for c in ("otdel", "podotdel")))
    g = g.select("path", full_parcel_id(F.col("ekatte"), F.col("ident")).alias("parcel_id"), "line_no", text.alias("s")).where("s <> ''")
    g = g.groupBy("path", "parcel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), ", ").alias("subdivisions"))
    return g.join(parcels(good, parts).select("path", "parcel_id"), ["path", "parcel_id"], "left_semi")


def rights(good: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, parcel_id, right_ord, kind, person_id, person_name, heirs, doc1, doc2, term): rights of parcels that do not exist stay too."""
    r = _of(good, "PRAVA", "IDENT", "PERSON", "PRAVOVID", "DOCID1", "DOCID2", "SROK").join(headers(parts).select("path", "ekatte"), "path")
    r = r.withColumn("parcel_id", full_parcel_id(F.col("ekatte"), F.col("ident"))).withColumnRenamed("person", "person_id")
    r = r.join(persons(good).select("path", "person_id", "name", "heirs"), ["path", "person_id"], "left")
    return r.select("path", "parcel_id", F.col("line_no").alias("right_ord"), F.col("pravovid").alias("kind"), "person_id", F.coalesce("name", F.lit("")).alias("person_name"), F.coalesce("heirs", F.lit(False)).alias("heirs"), F.col("docid1").alias("doc1"), F.col("docid2").alias("doc2"), F.col("srok").alias("term"))


def newest(parcels_: DataFrame, rights_: DataFrame, modified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of one settlement put together: a parcel comes from the newest file that has it (of equals the first path), with
    its rights; rights without any parcel come from the newest file that has them."""
    age = F.struct(F.col("modified").alias("m"), F.col("path").alias("p"))
    order = Window.partitionBy("parcel_id").orderBy(F.col("modified").desc(), "path")
    won = parcels_.join(modified, "path").withColumn("i", F.row_number().over(order)).where("i = 1").drop("i", "modified")
    held = rights_.join(won.select("path", "parcel_id"), ["path", "parcel_id"], "left_semi")
    loose = rights_.join(won.select("parcel_id"), "parcel_id", "left_anti").join(modified, "path")
    last = loose.groupBy("parcel_id").agg(F.max(age).alias("age")).select("parcel_id", F.col("age.p").alias("path"))
    return won, held.unionByName(loose.drop("modified").join(last, ["parcel_id", "path"], "left_semi"))


def load_registers(rows: DataFrame) -> dict[str, DataFrame]:
    """All register tables of a DataFrame of lines. Files without a settlement code or without parcels are skipped, with the reason in `skipped`."""
    parts = saved(sections(rows), "parts")  # all tables read them
    raw = saved(table_rows(parts), "table-rows")
    good = good_rows(raw)
    modified = rows.select("path", "modified").distinct()
    head = modified.select("path").join(headers(parts), "path", "left")
    p = parcels(good, parts).where("ekatte <> ''")
    skipped = head.join(p.select("path").distinct().withColumn("has", F.lit(True)), "path", "left").where("has is null")
    skipped = skipped.select("path", F.when(F.coalesce("ekatte", F.lit("")) == "", "no settlement code").otherwise("no parcels").alias("reason"))
    r = rights(good, parts).join(skipped.select("path"), "path", "left_anti")
    won, held = newest(p, r, modified)
    return {"parcels": won, "rights": held, "persons": persons(good), "headers": headers(parts), "bad_records": bad_records(raw), "skipped": skipped}


def warnings(rows: DataFrame) -> DataFrame:
    """(path, line_no, table, reason, n): all that reading the lines met with, and went on; never what a row holds.

    A line of its own has its number and n 1: rows that do not fit their fields or have no key, contour areas that are no number, parcels listed
    again. The others are said of a file, with a null line_no and how many there are: another format version than VERSION, no settlement code, characters that the code page
    lacks, persons listed again with another name, rights of persons that are not listed.
    """
    parts = saved(sections(rows), "parts")
    raw = saved(table_rows(parts), "table-rows")
    good = good_rows(raw)
    files = rows.groupBy("path").agg(F.sum(undecodable(F.col("text"))).cast("long").alias("odd"))
    head = files.join(headers(parts), "path", "left")
    of_file = lambda df, reason, n=F.lit(1), table="": df.select("path", F.lit(None).cast("long").alias("line_no"), F.lit(table).alias("table"), F.lit(reason).alias("reason"), n.cast("long").alias("n"))
    of_line = lambda df, reason, table: df.select("path", "line_no", table.alias("table"), reason.alias("reason"), F.lit(1).cast("long").alias("n"))
    listed = _of(good, "POZEMLIMOTI", "IDENT")
    again = listed.withColumn("_i", F.row_number().over(Window.partitionBy("path", "ident").orderBy("line_no"))).where("_i > 1")
    who = persons(good)
    unknown = _of(good, "PRAVA", "PERSON").join(who.select("path", F.col("person_id").alias("person")), ["path", "person"], "left_anti")
    told = [
        of_file(head.where((F.col("version") != "") & (F.col("version") != VERSION)), "other format version"),
        of_file(head.where(F.coalesce("ekatte", F.lit("")) == ""), "no settlement code"),
        of_file(head.where("odd > 0"), "undecodable characters", F.col("odd")),
        of_file(who.where("names > 1").groupBy("path").agg(F.count(F.lit(1)).alias("n")), "repeated with another name", F.col("n"), "PERSONS"),
        of_file(unknown.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "person not listed", F.col("n"), "PRAVA"),
        of_line(contour_areas(parts).where("area_sqm is null"), F.lit("bad contour area"), F.lit("")),
        of_line(again, F.lit("repeated parcel"), F.lit("POZEMLIMOTI")),
        of_line(bad_records(raw), F.col("reason"), F.col("table")),
    ]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


def union_persons(persons_: DataFrame) -> DataFrame:
    """(ekatte, person_id): the persons of all files of a settlement, each once."""
    return persons_.select("ekatte", "person_id").distinct()
