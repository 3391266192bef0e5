"""Personal data: base patterns, and terms of their surroundings that give them away.

Base patterns find the protected entities. A term discloses an entity when the corpus says so: with n(e), n(t) and
n(e, t) the numbers of distinct texts that hold the entity, the term, and the term within CONTEXT characters of the
entity, PMI(e, t) = ln(N n(e, t) / (n(e) n(t))) is the information the term gives about the entity, out of IC(e) =
ln(N / n(e)). Terms with PMI >= threshold * IC, seen in at least `support` different surroundings, are spans of the
kind `term` wherever they occur. In the sanitised text entities are generalised to the name of their kind and such terms
are removed. Statistics cover all documents; only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import as_row, join_hot, save, text_or_empty, whole_rows

KINDS = ["email", "ip", "card", "phone", "term"]
# Starts of runs only (or where the last match ended), and possessive runs: the same matches, without retries inside a run
# and without recursion, so that runs may have any length.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
TERM = r"[\p{L}][\p{L}\p{N}'-]+"
CONTEXT = 60
NO_ID = -(1 << 63)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    r = F.reverse(digits)
    at = lambda i: F.substring(r, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, at(i)).otherwise(F.element_at(F.array(*map(F.lit, DOUBLED)), at(i) + 1)))
    return total % 10 == 0


def placed(rows: DataFrame, key: list[str], text: str, pattern: str | Column) -> DataFrame:
    """(key, start, end, match): where a pattern matches, leftmost and without overlap, in code points from 0. A document's matches are summed up in order of place, one row each; keys must be unique."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = rows.select(*key, F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, p, -1).alias("between")).where(F.size("m") > 0)
    parts = found.select(*key, F.posexplode(F.arrays_zip("between", "m")).alias("i", "z"))
    up_to = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.length("z.between") + F.coalesce(F.length("z.m"), F.lit(0))).over(up_to)).where(F.col("z.m").isNotNull())
    return parts.select(*key, (F.col("end") - F.length("z.m")).alias("start"), "end", F.col("z.m").alias("match"))


def base_spans(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, kind, start, end, match) of the base patterns; kind is its number in KINDS."""
    t = F.col(text)
    gates = {"email": F.contains(t, F.lit("@")), "ip": F.regexp_like(t, F.lit(r"[0-9]\.[0-9]+\.")), "card": F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), "phone": F.contains(t, F.lit("+"))}
    asked = F.filter(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(PATTERNS[k]).alias("p"), gates[k].alias("on")) for i, k in enumerate(KINDS[:4]))), lambda x: x["on"])
    tried = rows.withColumn("_a", asked).where(F.size("_a") > 0).select(*key, text, F.explode("_a").alias("a"))
    tried = tried.select(*key, text, F.col("a.kind").alias("kind"), F.col("a.p").alias("p"))
    found = placed(tried, [*key, "kind"], text, F.col("p"))
    digits = _digits(F.col("match"))
    ok = (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.regexp_like("match", F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
        .when(F.col("kind") == 2, F.length(digits).between(13, 19) & _luhn(digits))
        .otherwise(F.length(digits).between(9, 15))
    )
    return found.where(ok)


def _disclosing(texts: DataFrame, asked: DataFrame, spans: DataFrame, keys: DataFrame, threshold: float, support: int) -> DataFrame | None:
    """(term): the terms that disclose an entity; None if there are none.

    texts are all rows (_th, _t), keys their saved keys (_th), asked the distinct texts that may hold entities.
    Only texts that may hold entities are shuffled; of the others only those of their words that are terms in question.
    """
    value = F.when(F.col("kind") == 0, F.lower("match")).when(F.col("kind") == 1, F.col("match")).otherwise(_digits(F.col("match")))
    entity = spans.select("_th", "kind", value.alias("value"), "start", "end")
    often = save(entity.groupBy("kind", "value").agg(F.countDistinct("_th").alias("ne")).where(F.col("ne") >= support), "entities")
    if often.isEmpty():
        return None
    near = entity.join(often, ["kind", "value"]).join(asked, "_th")
    before = F.substring("_t", F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)), F.least("start", F.lit(CONTEXT)))
    after = F.substring("_t", F.col("end") + 1, F.lit(CONTEXT))
    around = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("\n", before, after)), F.lit(TERM), F.lit(0)))
    pairs = near.select("kind", "value", "ne", "_th", F.xxhash64(before, after).alias("place"), F.explode(around).alias("term"))
    pairs = pairs.groupBy("kind", "value", "ne", "term").agg(F.countDistinct("_th").alias("net"), F.countDistinct("place").alias("places")).where(F.col("places") >= support)
    pairs = save(pairs, "pairs")
    if pairs.isEmpty():
        return None
    n = keys.distinct().count()
    pmi = F.log(F.lit(float(n)) * F.col("net") / (F.col("ne") * F.col("nt")))

    def rated(pairs: DataFrame, among: DataFrame) -> DataFrame:
        counts = _words(among).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.countDistinct("_th").alias("nt"))
        return pairs.join(counts, "term").where((F.col("ne") < n) & (pmi >= threshold * F.log(F.lit(float(n)) / F.col("ne")))).drop("nt")

    # Common words fail already by how many of the few asked texts hold them; only the rest is counted over all texts.
    rated = rated(save(rated(pairs, asked), "pairs"), texts)
    terms = save(rated.select("term").distinct(), "terms")
    return None if terms.isEmpty() else terms


def _words(texts: DataFrame) -> DataFrame:
    return texts.select("_th", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(TERM), F.lit(0)))).alias("term"))


def text_key(t: Column) -> Column:
    """128 bits of the text's SHA-256: what tells texts apart."""
    return F.unhex(F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 32))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_or_empty(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_k"), text_key(t).alias("_th"), t.alias("_t"))


def _all_spans(keyed: DataFrame, rows: DataFrame, threshold: float, support: int) -> DataFrame:
    """(_th, kind, start, end) of each distinct text with spans; _th is the text's key. `rows` are the saved keys of all rows (_id, _k, _th)."""
    texts = keyed.select("_k", "_th", "_t")
    gated = F.regexp_like("_t", F.lit(r"@|\+|[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}"))
    asked = texts.where(gated).dropDuplicates(["_th"])
    base = save(base_spans(asked, ["_th"], "_t"), "base-spans")
    spans = base.select("_th", "kind", "start", "end")
    terms = _disclosing(texts, asked, base, rows.select("_th"), threshold, support)
    if terms is not None:
        holding = _words(texts).join(terms, "term", "left_semi").select("_th").distinct()
        held = join_hot(texts, save(holding, "holding"), ["_th"], ["_k"], "left_semi", counted=rows).dropDuplicates(["_th"])
        more = placed(held, ["_th"], "_t", TERM).withColumn("term", F.lower("match")).join(terms, "term", "left_semi")
        spans = spans.unionByName(more.select("_th", F.lit(4).alias("kind"), "start", "end"))
    return spans


def personal_data(docs: DataFrame, threshold: float = 0.8, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, row_hash.

    Spans are kind:start:end in code points, end exclusive, by kind in the order of KINDS, then by start, joined by commas.
    A null text counts as empty and has none; repeated rows each get their result; texts and runs of any length are looked
    through as a whole; where two terms or entities tie, both count; an empty table gives an empty result. Only the two
    named columns are read, so others may have any name.
    """
    keyed = _keyed(docs, id_col, text_col)
    rows = save(keyed.drop("_t"), "keys")
    spans = _all_spans(keyed, rows, threshold, support)
    names = F.array(*map(F.lit, KINDS))
    listed = spans.groupBy("_th").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("s"))
    out = join_hot(rows, save(listed, "listed"), ["_th"], ["_k"]).withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(
        F.col("_id").alias(id_col), *map(number, range(5)), F.sha2(F.encode(text(F.filter("s", lambda x: x["kind"] < 4)), "UTF-8"), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), F.col("_th").alias("row_hash")
    )


def sanitised(docs: DataFrame, threshold: float = 0.8, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `sanitised`: entities replaced by the name of their kind in brackets, disclosing terms removed; where spans overlap, the first counts.

    A null text becomes an empty one in it. Other columns stay as they are, whatever their names, but for one called
    sanitised, which is replaced. What personal_data() says of repeated rows, long texts, ties and empty tables holds here.
    """
    keyed = _keyed(docs, id_col, text_col)
    texts, keys = keyed.select("_th", "_t"), save(keyed.drop("_t"), "keys")
    spans = _all_spans(keyed, keys, threshold, support)
    order = Window.partitionBy("_th").orderBy("start", "kind")
    end = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = spans.withColumn("_e", F.coalesce(end, F.lit(0))).where(F.col("start") >= F.col("_e"))
    free = free.withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("last", F.lead("start").over(order).isNull())
    held = free.join(texts.dropDuplicates(["_th"]), "_th")
    label = F.when(F.col("kind") == 4, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]")))
    piece = F.concat(F.substring("_t", F.col("from") + 1, F.col("start") - F.col("from")), label, F.when(F.col("last"), F.substring("_t", F.col("end") + 1, F.length("_t"))).otherwise(F.lit("")))
    joined = held.groupBy("_th").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", piece.alias("p")))), lambda x: x["p"]), "").alias("_s"))
    t = text_or_empty(f"`{text_col}`")
    rows = docs.select(as_row(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"), text_key(t).alias("_th"), t.alias("_t"))
    out = join_hot(rows, save(joined, "sanitised"), ["_th"], ["_id"], counted=keys).withColumn("_clean", F.coalesce("_s", "_t"))
    return whole_rows(out, docs, sanitised="_clean")
