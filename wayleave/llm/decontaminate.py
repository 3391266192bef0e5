"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of an item, or the whole item if it is shorter. Its tokens are its shingles of
`shingle` words. A document can only hold a window if it holds every token of it, so the necessary prefix of a window
is its rarest token. One pass over the documents notes where tokens of items occur (a bit map of fixed size lets other
words go by); their counts give the rarity order; the rarest token of each window is joined to its occurrences; the
window's offset and length bound where it can lie; and what is left is compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import as_row, save, text_or_empty, whole_rows
from wayleave.llm.textops import ALNUM, U, Words, mix, pieces

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % U(BITS)).astype(np.int64), (mix(h) % U(BITS)).astype(np.int64)


def _item_windows(window: int, shingle: int):
    """(item, wtext, len, k, off, h): each distinct token of each window; wtext are the window's words, parted by spaces."""
    lower, word = str.maketrans(UPPER, LOWER), re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, a in pieces(batch.column(1), 1 << 16):
                words = Words(a, ALNUM)
                by_k = {k: dict(zip(*reversed([x.tolist() for x in words.shingles(k)]), strict=True)) for k in range(1, shingle + 1)}
                items = batch.column(0).slice(at, len(a)).to_pylist()
                out: list[tuple] = []
                for i, text in enumerate(a.to_pylist()):
                    w, base = word.findall(text.translate(lower)), int(words.first[i])
                    if not w:
                        continue
                    size = min(window, len(w))
                    k = min(shingle, size)
                    for s in range(len(w) - size + 1):
                        out += [(items[i], " ".join(w[s : s + size]), size, k, j, by_k[k][base + s + j]) for j in range(size - k + 1)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int32()) for c in cols[2:5]), pa.array(np.array(cols[5], np.uint64).astype(np.int64))],
                        ["item", "wtext", "len", "k", "off", "h"],
                    )

    return run


def _scan(widths: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for batch in batches:
            for at, a in pieces(batch.column(2)):
                words = Words(a, ALNUM)
                row, pos, hashes = [], [], []
                for k in widths:
                    h, first = words.shingles(k)
                    p, q = _bits(h)
                    hit = np.flatnonzero((seen[p >> 3] >> (p & 7).astype(np.uint8)) & (seen[q >> 3] >> (q & 7).astype(np.uint8)) & 1)
                    first = first[hit]
                    row.append(words.doc[first])
                    pos.append(first - words.first[words.doc[first]])
                    hashes.append(h[hit].astype(np.int64))
                row, pos, hashes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, pos, hashes))
                order = np.argsort(row, kind="stable")
                per = np.bincount(row, minlength=len(a))
                hits = pa.StructArray.from_arrays([pa.array(pos[order].astype(np.int32)), pa.array(hashes[order])], ["pos", "h"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), hits)
                text = a.take(pa.array(np.arange(len(a)), mask=per == 0)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(a)), batch.column(1).slice(at, len(a)), pa.array(words.count.astype(np.int64)), lists, text], ["id", "th", "n_words", "hits", "text"])

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, part: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A-Z count as a-z; words are runs of ASCII letters, digits and non-ASCII characters. n_hit counts the words inside
    any occurrence of a window; contaminated: n_hit > 0 and part * n_hit >= n_words. Null texts have no words; items
    without words have no window; without items nothing is hit. Repeated rows each get their result, repeated items count
    once by their identifier, and an item without one is listed as an empty string. Texts may have any length; windows that
    occur several times or overlap count each word once. An empty table gives an empty result. Only the named columns are
    read, so others may have any name.
    """
    spark = docs.sparkSession
    tokens = save(items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_or_empty(item_text).alias("t")).mapInArrow(_item_windows(window, shingle), "item string, wtext string, len int, k int, off int, h long"), "windows")
    # The bit map is put together from its bytes: BITS / 8 rows at most, whatever the number of items.
    probes = tokens.select("h").distinct().mapInArrow(_probe, "w long, b int").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    seen = np.zeros(BITS >> 3, np.uint8)
    seen[probes["w"].to_numpy(np.int64)] = probes["b"].to_numpy(np.int64).astype(np.uint8)
    widths = sorted(r["k"] for r in tokens.select("k").distinct().collect())

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("t")).select("id", F.xxhash64("t").alias("th"), "t")
    scan = save(rows.mapInArrow(_scan(widths, spark.sparkContext.broadcast(seen)), "id long, th long, n_words long, hits array<struct<pos:int,h:long>>, text string"), "scan")
    key = ["id", "th"]
    some = scan.where(F.size("hits") > 0).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    at = some.select(*key, "n_words", F.explode("hits").alias("x")).select(*key, "n_words", "x.pos", "x.h").distinct()

    counts = at.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.select("wtext", "len", "off", "h").distinct().join(counts, "h", "left")
    prefix = ranked.groupBy("wtext", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("x")).where("x.df > 0").select("wtext", "len", "x.h", "x.off")
    near = at.join(prefix, "h").withColumn("start", F.col("pos") - F.col("off")).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    # A document's candidates come together, so that its words are taken apart once, not once for each of them.
    asked = near.groupBy(*key).agg(F.collect_set(F.struct("start", "len", "wtext")).alias("asked"))
    words = some.dropDuplicates(key).select(*key, F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    same = F.filter("asked", lambda x: F.array_join(F.slice("words", x["start"] + 1, x["len"]), " ") == x["wtext"])
    found = save(asked.join(words, key).select(*key, F.explode(same).alias("x")).select(*key, "x.start", "x.len", "x.wtext"), "found")

    end = F.col("start") + F.col("len")
    reach = F.max(end).over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy(*key, "start").agg(F.max("len").alias("len"))
    covered = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(reach, F.lit(0))))).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    named = found.select(*key, "wtext").distinct().join(tokens.select("wtext", "item").distinct(), "wtext").select(*key, "item").distinct()
    listed = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("list"))

    all_ = scan.select(F.col("id").alias("_given"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "th", "n_words").join(covered, key, "left").join(listed, key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_.select(
        F.col("_given").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(F.coalesce("list", F.lit("")), "UTF-8"), 256).alias("items_sha256"),
        ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("th").alias("row_hash"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that decontaminate() does not mark, with all their columns, whatever their names.

    What decontaminate() says of nulls, long texts, repeated rows and empty tables holds here: a row without words is kept,
    of repeated rows all or none are.
    """
    bad = decontaminate(docs, items, id_col=id_col, text_col=text_col, **how).where("contaminated")
    bad = save(bad.select(F.coalesce(f"`{id_col}`", F.lit(NO_ID)).alias("_id"), F.col("row_hash").alias("_th")).distinct(), "contaminated")
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    rows = docs.select(as_row(docs).alias("_row"), id_.alias("_id"), F.xxhash64(text_or_empty(f"`{text_col}`")).alias("_th"))
    return whole_rows(rows.join(bad, ["_id", "_th"], "left_anti"), docs)


#: Stands for a null identifier in joins.
NO_ID = -(1 << 63)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(b >> 3), pa.array((1 << (b & 7)).astype(np.int32))], ["w", "b"])
