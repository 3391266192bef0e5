"""Phrase collocations: word pairs counted in tiles over frequency ranks, and frequent pairs ranked and paired again.

1. Words are counted by language. The RANKED most frequent words get their rank as number, other frequent words a 62-bit
   hash; those that are not frequent break the text, as no phrase with them can be frequent.
2. Texts become sequences of numbers. Neighbouring numbers are pairs. Pairs of ranks fall into tiles of TILE x TILE cells: tiles that many
   pairs of a buffer fall into are counted by direct address (one dense bincount over all of them), the others as sorted coordinates.
   Every task does so buffer by buffer; Spark adds the counts up by pair.
3. Frequent pairs are ranked in turn: a place now has the number of the frequent pair that begins there, and neighbouring
   pairs, which share a word, make phrases of three words; and so on up to the longest phrase.

What is broadcast for a level has a fixed size: RANKED hashes and ranks, and a bit map of BITS bits, which lets all other frequent units
by. Where it fills up, infrequent ones go by as well; they fall out when their pairs are counted. Tables of units and phrases stay in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import partitions, save, text_or_empty
from wayleave.llm.textops import LOWER, U, Words, mix, pieces, raw

RANKED, TILE, BITS = 1 << 18, 512, 1 << 24
#: Numbers in one buffer, in one row, and the least share of a tile's cells that makes it dense.
BUFFER, ROW, DENSE = 1 << 20, 1024, 0.25
BREAK = -1
_ENDS = np.array([b in b".,;:!?" or 0x0A <= b <= 0x0D for b in range(256)])
_IN_WORD = np.array([b not in b" \t" for b in range(256)]) & ~_ENDS
_HIGH = U(1) << U(62)


def _as_unit(h: np.ndarray) -> np.ndarray:
    """A hash of 62 bits above all ranks."""
    return ((h & (_HIGH - U(1))) | _HIGH).astype(np.int64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _as_unit(mix(a.astype(np.uint64) * U(0x9E3779B97F4A7C15) + mix(b.astype(np.uint64) ^ U(0xC2B2AE3D27D4EB4F))))


def _bit(units: np.ndarray) -> np.ndarray:
    return (mix(units.astype(np.uint64)) % U(BITS)).astype(np.int64)


class Level:
    """Numbers of the frequent units of one level, found by their hashes."""

    def __init__(self, ranked: np.ndarray, others: np.ndarray):
        """ranked: hashes in order of frequency; others: a bit map of the hashes of all other frequent units."""
        order = np.argsort(ranked, kind="stable")
        self.hashes, self.ranks, self.others = ranked[order], order.astype(np.int64), others

    def numbers(self, units: np.ndarray) -> np.ndarray:
        b = _bit(units)
        out = np.where((self.others[b >> 3] >> (b & 7).astype(np.uint8)) & 1, units, BREAK)
        if self.hashes.size:
            at = np.minimum(np.searchsorted(self.hashes, units), self.hashes.size - 1)
            out = np.where(self.hashes[at] == units, self.ranks[at], out)
        return out


def tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers and how often each occurs."""
    near = (a < RANKED) & (b < RANKED)
    p, q = a[near], b[near]
    tile = (p // TILE) * (RANKED // TILE) + q // TILE
    dense = np.bincount(tile, minlength=(RANKED // TILE) ** 2) >= DENSE * TILE * TILE
    inside = dense[tile]
    tiles = np.flatnonzero(dense)
    cells = (np.cumsum(dense) - 1)[tile[inside]] * TILE * TILE + (p[inside] % TILE) * TILE + q[inside] % TILE
    n = np.bincount(cells, minlength=tiles.size * TILE * TILE)
    cell = np.flatnonzero(n)
    home, cell_a, cell_b = tiles[cell // (TILE * TILE)], cell // TILE % TILE, cell % TILE
    per = RANKED // TILE
    out = [(home // per * TILE + cell_a, home % per * TILE + cell_b, n[cell])]

    code, n = np.unique(p[~inside] * RANKED + q[~inside], return_counts=True)
    out.append((code // RANKED, code % RANKED, n))

    p, q = a[~near], b[~near]
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])[: p.size])
    out.append((p[new], q[new], np.diff(np.append(new, p.size))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _words(langs: pa.Array, a: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a slice, their hashes with the language, and whether a piece begins with each."""
    w = Words(a, _IN_WORD)
    coded = langs.dictionary_encode()
    of = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    units = _as_unit(mix(w.hash ^ of[coded.indices.to_numpy()[w.doc]])) if w.hash.size else np.zeros(0, np.int64)
    begins = np.ones(w.hash.size, bool)
    if w.hash.size:
        ends = np.cumsum(_ENDS[raw(a)[0]])[w.starts]
        begins[1:] = (w.doc[1:] != w.doc[:-1]) | (ends[1:] != ends[:-1])
    return w, units, begins


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, a in pieces(batch.column(1), 1 << 20):
            langs = batch.column(0).slice(at, len(a))
            w, units, _ = _words(langs, a)
            unit, first, n = np.unique(units, return_index=True, return_counts=True)
            size = w.size[first]
            ends = np.cumsum(size)
            place = np.arange(int(size.sum())) + np.repeat(w.starts[first] - (ends - size), size)
            text = LOWER[raw(a)[0][place]].tobytes()
            words = pa.LargeStringArray.from_buffers(unit.size, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(w.doc[first])), words, pa.array(unit), pa.array(n.astype(np.int64))], ["lang", "word", "unit", "n"])


def _rows(ids: np.ndarray) -> pa.RecordBatch | None:
    """ids in rows cut at breaks; only runs of two and more stay."""
    on = np.concatenate([[False], ids >= 0, [False]])
    keep = on[1:-1] & (on[:-2] | on[2:])
    after = np.concatenate([[False], keep[:-1]])
    ids = ids[keep | after]  # each run, and the place behind it
    ids = np.where(keep[keep | after], ids, BREAK)
    if not ids.size:
        return None
    breaks = np.flatnonzero(ids == BREAK)
    cuts = breaks[np.flatnonzero(np.diff(breaks // ROW, prepend=0))] + 1
    offsets = np.unique(np.concatenate([[0], cuts, [ids.size]])).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["ids"])


def _first_level(level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = level.value
        for batch in batches:
            for at, a in pieces(batch.column(1), 1 << 20):
                _, units, begins = _words(batch.column(0).slice(at, len(a)), a)
                ids = np.insert(known.numbers(units), np.flatnonzero(begins), BREAK)
                if (out := _rows(ids)) is not None:
                    yield out

    return run


def _flat(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """All rows of a batch with a break behind each, about BUFFER numbers at a time."""
    lists = batch.column(0)
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    ids, at = lists.flatten().to_numpy(), 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BUFFER, side="right")))
        yield np.insert(ids[base : ends[to - 1]], ends[at:to] - base, BREAK)
        at = to


def _next_level(level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = level.value
        for ids in (x for batch in batches for x in _flat(batch)):
            whole = (ids[1:] >= 0) & (ids[:-1] >= 0)
            up = np.full(ids.size, BREAK)
            up[:-1][whole] = known.numbers(pair_hash(ids[:-1][whole], ids[1:][whole]))
            if (out := _rows(up)) is not None:
                yield out

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        ids = np.concatenate(waiting)
        whole = (ids[1:] >= 0) & (ids[:-1] >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in tally(ids[:-1][whole], ids[1:][whole])], ["a", "b", "n"])

    for ids in (x for batch in batches for x in _flat(batch)):
        waiting.append(ids)
        size += ids.size
        if size >= BUFFER:
            yield counted()
            waiting, size = [], 0
    if size:
        yield counted()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = _bit(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(b >> 3), pa.array((1 << (b & 7)).astype(np.int32))], ["w", "b"])


def _level(units: DataFrame, ranked: int) -> Level:
    """units: (unit, f), saved. Ranks for whole classes of frequency from the top, as long as they hold no more than `ranked` units."""
    grade = F.floor(F.log2("f") * 64)
    least, so_far = None, 0
    for r in sorted(units.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # some 64 rows for each doubling
        so_far += r["count"]
        if so_far > ranked:
            break
        least = r["grade"]
    top = units.where(grade >= least).toPandas() if least is not None else units.limit(0).toPandas()  # `ranked` rows at most
    unit, f = top["unit"].to_numpy(np.int64), top["f"].to_numpy(np.int64)
    others = units.where(grade < least) if least is not None else units
    bits = others.select("unit").mapInArrow(_probe, "w long, b int").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # BITS / 8 rows at most
    seen = np.zeros(BITS >> 3, np.uint8)
    seen[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64).astype(np.uint8)
    return Level(unit[np.lexsort((unit, -f))], seen)


def _numbered(level):
    """The number of each unit of a table, in place of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(0, "unit", pa.array(level.value.numbers(batch.column(0).to_numpy())))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(a.to_numpy(), b.to_numpy())), a, b, batch.column(2)], ["unit", "a", "b", "f"])


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; texts are cut at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words. a is how often
    the phrase of 2 to `longest` words occurs within pieces (at least `least` times, overlaps included), n the number of words of its language. Of the cuts into two parts, which occur
    l and r times, the one with the least floor(1000 a n / (l r)) gives the score, the first one of several. A phrase that stands in a longer
    one of up to `longest` words that occurs as often is left out. Ranks go by score, then a, both descending, then the phrase's bytes. Null texts have no words; a
    null language counts as `und`; repeated rows count each time. Texts may have any length. A language without phrases has no rows, nor has an empty table. Only the
    two named columns are read, so others may have any name. `ranked` (up to RANKED) says how many units of a level get ranks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(f"`{text_col}`").alias("t"))
    words = save(rows.mapInArrow(_vocabulary, "lang string, word string, unit long, n long").groupBy("lang", "word", "unit").agg(F.sum("n").alias("f")), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least).select("unit", "f", "lang", "word")

    level = _level(often.select("unit", "f"), ranked)
    told = spark.sparkContext.broadcast(level)
    here = save(often.mapInArrow(_numbered(told), "unit long, f long, lang string, word string"), "units")
    phrases = here.select("unit", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    ids = save(rows.mapInArrow(_first_level(told), "ids array<long>"), "ids")

    found: list[DataFrame] = []
    for size in range(2, longest + 1):
        counts = ids.mapInArrow(_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        units = save(counts.mapInArrow(_hashed, "unit long, a long, b long, f long"), "pairs")
        told = spark.sparkContext.broadcast(_level(units.select("unit", "f"), ranked))
        numbered = units.mapInArrow(_numbered(told), "unit long, a long, b long, f long")
        head = phrases.select(F.col("unit").alias("a"), "lang", "phrase", "heads")
        tail = phrases.select(F.col("unit").alias("b"), "last", "tails")
        grown = numbered.join(head, "a").join(tail, "b")
        grown = grown.select("unit", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", *(F.concat(c, F.array("f")).alias(c) for c in ("heads", "tails")), "f")
        phrases = save(grown, "phrases")
        found.append(phrases)
        if size < longest:
            ids = save(ids.mapInArrow(_next_level(told), "ids array<long>"), "ids")

    scored = []
    for i, p in enumerate(found):
        if i + 1 < len(found):  # a phrase within a longer one that occurs as often is also within one that is a word longer
            longer = found[i + 1]
            inside = longer.select(F.col("a").alias("unit"), F.col("f").alias("_f")).unionByName(longer.select(F.col("b").alias("unit"), F.col("f").alias("_f")))
            p = p.join(inside.groupBy("unit").agg(F.max("_f").alias("_f")), "unit", "left").where(F.col("_f").isNull() | (F.col("_f") < F.col("f")))
        p = p.join(total, "lang")
        cuts = []
        for k in range(1, i + 2):
            l, r = F.col("heads")[k - 1], F.col("tails")[i + 1 - k]
            score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(16,0)") * F.col("n").cast("decimal(16,0)"), l.cast("decimal(19,0)") * r.cast("decimal(18,0)"))
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        best = F.array_min(F.array(*cuts))
        scored.append(p.select("lang", "phrase", F.col("f").alias("a"), best.alias("c"), "n").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"))
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)

    # The first `top` of each part of a language, then of the language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark)))
    for keys in ([F.col("lang"), part], [F.col("lang")]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
