"""Mixing sources to target weights by entropy balancing.

Sizes are counted once and summed to (source, size, number of documents). Each source gets a target: its weight's share
of all words, at most `cap` times what it has, with the excess reshared. Document rates are exponentially tilted:
rate = min(cap, exp(lambda * size / mean size)), one lambda for each source, and the convex dual of the token
constraints, sum(size * rate) = target, is solved by Newton steps kept inside a bracket. The sums are Spark
aggregations over the table of sizes, in exact decimals, so that reruns agree. Rates then become whole copies: documents
stand in order of size, a running sum of the rates is rounded, and of OFFSETS rounding offsets each source takes the one
whose words come nearest to its target. The running sum is two-level (blocks, then documents in a block), so that a source
that holds a large part of all documents spreads over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import as_row, join_hot, numbered, save, text_or_empty, whole_rows

WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
OFFSETS = 32
MILLION = 1_000_000
EXACT = "decimal(38,9)"
#: Newton steps of one job, and what a source carries from step to step.
STEPS = 5
STATE = ["ordinal", "mean", "target", "lam", "lo", "hi", "full", "done"]


def _targets(sources: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """(source, source_key, size, docs) -> plus target and ordinal.

    The level that fills all sources by weight rises until no source lies above its cap: each round is one aggregation
    to one row, and no round lowers the level. No task needs to see all sources.
    """
    s = numbered(sources, [F.col("source").asc_nulls_last(), F.col("source_key")], "ordinal")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("ordinal") - 1, F.lit(len(weights))).cast("int") + 1)
    s = save(s.withColumn("w", w.cast("long")).withColumn("most", cap * F.col("size")), "sources")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    level = 0.0
    while True:
        over = F.col("most").cast("double") < level * F.col("w")
        total = s.agg(exact(F.col("size")).alias("all"), exact(F.when(over, F.col("most"))).alias("full"), exact(F.when(~over, F.col("w"))).alias("w")).first()
        now = float(total["all"] - (total["full"] or 0)) / float(total["w"]) if total["w"] else level
        if now <= level:
            break
        level = now
    full = F.col("most").cast("double")
    return s.withColumn("target", F.least(full, level * F.col("w"))).select("source", "source_key", "size", "docs", "ordinal", "target")


def _rate(lam, x, cap: int):
    return F.when(lam * x >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(F.greatest(lam * x, F.lit(-60.0))))


def _stepped(hist: DataFrame, state: DataFrame, cap: int, tolerance: float) -> DataFrame:
    """One Newton step of every source: its words and their slope at lam, and lam moved, kept inside its bracket."""
    rated = hist.join(state, "ordinal").withColumn("rate", _rate(F.col("lam"), F.col("x"), cap))
    words = F.col("n") * F.col("size") * F.col("rate")
    slope = F.when(F.col("rate") < cap, words * F.col("x")).otherwise(F.lit(0.0))
    s = rated.groupBy(*STATE).agg(F.sum(words.cast(EXACT)).cast("double").alias("f"), F.sum(slope.cast(EXACT)).cast("double").alias("g"))
    s = s.withColumn("gap", F.col("f") - F.col("target"))
    s = s.withColumn("done", F.col("done") | (F.abs("gap") <= tolerance * F.greatest("target", F.lit(1.0))))
    s = s.withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
    newton = F.col("lam") - F.col("gap") / F.when(F.col("g") > 0, F.col("g"))
    inside = (newton > F.col("lo")) & (newton < F.col("hi"))
    halved = F.when(F.col("hi") >= 1e6, F.greatest(2 * F.abs("lam"), F.lit(1.0))).when(F.col("lo") <= -1e6, -F.greatest(2 * F.abs("lam"), F.lit(1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
    bounded = F.when(F.coalesce(inside, F.lit(False)) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs("lam"))), newton).otherwise(halved)
    return s.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(bounded)).select(*STATE)


def _tilts(sizes: DataFrame, targets: DataFrame, cap: int, tolerance: float = 1e-7, rounds: int = 12) -> DataFrame:
    """(ordinal, lam, mean) by Newton steps; a source at its cap has all rates at it (lam null). STEPS steps make one job, then one row says whether all are done."""
    t = targets.where("size > 0").withColumn("mean", F.col("size") / F.col("docs"))
    hist = sizes.join(t.select("source_key", "ordinal", "mean"), "source_key").where("size > 0").select("ordinal", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    hist = save(hist, "hist")
    full = F.col("target") >= F.col("size") * (cap - 1e-9)
    # The first lam gives a document of its source's mean size, weighted by words, the rate that all would need.
    typical = hist.groupBy("ordinal").agg((F.sum((F.col("n") * F.col("size") * F.col("x")).cast(EXACT)) / F.sum((F.col("n") * F.col("size")).cast(EXACT))).cast("double").alias("typical"))
    start = F.when(full, F.lit(0.0)).otherwise(F.log(F.col("target") / F.col("size")) / F.col("typical"))
    state = t.join(typical, "ordinal").select("ordinal", "mean", "target", start.alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), full.alias("full"), full.alias("done"))
    for _ in range(rounds):
        for _ in range(STEPS):
            state = _stepped(hist, state, cap, tolerance)
        state = save(state, "tilts")
        if state.where("not done").isEmpty():
            break
    return state.select("ordinal", "mean", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken, copies, row_hash.

    size is the number of words (null text: 0); sources stand in code point order, null last, and weigh as `weights`
    repeat. taken = size * copies, copies from 0 to cap. Texts without words have rate 1 and take nothing. A source without
    words has target 0. Rows that repeat are mixed each for itself; ties in size go by identifier, then by the text's
    hash (row_hash). Texts may have any length: one that is longer than its source's target may take all or none of it. An
    empty table gives an empty result. Reruns on the same rows agree. Only the named columns are read.
    """
    out = _mix(docs, weights, cap, id_col, text_col, source_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies", "row_hash")


def _source_key(source_col: str) -> Column:
    """Null sources are told from empty ones by a leading character."""
    c = F.col(f"`{source_col}`")
    return F.when(c.isNotNull(), F.concat(F.lit("="), c.cast("string"))).otherwise(F.lit("-"))


def _mix(docs: DataFrame, weights: tuple[int, ...], cap: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), _source_key(source_col).alias("source_key"), text_or_empty(f"`{text_col}`").alias("t"))
    rows = save(rows.select("id", "source", "source_key", F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("t").alias("row_hash")), "sizes")
    sizes = save(rows.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    sources = sizes.groupBy("source", "source_key").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs"))
    targets = save(_targets(sources, list(weights), cap), "targets")
    tilts = save(_tilts(sizes.select("source_key", "size", "n"), targets, cap), "tilts")

    # What a document's rate depends on, in millionths: one row for each source and size.
    x = F.col("size") / F.col("mean")
    class_ = F.floor(8 * F.log2(F.col("size") + 1)).cast("int")
    per_block = F.lit(max(256, math.isqrt(rows.count())))  # so that neither a block nor the list of blocks is long
    splits = sizes.withColumn("class", class_).groupBy("source_key", "class").agg((F.floor(F.sum("n") / per_block) + 1).alias("splits"))
    rated = sizes.select("source_key", "size", "n").withColumn("class", class_).join(splits, ["source_key", "class"]).join(targets.select("source_key", "ordinal", F.col("docs"), "target", F.col("size").alias("source_size")), "source_key").join(tilts, "ordinal", "left")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("lam"), x, cap))
    rated = rated.withColumn("rate", F.round(rate * MILLION).cast("long")).select("source_key", "ordinal", "size", "rate", "target", "source_size", "splits")

    # Blocks of a source: a size class (an eighth of an octave), split by the identifier's hash into as many as its rows ask for.
    work = join_hot(rows.drop("source"), save(rated, "rated"), ["source_key", "size"], ["id", "row_hash"], "inner").withColumn("class", class_)
    work = work.withColumn("split", F.pmod(F.xxhash64("id", "row_hash"), F.col("splits")).cast("int"))
    block = ["ordinal", "class", "split"]
    inner = Window.partitionBy(*block).orderBy("size", F.col("id").asc_nulls_last(), "row_hash")
    work = save(work.select("id", "row_hash", "source_key", *block, "size", "rate", "target", "source_size", F.sum("rate").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("run")), "rates")
    blocks = work.groupBy(*block).agg(F.sum("rate").alias("sum"))
    ahead = F.coalesce(F.sum("sum").over(Window.partitionBy("ordinal").orderBy(F.col("class").desc(), F.col("split").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*block, "sum", ahead.alias("ahead"))
    # Counted from the largest document down, so that what is left of the rounding falls on the small ones.
    work = work.join(blocks, block).withColumn("to", F.col("ahead") + F.col("sum") - F.col("run") + F.col("rate"))

    def copies(offset):
        # floor((to + offset) / MILLION) - floor((to - rate + offset) / MILLION), in whole numbers
        to = F.col("to") + offset
        return (F.col("rate") - F.pmod(to, F.lit(MILLION)) + F.pmod(to - F.col("rate"), F.lit(MILLION))) / MILLION

    work = save(work.select("id", "row_hash", "source_key", "ordinal", "size", "rate", "to", "target", "source_size"), "places")
    step = MILLION // OFFSETS
    words = work.groupBy("ordinal").agg(F.first("target").alias("target"), *(F.sum(F.round(F.col("size") * copies(F.lit(i * step))).cast("long")).alias(f"c{i}") for i in range(OFFSETS)))
    off = F.least(*(F.struct(F.abs(F.col(f"c{i}") - F.col("target")).alias("miss"), F.lit(i * step).alias("offset")) for i in range(OFFSETS)))
    chosen = words.select("ordinal", off["offset"].alias("offset"))
    out = join_hot(work, save(chosen, "offsets"), ["ordinal"], ["id", "row_hash"], "inner").withColumn("copies", F.round(copies(F.col("offset"))).cast("int"))
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes at least once, with all their columns and size, source_size, target, taken, copies of mix_sources().

    Columns of those five names are replaced, others stay, whatever their names. What mix_sources() says of nulls, ties,
    long texts and empty tables holds here. Rows that agree in identifier, text and source stand next to each other in the mix and
    so have one of two neighbouring numbers of copies; which of them has the larger one is left open.
    """
    key = ["_id", "_th", "_source"]
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("_id")
    mix = _mix(docs, weights, cap, id_col, text_col, source_col).select(F.coalesce("id", F.lit(-(1 << 63))).alias("_id"), F.col("row_hash").alias("_th"), F.col("source_key").alias("_source"), "size", "source_size", "target", "copies")
    same = F.count(F.lit(1)).alias("_rows"), F.min("copies").alias("_least"), F.sum("copies").alias("_all")
    rates = mix.groupBy(*key).agg(*same, *(F.first(c).alias(f"_{c}") for c in ("size", "source_size", "target"))).where("_all > 0")
    rows = docs.select(as_row(docs).alias("_row"), id_, F.xxhash64(text_or_empty(f"`{text_col}`")).alias("_th"), _source_key(source_col).alias("_source"))
    out = rows.join(rates, key).withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    more = F.col("_nth") <= F.col("_all") - F.col("_rows") * F.col("_least")
    out = out.withColumn("_copies", (F.col("_least") + F.when(more, F.lit(1)).otherwise(F.lit(0))).cast("int")).where("_copies > 0")
    out = out.withColumn("_taken", (F.col("_size") * F.col("_copies")).cast("long"))
    return whole_rows(out, docs, size="_size", source_size="_source_size", target="_target", taken="_taken", copies="_copies")
