"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, one tree over the sources, and a proof for each row.

Slot pivot: the children of a node are `fanout` consecutive nodes below. A group-by of the parent's number spreads them into
`fanout` columns, one conditional aggregate each; the columns put together are what the parent's hash is of, and all but a child's
own column are that child's siblings, in those before and those behind it. So a level takes one group-by, a level has a
`fanout`th of the rows of the one below, and the siblings need no further join: each parent unfolds its own slots.

Going up, every level is written to the shared folder. Going down, each node hands its way to the root (siblings before and behind
at each level) to its children by (group, number), which spreads the rows of a large source like all others. Rows get their numbers in
their source from ranges over (source, identifier) and the counts of each range before; no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.llm.shared import partitions, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,behind:string>>"


def digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _field(c: Column) -> Column:
    """A null as -, else the number of bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*(_field(c) for c in fields)))


def _placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """nodes with `at`, their number from 0 in their group, and `of`, the group's size; without a task that sees a whole group."""
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), group, *order).withColumn("_range", F.spark_partition_id())
    ranged = save(ranged, "ranges")  # the ranges stay as they are, whatever is computed again
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))  # at most one row for each range and group
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(counts, [group, "_range"]).withColumn("at", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def _slots(nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """One row for each parent: group, up (its number), of (size of its level), the slot columns s0.. with (h and what is carried), and its hash."""
    slot = F.pmod("at", F.lit(fanout))
    child = F.struct("h", *carried)
    columns = [F.first(F.when(slot == k, child), ignorenulls=True).alias(f"s{k}") for k in range(fanout)]
    up = nodes.groupBy("g", F.floor(F.col("at") / fanout).alias("up"), F.floor((F.col("of") + fanout - 1) / fanout).alias("of")).agg(*columns)
    return up.withColumn("h", digest(F.concat(*(F.coalesce(f"s{k}.h", F.lit("")) for k in range(fanout)))))


def _unfolded(parents: DataFrame, fanout: int, carried: list[str], more: list[str]) -> DataFrame:
    """The children of each parent with their number, and with `way`: their siblings, followed by the parent's way."""
    child = []
    for k in range(fanout):
        side = [F.concat(F.lit(""), *(F.coalesce(f"s{j}.h", F.lit("")) for j in js)) for js in (range(k), range(k + 1, fanout))]
        way = F.concat(F.array(F.struct(side[0].alias("before"), side[1].alias("behind"))), F.col("way"))
        fields = [F.col(f"s{k}.{c}").alias(c) for c in ["h", *carried]]
        child.append(F.when(F.col(f"s{k}").isNotNull(), F.struct((F.col("up") * fanout + k).alias("at"), *fields, way.alias("way"))))
    return parents.select("g", *more, F.explode(F.array_compact(F.array(*child))).alias("c")).select("g", *more, "c.*")


def _grown(nodes: DataFrame, fanout: int, carried: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """nodes: (g, at, of, h, carried). The root of each group with more than one node (g, h), and the levels of parents from below."""
    levels, here = [], nodes.where("of > 1")
    most = nodes.agg(F.max("of")).first()[0] or 0
    while most > 1:
        parents = save(_slots(here, fanout, carried if not levels else []), "level")
        levels.append(parents)
        here = parents.where("of > 1").select("g", F.col("up").alias("at"), "of", "h")
        most = -(-most // fanout)
    roots = [p.where("of = 1").select("g", "h") for p in levels]
    top = nodes.where("of = 1").select("g", "h")
    for r in roots:
        top = top.unionByName(r)
    return top, levels


def _handed_down(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, carried: list[str], more: list[str]) -> DataFrame:
    """Every node with its way to the root. tops: (g, way, more) for each group's own root."""
    alone = nodes.where("of = 1").select("g", "at", "h", *carried).join(tops, "g")
    ways = None
    for i in reversed(range(len(levels))):
        own = carried if i == 0 else []
        ended = levels[i].where("of = 1").join(tops, "g")
        parents = ended if ways is None else ended.unionByName(levels[i].where("of > 1").join(ways, ["g", "up"]))
        below = _unfolded(parents, fanout, own, more)
        if i:
            ways = save(below.select("g", F.col("at").alias("up"), "way", *more), "ways")
        else:
            alone = alone.unionByName(below.select(*alone.columns))
    return alone


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", tampered: tuple[Column, dict[str, Column]] | None = None, fanout: int = 16
) -> DataFrame:
    """One row for each input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the row's fields; in each group (`group_col`) leaves ascend by identifier, a null one first. While a
    level has more than one node, each run of `fanout` has its hash above. A group of one row has that leaf as its subroot. The subroots, by the group's bytes,
    null first, make the root in the same way. proof_sha256 is the hash of all siblings from the leaf to the root. `tampered` is a condition and
    the columns changed where it holds; folded_root is what the leaf as it then is, and the row's own siblings, lead to, and verified says whether that is
    the root. Rows with one identifier in one group are ordered by their leaves, so that rows that repeat in full have places next to each other. Texts may have any length; empty
    ones differ from null. An empty table gives an empty result. Only the named columns are read, so others may have any name.
    """
    cols = {f: F.col(f"`{f}`") for f in fields}
    own = leaf(list(cols.values()))
    changed = F.lit(None).cast("string")
    if tampered:
        changed = F.when(tampered[0], leaf([tampered[1].get(f, c) for f, c in cols.items()]))
    group = F.col(f"`{group_col}`").cast("string")
    # A group's key puts null before all values and keeps their order by bytes.
    leaves = docs.select(F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("g"), F.col(f"`{id_col}`").alias("id"), own.alias("h"), changed.alias("changed"))
    rows = save(_placed(save(leaves, "leaves"), "g", ["id", "h"]), "placed")
    subroots, levels = _grown(rows, fanout, ["id", "changed"])

    over = subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h")
    over = save(_placed(over, "g", ["group"]), "subroots")
    roots, higher = _grown(over, fanout, ["group"])
    tops = roots.select("g", F.col("h").alias("root"), F.array().cast(STEP).alias("way"))
    tops = save(_handed_down(over, higher, tops, fanout, ["group"], ["root"]).select(F.col("group").alias("g"), F.col("h").alias("subroot"), "root", "way"), "tops")

    out = _handed_down(rows, levels, tops, fanout, ["id", "changed"], ["subroot", "root"])
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["behind"])), "")
    folded = F.aggregate("way", F.coalesce("changed", "h"), lambda h, s: digest(F.concat(s["before"], h, s["behind"])))
    out = out.select("*", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_cased(rows_of: Column, text: str = "text") -> tuple[Column, dict[str, Column]]:
    """Tampering that puts A-Z of the text in lower case, in the rows that `rows_of` names."""
    return rows_of, {text: F.translate(F.col(f"`{text}`"), UPPER, LOWER)}


def one_in_five(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")) % 5 == 0
