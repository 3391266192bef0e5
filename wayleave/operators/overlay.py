"""Areas that polygons share: a grid-cell equi-join around a vectorised kernel.

Each ring is halved again and again until its pieces lie in one cell each, so a long corridor becomes as many small fragments as it
touches cells, whatever its box. Fragments
meet in an equi-join on the cell; cells are disjoint, so the areas of a pair of shapes are a plain sum over its fragments
and no pair has to be made distinct. Shapes whose few cells hold no fragment of the other side are left out before they are
cut. The area of two fragments is a sum over pairs of their edges: each edge spans a
signed triangle with the cell's corner, and the triangles' overlap is what lies below the nearer edge in the common angle.
That holds for any simple ring, concave or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayleave.sources.saved import saved

SLIVER = 0.001
VERTEX = "array<struct<x:double,y:double>>"


def by_cell(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of rows that were dealt to cells. Spark takes their size for that of the table they come from, however many each row became, and would send all of a side through the driver; so neither side is broadcast."""
    return a.join(b.hint("merge"), on, how)


def _half(ring: np.ndarray, axis: int, bound: float, sign: int) -> np.ndarray:
    """The part of a ring on one side of an axis-parallel line."""
    d = sign * (ring[:, axis] - bound)
    before, d0 = np.roll(ring, 1, axis=0), np.roll(d, 1)
    crosses, stays = (d >= 0) != (d0 >= 0), d >= 0
    both = np.empty((len(ring), 2, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        both[:, 0] = before + (ring - before) * (d0 / (d0 - d))[:, None]
    both[:, 0, axis] = bound
    both[:, 1] = ring
    return both[np.column_stack([crosses, stays])]


def _spans(low: np.ndarray, high: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last cell of intervals; one that ends on a line between cells does not reach the next one."""
    first = np.floor(low / cell).astype(np.int64)
    return first, np.maximum(np.ceil(high / cell).astype(np.int64) - 1, first)


def cut(ring: np.ndarray, cell: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, piece) of a ring in every cell that it has an area in. Halves without area are left at once."""
    wait = [ring]
    while wait:
        r = wait.pop()
        nxt = np.roll(r, -1, axis=0)
        o = r[0]
        if len(r) < 3 or not abs(((r[:, 0] - o[0]) * (nxt[:, 1] - o[1]) - (nxt[:, 0] - o[0]) * (r[:, 1] - o[1])).sum()) > 0:
            continue
        (x0, y0), (x1, y1) = _spans(r.min(axis=0), r.max(axis=0), cell)
        if x0 == x1 and y0 == y1:
            yield int(x0), int(y0), r
        else:
            axis = int(y1 - y0 > x1 - x0)
            bound = (((y0 + y1 if axis else x0 + x1) + 1) // 2) * cell
            wait += [_half(r, axis, bound, -1), _half(r, axis, bound, 1)]


def ring_sizes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of rings given by their vertices one after another."""
    first = np.cumsum(size) - size
    nxt = _rolled(flat, size, first)
    return np.abs(np.bincount(np.repeat(np.arange(len(size)), size), _cross(flat, nxt), minlength=len(size))) / 2


def _fragments(cell: float, share: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "ring"]
            rings = batch.column("ring")
            size = np.diff(rings.offsets.to_numpy())
            flat = rings.flatten()
            xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            if not len(size):
                continue
            first = np.cumsum(size) - size
            low, high = np.minimum.reduceat(xy, first), np.maximum.reduceat(xy, first)
            from_, to = _spans(low, high, cell)
            alone = (from_ == to).all(axis=1)  # in one cell as they are
            keep, at, parts = [np.flatnonzero(alone)], [from_[alone]], []
            mine = np.repeat(alone, size)
            parts.append((xy - np.repeat(from_, size, axis=0) * cell)[mine].reshape(-1))
            sizes = [2 * size[alone]]
            for row in np.flatnonzero(~alone):
                for cx, cy, piece in cut(xy[first[row] : first[row] + size[row]], cell):
                    keep.append([row])
                    at.append([(cx, cy)])
                    sizes.append([2 * len(piece)])
                    parts.append((piece - (cx * cell, cy * cell)).reshape(-1))
            at, sizes = np.concatenate(at).astype(np.int64), np.concatenate(sizes).astype(np.int64)
            taken = batch.select(names).take(pa.array(np.concatenate(keep).astype(np.int64)))
            flat_parts = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat_parts))
            more = [pa.array(ring_sizes(flat_parts.reshape(-1, 2), sizes // 2) / cell**2)] if share else []
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at[:, 0]), pa.array(at[:, 1]), lists, *more], [*names, "cx", "cy", "part", *["share"] * share])

    return run


def fragments(shapes: DataFrame, cell: float, share: bool = False) -> DataFrame:
    """shapes with a column ring -> its other columns, cx, cy and part (x and y by turns, from the cell's corner), and the share of the cell that it covers if asked for. Rings of under three vertices give nothing."""
    shapes = shapes.where(F.size("ring") > 2).withColumn("ring", F.col("ring").cast(VERTEX))
    kinds = dict(shapes.dtypes)
    return shapes.mapInArrow(_fragments(cell, share), ", ".join(f"`{c}` {k}" for c, k in kinds.items() if c != "ring") + ", cx long, cy long, part array<double>" + ", share double" * share)


#: A cell with more pairs of fragments than this, and more than WASTE times those that the shapes' own depth explains, is cut in four, LEVELS times at most.
PAIRS, WASTE, LEVELS = 4096, 16, 8


def _quarters(half: float, width: int, cut_, size_of):
    """Fragments (from their cell's corner, of twice the width `half`) cut to the four cells that theirs falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ("cx", "cy", "part", "share")
            names = [n for n in batch.schema.names if n not in own]
            cx, cy = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cx", "cy"))
            keep, at, parts, shares = [], [], [], []
            for row, part in enumerate(batch.column(batch.schema.get_field_index("part"))):
                ring = np.array(part.as_py()).reshape(-1, width)
                for i, j, piece in cut_(ring, half):
                    corner = np.zeros(width)
                    corner[:2] = i * half, j * half
                    keep.append(row)
                    at.append((2 * cx[row] + i, 2 * cy[row] + j))
                    parts.append((piece - corner).reshape(-1))
                    shares.append(size_of(piece) / half**2)
            if keep:
                where = np.array(at, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([p.size for p in parts])).astype(np.int32)), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(keep)).columns, pa.array(where[:, 0]), pa.array(where[:, 1]), lists, pa.array(shares)], [*names, *own])

    return run


def refined(a: DataFrame, b: DataFrame, on: list[str], cell: float, width: int = 2, cut_=cut, size_of=lambda ring: float(ring_sizes(ring, np.array([len(ring)]))[0])) -> tuple[DataFrame, DataFrame]:
    """Fragments of two sides (saved) with `lv`: where many meet in a cell without lying upon each other, as in a dense town, the cell is cut in four, again and again.

    How much of a cell each side covers in all (the sum of share) is how deep its shapes lie there; pairs that come from that depth would only be multiplied by cutting. So a
    cell ends with about PAIRS pairs, or with little more than the pairs that overlap. Areas add up over cells of any size.
    """
    a, b = a.withColumn("lv", F.lit(0)), b.withColumn("lv", F.lit(0))
    key = [*on, "cx", "cy"]
    for level in range(LEVELS):
        told = lambda df, n: df.where(F.col("lv") == level).groupBy(*key).agg(F.count(F.lit(1)).alias(f"n{n}"), F.sum("share").alias(f"d{n}"))  # noqa: B023, E731
        pairs, deep = F.col("na") * F.col("nb"), F.greatest("da", F.lit(1.0)) * F.greatest("db", F.lit(1.0))
        dense = saved(by_cell(told(a, "a"), told(b, "b"), key).where((pairs > PAIRS) & (pairs > WASTE * deep)).select(*key, F.lit(level).alias("lv")), "dense")
        if dense.isEmpty():
            break
        half = cell / 2 ** (level + 1)

        def parted(df: DataFrame) -> DataFrame:
            kinds = dict(df.dtypes)
            own = ("cx", "cy", "part", "share")
            rest = [c for c in df.columns if c not in own]
            some = df.join(dense, [*key, "lv"], "left_semi").select(*rest, *own)  # noqa: B023
            finer = some.mapInArrow(_quarters(half, width, cut_, size_of), ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, *own])).withColumn("lv", F.lit(level + 1))  # noqa: B023
            return saved(df.join(dense, [*key, "lv"], "left_anti").unionByName(finer), "finer")  # noqa: B023

        a, b = parted(a), parted(b)
    return a, b


#: Shapes of at most so many cells are looked up by them before they are cut.
FEW_CELLS = 16


def _near(shapes: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Without the shapes of few cells that have none of the cells."""
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda c: F.sequence(F.floor(F.array_min(c) / cell), F.greatest(F.ceil(F.array_max(c) / cell) - 1, F.floor(F.array_min(c) / cell)))
    count = lambda c: F.ceil(F.array_max(c) / cell) - F.floor(F.array_min(c) / cell)
    rows = shapes.where(F.size("ring") > 2).withColumn("_few", F.greatest(count(x), F.lit(1)) * F.greatest(count(y), F.lit(1)) <= FEW_CELLS)
    few = rows.where("_few").withColumn("_n", F.monotonically_increasing_id())
    at = few.withColumn("cx", F.explode(span(x))).withColumn("cy", F.explode(span(y)))
    at = by_cell(at, cells, ["cx", "cy"], "left_semi").drop("cx", "cy")
    return at.dropDuplicates(["_n"]).drop("_n", "_few").unionByName(rows.where("not _few").drop("_few"))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def edge_overlaps(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Signed overlaps of the triangles (0, a1, a2) and (0, b1, b2), row by row."""
    sa, sb = _cross(a1, a2), _cross(b1, b2)
    sign = np.sign(sa) * np.sign(sb)
    out = np.zeros(len(a1))
    live = np.flatnonzero(sign)
    a1, a2, b1, b2, sa, sb = (v[live] for v in (a1, a2, b1, b2, sa, sb))
    turn = lambda p, q, s: (np.where((s < 0)[:, None], q, p), np.where((s < 0)[:, None], p, q))
    (a1, a2), (b1, b2) = turn(a1, a2, sa), turn(b1, b2, sb)
    within = lambda p, u, v: (_cross(u, p) >= 0) & (_cross(p, v) >= 0)
    u = np.where(within(a1, b1, b2)[:, None], a1, b1)
    v = np.where(within(a2, b1, b2)[:, None], a2, b2)
    ok = within(u, a1, a2) & within(u, b1, b2) & within(v, a1, a2) & within(v, b1, b2) & (_cross(u, v) > 0)
    live, a1, a2, b1, b2, u, v = (w[ok] for w in (live, a1, a2, b1, b2, u, v))
    reach = lambda p, q, d: _cross(p, q - p) / _cross(d, q - p)
    au, bu, av, bv = reach(a1, a2, u), reach(b1, b2, u), reach(a1, a2, v), reach(b1, b2, v)
    near_u, near_v = np.minimum(au, bu)[:, None] * u, np.minimum(av, bv)[:, None] * v
    area = _cross(near_u, near_v) / 2
    crossing = (au - bu) * (av - bv) < 0
    if crossing.any():
        p, d, q, e = a1[crossing], (a2 - a1)[crossing], b1[crossing], (b2 - b1)[crossing]
        x = p + (_cross(q - p, e) / _cross(d, e))[:, None] * d
        area[crossing] = (_cross(near_u[crossing], x) + _cross(x, near_v[crossing])) / 2
    out[live] = area * sign[live]
    return out


def _rolled(flat: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The next vertex of each vertex of its ring."""
    nxt = np.arange(len(flat)) + 1
    nxt[first + size - 1] = first
    return flat[nxt]


def shared_areas(parts_a: pa.Array, parts_b: pa.Array) -> np.ndarray:
    """Area shared by the fragments of each row."""

    def read(parts: pa.Array):
        size = np.diff(parts.offsets.to_numpy()) // 2
        flat = parts.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        first = np.cumsum(size) - size
        return flat, _rolled(flat, size, first), size, first

    (pa1, pa2, na, fa), (pb1, pb2, nb, fb) = read(parts_a), read(parts_b)
    pairs = na * nb
    row = np.repeat(np.arange(len(pairs)), pairs)
    k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = fa[row] + k // nb[row], fb[row] + k % nb[row]
    return np.abs(np.bincount(row, edge_overlaps(pa1[i], pa2[i], pb1[j], pb2[j]), minlength=len(pairs)))


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            area = shared_areas(b.column(b.schema.get_field_index("part_a")).take(pa.array(np.arange(b.num_rows))), b.column(b.schema.get_field_index("part_b")).take(pa.array(np.arange(b.num_rows))))
            rest = b.select([n for n in b.schema.names if n not in ("part_a", "part_b")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(area)], [*rest.schema.names, "sqm"])


def _has_arcs(shapes: DataFrame) -> bool:
    return "bulge" in shapes.schema["ring"].dataType.elementType.fieldNames()


def overlap_areas(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], on: list[str] | None = None, cell: float = 50.0, least: float = SLIVER, where: Column | None = None) -> DataFrame:
    """(keys_a, keys_b, sqm): shared area of every pair of shapes with more than `least`; `on` names columns that must agree besides, `where` says which pairs of keys count.

    Key columns of a and b must have different names, but for those in `on`. Fragments of one shape add up; shapes with
    one key are one shape. Where the vertices of a or b have a bulge, their arcs are taken as they are (curved.curved_areas).
    """
    if _has_arcs(a) or _has_arcs(b):
        from wayleave.operators import curved

        as_bent = lambda df: df if _has_arcs(df) else df.withColumn("ring", curved.bent(F.col("ring")))
        return curved.curved_areas(as_bent(a), as_bent(b), keys_a, keys_b, on, cell, least, where)
    on = on or []
    fa = saved(fragments(a.select(*on, *keys_a, "ring"), cell, True), "fragments")
    asked = b.select(*on, *keys_b, "ring")
    if not on:
        asked = _near(asked, fa.select("cx", "cy").distinct(), cell)
    fa, fb = refined(fa, saved(fragments(asked, cell, True), "fragments"), on, cell)
    met = by_cell(fa.drop("share").withColumnRenamed("part", "part_a"), fb.drop("share").withColumnRenamed("part", "part_b"), [*on, "lv", "cx", "cy"])
    met = (met if where is None else met.where(where)).select(*on, *keys_a, *keys_b, "part_a", "part_b")
    kinds = dict(met.dtypes)
    names = [*on, *keys_a, *keys_b]
    areas = met.mapInArrow(_areas, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sqm double")
    return areas.groupBy(*names).agg(F.sum("sqm").alias("sqm")).where(F.col("sqm") > least)


def ring_area(ring) -> F.Column:
    """Area of a ring, by the shoelace from its first vertex."""
    p = lambda i: F.element_at(ring, i)
    o = p(F.lit(1))
    term = lambda i: (p(i)["x"] - o["x"]) * (p(i + 1)["y"] - o["y"]) - (p(i + 1)["x"] - o["x"]) * (p(i)["y"] - o["y"])
    return F.when(F.size(ring) > 2, F.aggregate(F.sequence(F.lit(2), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2).otherwise(F.lit(0.0))


def box_parts(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], cell: float = 50.0, least: float = SLIVER) -> DataFrame:
    """(keys_a, keys_b, x0, y0, x1, y1): the common part of axis-parallel boxes, with built-in expressions only.

    A pair that meets in several cells counts in the cell that holds the lower corner of its common part.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    def spread(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        rows = df.select(*keys, *(F.col(c).alias(f"{c}{tag}") for c in ("x0", "y0", "x1", "y1")))
        return rows.withColumn("cx", F.explode(cells(f"x0{tag}", f"x1{tag}"))).withColumn("cy", F.explode(cells(f"y0{tag}", f"y1{tag}")))

    met = by_cell(spread(a, keys_a, "a"), spread(b, keys_b, "b"), ["cx", "cy"])
    x0, y0, x1, y1 = F.greatest("x0a", "x0b"), F.greatest("y0a", "y0b"), F.least("x1a", "x1b"), F.least("y1a", "y1b")
    met = met.where((x1 > x0) & (y1 > y0) & (F.col("cx") == F.floor(x0 / cell)) & (F.col("cy") == F.floor(y0 / cell)) & ((x1 - x0) * (y1 - y0) > least))
    return met.select(*keys_a, *keys_b, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_overlaps(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], cell: float = 50.0, least: float = SLIVER) -> DataFrame:
    """overlap_areas() for axis-parallel boxes."""
    part = box_parts(a, b, keys_a, keys_b, cell, least)
    return part.select(*keys_a, *keys_b, ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("sqm"))
