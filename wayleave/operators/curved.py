"""Areas that shapes with arcs share, without straightening them: the cell join of overlay.py with arcs as edges of their own.

An arc is cut where its circle turns (its leftmost, rightmost, highest and lowest point) and where it crosses a line between cells, so
that each piece lies in one cell, and rings are then halved as straight ones are. Within a cell every edge, straight or bent, spans a signed
sector with the cell's corner; pieces of arcs are cut once more where a ray from the corner touches their circle, so that a ray meets each at most
once. Two sectors share what lies below the nearer edge in their common angle: that angle is parted where the two edges
cross, and in each part the nearer edge's sector is a triangle, or a triangle and a circular segment. So areas are closed
forms, exact but for rounding, with no chords and no bound to choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayleave.operators.overlay import FEW_CELLS, SLIVER, _cross, _rolled, _spans, by_cell, edge_overlaps, refined
from wayleave.sources.saved import saved

VERTEX = "array<struct<x:double,y:double,bulge:double>>"
#: Arcs flatter than this are straight: they rise less than a millionth of a millionth of their chord.
FLAT = 1e-12
#: So near to a cell's corner, in metres, the direction of a point says nothing.
CORNER = 1e-8


def circle(p: np.ndarray, q: np.ndarray, bulge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of the arcs from p to q."""
    d = q - p
    off = (1 / bulge - bulge) / 4
    c = (p + q) / 2 + np.column_stack([-d[:, 1], d[:, 0]]) * off[:, None]
    return c, np.hypot(*(p - c).T)


def arc_cuts(p: np.ndarray, q: np.ndarray, bulge: float, cell: float) -> np.ndarray:
    """(x, y, bulge) of the pieces of an arc, each in one cell and bent within one quarter; the first row is p, the end is left out."""
    (c,), (r,) = circle(p[None], q[None], np.array([bulge]))
    start, sweep = np.arctan2(*(p - c)[::-1]), 4 * np.arctan(bulge)
    angles = [np.arange(4) * np.pi / 2]
    fixed = [np.full((4, 2), np.nan)]
    for axis in (0, 1):
        lines = np.arange(np.ceil((c[axis] - r) / cell), np.floor((c[axis] + r) / cell) + 1) * cell
        lines = lines[np.abs(lines - c[axis]) < r]
        turn = np.arccos(np.clip((lines - c[axis]) / r, -1, 1))
        for a in (turn, -turn) if axis == 0 else (np.pi / 2 - turn, np.pi / 2 + turn):
            on = np.full((lines.size, 2), np.nan)
            on[:, axis] = lines  # exactly on the line, whatever sine and cosine say
            angles.append(a)
            fixed.append(on)
    angle, on = np.concatenate(angles), np.concatenate(fixed)
    part = np.mod((angle - start) * np.sign(sweep), 2 * np.pi) / abs(sweep)
    inside = (part > 1e-12) & (part < 1 - 1e-12)
    part, on, order = part[inside], on[inside], np.argsort(part[inside], kind="stable")
    part, on = part[order], on[order]
    at = start + part * sweep
    point = np.where(np.isnan(on), c + r * np.column_stack([np.cos(at), np.sin(at)]), on)
    steps = np.diff(np.concatenate([[0], part, [1]])) * sweep
    return np.column_stack([np.vstack([p, point]), np.tan(steps / 4)])


def _half(ring: np.ndarray, axis: int, bound: float, sign: int) -> np.ndarray:
    """The part of a ring (x, y, bulge) on one side of a line that none of its arcs crosses."""
    d = sign * (ring[:, axis] - bound)
    before, d0, d1 = np.roll(ring, 1, axis=0), np.roll(d, 1), np.roll(d, -1)
    crosses, stays = (d >= 0) != (d0 >= 0), d >= 0
    both = np.zeros((len(ring), 2, 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        both[:, 0, :2] = before[:, :2] + (ring[:, :2] - before[:, :2]) * (d0 / (d0 - d))[:, None]
    both[:, 0, axis] = bound
    both[:, 1] = ring
    # An arc stays if both ends do, and if it does not rise to the other side between them.
    nxt = np.roll(ring, -1, axis=0)
    way = nxt[:, :2] - ring[:, :2]
    rise = sign * (way[:, 0] if axis else -way[:, 1]) * -ring[:, 2] / 2
    both[:, 1, 2] = np.where((d1 >= 0) & ((d + d1) / 2 + rise >= 0), ring[:, 2], 0.0)
    return both[np.column_stack([crosses, stays])]


def _area(ring: np.ndarray) -> float:
    p = ring[:, :2] - ring[0, :2]
    q, b = np.roll(p, -1, axis=0), ring[:, 2]
    phi = 4 * np.arctan(b)
    bent = np.abs(b) > FLAT
    r2 = np.zeros(len(ring))
    r2[bent] = ((p - q)[bent] ** 2).sum(axis=1) * ((1 + b[bent] ** 2) / (4 * b[bent])) ** 2
    return float(_cross(p, q).sum() / 2 + (r2 * (phi - np.sin(phi)) / 2).sum())


def cut(ring: np.ndarray, cell: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, piece) of a ring (x, y, bulge) in every cell that it has an area in."""
    rows = []
    for i, (x, y, b) in enumerate(ring):
        end = ring[(i + 1) % len(ring), :2]
        flat = abs(b) <= FLAT or (end == (x, y)).all()
        rows.append(np.array([[x, y, 0.0]]) if flat else arc_cuts(ring[i, :2], end, b, cell))
    wait = [np.vstack(rows)]
    while wait:
        r = wait.pop()
        if len(r) < 2 or not abs(_area(r)) > 0:
            continue
        (x0, y0), (x1, y1) = _spans(r[:, :2].min(axis=0), r[:, :2].max(axis=0), cell)
        if x0 == x1 and y0 == y1:
            yield int(x0), int(y0), r
        else:
            axis = int(y1 - y0 > x1 - x0)
            bound = (((y0 + y1 if axis else x0 + x1) + 1) // 2) * cell
            wait += [_half(r, axis, bound, -1), _half(r, axis, bound, 1)]


def _fragments(cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "ring"]
            rings = batch.column("ring")
            ends = rings.offsets.to_numpy() - rings.offsets[0].as_py() if batch.num_rows else np.zeros(1, int)
            flat = rings.flatten()
            xyb = np.column_stack([flat.field(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in ("x", "y", "bulge")])
            keep, at, parts, shares = [], [], [], []
            for row in range(batch.num_rows):
                for cx, cy, piece in cut(xyb[ends[row] : ends[row + 1]], cell):
                    keep.append(row)
                    at.append((cx, cy))
                    shares.append(abs(_area(piece)) / cell**2)
                    parts.append((piece - (cx * cell, cy * cell, 0.0)).reshape(-1))
            if keep:
                where = np.array(at, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([p.size for p in parts])).astype(np.int32)), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(keep)).columns, pa.array(where[:, 0]), pa.array(where[:, 1]), lists, pa.array(shares)], [*names, "cx", "cy", "part", "share"])

    return run


def fragments(shapes: DataFrame, cell: float) -> DataFrame:
    """shapes with a column ring (x, y, bulge) -> its other columns, cx, cy, part (x, y, bulge by turns, from the cell's corner) and the share of the cell that it covers. Two vertices make a ring if an arc joins them."""
    shapes = shapes.where(F.size("ring") > 1).withColumn("ring", F.col("ring").cast(VERTEX))
    kinds = dict(shapes.dtypes)
    return shapes.mapInArrow(_fragments(cell), ", ".join(f"`{c}` {k}" for c, k in kinds.items() if c != "ring") + ", cx long, cy long, part array<double>, share double")


def bent(ring: Column) -> Column:
    """A ring with a bulge for each vertex, 0 where it has none."""
    return F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), F.lit(0.0).alias("bulge")))


def _near(shapes: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Without the shapes of few cells that have none of the cells; an arc rises at most |bulge| half chords."""
    nxt = lambda i: F.element_at("ring", F.when(i + 1 == F.size("ring"), F.lit(1)).otherwise(i + 2))
    more = F.array_max(F.transform("ring", lambda p, i: F.coalesce(F.abs(p["bulge"]), F.lit(0.0)) * F.hypot(p["x"] - nxt(i)["x"], p["y"] - nxt(i)["y"]) / 2))
    low = lambda c: F.floor((F.array_min(F.transform("ring", lambda p: p[c])) - F.col("_more")) / cell)
    high = lambda c: F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + F.col("_more")) / cell)
    rows = shapes.where(F.size("ring") > 1).withColumn("_more", more)
    for c in ("x", "y"):
        rows = rows.withColumn(f"_l{c}", low(c)).withColumn(f"_h{c}", high(c))
    few = (F.col("_hx") - F.col("_lx") + 1) * (F.col("_hy") - F.col("_ly") + 1) <= FEW_CELLS
    own = ["_more", "_lx", "_hx", "_ly", "_hy"]
    at = rows.where(few).withColumn("_n", F.monotonically_increasing_id())
    at = at.withColumn("cx", F.explode(F.sequence("_lx", "_hx"))).withColumn("cy", F.explode(F.sequence("_ly", "_hy")))
    at = by_cell(at, cells, ["cx", "cy"], "left_semi").drop("cx", "cy")
    return at.dropDuplicates(["_n"]).drop("_n", *own).unionByName(rows.where(~few).drop(*own))


class Edges:
    """Edges as seen from the cell's corner: ends p and q, and for arcs centre, radius squared and branch (1 beyond the centre's foot, -1 before it); branch 0 is straight."""

    def __init__(self, p, q, c, r2, branch):
        self.p, self.q, self.c, self.r2, self.branch = p, q, c, r2, branch

    def take(self, i: np.ndarray) -> Edges:
        return Edges(self.p[i], self.q[i], self.c[i], self.r2[i], self.branch[i])

    def turned(self) -> tuple[Edges, np.ndarray]:
        """All against the clock, and the sign that each had."""
        s = np.sign(_cross(self.p, self.q))
        back = (s < 0)[:, None]
        return Edges(np.where(back, self.q, self.p), np.where(back, self.p, self.q), self.c, self.r2, self.branch), s

    def reach(self, d: np.ndarray) -> np.ndarray:
        """How many times d a ray in direction d is long where it meets each edge's line or circle."""
        with np.errstate(divide="ignore", invalid="ignore"):
            straight = _cross(self.p, self.q - self.p) / _cross(d, self.q - self.p)
            dc, dd = (d * self.c).sum(axis=1), (d * d).sum(axis=1)
            root = np.sqrt(np.maximum(dc * dc - dd * ((self.c**2).sum(axis=1) - self.r2), 0))
            return np.where(self.branch == 0, straight, (dc + self.branch * root) / dd)

    def sector(self, d: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Area between the corner and the edge, from direction d to direction e."""
        a, b = self.reach(d)[:, None] * d, self.reach(e)[:, None] * e
        area = _cross(a, b) / 2
        bow = self.branch != 0
        half = np.sqrt(np.clip(((a - b)[bow] ** 2).sum(axis=1) / (4 * self.r2[bow]), 0, 1))
        phi = 2 * np.arcsin(half)
        area[bow] += self.branch[bow] * self.r2[bow] * (phi - np.sin(phi)) / 2
        return area


def read_edges(parts: pa.Array) -> tuple[Edges, np.ndarray, np.ndarray]:
    """The edges of each row's ring, arcs cut where a ray from the corner touches them; how many each row has, and the first."""
    size = np.diff(parts.offsets.to_numpy()) // 3
    flat = parts.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    first = np.cumsum(size) - size
    nxt = _rolled(flat, size, first)
    row = np.repeat(np.arange(len(size)), size)
    p, q, b = flat[:, :2], nxt[:, :2], flat[:, 2]
    bow = np.flatnonzero((np.abs(b) > FLAT) & (p != q).any(axis=1))
    straight = np.setdiff1d(np.arange(len(b)), bow, assume_unique=True)
    lines = Edges(p[straight], q[straight], np.zeros((straight.size, 2)), np.ones(straight.size), np.zeros(straight.size))
    ap, aq, ab = p[bow], q[bow], b[bow]
    c, r = circle(ap, aq, ab) if bow.size else (np.zeros((0, 2)), np.zeros(0))
    # Touching points of rays: on the circle, at a right angle to the radius.
    far = (c**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        along = r * r / far
        across = r * np.sqrt(np.maximum(far - r * r, 0)) / far
        touch = [c - along[:, None] * c + s * across[:, None] * np.column_stack([-c[:, 1], c[:, 0]]) for s in (1, -1)]
    sweep = 4 * np.arctan(ab)
    start = np.arctan2(ap[:, 1] - c[:, 1], ap[:, 0] - c[:, 0])
    turns = []
    for t in touch:
        part = np.mod((np.arctan2(t[:, 1] - c[:, 1], t[:, 0] - c[:, 0]) - start) * np.sign(sweep), 2 * np.pi) / np.abs(np.where(sweep == 0, 1, sweep))
        turns.append(np.where((far > r * r) & (part > 0) & (part < 1), part, 1.0))
    marks = np.sort(np.column_stack([np.zeros(bow.size), *turns, np.ones(bow.size)]), axis=1)
    pieces = [lines]
    rows = [row[straight]]
    for k in range(3):
        a, z = marks[:, k], marks[:, k + 1]
        some = np.flatnonzero(z > a)
        at = lambda u: c[some] + r[some, None] * np.column_stack([np.cos(start[some] + u * sweep[some]), np.sin(start[some] + u * sweep[some])])  # noqa: B023, E731
        p0 = np.where((a[some] == 0)[:, None], ap[some], at(a[some]))
        p1 = np.where((z[some] == 1)[:, None], aq[some], at(z[some]))
        # An arc that begins or ends in the corner does so in the direction of its tangent.
        ahead = lambda e: np.column_stack([-(e - c[some])[:, 1], (e - c[some])[:, 0]]) * (np.sign(sweep[some]) / r[some])[:, None]  # noqa: B023, E731
        p0 = np.where((np.hypot(*p0.T) < CORNER)[:, None], CORNER * ahead(p0), p0)
        p1 = np.where((np.hypot(*p1.T) < CORNER)[:, None], -CORNER * ahead(p1), p1)
        mid = at((a[some] + z[some]) / 2)
        branch = np.where(((mid - c[some]) * mid).sum(axis=1) >= 0, 1.0, -1.0)
        pieces.append(Edges(p0, p1, c[some], r[some] ** 2, branch))
        rows.append(row[bow[some]])
    all_ = Edges(*(np.concatenate([getattr(e, n) for e in pieces]) for n in ("p", "q", "c", "r2", "branch")))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    count = np.bincount(rows, minlength=len(size))
    return all_.take(order), count, np.cumsum(count) - count


def _crossings(a: Edges, b: Edges) -> np.ndarray:
    """Up to two points of each pair where the lines or circles of a and b cross; the middle of both where they do not (any other point does no harm)."""
    # As a straight line for both: a straight edge's own, or that through the crossings of two circles.
    two = (a.branch != 0) & (b.branch != 0)
    bow, line = (np.where((a.branch != 0)[:, None], a.c, b.c), np.where(a.branch != 0, a.r2, b.r2)), np.where((a.branch != 0)[:, None], b.p, a.p)
    way = np.where((a.branch != 0)[:, None], b.q - b.p, a.q - a.p)
    between = b.c - a.c
    with np.errstate(divide="ignore", invalid="ignore"):
        share = ((a.r2 - b.r2) / (between**2).sum(axis=1) + 1) / 2
        line = np.where(two[:, None], a.c + share[:, None] * between, line)
        way = np.where(two[:, None], np.column_stack([-between[:, 1], between[:, 0]]), way)
        c, r2 = bow
        w2 = (way**2).sum(axis=1)
        foot = line + (((c - line) * way).sum(axis=1) / w2)[:, None] * way
        half = np.sqrt((r2 - ((foot - c) ** 2).sum(axis=1)) / w2)[:, None]
        return np.stack([foot - half * way, foot + half * way], axis=1)


def bent_overlaps(a: Edges, b: Edges) -> np.ndarray:
    """Signed overlaps of the sectors of a and b, row by row."""
    (a, sa), (b, sb) = a.turned(), b.turned()
    sign = sa * sb
    out = np.zeros(len(sign))
    within = lambda p, u, v: (_cross(u, p) >= 0) & (_cross(p, v) >= 0)
    u = np.where(within(a.p, b.p, b.q)[:, None], a.p, b.p)
    v = np.where(within(a.q, b.p, b.q)[:, None], a.q, b.q)
    live = np.flatnonzero((sign != 0) & within(u, a.p, a.q) & within(u, b.p, b.q) & within(v, a.p, a.q) & within(v, b.p, b.q) & (_cross(u, v) > 0))
    a, b, u, v = a.take(live), b.take(live), u[live], v[live]
    unit = lambda d: d / np.hypot(d[:, 0], d[:, 1])[:, None]
    u, v = unit(u), unit(v)
    x = _crossings(a, b)
    ok = np.column_stack([np.isfinite(x[:, k]).all(axis=1) & (_cross(u, x[:, k]) > 0) & (_cross(x[:, k], v) > 0) for k in (0, 1)])
    m = [np.where(ok[:, k, None], unit(np.where(ok[:, k, None], x[:, k], u)), u) for k in (0, 1)]
    swap = (_cross(m[0], m[1]) < 0)[:, None]
    marks = [u, np.where(swap, m[1], m[0]), np.where(swap, m[0], m[1]), v]
    total = np.zeros(len(live))
    for d, e in zip(marks, marks[1:], strict=False):
        some = np.flatnonzero(_cross(d, e) > 0)
        d, e, pa_, pb = d[some], e[some], a.take(some), b.take(some)
        mid = unit(d + e)
        nearer = pa_.reach(mid) <= pb.reach(mid)
        total[some] += np.where(nearer, pa_.sector(d, e), pb.sector(d, e))
    out[live] = total * sign[live]
    return out


def shared_areas(parts_a: pa.Array, parts_b: pa.Array) -> np.ndarray:
    """Area shared by the fragments of each row."""
    (a, na, fa), (b, nb, fb) = read_edges(parts_a), read_edges(parts_b)
    pairs = na * nb
    row = np.repeat(np.arange(len(pairs)), pairs)
    k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = fa[row] + k // nb[row], fb[row] + k % nb[row]
    area = np.zeros(len(row))
    straight = (a.branch[i] == 0) & (b.branch[j] == 0)
    s, c = np.flatnonzero(straight), np.flatnonzero(~straight)
    area[s] = edge_overlaps(a.p[i[s]], a.q[i[s]], b.p[j[s]], b.q[j[s]])
    area[c] = bent_overlaps(a.take(i[c]), b.take(j[c]))
    return np.abs(np.bincount(row, area, minlength=len(pairs)))


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            part = lambda n: b.column(b.schema.get_field_index(n)).take(pa.array(np.arange(b.num_rows)))  # noqa: B023, E731
            rest = b.select([n for n in b.schema.names if n not in ("part_a", "part_b")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shared_areas(part("part_a"), part("part_b")))], [*rest.schema.names, "sqm"])


def curved_areas(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], on: list[str] | None = None, cell: float = 50.0, least: float = SLIVER, where: Column | None = None) -> DataFrame:
    """overlap_areas() for shapes whose ring has a bulge at each vertex (null: straight): that of the arc to the next one, as everywhere here.

    Areas are exact but for rounding (about 1e-9 of a cell's area for each fragment). A ring that only goes there and back has no area. An
    arc of a full circle cannot be written as one vertex; two half circles make one.
    """
    on = on or []
    fa = saved(fragments(a.select(*on, *keys_a, "ring"), cell), "fragments")
    asked = b.select(*on, *keys_b, F.col("ring").cast(VERTEX).alias("ring"))
    if not on:
        asked = _near(asked, fa.select("cx", "cy").distinct(), cell)
    fa, fb = refined(fa, saved(fragments(asked, cell), "fragments"), on, cell, 3, cut, lambda ring: abs(_area(ring)))
    met = by_cell(fa.drop("share").withColumnRenamed("part", "part_a"), fb.drop("share").withColumnRenamed("part", "part_b"), [*on, "lv", "cx", "cy"])
    met = (met if where is None else met.where(where)).select(*on, *keys_a, *keys_b, "part_a", "part_b")
    kinds = dict(met.dtypes)
    names = [*on, *keys_a, *keys_b]
    areas = met.mapInArrow(_areas, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sqm double")
    return areas.groupBy(*names).agg(F.sum("sqm").alias("sqm")).where(F.col("sqm") > least)
