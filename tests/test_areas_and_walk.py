"""Arcs in the area join, the walk's prefixes, nearest segments, and shapes drawn twice."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayleave.functions import geometry
from wayleave.operators import curved, duplicates, lines, order, overlay, report, walk

PAIR = "array<struct<x:double,y:double>>"


def disc(x, y, r):
    return np.array([[x - r, y, 1.0], [x + r, y, 1.0]])


def lens(d, r, s):
    if d >= r + s:
        return 0.0
    if d <= abs(r - s):
        return math.pi * min(r, s) ** 2
    return r * r * math.acos((d * d + r * r - s * s) / (2 * d * r)) + s * s * math.acos((d * d + s * s - r * r) / (2 * d * s)) - math.sqrt((r + s - d) * (d + r - s) * (d - r + s) * (d + r + s)) / 2


def shared(a, b, cell):
    """The job's steps for one pair, without the job."""

    fa, fb = {}, {}
    for f, ring in ((fa, a), (fb, b)):
        for cx, cy, piece in curved.cut(np.array(ring, float), cell):
            f.setdefault((cx, cy), []).append((piece - (cx * cell, cy * cell, 0)).reshape(-1).tolist())
    pairs = [(p, q) for k in fa.keys() & fb.keys() for p in fa[k] for q in fb[k]]
    lists = lambda i: pa.array([p[i] for p in pairs], pa.list_(pa.float64()))
    return float(curved.shared_areas(lists(0), lists(1)).sum()) if pairs else 0.0


def chords(ring, n):
    out = []
    for i, (x, y, b) in enumerate(ring):
        out.append((x, y))
        if b:
            q = ring[(i + 1) % len(ring)][:2]
            (c,), (r,) = curved.circle(np.array([[x, y]]), np.array([q]), np.array([b]))
            start = math.atan2(y - c[1], x - c[0])
            out += [(c[0] + r * math.cos(start + 4 * math.atan(b) * k / n), c[1] + r * math.sin(start + 4 * math.atan(b) * k / n)) for k in range(1, n)]
    return np.column_stack([np.array(out), np.zeros(len(out))])


def test_discs_share_a_lens():
    rnd = random.Random(7)
    for k in range(40):
        x, y, u, v, r, s = (*(rnd.uniform(-40, 40) for _ in range(4)), rnd.uniform(1, 40), rnd.uniform(1, 40))
        if k % 3 == 0:  # corners and touching points on lines between cells
            x, y, u, v, r, s = (round(z / 5) * 5.0 or 5.0 for z in (x, y, u, v, r, s))
            r, s = abs(r), abs(s)
        assert shared(disc(x, y, r), disc(u, v, s), 20.0) == pytest.approx(lens(math.hypot(x - u, y - v), r, s), abs=1e-8)
    assert shared(disc(0, 0, 30), disc(0, 0, 30), 7.0) == pytest.approx(math.pi * 900, abs=1e-8)


def test_bent_rings_do_not_depend_on_the_cells():
    rnd = np.random.default_rng(3)

    def star(grid):
        n = int(rnd.integers(3, 9))
        angle, r = np.sort(rnd.uniform(0, 2 * math.pi, n)), rnd.uniform(0.4, 1, n) * 40
        xy = np.column_stack([r * np.cos(angle), r * np.sin(angle)]) + rnd.uniform(-30, 30, 2)
        xy = np.round(xy / 5) * 5 if grid else xy
        return np.column_stack([xy, rnd.uniform(-0.25, 0.25, n) * (rnd.random(n) < 0.7)])

    for k in range(25):
        a, b = star(k % 3 == 0), star(k % 3 == 0)
        whole = shared(a + (500, 500, 0), b + (500, 500, 0), 1000.0)
        assert shared(a, b, 20.0) == pytest.approx(whole, abs=1e-6) and shared(a, b, 7.0) == pytest.approx(whole, abs=1e-6)
        assert shared(chords(a, 200), chords(b, 200), 20.0) == pytest.approx(whole, abs=0.05)


def test_overlap_areas_takes_arcs(spark):
    rows = lambda rings: [(i, [{"x": x, "y": y, "bulge": b} for x, y, b in np.asarray(r).tolist()]) for i, r in enumerate(rings)]
    a = spark.createDataFrame(rows([disc(0, 0, 30), disc(500, 0, 1), np.zeros((1, 3))]), "a long, ring array<struct<x:double,y:double,bulge:double>>")
    square = [(1, [{"x": 0.0, "y": 0.0}, {"x": 40.0, "y": 0.0}, {"x": 40.0, "y": 40.0}, {"x": 0.0, "y": 40.0}])]
    b = spark.createDataFrame(square, f"b long, ring {PAIR}")
    (row,) = overlay.overlap_areas(a, b, ["a"], ["b"], cell=9.0).collect()
    assert (row.a, row.b) == (0, 1) and row.sqm == pytest.approx(math.pi * 900 / 4, abs=1e-8)
    assert overlay.overlap_areas(a.limit(0), b, ["a"], ["b"]).count() == 0


def test_areas_of_bent_rings(spark):
    """Discs either way round, a ring of straight edges, a half circle bent in, a null bulge, and rings of one vertex and of none."""
    rings = [disc(0, 0, 30), disc(5, 5, 2)[::-1] * (1, 1, -1), [(0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)], [(0, 0, -1.0), (4, 0, None), (4, 3, 0), (0, 3, 0)], [(1, 1, 1.0)], []]
    rows = [(i, [{"x": float(x), "y": float(y), "bulge": None if b is None else float(b)} for x, y, b in (r.tolist() if isinstance(r, np.ndarray) else r)]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "i long, ring array<struct<x:double,y:double,bulge:double>>")
    got = {r.i: r.a for r in df.select("i", geometry.signed_area_with_arcs(F.col("ring")).alias("a")).collect()}
    for i, want in enumerate([900 * math.pi, -4 * math.pi, 12, 12 - 2 * math.pi, 0, 0]):
        assert got[i] == pytest.approx(want, abs=1e-9), i


def test_report_run_with_arcs(spark):
    """A corridor that is half a disc over two parcels, one of them a disc: the register's areas."""
    ring = "array<struct<x:double,y:double,bulge:double>>"
    shape = lambda r: [{"x": float(x), "y": float(y), "bulge": float(b)} for x, y, b in r]
    corridors = spark.createDataFrame([(1, shape([(-60, 0, 0), (60, 0, 1)]))], f"corridor_id long, ring {ring}")
    parcels = spark.createDataFrame([("1.1", shape([(-20, 0, 1), (20, 0, 1)])), ("1.2", shape([(100, 0, 0), (50, 0, 0), (50, 100, 0), (100, 100, 0)]))], f"parcel_id string, ring {ring}")
    poles = spark.createDataFrame([(1, "7", shape([(-1, 1, 0), (1, 1, 0), (1, 3, 0), (-1, 3, 0)]))], f"corridor_id long, pole_no string, ring {ring}")
    known = spark.createDataFrame([("1.1", "3", "a", "b", "c")], "parcel_id string, kat string, vids string, vidt string, ntp string")
    made = report.shared_tables(corridors, poles, parcels, known, cell=16.0)
    areas = {r.parcel_id: (r.drawn_sqm, r.gross_sqm) for r in made["areas"].collect()}
    beyond = 3600 * math.acos(5 / 6) / 2 - 50 * math.sqrt(1100) / 2
    assert areas["1.1"] == (pytest.approx(400 * math.pi), pytest.approx(200 * math.pi, abs=1e-5)) and areas["1.2"] == (pytest.approx(5000), pytest.approx(beyond, abs=1e-5))
    body = {r.parcel_id: r for r in made["body"].collect()}
    assert body["1.1"].found and body["1.1"].poles == 1 and float(body["1.1"].step_dka) == 0.004 and not body["1.2"].found


def test_placed(spark):
    """Consecutive numbers in each group, one of which has most of the rows, whatever the ranges."""
    rnd = random.Random(8)
    rows = [(rnd.choice("aaaab"), rnd.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, i long")
    got = order.placed(df, ["g"], [-F.col("v"), F.col("i")]).collect()
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert {r.i: r.row_ord for r in got if r.g == g} == {r[2]: n + 1 for n, r in enumerate(own)}
    assert order.placed(df.limit(0), ["g"], [F.col("i")]).count() == 0


def test_running(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.choice([None, rnd.randint(0, 99)])) for g in "ab" for i in range(50) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    for before in (False, True):
        got = {(r.g, r.i): (r.m, r.s) for r in walk.running(df, ["g"], "i", {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}, before, span=7).collect()}
        for g, i, _ in rows:
            seen = [v for h, j, v in rows if h == g and (j < i or (j == i and not before)) and v is not None]
            assert got[g, i] == (max(seen, default=None), sum(seen))


@pytest.mark.parametrize("span", [3, 4096])
def test_carried_settlement(spark, monkeypatch, span):
    """A settlement goes on as long as it lies near; once lost it comes back only with a point's own."""
    monkeypatch.setattr(walk.running, "__defaults__", (False, span))
    rnd = random.Random(span)
    points = [(c, i, rnd.choice([None, None, None, "a", "b"]), [e for e in "ab" if rnd.random() < 0.7]) for c in range(6) for i in range(20)]
    rows = spark.createDataFrame([(c, i, own, near, None, False) for c, i, own, near in points], "c long, ord long, own string, near array<string>, passes string, changes boolean")
    got = {(r.c, r.ord): r.ekatte for r in walk.inherited(rows, ["c"]).collect()}
    for c in range(6):
        last = None
        for _, i, own, near in (p for p in points if p[0] == c):
            last = own or (last if last in near else None)
            assert got[c, i] == last


def test_nearest_segment(spark):
    """Against all pairs: near and far points, points at equal distances, segments without length, an axis that is missing."""
    rnd = random.Random(4)
    line = [(0.0, 0.0)]
    for _ in range(60):
        line.append((line[-1][0] + rnd.choice([0, 1, 5, 300]), line[-1][1] + rnd.choice([0, 1, -5, 40])))
    segments = [(1, i, *p, *q) for i, (p, q) in enumerate(zip(line, line[1:], strict=False))]
    points = [(1, i, rnd.uniform(-100, 6000), rnd.uniform(-300, 300)) for i in range(80)] + [(1, 900 + i, x, y) for i, (x, y) in enumerate(line[::7])] + [(1, 990, 90_000.0, -70_000.0), (2, 991, 0.0, 0.0)]
    axis = spark.createDataFrame(segments, "c long, ord long, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: (r.station, r.offset) for r in lines.located(spark.createDataFrame(points, "c long, k long, x double, y double"), axis, ["c"], ["k"], cell=2.0).collect()}
    assert got.keys() == {k for c, k, _, _ in points if c == 1}
    for _, k, x, y in points[:-1]:
        best, along = None, 0.0
        for _, i, ax, ay, bx, by in segments:
            length = math.hypot(bx - ax, by - ay)
            if length:
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length**2))
                far = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
                side = math.copysign(1, (bx - ax) * (y - ay) - (by - ay) * (x - ax))
                best = min(best or (math.inf, 0, 0, 0), (far, i, along + t * length, side))
            along += length
        assert got[k][0] == pytest.approx(best[2]) and abs(got[k][1]) == pytest.approx(best[0] if best[0] > 1e-6 else 0)


def test_twins(spark):
    """Chains keep every second one, stars their first; against taking one after another."""
    rnd = random.Random(2)
    pairs = {("chain", i, i + 1) for i in range(9)} | {("star", 0, i) for i in range(1, 30)} | {("some", *sorted(rnd.sample(range(40), 2))) for _ in range(80)}
    got = {(r.g, r.b): r.a for r in duplicates.greedy_twins(spark.createDataFrame(sorted(pairs), "g string, a long, b long"), ["g"]).collect()}
    exp = {}
    for g in ("chain", "star", "some"):
        for b in range(40):
            kept = [a for h, a, c in pairs if h == g and c == b and (g, a) not in exp]
            if kept:
                exp[g, b] = min(kept)
    assert got == exp


def test_footprints_on_both_sides_of_a_line(spark):
    rows = [("p", t, 16.0, x, 1.0, x + 4, 5.0) for t, x in enumerate([1.998, 2.002, 2.002, 2.0119, 3.0])] + [("q", 9, 16.0, 2.002, 1.0, 6.002, 5.0), ("p", 7, 16.02, 1.998, 1.0, 5.998, 5.0)]
    df = spark.createDataFrame(rows, "pole string, take long, area_sqm double, x0 double, y0 double, x1 double, y1 double")
    kept = sorted((r.pole, r["take"]) for r in duplicates.dedup_structures(df, ["pole"]).collect())
    assert kept == [("p", 0), ("p", 3), ("p", 4), ("p", 7), ("q", 9)]
    assert duplicates.dedup_structures(df.limit(0), ["pole"]).count() == 0


def test_concave_shapes_drawn_twice(spark):
    """An L drawn twice from different corners, a square that covers part of it, and handles that are no numbers."""
    ell = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
    ring = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = [(3, 3), (6, 3), (6, 6), (3, 6)]
    rows = [("k", "A", 64.0, ring(ell)), ("k", "9", 64.0, ring(ell[2:] + ell[:2])), ("k", "zz", 64.0, ring(ell)), ("k", "1F", 9.0, ring(square)), ("m", "9", 64.0, ring(ell))]
    got = {(r.parcel_id, r.handle): (r.kept_handle, r.partly) for r in duplicates.dedup_shapes(spark.createDataFrame(rows, f"parcel_id string, handle string, area double, ring {PAIR}"), 7.0).collect()}
    assert got == {("k", "9"): (None, False), ("k", "A"): ("9", False), ("k", "zz"): ("9", False), ("k", "1F"): (None, True), ("m", "9"): (None, False)}


@pytest.mark.parametrize("bent", [False, True])
def test_dense_cells_are_cut_in_four(spark, monkeypatch, bent):
    """A town of small parcels and a stack of copies in one cell, and a parcel as large as the map: areas stay, cells end with few pairs that do not overlap, and the stack is not cut."""
    box = lambda x, y, w: [{"x": float(x + dx), "y": float(y + dy), "bulge": 0.0} for dx, dy in ((0, 0), (w, 0), (w, w), (0, w))]
    town = [(f"t{i}-{j}", box(i, j, 1)) for i in range(40) for j in range(40)]
    stack = [(f"s{i}", box(70, 70, 5)) for i in range(60)]
    kind = "array<struct<x:double,y:double,bulge:double>>" if bent else PAIR
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, ring array<struct<x:double,y:double,bulge:double>>").withColumn("ring", F.expr("ring") if bent else F.transform("ring", lambda p: F.struct(p["x"], p["y"]))).withColumn("ring", F.col("ring").cast(kind))
    a = frame([*town, *stack, ("whole", box(-1000, -1000, 2000))], "a")
    b = frame([(f"b{i}", box(i + 0.5, i + 0.25, 1)) for i in range(40)] + [(f"c{i}", box(71, 71, 1)) for i in range(60)], "b")
    module = curved if bent else overlay
    made = []
    monkeypatch.setattr(module, "refined", lambda *args, whole=module.refined: made.append(whole(*args)) or made[-1])
    got = {(r.a, r.b): r.sqm for r in overlay.overlap_areas(a, b, ["a"], ["b"], cell=100.0).collect()}
    fa, fb = made[0]
    cells = fa.groupBy("lv", "cx", "cy").agg(F.count("a").alias("na")).join(fb.groupBy("lv", "cx", "cy").agg(F.count("b").alias("nb")), ["lv", "cx", "cy"]).collect()
    assert max(r.lv for r in cells) > 1
    assert max(r.na * r.nb for r in cells if r.nb < 60) < overlay.PAIRS
    assert max(r.na * r.nb for r in cells) < 2 * 61 * 61
    assert fb.where("b like 'c%'").count() <= 4 * 60
    exp = {}
    for (n, p) in [*town, *stack, ("whole", box(-1000, -1000, 2000))]:
        for k in range(100):
            m, q = (f"b{k}", box(k + 0.5, k + 0.25, 1)) if k < 40 else (f"c{k - 40}", box(71, 71, 1))
            w = min(p[1]["x"], q[1]["x"]) - max(p[0]["x"], q[0]["x"])
            h = min(p[2]["y"], q[2]["y"]) - max(p[0]["y"], q[0]["y"])
            if w > 0 and h > 0:
                exp[n, m] = w * h
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-7 for k in exp)
