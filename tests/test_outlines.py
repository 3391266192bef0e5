"""Drawn outlines: arcs as chords, farthest vertices, retraced ends and odd lines."""

import math
import random
import time

from pyspark.sql import functions as F

from wayleave.operators import edges
from wayleave.operators import outlines as ol

SCHEMA = "id int, closed boolean, verts array<struct<x:double,y:double,bulge:double>>"


def ring_area(ring):
    return abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def test_circle_as_chords(spark):
    df = spark.createDataFrame([(1, True, [(500000.0, 4700000.0, 1.0), (500020.0, 4700000.0, 1.0)])], SCHEMA)
    ring = df.select(ol.straight_ring(F.col("verts")).alias("r")).first()["r"]
    moved = [{"x": p["x"] - 500000, "y": p["y"] - 4700000} for p in ring]
    assert abs(ring_area(moved) - 100 * math.pi) < 0.1
    assert all(abs(math.hypot(p["x"] - 10, p["y"]) - 10) < 1e-6 for p in moved)


def test_areas_of_curved_shapes(spark):
    half = spark.createDataFrame([(1, True, [(0.0, 0.0, 1.0), (20.0, 0.0, 0.0)])], SCHEMA.replace("id", "corridor_id"))
    box = spark.createDataFrame([("p", 1, True, [(0.0, -30.0, 0.0), (10.0, -30.0, 0.0), (10.0, 30.0, 0.0), (0.0, 30.0, 0.0)])], SCHEMA.replace("id int", "parcel_id string, pick int"))
    rows = ol.legacy_corridor_areas(half, box).collect()
    assert len(rows) == 1 and abs(rows[0]["sqm"] - 25 * math.pi) < 0.1


def test_odd_lines_stay(spark):
    lines = [(0, False, []), (1, False, [(1.0, 2.0, 0.5)]), (2, False, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.7)]), (3, True, [(0.0, 0.0, 0.0), (5.0, 0.0, 1e-12), (5.0, 5.0, 0.0)])]
    df = spark.createDataFrame(lines, SCHEMA)
    want = {i: [v[:2] for v in vs] for i, _, vs in lines}
    for made in (ol.remove_retraced_ends(df), ol.segment_arcs(df)):
        assert {r["id"]: [(p["x"], p["y"]) for p in r["verts"]] for r in made.collect()} == want
    told = {r["id"]: r for r in ol.segmentation_check(df, ol.segment_arcs(df), ["id"]).collect()}
    assert all(r["same_length"] and r["n_kept"] == r["n_source"] and not r["n_off"] and not r["n_backwards"] for r in told.values())
    assert ol.corridor_markers(df, ["id"]).count() == 0
    assert len(ol.sanitized(df).collect()) == 4


def test_lengths_and_pieces_of_arcs(spark):
    rnd = random.Random(3)
    lines = [(i, i % 2 == 0, [(rnd.uniform(0, 90), rnd.uniform(0, 90), rnd.choice([0.0, rnd.uniform(-3, 3)])) for _ in range(6)]) for i in range(20)]
    df = spark.createDataFrame(lines, SCHEMA)
    made = ol.segment_arcs(df, 7.0)
    for r in ol.segmentation_check(df, made, ["id"]).collect():
        assert (r["same_length"], r["n_kept"], r["n_off"], r["n_backwards"]) == (True, 6, 0, 0)
    assert made.select(F.max(F.size("verts"))).first()[0] > 20


def test_farthest_vertices(spark):
    rnd = random.Random(5)
    lines = [(i, True, [(float(rnd.randrange(12)), float(rnd.randrange(12)), 0.0) for _ in range(rnd.randrange(2, 25))]) for i in range(60)]
    of = lambda c: F.transform("verts", lambda p: p[c])
    got = {r["id"]: (r["f"]["i"], r["f"]["j"]) for r in spark.createDataFrame(lines, SCHEMA).select("id", ol._farthest(of("x"), of("y")).alias("f")).collect()}
    for i, _, v in lines:
        pairs = [(-math.dist(v[a][:2], v[b][:2]), a, b) for a in range(len(v)) for b in range(a + 1, len(v))]
        far = min(pairs)
        assert got[i] == ((far[1], far[2]) if far[0] < 0 else (-1, -1))


def plain_chain(pieces):
    left, line = [list(p) for p in pieces], None
    line = left.pop(0)
    while left:
        far = [(min(math.dist(line[-1], p[0]), math.dist(line[-1], p[-1])), i) for i, p in enumerate(left)]
        nxt = left.pop(min(far)[1])
        nxt = nxt if math.dist(line[-1], nxt[0]) <= math.dist(line[-1], nxt[-1]) else nxt[::-1]
        line = line + (nxt[1:] if len(nxt) > 1 and math.dist(line[-1], nxt[0]) <= 1e-9 else nxt)
    return line


def chained(spark, chains):
    df = spark.createDataFrame([(c, i, [{"x": float(x), "y": float(y)} for x, y in p]) for c, ps in chains.items() for i, p in enumerate(ps)], "corridor_id long, ord long, verts array<struct<x:double,y:double>>")
    return {r["corridor_id"]: [(p["x"], p["y"]) for p in r["verts"]] for r in edges.chain_axis(df).collect()}


def test_chained_pieces(spark):
    """Against the plain loop: pieces in any order and direction, equal distances, far clusters, single points."""
    rnd = random.Random(9)
    point = lambda: (rnd.choice([0, 3, 5, 8, 1000, 1004]) + rnd.random() * rnd.choice([0, 1]), rnd.choice([0, 4, -500]))
    chains = {c: [[point() for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 40))] for c in range(12)}
    got = chained(spark, chains)
    assert got == {c: [(float(x), float(y)) for x, y in plain_chain(ps)] for c, ps in chains.items()}


def test_many_pieces_and_long_lines_take_seconds(spark):
    rnd = random.Random(1)
    n = 30_000
    line = [(10.0 * i, 50 * math.sin(i / 40)) for i in range(n + 1)]
    pieces = [[a, b] if rnd.random() < 0.5 else [b, a] for a, b in zip(line, line[1:])]
    first, rest = [line[0], line[1]], pieces[1:]
    rnd.shuffle(rest)
    began = time.time()
    assert chained(spark, {1: [first, *rest]})[1] == line
    long = spark.createDataFrame([(1, False, [(x, y, 0.0) for x, y in line + line[-2 : -n // 3 : -1]])], SCHEMA)
    row = ol.remove_retraced_ends(long).select("removed_start", "removed_end", F.size("verts").alias("n")).first()
    assert tuple(row) == (0, n // 3 - 2, n + 1)
    assert time.time() - began < 60


def test_line_drawn_to_and_fro(spark):
    """Between two points again and again: the longest tail that mirrors what is before it goes."""
    verts = [(0.0 if i % 2 else 5.0, 0.0, 0.0) for i in range(4001)]
    df = spark.createDataFrame([(1, False, verts)], SCHEMA)
    row = ol.remove_retraced_ends(df).select("removed_start", "removed_end").first()
    assert row["removed_end"] == 2000 and row["removed_start"] == 1000
