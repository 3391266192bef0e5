"""Points, shapes and route axes: predicates, containment, stations, cutting at boundaries, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayleave.operators.overlay import by_cell, fragments
from wayleave.sources.saved import saved

OWN_LAYERS = ["servitude_points", "pole_corners", "servitude_markers"]
MARKERS = ["GBP032", "SERV_TOCHKA"]
CLOSE_M, BOX_M = 0.01, 0.01


def closed_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes that are closed, or have more than two vertices and ends within a centimetre."""
    a, b = F.element_at("verts", 1), F.element_at("verts", -1)
    ends = F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < CLOSE_M
    return shapes.where(F.col("closed") | ((F.size("verts") > 2) & ends))


def exclude_layers(shapes: DataFrame, layers: list[str] = OWN_LAYERS) -> DataFrame:
    return shapes.where(~F.lower("layer").isin([x.lower() for x in layers]))


def exclude_markers(blocks: DataFrame, names: list[str] = MARKERS) -> DataFrame:
    return blocks.where(~F.upper(F.trim("block_name")).isin(names))


def resolved_id(*candidates: Column) -> Column:
    """The first candidate that is not empty."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in candidates))


def box_may_overlap(a: list[Column], b: list[Column], margin: float = BOX_M) -> Column:
    """Whether boxes (x0, y0, x1, y1) touch within a margin; an unknown box is never ruled out."""
    test = (a[0] <= b[2] + margin) & (b[0] <= a[2] + margin) & (a[1] <= b[3] + margin) & (b[1] <= a[3] + margin)
    return F.coalesce(test, F.lit(True))


def touching_boxes(a: DataFrame, b: DataFrame, key_a: str, key_b: str, cell: float = 50.0, margin: float = BOX_M) -> DataFrame:
    """(key_a, key_b): pairs of boxes (key, x0, y0, x1, y1) that touch within a margin: an equi-join on the cells of the widened boxes."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - margin) / cell), F.floor((F.col(hi) + margin) / cell)))
    corners = ("x0", "y0", "x1", "y1")

    def spread(df: DataFrame, key: str, t: str) -> DataFrame:
        return df.select(key, *(F.col(c).alias(f"{c}{t}") for c in corners)).withColumn("_cx", cells(f"x0{t}", f"x1{t}")).withColumn("_cy", cells(f"y0{t}", f"y1{t}"))

    met = by_cell(spread(a, key_a, "a"), spread(b, key_b, "b"), ["_cx", "_cy"])
    return met.where(box_may_overlap(*([F.col(f"{c}{t}") for c in corners] for t in "ab"), margin)).select(key_a, key_b).distinct()


def same_footprint(area_a: Column, area_b: Column, a: list[Column], b: list[Column]) -> Column:
    near = F.abs(area_a - area_b) < CLOSE_M
    for x, y in zip(a, b, strict=True):
        near = near & (F.abs(x - y) <= BOX_M)
    return near


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many edges of a ring a ray to the right of (x, y) crosses."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)

    def hit(i: Column) -> Column:
        p, q = at(i), at(F.when(i == n, F.lit(1)).otherwise(i + 1))
        spans = (p["y"] > y) != (q["y"] > y)
        return F.when(spans & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(spans, q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + hit(i))


def containing(points: DataFrame, shapes: DataFrame, cell: float = 50.0) -> DataFrame:
    """points (x, y, ...) with each shape (ring, ...) that contains them, by even-odd crossings: an equi-join on cells.

    Shapes are cut to cells, so a point meets the few edges in its own cell, however long the ring is.
    """
    s = fragments(shapes, cell).withColumnsRenamed({"cx": "_cx", "cy": "_cy", "part": "_part"})
    p = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    ring = F.transform(F.sequence(F.lit(1), F.size("_part"), F.lit(2)), lambda i: F.struct(F.element_at("_part", i).alias("x"), F.element_at("_part", i + 1).alias("y")))
    met = by_cell(p, s, ["_cx", "_cy"]).withColumn("_ring", ring)
    inside = crossings(F.col("_ring"), F.col("x") - F.col("_cx") * cell, F.col("y") - F.col("_cy") * cell) % 2 == 1
    return met.where(inside).drop("_cx", "_cy", "_part", "_ring")


def first_settlement(points: DataFrame, shapes: DataFrame, keys: list[str], cell: float = 50.0) -> DataFrame:
    """(keys, ekatte): the settlement of the first shape, by `ord`, that contains each point."""
    return containing(points, shapes, cell).groupBy(*keys).agg(F.min_by("ekatte", "ord").alias("ekatte"))


def all_settlements(points: DataFrame, shapes: DataFrame, keys: list[str], cell: float = 50.0) -> DataFrame:
    return containing(points, shapes, cell).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("ekatte")), ",").alias("ekattes"))


def stations(segments: DataFrame, by: list[str]) -> DataFrame:
    """segments (x0, y0, x1, y1, ord) with length and station: the length of the line before each."""
    rows = segments.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("station", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def along_cells(df: DataFrame, cell: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """df with a row for each cell (_cx, _cy) along its segments: these are taken in pieces no longer than a cell, each with the cells of its box."""
    k = F.greatest(F.ceil(F.hypot(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)) / cell), F.lit(1)).cast("int")
    df = df.withColumn("_k", k).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    at = lambda a, b, j: F.col(a) + (F.col(b) - F.col(a)) * j / F.col("_k")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.least(at(a, b, F.col("_j")), at(a, b, F.col("_j") + 1)) / cell), F.floor(F.greatest(at(a, b, F.col("_j")), at(a, b, F.col("_j") + 1)) / cell)))
    return df.withColumn("_cx", cells(x0, x1)).withColumn("_cy", cells(y0, y1)).drop("_k", "_j").distinct()


def located(points: DataFrame, axis: DataFrame, by: list[str], keys: list[str], cell: float = 64.0) -> DataFrame:
    """(by, keys, station, offset): each point at the nearest segment of its axis (the first of equals); left of the axis is positive.

    A point meets the segments that pass through its own cell and the eight about it. What lies within a cell's width is sure to be among them,
    so if the nearest one does, it is the nearest of all; the points left over try again with cells of four times the width, until none is
    left. So a point meets a few segments, however many its axis has. Points without an axis of some length are left out.
    """
    s = saved(stations(axis, by).where("length > 0"), "stations")
    left = points.select(*by, *keys, "x", "y").join(s.select(*by).distinct(), by, "left_semi")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (F.col("length") * F.col("length"))))
    ex, ey = F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy
    side = F.signum(dx * (F.col("y") - F.col("y0")) - dy * (F.col("x") - F.col("x0")))
    dist = F.hypot(ex, ey)
    near = F.min_by(F.struct((F.col("station") + t * F.col("length")).alias("station"), F.when(dist <= 1e-6, F.lit(0.0)).otherwise(side * dist).alias("offset"), dist.alias("d")), F.struct(dist.alias("d"), F.col("ord")))
    found = None
    while True:
        about = lambda c: F.explode(F.sequence(F.floor(F.col(c) / cell) - 1, F.floor(F.col(c) / cell) + 1))  # noqa: B023, E731
        p = left.withColumn("_cx", about("x")).withColumn("_cy", about("y"))
        met = by_cell(p, along_cells(s, cell), [*by, "_cx", "_cy"]).groupBy(*by, *keys).agg(near.alias("n")).where(F.col("n.d") <= cell)
        sure = saved(met.select(*by, *keys, "n.station", "n.offset"), "located")
        found = sure if found is None else found.unionByName(sure)
        left = saved(left.join(sure.select(*by, *keys), [*by, *keys], "left_anti"), "left")
        if left.isEmpty():
            return found
        cell *= 4


def numbered(points: DataFrame, by: list[str], start: int) -> DataFrame:
    return points.withColumn("number", F.lit(start) + F.row_number().over(Window.partitionBy(*by).orderBy("ord")) - 1)


def numbered_inside(points: DataFrame, by: list[str], start: int) -> DataFrame:
    """Points from the first to the last that has a settlement; gaps between them use numbers too."""
    order = Window.partitionBy(*by).orderBy("ord")
    has = F.col("inside").cast("int")
    ahead = F.max(has).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.max(has).over(order.rowsBetween(0, Window.unboundedFollowing))
    return numbered(points.withColumn("_a", ahead).withColumn("_b", behind).where("_a = 1 and _b = 1").drop("_a", "_b"), by, start)


def number_ranges(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, ranges): consecutive numbers as "5001–5018", single ones as they are."""
    island = F.col("number") - F.row_number().over(Window.partitionBy(*by).orderBy("number"))
    runs = points.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def paired_edges(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left and right points side by side, by their place; the shorter side's cells are empty."""
    row = lambda df, n: df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("number")).alias("row_ord"), *(F.col(c).alias(f"{n}_{c}") for c in ("number", "x", "y")))
    return row(left, "left").join(row(right, "right"), [*by, "row_ord"], "full")


def route_order(points: DataFrame, by: list[str]) -> DataFrame:
    """(corridor_id, ekatte, place): the earliest relative position, 0 to 1, of each settlement over both edges."""
    w = Window.partitionBy(*by)
    place = (F.row_number().over(w.orderBy("ord")) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return points.withColumn("place", place).where("ekatte is not null").groupBy("corridor_id", "ekatte").agg(F.min("place").alias("place"))


def split_parameters(cuts: Column, start: float, end: float, gap: float = 1e-7) -> Column:
    """Sorted cut parameters without those at the ends or within gap of the last kept one."""
    inner = F.array_sort(F.filter(cuts, lambda p: ~F.isnan(p) & (p > start + gap) & (p < end - gap)))
    empty = F.array().cast("array<double>")
    return F.aggregate(inner, empty, lambda kept, p: F.when((F.size(kept) > 0) & (p - F.try_element_at(kept, F.lit(-1)) <= gap), kept).otherwise(F.concat(kept, F.array(p))))


def boundary_crossings(parts: DataFrame, cuts: DataFrame, by: list[str], cluster: float = 0.5) -> DataFrame:
    """(by, at, from_ekatte, to_ekatte, merged_hits, span, middle): one crossing for each change of settlement along a segment.

    parts (by, a, b, ekatte, start_ekatte) are a segment's pieces between its cuts, in metres, classified by their midpoint, in order of a; cuts (by, m). Short
    inner pieces are noise; a piece in no settlement is a hole. A crossing lies where the first settlement ends, and takes
    the cuts from there to where the second begins, within cluster metres.
    """
    w = Window.partitionBy(*by).orderBy("a")
    ends = (F.row_number().over(w) == 1) | (F.lead("a").over(w).isNull())
    kept = parts.withColumn("_ends", ends).where(F.col("_ends") | (F.col("b") - F.col("a") >= cluster)).where("ekatte is not null")
    before = F.coalesce(F.lag("ekatte").over(w), F.when(F.row_number().over(w) == 1, F.col("start_ekatte")))
    found = kept.select(*by, "a", before.alias("from_ekatte"), F.col("ekatte").alias("to_ekatte"), F.coalesce(F.lag("b").over(w), F.lit(0.0)).alias("at")).where("from_ekatte <> to_ekatte")
    near = found.join(cuts, by, "left").where(F.col("m").isNull() | F.col("m").between(F.col("at") - cluster, F.col("a") + cluster))
    hits = near.groupBy(*by, "a").agg(F.count("m").alias("n"), (F.max("m") - F.min("m")).alias("span"), ((F.max("m") + F.min("m")) / 2).alias("middle"))
    out = found.join(hits, [*by, "a"], "left")
    return out.select(*by, "at", "from_ekatte", "to_ekatte", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("merged_hits"), F.coalesce("span", F.lit(0.0)).alias("span"), F.coalesce("middle", "at").alias("middle"))


def listed_points(points: DataFrame) -> DataFrame:
    """Points of the walk that have a settlement; the others are not in the register."""
    return points.where(F.size("ekattes") > 0)


def corridor_print_rows(points: DataFrame, left: int = 5001, right: int = 1) -> DataFrame:
    """(corridor_id, ekatte, row_ord, left_no, left_north, left_east, right_no, right_north, right_east): the coordinate register of corridor edges as printed.

    Listed points are numbered along each edge; a shared point stands in both of its settlements, under one number. Drawing y is north, x is east,
    to three decimals, half away from zero.
    """
    p = listed_points(points)
    both = numbered(p.where("side = 'left'"), ["corridor_id"], left).unionByName(numbered(p.where("side = 'right'"), ["corridor_id"], right))
    printed = lambda c: F.round(F.col(c).cast("decimal(24,6)"), 3).cast("double")
    each = both.select("corridor_id", "side", "number", printed("x").alias("x"), printed("y").alias("y"), F.explode("ekattes").alias("ekatte"))
    rows = paired_edges(each.where("side = 'left'"), each.where("side = 'right'"), ["corridor_id", "ekatte"])
    return rows.select("corridor_id", "ekatte", "row_ord", *(F.col(f"{s}_{c}").alias(f"{s}_{n}") for s in ("left", "right") for c, n in (("number", "no"), ("y", "north"), ("x", "east"))))
