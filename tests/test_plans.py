"""Where Spark works out what is costly."""

from pyspark.sql import functions as F

from wayleave.operators import edges, lines
from wayleave.plans import registry, routes  # the registry comes first
from wayleave.sources.saved import saved

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outlines_are_not_worked_out_for_each_part(spark, monkeypatch):
    """Corridors are the distinct bands of parts; a filter on an outline's vertices would go below, to every part."""
    plans = []

    def noted(df, name):
        plans.append(plan(df))
        return saved(df, name)

    for module in (edges, lines):
        monkeypatch.setattr(module, "saved", noted)
    edges.split_edges(routes.outlines(spark, SF), routes.axes(spark, SF))
    assert plans and not [x for p in plans for x in p.splitlines() if "Filter" in x and "lambda" in x]


def test_rings_that_repeat_vertices_are_read_once(spark):
    """A ring of 2000 vertices, each drawn twice, and its first one again at the end."""
    at = lambda i: F.struct((i % 1000).cast("double").alias("x"), F.floor(i / 1000).cast("double").alias("y"))
    ring = F.flatten(F.transform(F.sequence(F.lit(0), F.col("id") + 1999), lambda i: F.array(at(i), at(i))))
    kept = spark.range(1).select(edges.dedupe_vertices(F.concat(ring, F.slice(ring, 1, 1))).alias("v"))
    assert kept.select(F.size("v")).first()[0] == 2000


def test_rows_dealt_to_cells_are_not_broadcast(spark):
    """Spark's estimate of them is that of the parts' table, some kilobytes here and still below 10 MB where they are millions."""
    met = registry.QUERIES["J22_axis_length_by_parcel"](spark, SF)
    text = met._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_cx" in text and "BroadcastHashJoin [_cx" not in text


def test_much_work_on_each_row_is_dealt_to_tasks(spark):
    """The parts are one file of a few kilobytes, which one task would read and work off."""
    for name in ("S05_split_cad_csv", "F18_start_forward_left"):
        assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
