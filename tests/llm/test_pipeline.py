"""The pipeline's stages on their own inputs."""

import importlib.util

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline(spark):
    import corpus_pipeline
    from wayleave.llm.decontaminate import decontaminate
    from wayleave.llm.exact_dedup import exact_dedup
    from wayleave.llm.near_dedup import near_duplicates
    from wayleave.llm.shared import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, last = [n for n, _ in corpus_pipeline.STAGES], len(corpus_pipeline.STAGES) - 1
    assert names == ["quality classifier", "exact dedup", "near dedup", "decontamination", "mixing"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    keeps = {
        1: lambda d: exact_dedup(d).where("kept"),
        2: lambda d: near_duplicates(d, 5).where("kept"),
        3: lambda d: decontaminate(d, items).where("not contaminated"),
    }
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = save(stage(spark, docs, SF), "stage")
        assert 0 < out.count() <= docs.count()
        if i < last:
            assert out.columns == docs.columns
        if i in keeps:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in keeps[i](docs).select("doc_id").collect()}
        docs = out


def test_bit_map_is_one_job_whatever_the_partitions(spark):
    """A job for each shuffle partition made hundreds of jobs where many partitions stay as they are."""
    import numpy as np

    from wayleave.llm.shared import bit_map

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    hashes = [-(1 << 63), -1, 0, 63, 64, (1 << 63) - 1, *(i * 0x9E3779B97F4A7 for i in range(500))]
    expected = np.zeros(1 << 10, np.uint64)
    for h in hashes:
        expected[h % (1 << 16) >> 6] |= np.uint64(1 << (h & 63))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("bit map", "")
        words = bit_map(spark.createDataFrame([(h,) for h in hashes], "h long"), 1 << 16)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bit map")) <= 3
        assert len(words) == len(expected) and (np.asarray(words, np.uint64) == expected).all()
        assert not np.asarray(bit_map(spark.createDataFrame([], "h long"), 1 << 16)).any()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch held 10,000 rows, up to 64 MB, in every worker and beside the heap of the executor."""
    import numpy as np
    from pyspark.sql import functions as F

    from wayleave.llm import near_dedup, quality

    def watched(run):
        def inner(batches):
            for batch in batches:
                assert batch.nbytes < 8 << 20, batch.nbytes
                yield from run(iter([batch]))

        return inner

    sketch, scores, key = near_dedup._sketch, quality._scores, "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(near_dedup, "_sketch", lambda width: watched(sketch(width)))
    monkeypatch.setattr(quality, "_scores", lambda model, text: watched(scores(model, text)))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 2000).alias("text")).coalesce(1)
    spark.conf.unset(key)
    assert near_dedup.near_duplicates(docs).where("kept").count() == 1500
    spark.conf.unset(key)
    none = np.zeros(quality.FEATURES)
    assert quality.score(docs, (none, none, 0.0)).where("score = 0.5").count() == 1500


def test_rows_that_are_dropped_or_labelled_are_told_without_python(spark):
    """Whole rows went to a Python worker and back to ask a bit map, twice in one query."""
    from pyspark.sql import functions as F

    from wayleave.llm.near_dedup import without_near_duplicates
    from wayleave.llm.shared import bit_words, with_bit

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here"), (None, None)], "doc_id long, text string")
    out = without_near_duplicates(docs)
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in out.collect()} == {1, 3, None}

    hashes = [-(1 << 63), -1, 0, 63, 64, (1 << 63) - 1, *(i * 0x9E3779B97F4A7 for i in range(300))]
    words = bit_words(spark.createDataFrame([(h,) for h in hashes], "h long"), 1 << 16)
    asked = spark.createDataFrame([(h + d,) for h in hashes[2:5] + hashes[6:] for d in (0, 1, 5)] + [(h,) for h in hashes], "x long")
    told = with_bit(asked, "x", words, "bit", 1 << 16).collect()
    bits = {h % (1 << 16) for h in hashes}
    assert len(told) == asked.count() and all(r.bit == (r.x % (1 << 16) in bits) for r in told)
    assert with_bit(asked, "x", words.where(F.lit(False)), "bit", 1 << 16).where("bit").isEmpty()
