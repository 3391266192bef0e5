"""Intermediate tables in the folder that driver and executors share: spark.checkpoint.dir, or a folder of our own on one machine where that is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='wayleave-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, its lineage cut, lost executors survived."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """files (name, content) written below folder, each under another name first, then moved, so that a task that runs again leaves the same files. Returns (name, size)."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        import pyarrow as pa

        there, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                part = f"{base}/{name}.{uuid.uuid4().hex}"
                with there.open_output_stream(part, compression=None) as f:
                    f.write(content)
                there.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], ["name", "size"])

    return saved(files.select("name", "content").mapInArrow(run, "name string, size long"), "written")
