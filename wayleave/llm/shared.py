"""What the operators of this subpackage share: reading tables, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a batch of rows that goes to a Python worker.
BATCH = 4 << 20
#: Bits of a bit map.
BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (one machine, tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='wayleave-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most BATCH bytes (or one row) where the session has Spark's default, 64 MB or 10,000 rows; a
    limit that was set stays. A task holds some batches at once in its Python worker and beside the JVM's heap, and both keep what they had."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH))


def bit_words(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """A bit map of the 64-bit column `h` as a table (w, b) of its 64-bit words that are not 0: bits / 64 rows at most, whatever the
    number of rows. Where it fills up, more rows pass than need to, and no result changes."""
    at = F.pmod("h", F.lit(bits))
    rows = hashes.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("b"))
    return rows.groupBy("w").agg(F.bit_or("b").alias("b"))


def with_bit(rows: DataFrame, h: str, words: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """rows with a boolean column: whether the bit of the column `h` is set in bit_words(). Its bounded table goes to every executor; rows stay where they are, and in the JVM."""
    at = F.pmod(h, F.lit(bits))
    told = F.broadcast(words.select(F.col("w").alias("_w"), F.col("b").alias("_b")))
    bit = F.call_function("shiftright", F.col("_b"), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(told, F.shiftright(at, 6) == F.col("_w"), "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("_w", "_b")


def bit_map(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """bit_words() in one array of unsigned 64-bit words. Its size is fixed by `bits`. One job brings its words to the driver, bits / 64
    rows of 16 bytes at most; a job for each partition would cost the driver more than the words do."""
    found = bit_words(hashes, bits).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint64)
    return words


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no column of an operator's own can clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def whole_rows(rows: DataFrame, like: DataFrame, row: str = "_row", **more: str) -> DataFrame:
    """The columns of `like` out of the struct `row`, with its names; `more` (name=column) goes last and replaces columns of those names."""
    own = [F.col(f"{row}.`{c}`").alias(c) for c in like.columns if c not in more]
    return rows.select(*own, *(F.col(c).alias(n) for n, c in more.items()))


def join_hot(rows: DataFrame, table: DataFrame, key: list[str], spread: list[str], how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """rows.join(table, key, how) for a table of one row a key, where one key may hold a large part of the rows.

    Keys with more than half a partition's fair share of the rows (at most twice as many keys as partitions) are dealt by a hash of the columns
    `spread` into as many parts as they hold such shares; the table's rows of those keys are repeated for each part.
    Which keys these are comes from counts over `counted` (a saved table with the same keys; rows itself if that is one), which every task
    aggregates before the shuffle.
    """
    n = partitions(rows.sparkSession)
    counted = rows if counted is None else counted
    counts = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_many"))
    fair = counted.count() // (2 * n) + 16
    hot = save(counts.where(F.col("_many") > fair).select(*key, F.ceil(F.col("_many") / fair).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.join(table, key, how)
    hot = F.broadcast(hot)  # 2 n rows at most
    dealt = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"))).drop("_parts")
    told = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(told, [*key, "_part"], how).drop("_part")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with consecutive numbers from 1 in the given order, without a task that sees all rows: ranges, and the count of rows before each."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    ranged = save(ranged, "ranges")  # the ranges stay as they are, whatever is computed again
    before, so_far = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row for each range
        before[r["_range"]], so_far = so_far, so_far + r["count"]
    if not before:
        return ranged.drop("_range").withColumn(name, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_range"))
    return ranged.withColumn(name, start + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range")
