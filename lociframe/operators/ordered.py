"""Numbering, running sums and look-behind over a global order, without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which one sorted task numbers a table; larger ones are cut into ranges. The size is counted, not guessed.
ONE_TASK_ROWS = 1_000_000
#: Rows a range should hold.
RANGE_ROWS = 2_000_000
#: Positions of a block, as bits; a block of blocks has as many again.
BLOCK_BITS = 16
#: Low bits of Spark's row numbers, which count inside a partition.
_PART_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); one of our own only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="lociframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/lociframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/lociframe/" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, keys: list[str], name: str = "pos", rows: int | None = None, most_in_one_task: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of ``keys``.

    ``rows`` is the table's size if known, else it is counted. Up to ONE_TASK_ROWS one window does it. Above,
    rows go to ranges of the keys (ties beyond the keys are cut too if the keys end in a unique one), each range is
    sorted and numbered by itself and written once, and the sizes of the ranges before are added: a table of one row
    a range. A sort, a shuffle, and no second sort.
    """
    rows = df.count() if rows is None else rows
    if rows <= (ONE_TASK_ROWS if most_in_one_task is None else most_in_one_task):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    sorted_ = materialize(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    sorted_ = sorted_.withColumn("_range", F.shiftright("_at", _PART_BITS))
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return sorted_.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_at", "_range", "_before")


def running_sums(df: DataFrame, sums: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Adds for each name the sum of its column over all rows of smaller ``pos`` (dense from 0).

    Three levels: inside blocks of 2**16 positions, over the blocks of a superblock, over superblocks. A task
    sees one block or the totals of one superblock; the last window has a row for 2**32 positions.
    """
    block, super_ = F.shiftright(F.col(pos), BLOCK_BITS), F.shiftright(F.col("_block"), BLOCK_BITS)
    rows = df.withColumn("_block", block)
    for n, c in sums.items():
        rows = rows.withColumn(f"_v_{n}", c.cast("long"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).withColumn("_super", super_)
    supers = blocks.groupBy("_super").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])
    top = supers.select("_super", *[before(f"_t_{n}", Window.orderBy("_super")).alias(f"_s_{n}") for n in sums])
    inner = blocks.select("_block", "_super", *[before(f"_t_{n}", Window.partitionBy("_super").orderBy("_block")).alias(f"_b_{n}") for n in sums])
    starts = inner.join(top, "_super").select("_block", *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(f"_o_{n}") for n in sums])
    own = Window.partitionBy("_block").orderBy(pos)
    rows = rows.select("*", *[before(f"_v_{n}", own).alias(f"_i_{n}") for n in sums])
    return rows.join(starts, "_block").select(*[F.col(c) for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def previous(df: DataFrame, value: str, name: str, pos: str = "pos") -> DataFrame:
    """Adds the ``value`` of the row before in ``pos`` (dense from 0), null at 0; blocks hand over their last value."""
    rows = df.withColumn("_block", F.shiftright(F.col(pos), BLOCK_BITS))
    last = rows.groupBy("_block").agg(F.max_by(value, pos).alias("_last")).select((F.col("_block") + 1).alias("_block"), "_last")
    own = Window.partitionBy("_block").orderBy(pos)
    inside = rows.withColumn("_lag", F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    return inside.join(last, "_block", "left").select(*[F.col(c) for c in df.columns], F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_lag")).alias(name))
