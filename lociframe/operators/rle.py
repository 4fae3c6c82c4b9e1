"""Run-length forms of a BWT: maximal runs, and bytes of a 3-bit symbol under a base-32 digit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions.alphabet import byte_digit, byte_symbol, run_bytes
from lociframe.operators import ordered
from lociframe.operators.ordered import materialize, number_rows, previous, running_sums


def runs(bwt: DataFrame) -> DataFrame:
    """(run_id, sym, start_pos, len): maximal runs of a BWT (pos, sym), numbered from 0.

    Changes are counted inside blocks of positions; blocks, one row each, hand over their last symbol and their count.
    """
    rows = bwt.select("pos", "sym", F.shiftright("pos", ordered.BLOCK_BITS).alias("_block"))
    own = Window.partitionBy("_block").orderBy("pos")
    change = F.coalesce((F.lag("sym").over(own) != F.col("sym")).cast("long"), F.lit(0))
    inside = rows.withColumn("_change", change).withColumn("_inside", F.sum("_change").over(own))
    blocks = inside.groupBy("_block").agg(F.min_by("sym", "pos").alias("_initial"), F.max_by("sym", "pos").alias("_final"), F.max("_inside").alias("_n"))
    blocks = materialize(blocks, "blocks")  # a row a block, read several times below
    return inside.join(_handed(blocks), "_block").groupBy((F.col("_start") + F.col("_inside")).alias("run_id"), "sym").agg(F.min("pos").alias("start_pos"), F.count("*").alias("len"))


def _handed(blocks: DataFrame) -> DataFrame:
    """(_block, _start): the number of the run that a block begins in."""
    marked = previous(blocks.withColumnRenamed("_block", "pos"), "_final", "_before")
    fresh = (F.col("_before").isNull() | (F.col("_before") != F.col("_initial"))).cast("long")
    at = running_sums(marked.withColumn("_fresh", fresh), {"_earlier": F.col("_fresh") + F.col("_n")})
    return at.select(F.col("pos").alias("_block"), (F.col("_earlier") + F.col("_fresh") - 1).alias("_start"))


def merge_runs(pieces: DataFrame) -> DataFrame:
    """Maximal runs from ordered pieces (run_id, sym, len) whose neighbours may have one symbol or no length."""
    dense = materialize(number_rows(pieces.where("len > 0"), ["run_id"], "pos"), "runs")
    marked = previous(dense, "sym", "_before").withColumn("_new", (F.col("_before").isNull() | (F.col("_before") != F.col("sym"))).cast("long"))
    at = running_sums(marked, {"_earlier": F.col("_new"), "_start": F.col("len")})
    return at.groupBy((F.col("_earlier") + F.col("_new") - 1).alias("run_id"), "sym").agg(F.min("_start").alias("start_pos"), F.sum("len").alias("len"))


def expand(runs_: DataFrame) -> DataFrame:
    """(pos, sym) of runs. A long run is cut into pieces that go to different tasks first."""
    piece = 1 << 20
    cut = runs_.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / piece))))
    first = F.col("start_pos") + F.col("_k") * piece
    last = F.least(first + piece, F.col("start_pos") + F.col("len")) - 1
    return cut.select("sym", F.explode(F.sequence(first, last)).alias("pos")).select("pos", "sym")


def to_bytes(runs_: DataFrame) -> DataFrame:
    """(off, byte 0..255). Needs maximal runs: neighbours of one symbol would decode as digits of one run."""
    each = materialize(runs_.select("run_id", run_bytes("sym", "len").alias("_bytes")), "runs")  # running sums read it twice
    at = running_sums(each, {"_off": F.size("_bytes")}, "run_id")
    return at.select("_off", F.posexplode("_bytes").alias("_k", "byte")).select((F.col("_off") + F.col("_k")).alias("off"), F.col("byte").cast("int").alias("byte"))


def from_bytes(rle: DataFrame) -> DataFrame:
    """Runs of (off, byte): neighbouring bytes of one symbol are digits of one run, least first.

    Digits of a run may lie in different blocks of the input; runs are told apart by a running sum over all bytes.
    """
    symbols = rle.select("off", "byte", byte_symbol("byte").alias("sym"))
    marked = materialize(previous(symbols, "sym", "_before", "off").withColumn("_new", (F.col("_before").isNull() | (F.col("_before") != F.col("sym"))).cast("long")), "marked")
    numbered = running_sums(marked, {"_earlier": F.col("_new")}, "off").withColumn("run_id", F.col("_earlier") + F.col("_new") - 1)
    digit = F.row_number().over(Window.partitionBy("run_id").orderBy("off")) - 1  # a run has 13 digits at most
    value = F.call_function("shiftleft", byte_digit("byte"), digit * 5)
    each = materialize(numbered.withColumn("_value", value).groupBy("run_id", "sym").agg(F.sum("_value").alias("len")), "runs")
    return running_sums(each, {"start_pos": F.col("len")}, "run_id").select("run_id", "sym", "start_pos", "len")
