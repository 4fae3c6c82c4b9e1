"""Symbol counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions.alphabet import SYMBOLS


def symbol_counts(bwt: DataFrame) -> DataFrame:
    """(sym, cnt) for all six symbols, zeros included."""
    all_ = bwt.sparkSession.createDataFrame([(c,) for c in SYMBOLS], "sym string")
    return all_.join(bwt.groupBy("sym").agg(F.count("*").alias("cnt")), "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def symbol_counts_of_runs(runs: DataFrame) -> DataFrame:
    all_ = runs.sparkSession.createDataFrame([(c,) for c in SYMBOLS], "sym string")
    return all_.join(runs.groupBy("sym").agg(F.sum("len").alias("cnt")), "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def f_offsets(counts: DataFrame) -> DataFrame:
    """(sym, cnt, start_idx, end_idx): where each symbol's rows begin and end in sorted order. Six rows."""
    upto = F.sum("cnt").over(Window.orderBy("sym"))
    return counts.select("sym", "cnt", (upto - F.col("cnt")).alias("start_idx"), upto.alias("end_idx"))


def offset_map(*bwts: DataFrame, symbol: str = "sym") -> DataFrame:
    """(sym, offset) for the symbols present in any input: how many smaller ones all inputs hold. Any orderable symbols."""
    rows = bwts[0].select(F.col(symbol).alias("sym"))
    for b in bwts[1:]:
        rows = rows.unionAll(b.select(F.col(symbol).alias("sym")))
    counts = rows.groupBy("sym").agg(F.count("*").alias("cnt"))
    return counts.select("sym", (F.sum("cnt").over(Window.orderBy("sym")) - F.col("cnt")).alias("offset"))


def total_size(reads: DataFrame) -> DataFrame:
    """One row: BWT rows of a collection, without building it."""
    return reads.agg(F.coalesce(F.sum(F.length("s").cast("long") + 1), F.lit(0)).alias("total"))


def read_count(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("reads"))


def layout(runs: DataFrame) -> DataFrame:
    """One row on how a collection compresses: runs, symbols, mean run length."""
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("len"), F.lit(0)).alias("symbols"), (F.sum("len") / F.count("*")).alias("mean_run"))


def observed(bwt: DataFrame, met: Observation) -> DataFrame:
    """The same rows; once they have been used, ``met`` holds how many of each symbol there were, in the order of the alphabet."""
    return bwt.observe(met, *[F.sum((F.col("sym") == c).cast("long")).alias(c) for c in SYMBOLS])
