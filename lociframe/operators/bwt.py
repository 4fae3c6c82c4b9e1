"""The multi-string BWT of a read collection: (pos LONG, sym STRING)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.ordered import materialize, number_rows, release


def suffix_rows(reads: DataFrame) -> DataFrame:
    """(rid, s, p, suf, sym): every suffix of every read, the empty one included, and the symbol before it."""
    p = F.explode(F.sequence(F.lit(0), F.length("s"))).alias("p")
    return reads.select("rid", "s", p).select("rid", "s", "p", F.expr("substring(s, p + 1)").alias("suf"), F.expr("CASE WHEN p = 0 THEN '$' ELSE substring(s, p, 1) END").alias("sym"))


def total_rows(reads: DataFrame) -> int:
    return reads.agg(F.sum(F.length("s").cast("long") + 1)).first()[0] or 0


def order_suffixes(reads: DataFrame, sorted_order: bool = True, most_in_one_task: int | None = None) -> DataFrame:
    """Suffix rows with their place: by suffix and then whole read (lexicographic) or read number (chronological).

    ``$`` sorts below the bases and a prefix before what it begins, so the order of rotations is this one.
    """
    keys = ["suf", "s", "rid"] if sorted_order else ["suf", "rid"]
    return number_rows(suffix_rows(reads), keys, "pos", total_rows(reads), most_in_one_task)


def build(reads: DataFrame, sorted_order: bool = True, most_in_one_task: int | None = None) -> DataFrame:
    """The BWT of short reads. Suffix text costs half the square of a read's length: for long reads use :func:`build_long`."""
    return order_suffixes(reads, sorted_order, most_in_one_task).select("pos", "sym")


#: Characters of suffix text for each BWT row above which reads count as long.
LONG_SUFFIXES = 512


def build_any(reads: DataFrame, sorted_order: bool = True) -> DataFrame:
    """The BWT by suffix text or, where that is counted to be long, by doubling (lexicographic order only)."""
    n = F.length("s").cast("double")
    rows, text = reads.agg(F.sum(n + 1), F.sum(n * (n + 1) / 2)).first()
    return build_long(reads) if sorted_order and rows and text / rows > LONG_SUFFIXES else build(reads, sorted_order)


def build_bucketed(reads: DataFrame, sorted_order: bool = True, width: int = 4) -> DataFrame:
    """The same BWT from buckets of suffixes that share their first ``width`` symbols, for reads of mixed content.

    Bucket sizes are counted first, from the reads alone: at most 6**width + 6**(width-1) + ... rows, which are
    broadcast. Low-complexity reads fill few buckets; :func:`build` cuts ranges by size instead.
    """
    from pyspark.sql.window import Window

    keys = ["suf", "s", "rid"] if sorted_order else ["suf", "rid"]
    rows = suffix_rows(reads).withColumn("_bucket", F.substring("suf", 1, width))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return rows.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_bucket").select((F.col("_start") + F.col("_i")).alias("pos"), "sym")


def build_long(reads: DataFrame) -> DataFrame:
    """The lexicographic BWT by cyclic prefix doubling: no suffix text, so long reads cost what their length is.

    Rank of a place by its first 2k symbols = rank of the pair (rank by k symbols here, rank k places on, wrapping
    at the read's end). Stops when 2k covers the longest read; reads that are equal keep equal ranks and equal
    symbols, so their order doesn't show.
    """
    sym = F.expr("CASE WHEN p = 0 THEN '$' ELSE substring(s, p, 1) END")
    rank = F.expr("CASE WHEN p = length(s) THEN 0 ELSE instr('$ACGNT', substring(s, p + 1, 1)) - 1 END").cast("long")
    rows = reads.select("rid", "s", F.explode(F.sequence(F.lit(0), F.length("s"))).alias("p"))
    rows = materialize(rows.select("rid", "p", (F.length("s") + 1).alias("n"), sym.alias("sym"), rank.alias("rk")), "doubling")
    longest = rows.agg(F.max("n")).first()[0] or 0
    k = 1
    while k < longest:
        ahead = rows.select("rid", ((F.col("p") - k % F.col("n") + F.col("n")) % F.col("n")).alias("p"), F.col("rk").alias("rk2"))
        pairs = materialize(rows.join(ahead, ["rid", "p"]), "doubling")
        dense = number_rows(pairs.select("rk", "rk2").distinct(), ["rk", "rk2"], "_new")
        done = rows
        rows = materialize(pairs.join(dense, ["rk", "rk2"]).select("rid", "p", "n", "sym", F.col("_new").alias("rk")), "doubling")
        release(pairs)
        release(done)
        k *= 2
    return number_rows(rows, ["rk", "rid", "p"], "pos").select("pos", "sym")


def as_string(bwt: DataFrame) -> str:
    """The whole BWT as one string, a partition at a time; for small ones and for standard output."""
    return "".join(r.sym for r in bwt.orderBy("pos").select("sym").toLocalIterator())
