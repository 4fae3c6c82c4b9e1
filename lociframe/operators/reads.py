"""Read collections: (rid LONG, s STRING), s over ACGNT."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.functions import alphabet

READS = T.StructType([T.StructField("rid", T.LongType(), False), T.StructField("s", T.StringType(), False)])
#: Hex digits of a digest to bases: a read of 32 bases from any key.
_DIGEST = ("0123456789abcdef", "ACGTACGTACGTACGN")


def from_strings(spark: SparkSession, strings: Iterable[str], first: int = 0) -> DataFrame:
    """Reads in the given order, normalised byte by byte; ``$`` in a read is refused."""
    rows = [(first + i, s) for i, s in enumerate(strings)]
    return checked(spark.createDataFrame(rows, READS).select("rid", alphabet.normalize("s").alias("s")))


def checked(reads: DataFrame) -> DataFrame:
    """Null reads go; a read with ``$`` or any other symbol outside ACGNT raises an error when it is met."""
    return reads.where("s IS NOT NULL").select("rid", alphabet.checked_read("s").alias("s"))


def from_keys(table: DataFrame, key: str, modulus: int | None = None) -> DataFrame:
    """A read of 32 bases for every row, drawn from the digest of its key; a modulus makes reads repeat."""
    of = F.col(key) if modulus is None else F.col(key) % modulus
    return table.select(F.col(key).cast("long").alias("rid"), F.translate(F.md5(of.cast("string")), *_DIGEST).alias("s"))


def from_texts(table: DataFrame, key: str, text: str, length: int | None = None) -> DataFrame:
    """Texts as reads, byte by byte, ``$`` as N; ``length`` cuts them into windows of so many bases.

    Windows are numbered key * 2**20 + window.
    """
    s = F.translate(alphabet.normalize(text), "$", "N")
    rows = table.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("rid"), s.alias("s"))
    if length is None:
        return rows
    # Texts are ASCII by now: one pass cuts them, and the empty text is one empty window.
    parts = F.when(F.length("s") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("s", F.lit(f"(.{{1,{length}}})"), F.lit(1)))
    return rows.select("rid", F.posexplode(parts).alias("_k", "s")).select((F.col("rid") * (1 << 20) + F.col("_k")).alias("rid"), "s")
