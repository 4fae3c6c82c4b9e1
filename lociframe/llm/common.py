"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator here.
SPACE = "\x20\x09-\x0d"
WORD_RE = re.compile(f"[^{SPACE}]+")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share; one of our own only where none is set (tests)."""
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


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: executors lost later cost no recomputation, and the table is read rather than made
    twice when two branches of a plan need it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lociframe/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Remove a table that :func:`durable` wrote, when nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/lociframe/" in f}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variation of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name = want
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def remainder(key: Column, modulus: int) -> Column:
    """CRC-32 of the key as text, modulo ``modulus``; null keys count as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus)).cast("int")


def crc_remainder(key: object, modulus: int) -> int:
    """:func:`remainder` for one Python value."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def share_of(hashed: Column, share: Column | float) -> Column:
    """True for about ``share`` of all 64-bit hashes, to the precision of a double however small the share is."""
    wanted = share if isinstance(share, Column) else F.lit(float(share))
    return F.shiftrightunsigned(hashed, 1).cast("double") <= wanted * float(1 << 63)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
