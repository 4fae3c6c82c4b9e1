"""FM-index tables, the backward step, and backward search over them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.alphabet import SYMBOLS, checked_kmer, run_bytes
from lociframe.operators.ordered import materialize, release, running_sums
from lociframe.operators.stats import f_offsets, symbol_counts

#: Positions between samples, as bits.
BIN_POWER = 8
_RANKS = {f"o{i}": c for i, c in enumerate(SYMBOLS)}


def occ(bwt: DataFrame) -> DataFrame:
    """(pos, o0..o5): how often each symbol occurs before ``pos``, for pos from 0 to the number of rows."""
    flags = {n: (F.col("sym") == c).cast("long") for n, c in _RANKS.items()}
    inner = running_sums(bwt, flags).select("pos", *_RANKS)
    last = bwt.agg(F.count("*").alias("pos"), *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in flags.items()])
    return inner.unionAll(last)


def sampled(runs: DataFrame, bin_power: int = BIN_POWER) -> DataFrame:
    """(bin, ref, c0..c5): for each bin the byte offset of the run with its first position, and the symbols before that run; then totals."""
    size = 1 << bin_power
    rows = runs.withColumn("_bytes", F.size(run_bytes("sym", "len")).cast("long"))
    own = {f"c{i}": F.when(F.col("sym") == c, F.col("len")).otherwise(0) for i, c in enumerate(SYMBOLS)}
    at = running_sums(rows, {"ref": F.col("_bytes"), **own}, "run_id")
    first, last = F.ceil(F.col("start_pos") / size), F.floor((F.col("start_pos") + F.col("len") - 1) / size)
    inner = at.where(first <= last).select(F.explode(F.sequence(first, last)).alias("bin"), "ref", *own)
    tail = rows.agg(F.ceil(F.coalesce(F.sum("len"), F.lit(0)) / size).cast("long").alias("bin"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("ref"), *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in own.items()])
    return inner.unionAll(tail)


def packed(bwt: DataFrame, bin_power: int = BIN_POWER) -> DataFrame:
    """(bin, text, c0..c5): the symbols of each bin as a string and the counts before it: any rank is one lookup by bin."""
    bins = bwt.groupBy(F.shiftright("pos", bin_power).alias("bin")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), "").alias("text"))
    count = {f"c{i}": F.length("text") - F.length(F.translate("text", c, "")) for i, c in enumerate(SYMBOLS)}
    inner = running_sums(bins, count, "bin")
    tail = bwt.agg(F.shiftright(F.count("*") + (1 << bin_power) - 1, bin_power).alias("bin"), F.lit("").alias("text"), *[F.sum((F.col("sym") == c).cast("long")).alias(f"c{i}") for i, c in enumerate(SYMBOLS)])
    return inner.unionAll(tail.where("c0 IS NOT NULL"))


def _pick(symbol: Column, columns: list[Column]) -> Column:
    return F.element_at(F.array(*columns), (F.instr(F.lit(SYMBOLS), symbol)).cast("int"))


def constrain_range(ranges: DataFrame, table: DataFrame, offsets: DataFrame) -> DataFrame:
    """One backward step: (qid, sym, l, h) to the rows whose suffix begins with sym and goes on as rows l..h do.

    ``table`` is :func:`occ`; both ends are equal-key lookups. offsets: six rows of :func:`f_offsets`.
    """
    low = table.select(F.col("pos").alias("l"), *[F.col(c).alias(f"_l{c}") for c in _RANKS])
    high = table.select(F.col("pos").alias("h"), *[F.col(c).alias(f"_h{c}") for c in _RANKS])
    start = F.broadcast(offsets.select("sym", "start_idx"))
    out = ranges.join(low, "l").join(high, "h").join(start, "sym")
    return out.select("qid", "sym", (F.col("start_idx") + _pick(F.col("sym"), [F.col(f"_l{c}") for c in _RANKS])).alias("l"), (F.col("start_idx") + _pick(F.col("sym"), [F.col(f"_h{c}") for c in _RANKS])).alias("h"))


class KmerIndex(Protocol):
    """What an index answers; :class:`RelationalIndex` and :class:`BroadcastIndex` do so in different ways."""

    @classmethod
    def load_vector(cls, rle_bytes: DataFrame, bin_power: int = BIN_POWER) -> KmerIndex: ...

    @classmethod
    def load_npy(cls, spark: SparkSession, path: str, bin_power: int = BIN_POWER) -> KmerIndex: ...

    def symbol_counts(self) -> DataFrame: ...

    def total_size(self) -> int: ...

    def constrain_range(self, ranges: DataFrame) -> DataFrame: ...

    def count_kmers(self, queries: DataFrame) -> DataFrame: ...


class _Loads:
    """Indexes of run-length bytes (off, byte) and of ``.npy`` files of them."""

    @classmethod
    def load_vector(cls, rle_bytes: DataFrame, bin_power: int = BIN_POWER):
        from lociframe.operators import rle

        return cls(materialize(rle.expand(rle.from_bytes(rle_bytes)), "loaded"), bin_power)

    @classmethod
    def load_npy(cls, spark: SparkSession, path: str, bin_power: int = BIN_POWER):
        from lociframe.sources import npy

        return cls.load_vector(npy.read_npy(spark, path), bin_power)


class RelationalIndex(_Loads):
    """Backward search as joins: a round a symbol, for any size of BWT. Suffixes whose range is empty leave the loop."""

    def __init__(self, bwt: DataFrame, bin_power: int = BIN_POWER) -> None:
        self.bin_power = bin_power
        self.table = materialize(packed(bwt, bin_power), "fm")
        self.counts = materialize(symbol_counts(bwt), "counts")
        self.offsets = f_offsets(self.counts)
        self._total = self.counts.agg(F.sum("cnt")).first()[0]

    def symbol_counts(self) -> DataFrame:
        return self.counts

    def total_size(self) -> int:
        return self._total

    def _rank(self, rows: DataFrame, at: str, name: str) -> DataFrame:
        """Adds how often _c occurs before position ``at``."""
        table = self.table.select(F.col("bin").alias("_bin"), "text", *[F.col(f"c{i}") for i in range(6)])
        joined = rows.withColumn("_bin", F.shiftright(at, self.bin_power)).join(table, "_bin")
        head = F.expr(f"substring(text, 1, cast({at} & {(1 << self.bin_power) - 1} AS INT))")
        inside = F.length(head) - F.length(F.replace(head, F.col("_c"), F.lit("")))
        rank = _pick(F.col("_c"), [F.col(f"c{i}") for i in range(6)]) + inside
        return joined.select(*[F.col(c) for c in rows.columns], rank.alias(name))

    def constrain_range(self, ranges: DataFrame) -> DataFrame:
        """One backward step of (qid, sym, l, h); ends beyond the last row are that row's end."""
        start = F.broadcast(self.offsets.select(F.col("sym").alias("_c"), "start_idx"))
        ranked = self._rank(self._rank(ranges.withColumn("_c", F.col("sym")), "l", "_rl"), "h", "_rh").join(start, "_c")
        return ranked.select("qid", "sym", (F.col("start_idx") + F.col("_rl")).alias("l"), (F.col("start_idx") + F.col("_rh")).alias("h"))

    def suffix_ranges(self, kmers: DataFrame) -> DataFrame:
        """(kmer, l, h) for every suffix of ``kmers`` (kmer) that occurs: a written table, for the caller to release.

        A suffix that many k-mers have is searched once: its range is that of the suffix one symbol shorter, one step
        back. The first symbol's ranges are the offsets.
        """
        at = F.explode(F.sequence(F.lit(1), F.length("kmer")))
        all_ = kmers.where("kmer <> ''").select("kmer", at.alias("_p")).select(F.expr("substring(kmer, _p)").alias("kmer")).distinct()
        all_ = materialize(all_.select("kmer", F.length("kmer").alias("_n")), "suffixes")
        longest = all_.agg(F.max("_n")).first()[0] or 0
        state = all_.where("_n = 1").join(F.broadcast(self.offsets), F.col("kmer") == F.col("sym")).where("start_idx < end_idx")
        states = [materialize(state.select("kmer", F.col("start_idx").alias("l"), F.col("end_idx").alias("h")), "search")]
        for n in range(2, longest + 1):
            shorter = states[-1].select(F.col("kmer").alias("_shorter"), "l", "h")
            going = all_.where(F.col("_n") == n).select("kmer", F.expr("substring(kmer, 2)").alias("_shorter")).join(shorter, "_shorter")
            stepped = self.constrain_range(going.select(F.col("kmer").alias("qid"), F.expr("substring(kmer, 1, 1)").alias("sym"), "l", "h"))
            states.append(materialize(stepped.where("l < h").select(F.col("qid").alias("kmer"), "l", "h"), "search"))
        found = states[0]
        for state in states[1:]:
            found = found.unionAll(state)
        out = materialize(found, "ranges")
        for done in (all_, *states):
            release(done)
        return out

    def count_kmers(self, queries: DataFrame) -> DataFrame:
        """(qid, kmer, n); see :func:`lociframe.operators.kmer.count_kmers`."""
        asked = materialize(queries.select("qid", checked_kmer("kmer").alias("kmer")), "queries")
        found = self.suffix_ranges(asked.where("kmer IS NOT NULL").select("kmer").distinct())
        n = F.when(F.col("kmer") == "", F.lit(self._total)).when(F.col("kmer").isNotNull(), F.coalesce(F.col("h") - F.col("l"), F.lit(0)))
        return asked.join(found, "kmer", "left").select("qid", "kmer", n.cast("long").alias("n"))


def _search(codes: np.ndarray, samples: np.ndarray, start: np.ndarray, power: int, kmers: list[str], total: int) -> np.ndarray:
    """Occurrences of each k-mer: all are taken back together, a symbol at a time, from the right."""
    low, high = np.zeros(len(kmers), np.int64), np.full(len(kmers), total, np.int64)
    size = np.fromiter(map(len, kmers), np.int64, len(kmers))
    letter = np.full(256, -1, np.int64)
    letter[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
    text = np.frombuffer("".join(kmers).encode(), np.uint8)
    end = np.cumsum(size)
    step = np.arange(1 << power)
    padded = np.concatenate([codes, np.full(1 << power, -1, np.int8)])

    def rank(c: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 14):  # a window of a bin's codes for each
            cc, ii = c[a : a + (1 << 14)], i[a : a + (1 << 14)]
            first = ii >> power << power
            window = padded[np.minimum(first, len(codes))[:, None] + step] == cc[:, None]
            out[a : a + (1 << 14)] = samples[ii >> power, cc] + (window & (step < (ii - first)[:, None])).sum(axis=1)
        return out

    for k in range(1, int(size.max(initial=0)) + 1):
        at = np.flatnonzero((size >= k) & (low < high))
        if not len(at):
            break
        c = letter[text[end[at] - k]]
        if k == 1:  # the first symbol's range is its rows
            low[at], high[at] = start[c], start[c] + samples[-1, c]
            continue
        state, back = np.unique(np.column_stack([c, low[at], high[at]]), axis=0, return_inverse=True)
        back = back.ravel()
        low[at], high[at] = ((start[state[:, 0]] + rank(state[:, 0], state[:, j]))[back] for j in (1, 2))
    return np.maximum(0, high - low)


class BroadcastIndex(_Loads):
    """Backward search in numpy over a broadcast index, for a BWT of checked size and many queries.

    Takes one byte for each symbol and 48 for each bin; above ``most`` symbols it refuses, and
    :class:`RelationalIndex` is the way.
    """

    def __init__(self, bwt: DataFrame, bin_power: int = BIN_POWER, most: int = 200_000_000) -> None:
        self.spark, self.bin_power = bwt.sparkSession, bin_power
        self.counts = symbol_counts(bwt)
        self._total = bwt.count()
        if self._total > most:
            raise ValueError(f"{self._total} symbols are too many to broadcast; use RelationalIndex")
        from lociframe.functions.alphabet import code

        table = bwt.select("pos", code("sym").cast("byte").alias("c")).toArrow()
        codes = np.empty(self._total, np.int8)
        codes[table["pos"].to_numpy()] = table["c"].to_numpy()
        size = 1 << bin_power
        bins = -(-len(codes) // size) + 1
        samples = np.zeros((bins, 6), np.int64)
        padded = np.append(codes, np.full((bins - 1) * size - len(codes), -1, np.int8)).reshape(-1, size)
        for c in range(6):
            samples[1:, c] = np.cumsum((padded == c).sum(axis=1))
        start = np.concatenate([[0], np.cumsum(samples[-1])[:-1]])
        self.state = self.spark.sparkContext.broadcast((codes, samples, start))

    def symbol_counts(self) -> DataFrame:
        return self.counts

    def total_size(self) -> int:
        return self._total

    def constrain_range(self, ranges: DataFrame) -> DataFrame:
        """One backward step of (qid, sym, l, h)."""
        state, power = self.state, self.bin_power

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, samples, start = state.value
            for batch in batches:
                ends = []
                for name in ("l", "h"):
                    out = []
                    for ch, i in zip(batch.column("sym").to_pylist(), batch.column(name).to_pylist(), strict=True):
                        c, b = SYMBOLS.index(ch), i >> power
                        out.append(int(start[c] + samples[b, c] + np.count_nonzero(codes[b << power : i] == c)))
                    ends.append(pa.array(out, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("sym"), *ends], names=["qid", "sym", "l", "h"])

        kind = ranges.schema["qid"].dataType.simpleString()
        return ranges.select("qid", "sym", "l", "h").mapInArrow(step, f"qid {kind}, sym string, l bigint, h bigint")

    def count_kmers(self, queries: DataFrame) -> DataFrame:
        state, power, total = self.state, self.bin_power, self._total

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, samples, start = state.value
            for batch in batches:
                kmers = batch.column("kmer")
                found = _search(codes, samples, start, power, kmers.fill_null("").to_pylist(), total)
                yield pa.RecordBatch.from_arrays([batch.column("qid"), kmers, pa.array(found, mask=kmers.is_null().to_numpy(zero_copy_only=False))], names=["qid", "kmer", "n"])

        return queries.select("qid", checked_kmer("kmer").alias("kmer")).mapInArrow(search, "qid bigint, kmer string, n bigint")
