"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import gzip
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import alphabet
from lociframe.operators import bwt, fm, kmer, merge, reads, rle, stats
from lociframe.operators.ordered import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Copies: every so many customers share a read.
DISTINCT = 900
_DNA = "translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN')"
_READS = f"reads AS (SELECT CAST(c_custkey AS BIGINT) AS rid, {_DNA.format(key=f'(c_custkey % {DISTINCT})')} AS s FROM customer)"
_SUFFIX = """suffixes AS (
  SELECT rid, s, CAST(p AS BIGINT) AS p, substr(s, p + 1) AS suf, CASE WHEN p = 0 THEN '$' ELSE substr(s, p, 1) END AS sym
  FROM (SELECT rid, s, unnest(range(0, length(s) + 1)) AS p FROM reads))"""
_BWT = "bwt AS (SELECT row_number() OVER (ORDER BY suf, s, rid) - 1 AS pos, sym FROM suffixes)"
_ALL = f"WITH {_READS}, {_SUFFIX}, {_BWT}"
_RUNS = """marked AS (SELECT pos, sym, CASE WHEN lag(sym) OVER (ORDER BY pos) = sym THEN 0 ELSE 1 END AS new FROM bwt),
runs AS (SELECT CAST(run AS BIGINT) AS run_id, sym, min(pos) AS start_pos, count(*) AS len
  FROM (SELECT pos, sym, sum(new) OVER (ORDER BY pos) - 1 AS run FROM marked) GROUP BY run, sym)"""
_CODE = "(instr('$ACGNT', sym) - 1)"
_BYTES = f"""digits AS (SELECT run_id, d, CAST({_CODE} + 8 * ((len >> (5 * d)) & 31) AS INTEGER) AS byte
  FROM runs, range(0, 13) r(d) WHERE d = 0 OR (len >> (5 * d)) > 0),
rle AS (SELECT row_number() OVER (ORDER BY run_id, d) - 1 AS off, byte FROM digits)"""
_COUNTS = "counts AS (SELECT a.sym, count(b.sym) AS cnt FROM (VALUES ('$'), ('A'), ('C'), ('G'), ('N'), ('T')) a(sym) LEFT JOIN bwt b ON a.sym = b.sym GROUP BY a.sym)"
_OFFSETS = "offsets AS (SELECT sym, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY sym) - cnt, 0) AS BIGINT) AS start_idx, CAST(sum(cnt) OVER (ORDER BY sym) AS BIGINT) AS end_idx FROM counts)"
_SYMBOLS = alphabet.SYMBOLS
_OCC = "occ AS (SELECT pos, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN sym = '{c}' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS o{i}" for i, c in enumerate(_SYMBOLS)) + (
    " FROM (SELECT pos, sym FROM bwt UNION ALL SELECT count(*), NULL FROM bwt) WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The reads most queries run on: one of 32 bases a customer, with copies."""
    return reads.from_keys(table(spark, sf, "customer"), "c_custkey", DISTINCT)


def base_bwt(spark: SparkSession, sf: str) -> DataFrame:
    return bwt.build(base_reads(spark, sf))


def stored_bwt(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(base_bwt(spark, sf), "bwt")


# Scalar functions


@query(f"WITH {_READS} SELECT rid, CAST(list_transform(string_split(s, ''), lambda c: CAST(instr('$ACGNT', c) - 1 AS INTEGER)) AS VARCHAR) AS codes FROM reads")
def encode_codes(spark: SparkSession, sf: str) -> DataFrame:
    return base_reads(spark, sf).select("rid", F.concat(F.lit("["), F.array_join(alphabet.to_codes("s"), ", "), F.lit("]")).alias("codes"))


@query(f"WITH {_READS} SELECT rid, s AS decoded FROM reads")
def decode_codes(spark: SparkSession, sf: str) -> DataFrame:
    return base_reads(spark, sf).select("rid", alphabet.from_codes(alphabet.to_codes("s")).alias("decoded"))


@query(
    r"""SELECT doc_id, md5(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[\x{80}-\x{7FF}]', 'NN', 'g'), '[\x{800}-\x{FFFF}]', 'NNN', 'g'), '[\x{10000}-\x{10FFFF}]', 'NNNN', 'g'),
    '[^$ACGNTacgnt]', 'N', 'gs'), 'acgnt', 'ACGNT')) AS digest FROM documents"""
)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(alphabet.normalize("text")).alias("digest"))


@query(f"WITH {_READS} SELECT rid, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return base_reads(spark, sf).select("rid", alphabet.reverse_complement("s").alias("rc"))


@query(f"WITH {_READS} SELECT rid, regexp_matches(s, '^[$ACGT]*$') AS plain FROM reads")
def alphabet_check(spark: SparkSession, sf: str) -> DataFrame:
    return base_reads(spark, sf).select("rid", (alphabet.is_kmer("s") & ~F.contains("s", F.lit("N"))).alias("plain"))


@query(f"WITH {_READS}, {_SUFFIX} SELECT rid, p, suf, sym FROM suffixes")
def suffix_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bwt.suffix_rows(base_reads(spark, sf)).select("rid", F.col("p").cast("long").alias("p"), "suf", "sym")


# Building

_SORTED = f"{_ALL} SELECT pos, sym FROM bwt"


@query(_SORTED)
def bwt_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return base_bwt(spark, sf)


@query(f"WITH {_READS}, {_SUFFIX} SELECT row_number() OVER (ORDER BY suf, rid) - 1 AS pos, sym FROM suffixes")
def bwt_chronological(spark: SparkSession, sf: str) -> DataFrame:
    return bwt.build(base_reads(spark, sf), sorted_order=False)


@query(_SORTED)
def bwt_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return bwt.build_bucketed(base_reads(spark, sf))


@query(_SORTED)
def bwt_doubling(spark: SparkSession, sf: str) -> DataFrame:
    return bwt.build_long(base_reads(spark, sf))


@query(
    r"""WITH reads AS (SELECT doc_id AS rid, translate(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[\x{80}-\x{7FF}]', 'NN', 'g'), '[\x{800}-\x{FFFF}]', 'NNN', 'g'), '[\x{10000}-\x{10FFFF}]', 'NNNN', 'g'),
    '[^$ACGNTacgnt]', 'N', 'gs'), 'acgnt', 'ACGNT'), '$', 'N') AS whole FROM documents),
    parts AS (SELECT rid * 1048576 + k AS rid, substr(whole, k * 48 + 1, 48) AS s FROM (SELECT rid, whole, unnest(range(0, greatest(1, CAST(ceil(length(whole) / 48.0) AS BIGINT)))) AS k FROM reads))
    SELECT left(s, 4) AS head, count(*) AS windows, sum(length(s) + 1)::BIGINT AS symbols FROM parts GROUP BY 1"""
)
def text_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads.from_texts(table(spark, sf, "documents"), "doc_id", "text", 48)
    return rows.groupBy(F.expr("left(s, 4)").alias("head")).agg(F.count("*").alias("windows"), F.sum(F.length("s").cast("long") + 1).alias("symbols"))


# Counts and offsets


@query(f"{_ALL}, {_COUNTS} SELECT sym, cnt FROM counts")
def symbol_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.symbol_counts(base_bwt(spark, sf))


@query(f"{_ALL}, {_COUNTS} SELECT sym, cnt FROM counts")
def symbol_counts_rle(spark: SparkSession, sf: str) -> DataFrame:
    return stats.symbol_counts_of_runs(rle.runs(stored_bwt(spark, sf)))


@query(f"WITH {_READS} SELECT CAST(sum(length(s) + 1) AS BIGINT) AS total FROM reads")
def total_size(spark: SparkSession, sf: str) -> DataFrame:
    return stats.total_size(base_reads(spark, sf))


@query(f"WITH {_READS} SELECT count(*) AS reads FROM reads")
def read_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.read_count(base_reads(spark, sf))


@query(f"{_ALL}, {_COUNTS}, {_OFFSETS} SELECT sym, cnt, start_idx, end_idx FROM offsets")
def f_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.f_offsets(stats.symbol_counts(base_bwt(spark, sf)))


@query(f"{_ALL}, {_COUNTS}, {_OFFSETS} SELECT sym, start_idx AS \"offset\" FROM offsets WHERE cnt > 0")
def offset_map_present(spark: SparkSession, sf: str) -> DataFrame:
    half = [base_bwt(spark, sf).where((F.col("pos") % 2) == k) for k in (0, 1)]
    return stats.offset_map(*half)


@query(f"{_ALL}, {_RUNS} SELECT count(*) AS runs, CAST(sum(len) AS BIGINT) AS symbols, CAST(sum(len) AS DOUBLE) / count(*) AS mean_run FROM runs")
def index_layout(spark: SparkSession, sf: str) -> DataFrame:
    return stats.layout(rle.runs(stored_bwt(spark, sf)))


# Runs and bytes


@query(f"{_ALL}, {_RUNS} SELECT run_id, sym, start_pos, len FROM runs")
def bwt_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rle.runs(stored_bwt(spark, sf))


@query(f"{_ALL}, {_RUNS}, {_BYTES} SELECT off, byte FROM rle")
def rle_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return rle.to_bytes(rle.runs(stored_bwt(spark, sf)))


@query(f"{_ALL}, {_RUNS} SELECT run_id, sym, start_pos, len FROM runs")
def rle_decode(spark: SparkSession, sf: str) -> DataFrame:
    return rle.from_bytes(materialize(rle.to_bytes(rle.runs(stored_bwt(spark, sf))), "rle"))


@query(_SORTED)
def rle_expand(spark: SparkSession, sf: str) -> DataFrame:
    return rle.expand(rle.runs(stored_bwt(spark, sf)))


# Ranks and index


@query(f"{_ALL}, {_OCC} SELECT * FROM occ")
def occ_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fm.occ(stored_bwt(spark, sf))


_FM_RUNS = "placed AS (SELECT *, " + ", ".join(f"coalesce(sum(CASE WHEN sym = '{c}' THEN len ELSE 0 END) OVER w, 0) AS c{i}" for i, c in enumerate(_SYMBOLS)) + (
    ", coalesce(sum(nb) OVER w, 0) AS ref FROM (SELECT *, (SELECT count(*) FROM range(0, 13) r(d) WHERE d = 0 OR (len >> (5 * d)) > 0) AS nb FROM runs)"
    " WINDOW w AS (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


@query(
    f"{_ALL}, {_RUNS}, {_FM_RUNS} SELECT CAST(b.bin AS BIGINT) AS bin, CAST(ref AS BIGINT) AS ref, "
    + ", ".join(f"CAST(c{i} AS BIGINT) AS c{i}" for i in range(6))
    + " FROM placed, range(0, (SELECT count(*) // 256 + 1 FROM bwt)) b(bin) WHERE b.bin * 256 BETWEEN start_pos AND start_pos + len - 1 UNION ALL SELECT CAST(ceil(sum(len) / 256.0) AS BIGINT), CAST(sum(nb) AS BIGINT), "
    + ", ".join(f"CAST(sum(CASE WHEN sym = '{c}' THEN len ELSE 0 END) AS BIGINT)" for c in _SYMBOLS)
    + " FROM placed"
)
def fm_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return fm.sampled(rle.runs(stored_bwt(spark, sf)))


_PICK = "CASE r.sym " + " ".join(f"WHEN '{c}' THEN {{t}}.o{i}" for i, c in enumerate(_SYMBOLS)) + " END"


@query(
    f"{_ALL}, {_OCC}, {_COUNTS}, {_OFFSETS}, ranges AS (SELECT c_custkey AS qid, substr('ACGNT', CAST(c_custkey % 5 AS INTEGER) + 1, 1) AS sym, c_custkey AS l, c_custkey + c_custkey % 97 AS h FROM customer)"
    f" SELECT r.qid, r.sym, s.start_idx + {_PICK.format(t='a')} AS l, s.start_idx + {_PICK.format(t='b')} AS h"
    " FROM ranges r JOIN occ a ON a.pos = r.l JOIN occ b ON b.pos = r.h JOIN offsets s ON s.sym = r.sym"
)
def constrain_range_step(spark: SparkSession, sf: str) -> DataFrame:
    built = stored_bwt(spark, sf)
    key = F.col("c_custkey")
    ranges = table(spark, sf, "customer").select(key.alias("qid"), F.substring(F.lit("ACGNT"), (key % 5).cast("int") + 1, F.lit(1)).alias("sym"), key.alias("l"), (key + key % 97).alias("h"))
    return fm.constrain_range(ranges, fm.occ(built), stats.f_offsets(stats.symbol_counts(built)))


# k-mer queries

_KMERS = "SELECT substr(s, p, {k}) AS kmer FROM (SELECT s, unnest(range(1, length(s) - {k} + 2)) AS p FROM reads WHERE length(s) >= {k})"


def batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A query a order: the first 1 to 8 bases of the order's own read."""
    own = reads.from_keys(table(spark, sf, "orders"), "o_orderkey")
    return own.select(F.col("rid").alias("qid"), F.expr("substring(s, 1, CAST(rid % 8 AS INT) + 1)").alias("kmer"))


_QUERIES = f"queries AS (SELECT CAST(o_orderkey AS BIGINT) AS qid, substr({_DNA.format(key='o_orderkey')}, 1, CAST(o_orderkey % 8 AS INTEGER) + 1) AS kmer FROM orders)"
_BATCH = (
    f"WITH {_READS}, {_QUERIES}, every AS ("
    + " UNION ALL ".join(f"SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=k)}) GROUP BY kmer" for k in range(1, 9))
    + ") SELECT qid, q.kmer, coalesce(n, 0) AS n FROM queries q LEFT JOIN every e ON q.kmer = e.kmer"
)


@query(_BATCH)
def count_kmer_batch(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.count_kmers(base_reads(spark, sf), batch_queries(spark, sf))


@query(_BATCH)
def count_kmer_fm(spark: SparkSession, sf: str) -> DataFrame:
    return fm.RelationalIndex(stored_bwt(spark, sf)).count_kmers(batch_queries(spark, sf))


@query(_BATCH)
def count_kmer_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    return fm.BroadcastIndex(stored_bwt(spark, sf)).count_kmers(batch_queries(spark, sf))


@query(
    f"WITH {_READS}, {_QUERIES}, every AS ("
    + " UNION ALL ".join(f"SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=k)}) GROUP BY kmer" for k in range(1, 9))
    + ") SELECT qid, q.kmer, coalesce(e.n, 0) + coalesce(f.n, 0) AS n FROM queries q LEFT JOIN every e ON q.kmer = e.kmer LEFT JOIN every f ON reverse(translate(q.kmer, 'ACGT', 'TGCA')) = f.kmer"
)
def count_kmer_both_strands(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.count_kmers(base_reads(spark, sf), batch_queries(spark, sf), both_strands=True)


@query(f"WITH {_READS} SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=8)}) GROUP BY kmer")
def kmer_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.spectrum(base_reads(spark, sf), 8)


@query(f"WITH {_READS} SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=6)}) GROUP BY kmer ORDER BY n DESC, kmer LIMIT 100")
def kmer_topk(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.top_kmers(base_reads(spark, sf), 6, 100)


@query(f"WITH {_READS} SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM ({_KMERS.format(k=7)}) GROUP BY 1")
def canonical_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.canonical_spectrum(base_reads(spark, sf), 7)


def _ends(spark: SparkSession, sf: str, form: str) -> DataFrame:
    own = reads.from_keys(table(spark, sf, "orders"), "o_orderkey")
    return own.select(F.col("rid").alias("qid"), F.expr(form).alias("kmer"))


def _ends_sql(form: str, match: str, shape: str) -> str:
    return (
        f"WITH {_READS}, q AS (SELECT CAST(o_orderkey AS BIGINT) AS qid, {_DNA.format(key='o_orderkey')} AS own FROM orders), k AS (SELECT qid, {form} AS kmer FROM q),"
        f" d AS (SELECT DISTINCT kmer FROM k), n AS (SELECT kmer, count(*) AS n FROM d JOIN reads ON {match} GROUP BY kmer) SELECT k.qid, k.kmer, coalesce(n.n, 0) AS n FROM k LEFT JOIN n ON k.kmer = n.kmer"
    )


@query(_ends_sql("'$' || substr(own, 1, 3)", "'$' || left(s, 3) = kmer", ""))
def prefix_count(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.count_kmers(base_reads(spark, sf), _ends(spark, sf, "concat('$', substring(s, 1, 3))"))


@query(_ends_sql("substr(own, 1, 3) || '$'", "right(s, 3) || '$' = kmer", ""))
def suffix_count(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.count_kmers(base_reads(spark, sf), _ends(spark, sf, "concat(substring(s, 1, 3), '$')"))


@query(_ends_sql("substr(own, 1, 2) || '$' || substr(own, 3, 1)", "right(s, 2) || '$' || left(s, 1) = kmer", ""))
def circular_count(spark: SparkSession, sf: str) -> DataFrame:
    return kmer.count_kmers(base_reads(spark, sf), _ends(spark, sf, "concat(substring(s, 1, 2), '$', substring(s, 3, 1))"))


# Merging


def _part(spark: SparkSession, sf: str, k: int, of: int) -> DataFrame:
    return materialize(bwt.build(base_reads(spark, sf).where(F.col("rid") % of == k)), "bwt")


@query(_SORTED)
def merge_bwt(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge(_part(spark, sf, 0, 2), _part(spark, sf, 1, 2))


@query(_SORTED)
def merge_bwt_many(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_all(*[_part(spark, sf, k, 3) for k in range(3)])


# Files and streams


def _folder(spark: SparkSession) -> str:
    from lociframe.operators.ordered import shared_dir

    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(dir=base)


@query(_SORTED)
def npy_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.sources import npy

    path = f"{_folder(spark)}/bwt.npy"
    npy.write_npy(materialize(rle.to_bytes(rle.runs(stored_bwt(spark, sf))), "rle"), path)
    return rle.expand(rle.from_bytes(materialize(npy.read_npy(spark, path), "rle")))


@query(_SORTED)
def ascii_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.sources import ascii_bwt

    path = f"{_folder(spark)}/bwt.txt"
    ascii_bwt.write_ascii(stored_bwt(spark, sf), path)
    return ascii_bwt.read_ascii(spark, path)


@query(_SORTED)
def fastx_build(spark: SparkSession, sf: str) -> DataFrame:
    """Reads written as a plain FASTA, a gzipped FASTA and a gzipped FASTQ file by the driver, then built from those."""
    from lociframe.sources import fastx

    folder = _folder(spark)
    paths = [f"{folder}/{n}" for n in ("a.fa", "b.fa.gz", "c.fq.gz")]
    files = [open(paths[0], "wt"), gzip.open(paths[1], "wt"), gzip.open(paths[2], "wt")]
    for i, r in enumerate(base_reads(spark, sf).toLocalIterator()):
        k = i % 3
        files[k].write(f"@{r.rid}\n{r.s}\n+\n{'I' * len(r.s)}\n" if k == 2 else f">{r.rid}\n{r.s[:20].lower()}\n{r.s[20:]}\n")
    for f in files:
        f.close()
    return bwt.build(fastx.read_fastx(spark, paths))


@query(_SORTED)
def stream_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Reads arrive as a stream of three micro-batches; each is merged into the BWT so far."""
    from lociframe.streaming.inserts import GrowingBwt

    folder = _folder(spark)
    rows = base_reads(spark, sf)
    for k in range(3):
        rows.where(F.col("rid") % 3 == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema("rid bigint, s string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    growing = GrowingBwt(spark, f"{folder}/index")
    growing.start(stream, f"{folder}/state").awaitTermination()
    return growing.bwt()


@query(f"WITH {_READS} SELECT kmer, count(*) AS n FROM ({_KMERS.format(k=8)}) GROUP BY kmer")
def stream_kmer_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.streaming.inserts import kmer_counts, run_to_memory

    folder = _folder(spark)
    rows = base_reads(spark, sf)
    for k in range(3):
        rows.where(F.col("rid") % 3 == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema("rid bigint, s string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    name = "kmers_" + os.path.basename(folder).replace("-", "_")
    run_to_memory(kmer_counts(stream, 8), name, f"{folder}/state")
    return spark.table(name)


# Paths for large inputs, files and commands on their own


@query(_SORTED)
def bwt_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The builder for tables that no single task numbers: ranges of the sort keys."""
    return bwt.build(base_reads(spark, sf), most_in_one_task=0)


_HALVES = """halves AS (SELECT rid, s, p, suf, sym, CAST(rid % 2 AS INTEGER) AS src FROM suffixes),
sided AS (SELECT src, sym, row_number() OVER (PARTITION BY src ORDER BY suf, s, rid) - 1 AS i FROM halves),
begun AS (SELECT src, sym, row_number() OVER (ORDER BY src, i) - 1 AS pos FROM sided)"""


@query(f"WITH {_READS}, {_SUFFIX}, {_HALVES} SELECT row_number() OVER (ORDER BY sym, pos) - 1 AS pos, src FROM begun")
def interleave_round(spark: SparkSession, sf: str) -> DataFrame:
    """One round of a merge, from all of the first before all of the second."""
    first, second = _part(spark, sf, 0, 2), _part(spark, sf, 1, 2)
    n = first.count()
    symbols = materialize(first.select(F.lit(0).alias("src"), F.col("pos").alias("i"), "sym").unionAll(second.select(F.lit(1), "pos", "sym")), "merge")
    offsets = {r.sym: r.offset for r in stats.offset_map(first, second).orderBy("sym").collect()}
    state = symbols.select(F.when(F.col("src") == 1, F.col("i") + n).otherwise(F.col("i")).alias("pos"), "src")
    return merge.interleave_step(state, symbols, offsets, list(offsets))


#: Bases of the reads of the merge that goes round by round, and how often one occurs.
_SHORT = 6


@query(
    f"WITH {_READS}, few AS (SELECT rid, substr(s, 1, {_SHORT}) AS s FROM reads), suffixes AS (SELECT rid, s, substr(s, p + 1) AS suf, CASE WHEN p = 0 THEN '$' ELSE substr(s, p, 1) END AS sym"
    f" FROM (SELECT rid, s, unnest(range(0, length(s) + 1)) AS p FROM few)) SELECT row_number() OVER (ORDER BY suf, s, rid) - 1 AS pos, sym FROM suffixes"
)
def merge_bwt_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The merge for inputs that no single task holds, over the first bases of each read: rounds end with the longest repeat."""
    few = base_reads(spark, sf).select("rid", F.expr(f"substring(s, 1, {_SHORT})").alias("s"))
    halves = [materialize(bwt.build(few.where(F.col("rid") % 2 == k)), "bwt") for k in (0, 1)]
    return merge.merge(*halves, most_in_one_task=0)


@query(f"{_ALL} SELECT pos, CAST({_CODE} AS INTEGER) AS sym FROM bwt")
def merge_any_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """A merge of tables whose symbols are numbers."""
    return merge.merge(*[_part(spark, sf, k, 2).select("pos", alphabet.code("sym").alias("sym")) for k in (0, 1)])


@query(f"{_ALL}, {_RUNS} SELECT run_id, sym, start_pos, len FROM runs")
def runs_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal runs from ordered pieces of at most two symbols, some of them empty."""
    runs_ = rle.runs(stored_bwt(spark, sf))
    pieces = runs_.select("run_id", "sym", F.explode(F.expr("transform(sequence(0L, len DIV 2), i -> named_struct('k', i, 'n', if(i < len DIV 2, 2L, len % 2)))")).alias("p"))
    return rle.merge_runs(pieces.select((F.col("run_id") * (1 << 20) + F.col("p.k")).alias("run_id"), "sym", F.col("p.n").alias("len")))


def _collection(spark: SparkSession, sf: str):
    from lociframe.operators.collection import Collection

    return Collection(spark).load_vector(materialize(rle.to_bytes(rle.runs(stored_bwt(spark, sf))), "rle"))


@query(_SORTED)
def load_vector(spark: SparkSession, sf: str) -> DataFrame:
    """A collection of run-length bytes."""
    return _collection(spark, sf).bwt()


_TEXT_DIGEST = "count(*) AS symbols, md5(string_agg(sym, '' ORDER BY pos)) AS digest"


@query(f"{_ALL} SELECT {_TEXT_DIGEST} FROM bwt")
def collection_iter(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols in order, as a caller gets them one by one."""
    import hashlib

    digest, n = hashlib.md5(), 0
    for c in _collection(spark, sf).iter():
        digest.update(c.encode())
        n += 1
    return spark.createDataFrame([(n, digest.hexdigest())], "symbols bigint, digest string")


@query(f"{_ALL}, {_RUNS} SELECT count(*) AS runs, md5(string_agg(sym || len, ',' ORDER BY run_id)) AS digest FROM runs")
def collection_run_iter(spark: SparkSession, sf: str) -> DataFrame:
    """All runs in order, as a caller gets them one by one."""
    import hashlib

    parts = [f"{c}{n}" for c, n in _collection(spark, sf).run_iter()]
    return spark.createDataFrame([(len(parts), hashlib.md5(",".join(parts).encode()).hexdigest())], "runs bigint, digest string")


@query("SELECT * FROM (VALUES (0, CAST(0 AS BIGINT), '')) t(reads, total, content)")
def empty_collection(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators.collection import Collection

    c = Collection(spark)
    return spark.createDataFrame([(c.count, c.total_size(), c.to_string())], "reads int, total bigint, content string")


@query(f"{_ALL}, {_RUNS} SELECT run_id, CAST({_CODE} + 8 * len AS INTEGER) AS packed, sym, len FROM runs WHERE len < 8192")
def packed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as 16 bits and back."""
    runs_ = rle.runs(stored_bwt(spark, sf)).where("len < 8192")
    packed = runs_.select("run_id", alphabet.pack_run("sym", "len").alias("packed"))
    return packed.select("run_id", "packed", alphabet.unpack_run("packed").alias("r")).select("run_id", "packed", "r.sym", "r.len")


@query(ORACLE_SQL["fm_sampled"].replace("// 256", "// 64").replace("* 256", "* 64").replace("/ 256.0", "/ 64.0"))
def fm_sampled_64(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled index with another distance of its samples."""
    return fm.sampled(rle.runs(stored_bwt(spark, sf)), bin_power=6)


_STEP = ORACLE_SQL["constrain_range_step"]


def _step(spark: SparkSession, sf: str, kind: type, power: int) -> DataFrame:
    key = F.col("c_custkey")
    ranges = table(spark, sf, "customer").select(key.alias("qid"), F.substring(F.lit("ACGNT"), (key % 5).cast("int") + 1, F.lit(1)).alias("sym"), key.alias("l"), (key + key % 97).alias("h"))
    return kind.load_vector(materialize(rle.to_bytes(rle.runs(stored_bwt(spark, sf))), "rle"), power).constrain_range(ranges)


@query(_STEP)
def constrain_range_relational(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, fm.RelationalIndex, 8)


@query(_STEP)
def constrain_range_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    return _step(spark, sf, fm.BroadcastIndex, 5)


@query(f"{_ALL}, placed AS (SELECT row_number() OVER (ORDER BY suf, s, rid) - 1 AS pos, suf FROM suffixes) SELECT substr(suf, 1, 3) AS kmer, min(pos) AS l, max(pos) + 1 AS h FROM placed WHERE length(suf) >= 3 GROUP BY 1")
def kmer_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of all 3-mers that occur, which a search keeps for all its queries."""
    index = fm.RelationalIndex(stored_bwt(spark, sf))
    letters = spark.createDataFrame([(c,) for c in "ACGNT"], "c string")
    kmers = letters.select("c").crossJoin(letters.toDF("d")).crossJoin(letters.toDF("e")).select(F.concat("c", "d", "e").alias("kmer"))  # 125 rows
    return index.suffix_ranges(kmers).where("length(kmer) = 3")


def _fasta(spark: SparkSession, sf: str, odd: bool = False) -> str:
    """All reads as one plain FASTA file, in order; odd: with lower case, U for T, and bytes that are no base."""
    path = f"{_folder(spark)}/reads.fa"
    with open(path, "wb") as f:
        for r in base_reads(spark, sf).orderBy("rid").toLocalIterator():
            s = r.s.encode()
            if odd:
                s = (s.lower().replace(b"t", b"u") if r.rid % 3 == 0 else s).replace(b"N", (b"-", b"\xff", b"x")[r.rid % 3])
            f.write(b">%d\n%s\n%s\n" % (r.rid, s[:20], s[20:]))
    return path


@query(_SORTED)
def fastx_odd_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence bytes of any value, each one symbol, read by small ranges of bytes."""
    from lociframe.sources import fastx

    return bwt.build(fastx.read_fastx(spark, [_fasta(spark, sf, odd=True)], chunk=4096))


@query(_SORTED)
def cli_build(spark: SparkSession, sf: str) -> DataFrame:
    """The command that makes a file of a FASTA file, and that file read back."""
    from lociframe import cli
    from lociframe.sources import npy

    source = _fasta(spark, sf)
    if cli.build([source], f"{source}.npy", spark):
        raise RuntimeError("the command failed")
    return rle.expand(rle.from_bytes(materialize(npy.read_npy(spark, f"{source}.npy"), "rle")))


@query(f"{_ALL} SELECT {_TEXT_DIGEST} FROM bwt")
def cli_build_text(spark: SparkSession, sf: str) -> DataFrame:
    """What the command prints where no file is named."""
    import contextlib
    import hashlib
    import io

    from lociframe import cli

    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        if cli.build([_fasta(spark, sf)], None, spark):
            raise RuntimeError("the command failed")
    text = printed.getvalue().removesuffix("\n")
    return spark.createDataFrame([(len(text), hashlib.md5(text.encode()).hexdigest())], "symbols bigint, digest string")


@query(_SORTED)
def cli_convert(spark: SparkSession, sf: str) -> DataFrame:
    """The command that turns text, here one endless line from standard input, into a file, and that file read back."""
    import io

    from lociframe import cli
    from lociframe.sources import npy

    out = f"{_folder(spark)}/bwt.npy"
    if cli.convert(None, out, spark, io.BytesIO(bwt.as_string(base_bwt(spark, sf)).encode())):
        raise RuntimeError("the command failed")
    return rle.expand(rle.from_bytes(materialize(npy.read_npy(spark, out), "rle")))


@query("SELECT * FROM (VALUES ('build without input', 66), ('build without output', 73), ('convert without input', 66), ('convert without output', 66), ('convert another symbol', 74), ('build another file', 74)) t(command, status)")
def cli_status(spark: SparkSession, sf: str) -> DataFrame:
    """Exit codes of commands that can't do what they are asked."""
    import contextlib
    import io

    from lociframe import cli

    folder = _folder(spark)
    good, bad = f"{folder}/good.txt", f"{folder}/bad.txt"
    with open(good, "w") as f:
        f.write("A$\nC$\n")
    with open(bad, "w") as f:
        f.write("A$X\n")
    with contextlib.redirect_stderr(io.StringIO()):
        rows = [
            ("build without input", cli.build([f"{folder}/none"], f"{folder}/out.npy", spark)),
            ("build without output", cli.build([good], f"{folder}/none/out.npy", spark)),
            ("convert without input", cli.convert(f"{folder}/none", f"{folder}/out.npy", spark)),
            ("convert without output", cli.convert(good, f"{folder}/none/out.npy", spark)),
            ("convert another symbol", cli.convert(bad, f"{folder}/out.npy", spark)),
            ("build another file", cli.build([bad], f"{folder}/out.npy", spark)),
        ]
    return spark.createDataFrame(rows, "command string, status int")


@query("SELECT * FROM (VALUES ('as written', ''), ('cut off', 'EOFError'), ('longer', 'EOFError'), ('no file', 'ValueError')) t(content, error)")
def npy_size_check(spark: SparkSession, sf: str) -> DataFrame:
    """A vector's length and its file's size must agree."""
    from lociframe.sources import npy

    whole = npy.header(4) + bytes([1, 9, 25, 8])
    rows = []
    for name, content in (("as written", whole), ("cut off", whole[:-1]), ("longer", whole + b"x"), ("no file", whole[:5])):
        try:
            npy.parse_header(content[: npy.HEADER], len(content))
            rows.append((name, ""))
        except (EOFError, ValueError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "content string, error string")


@query(f"{_ALL}, {_COUNTS} SELECT sym, cnt FROM counts")
def conversion_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols counted while a BWT is turned into run-length bytes."""
    from pyspark.sql import Observation

    met = Observation("symbols")
    materialize(rle.to_bytes(rle.runs(materialize(stats.observed(base_bwt(spark, sf), met), "bwt"))), "rle")
    return spark.createDataFrame(list(met.get.items()), "sym string, cnt bigint")


@query(f"WITH {_READS} SELECT CAST(count(*) AS BIGINT) AS reads, CAST(sum(length(s) + 1) AS BIGINT) AS symbols FROM reads")
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics that a stream reports of its micro-batches, added up."""
    from lociframe.streaming.inserts import observe_counts

    folder = _folder(spark)
    rows = base_reads(spark, sf)
    for k in range(3):
        rows.where(F.col("rid") % 3 == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema("rid bigint, s string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    running = observe_counts(stream).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    met = [p.observedMetrics["reads"] for p in running.recentProgress if p.numInputRows]
    return spark.createDataFrame([(sum(m["reads"] for m in met), sum(m["symbols"] for m in met))], "reads bigint, symbols bigint")


def long_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as reads."""
    return reads.from_texts(table(spark, sf, "documents"), "doc_id", "text")


@query(
    ORACLE_SQL["text_windows"].split(", parts AS")[0].split("FROM documents)")[0]
    + "FROM documents) SELECT substr('$ACGNT', c, 1) AS sym, sum(CASE WHEN c = 1 THEN 1 ELSE length(whole) - length(replace(whole, substr('$ACGNT', c, 1), '')) END)::BIGINT AS cnt FROM reads, range(1, 7) r(c) GROUP BY c"
)
def long_read_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of the BWT of whole texts, without building it."""
    counts = long_reads(spark, sf).agg(F.count("*").alias("c0"), *[F.sum(F.length("s") - F.length(F.translate("s", c, ""))).alias(f"c{i}") for i, c in enumerate(_SYMBOLS) if i])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("sym"), F.col(f"c{i}").cast("long").alias("cnt")) for i, c in enumerate(_SYMBOLS)])))
