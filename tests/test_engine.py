import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import alphabet
from lociframe.operators import bwt, fm, kmer, merge, ordered, reads, rle, stats
from lociframe.operators.collection import Collection
from lociframe.sources import ascii_bwt, fastx, npy
from tests import oracle

SETS = {
    "F1": ["CCGT", "N", "ACG"],
    "F2": ["A", "AA", "AAA"],
    "F3": ["ACA", "CA"],
    "F4": ["ACGT", "TGCA"],
    "F5": ["ACGT", "CCGG"],
    "F6": ["CCGTACGTA", "GGTACAGTA", "ACGACGACG"],
    "F8": ["ACG", "N", "CCGT", "N", "ACG", "ACG", "CCGT", "N"],
    "empty read": ["", "A", ""],
    "none": [],
}
GOLDEN = {"F1": "GTN$$ACCC$G", "F2": "AAA$AA$A$", "F3": "AACC$A$", "F4": "TAC$GATCG$", "F5": "TG$$CAGCCG"}


def of(spark, name):
    return reads.from_strings(spark, SETS[name] if isinstance(name, str) else name)


def table(spark, text):
    return spark.createDataFrame(list(enumerate(text)), "pos long, sym string")


@pytest.mark.parametrize("name", SETS)
def test_builders_agree(spark, name):
    want = oracle.bwt(SETS[name])
    assert GOLDEN.get(name, want) == want
    r = of(spark, name)
    assert bwt.as_string(bwt.build(r)) == want
    assert bwt.as_string(bwt.build_bucketed(r, width=2)) == want
    assert bwt.as_string(bwt.build_long(r)) == want
    assert bwt.as_string(bwt.build(r, sorted_order=False)) == oracle.bwt(SETS[name], chronological=True)


def test_ranges_number_like_one_task(spark, monkeypatch):
    rng = random.Random(4)
    rs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(12))) for _ in range(120)] + ["AAAAAAAA"] * 40
    want = oracle.bwt(rs)
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(ordered, "BLOCK_BITS", 3)
    r = of(spark, rs)
    built = ordered.materialize(bwt.build(r))
    assert bwt.as_string(built) == want
    assert [(x.sym, x.len) for x in rle.runs(built).orderBy("run_id").collect()] == oracle.runs(want)
    got = rle.from_bytes(rle.to_bytes(rle.runs(built)))
    assert [(x.sym, x.len) for x in got.orderBy("run_id").collect()] == oracle.runs(want)
    assert "".join(x.sym for x in rle.expand(got).orderBy("pos").collect()) == want
    rows = fm.occ(built).orderBy("pos").collect()
    assert [[x[f"o{i}"] for i in range(6)] for x in rows] == [[want[:p].count(c) for c in "$ACGNT"] for p in range(len(want) + 1)]


def test_encoding(spark):
    row = spark.createDataFrame([("$acgntXé\n U", "$ACGNT")], "t string, s string").select(
        alphabet.normalize("t").alias("n"), alphabet.to_codes("s").alias("c"), alphabet.from_codes(alphabet.to_codes("s")).alias("b"), alphabet.reverse_complement("s").alias("r"), alphabet.normalize_fastx("t").alias("f")
    ).first()
    assert row.n == "$ACGNTNNNNNN" and row.c == [0, 1, 2, 3, 4, 5] and row.b == "$ACGNT" and row.r == "ANCGT$" and row.f == "NACGNTNNNT"
    assert spark.createDataFrame([("ACGTN$",)], "s string").select(alphabet.to_codes("s")).first()[0] == [1, 2, 3, 5, 4, 0]
    assert spark.createDataFrame([("",)], "s string").select(alphabet.to_codes("s")).first()[0] == []
    packed = spark.createDataFrame([("T", 8191), ("$", 0)], "sym string, len long").select(alphabet.unpack_run(alphabet.pack_run("sym", "len")).alias("r")).collect()
    assert [tuple(x.r) for x in packed] == [("T", 8191), ("$", 0)]
    for bad in (alphabet.from_codes(F.array(F.lit(6))), alphabet.checked_kmer(F.lit("AX")), alphabet.checked_read(F.lit("A$")), alphabet.pack_run(F.lit("A"), F.lit(8192))):
        with pytest.raises(Exception, match="symbol|over|long"):
            spark.range(1).select(bad).collect()


@pytest.mark.parametrize(("text", "want"), [("ACGNT$", [9, 10, 11, 12, 13, 8]), ("\n$$\n$$\nAAA\n", [32, 25]), ("A" * 3104, [1, 9, 25]), ("A" * 31 + "C" * 31, [249, 250]), ("N" * 32767, [252, 252, 252]), ("", []), ("A" * 32, [1, 9])])
def test_run_length_bytes(spark, text, want):
    built = ascii_bwt.from_strings(spark, text)
    assert [r.byte for r in rle.to_bytes(rle.runs(built)).orderBy("off").collect()] == want == oracle.encode(text.replace("\n", ""))


def test_pieces_are_merged_before_writing(spark):
    pieces = spark.createDataFrame([(0, "A", 3), (1, "A", 2), (2, "C", 0), (3, "A", 1), (4, "C", 4)], "run_id long, sym string, len long")
    got = rle.merge_runs(pieces)
    assert [(r.sym, r.start_pos, r.len) for r in got.orderBy("run_id").collect()] == [("A", 0, 6), ("C", 6, 4)]


def test_text_is_strict(spark):
    for bad in ("ACx", "ac", "AC\r\n"):
        with pytest.raises(Exception, match="not a BWT symbol"):
            ascii_bwt.from_strings(spark, bad).collect()


@pytest.mark.parametrize(("power", "ref", "counts"), [(1, [0, 2, 3, 5, 5, 7, 8], "0002233 0001111 0000033 0111112 0011111 0111111"), (2, [0, 3, 5, 8], "0023 0011 0003 0112 0111 0111"), (3, [0, 5, 8], "023 011 003 012 011 011"), (4, [0, 8], "03 01 03 02 01 01")])
def test_sampled_index(spark, power, ref, counts):
    got = fm.sampled(rle.runs(table(spark, GOLDEN["F1"])), power).orderBy("bin").collect()
    assert [r.bin for r in got] == list(range(len(ref))) and [r.ref for r in got] == ref
    assert ["".join(str(r[f"c{i}"]) for r in got) for i in range(6)] == counts.split()


def test_counts_and_offsets(spark):
    built = table(spark, GOLDEN["F1"])
    assert [r.cnt for r in stats.symbol_counts(built).orderBy("sym").collect()] == [3, 1, 3, 2, 1, 1]
    assert [(r.start_idx, r.end_idx) for r in stats.f_offsets(stats.symbol_counts(built)).orderBy("sym").collect()] == [(0, 3), (3, 4), (4, 7), (7, 9), (9, 10), (10, 11)]
    got = stats.offset_map(table(spark, "CCGT"), table(spark, "ACG"))
    assert {r.sym: r.offset for r in got.collect()} == {"A": 0, "C": 1, "G": 4, "T": 6}
    numbers = stats.offset_map(spark.createDataFrame([(7,), (3,), (7,)], "sym int"))
    assert {r.sym: r.offset for r in numbers.collect()} == {3: 0, 7: 1}
    assert [r.cnt for r in stats.symbol_counts(table(spark, "")).collect()] == [0] * 6


def test_every_range_and_symbol(spark):
    text = oracle.bwt(SETS["F6"])
    built = table(spark, text)
    n = len(text)
    start = {c: sum(x < c for x in text) for c in "$ACGNT"}
    rows = [(i, c, lo, hi) for i, (c, lo, hi) in enumerate((c, lo, hi) for c in "$ACGNT" for lo in range(0, n + 1, 3) for hi in range(lo, n + 1, 4))]
    got = fm.constrain_range(spark.createDataFrame(rows, "qid long, sym string, l long, h long"), fm.occ(built), stats.f_offsets(stats.symbol_counts(built)))
    want = {q: (start[c] + text[:lo].count(c), start[c] + text[:hi].count(c)) for q, c, lo, hi in rows}
    assert {r.qid: (r.l, r.h) for r in got.collect()} == want


def all_counts(spark, rs, queries):
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, kmer string")
    r = of(spark, rs)
    built = ordered.materialize(bwt.build(r))
    return [{x.qid: x.n for x in got.collect()} for got in (kmer.count_kmers(r, asked), fm.RelationalIndex(built, 2).count_kmers(asked), fm.BroadcastIndex(built, 3).count_kmers(asked))]


def test_kmer_counts_three_ways(spark):
    rng = random.Random(8)
    rs = ["".join(rng.choice("ACGN") for _ in range(rng.randrange(6))) for _ in range(25)] + SETS["F6"]
    queries = ["", "$", "A", "ACG", "CC", "TAC", "$AC", "CG$", "A$", "A$A", "C$G", "$$", "$ACG$", "G$ACG$A", "N", "TTTTTTTTTTTTTTTTTT", *rs[:10]]
    want = {i: oracle.count(rs, q) for i, q in enumerate(queries)}
    for got in all_counts(spark, rs, [*queries, None]):
        assert got == {**want, len(queries): None}
    for got in all_counts(spark, [], ["", "A", "$"]):
        assert got == {0: 0, 1: 0, 2: 0}


def test_published_kmer_counts(spark):
    got = all_counts(spark, SETS["F6"], ["ACG", "CC", "TAC", *SETS["F6"], *"$ACGNT"])[1]
    assert list(got[i] for i in range(6)) == [4, 1, 2, 1, 1, 1]
    text = oracle.bwt(SETS["F6"])
    assert [got[6 + i] for i in range(6)] == [text.count(c) for c in "$ACGNT"]


@pytest.mark.parametrize("pair", [(["ACCA"], ["CAAA"]), (["ACCA"], ["CA"]), (["A", "AA"], ["AAA", "AAAA", ""]), ([], ["ACG"])])
def test_merges(spark, pair):
    want = oracle.bwt(pair[0] + pair[1])
    a, b = (table(spark, oracle.bwt(p)) for p in pair)
    assert bwt.as_string(merge.merge(a, b)) == want
    assert bwt.as_string(merge.merge(a, b, most_in_one_task=0)) == want


def test_merges_other_symbols(spark):
    a = spark.createDataFrame([(0, 20), (1, 10)], "pos long, sym int")
    b = spark.createDataFrame([(0, 10)], "pos long, sym int")
    for most in (0, 10):
        assert sorted(r.sym for r in merge.merge(a, b, most).collect()) == [10, 10, 20]


def test_long_copies_and_windows(spark):
    genome = "".join(random.Random(1).choice("ACGT") for _ in range(56))
    rs = [genome[i : i + 20] for i in range(37) for _ in range(8)]
    assert bwt.as_string(bwt.build(of(spark, rs))) == oracle.bwt(rs)
    docs = spark.createDataFrame([(1, "ACGT" * 5 + "é$"), (2, None), (3, "")], "doc_id long, text string")
    got = reads.from_texts(docs, "doc_id", "text", 8).orderBy("rid").collect()
    assert [r.s for r in got] == ["ACGTACGT", "ACGTACGT", "ACGTNNN", ""]


def test_npy_bytes_and_errors(spark, tmp_path):
    built = ascii_bwt.from_strings(spark, "A" * 3104 + "$")
    path = str(tmp_path / "x.npy")
    npy.write_npy(ordered.materialize(rle.to_bytes(rle.runs(built))), path)
    data = open(path, "rb").read()
    assert data == (b"\x93NUMPY\x01\x00\x56\x00{'descr': '|u1', 'fortran_order': False, 'shape': (4, ), }").ljust(95) + b"\n" + bytes([1, 9, 25, 8])
    assert np.load(path).tolist() == [1, 9, 25, 8]
    for where in (path, f"file:{path}"):
        assert [r.byte for r in npy.read_npy(spark, where).orderBy("off").collect()] == [1, 9, 25, 8]
    big = str(tmp_path / "big.npy")
    np.save(big, np.arange(200_000, dtype=np.uint8))
    assert npy.read_npy(spark, big).agg(F.sum("byte"), F.count("*")).first()[1] == 200_000
    for content, error in ((data[:-1], EOFError), (data[:5], ValueError), (data[:20], EOFError), (data[:10] + b"x" * 86, ValueError)):
        with pytest.raises(error):
            npy.parse_header(content[:96], len(content))


def test_fastx(spark, tmp_path):
    a, b, c, d = (str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "c.fq", "d.fa"))
    open(a, "w").write(">1\nACGT\n>2\nTGCA")
    gzip.open(b, "wt").write(">x y\nac gt\nuu\n\n>empty\n>n\nR-$\n")
    open(c, "w").write("@r\nACGT\n+\n@@@@\n\n")
    open(d, "w").close()
    got = fastx.read_fastx(spark, [a, b, c, d]).orderBy("rid").collect()
    assert [r.s for r in got] == ["ACGT", "TGCA", "ACGTTT", "", "NNN", "ACGT"]
    assert [r.rid >> 40 for r in got] == [0, 0, 1, 1, 1, 2]
    assert Collection.from_fastx(spark, [a]).to_string() == GOLDEN["F4"]
    assert fastx.read_fastx(spark, []).count() == 0
    open(d, "w").write("@r\nACGT\n+\n@@\n")
    with pytest.raises(Exception, match="malformed"):
        fastx.read_fastx(spark, [d]).collect()
    with pytest.raises(Exception, match="No such file"):
        fastx.read_fastx(spark, [str(tmp_path / "none")]).collect()


def test_collection_grows(spark, tmp_path):
    c = Collection(spark)
    assert c.to_string() == "" and c.count_kmer("A") == 0 and c.count_kmer("") == 0
    c.insert_string("AAAA").insert_string("ACCC")
    assert list(c.run_iter()) == [("A", 1), ("C", 1), ("A", 3), ("$", 2), ("C", 2), ("A", 1)]
    with pytest.raises(Exception, match="over ACGNT"):
        c.insert_string("A$")
    other = Collection(spark).load_vector(bytes(oracle.encode(oracle.bwt(SETS["F6"]))))
    other.insert_string("AAGTCATAT")
    assert [other.count_kmer(k) for k in ("AA", "GT", "ACG", "CC", "TAC", "$")] == [1, 5, 4, 1, 2, 4]
    path = str(tmp_path / "c.npy")
    other.save_npy(path)
    again = Collection(spark).load_npy(path)
    assert again.to_string() == oracle.bwt([*SETS["F6"], "AAGTCATAT"]) and again.symbol_count("$") == 4
    ordered_ = Collection(spark)
    for s in ("ACG", "CCGT", "N"):
        ordered_.insert_string(s)
    assert bwt.as_string(ordered_.bwt(sorted_order=False)) == GOLDEN["F1"]


def test_commands(spark, tmp_path, capsys):
    from lociframe import cli

    fa, out, txt = str(tmp_path / "a.fa"), str(tmp_path / "a.npy"), str(tmp_path / "a.txt")
    open(fa, "w").write(">1\nACGT\n>2\nTGCA")
    assert cli.build([fa], out, spark) == 0
    assert np.load(out).tolist() == [13, 9, 10, 8, 11, 9, 13, 10, 11, 8]
    assert cli.build([fa], None, spark) == 0 and capsys.readouterr().out == GOLDEN["F4"] + "\n"
    open(txt, "w").write("TAC$GA\nTCG$\n")
    assert cli.convert(txt, out + "2", spark) == 0 and open(out, "rb").read() == open(out + "2", "rb").read()
    assert cli.build([fa + "x"], out, spark) == 66 and cli.build([fa], "/none/x", spark) == 73
    assert cli.convert(fa + "x", out, spark) == 66 and cli.convert(txt, "/none/x", spark) == 66
    open(txt, "w").write("TAX")
    assert cli.convert(txt, out, spark) == 74


def test_streams(spark, tmp_path):
    from lociframe.streaming.inserts import GrowingBwt, kmer_counts, run_to_memory

    rng = random.Random(2)
    rs = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(60)]
    r = of(spark, rs)
    for k in range(3):
        r.where(F.col("rid") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("rid bigint, s string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    growing = GrowingBwt(spark, str(tmp_path / "index"))
    growing.start(stream, str(tmp_path / "s1")).awaitTermination()
    assert bwt.as_string(growing.bwt()) == oracle.bwt(rs) and growing.reads().count() == 60
    growing.add_batch(r.where(F.col("rid") % 3 == 2), 2)  # the last batch again
    assert growing.bwt().count() == 600
    run_to_memory(kmer_counts(stream, 4), "counts_", str(tmp_path / "s2"))
    assert {tuple(x) for x in spark.table("counts_").collect()} == {tuple(x) for x in kmer.spectrum(r, 4).collect()}
    assert kmer.canonical_spectrum(r, 4).agg(F.sum("n")).first()[0] == 360
    assert kmer.top_kmers(r, 2, 3).count() == 3


def test_growing_bwt_keeps_few_pieces(spark, tmp_path):
    from lociframe.streaming.inserts import GrowingBwt

    rng = random.Random(4)
    rs = ["".join(rng.choice("ACGT") for _ in range(5)) for _ in range(22)]
    r, growing = of(spark, rs), GrowingBwt(spark, str(tmp_path / "index"))
    for k in range(7):
        growing.add_batch(r.where(F.col("rid").between(3 * k, 3 * k + 2)), k)
    assert growing._live() == [(6, 6), (4, 5), (0, 3)] and len(growing._pieces()) <= 5
    assert bwt.as_string(growing.bwt()) == oracle.bwt(rs[:21])
    assert bwt.as_string(growing.bwt(6)) == oracle.bwt(rs[:18])
    growing.add_batch(r.where("rid >= 18"), 6)  # again, with a read more
    growing.add_batch(r.limit(0), 7)
    assert bwt.as_string(growing.bwt()) == oracle.bwt(rs) and growing.reads().count() == 22
    assert GrowingBwt(spark, str(tmp_path / "none")).bwt().count() == 0


def test_fastx_ranges_and_bytes(spark, tmp_path):
    rng = random.Random(5)
    fa, fq, odd = (str(tmp_path / n) for n in ("a.fa", "b.fq", "odd.fa"))
    rs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    with open(fa, "w") as f:
        f.write("".join(f">{i}\n{s[:15]}\n{s[15:]}\n" for i, s in enumerate(rs)))
    with open(fq, "w") as f:  # qualities that look like headers and plus lines
        f.write("".join(f"@{i}\n{s}\n+\n{''.join(rng.choice('@+>I') for _ in s)}\n" for i, s in enumerate(rs)))
    for chunk in (64, 333, 1 << 20):
        got = fastx.read_fastx(spark, [fa, fq], chunk).orderBy("rid").collect()
        assert [r.s for r in got] == rs + rs and len({r.rid for r in got}) == 400
    with open(odd, "wb") as f:
        f.write(b">1\nA\xc3\xa9C\n>2\nA\xffc-\n>3\nuU\x80.\n")
    assert [r.s for r in fastx.read_fastx(spark, [odd, f"file:{odd}"]).orderBy("rid").collect()] == ["ANNC", "ANCN", "TTNN"] * 2


def test_text_bwt_of_one_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ascii_bwt, "PIECE", 7)
    monkeypatch.setattr(ascii_bwt, "CHUNK", 21)
    rng = random.Random(6)
    text = "".join(rng.choice("$ACGNT") for _ in range(200))
    path = str(tmp_path / "one.txt")
    for written in (text, "\n".join([text[:50], "", text[50:51], text[51:]]) + "\n"):
        open(path, "w").write(written)
        assert bwt.as_string(ascii_bwt.read_ascii(spark, path)) == text
    open(path, "w").close()
    assert ascii_bwt.read_ascii(spark, path).count() == 0


def test_indexes_agree(spark, tmp_path):
    built = ordered.materialize(bwt.build(of(spark, "F6")))
    text = bwt.as_string(built)
    kmers = ["", "A", "$", "GTA", "$A", "A$", "ACGACGACG", "NN", "G$G", "TTTT", None, "ACG", "ACG"]
    queries = spark.createDataFrame(list(enumerate(kmers)), "qid long, kmer string")
    want = [None if k is None else oracle.count(SETS["F6"], k) if hasattr(oracle, "count") else None for k in kmers]
    rows = ordered.materialize(rle.to_bytes(rle.runs(built)))
    answers = []
    for kind in (fm.RelationalIndex, fm.BroadcastIndex):
        for power in (2, 8):
            index = kind.load_vector(rows, power)
            got = [r.n for r in index.count_kmers(queries).orderBy("qid").collect()]
            assert index.total_size() == len(text) and got[10] is None and got[0] == len(text)
            answers.append(got)
            ranges = spark.createDataFrame([(i, c, i, len(text)) for i in range(len(text)) for c in "ACGT$N"], "qid long, sym string, l long, h long")
            first = {c: sum(x < c for x in text) for c in "$ACGNT"}
            assert sorted(map(tuple, index.constrain_range(ranges).collect())) == sorted((i, c, first[c] + text[:i].count(c), first[c] + text.count(c)) for i in range(len(text)) for c in "ACGT$N")
    assert all(a == answers[0] for a in answers)
    assert want[1] is None or answers[0] == want


def test_long_reads_are_built_by_doubling(spark):
    rng = random.Random(7)
    rs = ["".join(rng.choice("ACG") for _ in range(1500)), "ACG" * 300]
    assert bwt.as_string(bwt.build_any(of(spark, rs))) == oracle.bwt(rs)
