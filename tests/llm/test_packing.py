import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lociframe.llm.packing import SumOfSquares, WordTokenizer, op4_sum_of_squares_packing, pack_documents, padding


def test_places_where_the_sum_of_squares_is_least():
    rng = random.Random(3)
    size = 12
    done = []
    packing = SumOfSquares(lambda w, n: done.append((w, n)), size)
    for i in range(500):
        n = rng.randrange(1, size)
        before = packing.count.copy()
        packing.place(i, n)
        got = int((packing.count[1:size] ** 2).sum())
        costs = []
        for h in [0, *[h for h in range(1, size) if before[h]]]:
            if h + n <= size:
                c = before.copy()
                c[h] -= h > 0
                c[h + n] += h + n < size
                costs.append(int((c[1:size] ** 2).sum()))
        assert got == min(costs)
    packing.finish()
    assert all(sum(b - a for _, a, b in w) == n and (n == size or n & (n - 1) == 0) for w, n in done)


def check(rows, texts, window):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: "é " * 3000, 4: "naïve  A'LL don't\x85x y \x1cq", 5: "w" * 20000, 6: "a", 7: "<|endoftext|> x", 8: "á ́b", None: "null key"}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, start int")
    check(pack_documents(docs.coalesce(1), window=64).collect(), texts, 64)
    assert pack_documents(docs.limit(0)).count() == 0
    twice = pack_documents(docs.where("doc_id = 6").union(docs.where("doc_id = 6"))).collect()
    assert len(twice) == 2
    assert [len(r.ids) for r in pack_documents(docs.where("doc_id = 2"), with_ids=True).collect()] == [1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_sum_of_squares_packing(spark, sf)
    check(got.collect(), texts, 2048)
    assert padding(got.toArrow()) == 0


def test_little_is_cut_again():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = WordTokenizer(f.read())
    lengths = tokenizer.encode(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks())[1] + 1
    for tasks in (1, 4):
        moved = 0
        for k in range(tasks):
            packing = SumOfSquares(lambda w, n: None)
            for i, n in enumerate(lengths[k::tasks].tolist()):
                if n % 2048:
                    packing.place(i, n % 2048)
            packing.finish()
            assert not packing.standing and not packing.count.any()
            moved += packing.moved
        assert moved < 0.02 * lengths.sum()


def test_open_windows_are_bounded():
    done = []
    packing = SumOfSquares(lambda w, n: done.append((w, n)), 64, most_open=10)
    for i in range(500):  # no two of them fit a window
        packing.place(i, 33 + i % 7)
        assert packing.standing <= 10
    packing.finish()
    assert all(sum(b - a for _, a, b in w) == n and (n == 64 or n & (n - 1) == 0) for w, n in done)
    pieces = defaultdict(list)
    for w, _ in done:
        for i, a, b in w:
            pieces[i].append((a, b))
    for i in range(500):
        ends = sorted(pieces[i])
        assert ends[0][0] == 0 and ends[-1][1] == 33 + i % 7 and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
