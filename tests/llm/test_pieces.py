import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from lociframe.llm.pieces import Lattice, ManyPaths, Vocabulary, choose_states, decode_ids, decode_texts, encode_batch, encode_texts, multiply, op10_max_plus_pieces, prepared

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def lattice():
    return Lattice(Vocabulary.load(PATH))


def by_chunks(lattice, text, size):
    chunks, args = [], []
    for x in range(0, len(text), size):
        skip, high = max(0, x - lattice.longest), min(x + size, len(text))
        part = text[skip : high + lattice.longest]
        fronts, backs, matrix = lattice.transfer(part, x - skip, high - skip)
        chunks.append(([(b + skip, e + skip) for b, e in fronts], [(b + skip, e + skip) for b, e in backs], matrix))
        args.append((part, x - skip, high - skip, skip))
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))
    states = [c[1][j] for c, j in zip(chunks, choose_states(chunks))]
    out = []
    for (part, low, high, skip), f, b in zip(args, [chunks[0][0][0], *states[:-1]], states):
        out += lattice.backtrace(part, low, high, (f[0] - skip, f[1] - skip), (b[0] - skip, b[1] - skip))
    return out


def test_random_texts_match_the_library(lattice, library):
    rng, many = random.Random(4), ManyPaths(lattice)
    parts = ["the", " ", "  ", "\n", "e", "é", "日", "ing", "▁", "a", "😀", "er", "on", "\t", "     ", "tion", "!!", "00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    want = [library.encode(t) for t in texts]
    for m in (None, many):
        ids, n = encode_batch(lattice, pa.array(texts), m)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    for t, w in zip(texts, want):
        if t:
            assert all(by_chunks(lattice, prepared(t), k) == w for k in (1, 2, 3, 7))
        assert decode_ids(w, lattice.v.table) == library.decode(w) == t.replace("▁", " ")


def test_one_long_word_by_chunks(lattice, library):
    word = "".join(random.Random(1).choice(["ab", "the", "er", "in", "x"]) for _ in range(3000))
    assert lattice.encode(prepared(word)) == library.encode(word) == by_chunks(lattice, prepared(word), 257)


def unigram():
    scores = {"a": -1.5, "b": -2.0, "ab": -2.2, "ba": -2.9, "aba": -3.1, "▁": -1.0, "▁a": -1.8, "bb": -3.5}
    return Lattice(Vocabulary("unigram", {p: i for i, p in enumerate(scores)}, scores, [], 99, [p.encode() for p in scores]))


def test_unigram_paths_match_enumeration():
    lat = unigram()
    for n in range(1, 8):
        for t in itertools.product("ab▁", repeat=n):
            text, best = "".join(t), -1e9
            for cuts in itertools.product((0, 1), repeat=n - 1):
                at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
                pieces = [text[a:b] for a, b in zip(at, at[1:])]
                if all(p in lat.pieces for p in pieces):
                    best = max(best, sum(lat.pieces[p] for p in pieces))
            weigh = lambda ids: sum(lat.pieces[list(lat.pieces)[i]] for i in ids)
            assert abs(weigh(lat.encode(text)) - best) < 1e-9
            for k in (1, 2, 3):
                assert abs(weigh(by_chunks(lat, text, k)) - best) < 1e-9


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.normal(size=s).tolist() for s in ((2, 3), (3, 4), (4, 2)))
    assert np.allclose(multiply(multiply(a, b), c), multiply(a, multiply(b, c)))


def test_edge_rows(spark, library):
    texts = {1: None, 2: "", 3: " ", 4: "the cat sat on the mat\n" * 40, 5: "word" * 500, 6: "é" * 300, None: "a b"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, ids int")
    got = encode_texts(docs, chunk=100).collect()
    assert {r.doc_id: r.ids for r in got} == {k: library.encode(t or "") for k, t in texts.items()}
    assert encode_texts(docs.limit(0)).count() == 0
    twice = encode_texts(docs.where("doc_id = 4").union(docs.where("doc_id = 4")), chunk=100)
    assert [r.ids for r in twice.collect()] == [library.encode(texts[4])] * 2
    back = {r.doc_id: r.decoded for r in decode_texts(encode_texts(docs, chunk=100)).collect()}
    assert back == {k: t or "" for k, t in texts.items()}


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_max_plus_pieces(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        ids = library.encode(t)
        assert got[k].n_ids == len(ids) and got[k].round_trip
        assert got[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_giant_texts_at_production_size(spark, library):
    rng = random.Random(4)
    words = ["the", "naïve", "Zürich", "https://a.b/c?d=e", "12,345.67", "日本語", "x" * 90, "e\u0301", "\n", "of", "data", "piece"]
    texts = {i: " ".join(rng.choice(words) for _ in range(n)) for i, n in ((1, 9000), (2, 40_000), (3, 7000))}
    texts[4] = "ab" * 40_000
    assert all(len(t) > 1 << 15 for t in texts.values())
    got = {r.doc_id: r.ids for r in encode_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: library.encode(t) for k, t in texts.items()}


def test_chunks_cover_a_text():
    from lociframe.llm.pieces import _cutter

    text = "a b" * 700
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([text, "é"])], names=["_row", "_text"])
    rows = [r for b in _cutter(10, 4)(iter([batch])) for r in b.to_pylist()]
    own = [r for r in rows if r["_row"] == 7]
    assert [r["k"] for r in own] == list(range(len(own))) and [r["k"] for r in rows if r["_row"] == 8] == [0]
    assert "".join(r["part"][r["low"] : r["high"]] for r in own) == prepared(text)
    assert all(prepared(text)[r["skip"] : r["skip"] + len(r["part"])] == r["part"] for r in own)
