import zlib
from collections import Counter, defaultdict

from lociframe.llm.sharding import op3_rendezvous_sharding, rendezvous, shard_documents


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    keys = spark.range(30000).toDF("k")
    got = Counter(r[0] for r in keys.select(rendezvous(keys.k, [1.0, 2.0, 0.0, 1.0])).collect())
    assert set(got) == {0, 1, 3} and abs(got[1] - 15000) < 500 and abs(got[0] - 7500) < 400
    both = keys.select(rendezvous(keys.k, [1.0] * 9).alias("a"), rendezvous(keys.k, [1.0] * 10).alias("b")).collect()
    moved = [r for r in both if r.a != r.b]
    assert all(r.b == 9 for r in moved) and abs(len(moved) - 3000) < 300
    fewer = keys.select(rendezvous(keys.k, [1.0] * 9).alias("a"), rendezvous(keys.k, [1.0] * 4 + [0.0] + [1.0] * 4).alias("b")).collect()
    assert all(r.a == r.b or r.a == 4 for r in fewer)


def test_edge_rows(spark):
    rows = [(1, "é"), (1, "é"), (None, None), (None, ""), (2, "x" * 100000)] + [(7, "same")] * 300
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, shard int")
    got = shard_documents(docs, [1.0] * 5).collect()
    assert len(got) == len(rows)
    check_slots(got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(8, 0)}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(10, zlib.crc32("é".encode()))}
    assert shard_documents(docs.limit(0), [1.0]).count() == 0
    assert {r.grown_shard for r in shard_documents(docs, [1.0], grown_weight=None).collect()} == {None}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_rendezvous_sharding(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    check_slots(got)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    again = {r.doc_id: r.shard for r in op3_rendezvous_sharding(spark, "/root/testdata/sf0.001").collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id in again)
