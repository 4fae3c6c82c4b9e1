"""Empty tables, repeated rows, null values and clashing columns, for the functions that stages and queries share."""

from pyspark.sql import functions as F

from lociframe.llm.pieces import decode_texts, encode_texts
from lociframe.llm.pii import redact_documents
from lociframe.llm.quality import COUNTS, count_texts, keep_good, learn_rules
from lociframe.llm.toxicity import drop_toxic, train

GOOD = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, GOOD), (1, GOOD), (None, GOOD), (2, None), (3, ""), (4, "write to a.b@c.org " + GOOD)]


def table(spark):
    """Columns that clash with what the functions add."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("_text", F.lit(7))
    for name in (*COUNTS, "spans", "ids", "decoded", "_id", "_clean", "_label"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.withColumn("n_chars", F.lit(5))


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_stage_functions(spark):
    docs = table(spark)
    model = train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int").limit(0))
    for result in (keep_good(docs, []), drop_toxic(docs, model), redact_documents(docs)):
        assert result.columns == docs.columns and all(r.score == "own" and r._text == 7 and r.ids == "x" for r in result.collect())
    assert ids(keep_good(docs, [])) == [(False, 1), (False, 1), (False, 4), (True, 0)]
    assert ids(drop_toxic(docs, model)) == ids(docs)
    clean = redact_documents(docs).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(k) for k, _ in ROWS)
    assert all(r.n_chars == len(r.text or "") and "a.b@c.org" not in (r.text or "") for r in clean)
    assert {r.text for r in clean if r.doc_id in (2, 3)} == {None, ""}
    for function in (lambda d: keep_good(d, []), lambda d: drop_toxic(d, model), redact_documents):
        assert function(docs.limit(0)).count() == 0


def test_counts_and_pieces(spark):
    docs = table(spark)
    counted = count_texts(docs)
    assert counted.columns == ["doc_id", *COUNTS] and ids(counted) == ids(docs)
    assert all(r.n_words == 0 for r in counted.collect() if r.doc_id in (2, 3))
    encoded = encode_texts(docs)
    assert encoded.columns == ["doc_id", "text", "ids"] and ids(encoded) == ids(docs)
    back = decode_texts(encoded.withColumn("decoded", F.lit(1)))
    assert back.columns == ["doc_id", "decoded"] and ids(back) == ids(docs)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_texts(none).collect()} == {1: None, 2: ""}
    assert count_texts(docs.limit(0)).count() == encode_texts(docs.limit(0)).count() == decode_texts(none.limit(0)).count() == 0


def test_a_key_that_repeats_teaches_once(spark):
    rows = [(i, f"{GOOD} {'vileword ' * 5 if i % 3 == 0 else ''}{'x x x x ' * 40 if i % 4 == 0 else ''}tail{i}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + [rows[7]] * 500 + [rows[8]] * 500, "doc_id long, text string").repartition(5)
    a, b = train(once, labels), train(many, labels)
    assert (a.keys == b.keys).all() and (a.weights == b.weights).all() and (a.logistic == b.logistic).all()
    assert str(learn_rules(once, labels)) == str(learn_rules(many, labels))
