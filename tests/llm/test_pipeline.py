import random

import pyarrow as pa
import pytest

import corpus_pipeline
from lociframe.llm.packing import padding
from lociframe.llm.pii import PiiFinder, redact
from lociframe.llm.quality import COUNTS, base_failed, learn_rules, text_counts, verdict
from lociframe.llm.toxicity import sums, train
from lociframe.llm.words import split_words
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "toxicity", "near_dedup", "pii", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_quality_and_toxicity_decide_row_by_row(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, before, after = stages[0]
    rows = before.collect()
    counts = text_counts(pa.array([r.text for r in rows]))
    rules = learn_rules(before, labels)
    table = spark.createDataFrame([(rows[i].doc_id, *(int(counts[c][i]) for c in COUNTS)) for i in range(len(rows))], "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    want = {r.doc_id for r in table.where(~base_failed() & (verdict(rules) == 0)).collect()}
    assert {r.doc_id for r in after.collect()} == want
    _, before, after = stages[1]
    model, rows = train(before, labels), before.collect()
    words = split_words(pa.array([r.text for r in rows]))
    score = model.score(*sums(model.tag(words), words), words.count)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, score) if s < 0.5}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    kept = {r.doc_id for r in after.collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    texts = texts_of(before)
    assert set(texts_of(after)) == {k for k, (_, c) in brute(texts, 80).items() if k == c}


def test_redaction_and_packing(stages):
    _, before, after = stages[3]
    finder, texts = PiiFinder(), texts_of(before)
    clean = {k: redact(t, finder(t)) for k, t in texts.items()}
    assert texts_of(after) == clean and any(clean[k] != texts[k] for k in texts)
    assert all(r.n_chars == len(r.text) for r in after.collect() if texts[r.doc_id] != r.text)
    _, before, after = stages[4]
    check(after.collect(), texts_of(before), 2048)
    assert padding(after.toArrow()) == 0


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages[-1][2]
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, want.groupBy("doc_id").sum("length").collect()))


def test_odd_rows(spark):
    from lociframe.llm.minhash import keep_one_of_each

    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text + " x"), (2, None), (3, ""), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 5) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in got.collect()) == [(0, "alone"), (1, text[:5]), (2, ""), (3, "")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).drop("_row"), SF).count() == 0
        assert stage(spark, docs.drop("_row"), SF).count() >= 0


def test_no_labels(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).count() > 0
