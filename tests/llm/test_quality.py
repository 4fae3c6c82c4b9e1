import random
import re

import numpy as np
import pyarrow as pa

from lociframe.llm.quality import COUNTS, Rule, base_failed, count_texts, judge_quality, keep_good, learn_decision_list, op5_decision_list_quality, text_counts, verdict


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "a", " a\n a\na", "é\x85ü x y"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "é#"]) + rng.choice([" ", " ", "\n", "  ", "\t", "\x0b"]) for _ in range(rng.randrange(60))))
    got = text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in COUNTS[:5]) == brute(t), t


def table_of(n, seed=0):
    rng = np.random.default_rng(seed)
    t = {c: np.full(n, 100, np.int64) for c in COUNTS}
    t["n_symbols"] = rng.integers(0, 100, n)
    t["n_upper"] = rng.integers(0, 100, n)
    return t


def test_learns_conjunctions():
    t = table_of(3000)
    bad = (t["n_symbols"] > 60) & (t["n_upper"] < 30) | (t["n_symbols"] < 10)
    rules = learn_decision_list(t, bad)
    assert rules and all(r.bad / (r.bad + r.good) >= 0.9 for r in rules)
    assert sum(r.bad for r in rules) >= 0.95 * bad.sum()
    assert learn_decision_list(table_of(0), np.zeros(0, bool)) == []
    assert learn_decision_list(t, np.zeros(3000, bool)) == []


def test_expression_is_ordered(spark):
    rules = [Rule((("words", True, 30.0),)), Rule((("words", True, 60.0), ("symbols_per_word", False, 0.5)))]
    row = {c: 0 for c in COUNTS}
    rows = [{**row, "n_words": n, "n_symbols": s} for n, s in ((25, 25), (50, 50), (50, 0), (90, 90))]
    got = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in COUNTS)).select(verdict(rules).alias("v"), base_failed().alias("b"), verdict([]).alias("z")).collect()
    assert [r.v for r in got] == [1, 2, 0, 0] and not any(r.b or r.z for r in got)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (3, "", 3), (4, "x " * 50000, 4), (4, "x " * 50000, 4)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, 0), (None, None), (4, 1)], "doc_id long, quality int")
    got = judge_quality(docs, labels).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 2, 50000, 50000] and all(r.base_failed and not r.kept for r in got)
    assert keep_good(docs, []).columns == docs.columns and keep_good(docs, []).count() == 0
    assert judge_quality(docs.limit(0), labels.limit(0)).count() == 0
    assert count_texts(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op5_decision_list_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for k in list(texts)[:150]:
        r, want = got[k], brute(texts[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    good = [k for k, v in labels.items() if v == 1 and not got[k].base_failed]
    bad = [k for k, v in labels.items() if v == 0]
    assert sum(got[k].kept for k in good) >= 0.97 * len(good)
    assert sum(not got[k].kept for k in bad) >= 0.85 * len(bad)
