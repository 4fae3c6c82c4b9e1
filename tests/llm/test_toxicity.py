import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash

from lociframe.llm.common import crc_remainder
from lociframe.llm.toxicity import PREFIXES, SUFFIXES, Chain, drop_toxic, learn, op8_crf_toxicity, score_toxicity


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        first = np.zeros(n, bool)
        first[0] = True
        if n > 4:
            first[4] = True
        x, t, s = np.exp(rng.normal(size=n)), np.exp(rng.normal(size=(2, 2))), 0.3
        p, pairs, z = np.zeros(n), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = np.prod([x[i] ** y[i] * ((s if y[i] else 1) if first[i] else t[y[i - 1], y[i]]) for i in range(n)])
            z += w
            p += w * np.array(y)
            for i in range(1, n):
                if not first[i]:
                    pairs[y[i - 1], y[i]] += w
        chain = Chain(x, first, t, s)
        assert np.allclose(chain.p, p / z) and np.allclose(chain.pairs(), pairs / z)


def texts_of(n, rng):
    out, toxic = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefg')}{rng.choice('hijklm')}{rng.choice('nopq')}{rng.choice('rstu')}" for _ in range(rng.randrange(20, 200))]
        y = i % 6 == 0
        for _ in range(4 if y else 0):
            w[rng.randrange(len(w))] = rng.choice(["Vileword!", "NASTY", "grimthing***", "grimperson"])
        out.append(" ".join(w))
        toxic.append(y)
    return out, np.array(toxic)


def test_learns_and_finds_spans(spark):
    rng = random.Random(1)
    texts, toxic = texts_of(900, rng)
    model = learn(pa.array(texts[:600]), toxic[:600])
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts[600:])], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    right = sum((got[i].score >= 0.5) == bool(y) for i, y in enumerate(toxic[600:]))
    assert right >= 0.97 * len(got)
    words = {texts[600 + i][s.start : s.end] for i in got for s in got[i].spans}
    assert any("Vileword!" in w for w in words) and any("grimthing***" in w for w in words)
    assert drop_toxic(docs, model).count() == sum(r.score < 0.5 for r in got.values())
    assert drop_toxic(docs, model).columns == docs.columns
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "é \t"), (2, "Vileword! " * 30000)], "doc_id long, text string")
    scored = score_toxicity(odd, model).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    assert max(scored, key=lambda r: r.score).doc_id == 2
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_one_class_or_no_labels():
    for texts, y in (([], []), (["a b"], [0]), (["a b", "c"], [1, 1])):
        model = learn(pa.array(texts, pa.string()), np.array(y))
        assert 0 <= model.score(np.zeros(1), np.zeros(1), np.zeros(1))[0] <= 1


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op8_crf_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc_remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def plain_score(model, text):
    """A document's score by loops: weights from a dictionary, sums over both tags word by word, logistic of the summary."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    x = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word).lower()
        names = [f"w0:{core}"] if core else []
        names += [f"p{k}:{core[:k]}" for k in PREFIXES if len(core) >= k] + [f"s{k}:{core[-k:]}" for k in SUFFIXES if len(core) >= k]
        x.append(math.exp(min(30, max(-30, model.bias + sum(weights.get(xxhash.xxh3_64_intdigest(n.encode()), 0) for n in names)))))
    t = np.exp(model.transition)
    ahead, behind = [], [np.ones(2)]
    for i, odds in enumerate(x):
        now = np.array([1.0, math.exp(model.start)]) if i == 0 else ahead[-1] @ t
        ahead.append(now * [1.0, odds] / (now * [1.0, odds]).sum())
    for odds in reversed(x[1:]):
        before = t @ (behind[-1] * [1.0, odds])
        behind.append(before / before.sum())
    p = [float((a * b)[1] / (a * b).sum()) for a, b in zip(ahead, reversed(behind))]
    total, peak, n = sum(p), max(p, default=0.0), len(p)
    share = total / (n + 20)
    told = [math.log(total + 0.05), share, math.log(share + 1e-4), peak, math.log1p(n), min(total, 3)]
    z = model.logistic[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.logistic[1:], told, model.mean, model.scale))
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def test_document_scores_match_plain_loops(spark):
    rng = random.Random(2)
    texts, toxic = texts_of(600, rng)
    model = learn(pa.array(texts[:400]), toxic[:400])
    rows = list(enumerate([*texts[400:], None, "", "!!", "nasty", "(Vileword) Éa--", "grim " * 3000]))
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - plain_score(model, t)) < 1e-8 for i, t in rows)
