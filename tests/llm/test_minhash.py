import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from lociframe.llm import minhash
from lociframe.llm.graph import connected_components
from lociframe.llm.minhash import WINDOW, least_depth, near_duplicates, op7_lsh_forest_dedup, parity_bits, prefix_lengths, scan_order, shingle_sets


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, similarity=85):
    """texts: {id: text}; exact components over an inverted index."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        for h in s:
            index[h].append(k)
    seen = set()
    for members in index.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


def compare(got, texts, similarity=85):
    want = brute(texts, similarity)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_groups_of_near_copies(spark):
    rng = random.Random(2)
    texts = {}
    for g in range(30):
        base = words(rng, rng.randrange(60, 160))
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            texts[len(texts)] = " ".join(w)
    base = words(rng, 150)
    for _ in range(160):  # one large group of texts that differ
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts[len(texts)] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    compare(near_duplicates(docs).collect(), texts)


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    texts = {1: None, 2: "", 3: " \n ", 4: "One two", 5: "one TWO", 6: "one two three", 7: long, 8: long.upper(), 9: "é É"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, node int")
    compare(near_duplicates(docs).collect(), texts)
    assert near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "one two"), (4, "one two"), (4, "one two"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7), (200, 201), (201, 202), (300, 300), (None, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 1, 200: 200, 201: 200, 202: 200, 300: 300}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    compare(op7_lsh_forest_dedup(spark, sf).collect(), texts)


def test_different_texts_of_one_key(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(words(rng, 100)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (3, a + " more"), (9, b + " more"), (7, c), (None, b)]
    for parts in (1, 4):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 3, False), (3, 3, True), *[(5, 3, False)] * 3, (7, 7, True), (9, 3, False)]


def test_a_common_body_without_links(spark, monkeypatch):
    """Texts that share most of their words and don't link, beside some that do: comparisons grow with the texts."""
    rng = random.Random(5)
    body = [f"b{i}" for i in range(120)]
    compared = {}
    real = minhash._confirmed
    for n in (150, 600):
        texts = {i: " ".join(body + [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(28, 36))]) for i in range(n)}
        texts |= {n + i: texts[i] + " more" for i in range(0, n, 10)}
        total = []
        monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *rest: total.append(pairs.count()) or real(pairs, *rest))
        compare(near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect(), texts)
        compared[n] = sum(total)
    assert compared[600] < 6 * compared[150]


def test_a_dense_group_at_the_threshold(spark):
    rng = random.Random(6)
    base, texts = words(rng, 120), {}
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for similarity in (85, 80):
        compare(near_duplicates(docs, similarity=similarity).collect(), texts, similarity)


def test_neighbours_in_a_sorted_order():
    rng = np.random.default_rng(1)
    sig = np.sort(rng.choice(3, (400, 8), p=[0.7, 0.2, 0.1]).astype(">u4").view("V32").ravel()).view(">u4").reshape(-1, 8)
    tree, node = np.zeros(400, np.int32), rng.permutation(400)
    a, b, crowded = scan_order(tree, sig, node, 4, 0, 400)
    got, far = set(zip(a.tolist(), b.tolist())), set(crowded.tolist())
    place = {int(n): i for i, n in enumerate(node)}
    for i in range(400):
        for j in range(i + 1, 400):
            x, y = int(node[i]), int(node[j])
            if (sig[i, :4] == sig[j, :4]).all():
                assert (x, y) in got or (x in far and y in far)
            else:
                assert (x, y) not in got
    assert all(place[y] - place[x] <= WINDOW for x, y in got) and far
    assert least_depth(85) == 4 and least_depth(80) == 3


def test_prefixes_and_parity_miss_no_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, similarity = int(rng.integers(5, 200)), int(rng.choice([80, 85, 95]))
        x = rng.permutation(400)[:n]
        y = np.unique(np.concatenate([x[rng.random(n) < 0.93], rng.integers(400, 800, int(rng.integers(0, 8)))]))
        x, both = np.sort(x), len(np.intersect1d(x, y))
        apart = int(np.unpackbits((parity_bits(minhash.mix(x)) ^ parity_bits(minhash.mix(y))).view(np.uint8)).sum())
        assert apart <= len(x) + len(y) - 2 * both
        if 100 * both >= similarity * (len(x) + len(y) - both):
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            i, j = prefix_lengths(len(small), similarity)[1], prefix_lengths(len(large), similarity)[0]
            assert set(small[:i]) & set(large[:j])
    assert shingle_sets(pa.array(["a b"]))[1].tolist() == [1]
