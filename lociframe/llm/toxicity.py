"""Operator 8: toxic spans by a linear-chain conditional random field, toxic documents by its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import WORD_RE, pick, remainder, share_of
from lociframe.llm.words import Words, filled, portions, split_words

#: Labelled rows that the field is learned from: about this many of them, chosen by a hash of their key.
LABELLED_ROWS = 6_000
#: Rows whose key's CRC-32 has this remainder are held out.
HELD_OUT, FOLDS = 0, 5
#: Prefix and suffix lengths of a word that are features, beside the word.
PREFIXES, SUFFIXES = (4, 5, 6, 7), (4, 6)
_CORE = r"^[^\p{L}\p{N}]*(?P<core>.*?)[^\p{L}\p{N}]*$"


def cores(words: Words) -> tuple[pa.Array, np.ndarray]:
    """Distinct lower-case words without marks at their ends, and which of them each word of the texts is."""
    found = pc.fill_null(pc.struct_field(pc.extract_regex(words.vocabulary, _CORE), "core"), "")
    encoded = pc.utf8_lower(found).dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy()[words.code] if len(words.code) else np.zeros(0, np.int64)


def features(core: pa.Array) -> np.ndarray:
    """64-bit feature hashes, a row a word."""
    size = pc.utf8_length(core)
    out = []
    for name, k in [("w", 0), *(("p", k) for k in PREFIXES), *(("s", k) for k in SUFFIXES)]:
        part = core if name == "w" else pc.utf8_slice_codeunits(core, 0, k) if name == "p" else pc.utf8_slice_codeunits(core, -k, None)
        if name != "w":  # a shorter word has no such feature: its word feature says as much
            part = pc.if_else(pc.greater_equal(size, k), part, "")
        encoded = part.dictionary_encode()
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(f"{name}{k}:{t}") if t else 0 for t in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
        out.append(hashed[encoded.indices.to_numpy()] if len(core) else np.zeros(0, np.uint64))
    return np.column_stack(out)


class Chain:
    """A field with the labels 0 (clean) and 1 (toxic) over words end to end, many texts at once.

    ``x`` are the emission odds of label 1, ``t`` the 2 x 2 transition weights, ``s`` the odds of label 1 at a
    text's first word. The odds of the two labels, forward and backward, follow recursions of one fraction, which
    are worked on in columns: each column's map is composed, starts are carried from column to column, and then
    all columns run at once.
    """

    def __init__(self, x: np.ndarray, first: np.ndarray, t: np.ndarray, s: float) -> None:
        self.x, self.first, self.t = x, first, t
        n = len(x)
        last = np.zeros(n, bool)
        last[:-1] = first[1:]
        if n:
            last[-1] = True
        # Forward: r = x (t01 + r t11) / (t00 + r t10), as numerator a + b r, denominator c + d r.
        self.r = self._run(np.where(first, x * s, x * t[0, 1]), np.where(first, 0, x * t[1, 1]), np.where(first, 1.0, t[0, 0]), np.where(first, 0, t[1, 0]))
        # Backward: b = (t10 + t11 y b') / (t00 + t01 y b') with y, b' of the next word; 1 at the last.
        y = np.append(x[1:], 1.0)[:n]
        back = self._run(*(v[::-1] for v in (np.where(last, 1.0, t[1, 0]), np.where(last, 0, t[1, 1] * y), np.where(last, 1.0, t[0, 0]), np.where(last, 0, t[0, 1] * y))))
        self.b = back[::-1]
        odds = self.r * self.b
        self.p = odds / (1 + odds)

    @staticmethod
    def _run(a, b, c, d) -> np.ndarray:
        n = len(a)
        if not n:
            return np.zeros(0)
        steps = max(1, int(np.sqrt(n)) // 2)
        wide = -(-n // steps)
        pad = wide * steps - n
        a, b, c, d = (np.concatenate([v, np.full(pad, z)]).reshape(wide, steps).T.copy() for v, z in ((a, 1.0), (b, 0.0), (c, 1.0), (d, 0.0)))
        # Compose each column: r -> (p + q r) / (u + v r).
        p, q, u, v = np.zeros(wide), np.ones(wide), np.ones(wide), np.zeros(wide)
        for k in range(steps):
            p, q, u, v = a[k] * u + b[k] * p, a[k] * v + b[k] * q, c[k] * u + d[k] * p, c[k] * v + d[k] * q
            z = p + q + u + v
            p, q, u, v = p / z, q / z, u / z, v / z
        start = np.empty(wide)
        r = 1.0
        for i, (pi, qi, ui, vi) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
            start[i] = r
            r = min(max((pi + qi * r) / max(ui + vi * r, 1e-300), 1e-300), 1e300)
        out = np.empty((steps, wide))
        r = start
        for k in range(steps):
            r = (a[k] + b[k] * r) / (c[k] + d[k] * r)
            out[k] = r
        return out.T.ravel()[:n]

    def pairs(self) -> np.ndarray:
        """Expected number of each transition."""
        inner = np.flatnonzero(~self.first)
        r, x, b = self.r[inner - 1], self.x[inner], self.b[inner]
        w = np.stack([self.t[0, 0] + 0 * r, self.t[0, 1] * x * b, self.t[1, 0] * r, self.t[1, 1] * r * x * b])
        return (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class ToxicityModel:
    """keys, weights: the features of the field, sorted by hash; bias, transition, start: its other log weights; the rest scores documents."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    start: float
    mean: np.ndarray
    scale: np.ndarray
    logistic: np.ndarray

    def emission(self, hashed: np.ndarray) -> np.ndarray:
        """Log odds of a toxic tag for each row of feature hashes."""
        if not len(self.keys) or not len(hashed):
            return np.full(len(hashed), self.bias)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return self.bias + np.where(self.keys[at] == hashed, self.weights[at], 0).sum(axis=1)

    def tag(self, words: Words) -> np.ndarray:
        """Marginal probability of a toxic tag for every word."""
        core, code = cores(words)
        x = np.exp(np.clip(self.emission(features(core)), -30, 30))[code] if len(code) else np.zeros(0)
        return Chain(x, first_words(words), np.exp(self.transition), float(np.exp(self.start))).p

    def score(self, total: np.ndarray, peak: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (summary(total, peak, count) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + z @ self.logistic[1:], -40, 40)))


def first_words(words: Words) -> np.ndarray:
    first = np.ones(len(words.doc), bool)
    first[1:] = words.doc[1:] != words.doc[:-1]
    return first


def sums(p: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of toxic words, and the highest marginal, of each text."""
    n = len(words.count)
    peak = np.zeros(n)
    np.maximum.at(peak, words.doc, p)
    return np.bincount(words.doc, weights=p, minlength=n), peak


def summary(total: np.ndarray, peak: np.ndarray, count: np.ndarray) -> np.ndarray:
    long = np.log1p(count)
    return np.column_stack([np.log(total + 0.05), total / (count + 20), np.log(total / (count + 20) + 1e-4), peak, long, np.minimum(total, 3)])


def evidence(hashed: np.ndarray, code: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of the texts, texts that have each, and how far below chance twice its error the clean side lies.

    The last is the log ratio of a feature's smoothed rates in toxic and clean texts, less two standard errors.
    """
    width = np.uint64(max(1, len(hashed)))
    own = np.unique(doc.astype(np.uint64) * width + code.astype(np.uint64))
    d, w = (own // width).astype(np.int64), (own % width).astype(np.int64)
    keys, at = np.unique(hashed, return_inverse=True)
    at = at.reshape(hashed.shape).astype(np.int32)
    yes, all_ = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(hashed.shape[1]):  # a feature is of one column, but for 0, which is none
        pair = np.unique(at[w, k] * np.int64(len(toxic) + 1) + d)
        f, of = pair // (len(toxic) + 1), pair % (len(toxic) + 1)
        yes += np.bincount(f, weights=toxic[of], minlength=len(keys))
        all_ += np.bincount(f, minlength=len(keys))
    no = all_ - yes
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    ratio = np.log((yes + 0.5) / (n1 + 1)) - np.log((no + 0.5) / (n0 + 1))
    bound = ratio - 2 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    bound[keys == 0] = -np.inf
    return keys, all_, bound


def _groups(first: np.ndarray, most: int = 300_000) -> list[int]:
    """Bounds of runs of whole texts of about ``most`` words."""
    starts = np.flatnonzero(first)
    part = starts // most
    return [*starts[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(first)] if len(starts) else [0, 0]


def learn(texts: pa.Array, toxic: np.ndarray, rounds: int = 45, l2: float = 0.3, lead: float = 1.0, seed: int = 3) -> ToxicityModel:
    """Labelled texts to a model. Three quarters teach the field, one quarter how its marginals score a text.

    Tokens are labelled first: in toxic texts those with a feature whose evidence exceeds ``lead``, and none in
    clean texts. The field then maximises the log likelihood of these tags, less the penalty, by Rprop.
    """
    toxic = np.asarray(toxic, float)
    fold = np.random.default_rng(seed).random(len(toxic)) < (0.25 if len(toxic) >= 40 else 0)
    teach = texts.filter(pa.array(~fold))
    y_doc = toxic[~fold]
    words = split_words(teach)
    core, code = cores(words)
    hashed = features(core)
    keys, seen, bound = evidence(hashed, code, words.doc, y_doc)
    strong = keys[bound > lead]
    marked = np.isin(hashed, strong).any(axis=1)
    y = (marked[code] & (y_doc[words.doc] > 0.5)).astype(float) if len(code) else np.zeros(0)
    # Features of at least three texts, or of a marked word, have a weight.
    held = keys[((seen >= 3) | np.isin(keys, strong)) & (keys != 0)]
    at = np.minimum(np.searchsorted(held, hashed), max(0, len(held) - 1))
    known = (held[at] == hashed) if len(held) else np.zeros(hashed.shape, bool)
    at = np.where(known, at, len(held))
    first = first_words(words)
    pairs_y = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pairs_y, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(len(held) + 6)  # weights, bias, four transitions, start
    theta[len(held)] = np.log((y.sum() + 0.5) / (len(y) + 1))
    step, before = np.full(len(theta), 0.1), np.zeros(len(theta))
    at = at.astype(np.int32)
    bounds = _groups(first)
    for _ in range(rounds if len(y) else 0):
        w = np.append(theta[: len(held)], 0.0)
        x = np.exp(np.clip(theta[len(held)] + w[at].sum(axis=1), -30, 30))
        per_word, pairs_p, start_g = np.zeros(len(core)), np.zeros((2, 2)), 0.0
        for i, j in zip(bounds, bounds[1:]):  # whole texts, some hundred thousand words at once
            chain = Chain(x[code[i:j]], first[i:j], np.exp(theta[-5:-1].reshape(2, 2)), float(np.exp(theta[-1])))
            gap = y[i:j] - chain.p
            per_word += np.bincount(code[i:j], weights=gap, minlength=len(core))
            pairs_p += chain.pairs()
            start_g += gap[first[i:j]].sum()
        g = sum(np.bincount(at[:, k], weights=per_word, minlength=len(held) + 1) for k in range(at.shape[1]))[: len(held)]
        g = np.concatenate([g, [per_word.sum()], (pairs_y - pairs_p).ravel(), [start_g]]) - l2 * theta * (np.arange(len(theta)) != len(held))
        turn = np.sign(g) * np.sign(before)
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-6, 1.0)
        before = np.where(turn < 0, 0, g)
        theta = theta + np.sign(before) * step
    keep = np.abs(theta[: len(held)]) > 1e-3
    model = ToxicityModel(held[keep], theta[: len(held)][keep], float(theta[len(held)]), theta[-5:-1].reshape(2, 2), float(theta[-1]), np.zeros(6), np.ones(6), np.zeros(7))
    judge = texts.filter(pa.array(fold)) if fold.any() else texts
    summaries = [np.zeros((0, 6))]
    for i in range(0, len(judge), 200):
        words = split_words(judge.slice(i, 200))
        summaries.append(summary(*sums(model.tag(words), words), words.count))
    model.mean, model.scale, model.logistic = _logistic(np.concatenate(summaries), toxic[fold] if fold.any() else toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(x) or y.min() == y.max():  # one class: the smoothed share whatever the text
        rate = (y.sum() + 0.5) / (len(y) + 2)  # without labels below one half: nothing is toxic
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.log(rate / (1 - rate)), np.zeros(x.shape[1]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = l2 * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED_ROWS) -> ToxicityModel:
    """Learn from the labelled rows that aren't held out; about ``bound`` of them come to the driver, their texts whole.

    Null keys and labels teach nothing. A key with several labels has their mean, toxic at one half or more; of a key
    with several rows one text is learned from, the least by a hash, so no key fills the driver. Empty tables and
    labels of one class give a model with one score below one half, or the smoothed share of toxic labels; other columns are
    not looked at.
    """
    marked = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_label")).where("_label IS NOT NULL AND _id IS NOT NULL")
    share = min(1.0, bound / max(1, marked.count()))
    mine = marked.where((remainder(F.col("_id"), FOLDS) != HELD_OUT) & share_of(F.xxhash64("_id", F.lit("toxic")), share))
    mine = mine.groupBy("_id").agg(F.avg("_label").alias("_label"))
    rows = pick(docs, key, text).toDF("_id", "_text").join(F.broadcast(mine), "_id")  # about ``bound`` keys
    least = F.struct(F.xxhash64("_text", F.lit("least")), "_text")
    rows = rows.groupBy("_id").agg(F.min_by("_text", least).alias("_text"), F.first("_label").alias("_label"))
    table = rows.select("_text", "_label", F.xxhash64("_id", F.lit("order")).alias("_at")).toArrow().sort_by([("_at", "ascending"), ("_text", "ascending")])
    return learn(filled(table["_text"].combine_chunks()), table["_label"].to_numpy() >= 0.5)


def _scorer(model, spans: bool) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: ToxicityModel = model.value
        for batch in portions(batches, "_text", 4 << 20):
            texts = filled(batch.column("_text"))
            words = split_words(texts)
            p = plan.tag(words)
            total, peak = sums(p, words)
            out = {n: batch.column(n) for n in batch.schema.names if n != "_text" or not spans}
            out["score"] = pa.array(plan.score(total, peak, words.count))
            if spans:
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                start = words.start
                for i in np.flatnonzero(peak >= 0.5):
                    own = p[start[i] : start[i] + words.count[i]] >= 0.5
                    at = [m.span() for m in WORD_RE.finditer(texts[int(i)].as_py())]
                    for k in np.flatnonzero(own & ~np.append(False, own[:-1])):
                        to = k
                        while to + 1 < len(own) and own[to + 1]:
                            to += 1
                        found[i].append({"start": at[k][0], "end": at[to][1]})
                out["spans"] = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score (0 to 1) and spans, the offsets (start, end) in code points of runs of words tagged toxic.

    Every whole text is tagged, by its words alone. Null and empty texts get the score of a text without words.
    Null and repeated keys stay, one row a row; an empty table gives an empty one; other columns are left out.
    No shuffle; the model is broadcast (its size is bounded by the labelled rows it was learned from).
    """
    rows = pick(docs, key, text).toDF(key, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, True), f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``.

    Null and empty texts have the score of a text without words. Null and repeated keys and repeated rows are judged row by
    row; an empty table gives an empty one; columns may have any names, ``score`` among them. No shuffle.
    """
    names = docs.columns
    shown = [f"_c{i}" if n != text else "_text" for i, n in enumerate(names)]
    rows = docs.toDF(*shown)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "score double"])
    kept = rows.mapInArrow(_scorer(shared, False), schema).where(F.col("score") < threshold)
    return kept.select(*[F.col(s).alias(n) for n, s in zip(names, shown, strict=True)])


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), offsets)
