"""Operator 5: learned decision lists over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import pick, share_of
from lociframe.llm.words import filled, mix, portions, rows_of, split_words

#: Labelled rows that a list is learned from: about this many of them, chosen by a hash of their key.
LABELLED_ROWS = 40_000
#: Words of a window for repeats.
REPEAT = 8
#: Counts of each whole text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_letters", "n_digits", "n_bang", "n_pipe", "n_stop", "longest_word")

_COUNTED = {"n_symbols": r"[#*$%&|<>]", "n_upper": r"\p{Lu}", "n_letters": r"\p{L}", "n_digits": r"[0-9]", "n_bang": r"!", "n_pipe": r"\|", "n_stop": r"[.?,;:]"}


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text (no nulls).

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words that lie in a window of eight
    which the text has at least twice. Windows are found by one 64-bit key each and one sort of the portion; rows
    that meet are compared word by word, so an equal key alone never counts.
    """
    n = len(texts)
    words = split_words(texts)
    out: dict[str, np.ndarray] = {"n_words": words.count}
    sizes = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False) if len(words.vocabulary) else np.zeros(0)
    per_word = sizes[words.code] if len(words.code) else np.zeros(0)
    out["word_chars"] = rows_of(per_word, words.doc, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.doc, per_word.astype(np.int64))
    out["longest_word"] = longest
    for name, pattern in _COUNTED.items():
        out[name] = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    width = np.uint64(max(1, len(words.vocabulary)))
    seen = np.unique(words.doc.astype(np.uint64) * width + words.code.astype(np.uint64))
    out["n_distinct"] = np.bincount((seen // width).astype(np.int64), minlength=n)

    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten().dictionary_encode()
    line, row = flat.indices.to_numpy(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    worded = pc.match_substring_regex(flat.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False).astype(bool)
    has = worded[line] if len(line) else np.zeros(0, bool)
    line, row = line[has].astype(np.int64), row[has]
    distinct = np.unique(row * max(1, len(worded)) + line)
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct // max(1, len(worded)), minlength=n)

    out["n_repeat_words"] = rows_of(_in_repeats(words.code, words.doc).astype(np.float64), words.doc, n)
    return {k: np.asarray(out[k], np.int64) for k in COUNTS}


def _in_repeats(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window of REPEAT words that occurs at least twice in their row."""
    windows = len(code) - REPEAT + 1
    if windows < 2:
        return np.zeros(len(code), bool)
    inside = doc[:windows] == doc[REPEAT - 1 :]
    start = np.flatnonzero(inside)
    key = mix(doc[start].astype(np.uint64) + np.uint64(1))
    drawn = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(REPEAT):
        key = key * np.uint64(0x9E3779B97F4A7C15) + drawn[start + k]
    order = np.argsort(key, kind="stable")
    a, b = start[order[:-1]], start[order[1:]]
    meet = np.flatnonzero(key[order[:-1]] == key[order[1:]])
    a, b = a[meet], b[meet]
    same = doc[a] == doc[b]
    for k in range(REPEAT):
        same &= code[a + k] == code[b + k]
    edge = np.zeros(len(code) + 1, np.int64)
    for x in (np.unique(np.concatenate([a[same], b[same]])),):
        edge[x] += 1
        np.subtract.at(edge, x + REPEAT, 1)
    return np.cumsum(edge[:-1]) > 0


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "_text"):
        counts = text_counts(filled(batch.column("_text")))
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in counts.values())], names=[*kept, *counts])


def count_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and COUNTS of every whole text.

    Null and empty texts: all 0. Null and repeated keys stay, one row a row; an empty table gives an empty one; other columns
    are left out. No shuffle.
    """
    rows = pick(docs, key, text).toDF(key, "_text")
    return rows.mapInArrow(_count_rows, f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: Statistics that conditions test: numerator and denominator (0 where that is 0).
STATISTICS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "longest_word": ("longest_word", None),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "bangs_per_word": ("n_bang", "n_words"),
    "pipes_per_word": ("n_pipe", "n_words"),
    "stops_per_word": ("n_stop", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def statistic(name: str) -> Column:
    a, b = STATISTICS[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _statistics(table: dict[str, np.ndarray]) -> np.ndarray:
    out = []
    for a, b in STATISTICS.values():
        x = table[a].astype(float)
        out.append(x if b is None else np.divide(x, table[b], out=np.zeros_like(x), where=table[b] > 0))
    return np.column_stack(out) if len(table["n_words"]) else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, at most?, threshold) together mark a text as bad. bad, good: learning rows covered."""

    conditions: tuple[tuple[str, bool, float], ...]
    bad: int = 0
    good: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.conditions:
            out = out & (statistic(name) <= threshold if at_most else statistic(name) >= threshold)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if m else '>='} {t:g}" for n, m, t in self.conditions)


NAMES = tuple(STATISTICS)


def _covers(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, at_most, threshold in conditions:
        v = x[:, NAMES.index(name)]
        out &= v <= threshold if at_most else v >= threshold
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[str, bool, float]]:
    """Add the condition of the highest information gain until no good row is covered or none gains."""
    conditions: list[tuple[str, bool, float]] = []
    at = np.arange(len(x))
    while len(conditions) < most and len(at):
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        if not n or not p:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(NAMES):
            order = np.argsort(x[at, j], kind="stable")
            v, b = x[at, j][order], bad[at][order]
            ups = np.flatnonzero(v[1:] > v[:-1])  # a threshold between two values
            if not len(ups):
                continue
            below_p, below = np.cumsum(b)[ups], ups + 1
            for at_most, pp, all_ in ((True, below_p, below), (False, p - below_p, len(v) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / all_) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, at_most, float((v[ups[k]] + v[ups[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        at = at[_covers(x[at], [best[1]])]
    return conditions


def learn_decision_list(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 24, most_conditions: int = 5, least_bad: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the third, keep it if precise.

    Pruning drops final conditions while (bad - good) / (bad + good) on the rows kept back doesn't fall. A rule
    enters the list if its precision over all rows that earlier rules leave is at least ``precision`` and it
    covers ``least_bad`` bad ones; what it covers is taken away before the next. No rows, or rows of one
    class: an empty list, which keeps every text.
    """
    x, bad = _statistics(table), np.asarray(bad, bool)
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(bad), bool)
    misses = 0
    while len(rules) < most_rules and misses < 4 and bad[left].sum() >= least_bad:
        at = np.flatnonzero(left)
        part = rng.random(len(at)) < 2 / 3
        grown, held = at[part], at[~part]
        conditions = _grow(x[grown], bad[grown], most_conditions)

        def worth(conds, held=held) -> float:
            c = _covers(x[held], conds)
            p, n = int(bad[held][c].sum()), int((~bad[held][c]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        covered = at[_covers(x[at], conditions)] if conditions else at[:0]
        p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
        if p < least_bad or p < precision * (p + n):
            misses += 1
            continue
        rules.append(Rule(tuple(conditions), p, n))
        left[covered] = False
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a text meets, from 1; 0 if none: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = LABELLED_ROWS) -> list[Rule]:
    """A list learned from labelled whole texts; the counts of about ``bound`` rows come to the driver.

    Texts that the base fails anyway teach nothing and are left out, as are null keys and labels; a key with
    several labels has their mean, bad below one half; of a key with several rows one is learned from, that of the least
    counts, so no key fills the driver. Without labels no rule is learned.
    """
    marked = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_label")).where("_label IS NOT NULL AND _id IS NOT NULL")
    share = min(1.0, bound / max(1, marked.count()))
    mine = marked.where(share_of(F.xxhash64("_id", F.lit("learn")), share)).groupBy("_id").agg(F.avg("_label").alias("_label"))
    rows = pick(docs, key, text).toDF("_id", "_text").join(F.broadcast(mine), "_id")  # about ``bound`` keys
    counted = count_texts(rows.select("_id", "_text"), "_id", "_text").where(~base_failed()).join(F.broadcast(mine), "_id")
    counted = counted.groupBy("_id").agg(F.min(F.struct(*COUNTS)).alias("_counts"), F.first("_label").alias("_label")).select("_id", "_counts.*", "_label")
    table = counted.toArrow().sort_by([("_id", "ascending"), *((c, "ascending") for c in COUNTS)])
    return learn_decision_list({c: table[c].to_numpy() for c in COUNTS}, table["_label"].to_numpy() < 0.5)


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's counts, base_failed, rule (0: none) and kept.

    The list is learned from labelled texts; counts come from one pass over the whole texts and the list is
    applied to them as one conditional expression. Null and empty texts have counts of 0 and fail the base. Null
    and repeated keys stay; a null key has no label. An empty table gives an empty one; other columns are left out.
    """
    rules = learn_rules(docs, labels, key, text)
    judged = count_texts(docs, key, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base and that no rule marks.

    Null and empty texts fail the base and go. Null keys and repeated rows are judged row by row; an empty table gives an
    empty one; columns may have any names, those of COUNTS among them. One pass, no shuffle.
    """
    names = docs.columns
    shown = [f"_c{i}" for i in range(len(names))]
    rows = docs.toDF(*shown).withColumn("_text", F.col(shown[names.index(text)]))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), *(f"{c} bigint" for c in COUNTS)])
    kept = rows.mapInArrow(_count_rows, schema).where(~base_failed() & (verdict(rules) == 0))
    return kept.select(*[F.col(s).alias(n) for n, s in zip(names, shown, strict=True)])


def op5_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
