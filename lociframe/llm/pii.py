"""Operator 1: personal data by anchor expansion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import pick

#: Kinds of the base, in order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "login_url", "iban", "secret")
KINDS = BASE + ADDED

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED = re.compile(r"[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?([A-Za-z0-9-]+(?:(?:\.|[\x20]?(?:\(dot\)|\[dot\]|\{dot\})[\x20]?)[A-Za-z0-9-]+)+)", re.I)
_LOGIN = re.compile(r"://[^\s/?#@:]++:[^\s/?#@]++@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\x20:#.=]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_GIVEN = re.compile(r"[\"']?[\x20]{0,2}[:=][\x20]{0,2}[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9_./+=-]{16,}")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Words before an account number or a secret.
_IBAN_CUES = ("iban",)
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in _DIGIT:
        found.add_word(d, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for left, right in ("()", "[]", "{}"):
        for at in ("at", "AT", "At"):
            found.add_word(left + at + right, "masked")
    for kind, cues in (("iban", _IBAN_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _back(text: str, at: int, least: int, among: frozenset) -> int:
    while at > least and text[at - 1] in among:
        at -= 1
    return at


class PiiFinder:
    """Finds spans in one text: a single pass of the automaton gives anchors, a parser a kind grows each to its bounds.

    For the base kinds the parsers give what the leftmost non-overlapping matches of their patterns give: each
    kind remembers where its last match ended, whether or not the match then held good, and no parser looks
    behind that. A parser reads every character a bounded number of times, so the work is linear in the text.
    """

    def __init__(self) -> None:
        self.anchors = _automaton()

    def __call__(self, text: str | None) -> list[Span]:
        """Spans (kind, start, end) in code points, end exclusive; by kind, then start. Null and empty: none."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)
        if text:
            for last, anchor in self.anchors.iter(text):
                getattr(self, f"_{anchor}")(text, last, out, done)
        return [(k, a, b) for k in KINDS for a, b in out[k]]

    def _at(self, text, at, out, done) -> None:
        start = _back(text, at, done["email"], _LOCAL)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            done["email"] = m.end()

    def _digit(self, text, at, out, done) -> None:
        if at and text[at - 1] in _DIGIT:  # inside a run that was tried from its start
            return
        if at >= done["ip"] and (m := _IP.match(text, at)):
            done["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        if at >= done["card"] and (m := _CARD.match(text, at)):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())

    def _plus(self, text, at, out, done) -> None:
        if at >= done["phone"] and (m := _PHONE.match(text, at)):
            done["phone"] = m.end()
            if 9 <= sum(c in _DIGIT for c in m[0]) <= 15:
                out["phone"].append(m.span())

    def _masked(self, text, last, out, done) -> None:
        at = last - 3
        at -= text[at - 1 : at] == " "
        start = _back(text, at, done["masked_email"], _LOCAL)
        if start < at and (m := _MASKED.match(text, at)):
            out["masked_email"].append((start, m.end()))
            done["masked_email"] = m.end()

    def _scheme(self, text, last, out, done) -> None:
        at = last - 2
        start = _back(text, at, done["login_url"], _SCHEME)
        if start < at and (m := _LOGIN.match(text, at)):
            out["login_url"].append((start, m.end()))
            done["login_url"] = m.end()

    def _iban(self, text, last, out, done) -> None:
        m = _IBAN.match(text, last + 1)
        if m and m.start(1) >= done["iban"] and _mod97(m[1].replace(" ", "")):
            out["iban"].append(m.span(1))
            done["iban"] = m.end(1)

    def _secret(self, text, last, out, done) -> None:
        given = _GIVEN.match(text, last + 1)
        # Cues inside a run that was read aren't followed again: what ends it has no more letters or digits than all of it.
        if given and given.end() >= done["secret"] and (m := _SECRET.match(text, given.end())):
            done["secret"] = m.end()
            if any(c in _DIGIT for c in m[0]) and any(c.isalpha() for c in m[0]):
                out["secret"].append(m.span())


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or union of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:  # lies in or runs on from what was replaced
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(found: Callable[[list, list[list[Span]]], dict[str, pa.Array]]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PiiFinder()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            more = found(texts, [finder(t) for t in texts])
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *more.values()], names=[*kept, *more])

    return scan


def _columns(texts: list, spans: list[list[Span]]) -> dict[str, pa.Array]:
    return {"spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _SPANS)}


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text: ``key`` and spans, an array of (kind, start, end), by kind, then start.

    Null and empty texts have no spans. Null and repeated keys stay as they are, one row a row; an empty table
    gives an empty one; other columns are left out. No shuffle: each task scans its own rows, one text at a time.
    """
    rows = pick(docs, key, text).toDF(key, "_text")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_scan(_columns), f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``length`` set to the code points left.

    Null and empty texts stay what they are, with a length of 0. Null keys and repeated rows stay, one row a row; an empty table
    gives an empty one; columns may have any names, and without one named ``length`` none is set. No shuffle.
    """

    def put(texts: list, spans: list[list[Span]]) -> dict[str, pa.Array]:
        return {"_clean": pa.array([t if not s else redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())}

    names = docs.columns
    shown = [f"_c{i}" if n != text else "_text" for i, n in enumerate(names)]
    rows = docs.toDF(*shown)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "_clean string"])
    clean = rows.mapInArrow(_scan(put), schema)
    size = F.length("_clean")
    out = {text: F.col("_clean")} | ({length: F.coalesce(size, F.lit(0)).cast(docs.schema[length].dataType)} if length in names else {})
    return clean.select(*[out.get(n, F.col(s)).alias(n) for n, s in zip(names, shown, strict=True)])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in ADDED],
    )


