import hashlib
import random
import re
import time

from lociframe.llm.pii import BASE, PiiFinder, digest, find_pii, luhn, op1_anchor_pii, redact, redact_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            n = sum(c in "0123456789" for c in m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                "card": 13 <= n <= 19 and luhn(re.sub("[^0-9]", "", m[0])),
                "phone": 9 <= n <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def of_base(spans):
    return [s for s in spans if s[0] in BASE]


def test_random_texts_match_the_patterns():
    rng, finder = random.Random(5), PiiFinder()
    for _ in range(6000):
        text = "".join(rng.choice(["a", "@", ".", "1", "4", "25", "256", "+", "-", " ", "(", ")", "é", "::", "b.c", "4111111111111111", "1.2.3.4"]) for _ in range(rng.randrange(30)))
        assert of_base(finder(text)) == base(text), text


def test_planted_and_added():
    finder = PiiFinder()
    text = 'Ünd a.b@c.example.org, 10.0.0.255 300.1.1.1, 4111 1111 1111 1111 +1 (212) 555-0100 x [at] y [dot] com token = "bc0d31ba76f17e56642e" IBAN DE89 3704 0044 0532 0130 00 https://me:pw12@h.example/x'
    spans = finder(text)
    assert of_base(spans) == base(text)
    got = {k: text[a:b] for k, a, b in spans}
    assert got["masked_email"] == "x [at] y [dot] com" and got["secret"] == "bc0d31ba76f17e56642e"
    assert got["iban"] == "DE89 3704 0044 0532 0130 00" and got["login_url"] == "https://me:pw12@h.example"
    assert [k for k, _, _ in spans if k in BASE].count("ip") == 1
    assert "@" not in redact(text, spans) and "[CARD]" in redact(text, spans)


def test_rows(spark):
    big = "x" * 200_000 + " a@b.co " + "9" * 50_000
    rows = [(1, "a@b.co", "z"), (None, None, "z"), (3, "", "z"), (1, "a@b.co", "z"), (5, big, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_pii(docs).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got) == [(0, 0), (1, 1), (1, 1), (3, 0), (5, 1)]
    assert find_pii(docs.limit(0)).count() == 0
    clean = redact_documents(docs.withColumn("n_chars", docs.doc_id)).collect()
    assert sorted(str(r.text)[:8] for r in clean) == ["", "None", "[EMAIL]", "[EMAIL]", "xxxxxxxx"]
    assert {r.n_chars for r in clean if r.doc_id == 1} == {7}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_anchor_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in BASE]
        assert set(digest(want).split(",")) <= set(r.spans.split(","))


def test_long_values():
    finder = PiiFinder()
    token, user, word = "eyJ0" * 900, "u" * 300, "p1" * 400
    label = "d" * 70
    text = f"token: {token} and https://{user}:{word}@h.example/x and me [at] {label} [dot] " + "a." * 12 + "com"
    got = {k: text[a:b] for k, a, b in finder(text)}
    assert got["secret"] == token and got["login_url"] == f"https://{user}:{word}@h.example" and got["masked_email"].startswith("me [at] ddd") and got["masked_email"].endswith(".a.com")
    clean = redact(text, finder(text))
    assert "eyJ0" not in clean and "p1p1" not in clean and label not in clean
    # Cues inside a long run are read once.
    start = time.process_time()
    assert finder("token=" * 100_000) == [] and finder("://a:" * 100_000) == []
    assert time.process_time() - start < 20
