"""Small plain-Python versions of what the engine computes."""

from __future__ import annotations


def bwt(reads, chronological=False):
    rows = [(s[p:], r if chronological else s, r, s[p - 1] if p else "$") for r, s in enumerate(reads) for p in range(len(s) + 1)]
    return "".join(x[3] for x in sorted(rows))


def runs(text):
    out = []
    for c in text:
        if out and out[-1][0] == c:
            out[-1][1] += 1
        else:
            out.append([c, 1])
    return [tuple(x) for x in out]


def encode(text):
    out = []
    for c, n in runs(text):
        while True:
            out.append("$ACGNT".index(c) | (n & 31) << 3)
            n >>= 5
            if not n:
                break
    return out


def count(reads, kmer):
    """Occurrences on the circle of each read and its end."""
    if not kmer:
        return sum(len(s) + 1 for s in reads)
    n = 0
    for s in reads:
        circle = (s + "$") * (len(kmer) // (len(s) + 1) + 2)
        n += sum(circle.startswith(kmer, i) for i in range(len(s) + 1))
    return n
