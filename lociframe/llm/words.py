"""Whole texts as arrays of word numbers, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
BATCH_BYTES = 8 << 20


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in portions of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a batch: ``vocabulary[code[i]]`` is word i, ``doc[i]`` its row, ``count[r]`` the words of row r."""

    vocabulary: pa.Array
    code: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    @property
    def start(self) -> np.ndarray:
        """Place of each row's first word."""
        return np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if len(self.count) else np.zeros(0, np.int64)


def split_words(texts: pa.Array) -> Words:
    """Cut at spaces and the controls 9 to 13 only, as ``[^\\x20\\x09-\\x0D]+`` does."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    count = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    encoded = flat.dictionary_encode()
    code, vocabulary = encoded.indices.to_numpy(), encoded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
    if empty >= 0:  # white space at an end
        real = code != empty
        code, doc = code[real], doc[real]
        count = np.bincount(doc, minlength=len(texts))
    return Words(vocabulary, code, doc, count.astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(total: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``total`` by row."""
    return np.bincount(rows, weights=total, minlength=n).astype(np.int64)
