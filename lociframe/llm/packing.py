"""Operator 4: sum-of-squares online packing of tokenized documents into windows."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lociframe.llm.common import pick
from lociframe.llm.words import filled, portions, split_words

WINDOW = 2048
#: Id that ends every document.
END_ID = 1
#: Windows that may stand open in a task, which bounds its memory; beyond it the fullest is topped up from the emptiest.
MOST_OPEN = 4096
#: Words that are encoded as one string.
JOINED = 512
#: Letters, then ASCII punctuation without the apostrophe, after which the pre-tokenizer has forms of its own.
_PARTS = r"^(?P<letters>\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` BPE model with word ends, whose pre-tokenizer never joins what white
    space parts and cuts letters from punctuation.

    Each distinct word of a portion is encoded once. Words of letters, or letters and then ASCII punctuation, are
    the ids of their two parts one after the other; distinct letter parts are encoded many to a string and told
    apart by the ids that end a word. Other words, and strings with an unexpected number of word ends, are encoded
    one by one. The ids of a text are those of its words in order, which is what encoding it whole gives.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix") or None
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.joins = bool(suffix)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)] if words else []
        return np.fromiter((x for w in ids for x in w), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word of letters."""
        if not self.joins:
            return self._one_by_one(words)
        chunks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for chunk, e in zip(chunks, self.model.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(chunk) and at[-1] == len(ids) - 1:
                size = np.diff(at, prepend=-1)
            else:
                ids, size = self._one_by_one(chunk)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        words = split_words(texts)
        if not len(words.code):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        parts = pc.extract_regex(words.vocabulary, _PARTS)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        letters = pc.ascii_lower(pc.struct_field(parts, "letters").filter(pa.array(plain))).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(pa.array(plain)).dictionary_encode()
        tables = [self._letters(letters.dictionary.to_pylist()), self._one_by_one(marks.dictionary.to_pylist()), self._one_by_one(words.vocabulary.filter(pa.array(~plain)).to_pylist()), (np.zeros(0, np.uint32), np.zeros(1, np.int64))]
        flat, each = np.concatenate([t[0] for t in tables]).astype(np.uint32), np.concatenate([t[1] for t in tables])
        first = np.cumsum(each) - each
        n1, n2 = len(tables[0][1]), len(tables[0][1]) + len(tables[1][1])
        two = np.full((len(plain), 2), len(each) - 1)  # places in the tables of the parts of each distinct word; the last is nothing
        two[plain, 0] = letters.indices.to_numpy()
        two[plain, 1] = n1 + marks.indices.to_numpy()
        two[~plain, 0] = n2 + np.arange(int((~plain).sum()))
        stream = two[words.code].ravel()
        size = each[stream]
        at = np.repeat(first[stream] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return flat[at], np.bincount(words.doc, weights=size.reshape(-1, 2).sum(axis=1), minlength=len(texts)).astype(np.int64)


class SumOfSquares:
    """Packs items one by one into windows of ``size``.

    ``count[h]`` is the number of open windows filled up to level h. An item of length n goes where the sum of
    squares of these counts becomes least: into a new window (which adds one to level n) or into one of level h
    (which takes one from h and adds one to h + n, or to none if that fills it). Ties go to the fullest window.
    ``place`` costs one pass over the level array, whatever has been packed before.

    ``top_up`` closes a window without an item that fits: the fullest takes what it lacks from the emptiest, whose last
    piece is cut. It runs while more than ``most_open`` windows stand open, and by ``finish`` until none does. Windows
    whose fill is a power of two need no padding and stay; the last rest is cut at powers of two. ``placed`` and
    ``moved`` count the tokens that were placed by the rule and, of these, those that were moved again.
    """

    def __init__(self, emit: Callable[[list[tuple], int], None], size: int = WINDOW, most_open: int = MOST_OPEN) -> None:
        self.size, self.emit, self.most_open = size, emit, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.standing = self.placed = self.moved = 0

    def place(self, item: tuple, n: int) -> None:
        """``item``: anything; it comes back in ``emit`` as (item, from, to) with its bounds inside the item."""
        if n >= self.size:
            raise ValueError("cut whole windows off first")
        self.placed += n
        self._put((item, 0, n), n)
        while self.standing > self.most_open:
            self.top_up()

    def _put(self, piece: tuple, n: int) -> None:
        size, count = self.size, self.count
        # Change of the sum of squares by a move from level h to h + n, for h = 0 ... size - n.
        after = 2 * count[n : size + 1] + 1
        after[-1] = 0
        before = 1 - 2 * count[: size - n + 1]
        before[0] = 0
        cost = np.where(count[: size - n + 1] > 0, after + before, np.iinfo(np.int64).max)
        cost[0] = after[0]
        h = size - n - int(np.argmin(cost[::-1]))
        window = self._take(h) if h else []
        window.append(piece)
        if h + n == size:
            self.emit(window, size)
        else:
            self._stand(window, h + n)

    def _stand(self, window: list[tuple], level: int) -> None:
        self.open[level].append(window)
        self.count[level] += 1
        self.standing += 1

    def _take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.standing -= 1
        return self.open[level].pop()

    def top_up(self) -> None:
        """Moves tokens from the emptiest window to the fullest; either the one is full then or the other gone."""
        levels = np.flatnonzero(self.count)
        low, high = int(levels[0]), int(levels[-1])
        into, other = self._take(high), self._take(low)
        room = self.size - high
        self.moved += min(room, low)
        while room and other:
            item, a, b = other.pop()
            n = min(room, b - a)
            into.append((item, b - n, b))
            if b - n > a:
                other.append((item, a, b - n))
            room -= n
        if room:
            self._stand(into, self.size - room)
        else:
            self.emit(into, self.size)
        if other:
            self._stand(other, low - (self.size - high))

    def again(self) -> None:
        """Places the items of all open windows anew by the same rule, long ones first, so that short ones fill what is left."""
        items = [item for level in np.flatnonzero(self.count).tolist() for _ in range(int(self.count[level])) for item in self._take(level)]
        for item, a, b in sorted(items, key=lambda x: x[1] - x[2]):
            self._put((item, a, b), b - a)

    def finish(self) -> None:
        self.again()
        for bit in range(self.size.bit_length()):
            if 1 << bit < self.size:
                while self.count[1 << bit]:
                    self.emit(self._take(1 << bit), 1 << bit)
        while self.standing > 1:
            self.top_up()
        for level in np.flatnonzero(self.count).tolist():
            window, bits = self._take(level), [1 << b for b in range(level.bit_length()) if level >> b & 1]
            self.moved += level - bits[-1]
            while bits:
                part, room = [], bits.pop()
                size = room
                while room:
                    item, a, b = window.pop(0)
                    n = min(room, b - a)
                    part.append((item, a, a + n))
                    if a + n < b:
                        window.insert(0, (item, a + n, b))
                    room -= n
                self.emit(part, size)


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(key: str, definition, window: int, end_id: int, with_ids: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(definition.value)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rows: list[tuple] = []
        key_type = None

        def emit(pieces: list[tuple], _level: int) -> None:
            nonlocal sequence
            offset = 0
            for (doc, begin, ids, total), a, b in pieces:
                part = ids[a:b]
                rows.append((doc, begin + a, b - a, zlib.crc32(part.astype("<u4").tobytes()), total, sequence, offset, part.astype(np.int32)))
                offset += b - a
            sequence += 1

        packing = SumOfSquares(emit, window)

        def out() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(list(columns[7]), pa.list_(pa.int32())))
            rows = []
            return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for batch in portions(batches, "_text"):
            key_type = batch.column(key).type
            ids, sizes = tokenizer.encode(filled(batch.column("_text")))
            at = 0
            for doc, n in zip(batch.column(key).to_pylist(), sizes.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id))
                at += n
                whole = len(own) // window * window
                for begin in range(0, whole, window):
                    emit([((doc, begin, own[begin : begin + window], n + 1), 0, window)], window)
                if whole < len(own):
                    packing.place((doc, whole, own[whole:].copy(), n + 1), len(own) - whole)
            if rows:
                yield out()
        packing.finish()
        if rows:
            yield out()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text and pack it into sequences of at most ``window`` ids; one row a piece.

    Columns: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for. Every
    document ends with ``end_id``. Whole windows are cut off the front of long documents; what is left is placed
    by :class:`SumOfSquares`. A task packs its own rows as they stream by, without a shuffle; it holds a portion of
    texts, the level array and MOST_OPEN open windows. Sequences are full or have a power of two of ids, so
    none is padded: what no item fills is topped up by cutting the emptiest windows.

    Null and empty texts are documents of the end id alone. Null and repeated keys stay, each row a document of
    its own. An empty table gives an empty one; other columns are left out. Task numbers go into sequence_id:
    a task run again reads the same rows and gives the same sequences.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, encoding="utf-8") as f:  # a few MB whatever the data; on the driver, then broadcast
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = pick(docs, key, text).toDF(key, "_text")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_packer(key, definition, window, end_id, with_ids), f"`{key}` {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def padding(pieces: pa.Table, window: int = WINDOW) -> float:
    """Share of padded ids, for tests and reports: sequences are padded to ``window`` except at a power of two."""
    filled_to = pieces.group_by("sequence_id").aggregate([("length", "sum")])["length_sum"].to_numpy()
    padded = np.where(filled_to & (filled_to - 1) == 0, filled_to, window)
    return float((padded.sum() - filled_to.sum()) / max(1, padded.sum())) if len(filled_to) else 0.0


