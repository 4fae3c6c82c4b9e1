"""Operator 7: near-duplicate texts by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import drop_durable, durable, free_name, partitions, pick
from lociframe.llm.graph import connected_components
from lociframe.llm.words import filled, mix, portions, split_words

SHINGLE = 5
#: Links: 100 * intersection >= LINK * union.
LINK = 85
#: Trees of the forest and values of a signature order.
TREES, DEPTH = 16, 8
#: Share of linking pairs that may have no common region in any tree; it fixes the least depth, see :func:`least_depth`.
MISS = 2e-5
#: Neighbours on either side of a node in a sorted order that are its candidates, and those that are so in a crowded region.
WINDOW, NEAR = 16, 1
#: Hashed counters that order shingles by how many crowded sets hold them.
SLOTS = 1 << 21
#: Nodes of a posting list that one task holds at once, and parts that hot keys of a join are dealt into.
SLAB, SALTS = 512, 16
#: 64-bit words of a set's parity bits.
PARITY = 8
#: A set that more than one row in HOT_SHARE has is hot.
HOT_SHARE = 1000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def least_depth(similarity: int) -> int:
    """The greatest prefix length that linking pairs share in at least one tree but for a share of MISS."""
    fits = [d for d in range(1, DEPTH + 1) if (1 - (similarity / 100) ** d) ** TREES <= MISS]
    return max(fits, default=1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (no nulls), end to end, and how many each has."""
    n = len(texts)
    words = split_words(texts)
    if not len(words.code):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    lower = pc.ascii_lower(words.vocabulary).to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in lower), np.uint64, len(lower))[words.code]
    doc = words.doc
    start = np.flatnonzero(doc[: len(doc) - SHINGLE + 1] == doc[SHINGLE - 1 :]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    parts, owners = [], []
    for length, at in [(SHINGLE, start)] + [(k, words.start[words.count == k]) for k in range(1, SHINGLE)]:
        h = np.full(len(at), np.uint64(length))
        for k in range(length):
            h = h * _PRIME + hashed[at + k]
        parts.append(mix(h))
        owners.append(doc[at])
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n).astype(np.int64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * _PRIME)
    return drawn[::2] | np.uint64(1), drawn[1::2]


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima (uint32) of each non-empty set, a row a set."""
    counts = counts[counts > 0]
    start = np.cumsum(counts) - counts
    a, b = _multipliers()
    out = np.empty((len(counts), len(a)), np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((hashes * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "_text"):
        hashes, counts = shingle_sets(filled(batch.column("_text")))
        some = counts > 0
        start = (np.cumsum(counts) - counts)[some]
        k1, k2, sig = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64), [None] * len(counts)
        if some.any():
            k1[some] = np.add.reduceat(mix(hashes), start)
            k2[some] = np.bitwise_xor.reduceat(mix(hashes + _PRIME), start)
            for i, row in zip(np.flatnonzero(some), signatures(hashes, counts).astype(">u4"), strict=True):
                sig[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_text_hash"), pa.array(counts), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())],
            names=["_id", "_text_hash", "n_shingles", "k1", "k2", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "_text"):
        hashes, counts = shingle_sets(filled(batch.column("_text")))
        ends = np.cumsum(counts)
        sets = [hashes[e - c : e].astype("<u8").tobytes() for e, c in zip(ends, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _confirm(similarity: int) -> object:
    """Keep the pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y").mapInArrow(_confirm(similarity), "a bigint, b bigint")


#: Kinds of rows that a scan of a sorted order gives: candidates, nodes of crowded regions, rows at the ends of a part.
PAIR, CROWDED, BORDER = 0, 1, 2


def _runs(tree: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Number of the run of rows whose tree and prefix are those of the row before."""
    same = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1]).all(axis=1)
    return np.concatenate([[0], np.cumsum(~same)]) if len(tree) else np.zeros(0, np.int64)


def scan_order(tree: np.ndarray, sig: np.ndarray, node: np.ndarray, depth: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a, b) and crowded nodes that the rows first ... last - 1 of a stretch of the sorted orders give with rows after them.

    A run of rows that share ``depth`` values is a region. A row is crowded if its region reaches WINDOW rows away;
    two crowded rows are candidates only if they are NEAR: neighbours with the longest common prefix.
    """
    n, run = len(tree), _runs(tree, sig[:, :depth])
    reach = np.zeros(n, bool)
    if n > WINDOW:
        far = run[WINDOW:] == run[:-WINDOW]
        reach[:-WINDOW] |= far
        reach[WINDOW:] |= far
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, WINDOW + 1):
        i = np.arange(first, min(last, n - k))
        i = i[(run[i] == run[i + k]) & ((k <= NEAR) | ~(reach[i] & reach[i + k]))]
        if not len(i):
            if k == 1:
                break
            continue
        a.append(node[i])
        b.append(node[i + k])
    return np.concatenate(a), np.concatenate(b), node[first:last][reach[first:last]]


def _scan(depth: int) -> object:
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("sig", pa.binary())])

    def rows(kind: int, a: np.ndarray, b: np.ndarray, tree: np.ndarray | None = None, sig: list | None = None) -> pa.RecordBatch:
        none = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(none, kind, np.int32)), pa.array(a), pa.array(b), pa.array(tree) if tree is not None else pa.nulls(none, pa.int32()), pa.array(sig, pa.binary()) if sig is not None else pa.nulls(none, pa.binary())], schema=schema
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tree, sig, node = np.zeros(0, np.int32), np.zeros((0, DEPTH), ">u4"), np.zeros(0, np.int64)
        at, seen, border = 0, 0, 0  # rows of the stretch that are done with; rows read; rows given as the part's front

        def given(to: int) -> Iterator[pa.RecordBatch]:
            a, b, crowded = scan_order(tree, sig, node, depth, at, to)
            if len(a):
                yield rows(PAIR, np.minimum(a, b), np.maximum(a, b))
            if len(crowded):
                yield rows(CROWDED, crowded, crowded)

        def ends(i: int, j: int) -> pa.RecordBatch:
            return rows(BORDER, node[i:j], np.full(j - i, part, np.int64), tree[i:j], [v.tobytes() for v in sig[i:j]])

        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(-1, DEPTH)
            tree, sig, node = np.concatenate([tree, batch.column("tree").to_numpy()]), np.concatenate([sig, more]), np.concatenate([node, batch.column("node").to_numpy()])
            seen += batch.num_rows
            if border < WINDOW:
                to = min(WINDOW, seen)
                yield ends(border, to)
                border = to
            to = len(tree) - 2 * WINDOW
            if to > at:
                yield from given(to)
                cut = max(0, to - WINDOW)
                tree, sig, node, at = tree[cut:], sig[cut:], node[cut:], to - cut
        yield from given(len(tree))
        back = min(WINDOW, seen - border)
        if back > 0:
            yield ends(len(tree) - back, len(tree))

    return scan


def _across(border: list[tuple], depth: int) -> tuple[list[tuple], list[tuple]]:
    """Candidates and crowded nodes that lie on both sides of a cut between parts; ``border``: (tree, sig, node, part)."""
    border = sorted(border)
    pairs, crowded = [], []
    for i, (tree, sig, node, part) in enumerate(border):
        for k in range(1, min(WINDOW, len(border) - 1 - i) + 1):
            t, s, other, p = border[i + k]
            if t != tree or s[: 4 * depth] != sig[: 4 * depth]:
                break
            if p != part:
                pairs.append((min(node, other), max(node, other)))
                if k == WINDOW:
                    crowded += [(node,), (other,)]
    return pairs, crowded


def forest(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), a < b, and crowded nodes (node) of the sorted orders of ``nodes`` (node, sig).

    Each of TREES orders sorts the nodes by its own DEPTH values of their signatures. The orders lie end to end in
    one range-partitioned sort, which cuts any region between tasks, so that no key is hot. A node's candidates
    are its neighbours up to WINDOW places away with which it shares at least ``depth`` values: in a small region
    these are all its members, in a large one those with the longest common prefixes, as deep as the region is dense.
    Regions that reach further make their nodes crowded. Rows at the ends of parts, 2 * WINDOW a part,
    are matched on the driver.
    """
    spark = nodes.sparkSession
    rows = nodes.select("node", F.posexplode(F.array(*[F.expr(f"substring(sig, {1 + t * 4 * DEPTH}, {4 * DEPTH})") for t in range(TREES)])).alias("tree", "sig"))
    rows = rows.repartitionByRange(partitions(spark), "tree", "sig", "node").sortWithinPartitions("tree", "sig", "node").select("tree", "sig", "node")
    found = durable(rows.mapInArrow(_scan(depth), "kind int, a bigint, b bigint, tree int, sig binary"), "forest")
    border = [(r["tree"], r["sig"], r["a"], r["b"]) for r in found.where(F.col("kind") == BORDER).select("tree", "sig", "a", "b").toArrow().to_pylist()]
    pairs, crowded = _across(border, depth)
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").union(spark.createDataFrame(pairs, "a bigint, b bigint")).where("a <> b").distinct()
    crowded = found.where(F.col("kind") == CROWDED).select(F.col("a").alias("node")).union(spark.createDataFrame(crowded, "node bigint")).distinct()
    return pairs, crowded


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for v in batch.column("shingles"):
            np.add.at(total, np.frombuffer(v.as_buffer(), "<u8") % np.uint64(SLOTS), 1)
    slot = np.flatnonzero(total)
    for i in range(0, len(slot), 1 << 16):
        part = slot[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])


def prefix_lengths(n: int, similarity: int) -> tuple[int, int]:
    """How many of a set's ``n`` shingles, in one order for all sets, must show one of any linking set: (of sets up to its size, of sets at least as large)."""
    return n - -(-similarity * n // 100) + 1, n - -(-2 * similarity * n // (100 + similarity)) + 1


_BITS = [f"z{i}" for i in range(PARITY)]


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """PARITY words of 64 bits: whether an odd number of shingles falls to each bit. Two sets' words differ in no more bits than the sets have shingles apart."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(counts, similarity: int) -> object:
    """Postings (token, node, c, n, at, z0 ...): the rarest shingles of each set, as many as a link needs to show in, and its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            token, at, size, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [], [np.zeros((0, PARITY), np.int64)]
            for v in batch.column("shingles"):
                h = np.frombuffer(v.as_buffer(), "<u8")
                weight = often[h % np.uint64(SLOTS)]
                order = np.lexsort((h, weight))[: prefix_lengths(len(h), similarity)[0]]
                place = np.flatnonzero(weight[order] > 1).astype(np.int32)  # the others are in this set alone
                token.append(h[order[place]])
                at.append(place)
                size.append(len(place))
                bits.append(np.tile(parity_bits(h), (len(place), 1)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(token).view(np.int64)), *(batch.column(c).take(row) for c in ("node", "c", "n")), pa.array(np.concatenate(at)), *map(pa.array, np.concatenate(bits).T.copy())],
                names=["token", "node", "c", "n", "at", *_BITS],
            )

    return run


def crowded_candidates(sets: DataFrame, labels: DataFrame, crowded: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b), a < b, of crowded nodes in different components that may link: every one that does is among them.

    An exact prefix filter, whatever the sizes of regions. Shingles are put in one order, rare ones first. Two sets
    that link share one among the first few of each, at places that leave enough shingles behind them to share.
    Shingles that many sets share come last and are in no prefix of sets which differ by more than a link allows,
    so what is compared grows with the sets rather than with their square. Of the pairs that meet, parity bits drop
    those that are too far apart to link. Members of a posting list meet those outside its largest component, SLAB
    at a time.
    """
    spark = sets.sparkSession
    pool = sets.join(crowded, "node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("c"), (F.length("shingles") / 8).cast("int").alias("n"), "shingles")
    counts = np.ones(SLOTS, np.int64)
    met = pool.select("shingles").mapInArrow(_tally, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # SLOTS rows at most
    counts[met["slot"].to_numpy()] = met["n"].to_numpy()
    shared = spark.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))
    posted = durable(pool.mapInArrow(_prefixes(shared, similarity), "token bigint, node bigint, c bigint, n int, at int, " + ", ".join(f"{z} bigint" for z in _BITS)), "postings")
    sizes = posted.groupBy("token", "c").agg(F.count("*").alias("_m")).groupBy("token").agg(F.max(F.struct("_m", "c")).alias("_best"), F.sum("_m").alias("_all"), F.count("*").alias("_parts"))
    open_ = sizes.where("_parts > 1").select("token", F.col("_best.c").alias("_main"), F.ceil(F.col("_all") / SLAB).cast("int").alias("_slabs"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = durable(posted.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int")).join(open_, ["token", "_salt"]).drop("_salt"), "open-postings")
    names = ("node", "c", "n", "at", *_BITS)
    held = rows.select("token", F.pmod(F.xxhash64("node"), F.col("_slabs")).cast("int").alias("_slab"), *[F.col(c).alias(f"y_{c}") for c in names])
    seek = rows.where("c <> _main").select("token", F.explode(F.sequence(F.lit(0), F.col("_slabs") - 1)).alias("_slab"), *[F.col(c).alias(f"x_{c}") for c in names])
    least = f"y_n - int(ceil(2 * {similarity} * y_n / {100 + similarity}.0)) + 1"
    fits = " AND ".join(
        [
            "x_c <> y_c",
            f"100 * least(x_n, y_n) >= {similarity} * greatest(x_n, y_n)",
            f"{100 + similarity} * least(x_n - x_at, y_n - y_at) >= {similarity} * (x_n + y_n)",
            # Shingles apart, at least as many as bits that differ: union less intersection.
            f"{100 + similarity} * (" + " + ".join(f"bit_count(x_{z} ^ y_{z})" for z in _BITS) + f") <= {100 - similarity} * (x_n + y_n)",
            f"((y_n <= x_n AND y_at < {least}) OR (x_n <= y_n AND x_at < {least.replace('y_n', 'x_n')}))",
        ]
    )
    pairs = seek.join(held, ["token", "_slab"]).where(fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    out = durable(pairs, "crowded-pairs")
    for done in (posted, rows):
        drop_durable(done)
    return out


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.lit("text"))


def _same_key(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes that hold different texts of one repeated key."""
    digest = F.struct("k1", "k2", "n_shingles")
    several = full.groupBy("_id").agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b").select("_id")
    held = full.join(several, "_id", "left_semi").select("_id", "k1", "k2", "n_shingles").distinct().join(nodes, ["k1", "k2", "n_shingles"]).select("_id", "node")
    first = held.groupBy("_id").agg(F.min("node").alias("a"))
    return held.join(first, "_id").where("a <> node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = LINK) -> DataFrame:
    """One row a row of ``docs``: ``key``, n_shingles, component_id, kept.

    Texts link where 100 * intersection >= ``similarity`` * union. component_id is the smallest key reachable by
    links, kept marks its row. Texts with equal shingle sets are one node of the forest and copies cost one sketch
    each; links between different sets are confirmed on the full sets. Null and empty texts, and texts
    without words, have no shingles and link with nothing. Rows with one key are one document. A row with a null
    key takes its component from the rows with equal sets and is kept where that is null. An empty table gives an
    empty one; other columns are left out. Keys are integers.

    Candidates are neighbours in the sorted orders of the forest (:func:`forest`). Nodes of crowded regions, whose
    neighbourhoods are cut, meet again by :func:`crowded_candidates`, which misses no link. So the only links that can
    be lost are those of pairs that share no region in any tree, MISS of them at the threshold. Work grows with
    the rows, and with the links that a dense group has outside its largest component.
    """
    rows = pick(docs, key, text).toDF("_id", "_text").select(F.col("_id").cast("long").alias("_id"), text_hash(F.col("_text")).alias("_text_hash"), "_text")
    sketch = durable(rows.mapInArrow(_sketch, "_id bigint, _text_hash bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"), "sketches")
    full = sketch.where("n_shingles > 0 AND _id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("_id", "_text_hash", "sig")).alias("_first"), F.count("*").alias("copies"))
    nodes = durable(classes.select("k1", "k2", "n_shingles", "copies", F.monotonically_increasing_id().alias("node"), F.col("_first._id").alias("_first_id"), F.col("_first._text_hash").alias("_text_hash"), F.col("_first.sig").alias("sig")), "nodes")

    pairs, crowded = forest(nodes, least_depth(similarity))
    pairs, crowded = durable(pairs, "pairs"), durable(crowded, "crowded")
    # Sets of the texts that are a candidate: found in the input again by key and hash.
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("_first_id").alias("_id"), "_text_hash")
    again = rows.where("_id IS NOT NULL").join(wanted, ["_id", "_text_hash"])
    sets = durable(again.select("node", "_text").mapInArrow(_sets, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    links = durable(_confirmed(pairs, sets, similarity).union(_same_key(full, nodes)), "links")
    labels = connected_components(links)
    if not crowded.isEmpty():
        apart = crowded_candidates(sets, labels, crowded, similarity)
        more = durable(_confirmed(apart.join(pairs, ["a", "b"], "left_anti"), sets, similarity), "links")
        if not more.isEmpty():
            labels = connected_components(links.union(more))
        drop_durable(apart)
    for done in (pairs, crowded, sets, links):
        drop_durable(done)
    linked = nodes.join(labels, "node").select("node", "component", "_first_id")
    least = linked.groupBy("component").agg(F.min("_first_id").alias("_least"))
    least = linked.join(least, "component").select("node", "_least")
    named = durable(nodes.join(least, "node", "left").select("k1", "k2", "n_shingles", "copies", F.coalesce("_least", "_first_id").alias("_component")), "classes")
    # Sets that a large share of the rows holds are named by broadcast: HOT_SHARE of them at most.
    digest = ["k1", "k2", "n_shingles"]
    often = F.broadcast(named.where(F.col("copies") * HOT_SHARE > sketch.count()).select(*digest, "_component"))
    some = sketch.where("n_shingles > 0").select("_id", *digest)
    found = some.join(often, digest).unionByName(some.join(often, digest, "left_anti").join(named.drop("copies"), digest, "left"))
    out = found.select("_id", "n_shingles", F.coalesce("_component", "_id").alias("_of")).union(sketch.where("n_shingles = 0").select("_id", "n_shingles", "_id"))
    out = out.toDF(key, "n_shingles", "component_id")
    return out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = LINK) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of near-duplicates: the smallest key stays.

    Rows are told apart by numbers of their own, so repeated rows and rows with null keys are one group like any
    other copies, and a null key stays only where a group has no other. Null and empty texts, and those without words,
    are groups of their own and stay. An empty table gives an empty one; columns may have any names. The table is
    written once with its numbers; rows of a large group are dealt over SALTS parts where they meet its first row.
    """
    row = free_name(docs, "_row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, row, text, similarity).select(F.col(f"`{row}`").alias("_at"), F.col("component_id").alias("_group"))
    keyed = rows.select(F.col(f"`{row}`").alias("_at"), F.col(f"`{key}`").alias("_key"))
    named = durable(groups.join(keyed, "_at").withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int")), "groups")
    order = F.struct(F.col("_key").isNull().alias("_none"), "_key", "_at")
    parts = named.groupBy("_group", "_salt").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    first = parts.groupBy("_group").agg(F.min("_first")["_at"].alias("_stays"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts")).where("_n > 1")
    first = first.select("_group", "_stays", F.explode("_salts").alias("_salt"))
    gone = named.join(first, ["_group", "_salt"]).where("_at <> _stays").select(F.col("_at").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op7_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
