"""Operator 2: near-duplicate embeddings by a random-projection tree forest with spill."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import drop_durable, durable, pick, share_of
from lociframe.llm.graph import connected_components
from lociframe.llm.words import mix

#: Cosine from which two vectors link.
LINK = 0.95
#: Trees; half the width of the band around a split whose vectors go down both sides, times the root of the dimension: unit
#: vectors that link lie up to 0.32 apart, on a random line up to about 0.32 over that root.
TREES, SPILL = 4, 0.2
#: Distinct vectors that a round's splits are drawn from, chosen by a hash: of all vectors first, then of each leaf that is still large. All vectors are routed and compared.
SAMPLE, LEAF_SAMPLE = 20_000, 4096
#: Vectors a leaf should hold, and sampled vectors that a split needs.
LEAF, LEAST_SAMPLED = 512, 16
#: Vectors of a leaf that are compared as one block; a larger leaf becomes all pairs of its blocks.
BLOCK = 1024
#: Vectors of a large leaf that a task routes at once.
ROUTED = 20_000
#: A vector that more than one row in HOT_SHARE holds is hot.
HOT_SHARE = 1000


@dataclass
class Tree:
    """Splits in arrays: node k sends x to left[k] if x @ normal[k] <= cut[k] + spill, to right[k] if >= cut[k] - spill. Leaves are negative."""

    normal: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)


def spill_of(x: np.ndarray) -> float:
    return SPILL / np.sqrt(x.shape[1])


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator, first_leaf: int, least: int = LEAST_SAMPLED) -> tuple[Tree, int]:
    """A tree over sampled unit vectors: each split lies across the line between two random members, at the median.

    Returns the tree and the number of its leaves; leaves are numbered from ``first_leaf`` and stored as -1 - number.
    """
    tree, leaves = Tree(), 0

    def grow(at: np.ndarray, level: int) -> int:
        nonlocal leaves
        for _ in range(8 if level < depth and len(at) >= 2 * least else 0):
            i, j = rng.choice(len(at), 2, replace=False)
            normal = x[at[i]] - x[at[j]]
            length = np.linalg.norm(normal)
            if length < 1e-9:
                continue
            normal = normal / length
            p = x[at] @ normal
            cut = float(np.median(p))
            left, right = at[p <= cut + spill_of(x)], at[p >= cut - spill_of(x)]
            if max(len(left), len(right)) > 0.85 * len(at):  # hardly parts them: near copies, or a poor draw
                continue
            k = len(tree.cut)
            tree.normal.append(normal)
            tree.cut.append(cut)
            tree.left.append(0)
            tree.right.append(0)
            tree.left[k] = grow(left, level + 1)
            tree.right[k] = grow(right, level + 1)
            return k
        leaves += 1
        return -first_leaf - leaves

    root = grow(np.arange(len(x)), 0)
    if root < 0:
        tree.left.append(root)
    return tree, leaves


def depth_of(total: int, leaf: int) -> int:
    """Levels of splits that bring ``total`` vectors to leaves of ``leaf``, with room for those that go down both sides."""
    return max(0, int(np.ceil(np.log2(max(1, total / leaf)) * 1.3)))


class Forest:
    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, seed: int = 11, leaf: int = LEAF, least: int = LEAST_SAMPLED) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if len(sample) else 0
        self.trees, self.leaves = [], 0
        for _ in range(trees if len(sample) else 0):
            tree, n = grow_tree(sample, depth_of(total, leaf), rng, self.leaves, least)
            self.trees.append(tree)
            self.leaves += n

    def route(self, x: np.ndarray) -> list[list[int]]:
        """The leaves, in ascending order, of each unit vector."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for tree in self.trees:
            todo = [(0 if tree.cut else tree.left[0], np.arange(len(x)))]
            while todo:
                k, at = todo.pop()
                if k < 0:
                    for i in at:
                        out[i].append(-1 - k)
                    continue
                p = x[at] @ tree.normal[k]
                todo.append((tree.left[k], at[p <= tree.cut[k] + spill_of(x)]))
                todo.append((tree.right[k], at[p >= tree.cut[k] - spill_of(x)]))
        return [sorted(c) for c in out]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(cells: list[list[int]]) -> pa.Array:
    return pa.array(cells, pa.list_(pa.int64()))


def _router(forest, kind: str) -> object:
    """Vectors as bytes of their own precision, and their leaves."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Forest = forest.value
        for batch in batches:
            lists = batch.column("vector")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(lists.value_lengths().to_numpy())
            vectors = np.split(values, ends[:-1]) if len(ends) else []
            cells: list[list[int]] = [[-len(v)] for v in vectors]  # vectors of another length than the forest's share a cell a length
            fit = [i for i, v in enumerate(vectors) if len(v) == plan.dim]
            if fit:
                for i, c in zip(fit, plan.route(unit(np.stack([vectors[i] for i in fit]).astype(float))), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), pa.array([v.tobytes() for v in vectors], pa.binary()), _lists(cells)],
                names=["node", "copies", "vector", "cells"],
            )

    return route


def _vectors(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float))


def _child(cell: int, leaf: int) -> int:
    """A number of its own for a leaf inside a leaf."""
    return int(mix(mix(np.array([cell], np.int64).view(np.uint64)) + np.uint64(leaf + 1))[0] >> np.uint64(1))


def _grower(kind: str, leaf: int, least: int) -> object:
    def grow(table: pa.Table) -> pa.Table:
        cell, total = table["cell"][0].as_py(), table["_n"][0].as_py()
        x = _vectors(table.sort_by("node")["vector"], kind)
        tree, _ = grow_tree(x, depth_of(total, leaf), np.random.default_rng(abs(cell)), 0, least)
        return pa.table({"cell": [cell], "tree": pa.array([pickle.dumps(tree) if tree.cut else None], pa.binary())})

    return grow


def _sender(kind: str) -> object:
    """Leaves inside one leaf for some of its vectors; a leaf without splits is final."""

    def send(placed: pa.Table, grown: pa.Table) -> pa.Table:
        cell, tree = placed["cell"][0].as_py() if len(placed) else 0, grown["tree"][0].as_py() if len(grown) else None
        node = placed["node"].to_numpy()
        if tree is None:
            return pa.table({"node": node, "cell": np.full(len(node), cell, np.int64), "final": np.ones(len(node), bool)})
        x = _vectors(placed["vector"], kind)
        plan = Forest(np.zeros((0, 0)), 0)
        plan.trees = [pickle.loads(tree)]
        leaves = plan.route(x)
        name = {k: _child(cell, k) for k in {k for c in leaves for k in c}}
        size = [len(c) for c in leaves]
        return pa.table({"node": np.repeat(node, size), "cell": np.array([name[k] for c in leaves for k in c], np.int64), "final": np.zeros(sum(size), bool)})

    return send


def split_further(routed: DataFrame, kind: str, leaf: int, least: int, sample: int) -> DataFrame:
    """``routed`` (node, copies, vector, cells) with leaves split again until they hold about ``leaf`` vectors or can't be parted.

    Each round draws about ``sample`` vectors of every leaf that is still large, by a hash, grows a tree over each, and
    sends all its vectors down that tree, ROUTED a task. Near copies, which no split parts, stay one leaf.
    """
    placed = routed.select("node", F.explode("cells").alias("cell"), F.lit(False).alias("final"))
    again = False
    while True:
        sizes = placed.where("NOT final AND cell >= 0").groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * leaf)
        sizes = durable(sizes, "large-leaves")
        if sizes.isEmpty():
            break
        large = placed.where("NOT final").join(sizes, "cell").join(routed.select("node", "vector"), "node")
        large = durable(large.select("cell", "node", "vector", "_n", F.pmod(F.xxhash64("node", F.lit("salt")), F.ceil(F.col("_n") / ROUTED)).cast("int").alias("_salt")), "large")
        grown = large.where(share_of(F.xxhash64("node", "cell"), F.lit(float(sample)) / F.col("_n"))).groupBy("cell").applyInArrow(_grower(kind, leaf, least), "cell bigint, tree binary")
        grown = durable(grown.join(sizes, "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / ROUTED) - 1).cast("int"))).alias("_salt")), "trees")
        sent = large.groupBy("cell", "_salt").cogroup(grown.groupBy("cell", "_salt")).applyInArrow(_sender(kind), "node bigint, cell bigint, final boolean")
        before, placed = placed, durable(placed.join(sizes, "cell", "left_anti").select("node", "cell", "final").union(sent), "placed")
        for done in (sizes, large, grown, *([before] if again else [])):
            drop_durable(done)
        again = True
    if not again:
        return routed
    cells = placed.groupBy("node").agg(F.array_sort(F.collect_set("cell")).alias("cells"))  # a few a tree
    out = durable(routed.drop("cells").join(cells, "node"), "routed")
    drop_durable(placed)
    return out


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, from the smallest by other links and further links."""
    while True:
        new = label.copy()
        a_root, b_root = label[a], label[b]
        low = np.minimum(a_root, b_root)
        np.minimum.at(new, a_root, low)
        np.minimum.at(new, b_root, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _memberships(cells: pa.ChunkedArray, before: int) -> np.ndarray:
    """Rows x leaves, for the leaves that come before one: whether the row lies in the leaf."""
    lists = cells.combine_chunks()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    earlier = flat < before
    leaf, number = np.unique(flat[earlier], return_inverse=True)
    out = np.zeros((len(lists), len(leaf)), np.float32)
    out[row[earlier], number] = 1
    return out


def new_links(x: np.ndarray, member: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs of rows in ``left`` x ``right`` that link and share no earlier leaf.

    Where most of both sides lie in one earlier leaf, their pairs have been met there: only the others are multiplied.
    """
    if not len(left) or not len(right):
        return
    if member.shape[1] and len(left) * len(right) > 1 << 12:
        both = member[left].sum(axis=0) * member[right].sum(axis=0)
        k = int(both.argmax())
        if both[k] > 0.3 * len(left) * len(right):
            l_in, r_in = member[left, k] > 0, member[right, k] > 0
            yield from new_links(x, member, left[~l_in], right)
            yield from new_links(x, member, left[l_in], right[~r_in])
            return
    i, j = np.nonzero(x[left] @ x[right].T >= LINK)
    i, j = left[i], right[j]
    some = i != j
    i, j = i[some], j[some]
    if member.shape[1] and len(i):
        bits = np.packbits(member.astype(bool), axis=1)
        fresh = np.concatenate([~(bits[i[a : a + (1 << 18)]] & bits[j[a : a + (1 << 18)]]).any(axis=1) for a in range(0, len(i), 1 << 18)])
        i, j = i[fresh], j[fresh]
    if len(i):
        yield i, j


def _comparer(kind: str) -> object:
    def compare(table: pa.Table) -> pa.Table:
        """Links inside a block, or between two blocks, of one leaf.

        Gives one row for each vector that links here by pairs whose first common leaf this is, so that sums over all
        leaves count each pair once: with how many vectors, and the root of its component here.
        """
        cell, one, two = (table[c][0].as_py() for c in ("cell", "i", "j"))
        node, copies, block = table["node"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        x, member = _vectors(table["vector"], kind), _memberships(table["cells"], cell)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in new_links(x, member, np.flatnonzero(block == one), np.flatnonzero(block == two)):
            links += np.bincount(i, weights=copies[j], minlength=len(node)).astype(np.int64)
            if one != two:
                links += np.bincount(j, weights=copies[i], minlength=len(node)).astype(np.int64)
            label = _roots(label, i, j)
        used = np.flatnonzero(links)
        return pa.table({"node": node[used], "links": links[used], "root": node[label[used]]})

    return compare


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE) -> DataFrame:
    """One row a row of ``vectors``: ``key``, n_links, component_id, kept.

    n_links counts the other rows at a cosine of LINK or more (copies count one by one), component_id is the
    smallest key reachable by links, kept marks rows that have it. Vectors that are null, empty or zero, or hold
    null or non-finite components, and vectors of different lengths, link with nothing. A null key is a vector
    like any other, never a component's key while the component has another; alone it has a null component and
    is kept. Repeated keys are rows of their own and are all kept where theirs is the smallest. An empty table gives an
    empty one; other columns are left out.

    Equal vectors are one node with a number of copies. Nodes go down all trees; splits are drawn from a sample of all
    vectors, then from samples of the leaves that are still large (:func:`split_further`). Leaves are compared block
    by block, so no leaf need fit a task, and a leaf gives one row a node, not one a pair. Work grows with the
    vectors and the depth of the trees, but for near copies that no split parts: n of them have up to n * n links to count.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = pick(vectors, key, vector).toDF("_id", "_vector").select("_id", F.col("_vector").cast(f"array<{'float' if element == 'float' else 'double'}>").alias("_vector"))
    good = (F.size("_vector") > 0) & F.forall("_vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("_vector", lambda c: c != 0)
    rows = rows.withColumn("_vector", F.when(good, F.transform("_vector", lambda c: c + F.lit(0).cast(element if element == "float" else "double"))))  # -0.0 is 0.0
    held = rows.where("_vector IS NOT NULL").select("_id", "_vector", F.xxhash64("_vector").alias("_h1"), F.hash("_vector", F.lit(1)).alias("_h2"))
    nodes = held.groupBy("_h1", "_h2").agg(F.count("*").alias("copies"), F.min("_id").alias("key"), F.first("_vector").alias("vector"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = nodes.count()
    drawn = nodes.where(share_of(F.xxhash64("_h1", F.lit("sample")), sample / max(1, total))).select("_h1", "vector").toArrow().sort_by("_h1")["vector"].to_pylist()
    lengths = [len(v) for v in drawn]
    dim = max(set(lengths), key=lengths.count) if lengths else 0
    x = unit(np.array([v for v in drawn if len(v) == dim], float)) if dim else np.zeros((0, 0))
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(x, total, trees, leaf=leaf))
    routed = durable(nodes.select("node", "copies", "vector").mapInArrow(_router(forest, kind), "node bigint, copies bigint, vector binary, cells array<bigint>"), "routed")
    routed = split_further(routed, kind, leaf, LEAST_SAMPLED, leaf_sample)
    placed = routed.withColumn("cell", F.explode("cells"))
    sizes = durable(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1"), "leaf-sizes")
    hashed_block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
    placed = placed.join(sizes, "cell", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("block", hashed_block(F.col("_blocks")))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    met = placed.select("cell", "i", "j", "block", "node", "copies", "vector", "cells").groupBy("cell", "i", "j").applyInArrow(_comparer(kind), "node bigint, links bigint, root bigint")
    met = durable(met, "vector-links")
    counts = met.groupBy("node").agg(F.sum("links").alias("_links"))
    labels = connected_components(met.where("node <> root"), "node", "root")
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("key").alias("_component"))
    per_node = durable(named.join(smallest, "component").join(counts, "node", "left").select("_h1", "_h2", "copies", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), "_component"), "per-node")
    often = F.broadcast(per_node.where(F.col("copies") * HOT_SHARE > held.count()).drop("copies"))  # HOT_SHARE of them at most
    some = held.select("_id", "_h1", "_h2")
    found = some.join(often, ["_h1", "_h2"]).unionByName(some.join(often, ["_h1", "_h2"], "left_anti").join(per_node.drop("copies"), ["_h1", "_h2"]))
    out = found.select("_id", "_n", "_component").union(rows.where("_vector IS NULL").select("_id", F.lit(0).cast("long"), F.col("_id")))
    out = out.select(F.col("_id").alias(key), F.col("_n").cast("long").alias("n_links"), F.coalesce("_component", "_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


def op2_projection_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
