"""Nearest neighbours by a forest of random-projection trees.

The forest is grown on a bounded sample: each node splits its points at their
median along the direction between two of them, so trees follow clusters. All
vectors are then indexed: every row goes down every tree to one leaf. A query
searches all trees through one priority queue of branches, nearest first: a
branch's distance is the sum of the squared distances to the splits that the
query crosses on the way to it. Leaf candidates are reranked exactly, in double
precision, by inner product.

A few thousand sample vectors give each query a first floor: its ``k`` best
among them bound the score that a result must reach, and so the distance up to
which branches are worth opening. Then come two passes over the leaves. The
first opens the leaves that hold the nearest ``least`` entries, which raises
the floor to nearly its final height; the second goes on from there, up to
``budget`` entries, and stops where no branch can reach the floor. Both numbers
hold for a query, whatever the size of the table (entries are counted in each
tree, with repeats). After each step a query keeps its ``k`` best, and only
entries above its floor, at most ``k + 1`` of a shard, leave a task. An index
that is no larger than the sample of the first step is searched whole, without
leaves.

So queries inside clusters stop early, and the budget bounds the others. Where
vectors have no near neighbours at all, exactness needs a share of the table
that no forest can lower, and recall falls as the table outgrows the budget:
set it to about half the table or accept that.

The trees are built on directions, and vectors of different lengths get one
more component that makes all lengths equal (so that the nearest direction has
the largest inner product).

Equal vectors are one entry, which carries the ids that any query could need
from it: the ``k + 1`` smallest. A leaf of hot vectors hence stays small.
Neighbouring leaves form shards of bounded size (a larger leaf is several).
Queries meet candidates shard by shard, in blocks of queries; vectors never
meet vectors outside the leaves that a query opens.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do rows without an id. Rows that
share an id and a vector count once. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import column_of, mix64, ragged, written


@dataclass
class Forest:
    """Trees in flat arrays; a child below 0 is leaf ``-1 - child``. ``leaf_of`` numbers leaves over all trees."""

    normals: np.ndarray  # of inner nodes, float32
    cuts: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int
    sizes: np.ndarray  # vectors in each leaf, once the index is built

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                right = np.einsum("ij,ij->i", x[live], self.normals[at]) > self.cuts[at]
                node[live] = self.children[at, right.astype(np.int64)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, skip: int, most: int, reach: float) -> list[int]:
        """Leaves in the order in which one queue over all trees opens them.

        ``margins`` are the query's signed distances to the split of every
        inner node. The search ends when the leaves hold ``most`` entries or
        the next branch is farther than ``reach`` (squared). Leaves before the
        first ``skip`` entries have been searched and are left out.
        """
        queue = [(0.0, int(r)) for r in self.roots]
        heapq.heapify(queue)
        found, out = 0, []
        children, sizes = self.children, self.sizes
        while queue and found < most:
            bound, node = heapq.heappop(queue)
            if bound > reach:
                break
            while node >= 0:
                m = float(margins[node])
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (bound + m * m, int(children[node, far])))
                node = int(children[node, near])
            if found >= skip:
                out.append(-1 - node)
            found += int(sizes[-1 - node])
        return out


@dataclass
class Shards:
    """Neighbouring leaves together, up to ``size`` entries; a larger leaf is ``parts`` shards from ``first``."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, size: int) -> Shards:
        first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // size))
        now, held = 0, 0
        for leaf, n in enumerate(sizes.tolist()):
            if held and held + n > size:
                now, held = now + 1, 0
            first[leaf] = now
            held += n
            if parts[leaf] > 1:
                now, held = now + int(parts[leaf]), 0
        return cls(first, parts)


def grow_forest(sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """``trees`` trees whose leaves hold at most ``leaf`` points of ``sample``, where points differ."""
    rng = np.random.default_rng(seed)
    normals, cuts, children, roots, leaves = [], [], [], [], 0

    for _ in range(trees):
        todo = [(np.arange(len(sample)), None)]
        while todo:
            rows, place = todo.pop()
            node, split = None, None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(rows, 2, replace=False)].astype(float)
                    normal = a - b
                    length = np.linalg.norm(normal)
                    if length < 1e-9:
                        continue
                    normal = (normal / length).astype(np.float32)
                    along = sample[rows] @ normal
                    cut = np.float32(np.median(along))
                    right = along > cut
                    if right.any():
                        split = rows[~right], rows[right]
                        break
            if split is None:
                node, leaves = -1 - leaves, leaves + 1
            else:
                node = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(split[0], (node, 0)), (split[1], (node, 1))]
            if place is None:
                roots.append(node)
            else:
                children[place[0]][place[1]] = node
    width = sample.shape[1] if sample.ndim == 2 else 1
    return Forest(np.array(normals, np.float32).reshape(-1, width), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64), leaves, np.zeros(leaves, np.int64))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def directions(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component that brings them all to the length ``longest``."""
    gap = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.concatenate([x, gap[:, None]], 1).astype(np.float32) / np.float32(longest)


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``vector`` (as it is if of floats, else of doubles) of the rows that take part."""
    v = F.col(vector_column)
    if rows.schema[vector_column].dataType != ArrayType(FloatType(), True):
        v = v.cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _entries(clean: DataFrame, k: int) -> DataFrame:
    """``key, vector, ids, entry``: each distinct vector with its ``k + 1`` smallest ids, the first of which names it."""
    # first within parts of a hot vector, then among what is left
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    keyed = clean.select(F.xxhash64("vector").alias("key"), "vector", "vec_id").withColumn("part", part).distinct()
    for by in (["key", "vector", "part"], ["key", "vector"]):
        keyed = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return keyed.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.expr("ids[0]"))


FOUND = "query_id long, vec_id long, score double"


def _expand(asker: np.ndarray, row: np.ndarray, col: np.ndarray, scores: np.ndarray, ids: pa.ListArray) -> pa.RecordBatch:
    """One row of ``FOUND`` for each id of the entries ``col`` that the queries ``row`` found."""
    flat, first = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(first)[col]
    index = ragged((first[:-1] - first[0])[col], sizes)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(asker[row], sizes)), pa.array(flat[index]), pa.array(np.repeat(scores, sizes))], names=["query_id", "vec_id", "score"])


def _best(q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of entries that reach the floor, and the ``k + 1`` best of these with all ties."""
    scores = q @ x.T
    if inside is not None:
        scores[~inside] = -np.inf
    low = floor
    if len(x) > k + 1:
        low = np.maximum(low, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
    low = np.where(np.isfinite(low), low - 1e-9 * np.maximum(1, np.abs(low)), -np.finfo(float).max)
    row, col = np.nonzero(scores >= low[:, None])
    return row, col, np.einsum("ij,ij->i", q[row], x[col])


def nearest(
    rows: DataFrame, queries: DataFrame, *, k: int = 20, trees: int = 4, leaf: int = 512, least: int = 4000, budget: int = 48_000, sample: int = 50_000, probes: int = 4096, shard: int = 8192, block: int = 16_384, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product found for each query, without itself.

    The forest is fitted on at most ``sample`` distinct vectors (those with the
    smallest hash) and broadcast; its size is bounded by ``sample * trees``
    splits. Every distinct vector is indexed. A query opens leaves of about
    ``least`` entries in a first pass and up to ``budget`` in all; an index of
    at most ``probes`` entries is compared whole.
    """
    spark = rows.sparkSession
    clean = usable(rows, id_column, vector_column)
    widths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0]["n"]
    entries = written(_entries(clean.where(F.size("vector") == width), k), "entries")
    stats = entries.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)")).alias("longest")).first()
    n, longest = stats["n"], float(np.sqrt(stats["longest"])) * (1 + 1e-6)
    part = min(1.0, 1.2 * sample / n)
    fit = entries.where(F.col("key") <= int(-(2**63) + part * (2**64 - 1))) if part < 1 else entries
    picked = fit.orderBy("key", "entry").limit(sample).select("vector", "ids").toArrow().combine_chunks()  # bounded by the sample
    points, names = matrix(picked.column("vector").combine_chunks()), picked.column("ids").combine_chunks()
    drawn = np.random.default_rng(seed).permutation(len(points))[:probes]
    known = spark.sparkContext.broadcast((points[drawn], names.take(pa.array(drawn))))
    asked = written(usable(queries, id_column, vector_column).where(F.size("vector") == width).withColumnRenamed("vec_id", "query_id").distinct(), "queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids = known.value
        for batch in batches:
            q, asker = matrix(column_of(batch, "vector")), column_of(batch, "query_id").to_numpy()
            for a in range(0, batch.num_rows, 256):
                row, col, score = _best(q[a : a + 256], x, np.full(len(q[a : a + 256]), -np.inf), k)
                yield _expand(asker[a : a + 256], row, col, score, ids)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(pairs: DataFrame) -> DataFrame:
        each = pairs.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    kept = written(top(asked.mapInArrow(probe, FOUND)), "kept")
    if n > len(drawn):
        size = max(2, min(leaf, round(leaf * len(points) / n)) if n > len(points) else leaf)
        search = _Search(entries, grow_forest(directions(points, longest), trees, size, seed), longest, k, shard, block)
        for skip, most in ((0, least), (least, budget)):
            floors = kept.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            found = search.step(asked.join(floors, "query_id", "left"), skip, most)
            kept = written(top(kept.select("query_id", "vec_id", "score").unionByName(found)), "kept")
    return kept.select("query_id", "rank", "vec_id", "score")


class _Search:
    """The index of ``entries`` under a forest, and the steps that queries take through it."""

    def __init__(self, entries: DataFrame, forest: Forest, longest: float, k: int, shard: int, block: int):
        self.longest, self.k, self.block, self.trees = longest, k, block, len(forest.roots)
        self.spark = entries.sparkSession
        sent, trees = self.spark.sparkContext.broadcast(forest), self.trees

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                if batch.num_rows:
                    leaves = own.leaf_of(directions(matrix(column_of(batch, "vector")), longest))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), trees).cast(pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

        self.kind = entries.schema["vector"].dataType.simpleString()
        self.index = written(entries.select("entry", "vector", "ids").mapInArrow(place, f"entry long, vector {self.kind}, ids array<long>, leaves array<long>"), "index")
        for r in self.index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # bounded by the sample
            forest.sizes[r["leaf"]] = r["count"]
        self.sent = self.spark.sparkContext.broadcast((forest, Shards.of(forest.sizes, shard)))

    def step(self, asking: DataFrame, skip: int, most: int) -> DataFrame:
        """Rows of ``FOUND`` from the leaves that the queries ``(query_id, vector, floor)`` open after ``skip`` entries."""
        sent, longest, k, trees = self.sent, self.longest, self.k, self.trees

        def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, shards = sent.value
            for batch in batches:
                q, floors = matrix(column_of(batch, "vector")), np.asarray(column_of(batch, "floor").fill_null(-np.inf))
                x = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                x = np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)
                # squared distance, between directions, of a vector that scores the floor
                reach = 2 - 2 * (floors - 1e-6 * np.maximum(1, np.abs(floors))) / (np.linalg.norm(q, axis=1) * longest)
                which, place, lists = [], [], []
                for i in range(batch.num_rows):
                    opened: dict[int, list[int]] = {}
                    for f in own.search(x[i] @ own.normals.T - own.cuts, skip, most, reach[i]):
                        for p in range(int(shards.parts[f])):
                            opened.setdefault(int(shards.first[f]) + p, []).append(f)
                    which += [i] * len(opened)
                    place += opened
                    lists += opened.values()
                some = batch.select(["query_id", "vector", "floor"]).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(place, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["query_id", "vector", "floor", "shard", "leaves"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, shards = sent.value
            for batch in batches:
                leaves = column_of(batch, "leaves").flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), trees)
                part = mix64(column_of(batch, "entry").to_numpy().view(np.uint64))[row] % shards.parts[leaves].astype(np.uint64)
                some = batch.select(["entry", "vector", "ids"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaves), pa.array(shards.first[leaves] + part.astype(np.int64))], names=["entry", "vector", "ids", "leaf", "shard"])

        def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])]
            if left.num_rows and right.num_rows:
                leaf, entry = right.column("leaf").to_numpy(), right.column("entry").to_numpy()
                # an entry that several trees bring to this shard is compared once, for the queries that open any of its leaves
                kinds, first, of = np.unique(entry, return_index=True, return_inverse=True)
                x, ids = matrix(right.column("vector").combine_chunks())[first], right.column("ids").combine_chunks().take(pa.array(first))
                numbers, at = np.unique(leaf, return_inverse=True)
                holds = np.zeros((len(numbers), len(kinds)), np.float32)
                holds[at, of] = 1
                q, floors, asker = matrix(left.column("vector").combine_chunks()), left.column("floor").fill_null(-np.inf).to_numpy(), left.column("query_id").to_numpy()
                lists = left.column("leaves").combine_chunks()
                for a in range(0, len(q), 256):
                    some = lists.slice(a, 256)
                    open_at = np.zeros((len(some), len(numbers)), np.float32)
                    who = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
                    wanted = some.flatten().to_numpy()
                    there = np.isin(wanted, numbers)
                    open_at[who[there], np.searchsorted(numbers, wanted[there])] = 1
                    row, col, score = _best(q[a : a + 256], x, floors[a : a + 256], k, open_at @ holds > 0)
                    parts.append(_expand(asker[a : a + 256], row, col, score, ids))
            return pa.Table.from_batches(parts)

        opened = written(asking.select("query_id", "vector", "floor").mapInArrow(open_leaves, f"query_id long, vector {self.kind}, floor double, shard long, leaves array<long>"), "opened")
        # a shard that many queries open is searched by blocks of them
        blocks = opened.groupBy("shard").agg(F.ceil(F.count("*") / self.block).alias("blocks"))
        held = self.index.mapInArrow(deal, f"entry long, vector {self.kind}, ids array<long>, leaf long, shard long").join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        asks = opened.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
        return asks.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(rerank, FOUND)
