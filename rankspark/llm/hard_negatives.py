"""Hard-negative mining by a GNAT-style tree over integer vectors.

For each anchor and each of its first ``n_positives`` rows of the same label,
the first ``n_negatives`` rows of other labels whose score lies between
``low`` and ``high`` times the positive's. A row's score is its inner product
with the anchor, of components ``floor(scale * x)``; higher scores come first,
then smaller ids. Everything is exact.

Metric: a row x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm,
an anchor a becomes (a, 0), so that the squared distance is |a|^2 + M - 2
score: rows whose scores lie in a window lie in an annulus around the anchor.

Tree: the split points of a node are distinct rows chosen far from each other;
a row goes to the nearest one, so a node is cut by the hyperplanes between
several points at once. The points come from a sample of ``SAMPLE_ROWS`` rows
(by a hash of the id; a documented bound), but every row of the table is in
the tree, and each split point stores the least and greatest distance to the
rows of each sibling subtree, taken over all rows. A subtree is left out when,
for any split point, its range and the distances that the annulus allows do
not meet. What remains are leaves, which are compared exactly.

The lower edge of a window is raised first to the score of the k-th fitting
row of the sample, if it has k: the result cannot lie lower.

On Spark: rows are dealt to (leaf, part) blocks of about ``BLOCK_ROWS`` rows
however many of them a leaf has (copies of one vector too); queries go to the
blocks of their leaves in sets of about ``QUERY_ROWS``, where numpy computes
the scores; each block returns the first k of each query, and a ranking over
these few keeps the first k of all. The driver holds the sample, the tree and
its ranges, all bounded by the parameters.

Defined results: rows with a null id, label, vector or component, or a
component that is not finite, take no part; vectors of different lengths are
filled up with zeros, so an empty one has score 0; rows that share an id each
count, ties between them in the order of reading; an anchor without other
rows of its label or without a fitting row has no result; an empty table gives
no rows. Scores are exact below 2**63. Columns are read by their exact names,
so other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rankspark.llm.common import map_arrow, named, prepare, written

SAMPLE_ROWS = 2048
FAN_OUT = 8
LEAF_SAMPLE = 32
MAX_DEPTH = 12
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Node:
    """Split points (lifted) with the ranges ``least[i, j]`` .. ``most[i, j]`` from point i to the rows under child j."""
    points: np.ndarray
    children: list = field(default_factory=list)  # a Node or the number of a leaf
    least: np.ndarray | None = None
    most: np.ndarray | None = None


@dataclass
class Tree:
    root: Node | int
    leaves: int
    nodes: list
    norm: float  # M
    size: int  # length of the vectors


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list of integers, filled up with zeros to ``size``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, exact."""
    largest = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < 2 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(0, norm - (x * x).sum(axis=1)))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def build_tree(sample: np.ndarray, norm: float, fan_out: int = FAN_OUT, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    """A tree over the distinct rows of ``sample``; the ranges are still empty."""
    tree = Tree(0, 0, [], norm, sample.shape[1])

    def grow(rows: np.ndarray, depth: int) -> Node | int:
        if len(rows) <= max(leaf_sample, fan_out) or depth == MAX_DEPTH:
            tree.leaves += 1
            return tree.leaves - 1
        chosen = [0]  # each next point is the row farthest from those chosen
        gap = distances(rows, rows[:1])[:, 0]
        while len(chosen) < fan_out:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(rows, rows[chosen[-1:]])[:, 0])
        node = Node(rows[chosen])
        tree.nodes.append(node)
        own = distances(rows, node.points).argmin(axis=1)
        node.children = [grow(rows[own == j], depth + 1) for j in range(fan_out)]
        return node

    tree.root = grow(lifted(np.unique(sample, axis=0), norm), 0)
    return tree


def paths(tree: Tree, rows: np.ndarray, seen=None) -> np.ndarray:
    """Leaf of each row; ``seen(node number, distances to its points, child of each)`` is told of every step."""
    z = lifted(rows, tree.norm)
    leaf = np.zeros(len(rows), np.int32)
    number = {id(n): k for k, n in enumerate(tree.nodes)}
    todo = [(tree.root, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if isinstance(node, int):
            leaf[own] = node
        elif len(own):
            d = distances(z[own], node.points)
            child = d.argmin(axis=1)
            if seen:
                seen(number[id(node)], d, child)
            todo += [(c, own[child == j]) for j, c in enumerate(node.children)]
    return leaf


def reached(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries that may have rows with low <= score <= high there). The bounds may be infinite."""
    square = (queries.astype(float) ** 2).sum(axis=1)
    slack = 1e-6 * (1 + np.sqrt(square) + math.sqrt(tree.norm))  # for the rounding of distances
    inner = np.sqrt(np.maximum(0, square + tree.norm - 2 * high)) - slack
    outer = np.sqrt(np.maximum(0, square + tree.norm - 2 * low)) + slack
    z = np.column_stack((queries.astype(float), np.zeros(len(queries))))
    todo = [(tree.root, np.flatnonzero(low <= high))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            yield node, own
            continue
        d = distances(z[own], node.points)
        nearest = np.maximum(d - outer[own, None], inner[own, None] - d)
        farthest = d + outer[own, None]
        for j, child in enumerate(node.children):
            meets = ((node.least[:, j] <= farthest) & (node.most[:, j] >= nearest)).all(axis=1)
            todo.append((child, own[meets]))


class Index:
    """The valid rows of a table in (leaf, part) blocks, written to the shared folder, and the tree over them."""

    def __init__(self, docs: DataFrame, id_col: str, vector_col: str, label: Column, scale: int,
                 sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS):
        prepare(docs.sparkSession)
        self.spark = docs.sparkSession
        vector = named(vector_col)
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        valid = docs.filter(named(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & ~bad).select(
            named(id_col).cast("long").alias("id"), label.alias("label"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        facts = valid.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), F.max(F.size("vector")).alias("size")).first()
        self.rows = facts["n"]
        if not self.rows:
            return
        sample = valid.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
        self.sample = matrix(sample.column("vector"), facts["size"])
        self.sample_ids = np.array(sample.column("id"))
        self.sample_labels = sample.column("label").to_numpy()
        self.tree = build_tree(self.sample, facts["norm"])
        self._deal(valid, block_rows)

    def _deal(self, valid: DataFrame, block_rows: int) -> None:
        shared = self.spark.sparkContext.broadcast(self.tree)

        def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for b in batches:
                leaf = paths(tree, matrix(b.column("vector"), tree.size))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            m = max((len(n.points) for n in tree.nodes), default=0)
            least = np.full((len(tree.nodes), m, m), np.inf)
            most = np.full((len(tree.nodes), m, m), -np.inf)

            def seen(k: int, d: np.ndarray, child: np.ndarray) -> None:
                for j in range(len(tree.nodes[k].points)):
                    if (child == j).any():
                        least[k, :, j] = np.minimum(least[k, :, j], d[child == j].min(axis=0))
                        most[k, :, j] = np.maximum(most[k, :, j], d[child == j].max(axis=0))

            for b in batches:
                paths(tree, matrix(b.column("vector"), tree.size), seen)
            node, i, j = np.nonzero(least <= most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (node, i, j)]
                + [pa.array(least[node, i, j]), pa.array(most[node, i, j])], names=["node", "i", "j", "least", "most"])

        schema = StructType([*valid.schema.fields, StructField("leaf", IntegerType())])
        table = written(map_arrow(valid, to_leaf, schema).withColumn("row", F.monotonically_increasing_id()), "gnat-rows")
        found = map_arrow(table.select("vector"), ranges, "node int, i int, j int, least double, most double") \
            .groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        for n in self.tree.nodes:
            n.least = np.full((len(n.points), len(n.points)), np.inf)  # a child without rows meets nothing
            n.most = np.full((len(n.points), len(n.points)), -np.inf)
        for r in found:
            self.tree.nodes[r["node"]].least[r["i"], r["j"]] = r["least"]
            self.tree.nodes[r["node"]].most[r["i"], r["j"]] = r["most"]
        self.shared = self.spark.sparkContext.broadcast(
            (self.tree, self.sample, self.sample_ids, self.sample_labels))
        # One row for each leaf, of which the parameters bound the number.
        counts = table.groupBy("leaf").count().collect()
        parts = {r["leaf"]: math.ceil(r["count"] / block_rows) for r in counts}
        self.parts = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv])
        self.table = table

    def first_in_window(self, queries: DataFrame, k: int, same_label: bool, query_rows: int = QUERY_ROWS) -> DataFrame:
        """(q, rank, id, row, score): the first k rows of each query (q, id, row, label, vector, low, high) whose
        score lies in low .. high (null: no bound) and whose label is the query's (or not); never the row itself."""
        shared, tree_size = self.shared, self.tree.size
        schema = StructType([*queries.schema.fields, StructField("leaf", IntegerType())])

        def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sample, ids, labels = shared.value
            for b in batches:
                v = matrix(b.column("vector"), tree.size)
                low, high = _bounds(b)
                own_id, own = b.column("id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)
                for a in range(0, len(v), 256):
                    z = slice(a, a + 256)
                    score = products(v[z], sample).astype(float)
                    fits = ((own[z, None] == labels) == same_label) & (score >= low[z, None]) & (score <= high[z, None])
                    fits &= own_id[z, None] != ids
                    score[~fits] = -np.inf
                    if score.shape[1] >= k:
                        low[z] = np.maximum(low[z], np.partition(score, -k, axis=1)[:, -k])
                for leaf, own in reached(tree, v, low, high):
                    part = b.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(own), leaf, np.int32))],
                                                     names=[*b.schema.names, "leaf"])

        n_sets = math.ceil(max(1, queries.count()) / query_rows)
        key = ["leaf", "part", "set"]
        asked = map_arrow(queries, to_leaves, schema) \
            .withColumn("part", F.explode(F.sequence(F.lit(0), self.parts[F.col("leaf")] - 1))) \
            .withColumn("set", F.pmod(F.xxhash64("q"), F.lit(n_sets)).cast("int"))
        rows = self.table.withColumn("part", F.pmod(F.xxhash64("row"), self.parts[F.col("leaf")]).cast("int")) \
            .withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))

        def scan(queries: pa.Table, rows: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if queries.num_rows and rows.num_rows:
                rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
                ids, numbers, labels = (rows.column(c).to_numpy() for c in ("id", "row", "label"))
                vectors, asking = matrix(rows.column("vector"), tree_size), matrix(queries.column("vector"), tree_size)
                q, own_row, own = (queries.column(c).to_numpy() for c in ("q", "row", "label"))
                low, high = _bounds(queries)
                for a in range(0, len(q), 256):
                    score = products(asking[a:a + 256], vectors)
                    for x, s in enumerate(score, a):
                        at = np.flatnonzero(((labels == own[x]) == same_label) & (numbers != own_row[x])
                                            & (s >= low[x]) & (s <= high[x]))
                        at = at[np.argsort(-s[at], kind="stable")[:k]]
                        for c, values in zip(out, (np.full(len(at), q[x]), ids[at], numbers[at], s[at])):
                            c.append(values)
            return pa.Table.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in out],
                                        names=["q", "id", "row", "score"])

        found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(scan, "q long, id long, row long, score long")
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
            .select("q", "rank", "id", "row", "score")


def _bounds(queries) -> tuple[np.ndarray, np.ndarray]:
    low, high = (queries.column(c).to_numpy(zero_copy_only=False).astype(float) if isinstance(queries, pa.RecordBatch)
                 else queries.column(c).to_numpy().astype(float) for c in ("low", "high"))
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def mine(docs: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
         query_rows: int = QUERY_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``low`` and ``high`` in hundredths
    of the positive's score, ``is_anchor`` a condition on the columns id, label and vector."""
    spark = docs.sparkSession
    index = Index(docs, id_col, vector_col, named("label") if label is None else label, scale, sample_rows, block_rows)
    if not index.rows:
        return spark.createDataFrame([], RESULT)
    null = F.lit(None).cast("double")
    anchors = index.table.filter(is_anchor).select(
        F.col("row").alias("q"), "id", "row", "label", "vector", null.alias("low"), null.alias("high"))
    positives = index.first_in_window(anchors, n_positives, True, query_rows) \
        .select(F.col("q").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole scores: low * p <= 100 * n <= high * p.
    p = F.col("positive_score")
    least, most = -F.floor(-p * low / 100), F.floor(p * high / 100)
    asked = written(positives.join(anchors.drop("q", "low", "high"), "row").select(
        F.monotonically_increasing_id().alias("q"), "id", "row", "label", "vector", least.cast("double").alias("low"),
        most.cast("double").alias("high"), "positive_id", "positive_score").filter("low <= high"), "gnat-windows")
    windows = asked.drop("positive_id", "positive_score")
    found = index.first_in_window(windows, n_negatives, False, query_rows).withColumnRenamed("id", "negative_id")
    return found.join(asked.select("q", F.col("id").alias("anchor_id"), "positive_id", "positive_score"), "q").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"))
