"""Exact top-k of a batch of queries, one pass over the documents.

A batch whose topics share terms meets each posting many times: joined term by
term, every (topic, document) pair goes through a shuffle. Here each posting
of a query term is weighted once (by the model's Column expression, for each
query multiplicity of its term) where the direct index lies; a task adds the
weights up for its own documents and topics and keeps the first k of each
topic. Only these, at most k per topic and task, are shuffled.

The tasks' part is numpy on blocks of whole documents: a matrix of weights
(query term, document), whose rows are added for each topic and field. A
document's fields may lie in two tasks; each gives what it has and the best
counts. Where ids repeat (or are null) and where there is no direct index, the
weights are first summed by document and dealt out by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from rankspark.functions.models import contribution
from rankspark.operators.index import Index, postings_by_document
from rankspark.session import map_arrow

#: Rows of weights that a task gathers before it adds them up, and cells of its matrix.
BLOCK_ROWS = 250_000
BLOCK_CELLS = 4_000_000
#: (topic, rank) places that a task holds at once; more topics go in several passes.
MAX_PLACES = 4_000_000
_NULL_ID = -(1 << 63)


def search_scanned(index: Index, stats: DataFrame, models: dict, fields: list[str], k: int, decimals: int) -> DataFrame:
    """(topic_id, src, doc_id, score): what can be among the first k of a topic by the ``src``-th of ``models``.

    Scores are rounded; ``stats`` as of ``asked``, few rows.
    """
    spark = index.spark
    topics, terms, weighted, numbers, field, vid = numbered(stats, fields)
    out = StructType([StructField("topic_id", stats.schema["topic_id"].dataType), StructField("src", IntegerType()),
                      StructField("doc_id", LongType()), StructField("score", DoubleType())])
    if not len(vid):
        return spark.createDataFrame([], out)
    rows, whole = postings_by_document(index, fields, terms, True)
    columns = [f"w{m}" for m in range(len(models))]
    on = ["key"] if "key" in rows.columns else ["field", "term"]
    weights = rows.join(F.broadcast(spark.createDataFrame(weighted)), on).select(
        "doc_id", "vid", *[contribution(m, p).alias(c) for c, (m, p) in zip(columns, models.values())])
    if not whole:
        weights = weights.groupBy("doc_id", "vid").agg(*[F.sum(c).alias(c) for c in columns]) \
            .repartition("doc_id").sortWithinPartitions("doc_id")
    found, step = None, max(1, MAX_PLACES // (k * len(models)))
    for low in range(0, len(topics), step):
        lo, hi = np.searchsorted(numbers, [low, low + step])
        plan = spark.sparkContext.broadcast((topics.slice(low, step), numbers[lo:hi] - low, field[lo:hi], vid[lo:hi], len(weighted)))
        part = map_arrow(weights, _scanner(plan, columns, k, decimals), out)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("topic_id", "src", "doc_id").agg(F.max("score").alias("score"))


def numbered(stats: DataFrame, fields: list[str]) -> tuple[pa.Array, pa.Array, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's statistics (few rows) as numbers.

    Its topics; its terms; a row for each ``vid``, a term in a field with its multiplicity in a topic (``key``: the term's
    place times the fields plus the field's), with its statistics; and the topics' numbers, fields and vids, in this order.
    """
    asked = stats.select("topic_id", "field", "term", "qtf", "df", "cf", "n", "avgdl").toArrow().combine_chunks()
    topic = _encoded(asked["topic_id"])
    named = _encoded(asked["term"])
    terms = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    field = pc.index_in(asked["field"], pa.array(fields, asked["field"].type)).to_numpy().astype(np.int64)
    qtf = asked["qtf"].to_numpy().astype(np.int64)
    place = terms * len(fields) + field
    _, first, vid = np.unique(place * (int(qtf.max(initial=0)) + 1) + qtf, return_index=True, return_inverse=True)
    weighted = asked.take(pa.array(first)).drop_columns(["topic_id"]).append_column("vid", pa.array(np.arange(len(first)), pa.int32())) \
        .append_column("key", pa.array(place[first]))
    numbers = topic.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((vid, field, numbers))
    return topic.dictionary, named.dictionary, weighted, numbers[order], field[order], vid[order]


def _encoded(column) -> pa.DictionaryArray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode(null_encoding="encode")


def _scanner(plan, columns: list[str], k: int, decimals: int):
    def run(batches):
        ids, numbers, field, vid, size = plan.value
        starts = np.flatnonzero(np.diff(numbers * (field.max() + 1) + field, prepend=-1))
        lists = [(int(numbers[a]), vid[a:b]) for a, b in zip(starts, [*starts[1:], len(vid)])]  # by topic, then field
        best = [[_Best(k, decimals) for _ in range(len(ids))] for _ in columns]
        kept, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column(0)
            kept.append((pc.fill_null(docs, _NULL_ID).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(),
                         [(pc.fill_null(batch.column(c), 0.0).to_numpy(zero_copy_only=False),
                           batch.column(c).is_valid().to_numpy(zero_copy_only=False)) for c in columns]))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                kept, rows = _add(kept, lists, best, size, False)
        if kept:
            _add(kept, lists, best, size, True)
        for src, topics in enumerate(best):
            for number, top in enumerate(topics):
                docs, scores = top.first()
                if len(docs):
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(np.full(len(docs), number))), pa.array(np.full(len(docs), src, np.int32)),
                        pa.array(docs, mask=docs == _NULL_ID), pa.array(scores, from_pandas=False)],
                        ["topic_id", "src", "doc_id", "score"])
    return run


def _add(kept: list, lists: list, best: list, size: int, last: bool) -> tuple[list, int]:
    """Score the whole documents of the gathered rows; what is left of the last one stays."""
    docs, vids = (np.concatenate([b[i] for b in kept]) for i in (0, 1))
    weights = [tuple(np.concatenate([b[2][m][i] for b in kept]) for i in (0, 1)) for m in range(len(best))]
    edges = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1, [len(docs)]])
    n = len(edges) - 1 if last else len(edges) - 2
    local = np.full(size, -1)
    local[vids] = 0
    used = np.flatnonzero(local == 0)
    local[used] = np.arange(len(used))
    present = [(number, own) for number, own in ((number, local[v]) for number, v in lists) if (own >= 0).any()]
    present = [(number, own[own >= 0]) for number, own in present]
    step = max(1, BLOCK_CELLS // len(used))
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = edges[a], edges[b]
        width = b - a
        cell = local[vids[lo:hi]] * width + np.repeat(np.arange(width), np.diff(edges[a:b + 1]))
        for tops, (w, valid) in zip(best, weights):
            sums = np.bincount(cell, w[lo:hi], len(used) * width).reshape(len(used), width)
            there = np.zeros(len(used) * width, bool)
            there[cell[valid[lo:hi]]] = True
            _score(present, tops, sums, there.reshape(len(used), width), docs[edges[a:b]])
    cut = edges[n]
    if cut == len(docs):
        return [], 0
    return [(docs[cut:], vids[cut:], [(w[cut:], valid[cut:]) for w, valid in weights])], len(docs) - cut


def _score(present: list, tops: list, sums: np.ndarray, there: np.ndarray, docs: np.ndarray) -> None:
    """Add the rows of each topic's terms up, by field, and offer each document's best field."""
    for i, (number, own) in enumerate(present):
        found = there[own].any(axis=0)
        score = np.where(found, sums[own].sum(axis=0), -np.inf)
        if i and present[i - 1][0] == number:
            found, score = found | found_before, np.maximum(score, before)
        if i + 1 < len(present) and present[i + 1][0] == number:
            found_before, before = found, score
        else:
            tops[number].offer(docs, score, found)


class _Best:
    """The first k documents of a topic by rounded score, then id."""

    def __init__(self, k: int, decimals: int):
        self.k, self.unit = k, 10.0 ** decimals
        self.docs, self.scores, self.held, self.least = [], [], 0, -np.inf

    def offer(self, docs: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        at = np.flatnonzero(found & ~(scores < self.least - 1.0 / self.unit))
        if len(at):
            scores = self._rounded(scores[at])
            self.docs.append(docs[at])
            self.scores.append(scores)
            self.held += len(at)
            if self.held >= 2 * self.k + 64 or self.least == -np.inf and self.held >= self.k:
                self._cut()

    def _rounded(self, x: np.ndarray) -> np.ndarray:
        """Half up, away from 0, as Spark's round; numbers too large to have such digits stay."""
        r = np.copysign(np.floor(np.abs(x) * self.unit + 0.5) / self.unit, x) + 0.0
        return np.where(np.abs(x) < 1e9, r, x)

    def _cut(self) -> None:
        docs, scores = np.concatenate(self.docs), np.concatenate(self.scores)
        order = np.lexsort((docs, -scores, ~np.isnan(scores)))[:self.k]  # NaN is the largest number, as in Spark
        self.docs, self.scores, self.held = [docs[order]], [scores[order]], len(order)
        if self.held == self.k and not np.isnan(scores[order[-1]]):
            self.least = scores[order[-1]]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0)
        self._cut()
        return self.docs[0], self.scores[0]
