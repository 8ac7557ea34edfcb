"""Exact top-k of a stored index without scoring every match (H1, H2).

The index keeps, for each term and block of documents, between which values
tf and dl lie there. With the query's statistics that gives the least and the
largest contribution a term can make in a block (``contribution_bounds``), and
so a bound on the score of any document of the block.

1. Probe: for each topic the stretches of blocks with the highest bounds, as
   many as hold ``PROBE * k`` postings of one term, are scored. The k-th best
   score there is the threshold: the k-th best of all cannot be lower.
2. Stretches whose bound lies under every topic's threshold are left out. In
   the others a task goes from some documents to the next ones; the largest
   weight of each term there bounds a topic's scores. Topics whose bound lies
   under their threshold are left out. For each other topic the terms with the
   lowest bounds are optional, as long as they stay below the threshold
   together: a document that holds only such terms cannot be among the first k.
3. Documents with a needed term are scored by those; documents that even the
   whole optional bound does not lift to the threshold go. What is left gets
   its optional terms' contributions. The k-th best of a task's documents is a
   better threshold for the next ones.

Terms, topics and fields are numbers, and the postings of a stretch come
together in one task, a row for each term and stretch in the shuffle. A topic
and document becomes a row only where it can still be among the first k. The
stretches are at most about ``STRETCHES``, so the bounds stay few as an index grows.

A contribution may be negative (BM25's idf of terms in more than half of the
documents); upper bounds count it as 0, so they hold for documents without the
term.
Each field counts on its own in field-max search: the field in which a
document reaches the threshold is scored exactly, and no other one matters.
The thresholds allow for the rounding of scores.

Batches too large to go to every task, and indexes with ids that repeat or are
null, take joins instead (``_joined``). The rows of a repeated id can lie in
several blocks, and no bound of a block covers their sum: what is left out
there may differ from what ``search`` without pruning leaves out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.models import DEFAULT_K, contribution, contribution_bounds
from rankspark.operators.guards import BROADCAST_MAX_ROWS
from rankspark.operators import index as I
from rankspark.operators.index import Index, repeated_ids, runs_of, stretch_bits, stretch_bounds, stretch_postings
from rankspark.operators.scan import BLOCK_CELLS, MAX_PLACES, _Best, numbered
from rankspark.operators.search import SCORE_DECIMALS, Asked, _fields_for, asked, top_k
from rankspark.session import map_arrow, materialize

#: Documents probed for a threshold, as a multiple of k.
PROBE = 3
#: Documents that a topic's bound holds for.
CHUNK = 1024
_MARGIN = 10.0 ** -(SCORE_DECIMALS - 1)
_GROUP = ["topic_id", "field", "block"]
_HITS = "number int, doc_id long, score double"


@dataclass
class PrunedRun:
    run: DataFrame
    counts: DataFrame  # (step, n)

    def scored(self) -> dict[str, int]:
        """How many (topic, document) were scored: for the thresholds, by needed terms, and of those to the end."""
        found = {r["step"]: r["n"] for r in self.counts.groupBy("step").agg(F.sum("n").cast("long").alias("n")).collect()}
        return {step: found.get(step) or 0 for step in ("probed", "needed", "kept")}


def _counted(step: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit(step).alias("step"), "n")


def search_pruned(index: Index, queries: DataFrame, model: str = "bm25_doc", mode: str = "document", k: int | None = None,
                  params: dict | None = None, fields=None, max_rows: int = BROADCAST_MAX_ROWS,
                  query: Asked | None = None) -> PrunedRun:
    """The run that ``search`` gives, of a stored index and a model with a bound."""
    k = k or DEFAULT_K[mode]
    sel = _fields_for(index, mode, fields)
    bounds = contribution_bounds(model, params)
    if bounds is None or not index.segments:
        raise ValueError("pruning needs a stored index and a model with a bound")
    query = query or asked(index, queries, mode, fields, max_rows)
    if query.terms is None or repeated_ids(index, sel[0]):
        return _joined(index, query, sel, model, params, bounds, k, max_rows)
    spark = index.spark
    topics, terms, weighted, numbers, field, vid = numbered(query.stats, sel)
    if not len(vid):
        empty = spark.createDataFrame([], f"topic_id {query.stats.schema['topic_id'].dataType.simpleString()}, doc_id long, score double")
        return PrunedRun(top_k(empty, "score", k), _counted("probed", empty))
    weights = F.broadcast(spark.createDataFrame(weighted.drop_columns(["field", "term"])))
    keys = F.broadcast(spark.createDataFrame(weighted.select(["field", "term", "key"])).distinct())
    stored = index.read("stored", sel, query.terms).join(keys, ["field", "term"]).drop("field", "term")
    shift = stretch_bits(index)

    high = stretch_bounds(stored, shift).join(weights, "key").select("stretch", "vid", "rows", F.greatest(bounds[1], F.lit(0.0)).alias("high"))
    plan = spark.sparkContext.broadcast((numbers, field, vid, len(weighted)))
    groups = map_arrow(high.repartition("stretch").sortWithinPartitions("stretch"), _totals(plan), "number int, field int, stretch long, total double, docs long")
    first = Window.partitionBy("number").orderBy(F.col("total").desc(), "field", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    ranked = materialize(groups.withColumn("before", F.coalesce(F.sum("docs").over(first), F.lit(0))), "stretches")

    # A row a stretch: few, however large the index.
    probe = _collected(ranked.filter(F.col("before") < PROBE * k))
    postings = pc.sum(weighted["df"]).as_py() or 0

    def scored(stretches: np.ndarray, edges: np.ndarray) -> DataFrame:
        rows = stretch_postings(stored, shift, min(shift, I.UNIT_BITS), stretches, postings).join(weights, "key") \
            .select("unit", "vid", "doc_id", contribution(model, params).alias("w"))
        found, step = None, max(1, MAX_PLACES // k)
        for low in range(0, len(topics), step):
            lo, hi = np.searchsorted(numbers, [low, low + step])
            plan = spark.sparkContext.broadcast((low, numbers[lo:hi] - low, field[lo:hi], vid[lo:hi], len(weighted), edges[low:low + step]))
            part = map_arrow(rows, _scorer(plan, k), _HITS)
            found = part if found is None else found.unionByName(part)
        return found

    none = np.full(len(topics), -np.inf)
    probed = materialize(scored(probe, none), "probed")
    edge = _edges(_best(probed), k, "number")
    edges = none.copy()
    for r in edge.collect():  # a row a topic
        edges[r["number"]] = r["edge"]
    floor = F.coalesce("edge", F.lit(float("-inf")))  # fewer than k documents seen: nothing is left out
    left = _collected(ranked.join(F.broadcast(edge), "number", "left").filter(F.col("total") >= floor))
    rest = scored(np.setdiff1d(left, probe), edges)
    names = F.broadcast(spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(topics)), pa.int32()), "topic_id": topics})))
    run = top_k(_best(probed.unionByName(rest)).join(names, "number"), "score", k)

    def count(step: str, rows: DataFrame, number: int) -> DataFrame:
        return rows.filter(F.col("number") == number).select(F.lit(step).alias("step"), F.col("score").alias("n"))

    return PrunedRun(run, count("probed", probed, _KEPT).unionByName(count("needed", rest, _NEEDED)).unionByName(count("kept", rest, _KEPT)))


#: Numbers of the rows that say how many documents a task scored by needed terms, and to the end.
_NEEDED, _KEPT = -1, -2


def _best(found: DataFrame) -> DataFrame:
    return found.filter(F.col("number") >= 0).groupBy("number", "doc_id").agg(F.max("score").alias("score"))


def _collected(groups: DataFrame) -> np.ndarray:
    return np.array(sorted(r["stretch"] for r in groups.select("stretch").distinct().collect()), np.int64)


def _totals(plan):
    """Of each stretch: for each topic and field found there the bound of a score, and how many postings a term has at most."""
    def run(batches):
        numbers, field, vid, size = plan.value
        starts = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (field[1:] != field[:-1])]))
        for stretch, vids, rows, high in runs_of(batches):
            bound, docs, vids = np.zeros(size), np.zeros(size, np.int64), vids.to_numpy()
            np.maximum.at(bound, vids, high.to_numpy())
            np.add.at(docs, vids, rows.to_numpy())
            total, docs = np.add.reduceat(bound[vid], starts), np.maximum.reduceat(docs[vid], starts)
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers[starts][at].astype(np.int32)), pa.array(field[starts][at].astype(np.int32)), pa.array(np.full(len(at), stretch[0].as_py())),
                pa.array(total[at], from_pandas=False), pa.array(docs[at])], ["number", "field", "stretch", "total", "docs"])
    return run


class _Distinct(_Best):
    """The first k documents of a topic, each once, as the fields of one can lie in two blocks."""

    def _cut(self) -> None:
        docs, scores = np.concatenate(self.docs), np.concatenate(self.scores)
        order = np.lexsort((-scores, ~np.isnan(scores), docs))
        order = order[np.concatenate([[True], np.diff(docs[order]) != 0])]
        self.docs, self.scores = [docs[order]], [scores[order]]
        super()._cut()


def _scorer(plan, k: int):
    def run(batches):
        low, numbers, field, vid, size, edges = plan.value
        tops, counts = [_Distinct(k, SCORE_DECIMALS) for _ in edges], {_NEEDED: 0, _KEPT: 0}
        edges = edges.copy()
        for _, vids, docs, w in runs_of(batches):
            valid = w.is_valid().to_numpy()
            _score_unit(vids.to_numpy(), docs.to_numpy(), pc.fill_null(w, 0.0).to_numpy(), valid, numbers, field, vid, size, edges, tops, counts)
        for number, top in enumerate(tops):
            docs, scores = top.first()
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), low + number, np.int32)), pa.array(docs), pa.array(scores, from_pandas=False)],
                                                 ["number", "doc_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([None, None], pa.int64()), pa.array(list(counts.values()), pa.float64())],
                                         ["number", "doc_id", "score"])
    return run


def _score_unit(vids: np.ndarray, docs: np.ndarray, w: np.ndarray, valid: np.ndarray, numbers: np.ndarray, field: np.ndarray, vid: np.ndarray,
                size: int, edges: np.ndarray, tops: list, counts: dict) -> None:
    """Score a unit's documents, CHUNK at once, for the topics that they can be among the first k of; ``edges`` rise."""
    local = np.full(size, -1)
    local[vids] = 0
    used = np.flatnonzero(local == 0)
    local[used] = np.arange(len(used))
    there = local[vid] >= 0
    own, numbers, field = local[vid][there], numbers[there], field[there]
    if not len(own):
        return
    starts = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (field[1:] != field[:-1])]))
    ends, topic = np.append(starts[1:], len(own)), numbers[starts]
    ids, col = np.unique(docs, return_inverse=True)
    row, step = local[vids], max(1, min(CHUNK, BLOCK_CELLS // len(used)))
    if len(ids) > step:
        order = np.argsort(col, kind="stable")
        row, col, w, valid = row[order], col[order], w[order], valid[order]
    for a in range(0, len(ids), step):
        lo, hi = np.searchsorted(col, [a, a + step]) if len(ids) > step else (0, len(col))
        width = min(step, len(ids) - a)
        cell = row[lo:hi] * width + (col[lo:hi] - a)
        weight, has = np.zeros(len(used) * width), np.zeros(len(used) * width, bool)
        weight[cell], has[cell] = w[lo:hi], valid[lo:hi]
        weight, has = weight.reshape(len(used), width), has.reshape(len(used), width)
        bound = np.maximum(weight.max(axis=1), 0.0)[own]
        total = np.add.reduceat(bound, starts)
        alive, some = np.flatnonzero(~(total < edges[topic])), ids[a:a + width]
        best, last = None, -1
        for i in alive:
            number = topic[i]
            if number != last and best is not None:
                _offer(tops[last], some, best, edges, last, counts)
                best = None
            last, edge = number, edges[number]
            rising = bound[starts[i]:ends[i]]
            order = np.argsort(rising, kind="stable")
            gain = np.cumsum(rising[order])
            optional = int((gain < edge).sum())
            needed = own[starts[i]:ends[i]][order[optional:]]
            part = weight[needed].sum(axis=0)
            found = has[needed].any(axis=0)
            counts[_NEEDED] += int(found.sum())
            if optional:
                at = np.flatnonzero(found & ~(part + gain[optional - 1] < edge))
                score = np.full(width, -np.inf)
                score[at] = part[at] + weight[np.ix_(own[starts[i]:ends[i]][order[:optional]], at)].sum(axis=0)
            else:
                score = np.where(found, part, -np.inf)
            best = score if best is None else np.maximum(best, score)
        if best is not None:
            _offer(tops[last], some, best, edges, last, counts)


def _offer(top: _Best, docs: np.ndarray, scores: np.ndarray, edges: np.ndarray, number: int, counts: dict) -> None:
    found = scores != -np.inf
    counts[_KEPT] += int(found.sum())
    top.offer(docs, scores, found & ~(scores < edges[number]))
    edges[number] = max(edges[number], top.least - _MARGIN)


def _joined(index: Index, query: Asked, sel: list[str], model: str, params: dict | None, bounds: tuple, k: int, max_rows: int) -> PrunedRun:
    """The same for a batch of any size: blocks, postings and what they add up to are joined as rows.

    Lower bounds count a negative contribution in full: the k-th best of the needed terms' scores, less what optional
    terms can take away, is the better threshold.
    """
    blocks = index.read("blocks", sel, query.terms).select(
        "field", "term", "block", F.col("n").alias("rows"), "min_tf", "max_tf", "min_dl", "max_dl")
    blocks = blocks.groupBy("field", "term", "block").agg(
        F.sum("rows").alias("rows"), *[F.min(c).alias(c) for c in ("min_tf", "min_dl")],
        *[F.max(c).alias(c) for c in ("max_tf", "max_dl")])
    stats = ["qtf", "df", "cf", "n", "avgdl"]
    parts = materialize(blocks.join(query.stats, ["field", "term"]).select(
        *_GROUP, "term", *stats, "rows", *[f(b, F.lit(0.0)).alias(c) for f, b, c in zip((F.least, F.greatest), bounds, ("low", "high"))]),
        "bounds")
    small = parts.count() <= max_rows

    def scored(chosen: DataFrame, *carried: str) -> DataFrame:
        """Contributions of the postings of the chosen (topic, field, block, term)."""
        rows = index.read("postings", sel, query.terms)
        chosen = chosen.select(*_GROUP, "term", *stats, *carried)
        return rows.join(F.broadcast(chosen) if small else chosen, ["field", "term", "block"]) \
            .select("topic_id", "field", "doc_id", contribution(model, params).alias("w"), *carried)

    groups = parts.groupBy(*_GROUP).agg(F.sum("high").alias("total"), F.max("rows").alias("docs"))
    first = Window.partitionBy("topic_id").orderBy(F.col("total").desc(), "field", "block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    ranked = materialize(groups.withColumn("before", F.coalesce(F.sum("docs").over(first), F.lit(0))), "blocks")
    probe = F.col("before") < PROBE * k
    chosen = parts.join(ranked.filter(probe).select(*_GROUP), _GROUP, "left_semi")
    probed = materialize(scored(chosen).groupBy("topic_id", "field", "doc_id").agg(F.sum("w").alias("score")), "probed")
    best = probed.groupBy("topic_id", "doc_id").agg(F.max("score").alias("score"))
    edge = _edges(best, k)

    floor = F.coalesce("edge", F.lit(float("-inf")))  # fewer than k documents seen: nothing is left out
    left = ranked.filter(~probe).join(edge, "topic_id", "left").filter(F.col("total") >= floor) \
        .select(*_GROUP, floor.alias("edge"))
    group = Window.partitionBy(*_GROUP)
    rising = group.orderBy("high", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = parts.join(left, _GROUP).withColumn("optional", F.sum("high").over(rising) < F.col("edge"))
    for name, bound in (("gain", "high"), ("loss", "low")):
        terms = terms.withColumn(name, F.sum(F.when(F.col("optional"), F.col(bound)).otherwise(0.0)).over(group))
    terms = materialize(terms, "terms")
    carried = ["edge", "gain", "loss"]
    needed = materialize(scored(terms.filter(~F.col("optional")), *carried).groupBy("topic_id", "field", "doc_id")
                         .agg(F.sum("w").alias("part"), *[F.max(c).alias(c) for c in carried]), "needed")
    sure = needed.groupBy("topic_id", "doc_id").agg(F.max(F.col("part") + F.col("loss")).alias("score"))
    better = _edges(sure, k).withColumnRenamed("edge", "better")
    kept = materialize(needed.join(F.broadcast(better) if small else better, "topic_id", "left")
                       .filter(F.col("part") + F.col("gain") >= F.greatest("edge", "better")), "kept")
    key = ["topic_id", "field", "doc_id"]
    few = kept.count() <= max_rows
    rest = scored(terms.filter("optional")).join(F.broadcast(kept.select(*key)) if few else kept.select(*key), key, "left_semi")
    full = kept.select(*key, F.col("part").alias("w")).unionByName(rest).groupBy(*key).agg(F.sum("w").alias("score"))
    scores = full.unionByName(probed).groupBy("topic_id", "doc_id").agg(F.max("score").alias("score"))
    return PrunedRun(top_k(scores, "score", k), _counted("probed", probed).unionByName(_counted("needed", needed)).unionByName(_counted("kept", kept)))


def _edges(scores: DataFrame, k: int, topic: str = "topic_id") -> DataFrame:
    """(topic_id, edge): a little less than the k-th best score of each topic that has k."""
    return top_k(scores, "score", k, (topic,)).filter(F.col("rank") == k).select(topic, (F.col("score") - _MARGIN).alias("edge"))
