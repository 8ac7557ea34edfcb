"""Batch ranked retrieval.

All topics are scored in one plan:

  query terms (topic, term, qtf)                      tiny, in-row counted
    ⋈ lexicon subset (df, cf)  ⋈ field statistics     broadcast, size-checked
    ⋈ postings on (field, term)                       of a stored index only the
                                                      files that can hold the
                                                      terms; broadcast hash join,
                                                      no shuffle of the postings
    → per-term contribution (model Column expression)
    → groupBy(topic, doc): sum per field / document   the one shuffle
    → top-k per topic: row_number ≤ k                 partial limit before the
                                                      exchange (WindowGroupLimit)

Several models can be scored in the same pass (fusion needs two).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.analysis import query_terms
from rankspark.functions.models import DEFAULT_K, contribution, contribution_bounds
from rankspark.operators.clustered import MAX_KEYS
from rankspark.operators.guards import BROADCAST_MAX_ROWS, checked_broadcast
from rankspark.operators.index import Index, repeated_ids
from rankspark.operators.store import Store
from rankspark.session import materialize

SCORE_DECIMALS = 6
#: Postings of the query terms beyond which a search looks for the first k only (a join would shuffle each topic and document).
PRUNE_POSTINGS = 10_000_000
RUN_COLUMNS = ["topic_id", "doc_id", "rank", "score"]


def _fields_for(index: Index, mode: str, fields) -> list[str]:
    if mode == "document":
        return [index.doc_field]
    if mode == "field_max":
        chosen = list(fields or index.fields)
        unknown = set(chosen) - set(index.fields)
        if unknown:
            raise ValueError(f"fields not indexed: {sorted(unknown)}")
        return chosen
    raise ValueError(f"unknown mode {mode!r}")


@dataclass(frozen=True)
class Asked:
    """Statistics of a batch's query terms; ``terms`` as a list, and a broadcast hint, where they are few."""
    stats: DataFrame
    terms: list[str] | None
    rows: int  # of (topic, term, field) at most


def asked(index: Index, queries: DataFrame, mode: str = "document", fields=None, max_rows: int = BROADCAST_MAX_ROWS) -> Asked:
    """(topic_id, field, term, qtf, df, cf, n, avgdl) per matched query term.

    Field-max statistics count only documents that have the field; document
    statistics count every document.
    """
    sel = _fields_for(index, mode, fields)
    # One count bounds everything: lexicon keys (field, term) are unique, so
    # there are at most |query terms| x |fields| rows.
    qt = materialize(query_terms(queries, index.analyzer), "query-terms")
    rows = qt.count() * len(sel)
    small = rows <= max_rows
    terms = qt.select("term").distinct()
    known = sorted(r["term"] for r in terms.collect()) if small else None
    lex = index.lexicon_of(sel, F.broadcast(terms) if small else terms, known)
    n_col = "n_docs" if mode == "document" else "n_with_field"
    stats = (index.stats.filter(F.col("field").isin(sel))
             .select("field", F.col(n_col).cast("double").alias("n"),
                     F.try_divide(F.col("total_len").cast("double"), F.col(n_col)).alias("avgdl")))
    qstats = (qt.join(lex, "term").join(F.broadcast(stats), "field")
              .select("topic_id", "field", "term", "qtf", "df", "cf", "n", "avgdl"))
    return Asked(F.broadcast(qstats) if small else qstats, known, rows)


def query_statistics(index: Index, queries: DataFrame, mode: str = "document", fields=None,
                     max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return asked(index, queries, mode, fields, max_rows).stats


def candidates(index: Index, qstats: DataFrame, fields: list[str], terms: list[str] | None = None) -> DataFrame:
    """Postings of the query terms (F1/F2), with their statistics attached; ``terms`` names them if they are few."""
    postings = index.postings_of(fields, terms).select("field", "term", "doc_id", "tf", "dl")
    return postings.join(qstats, ["field", "term"])


def score_table(index: Index, queries: DataFrame, models: dict, mode: str = "document", fields=None,
                max_rows: int = BROADCAST_MAX_ROWS, query: Asked | None = None) -> DataFrame:
    """(topic_id, doc_id, <label>...) raw scores for each ``label: (model, params)``.

    One aggregation for all models. Field-max takes, per model, the best
    field's sum (best_fields, no tie-breaker); document mode sums over terms.
    """
    sel = _fields_for(index, mode, fields)
    query = query or asked(index, queries, mode, fields, max_rows)
    cand = candidates(index, query.stats, sel, query.terms)
    contribs = {label: contribution(m, p) for label, (m, p) in models.items()}
    cand = cand.select("topic_id", "doc_id", "field",
                       *[c.alias(f"_w_{label}") for label, c in contribs.items()])
    aggs: list[Column] = []
    for label in models:
        w = F.col(f"_w_{label}")
        if mode == "document" or len(sel) == 1:
            aggs.append(F.sum(w).alias(label))
        else:
            per_field = [F.sum(F.when(F.col("field") == f, w)) for f in sel]
            aggs.append(F.greatest(*per_field).alias(label))
    return cand.groupBy("topic_id", "doc_id").agg(*aggs)


def top_k(scores: DataFrame, score_col: str, k: int, by: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Rank within ``by`` by rounded score desc, then doc_id; keep rank <= k (H1-H5)."""
    rounded = (scores.filter(F.col(score_col).isNotNull())
               .select(*by, "doc_id", F.round(F.col(score_col), SCORE_DECIMALS).alias("score")))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (rounded.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(*by, "doc_id", F.col("rank").cast("int").alias("rank"), "score"))


def search(index: Index, queries: DataFrame, model: str = "bm25_doc", mode: str = "document",
           k: int | None = None, params: dict | None = None, fields=None,
           max_rows: int = BROADCAST_MAX_ROWS, prune: bool | None = None) -> DataFrame:
    """Run (topic_id, doc_id, rank, score) for every query of ``queries``.

    ``queries`` has (topic_id, text). ``mode`` is "document" (all fields as one
    bag of words) or "field_max" (per-field statistics, best field wins).
    ``prune``: leave out what cannot be among the first k (``topk``); by
    default where the query terms have more than PRUNE_POSTINGS postings in a
    stored index, the model has a bound and no id repeats. The run is then the same.
    """
    k = k or DEFAULT_K[mode]
    query = asked(index, queries, mode, fields, max_rows)
    if prune:
        from rankspark.operators.topk import search_pruned

        return search_pruned(index, queries, model, mode, k, params, fields, max_rows, query).run
    matches = _matches(index, query, max_rows)
    if matches is None:
        return top_k(_scanned(index, query, [(model, params)], mode, fields, k), "score", k)
    if (prune is None and matches > PRUNE_POSTINGS and contribution_bounds(model, params) is not None
            and not repeated_ids(index, _fields_for(index, mode, fields)[0])):
        return search(index, queries, model, mode, k, params, fields, max_rows, True)
    return top_k(score_table(index, queries, {"s": (model, params)}, mode, fields, max_rows, query), "s", k)


def _matches(index: Index, query: Asked, max_rows: int) -> int | None:
    """Postings that the topics of a stored index ask for, each as often as it is asked for.

    None where the documents are to be scanned (``scan``): the batch is small
    enough to go to every task and asks for more than there are, or nothing is
    stored that would be read by term.
    """
    if query.rows > max_rows:
        return 0 if not index.segments else query.stats.agg(F.sum("df")).first()[0] or 0
    if not index.segments:
        return None
    matches = query.stats.agg(F.sum("df")).first()[0] or 0
    return matches if matches <= sum(s["postings"] for s in index.segments) else None


def _scanned(index: Index, query: Asked, models: list, mode: str, fields, k: int) -> DataFrame:
    from rankspark.operators.scan import search_scanned

    return search_scanned(index, query.stats, dict(enumerate(models)), _fields_for(index, mode, fields), k, SCORE_DECIMALS)


def fuse(run_first: DataFrame, run_second: DataFrame) -> DataFrame:
    """BM25_PLUS_DFR fusion.

    Concatenate the first run then the second, keep the first occurrence of
    each document (so a document in both keeps its first-run score), sort by
    raw score desc (stable: first run, then its own order) and number again.
    No cut.
    """
    return _fused(run_first.withColumn("src", F.lit(0)).unionByName(run_second.withColumn("src", F.lit(1))))


def _fused(both: DataFrame) -> DataFrame:
    """The first source's row of each (topic, document), numbered anew."""
    kept = both.groupBy("topic_id", "doc_id").agg(F.min(F.struct("src", "rank", "score")).alias("r"))
    order = Window.partitionBy("topic_id").orderBy(F.col("r.score").desc(), "r.src", "r.rank")
    return kept.select("topic_id", "doc_id", F.row_number().over(order).cast("int").alias("rank"),
                       F.col("r.score").alias("score"))


def search_fused(index: Index, queries: DataFrame, first: str, second: str, mode: str,
                 k: int | None = None, fields=None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Both runs from one candidate pass: each scored pair becomes a row per model, ranked once, then fused."""
    k = k or DEFAULT_K[mode]
    query = asked(index, queries, mode, fields, max_rows)
    if _matches(index, query, max_rows) is None:
        return _fused(top_k(_scanned(index, query, [(first, None), (second, None)], mode, fields, k), "score", k, ("topic_id", "src")))
    scores = score_table(index, queries, {"a": (first, None), "b": (second, None)}, mode, fields, max_rows, query)
    each = scores.select("topic_id", "doc_id", F.inline(F.array(
        F.struct(F.lit(0).alias("src"), F.col("a").alias("s")), F.struct(F.lit(1).alias("src"), F.col("b").alias("s")))))
    return _fused(top_k(each, "s", k, ("topic_id", "src")))


def match_all(articles: DataFrame, id_col: str = "id") -> DataFrame:
    """Every document with constant score 1.0."""
    return articles.select(F.col(id_col).alias("doc_id"), F.lit(1.0).alias("score"))


def lookup(articles: DataFrame | Store, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The stored articles of ``ids`` (column ``id_col``); an id without article fails.

    One read of the articles gives what is found, kept in the shared folder,
    and with it what is missing. The ids are counted and broadcast under the
    bound, so the articles are read where they lie (of a store only the files
    and row groups that can hold them); beyond it both sides are shuffled.
    """
    wanted, rows = checked_broadcast(ids.select(id_col).distinct())
    found = materialize(_stored(articles, wanted, rows, id_col).join(wanted, id_col, "left_semi"), "found")
    _all_stored(wanted, found, id_col)
    return found


def _stored(articles: DataFrame | Store, wanted: DataFrame, rows: int, id_col: str) -> DataFrame:
    if isinstance(articles, DataFrame):
        return articles
    known = [r[0] for r in wanted.select(id_col).distinct().collect()] if rows <= MAX_KEYS else None
    return articles.holding(known)


def _all_stored(wanted: DataFrame, found: DataFrame, id_col: str) -> None:
    missing = wanted.select(id_col).join(found.select(id_col), id_col, "left_anti").first()
    if missing:
        raise LookupError(f"no stored article {missing[0]}")


def enrich(run: DataFrame, articles: DataFrame | Store, id_col: str = "id", check: bool = True) -> DataFrame:
    """Attach the stored article to each hit (F4); a missing article fails.

    Done after top-k: the run (at most k rows per topic) is counted and
    broadcast under the bound, so articles are not shuffled for it. They are
    read once: the hits with their articles are kept in the shared folder.
    """
    hits, rows = checked_broadcast(run)
    stored = _stored(articles, hits.select(F.col("doc_id").alias(id_col)), rows, id_col).withColumnRenamed(id_col, "doc_id")
    if not check:
        return stored.join(hits, "doc_id")
    found = materialize(stored.join(hits, "doc_id"), "enriched")
    _all_stored(hits.select("doc_id").distinct(), found, "doc_id")
    return found
