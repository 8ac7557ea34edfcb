"""The service's four requests as functions.

  find(index, text, options)                      top 10 for a free-text query
  find_by_topic(index, topics, id, set, options)  the topic and its ranked run
  evaluate_topics(index, topics, requested, qrels, options, name)
  evaluate_all(index, topics, topic_set, qrels, options, name)

``index`` is one Index, or Engines: one per engine, each with its own term
pipeline. Options: algorithm in BM25 / DFR / DFR_BM25 / BM25_PLUS_DFR and engine in
ELASTICSEARCH (field-max search) / TERRIER (document search). Every topic of
a request is scored in one plan, not one search per topic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.analysis import DEFAULT, PIPELINE
from rankspark.functions.models import ALGORITHMS, DEFAULT_K, ENGINE_MODES
from rankspark.functions.text import topic_text
from rankspark.operators import evaluate as E
from rankspark.operators.index import Index, build_index
from rankspark.operators.search import search, search_fused
from rankspark.sinks.outputs import latex_report, report_lines
from rankspark.sources.corpus import topic_by_id, topics_subset

FREE_TEXT_K = 10


@dataclass(frozen=True)
class Options:
    algorithm: str = "BM25"
    engine: str = "TERRIER"

    @property
    def mode(self) -> str:
        return ENGINE_MODES[self.engine]


@dataclass(frozen=True)
class Engines:
    """Field-max search splits words only; document search drops stop words and stems."""

    field_max: Index
    document: Index

    @staticmethod
    def build(docs: DataFrame, fields, id_col: str = "doc_id") -> "Engines":
        return Engines(build_index(docs, fields, id_col, DEFAULT), build_index(docs, fields, id_col, PIPELINE))

    def of(self, mode: str) -> Index:
        return self.field_max if mode == "field_max" else self.document


def run_for(index: Index | Engines, queries: DataFrame, options: Options, k: int | None = None) -> DataFrame:
    """Algorithm and engine dispatch to one batch search."""
    mode = options.mode
    index = index.of(mode) if isinstance(index, Engines) else index
    k = k or DEFAULT_K[mode]
    table = ALGORITHMS[mode]
    if options.algorithm == "BM25_PLUS_DFR":
        return search_fused(index, queries, table["BM25"], table["DFR"], mode, k)
    if options.algorithm not in table:
        raise ValueError(f"unknown algorithm {options.algorithm!r}")
    return search(index, queries, table[options.algorithm], mode, k)


def find(index: Index | Engines, text: str, options: Options = Options()) -> DataFrame:
    """Free-text search: the first 10 matches (H3)."""
    spark = (index.document if isinstance(index, Engines) else index).spark
    q = spark.createDataFrame([(0, text)], "topic_id int, text string")
    return run_for(index, q, options).filter(F.col("rank") <= FREE_TEXT_K)


def find_by_topic(index: Index | Engines, topics: DataFrame, topic_id: int, topic_set: str,
                  options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    topic = topic_by_id(topics, topic_set, topic_id)
    return topic, run_for(index, topic_text(topic), options)


def _evaluated(index, chosen: DataFrame, qrels: DataFrame, options: Options, name: str):
    """(summary, per-topic measures, LaTeX, report lines under the run's name)."""
    twice = chosen.groupBy("id").agg(F.count_distinct("topic_set").alias("n")).filter(F.col("n") > 1).first()
    if twice:
        raise ValueError(f"topic {twice['id']} is in several of the requested sets; judgements name topics by id only")
    by_topic, summary = E.evaluate(run_for(index, topic_text(chosen), options), qrels, check=True)
    return summary, by_topic, latex_report(summary), report_lines(summary, name)


def evaluate_topics(index: Index | Engines, topics: DataFrame, requested: DataFrame, qrels: DataFrame,
                    options: Options = Options(), name: str = "run"):
    """(summary, per-topic measures, LaTeX, report) for the requested (topic_set, id) list."""
    return _evaluated(index, topics_subset(topics, requested), qrels, options, name)


def evaluate_all(index: Index | Engines, topics: DataFrame, topic_set: str, qrels: DataFrame,
                 options: Options = Options(), name: str = "run"):
    return _evaluated(index, topics.filter(F.col("topic_set") == topic_set), qrels, options, name)
