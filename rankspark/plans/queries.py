"""Registered queries: one per operator of the survey's inventory.

Every query reads the driver tables (through the bindings of ``testbed``) and
runs over them whole. ``QUERIES[name](spark, sf_dir) -> DataFrame``;
``ORACLE[name]`` is the matching DuckDB SQL over the same tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.analysis import DEFAULT, ENGLISH_STOP_WORDS, PIPELINE, Analyzer, query_terms
from rankspark.functions.models import register_model, tf_idf
from rankspark.functions.text import ARTICLE_FIELDS, article_fields, topic_text
from rankspark.operators import evaluate as E
from rankspark.operators.index import (Index, add_documents, build_index, forward_by_ids, forward_index, merge_index,
                                       merge_term_ids, read_index, remap_forward, stem_map, stemmed_index, term_ids, write_index)
from rankspark.operators.ingest import append_articles, insert_if_absent
from rankspark.operators.search import candidates, enrich, lookup, match_all, query_statistics, search, search_fused
from rankspark.operators.store import Store, read_store, write_store
from rankspark.plans import oracle as O
from rankspark.plans import testbed as T
from rankspark.plans.requests import Engines, Options, evaluate_topics, find, run_for
from rankspark.session import materialize, scratch_path
from rankspark.sinks import outputs as S
from rankspark.sources import corpus as C

RUN_NAME = "rankspark"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- indexes

def doc_index(spark: SparkSession, sf_dir: str, **kw) -> Index:
    """Single-field index over documents.text."""
    return build_index(T.table(spark, sf_dir, "documents"), fields=("text",), id_col="doc_id", **kw)


def article_index(spark: SparkSession, sf_dir: str, **kw) -> Index:
    """Four-field article index plus the whole-document field."""
    return build_index(article_fields(T.articles_view(spark, sf_dir)), fields=ARTICLE_FIELDS,
                       id_col="doc_id", **kw)


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str, analyzer: Analyzer = DEFAULT) -> Index:
    """The index of a data folder, built and written once per session, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, analyzer)
    if key not in _STORED:
        build = doc_index if kind == "docs" else article_index
        path = scratch_path(spark, f"index-{kind}")
        write_index(build(spark, sf_dir, analyzer=analyzer), path)
        _STORED[key] = path
    return read_index(spark, _STORED[key])


def article_store(spark: SparkSession, sf_dir: str) -> Store:
    """The articles of a data folder clustered by id, written once per session, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir, "store")
    if key not in _STORED:
        path = scratch_path(spark, "articles")
        write_store(T.articles_view(spark, sf_dir), path)
        _STORED[key] = path
    return read_store(spark, _STORED[key])


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_text(T.topics_all(spark, sf_dir))


# ---------------------------------------------------------------- search runs

@register("run_bm25_flat", O.run_sql("docs", O.FREE_QUERIES, "bm25_field", "field_max", 20))
def run_bm25_flat(spark, sf_dir):
    """G1 over the single field text, top 20 per benchmark item (flagship)."""
    return search(stored(spark, sf_dir, "docs"), T.free_text_queries(spark, sf_dir),
                  model="bm25_field", mode="field_max", k=20)


@register("run_bm25_fieldmax", O.run_sql("articles", O.TOPIC_QUERIES, "bm25_field", "field_max", 1000))
def run_bm25_fieldmax(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="bm25_field", mode="field_max", k=1000)


@register("run_dfr_fieldmax", O.run_sql("articles", O.TOPIC_QUERIES, "dfr_gbh2", "field_max", 1000))
def run_dfr_fieldmax(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="dfr_gbh2", mode="field_max", k=1000)


@register("run_dfrbm25_fieldmax", O.run_sql("articles", O.TOPIC_QUERIES, "dfr_bm25", "field_max", 1000))
def run_dfrbm25_fieldmax(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="dfr_bm25", mode="field_max", k=1000)


@register("run_bm25_doc", O.run_sql("articles", O.TOPIC_QUERIES, "bm25_doc", "document", 20))
def run_bm25_doc(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="bm25_doc", mode="document", k=20)


@register("run_bm25_doc_pipeline", O.run_sql("articles", O.TOPIC_QUERIES, "bm25_doc", "document", 20,
                                             stop=ENGLISH_STOP_WORDS, stem=True))
def run_bm25_doc_pipeline(spark, sf_dir):
    """The document engine with its own term pipeline (stop words, stemming), through the dispatch."""
    engines = Engines(stored(spark, sf_dir, "articles"), stored(spark, sf_dir, "articles", PIPELINE))
    return run_for(engines, topic_queries(spark, sf_dir), Options("BM25", "TERRIER"))


@register("run_dfr_doc", O.run_sql("articles", O.TOPIC_QUERIES, "bb2", "document", 20))
def run_dfr_doc(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="bb2", mode="document", k=20)


@register("run_dfrbm25_doc", O.run_sql("articles", O.TOPIC_QUERIES, "dfr_bm25", "document", 20))
def run_dfrbm25_doc(spark, sf_dir):
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="dfr_bm25", mode="document", k=20)


def _topk(kind: str, queries, model: str, mode: str, k: int):
    def q(spark, sf_dir):
        """H1/H2 with G0a/G0b: the same run without scoring every match, by bounds of the stored blocks."""
        return search(stored(spark, sf_dir, kind), queries(spark, sf_dir), model=model, mode=mode, k=k, prune=True)
    return q


for _name, _kind, _model, _mode, _k in (
        ("topk_bm25_flat", "docs", "bm25_field", "field_max", 20), ("topk_bm25_fieldmax", "articles", "bm25_field", "field_max", 1000),
        ("topk_bm25_doc", "articles", "bm25_doc", "document", 20), ("topk_dfr_fieldmax", "articles", "dfr_gbh2", "field_max", 20),
        ("topk_dfr_doc", "articles", "bb2", "document", 20), ("topk_first", "docs", "bm25_doc", "document", 1)):
    register(_name, O.run_sql(_kind, O.TOPIC_QUERIES if _kind == "articles" else O.FREE_QUERIES, _model, _mode, _k))(
        _topk(_kind, topic_queries if _kind == "articles" else T.free_text_queries, _model, _mode, _k))


@register("run_bm25_doc_stem_map", ORACLE["run_bm25_doc_pipeline"])
def run_bm25_doc_stem_map(spark, sf_dir):
    """The same run over an index stemmed through the map of its distinct terms, not token by token."""
    plain = stored(spark, sf_dir, "articles", Analyzer(stop_words=ENGLISH_STOP_WORDS))
    return search(stemmed_index(plain), topic_queries(spark, sf_dir), "bm25_doc", "document", 20)


def _dispatched(name: str, kind: str, queries, options: Options, sql: str):
    @register(name, sql)
    def q(spark, sf_dir):
        """Algorithm and engine of a request through the dispatch."""
        return run_for(stored(spark, sf_dir, kind), queries(spark, sf_dir), options)


_dispatched("request_dfr_fieldmax", "articles", topic_queries, Options("DFR", "ELASTICSEARCH"), ORACLE["run_dfr_fieldmax"])
_dispatched("request_fusion_doc", "articles", topic_queries, Options("BM25_PLUS_DFR", "TERRIER"),
            "WITH " + O.fused_cte_sql("articles", O.TOPIC_QUERIES, "bm25_doc", "bb2", "document", 20) + "\n"
            + O.RUN_SELECT.format(src="x_fused"))


# The explorer script's parameter sets: b=0 with k1=0.9.
BM25_NO_LENGTH = {"k1": 0.9, "b": 0.0}


@register("run_bm25_params", O.run_sql("docs", O.FREE_QUERIES, "bm25_field", "field_max", 20,
                                       params=BM25_NO_LENGTH))
def run_bm25_params(spark, sf_dir):
    return search(stored(spark, sf_dir, "docs"), T.free_text_queries(spark, sf_dir),
                  model="bm25_field", mode="field_max", k=20, params=BM25_NO_LENGTH)


@register("run_fields_subset", O.run_sql("articles", O.TOPIC_QUERIES, "bm25_field", "field_max", 1000,
                                         fields=("title", "abstract")))
def run_fields_subset(spark, sf_dir):
    """Field-max over a chosen field list (title, content)."""
    return search(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                  model="bm25_field", mode="field_max", k=1000, fields=("title", "abstract"))


@register("run_custom_model", O.run_sql("docs", O.FREE_QUERIES, "tf_idf", "document", 20))
def run_custom_model(spark, sf_dir):
    """K1: a model added through the registry (tf-idf)."""
    register_model("tf_idf", tf_idf)
    return search(stored(spark, sf_dir, "docs"), T.free_text_queries(spark, sf_dir),
                  model="tf_idf", mode="document", k=20)


@register("run_fusion_doc", "WITH " + O.fused_cte_sql("articles", O.TOPIC_QUERIES, "bm25_doc", "bb2",
                                                      "document", 20)
          + "\n" + O.RUN_SELECT.format(src="x_fused"))
def run_fusion_doc(spark, sf_dir):
    return search_fused(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                        "bm25_doc", "bb2", "document", k=20)


@register("run_fusion_fieldmax", "WITH " + O.fused_cte_sql("articles", O.TOPIC_QUERIES, "bm25_field",
                                                           "dfr_gbh2", "field_max", 1000)
          + "\n" + O.RUN_SELECT.format(src="x_fused"))
def run_fusion_fieldmax(spark, sf_dir):
    return search_fused(stored(spark, sf_dir, "articles"), topic_queries(spark, sf_dir),
                        "bm25_field", "dfr_gbh2", "field_max", k=1000)


@register("find_text", O.run_sql("docs", O.FREE_QUERIES, "bm25_doc", "document", 10))
def find_text(spark, sf_dir):
    """H3: free-text search, first 10 per query, for every benchmark text."""
    return search(stored(spark, sf_dir, "docs"), T.free_text_queries(spark, sf_dir),
                  model="bm25_doc", mode="document", k=10)


@register("request_find", O.run_sql("docs", "SELECT 0 AS topic_id, text FROM benchmark ORDER BY item_id LIMIT 1",
                                    "bm25_field", "field_max", 10))
def request_find(spark, sf_dir):
    """The find request: ten best documents for one free text (that of the first item)."""
    text = T.table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return find(stored(spark, sf_dir, "docs"), text, Options("BM25", "ELASTICSEARCH"))


# ---------------------------------------------------------------- evaluation

EVAL_RUN_SQL = O.run_cte_sql("articles", O.TOPIC_QUERIES, "bm25_field", "field_max", 1000)
EVAL_CTES = "WITH " + O.eval_ctes(EVAL_RUN_SQL)


def eval_inputs(spark, sf_dir):
    """The field-max BM25 run of all topics (k=1000) and the judgements, written once as the measures read them twice."""
    return run_bm25_fieldmax(spark, sf_dir), materialize(T.qrels_view(spark, sf_dir), "qrels")


def by_topic(spark, sf_dir):
    run, qrels = eval_inputs(spark, sf_dir)
    return E.evaluate_by_topic(run, qrels, check=True)


@register("request_evaluate_topics", EVAL_CTES + "\nSELECT * FROM e_topic WHERE topic_id IN (SELECT topic_id FROM e_q WHERE rel = 2)")
def request_evaluate_topics(spark, sf_dir):
    """The evaluate-topics request for every topic that some document has in full."""
    qrels = T.qrels_view(spark, sf_dir)
    asked = qrels.filter("rel = 2").select(F.lit(T.TOPIC_SET).alias("topic_set"), F.col("topic_id").alias("id")).distinct()
    return evaluate_topics(stored(spark, sf_dir, "articles"), T.topics_all(spark, sf_dir), asked, qrels,
                           Options("BM25", "ELASTICSEARCH"), RUN_NAME)[1]


def _measure_cols(prefixes) -> list[str]:
    names = [n for n, *_ in E.measure_specs() + E.DERIVED]
    return [n for n in names if any(n == p or n.startswith(p) for p in prefixes)]


EVAL_GROUPS = {
    "eval_counts": ["num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret"],
    "eval_map": ["map", "map_cut_"],
    "eval_rprec": ["Rprec", "Rprec_mult_"],
    "eval_bpref": ["bpref"],
    "eval_recip_rank": ["recip_rank"],
    "eval_iprec": ["iprec_at_recall_", "11pt_avg"],
    "eval_cutoffs": ["P_", "recall_", "relative_P_", "ndcg_cut_"],
    "eval_success": ["success_"],
    "eval_ndcg": ["ndcg", "ndcg_cut_"],
    "eval_set": ["set_P", "set_recall", "set_relative_P", "set_F", "set_map", "utility"],
    "eval_infap": ["infAP"],
}


def _group_query(cols):
    def q(spark, sf_dir):
        return by_topic(spark, sf_dir).select("topic_id", *[f"`{c}`" for c in cols])
    return q


for _name, _prefixes in EVAL_GROUPS.items():
    _cols = _measure_cols(_prefixes)
    register(_name, EVAL_CTES + "\nSELECT topic_id, " + ", ".join(f'"{c}"' for c in _cols)
             + " FROM e_topic")(_group_query(_cols))


@register("eval_by_topic", EVAL_CTES + "\nSELECT * FROM e_topic")
def eval_by_topic(spark, sf_dir):
    return by_topic(spark, sf_dir)


@register("eval_summary", EVAL_CTES + "\n" + O.eval_summary_select())
def eval_summary(spark, sf_dir):
    return E.summary(by_topic(spark, sf_dir))


@register("eval_judged", EVAL_CTES + "\nSELECT topic_id::INTEGER AS topic_id, doc_id::BIGINT AS doc_id, pos::INTEGER AS pos, "
          "rel::DOUBLE AS rel, cr AS cum_rel, cn AS cum_nonrel, cp AS cum_pool FROM e_base")
def eval_judged(spark, sf_dir):
    run, qrels = eval_inputs(spark, sf_dir)
    return E.judged_run(run, qrels).select("topic_id", "doc_id", F.col("pos").cast("int").alias("pos"),
                                           F.col("rel").cast("double").alias("rel"),
                                           "cum_rel", "cum_nonrel", "cum_pool")


@register("eval_topics", EVAL_CTES + "\nSELECT DISTINCT topic_id FROM e_run")
def eval_topics(spark, sf_dir):
    """topics evaluated = topics in both the run and the judgements."""
    run, qrels = eval_inputs(spark, sf_dir)
    return (run.select("topic_id").distinct()
            .join(qrels.select("topic_id").distinct(), "topic_id", "left_semi"))


@register("eval_relstring", EVAL_CTES + """
SELECT topic_id, string_agg(CASE WHEN rel IS NULL THEN '-' WHEN rel < 0 THEN '<' WHEN rel > 9 THEN '>' ELSE rel::INTEGER::VARCHAR END,
                            '' ORDER BY pos) AS relstring_10
FROM e_base WHERE pos <= 10 GROUP BY topic_id""")
def eval_relstring(spark, sf_dir):
    """The grades of the first ten documents of each topic as one string."""
    return E.relevance_strings(*eval_inputs(spark, sf_dir))


@register("qrels_view", O.QRELS)
def qrels_view(spark, sf_dir):
    return T.qrels_view(spark, sf_dir)


# ---------------------------------------------------------------- sources, projections

ART_FLAT_SQL = (f"SELECT id, title, abstract, array_to_string(keywords, '|') AS keywords, "
                f"array_to_string(list_transform(meshHeadings, lambda m: m.description || '/' || m.name), '|') "
                f"AS mesh FROM ({O.ARTICLES})")


def _mesh(mesh):
    return F.array_join(F.transform(mesh, lambda m: F.concat_ws("/", m["description"], m["name"])), "|")


def flat_articles(a: DataFrame) -> DataFrame:
    return a.select("id", "title", "abstract", F.array_join("keywords", "|").alias("keywords"), _mesh("meshHeadings").alias("mesh"))


@register("articles_view", ART_FLAT_SQL)
def articles_view_q(spark, sf_dir):
    """The article model over documents (nested parts flattened for comparison)."""
    return flat_articles(T.articles_view(spark, sf_dir))


@register("field_text", O.ARTICLE_WIDE)
def field_text(spark, sf_dir):
    """C4, D3: per-field searchable text."""
    return article_fields(T.articles_view(spark, sf_dir))


@register("topics_all", O.TOPICS)
def topics_all_q(spark, sf_dir):
    return T.topics_all(spark, sf_dir)


@register("topic_text", O.TOPIC_QUERIES)
def topic_text_q(spark, sf_dir):
    return topic_queries(spark, sf_dir)


@register("topic_by_id", f"SELECT * FROM ({O.TOPICS}) WHERE topic_set = 'bench' AND id = 1")
def topic_by_id_q(spark, sf_dir):
    """One topic by (set, id); a missing topic raises."""
    return C.topic_by_id(T.topics_all(spark, sf_dir), "bench", 1)


@register("topics_subset", f"SELECT * FROM ({O.TOPICS}) WHERE id IN (SELECT topic_id FROM ({O.QRELS}) WHERE rel = 2)")
def topics_subset_q(spark, sf_dir):
    """The topics a request names; here: every topic with a passage judgement."""
    req = (T.qrels_view(spark, sf_dir).filter(F.col("rel") == 2)
           .select(F.lit(T.TOPIC_SET).alias("topic_set"), F.col("topic_id").alias("id")).distinct())
    return C.topics_subset(T.topics_all(spark, sf_dir), req)


@register("doc_lookup", ART_FLAT_SQL + " WHERE id IN (SELECT doc_id FROM labels)")
def doc_lookup(spark, sf_dir):
    """Stored articles by id (ids from the labels table), whole; an unknown id fails."""
    ids = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return flat_articles(lookup(article_store(spark, sf_dir), ids))


@register("xml_roundtrip", ART_FLAT_SQL)
def xml_roundtrip(spark, sf_dir):
    """Articles written as XML and read back by the corpus reader."""
    path = scratch_path(spark, "xml")
    C.write_articles_xml(T.articles_view(spark, sf_dir), path)
    return flat_articles(C.read_articles(spark, path))


@register("topics_xml_roundtrip", O.TOPICS)
def topics_xml_roundtrip(spark, sf_dir):
    """A4: the topic set written as XML and read back."""
    path = scratch_path(spark, "topics")
    C.write_topics_xml(T.topics_all(spark, sf_dir), path)
    return C.read_topics(spark, path, T.TOPIC_SET)


@register("match_all", "SELECT doc_id, 1e0 AS score FROM documents")
def match_all_q(spark, sf_dir):
    return match_all(T.articles_view(spark, sf_dir))


@register("json_roundtrip", ART_FLAT_SQL)
def json_roundtrip(spark, sf_dir):
    """Article -> JSON document -> article."""
    return flat_articles(S.from_json_documents(S.to_json_documents(T.articles_view(spark, sf_dir))))


@register("insert_if_absent", "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'existing' ELSE 'inserted' END AS origin, "
                              "CASE WHEN lang = 'en' THEN 0 ELSE doc_id % 3 + 1 END::INTEGER AS copy FROM documents")
def insert_if_absent_q(spark, sf_dir):
    """existing = English articles; a batch of three copies of every article, of which the first in the batch's
    order counts; only new ids are added, and a second call of the same batch adds none."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    existing = docs.filter(F.col("lang") == "en").select("id", F.lit(0).alias("copy"))
    path = scratch_path(spark, "inserted")
    # Copy k of an id stands at place (k - 1 - id) mod 3: copy id % 3 + 1 comes first.
    batch = docs.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("copy"))
    batch = batch.withColumn("place", F.pmod(F.col("copy") - 1 - F.col("id"), F.lit(3)))
    for _ in range(2):
        append_articles(existing, batch, path, "id", order_col="place", batch_key="0001")
    new = spark.read.parquet(path)
    return (existing.select("id", F.lit("existing").alias("origin"), "copy")
            .unionByName(new.select("id", F.lit("inserted").alias("origin"), "copy")))


@register("corpus_files", ART_FLAT_SQL)
def corpus_files(spark, sf_dir):
    """A1/A2: a corpus folder of plain and gzip files, listed and read file by file in the order of their paths."""
    path = scratch_path(spark, "corpus")
    arts = T.articles_view(spark, sf_dir)
    for k, codec in enumerate(("none", "gzip")):
        C.write_articles_xml(arts.filter(F.pmod(F.coalesce("id", F.lit(0)), F.lit(2)) == k), f"{path}/part={k}", codec)
    files = C.list_corpus_files(spark, path)
    return flat_articles(C.read_articles(spark, path, max_files=len(files)))


# ---------------------------------------------------------------- analysis

TOKENS_SQL = (f"SELECT doc_id, len(tk)::INTEGER AS n_tokens, array_to_string(tk, ' ') AS tokens "
              f"FROM (SELECT doc_id, {O.tokens('text')} AS tk FROM documents)")
_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
TOKENS_NOSTOP_SQL = (f"SELECT doc_id, len(tk)::INTEGER AS n_tokens, array_to_string(tk, ' ') AS tokens "
                     f"FROM (SELECT doc_id, list_filter({O.tokens('text')}, lambda s: NOT list_contains([{_STOP}], s)) "
                     f"AS tk FROM documents)")


def _tokens_q(analyzer):
    def q(spark, sf_dir):
        t = analyzer.tokens("text")
        return T.table(spark, sf_dir, "documents").select(
            "doc_id", F.size(t).cast("int").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))
    return q


register("tokens", TOKENS_SQL)(_tokens_q(Analyzer()))
register("tokens_nostop", TOKENS_NOSTOP_SQL)(_tokens_q(Analyzer(stop_words=ENGLISH_STOP_WORDS)))


@register("lexicon_stemmed", "WITH " + O.index_ctes(O.DOCS_WIDE, ("text",), None, ENGLISH_STOP_WORDS, True)
          + "\nSELECT term, df, cf FROM x_lex")
def lexicon_stemmed(spark, sf_dir):
    """Lexicon under the stop-word + stemming pipeline."""
    return doc_index(spark, sf_dir, analyzer=PIPELINE).lexicon.select("term", "df", "cf")


@register("stem_map", "WITH " + O.index_ctes(O.DOCS_WIDE, ("text",), None) + f"""
SELECT term, {O.sql_s_stem('term')} AS stem FROM x_lex""")
def stem_map_q(spark, sf_dir):
    """The stem of every distinct term."""
    return stem_map(stored(spark, sf_dir, "docs").lexicon)


@register("query_terms", f"""SELECT topic_id, term, count(*)::INTEGER AS qtf
FROM (SELECT topic_id::INTEGER AS topic_id, unnest({O.tokens('text')}) AS term FROM ({O.TOPIC_QUERIES}))
GROUP BY topic_id, term""")
def query_terms_q(spark, sf_dir):
    """Query-term multiplicity per topic."""
    return query_terms(topic_queries(spark, sf_dir))


# ---------------------------------------------------------------- index tables

DOCS_IDX = "WITH " + O.index_ctes(O.DOCS_WIDE, ("text",), None)
ART_IDX = "WITH " + O.index_ctes(O.ARTICLE_WIDE, ARTICLE_FIELDS, "_doc")


@register("postings", DOCS_IDX + """
SELECT p.field, p.term, p.doc_id, p.tf::INTEGER AS tf, d.dl::INTEGER AS dl
FROM x_post p JOIN x_dl d ON d.doc_id = p.doc_id AND d.field = p.field""")
def postings_q(spark, sf_dir):
    """(field, term, doc, tf, dl) built in-row, no shuffle."""
    return doc_index(spark, sf_dir).postings


@register("doc_lengths", ART_IDX + "\nSELECT doc_id, field, dl::INTEGER AS dl FROM x_dl")
def doc_lengths(spark, sf_dir):
    return article_index(spark, sf_dir).doclen


@register("lexicon", ART_IDX + "\nSELECT field, term, df, cf FROM x_lex")
def lexicon_q(spark, sf_dir):
    return article_index(spark, sf_dir).lexicon


@register("collection_stats", ART_IDX + "\nSELECT field, n_docs, n_with_field, total_len FROM x_st")
def collection_stats(spark, sf_dir):
    return article_index(spark, sf_dir).stats


def _halves(spark, sf_dir):
    """Two indexes over a natural split of the corpus (English / the rest)."""
    docs = T.table(spark, sf_dir, "documents")
    en = F.coalesce(F.col("lang"), F.lit("")) == "en"
    a = build_index(docs.filter(en), ("text",))
    b = build_index(docs.filter(~en), ("text",))
    return merge_index(a, b)


@register("merge_stored_index", DOCS_IDX + """
SELECT p.field, p.term, p.doc_id, p.tf::INTEGER AS tf, d.dl::INTEGER AS dl, l.df, l.cf
FROM x_post p JOIN x_dl d ON d.doc_id = p.doc_id AND d.field = p.field JOIN x_lex l ON l.field = p.field AND l.term = p.term""")
def merge_stored_index(spark, sf_dir):
    """One half written, the other merged into it as a new version, read back."""
    docs = T.table(spark, sf_dir, "documents")
    en = F.coalesce(F.col("lang"), F.lit("")) == "en"
    path, other = scratch_path(spark, "merged"), scratch_path(spark, "half")
    first = write_index(build_index(docs.filter(en), ("text",)), path)
    second = write_index(build_index(docs.filter(~en), ("text",)), other)
    write_index(merge_index(first, second), path)
    idx = read_index(spark, path)
    return idx.postings.join(idx.lexicon, ["field", "term"])


def _in_batches(spark, sf_dir) -> Index:
    """An index of the English documents to which the other languages come as three batches."""
    docs = T.table(spark, sf_dir, "documents")
    lang = F.coalesce(F.col("lang"), F.lit(""))
    path = scratch_path(spark, "batches")
    write_index(build_index(docs.filter(lang == "en"), ("text",)), path)
    third = F.pmod(F.col("doc_id"), F.lit(3))
    for k in range(3):
        add_documents(spark, path, docs.filter((lang != "en") & (F.coalesce(third, F.lit(0)) == k)), compact=k == 2)
    return read_index(spark, path)


@register("batches_lexicon", DOCS_IDX + "\nSELECT field, term, df, cf FROM x_lex")
def batches_lexicon(spark, sf_dir):
    """Statistics of four segments summed equal one build's."""
    return _in_batches(spark, sf_dir).lexicon


@register("batches_search", O.run_sql("docs", O.FREE_QUERIES, "bm25_doc", "document", 20))
def batches_search(spark, sf_dir):
    """A search over an index that grew by batches equals one over one build."""
    return search(_in_batches(spark, sf_dir), T.free_text_queries(spark, sf_dir), "bm25_doc", "document", 20)


@register("stored_forward_index", DOCS_IDX + """
SELECT doc_id, field, string_agg(term || ':' || tf, ' ' ORDER BY term) AS entries
FROM x_post GROUP BY doc_id, field""")
def stored_forward_index(spark, sf_dir):
    """The direct index of a stored index that grew by batches, read as it is stored."""
    return _entry_lines(forward_index(_in_batches(spark, sf_dir)))


SHIFT = 10_000_000


@register("merge_shifted_ids", DOCS_IDX + f"""
SELECT p.field, p.term, p.doc_id + s.shift AS doc_id, p.tf::INTEGER AS tf, d.dl::INTEGER AS dl
FROM x_post p JOIN x_dl d ON d.doc_id = p.doc_id AND d.field = p.field, (SELECT unnest([0, {SHIFT}])::BIGINT AS shift) s""")
def merge_shifted_ids(spark, sf_dir):
    """E5: an index merged with itself, the second side's ids shifted."""
    idx = doc_index(spark, sf_dir)
    return merge_index(idx, doc_index(spark, sf_dir), shift_ids=SHIFT).postings


@register("index_roundtrip", DOCS_IDX + "\nSELECT field, term, df, cf FROM x_lex")
def index_roundtrip(spark, sf_dir):
    """The lexicon of the stored index."""
    return stored(spark, sf_dir, "docs").lexicon


@register("merge_postings", DOCS_IDX + """
SELECT p.field, p.term, p.doc_id, p.tf::INTEGER AS tf, d.dl::INTEGER AS dl
FROM x_post p JOIN x_dl d ON d.doc_id = p.doc_id AND d.field = p.field""")
def merge_postings(spark, sf_dir):
    """E5: postings of the two halves appended equal one build."""
    return _halves(spark, sf_dir).postings


@register("merge_lexicon", DOCS_IDX + "\nSELECT field, term, df, cf FROM x_lex")
def merge_lexicon(spark, sf_dir):
    """Lexicons summed per term (full outer join semantics)."""
    return _halves(spark, sf_dir).lexicon


@register("merge_doclens", DOCS_IDX + "\nSELECT doc_id, field, dl::INTEGER AS dl FROM x_dl")
def merge_doclens(spark, sf_dir):
    """Document tables appended."""
    return _halves(spark, sf_dir).doclen


@register("term_ids", DOCS_IDX + "\nSELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id FROM x_lex")
def term_ids_q(spark, sf_dir):
    """Dense term ids in term order, without a single-partition window."""
    return term_ids(doc_index(spark, sf_dir).lexicon, "text")


@register("forward_index", DOCS_IDX + """
SELECT doc_id, field, string_agg(term || ':' || tf, ' ' ORDER BY term) AS entries
FROM x_post GROUP BY doc_id, field""")
def forward_index_q(spark, sf_dir):
    """Doc -> term-sorted (term, tf) list (flattened to text)."""
    return _entry_lines(forward_index(doc_index(spark, sf_dir)))


def _entry_lines(fwd: DataFrame) -> DataFrame:
    return fwd.select(
        "doc_id", "field",
        F.array_join(F.transform("entries", lambda e: F.concat(e["term"], F.lit(":"), e["tf"].cast("string"))),
                     " ").alias("entries"))


def _id_lines(forward: DataFrame) -> DataFrame:
    pairs = F.transform("entries", lambda e: F.concat(e["term_id"].cast("string"), F.lit(":"), e["tf"].cast("string")))
    return forward.select("doc_id", "field", F.array_join(pairs, " ").alias("entries"))


def _merged_by_ids(spark, sf_dir, keep_first: bool) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    en = F.coalesce(F.col("lang"), F.lit("")) == "en"
    sides = [build_index(docs.filter(x), ("text",)) for x in (en, ~en)]
    ids = [term_ids(i.lexicon, "text") for i in sides]
    lists = [forward_by_ids(forward_index(i), d) for i, d in zip(sides, ids)]
    _, *maps = merge_term_ids(*ids, keep_first)
    return _id_lines(remap_forward(lists[0], maps[0]).unionByName(remap_forward(lists[1], maps[1])))


@register("merge_term_ids", DOCS_IDX + """,
ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM x_lex)
SELECT doc_id, field, string_agg(id || ':' || tf, ' ' ORDER BY id) AS entries FROM x_post JOIN ids USING (term) GROUP BY doc_id, field""")
def merge_term_ids_q(spark, sf_dir):
    """Two direct indexes with dense ids of their own merged: one dictionary, both sides' lists under its ids."""
    return _merged_by_ids(spark, sf_dir, False)


@register("merge_term_ids_kept", DOCS_IDX + """,
en AS (SELECT doc_id FROM documents WHERE lang = 'en'),
side AS (SELECT term, max((doc_id IN (SELECT doc_id FROM en))::INTEGER) AS mine FROM x_post GROUP BY term),
ids AS (SELECT term, row_number() OVER (ORDER BY mine DESC, term) - 1 AS id FROM side)
SELECT doc_id, field, string_agg(id || ':' || tf, ' ' ORDER BY id) AS entries FROM x_post JOIN ids USING (term) GROUP BY doc_id, field""")
def merge_term_ids_kept(spark, sf_dir):
    """E8 with the first side's ids kept: the second side's own terms are numbered after them."""
    return _merged_by_ids(spark, sf_dir, True)


@register("match_candidates", DOCS_IDX + f""",
q AS (SELECT topic_id, term, count(*)::INTEGER AS qtf
      FROM (SELECT topic_id::INTEGER AS topic_id, unnest({O.tokens('text')}) AS term FROM ({O.TOPIC_QUERIES}))
      GROUP BY topic_id, term)
SELECT q.topic_id, p.term, q.qtf, l.df, count(*) AS n_docs, sum(p.tf)::BIGINT AS sum_tf, sum(p.doc_id)::BIGINT AS sum_ids
FROM q JOIN x_post p ON p.term = q.term JOIN x_lex l ON l.term = p.term AND l.field = p.field GROUP BY ALL""")
def match_candidates(spark, sf_dir):
    """query terms joined to postings (any term matches), summed per (topic, term)."""
    idx = stored(spark, sf_dir, "docs")
    found = candidates(idx, query_statistics(idx, topic_queries(spark, sf_dir), "field_max"), ["text"])
    return found.groupBy("topic_id", "term", "qtf", "df").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("sum_tf"), F.sum("doc_id").alias("sum_ids"))


# ---------------------------------------------------------------- joins after ranking, sinks

DOC_RUN_CTES = O.run_cte_sql("articles", O.TOPIC_QUERIES, "bm25_doc", "document", 20)


_MESH_SQL = "array_to_string(list_transform(a.meshHeadings, lambda m: m.description || '/' || m.name), '|')"


@register("run_enriched", "WITH " + DOC_RUN_CTES + f""",
a AS ({O.ARTICLES})
SELECT r.topic_id::INTEGER AS topic_id, r.doc_id::BIGINT AS doc_id, r.rank::INTEGER AS rank, r.score::DOUBLE AS score,
       a.title, a.abstract, array_to_string(a.keywords, '|') AS keywords, {_MESH_SQL} AS mesh
FROM x_run r JOIN a ON a.id = r.doc_id""")
def run_enriched(spark, sf_dir):
    """each ranked hit with its whole stored article (after top-k); a missing article fails."""
    out = enrich(run_bm25_doc(spark, sf_dir), article_store(spark, sf_dir))
    return out.select("topic_id", "doc_id", "rank", "score", "title", "abstract",
                      F.array_join("keywords", "|").alias("keywords"), _mesh("meshHeadings").alias("mesh"))


@register("response_nested", "WITH " + DOC_RUN_CTES + f""",
a AS ({O.ARTICLES})
SELECT topic_id::INTEGER AS topic_id, count(*) AS n_docs,
       string_agg(rank || ':' || printf('%.6f', score) || ':' || doc_id || ':' || a.title || ':' || a.abstract || ':'
                  || array_to_string(a.keywords, '|') || ':' || {_MESH_SQL}, chr(10) ORDER BY rank) AS documents
FROM x_run r JOIN a ON a.id = r.doc_id GROUP BY topic_id""")
def response_nested(spark, sf_dir):
    """Per topic, the ranked documents with their whole articles (flattened for comparison)."""
    nested = S.nested_response(run_bm25_doc(spark, sf_dir), article_store(spark, sf_dir))

    def shown(d):
        a = d["article"]
        return F.concat_ws(":", d["rank"].cast("string"), F.format_string("%.6f", d["score"]), a["doc_id"].cast("string"),
                           a["title"], a["abstract"], F.array_join(a["keywords"], "|"), _mesh(a["meshHeadings"]))

    return nested.select("topic_id", F.size("documents").cast("bigint").alias("n_docs"),
                         F.array_join(F.transform("documents", shown), "\n").alias("documents"))


@register("response_records", "WITH " + DOC_RUN_CTES + f""",
t AS ({O.TOPICS})
SELECT t.id AS topic_id, t.topic_set || '|' || t.id || '|' || t.disease || '|' || t.gene || '|' || t.treatment AS request,
       'BM25/TERRIER' AS options, count(r.doc_id) AS n_docs, coalesce(string_agg(r.doc_id::VARCHAR, ' ' ORDER BY r.rank), '') AS ids
FROM t LEFT JOIN x_run r ON r.topic_id = t.id GROUP BY ALL""")
def response_records(spark, sf_dir):
    """The whole record of each topic: what was asked, the options, and the documents (flattened for comparison)."""
    topics = T.topics_all(spark, sf_dir)
    out = S.response(run_bm25_doc(spark, sf_dir), article_store(spark, sf_dir), topics.withColumn("topic_id", F.col("id")),
                     "BM25", "TERRIER")
    ids = F.transform("documents", lambda d: d["article"]["doc_id"].cast("string"))
    return out.select("topic_id", F.concat_ws("|", *[F.col("request")[c].cast("string") for c in ("topic_set", "id", "disease", "gene", "treatment")])
                      .alias("request"), F.concat_ws("/", "options.algorithm", "options.engine").alias("options"),
                      F.size("documents").cast("bigint").alias("n_docs"), F.array_join(ids, " ").alias("ids"))


@register("run_lines", "WITH " + DOC_RUN_CTES + f"""
SELECT printf('%d Q0 %d %d %.6f %s', topic_id, doc_id, rank, score, '{RUN_NAME}') AS line FROM x_run""")
def run_lines_q(spark, sf_dir):
    """The run file lines."""
    return S.run_lines(run_bm25_doc(spark, sf_dir), RUN_NAME)


@register("run_file_roundtrip", "WITH " + DOC_RUN_CTES + f"""
SELECT topic_id::INTEGER AS topic_id, doc_id::BIGINT AS doc_id, rank::INTEGER AS rank, score::DOUBLE AS score,
       '{RUN_NAME}' AS name FROM x_run""")
def run_file_roundtrip(spark, sf_dir):
    """B7 then A10: write the run file to shared storage and read it back."""
    path = scratch_path(spark, "run")
    S.write_run(run_bm25_doc(spark, sf_dir), RUN_NAME, path)
    return C.read_run(spark, path)


@register("qrels_file_roundtrip", O.QRELS)
def qrels_file_roundtrip(spark, sf_dir):
    """A5: judgements written as text and read back."""
    path = scratch_path(spark, "qrels")
    S.write_qrels(T.qrels_view(spark, sf_dir), path)
    return C.read_qrels(spark, path)


SUMMARY_SQL = EVAL_CTES + ",\ns AS (" + O.eval_summary_select() + ")"


@register("report_parse", SUMMARY_SQL + "\nSELECT name, printf('%.4f', round(value, 4)) AS value FROM s")
def report_parse(spark, sf_dir):
    """Evaluator-style report text parsed back to (name, value)."""
    return S.parse_report(S.report_lines(eval_summary(spark, sf_dir)))


@register("latex_report", SUMMARY_SQL + r"""
SELECT '\begin{tabular}{ |c|c| }' || chr(10) || '\hline' || chr(10)
       || string_agg(printf('%s & %.4f \\', name, round(value, 4)), chr(10) ORDER BY ord)
       || chr(10) || '\hline' || chr(10) || '\end{tabular}' AS latex FROM s""")
def latex_report_q(spark, sf_dir):
    """The LaTeX table of the summary."""
    return S.latex_report(eval_summary(spark, sf_dir))
