import pytest
from pyspark.sql import functions as F

from rankspark.functions.analysis import PIPELINE, Analyzer, s_stem
from rankspark.operators import evaluate as E
from rankspark.operators.index import (build_index, forward_by_ids, forward_index, merge_term_ids, remap_forward, stem_map,
                                       stemmed_index, term_ids)
from rankspark.operators.ingest import append_articles, insert_if_absent
from rankspark.operators.search import enrich, lookup
from rankspark.operators.store import read_store, write_store
from rankspark.session import scratch_path
from rankspark.sinks.outputs import response

SF = "/root/testdata/sf0.001"


def articles(spark, ids):
    return spark.createDataFrame([(i, f"title {i}", f"text of {i}") for i in ids], "id long, title string, abstract string")


@pytest.fixture(scope="module")
def store(spark):
    return write_store(articles(spark, [*range(0, 4000, 2), -7, 10 ** 12]), scratch_path(spark, "store"), files=16)


def test_lookup_reads_the_files_that_can_hold_the_ids(spark, store):
    assert 12 <= len(store.ranges) <= 16
    assert len(store.files_with([100])) == 1 and len(store.files_with([10 ** 13])) == 0
    assert len(store.files_with([0, 1000, 3998])) == 3
    assert {r.id for r in store.holding([100, 102]).collect()} == {100, 102}
    plan = store.holding([100])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(id,100)" in plan or "In(id" in plan
    got = lookup(store, spark.createDataFrame([(i,) for i in (8, -7, 10 ** 12, 8)], "id long"))
    assert sorted((r.id, r.title) for r in got.collect()) == [(-7, "title -7"), (8, "title 8"), (10 ** 12, f"title {10 ** 12}")]
    for missing in (9, 10 ** 13):
        with pytest.raises(LookupError, match=str(missing)):
            lookup(store, spark.createDataFrame([(8,), (missing,)], "id long"))
    assert lookup(store, spark.createDataFrame([], "id long")).count() == 0
    assert sorted(read_store(spark, store.path).ranges) == sorted(store.ranges)
    empty = write_store(articles(spark, []), scratch_path(spark, "none"))
    assert empty.files_with([1]) == [] and empty.holding([1]).count() == 0


def test_enrich_from_the_store(spark, store):
    run = spark.createDataFrame([(1, 8, 1, 2.0), (1, 10, 2, 1.0), (2, 8, 1, 1.0)], "topic_id int, doc_id long, rank int, score double")
    got = enrich(run, store)
    assert sorted((r.topic_id, r.doc_id, r.title) for r in got.collect()) == [(1, 8, "title 8"), (1, 10, "title 10"), (2, 8, "title 8")]
    with pytest.raises(LookupError):
        enrich(run.withColumn("doc_id", F.col("doc_id") + 1), store)


def test_response_says_what_was_asked(spark, store):
    run = spark.createDataFrame([(1, 8, 1, 2.0), (1, 10, 2, 1.0)], "topic_id int, doc_id long, rank int, score double")
    asked = spark.createDataFrame([(1, "lung"), (2, "nothing")], "topic_id int, query string")
    rows = {r.topic_id: r for r in response(run, store, asked, "BM25", "TERRIER").collect()}
    assert rows[1].request.query == "lung" and tuple(rows[1].options) == ("BM25", "TERRIER")
    assert [(d.rank, d.article.doc_id, d.article.title) for d in rows[1].documents] == [(1, 8, "title 8"), (2, 10, "title 10")]
    assert rows[2].request.query == "nothing" and rows[2].documents == []


def test_insert_leaves_the_stored_ids_where_they_are(spark):
    path = scratch_path(spark, "stored")
    spark.range(2000).selectExpr("id", "'old' title").write.parquet(path)
    existing = spark.read.parquet(path)
    batch = spark.createDataFrame([(5, "b", 2), (5, "a", 1), (3000, "late", 2), (3000, "first", 1), (None, "x", 1)], "id long, title string, place int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what the operator itself broadcasts
    try:
        for bound in (500_000, 1):
            got = insert_if_absent(existing, batch, "id", "place", max_rows=bound)
            assert sorted((r.id or 0, r.title) for r in got.collect()) == [(0, "x"), (3000, "first")]
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (bound == 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_batch_counts_once(spark):
    path = scratch_path(spark, "batch")
    existing = articles(spark, [1, 2])
    for _ in range(2):
        out = append_articles(existing, articles(spark, [2, 3]), path, batch_key="a")
        assert [r.id for r in out.collect()] == [3]
    append_articles(existing.unionByName(spark.read.parquet(path).drop("batch")), articles(spark, [3, 4]), path, batch_key="b")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    out = append_articles(existing, articles(spark, [2, 9]), scratch_path(spark, "plain"))
    assert [r.id for r in out.collect()] == [9]


def test_merged_ids(spark):
    first = spark.createDataFrame([("b", 0), ("d", 1)], "term string, term_id long")
    second = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id long")
    merged, one, two = merge_term_ids(first, second)
    assert {r.term: r.term_id for r in merged.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {tuple(r) for r in one.collect()} == {(0, 1), (1, 3)} and {tuple(r) for r in two.collect()} == {(0, 0), (1, 1), (2, 2)}
    merged, one, two = merge_term_ids(first, second, keep_first=True)
    assert {r.term: r.term_id for r in merged.collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
    assert {tuple(r) for r in one.collect()} == {(0, 0), (1, 1)} and {tuple(r) for r in two.collect()} == {(0, 2), (1, 0), (2, 3)}
    empty = first.limit(0)
    assert {r.term: r.term_id for r in merge_term_ids(empty, second, True)[0].collect()} == {"a": 0, "b": 1, "c": 2}


def test_lists_are_sorted_by_their_new_ids(spark):
    docs = spark.createDataFrame([(1, "c a b b"), (2, "")], "doc_id long, text string")
    index = build_index(docs, ("text",))
    lists = forward_by_ids(forward_index(index), term_ids(index.lexicon, "text"))
    assert [(r.doc_id, [tuple(e) for e in r.entries]) for r in lists.collect()] == [(1, [(0, 1), (1, 2), (2, 1)])]
    new = spark.createDataFrame([(0, 9), (1, 3), (2, 5)], "old_id long, new_id long")
    assert [tuple(e) for e in remap_forward(lists, new).first().entries] == [(3, 2), (5, 1), (9, 1)]


def test_stems_of_distinct_terms(spark):
    import re

    words = ["flies", "eies", "skies", "dies", "cries", "aies", "goes", "trees", "mates", "es", "ies", "s", "us", "bus", "glass", "cats", "a", "maes",
             "öles", "naïves", "日本s", "studies"]

    def plain(w):
        if w.endswith("ies") and not re.search("[ea]ies$", w):
            return w[:-3] + "y"
        if w.endswith("es") and not re.search("[aeo]es$", w):
            return w[:-1]
        return w[:-1] if w.endswith("s") and not re.search("[us]s$", w) else w

    d = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r.term: r.stem for r in stem_map(d).collect()} == {w: plain(w) for w in words}
    assert [r[0] for r in d.select(s_stem(F.col("term"))).collect()] == [plain(w) for w in words]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mapped = stemmed_index(build_index(docs, ("text",), analyzer=Analyzer(stop_words=PIPELINE.stop_words)))
    whole = build_index(docs, ("text",), analyzer=PIPELINE)
    assert mapped.analyzer == PIPELINE and sorted(mapped.lexicon.collect()) == sorted(whole.lexicon.collect())
    assert sorted(mapped.postings.collect()) == sorted(whole.postings.collect())


def test_relevance_strings(spark):
    run = spark.createDataFrame([(1, d, r, 10.0 - r) for r, d in enumerate([11, 12, 13, 14, 15], 1)] + [(2, 11, 1, 1.0)],
                                "topic_id int, doc_id long, rank int, score double")
    qrels = spark.createDataFrame([(1, "0", 11, 2), (1, "0", 13, 0), (1, "0", 14, -1), (1, "0", 15, 12), (2, "0", 99, 1)],
                                  "topic_id int, iter string, doc_id long, rel int")
    got = {r.topic_id: r.relstring_10 for r in E.relevance_strings(run, qrels).collect()}
    assert got == {1: "2-0<>", 2: "-"}
    assert {r.topic_id: r.relstring_3 for r in E.relevance_strings(run, qrels, 3).collect()} == {1: "2-0", 2: "-"}


def test_files_follow_the_length_of_the_texts(spark, monkeypatch):
    """long articles get more files, so that none is too large to be sorted in memory."""
    from rankspark.operators import store as ST

    monkeypatch.setattr(ST, "FILE_BYTES", 4000)
    rows = [(i, None if i == 3 else "é" * 100, ["k"]) for i in range(100)]
    kept = write_store(spark.createDataFrame(rows, "id long, title string, keywords array<string>"), scratch_path(spark, "long"))
    assert len(kept.ranges) == 5
    assert sorted((r.id, r.title, r.keywords) for r in kept.articles.collect()) == rows
    short = write_store(spark.createDataFrame([(i, None, ["k"]) for i in range(100)], "id long, title string, keywords array<string>"),
                        scratch_path(spark, "short"))
    assert len(short.ranges) == 1
