import pytest

from rankspark.functions.analysis import PIPELINE
from rankspark.operators.index import add_documents, build_index, merge_index, read_index, term_ids, write_index
from rankspark.operators.ingest import append_articles, insert_if_absent
from rankspark.operators.search import search
from rankspark.session import scratch_path

SF = "/root/testdata/sf0.001"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_merge_halves_equals_one_build(spark):
    docs = _docs(spark)
    full = build_index(docs, ("text",))
    merged = merge_index(build_index(docs.filter("lang = 'en'"), ("text",)),
                         build_index(docs.filter("lang <> 'en' OR lang IS NULL"), ("text",)))
    assert sorted(full.lexicon.collect()) == sorted(merged.lexicon.collect())
    assert sorted(full.stats.collect()) == sorted(merged.stats.select(*full.stats.columns).collect())


def test_merge_guards(spark):
    docs = _docs(spark)
    with pytest.raises(ValueError):
        merge_index(build_index(docs, ("text",)), build_index(docs, ("text",), analyzer=PIPELINE))


def test_persisted_index_searches_the_same(spark):
    docs = _docs(spark)
    idx = build_index(docs, ("text",))
    stored = write_index(idx, scratch_path(spark, "test-index"), buckets=8)
    again = read_index(spark, stored.path)
    q = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id as int) topic_id", "text")
    a = sorted(search(idx, q, "bm25_doc", "document", 20).collect())
    b = sorted(search(again, q, "bm25_doc", "document", 20).collect())
    assert a == b and len(a) > 0


def test_term_ids_dense(spark):
    lex = build_index(_docs(spark), ("text",)).lexicon
    ids = term_ids(lex, "text").collect()
    terms = sorted(r.term for r in ids)
    assert sorted(r.term_id for r in ids) == list(range(len(ids)))
    assert [r.term for r in sorted(ids, key=lambda r: r.term_id)] == terms


def test_insert_if_absent_first_wins(spark):
    existing = spark.createDataFrame([(1, "old")], "id long, title string")
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id long, title string")
    out = sorted(tuple(r) for r in insert_if_absent(existing, batch, "id", order_col="title").collect())
    assert out == [(2, "a")]


def test_stored_indexes_merge_and_publish(spark):
    docs = _docs(spark)
    full = build_index(docs, ("text",))
    path = scratch_path(spark, "test-publish")
    first = write_index(build_index(docs.filter("lang = 'en'"), ("text",)), path, buckets=8)
    before = sorted(first.lexicon.collect())
    second = add_documents(spark, path, docs.filter("lang <> 'en' OR lang IS NULL"))
    assert sorted(second.lexicon.collect()) == sorted(full.lexicon.collect())
    assert sorted(second.postings.drop("term_bucket").collect()) == sorted(full.postings.collect())
    assert sorted(read_index(spark, path).stats.select(*full.stats.columns).collect()) == sorted(full.stats.collect())
    assert sorted(first.lexicon.collect()) == before  # a reader of the old version is not disturbed


def test_unpublished_data_is_not_seen(spark):
    path = scratch_path(spark, "test-unpublished")
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)
    build_index(_docs(spark), ("text",)).doclen.write.parquet(f"{path}/data-broken/doclen")
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)


def test_a_frequent_term_may_span_files(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).selectExpr("id doc_id", "concat('common ', id, ' word', id % 50) text")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        idx = write_index(build_index(docs.repartition(8), ("text",)), scratch_path(spark, "test-hot"), buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    own = idx.postings.filter("term = 'common'")
    assert own.count() == 20_000 and own.select(F.input_file_name()).distinct().count() > 1


def test_merge_needs_key_columns(spark):
    from dataclasses import replace

    a = build_index(_docs(spark), ("text",))
    with pytest.raises(ValueError):
        merge_index(a, replace(a, doclen=a.doclen.drop("dl")))


def test_append_keeps_the_first_of_an_id(spark):
    path = scratch_path(spark, "test-append")
    existing = spark.createDataFrame([(1, "old")], "id long, title string")
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id long, title string")
    append_articles(existing, batch, path, order_col="title")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "a")]
