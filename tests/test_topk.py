import random

import pytest
from pyspark.sql import functions as F

from rankspark.functions.models import MODELS, Terms, contribution_bounds, register_model, tf_idf
from rankspark.functions.text import ARTICLE_FIELDS, article_fields
from rankspark.operators import index as I
from rankspark.operators import search as S
from rankspark.operators.index import build_index, write_index
from rankspark.operators.search import search
from rankspark.operators.topk import search_pruned
from rankspark.plans import testbed as T
from rankspark.plans.queries import topic_queries
from rankspark.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_blocks():
    old, I.BLOCK_BITS = I.BLOCK_BITS, 3
    yield
    I.BLOCK_BITS = old


@pytest.fixture(scope="module")
def docs(spark, small_blocks):
    return write_index(build_index(T.table(spark, SF, "documents"), ("text",)), scratch_path(spark, "topk-docs"))


@pytest.fixture(scope="module")
def articles(spark, small_blocks):
    return write_index(build_index(article_fields(T.articles_view(spark, SF)), ARTICLE_FIELDS), scratch_path(spark, "topk-articles"))


@pytest.mark.parametrize("model,mode", [("bm25_doc", "document"), ("bb2", "document"), ("dfr_bm25", "document"),
                                        ("bm25_field", "field_max"), ("dfr_gbh2", "field_max")])
def test_same_run_and_fewer_scored(spark, docs, articles, model, mode):
    index = docs if mode == "document" else articles
    queries = (T.free_text_queries if mode == "document" else topic_queries)(spark, SF)
    pairs = S.score_table(index, queries, {"s": (model, None)}, mode).count()
    kept = []
    for k in (1, 20):
        pruned = search_pruned(index, queries, model, mode, k)
        assert sorted(pruned.run.collect()) == sorted(search(index, queries, model, mode, k, prune=False).collect())
        n = pruned.scored()
        kept.append(n["probed"] + n["kept"])
    if mode == "document":
        assert kept[0] < 0.7 * pairs and kept[0] < kept[1]


def test_negative_weights(spark, small_blocks):
    """Terms in more than half of the documents lower a BM25 score; the first k must not miss documents without them."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["of", "the", "gene", "braf", "x", "y", "z"], weights=[9, 9, 1, .3, 2, 2, 2], k=rnd.randint(1, 30))))
            for i in range(600)]
    index = write_index(build_index(spark.createDataFrame(rows, "doc_id long, text string"), ("text",)), scratch_path(spark, "negative"))
    q = spark.createDataFrame([(1, "the braf gene of of"), (2, "the of"), (3, "gene"), (4, "nothing here"), (5, None)], "topic_id int, text string")
    for k in (1, 40):
        for model in ("bm25_doc", "bb2"):
            assert sorted(search(index, q, model, "document", k, prune=True).collect()) == \
                sorted(search(index, q, model, "document", k, prune=False).collect()), (k, model)


@pytest.mark.parametrize("model", ["bm25_field", "bm25_doc", "dfr_gbh2", "bb2", "dfr_bm25"])
def test_bounds_hold_inside_their_range(spark, model):
    rnd = random.Random(5)
    rows = []
    for _ in range(3000):
        n = rnd.choice([2, 3, 5, 6, 50, 10_000])
        df = rnd.randint(1, n)
        cf = df + rnd.choice([0, 0, 1, 5, 500])
        tfs, dls = sorted(rnd.randint(1, max(1, cf - df + 1)) for _ in range(2)), sorted(rnd.randint(1, 400) for _ in range(2))
        tf, dl = rnd.randint(*tfs), rnd.randint(*dls)
        rows.append((tf, rnd.randint(1, 3), df, cf, float(n), dl, float(rnd.randint(1, 300)), *tfs, *dls))
    d = spark.createDataFrame(rows, "tf int, qtf int, df long, cf long, n double, dl int, avgdl double, min_tf int, max_tf int, min_dl int, max_dl int")
    low, high = contribution_bounds(model)
    w = MODELS[model](Terms.from_columns())
    bad = d.select(w.alias("w"), low.alias("low"), high.alias("high"), "*").filter("w > high + 1e-9 or w < low - 1e-9")
    assert bad.count() == 0, bad.first()


def test_models_without_bounds_are_scored_in_full(spark, docs):
    register_model("tf_idf", tf_idf)
    assert contribution_bounds("tf_idf") is None and contribution_bounds("bm25_doc", {"b": 1.5}) is None
    q = T.free_text_queries(spark, SF)
    with pytest.raises(ValueError):
        search_pruned(docs, q, "tf_idf", "document", 5)
    register_model("tf_idf", tf_idf, monotone=True)
    try:
        assert sorted(search(docs, q, "tf_idf", "document", 5, prune=True).collect()) == \
            sorted(search(docs, q, "tf_idf", "document", 5, prune=False).collect())
    finally:
        register_model("tf_idf", tf_idf)
    with pytest.raises(ValueError):  # nothing is stored of its blocks
        search_pruned(build_index(T.table(spark, SF, "documents"), ("text",)), q)


def test_pruning_starts_by_itself(spark, docs, monkeypatch):
    q = T.free_text_queries(spark, SF)
    want = sorted(search(docs, q, "bm25_doc", "document", 20, prune=False).collect())
    monkeypatch.setattr(S, "PRUNE_POSTINGS", 10)
    found = search(docs, q, "bm25_doc", "document", 20)
    assert sorted(found.collect()) == want
    assert found.filter(F.col("rank") == 1).count() > 0


def test_no_pruning_by_itself_where_ids_repeat_or_are_null(spark, small_blocks, monkeypatch):
    """The rows of one id lie in many blocks, none of which bounds its score."""
    rows = [(7 if i % 10 == 0 else None if i % 10 == 1 else i, "braf " + "gene " * (i % 3) + "x " * (i % 23)) for i in range(400)]
    rows += [(1000 + i, "other") for i in range(3000)]  # so few matches that they are read by term
    index = write_index(build_index(spark.createDataFrame(rows, "doc_id long, text string"), ("text",)), scratch_path(spark, "repeated"))
    q = spark.createDataFrame([(1, "braf gene"), (2, "gene x")], "topic_id int, text string")
    for k in (1, 5):
        monkeypatch.undo()
        want = search(index, q, "bb2", "document", k, prune=False).collect()
        monkeypatch.setattr(S, "PRUNE_POSTINGS", 10)
        assert sorted(search(index, q, "bb2", "document", k).collect(), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("mode", ["document", "field_max"])
def test_few_rows_are_kept_between_the_steps(spark, docs, articles, mode, monkeypatch):
    """No row for each topic and document that is scored: only hits and bounds of stretches are written."""
    from rankspark.operators import topk

    index, model = (docs, "bm25_doc") if mode == "document" else (articles, "bm25_field")
    queries = (T.free_text_queries if mode == "document" else topic_queries)(spark, SF)
    written, keep = {}, topk.materialize

    def counted(df, name):
        kept = keep(df, name)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(topk, "materialize", counted)
    monkeypatch.setattr(I, "STRETCHES", 16, raising=False)
    pruned = search_pruned(index, queries, model, mode, 1)
    pairs = S.score_table(index, queries, {"s": (model, None)}, mode).count()
    assert sorted(pruned.run.collect()) == sorted(search(index, queries, model, mode, 1, prune=False).collect())
    assert max(written.values()) < 0.3 * pairs, (written, pairs)


def test_large_batches_and_stretches(spark, articles, monkeypatch):
    """Batches beyond the bound take joins; blocks are looked at in stretches, and topics in several passes."""
    from rankspark.operators import topk

    queries = topic_queries(spark, SF)
    want = sorted(search(articles, queries, "bm25_field", "field_max", 20, prune=False).collect())
    assert sorted(search_pruned(articles, queries, "bm25_field", "field_max", 20, max_rows=10).run.collect()) == want
    for at, name, value in ((I, "STRETCHES", 16), (I, "UNIT_BITS", 1), (topk, "MAX_PLACES", 300), (topk, "CHUNK", 3)):
        monkeypatch.setattr(at, name, value)
    assert sorted(search_pruned(articles, queries, "bm25_field", "field_max", 20).run.collect()) == want


@pytest.mark.parametrize("portion", [200_000, 3])
def test_numbers_as_bytes(portion, monkeypatch):
    import numpy as np

    monkeypatch.setattr(I, "PORTION", portion)
    values = np.array([5, -3, 1 << 40, -(1 << 62), 0, 127, -128, 300, 7], np.int64)
    for sizes in ([9], [1] * 9, [2, 3, 0, 4], [4, 5]):
        sizes = np.array(sizes)
        assert (I._unplaned(I._planed(values, sizes), sizes) == values).all()
    assert len(I._planed(np.arange(-50, 50), np.array([100]))[0].as_py()) == 100  # a byte each
