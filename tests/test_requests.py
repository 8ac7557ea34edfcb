import pytest

from rankspark.plans.requests import Engines, Options, evaluate_all, evaluate_topics, find, find_by_topic


def _topics(spark):
    return spark.createDataFrame([("s", 1, "braf", "melanoma", ""), ("s", 2, "flu", "lung", "")],
                                 "topic_set string, id int, disease string, gene string, treatment string")


@pytest.mark.parametrize("algorithm", ["BM25", "DFR", "DFR_BM25", "BM25_PLUS_DFR"])
@pytest.mark.parametrize("engine", ["ELASTICSEARCH", "TERRIER"])
def test_find_dispatch(spark, unit_index, algorithm, engine):
    rows = find(unit_index, "flu lung", Options(algorithm, engine)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3]
    assert sorted(r.rank for r in rows) == [1, 2]


def test_find_by_topic_and_missing(spark, unit_index):
    topic, run = find_by_topic(unit_index, _topics(spark), 1, "s")
    assert topic.collect()[0].disease == "braf" and [r.doc_id for r in run.collect()] == [2]
    with pytest.raises(LookupError):
        find_by_topic(unit_index, _topics(spark), 9, "s")


def test_evaluate_all(spark, unit_index):
    qrels = spark.createDataFrame([(1, "0", 2, 1), (2, "0", 3, 1), (2, "0", 1, 0)],
                                  "topic_id int, iter string, doc_id long, rel int")
    summary, per_topic, latex, report = evaluate_all(unit_index, _topics(spark), "s", qrels, Options("BM25", "TERRIER"), "mine")
    assert report.orderBy("ord").first().line.split() == ["runid", "all", "mine"]
    vals = {r.name: r.value for r in summary.collect()}
    assert vals["num_q"] == 2 and vals["num_rel"] == 2
    assert per_topic.count() == 2
    assert latex.collect()[0].latex.startswith("\\begin{tabular}")


def test_each_engine_has_its_pipeline(spark):
    docs = spark.createDataFrame([(1, "the tests"), (2, "a test"), (3, "other words"), (4, "more"), (5, "still more")],
                                 "doc_id long, text string")
    both = Engines.build(docs, ("text",))
    assert {r.doc_id for r in find(both, "the test", Options("BM25", "ELASTICSEARCH")).collect()} == {1, 2}
    assert [r.doc_id for r in find(both, "the", Options("BM25", "ELASTICSEARCH")).collect()] == [1]
    assert find(both, "the", Options("BM25", "TERRIER")).collect() == []  # a stop word
    assert {r.doc_id for r in find(both, "tests", Options("BM25", "TERRIER")).collect()} == {1, 2}  # stemmed


def test_evaluate_topics_and_colliding_sets(spark, unit_index):
    qrels = spark.createDataFrame([(1, "0", 2, 1), (2, "0", 3, 1)], "topic_id int, iter string, doc_id long, rel int")
    ask = lambda *x: spark.createDataFrame(list(x), "topic_set string, id int")
    topics = _topics(spark).unionByName(spark.createDataFrame([("t", 1, "flu", "", "")], _topics(spark).schema))
    summary, per_topic, _, _ = evaluate_topics(unit_index, topics, ask(("s", 1)), qrels)
    assert [r.topic_id for r in per_topic.collect()] == [1]
    assert {r.name: r.value for r in summary.collect()}["map"] == 1.0
    with pytest.raises(ValueError):
        evaluate_topics(unit_index, topics, ask(("s", 1), ("t", 1)), qrels)
