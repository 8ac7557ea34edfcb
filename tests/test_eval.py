import pytest

from rankspark.operators import evaluate as E


def _run(spark, rows):
    return spark.createDataFrame(rows, "topic_id int, doc_id long, rank int, score double")


def _qrels(spark, rows):
    return spark.createDataFrame(rows, "topic_id int, iter string, doc_id long, rel int")


def _m(df, topic, col):
    return [r[col] for r in df.collect() if r.topic_id == topic][0]


def test_perfect_and_reversed(spark):
    qrels = _qrels(spark, [(1, "0", 1, 1), (1, "0", 2, 1), (1, "0", 3, 0), (2, "0", 1, 1), (2, "0", 2, 1),
                           (2, "0", 3, 0)])
    run = _run(spark, [(1, 1, 1, 3.0), (1, 2, 2, 2.0), (1, 3, 3, 1.0),
                       (2, 3, 1, 3.0), (2, 2, 2, 2.0), (2, 1, 3, 1.0)])
    bt = E.evaluate_by_topic(run, qrels)
    assert _m(bt, 1, "map") == 1.0 and _m(bt, 1, "recip_rank") == 1.0 and _m(bt, 1, "bpref") == 1.0
    assert abs(_m(bt, 2, "map") - (1 / 2 + 2 / 3) / 2) < 1e-12
    assert _m(bt, 2, "recip_rank") == 0.5
    assert _m(bt, 2, "bpref") == 0.0  # both relevant ranked below the one judged nonrelevant
    assert _m(bt, 1, "ndcg") == 1.0 and _m(bt, 1, "P_5") == 0.4


def test_equal_scores_tie_break_on_docno_string(spark):
    qrels = _qrels(spark, [(1, "0", 9, 1), (1, "0", 10, 0)])
    run = _run(spark, [(1, 10, 1, 5.0), (1, 9, 2, 5.0)])
    j = {r.doc_id: r.pos for r in E.judged_run(run, qrels).collect()}
    assert j == {9: 1, 10: 2}  # "9" > "10" as strings, descending


def test_no_relevant_and_topic_sets(spark):
    qrels = _qrels(spark, [(1, "0", 5, 1), (3, "0", 1, 1)])
    run = _run(spark, [(1, 1, 1, 1.0), (2, 1, 1, 1.0)])
    bt = E.evaluate_by_topic(run, qrels)
    assert [r.topic_id for r in bt.collect()] == [1]  # 2 only in run, 3 only in qrels
    assert _m(bt, 1, "map") == 0.0 and _m(bt, 1, "recip_rank") == 0.0


def test_duplicates_and_disjoint_fail(spark):
    qrels = _qrels(spark, [(1, "0", 1, 1)])
    with pytest.raises(ValueError):
        E.validate(_run(spark, [(1, 1, 1, 1.0), (1, 1, 2, 0.5)]), qrels)
    with pytest.raises(ValueError):
        E.validate(_run(spark, [(7, 1, 1, 1.0)]), qrels)


def test_summary_names(spark):
    qrels = _qrels(spark, [(1, "0", 1, 2), (1, "0", 2, 1)])
    run = _run(spark, [(1, 2, 1, 2.0), (1, 1, 2, 1.0)])
    _, summ = E.evaluate(run, qrels)
    names = {r.name: r.value for r in summ.collect()}
    for n in ("num_q", "map", "gm_map", "Rprec", "bpref", "iprec_at_recall_0.00", "P_10", "ndcg_cut_10",
              "Rprec_mult_0.20", "11pt_avg", "success_1", "set_F", "infAP", "utility"):
        assert n in names
    ideal = 2 + 1 / __import__("math").log2(3)
    got = 1 + 2 / __import__("math").log2(3)
    assert abs(names["ndcg"] - got / ideal) < 1e-12


def test_every_measure_by_hand(spark):
    """Ranks 1-6 of topic 1: rel 2, nonrel, rel 1, unjudged, pooled but unjudged, nonrel; one relevant (1) missed.

    R = 3, judged nonrelevant = 3 (one not retrieved), 6 retrieved.
    """
    from math import log2

    qrels = _qrels(spark, [(1, "0", 11, 2), (1, "0", 12, 0), (1, "0", 13, 1), (1, "0", 15, -1), (1, "0", 16, 0),
                           (1, "0", 17, 1), (1, "0", 18, 0)])
    run = _run(spark, [(1, 10 + k, k, 10.0 - k) for k in range(1, 7)])
    got = E.evaluate_by_topic(run, qrels).first().asDict()
    ap = (1 + 2 / 3) / 3
    dcg, ideal = 2 + 1 / log2(4), 2 + 1 / log2(3) + 1 / log2(4)
    e = 0.00001
    want = {
        "num_ret": 6, "num_rel": 3, "num_rel_ret": 2, "num_nonrel_judged_ret": 2, "map": ap, "Rprec": 2 / 3,
        # rank 1: no nonrelevant above; rank 3: one above, min(1, 3) / min(3, 3)
        "bpref": (1 + (1 - 1 / 3)) / 3, "recip_rank": 1.0,
        # cutoffs floor(x * 3 + .9): 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3; three relevant are never reached
        **{f"iprec_at_recall_{x}": 1.0 for x in ("0_00", "0_10", "0_20", "0_30")},
        **{f"iprec_at_recall_{x}": 2 / 3 for x in ("0_40", "0_50", "0_60")},
        **{f"iprec_at_recall_{x}": 0.0 for x in ("0_70", "0_80", "0_90", "1_00")}, "11pt_avg": (4 + 3 * 2 / 3) / 11,
        "P_5": 2 / 5, "P_10": 2 / 10, "P_1000": 2 / 1000, "recall_5": 2 / 3, "recall_1000": 2 / 3,
        "relative_P_5": 2 / 3, "relative_P_10": 2 / 3, "map_cut_5": ap, "ndcg_cut_5": dcg / ideal, "ndcg": dcg / ideal,
        # floor(x * 3 + .9): 1, 2, 2, 3, 3, 4, 5, 5, 6, 6
        "Rprec_mult_0_20": 1.0, "Rprec_mult_0_40": 1 / 2, "Rprec_mult_0_60": 1 / 2, "Rprec_mult_0_80": 2 / 3,
        "Rprec_mult_1_00": 2 / 3, "Rprec_mult_1_20": 2 / 4, "Rprec_mult_1_40": 2 / 5, "Rprec_mult_1_60": 2 / 5,
        "Rprec_mult_1_80": 2 / 6, "Rprec_mult_2_00": 2 / 6,
        "success_1": 1.0, "success_5": 1.0, "success_10": 1.0, "set_P": 2 / 6, "set_recall": 2 / 3, "set_relative_P": 2 / 3,
        "set_F": 2 * (1 / 3) * (2 / 3) / (1 / 3 + 2 / 3), "set_map": (2 / 6) * (2 / 3), "utility": 2.0 - 4.0,
        # rank 1 gives 1; rank 3: 1/3 + 2/3 * (2/2) * (1 + e) / (1 + 1 + 2e)
        "infAP": (1 + 1 / 3 + 2 / 3 * (1 + e) / (2 + 2 * e)) / 3,
    }
    for name, value in want.items():
        assert abs(got[name] - value) < 1e-9, name
    left = {n for n in got if n not in want and n != "topic_id"}
    assert all(n.rsplit("_", 1)[0] in ("P", "recall", "relative_P", "map_cut", "ndcg_cut") for n in left), left


def test_summary_sums_and_geometric_means(spark):
    from math import exp, log

    qrels = _qrels(spark, [(1, "0", 1, 1), (2, "0", 1, 1), (2, "0", 2, 0)])
    run = _run(spark, [(1, 1, 1, 1.0), (2, 2, 1, 2.0), (2, 1, 2, 1.0)])
    _, summ = E.evaluate(run, qrels)
    v = {r.name: r.value for r in summ.collect()}
    assert v["num_q"] == 2 and v["num_ret"] == 3 and v["map"] == 0.75
    assert abs(v["gm_map"] - exp((log(1) + log(0.5)) / 2)) < 1e-9
    assert abs(v["gm_bpref"] - exp((log(1) + log(0.00001)) / 2)) < 1e-9


def test_judgements_are_made_once(spark):
    """the measures read the judgements twice; the documents' passages are looked for once, before."""
    from rankspark.plans.queries import QUERIES

    for name in ("eval_judged", "eval_relstring"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() > 0 and not [f for f in out.inputFiles() if "documents.parquet" in f]


def test_grams_are_found_as_by_their_hashes(spark, monkeypatch):
    """Short items, repeated and null ids, repeated words, grams across the ends of texts."""
    from rankspark.plans import testbed as T

    items = [(1, "a b c d e f a b c d e"), (2, "a"), (3, "b c"), (3, "x y z"), (4, None), (None, "a b c d e"), (5, "q r s t u v w"), (6, "a b c d zz")]
    texts = ["A b, c d e f g", "a a b c d e", "b", "c d e", "q r s t", "u v w", "x y z q r s t u", None, "", "é b c d zz a", "a b c d e"]
    docs = spark.createDataFrame([(None if i == 3 else i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    planned = []
    found = T._grams_found
    monkeypatch.setattr(T, "_grams_found", lambda *a: planned.append(a) or found(*a))
    now = sorted(T.passage_judgements(docs, bench).collect(), key=repr)
    assert planned  # no gram of a document is hashed
    monkeypatch.setattr(T, "BROADCAST_MAX_ROWS", 0)
    assert now == sorted(T.passage_judgements(docs, bench).collect(), key=repr) and len(planned) == 1
    # By hand: item 1 has 7 grams; all of the text "a b c d e" is one of them, a seventh (grade 1).
    assert (1, 1, 1) in [tuple(r) for r in now] and (2, 0, 2) in [tuple(r) for r in now]
