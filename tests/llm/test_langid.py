import itertools

import numpy as np
from pyspark.sql import functions as F

from rankspark.llm import langid as G
from rankspark.llm import registry


def test_grams():
    ids, owner = G.gram_ids([b"ab", b"c", b"ab"])
    by = [sorted(ids[owner == k]) for k in range(3)]
    assert by[0] == by[2] != by[1]
    # " ab ": 2 letters, 3 pairs, 2 triples, 1 of four; " c ": 1, 2, 1, 0
    assert [len(x) for x in by] == [8, 4, 8]


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(4)
    scores = [np.round(rng.uniform(-3, 0, (rng.integers(1, 8), 3)), 3) for _ in range(120)]
    for path, s in zip(G.viterbi(scores, 2.0), scores):
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(value(path) - best) < 1e-9


def _model(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate([
        ("en", "the house and the garden with the tree are there"), ("de", "das Haus und der Garten mit dem Baum sind dort"),
        ("ru", "дом и сад с деревом"), ("uk", "будинок і сад з деревом")] * 5)]
    rows += [(90, None, "xx"), (91, "untold", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return G.train(G.training_sample(d, "doc_id", "text", "lang", 100))


def test_scripts_and_spans(spark):
    m = _model(spark)
    assert m.languages == ["de", "en", "ru", "uk"]
    assert m.allowed[0].tolist() == [True, True, False, False] and m.allowed[2].tolist() == [False, False, True, True]
    text = "the tree and the house are there. das Haus und der Garten sind dort: сад с деревом"
    lang, score, spans = G.label([text], G.Words(m))[0]
    assert [s[2] for s in spans][:2] == ["en", "de"] and spans[-1][2] in ("ru", "uk")
    assert text[spans[0][0]:spans[0][1]] == "the tree and the house are there" and 0 < score < 1
    assert G.label(["", None, "12 -- 3", "\u00bd \u2167 \u00b2"], G.Words(m)) == [("und", 0.0, [])] * 4


def test_odd_tables(spark, odd_docs, no_docs):
    m = _model(spark)
    rows = G.identify(odd_docs, m, [F.col("doc_id")]).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang == "und") == (r.doc_id in (2, 3, 5) or (r.doc_id is None and not r.spans)) for r in rows)
    assert G.identify(no_docs, m, [F.col("doc_id")]).count() == 0
    none = G.train(G.training_sample(no_docs, "doc_id", "text", "lang", 10))
    assert none.languages == [] and {r.lang for r in G.identify(odd_docs, none, []).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op7_language_spans(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("ok")).first()
    assert held[1] > 200 and held[0] >= 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_text_unlike_anything_learned_scores_low(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IN ('de', 'en')")
    m = G.train(G.training_sample(docs, "doc_id", "text", "lang", 100))
    strange = ["\u0397 \u03b3\u03c1\u03ae\u03b3\u03bf\u03c1\u03b7 \u03ba\u03b1\u03c6\u03ad \u03b1\u03bb\u03b5\u03c0\u03bf\u03cd",
               "\u0421\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a",
               "xq zzkv wpfh qqjx vvkz bzzq xkcd wqpl jjxq kkvwz", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059"]
    for lang, score, _ in G.label(strange, G.Words(m)):
        assert lang in ("de", "en") and score < 0.4
    clean = [(r.text, r.lang) for r in docs.collect()]
    got = G.label([t for t, _ in clean], G.Words(m))
    assert sum(g[1] >= 0.4 for g in got) >= 0.98 * len(got) and sum(g[0] == x for g, (_, x) in zip(got, clean)) >= 0.97 * len(got)


def test_bounded_memory_changes_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    m = G.train(G.training_sample(docs, "doc_id", "text", "lang", 100))
    texts = [r.text for r in docs.collect()]
    want = G.label(texts, G.Words(m))
    known = G.Words(m)
    monkeypatch.setattr(G, "CELLS", 50)
    assert [G.label([t], known if not known.full() else G.Words(m))[0] for t in texts] == want


def test_clashing_names(spark, odd_docs):
    d = odd_docs.withColumn("lang", F.lit("x")).withColumn("score", F.lit(1)).withColumn("__text", F.lit("y"))
    out = G.identify(d, _model(spark), [F.col("doc_id"), F.col("`a.b`"), F.col("score").alias("kept"), F.col("__text")])
    assert out.columns == ["doc_id", "a.b", "kept", "__text", "lang", "score", "spans"] and out.filter("kept = 1").count() == d.count()
