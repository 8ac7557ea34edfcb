import random

import numpy as np
import pyarrow as pa
import pytest

from rankspark.operators import scan
from rankspark.operators import search as S
from rankspark.operators.index import add_documents, build_index, postings_by_document, stemmed_index, write_index
from rankspark.session import scratch_path

WORDS = [f"w{i}" for i in range(30)]


def _docs(spark, ids, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 12))), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 40)))) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, title string, abstract string")


def _queries(spark):
    rnd = random.Random(2)
    rows = [(t, " ".join(rnd.choices(WORDS, k=12))) for t in [*range(1, 30), 7, None, None]]
    return spark.createDataFrame([*rows, (40, "absent"), (41, None)], "topic_id int, text string")


def _joined(index, queries, model, mode, k):
    return S.top_k(S.score_table(index, queries, {"s": (model, None)}, mode), "s", k)


def _sorted(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("ids,whole", [(list(range(60)), True), ([*range(40), 3, 3, 9, None, None], False)])
def test_batch_is_scanned_by_document(spark, monkeypatch, ids, whole):
    """The same run as by the join, without a row for every topic and document."""
    index = write_index(build_index(_docs(spark, ids), ("title", "abstract")), scratch_path(spark, "scan"))
    assert postings_by_document(index, ["title"])[1] is whole
    q = _queries(spark)
    cases = [("bm25_field", "field_max", 7), ("bm25_doc", "document", 100), ("bb2", "document", 1)]
    want = [_sorted(_joined(index, q, *c)) for c in cases]
    fused = _sorted(S.fuse(_joined(index, q, "bm25_doc", "document", 5), _joined(index, q, "bb2", "document", 5)))

    def pairs(*_, **__):
        raise AssertionError("a row for every topic and document")
    monkeypatch.setattr(S, "score_table", pairs)
    assert [_sorted(S.search(index, q, *c)) for c in cases] == want
    assert _sorted(S.search_fused(index, q, "bm25_doc", "bb2", "document", 5)) == fused


def test_segments_and_postings_without_direct_index(spark):
    q, path = _queries(spark), scratch_path(spark, "scan-segments")
    write_index(build_index(_docs(spark, range(30)), ("title", "abstract")), path)
    grown = add_documents(spark, path, _docs(spark, [*range(30, 50), 3], 4))
    for index in (grown, stemmed_index(grown)):
        assert _sorted(S.search(index, q, "bm25_field", "field_max", 6)) == _sorted(_joined(index, q, "bm25_field", "field_max", 6))


def test_few_terms_are_read_by_term(spark, monkeypatch):
    index = write_index(build_index(_docs(spark, range(60)), ("title", "abstract")), scratch_path(spark, "scan-few"))
    monkeypatch.setattr(S, "_scanned", None)
    q = spark.createDataFrame([(1, "w1 w2")], "topic_id int, text string")
    assert S.search(index, q, "bm25_doc", "document", 5).count() == 5


def test_blocks_cut_anywhere_give_the_same(monkeypatch):
    """Small blocks, ties at the last place, NaN (the largest), a missing weight and scores below zero."""
    rnd = random.Random(6)
    rows = [(d, v, rnd.choice([-1.0, 0.5, 0.5, 2.0, None]), float("nan") if d == 17 and v == 2 else 0.25)
            for d in rnd.sample(range(500), 200) for v in sorted(rnd.sample(range(9), rnd.randint(1, 6)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64(), pa.float64()))],
                                       ["doc_id", "vid", "w0", "w1"])
    topics = [([0, 0, 1], [0, 3, 4]), ([0, 0, 0], [2, 2, 5]), ([1], [8])]  # (field, vid) lists; a repeated one counts twice

    class Plan:
        value = (pa.array([5, None, 7]), np.repeat([0, 1, 2], [3, 3, 1]), np.array([f for t in topics for f in t[0]]),
                 np.array([v for t in topics for v in t[1]]), 9)

    want = []
    for n, (fields, vids) in enumerate(topics):
        for src in (0, 1):
            best = {}
            for d in {r[0] for r in rows}:
                w = {r[1]: r[2 + src] for r in rows if r[0] == d}
                sums = [[w[v] for f2, v in zip(fields, vids) if f2 == f and w.get(v) is not None] for f in set(fields)]
                sums = [sum(s) for s in sums if s]
                if sums:
                    best[d] = max(sums, key=lambda x: (x != x, x))
            first = sorted(best.items(), key=lambda x: (x[1] == x[1], -x[1] if x[1] == x[1] else 0, x[0]))[:20]
            want += [([5, None, 7][n], src, d, s) for d, s in first]
    for rows_at_once, cells in ((1, 1), (13, 40), (10_000, 10_000)):
        monkeypatch.setattr(scan, "BLOCK_ROWS", rows_at_once)
        monkeypatch.setattr(scan, "BLOCK_CELLS", cells)
        parts = [batch.slice(i, 37) for i in range(0, len(rows), 37)]
        got = [r for b in scan._scanner(Plan, ["w0", "w1"], 20, 6)(parts) for r in zip(*b.to_pydict().values())]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_words_are_cut_apart_as_by_the_expression(spark):
    """plain words come to the index as one string, and a scan's postings as numbers, with the same terms."""
    from pyspark.sql import functions as F

    from rankspark.functions.analysis import DEFAULT, PIPELINE, tokenize
    from rankspark.operators import index as I

    texts = ["", None, " ", "a", "--Aé b  c\tÉ\n", "İstanbul ǅ 1²x٣", "x y z", "日本 語。", "no-end", "́e\U0001d7ce �"]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, title string, abstract string").coalesce(1)
    want = {r.doc_id: sorted(r.t) for r in docs.select("doc_id", tokenize(F.col("title")).alias("t")).collect()}
    index = build_index(docs, ("title", "abstract"))
    rows = {r.doc_id: sorted(e.term for e in r.entries for _ in range(e.tf)) for r in index.tokenized.filter("field = 'title'").collect()}
    assert rows == want and DEFAULT.plain and not PIPELINE.plain
    assert "array" not in str(index.coded._jdf.queryExecution().optimizedPlan().children().head().schema())  # a string a field, not a list
    numbered = I.postings_by_document(index, ["abstract", "title"], pa.array(["b", "a", "none"]), True)[0]
    assert sorted(map(tuple, numbered.collect())) == [(0, 4, 1, 4), (1, 4, 1, 4), (2, 3, 1, 1), (3, 3, 1, 1)]


def test_stemmed_search_reads_the_asked_terms_alone(spark, tmp_path):
    """The postings of the terms behind the asked stems come from the stored index, put together by document, not by a join of all."""
    from rankspark.functions.analysis import PIPELINE, Analyzer

    words = ["gene", "genes", "study", "studies", "braf", "cell", "cells", "the", "mouse"]
    rows = [(i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 2 + i % 11))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = write_index(build_index(docs, ("text",), analyzer=Analyzer(stop_words=PIPELINE.stop_words)), str(tmp_path / "plain"))
    mapped, direct = stemmed_index(stored), build_index(docs, ("text",), analyzer=PIPELINE)
    q = spark.createDataFrame([(1, "genes studies"), (2, "cell of the mice"), (3, "braf braf cells study"), (4, "absent")], "topic_id int, text string")
    rows, whole = postings_by_document(mapped, ["text"], pa.array(["gene", "study"]), True)
    assert whole and rows.columns == ["key", "doc_id", "tf", "dl"]
    assert rows.count() == direct.postings.filter("term IN ('gene', 'study')").count()
    for model in ("bm25_doc", "bb2"):
        assert sorted(S.search(mapped, q, model, "document", 20).collect()) == sorted(S.search(direct, q, model, "document", 20).collect())
    twice = write_index(build_index(docs.union(docs.limit(5)), ("text",), analyzer=Analyzer(stop_words=PIPELINE.stop_words)), str(tmp_path / "twice"))
    again = stemmed_index(twice)
    assert not postings_by_document(again, ["text"], pa.array(["gene"]), True)[1]
    assert S.search(again, q, "bm25_doc", "document", 20).count() > 0
