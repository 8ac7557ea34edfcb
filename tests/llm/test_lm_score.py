import math
from collections import Counter

import numpy as np
import pytest

from rankspark.llm import lm_score as L


def brute(docs, targets, mu, leave_one_out=False):
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    vocabulary = len(set().union(*words.values()))
    models = []
    for pick in (lambda i: i in targets, lambda i: True):
        uni, bi = Counter(), Counter()
        for i, x in words.items():
            if pick(i):
                uni.update(x)
                bi.update(zip(x, x[1:]))
        models.append((uni, bi, sum(uni.values())))
    out = {}
    for i, x in words.items():
        loss = []
        for k, (uni, bi, n) in enumerate(models):
            if leave_one_out and (k or i in targets):
                uni, bi, n = uni - Counter(x), bi - Counter(zip(x, x[1:])), n - len(x)
            p1 = lambda w: (uni[w] + 1) / (n + vocabulary)  # noqa: B023, E731
            ls = [-math.log(p1(w)) if k == 0 else -math.log((bi[x[k - 1], w] + mu * p1(w)) / (uni[x[k - 1]] + mu))
                  for k, w in enumerate(x)]
            loss.append(sum(ls) / len(ls) if ls else None)
        out[i] = (len(x), *loss, loss[0] - loss[1] if x else None)
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200}, {"block_bytes": 10_000}, {"block_bytes": 200, "leave_one_out": True}])
def test_scores_are_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["aa", "Bb", "cc", "dé", "ee"], rng.integers(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " rare words here "), (103, "aa " * 2000)]
    targets = set(range(0, 60, 3))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "x long")
    got = L.cross_entropy_difference(d, t, mu=3.0, **sizes).collect()
    want = brute(docs, targets, 3.0, "leave_one_out" in sizes)
    assert len(got) == len(docs)
    for r in got:
        n, *loss = want[r.id]
        assert r.n_words == n and r.target == int(r.id in targets)
        assert [r.target_loss, r.background_loss, r.score] == (pytest.approx(loss, rel=1e-9, abs=1e-9) if n else loss)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, {r.doc_id for r in good.collect()}, L.MU)
    got = {r.id: r for r in L.cross_entropy_difference(docs, good, block_bytes=1 << 17).collect()}
    assert len(got) == len(rows)
    for i, (n, _, _, score) in want.items():
        assert got[i].n_words == n and (got[i].score == pytest.approx(score, abs=1e-9) if n else got[i].score is None)


def test_packed_numbers_come_back():
    for x in ([], [0], [1, 255, 256, (1 << 64) - 1]):
        assert L.unpacked(L.packed(np.array(x, np.uint64))).tolist() == x


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long")
    rows = L.cross_entropy_difference(odd_docs, none, block_bytes=100).collect()
    assert len(rows) == odd_docs.count() and all((r.score is None) == (r.n_words == 0) for r in rows)
    assert L.cross_entropy_difference(no_docs, none).count() == 0


def test_closer_documents_score_lower(spark, sf):
    from rankspark.llm import registry

    s = registry.op5_cross_entropy_difference(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    mean = {r.quality: r.m for r in s.groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert mean[1] < mean[0]


@pytest.mark.parametrize("bits", [1, 2])
def test_more_levels_change_nothing(spark, bits):
    """A tree of several levels gives the scores of brute force too."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["aa", "Bb", "cc", "dd", "ee", "f", "g"], rng.integers(0, 30)))) for i in range(80)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i,) for i in range(0, 80, 4)], "x long")
    got = {r.id: r.score for r in L.cross_entropy_difference(d, t, mu=3.0, block_bytes=500, fan_bits=bits).collect()}
    for i, (n, _, _, score) in brute(docs, set(range(0, 80, 4)), 3.0).items():
        assert got[i] == (pytest.approx(score, abs=1e-9) if n else None)


def test_rows_follow_the_blocks(spark):
    """Ten, twenty and forty blocks send rows in proportion, not with their square."""
    counts = []
    for n in (10, 20, 40):
        rows = [(i, " ".join(f"w{i}x{k}" for k in range(300)), 0, i) for i in range(n)]
        blocks = spark.createDataFrame(rows, "id long, text string, target int, block int")
        counts.append(L.block_counts(blocks).count())
    assert counts == [64 * n for n in (10, 20, 40)]


def test_a_block_that_changed_is_noticed():
    import pyarrow as pa

    keys = np.array([3, 9, 1 << 60], np.uint64)
    piece = L._pieces(keys, [np.array([1, 2, 3])] * 2, 0, 0, 0)
    group = [L._Group(piece.slice(k, 1)) for k in range(piece.num_rows)]
    found = pa.concat_tables([pa.Table.from_arrays(g.answers(piece.slice(k, 1), g.sums), names=L._names(L.TOTALS)[:6])
                              for k, g in enumerate(group)])
    assert L._joined(found, keys)[0].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        L._joined(found, np.array([3, 10, 1 << 60], np.uint64))
    with pytest.raises(ValueError):
        L._joined(found, keys[:2])
