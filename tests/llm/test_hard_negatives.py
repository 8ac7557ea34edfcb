import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import hard_negatives as H

SMALL = dict(sample_rows=300, block_rows=64, query_rows=8)


def brute(rows, is_anchor, scale=256):
    """rows: (id, vector, label)."""
    good = [(i, [int(np.floor(scale * x)) for x in v], c) for i, v, c in rows
            if i is not None and v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, c) in enumerate(good):
        if not is_anchor(i):
            continue
        score = [sum(a * b for a, b in zip(v, w)) for _, w, _ in good]
        order = sorted((j for j in range(len(good)) if j != k), key=lambda j: (-score[j], good[j][0]))
        for p in [j for j in order if good[j][2] == c][:5]:
            fits = [j for j in order if good[j][2] != c and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            out += [(i, good[p][0], r, good[j][0], score[p], score[j]) for r, j in enumerate(fits[:10], 1)]
    return sorted(out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def found(df):
    assert df.columns == [c.split(" ")[0] for c in H.RESULT.split(", ")]
    return sorted(map(tuple, df.collect()))


def clusters(seed, n, dim, groups, spread):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(groups, dim))
    own = rnd.integers(0, groups, n)
    v = (centre[own] + spread * rnd.normal(size=(n, dim))).astype(np.float32)
    return [(i, v[i].tolist(), int(rnd.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_brute_force(spark, spread):
    rows = clusters(3, 700, 6, 12, spread)
    got = found(H.mine(frame(spark, rows), F.col("id") % 10 == 0, **SMALL))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_copies_of_one_vector(spark):
    """A third of the rows are one vector: its leaf is dealt out to several blocks and ties go by id."""
    rows = clusters(5, 400, 5, 6, 0.3)
    rows += [(1000 + k, rows[7][1], k % 3) for k in range(200)]
    assert found(H.mine(frame(spark, rows), F.col("id") % 20 == 0, **SMALL)) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(7, 60, 3, 3, 0.5)
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (110, [1.0, None, 1.0], 1), (120, [nan, 1.0, 1.0], 2), (130, [inf, 0.0, 0.0], 1),
             (140, [1.0, 1.0, 1.0], None), (150, [], 1), (160, [2.0], 1), (170, [1.0, 1.0, 1.0, 3.0], 2), (10, rows[10][1], 3),
             (10, rows[10][1], rows[10][2]), (180, [0.0, 0.0, 0.0], 0)]
    docs = frame(spark, rows, "double")
    for c in ("id", "row", "leaf", "part", "set", "q", "vector", "low", "a.b"):
        docs = docs.withColumn(c, F.lit("x"))
    assert found(H.mine(docs, F.col("id") % 10 == 0, **SMALL)) == brute(rows, lambda i: i % 10 == 0)
    assert found(H.mine(frame(spark, []), F.lit(True))) == []
    assert found(H.mine(frame(spark, [(1, [1.0], 1)]), F.lit(True))) == []
    assert found(H.mine(frame(spark, [(None, [1.0], 1)]), F.lit(True))) == []


def test_subtrees_are_left_out_and_none_wrongly(spark):
    """On rows in groups, few leaves are reached, and those hold every row of the window."""
    rows = clusters(11, 3000, 8, 40, 0.02)
    index = H.Index(frame(spark, rows), "vec_id", "embedding", F.col("label"), 256, block_rows=256)
    data = index.table.toArrow()
    v, leaf = H.matrix(data.column("vector"), 8), data.column("leaf").to_numpy()
    asked, score = v[:50], H.products(v[:50], v)
    low = np.partition(score, -20, axis=1)[:, -20].astype(float)
    high = np.partition(score, -5, axis=1)[:, -5].astype(float)
    reached = {(leaf, q) for leaf, own in H.reached(index.tree, asked, low, high) for q in own.tolist()}
    need = {(int(leaf[x]), q) for q in range(50) for x in np.flatnonzero((score[q] >= low[q]) & (score[q] <= high[q]))}
    assert need <= reached
    assert len(reached) < 0.2 * 50 * index.tree.leaves
    ranges = [n for n in index.tree.nodes]
    assert ranges and all(n.least.shape == (8, 8) and (n.least <= n.most).any() for n in ranges)


def test_large_components_stay_exact():
    a = np.array([[2 ** 30, 3], [2 ** 29, 5]])
    assert H.products(a, a).tolist() == [[2 ** 60 + 9, 2 ** 59 + 15], [2 ** 59 + 15, 2 ** 58 + 25]]
