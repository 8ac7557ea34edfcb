import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rankspark.llm import simhash as S
from rankspark.llm.common import connected_components

UP = {c: c + 32 for c in range(65, 91)}


def brute_fp(text, k=3):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, radius):
    """nodes: {id: fp}; smallest id reachable."""
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(nodes)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (nodes[i] ^ nodes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = rnd.choice(["\t", " ", "\n\n"]).join(rnd.choice(["A", "b", "Ét", "c d"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == brute_fp(t)
    assert S.fingerprint(None) == 0


def _nodes(seed, n=260, radius=3):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(set(out)) < n:
        x = rnd.choice(out[-40:])
        for b in rnd.sample(range(64), rnd.randint(1, radius + 2)):
            x ^= 1 << b
        out.append(x)
    return dict(enumerate(dict.fromkeys(out)))


def test_links_within_a_unit():
    for radius in (1, 2, 3, 4, 7):
        fps = np.array(list(_nodes(radius, 200, radius).values()), np.uint64)
        found = S.links(fps, np.zeros(len(fps), np.int64), radius)
        assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= radius for i, j in found)
        want = brute_components(dict(enumerate(map(int, fps))), radius)
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in found:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


def test_near_pairs_keep_every_component(spark):
    nodes = _nodes(9, 300)
    want = brute_components(nodes, 3)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in nodes.items()], "id long, fp long")
    for agree, bucket_rows in ((1, 4096), (1, 3), (2, 5), (3, 4096)):
        got = {r.node: r.root for r in connected_components(S.near_pairs(df, 3, bucket_rows, agree)).collect()}
        assert {i: got.get(i, i) for i in nodes} == want


def test_near_duplicates(spark, odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    docs = odd_docs.collect()
    fps = {r.doc_id: brute_fp(r.text) for r in docs if r.doc_id is not None}
    want = brute_components(fps, 3)
    assert {r.id: r.component for r in rows if r.id is not None} == want
    assert all(r.fp % (1 << 64) in {brute_fp(d.text) for d in docs if d.doc_id == r.id} for r in rows)
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(200, 260)] + [(259, 99), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(11, 61)) and all(got[i] == 99 for i in [100, *range(200, 260)])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_corpus_against_brute_force(spark, sf):
    from rankspark.llm import registry

    docs = {r.doc_id: brute_fp(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_components(docs, 3)
    got = registry.op6_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in docs.items()}
    assert F is not None


def test_keep_one_with_repeated_and_null_ids(spark):
    rnd = random.Random(12)
    a, b, c, e = (" ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(4))
    rows = [(1, a), (2, a), (1, b), (3, b), (4, c), (4, c), (4, e), (5, e), (None, c), (None, "quite alone here"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.text) for r in S.keep_one(d.repartition(parts)).collect()), key=repr)
        assert got == sorted([(1, a), (1, b), (4, c), (4, e), (None, "quite alone here"), (None, None)], key=repr)
    # Unlinked groups that share their smallest id stay two: before, 3 and 5 went with the arbitrary row of 1 and 4.
    one = {(r.id, r.component) for r in S.near_duplicates(d).collect()}
    assert {(2, 1), (3, 1), (5, 4)} <= one
    same = spark.createDataFrame([(7, "A b c"), (7, "a B c"), (7, "a b c")], "doc_id long, text string")
    assert [r.text for r in S.keep_one(same.repartition(3)).collect()] == ["A b c"]


def test_keep_one_with_clashing_names(spark):
    text = "one two three four five six seven"
    d = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, "alone a b c"), (None, "alone a b c")], "doc_id long, text string")
    for c in ("__fp", "__id", "__row", "__known", "id", "fp", "row", "c0", "a.b"):
        d = d.withColumn(c, F.lit("x"))
    got = S.keep_one(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [(1, text), (None, "alone a b c")]
