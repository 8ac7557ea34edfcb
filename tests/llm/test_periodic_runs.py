import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankspark.llm import periodic_runs as R
from rankspark.llm import registry


def brute(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out[i, j + q] = min(q, out.get((i, j + q), q))
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def planted(rnd):
    k = rnd.choice([1, 2, 2, 3, 4, 8])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, rnd.choice([12, 40, 150])))]
    for _ in range(rnd.randint(0, 3)):
        u = [rnd.randrange(k) for _ in range(rnd.randint(1, 8))]
        u = u * 4 + [rnd.randrange(k)] if rnd.random() < .3 else u
        at = rnd.randint(0, len(w))
        w[at:at] = (u * rnd.randint(3, 9))[:rnd.randint(4, 60)]
    return w, k


def test_runs_against_brute_force():
    rnd = random.Random(8)
    for _ in range(1500):
        w, k = planted(rnd)
        assert R.runs_of(np.array(w, np.int64), k) == brute(w), w


def test_grammar_stands_for_the_words():
    rnd = random.Random(9)
    for _ in range(200):
        w, k = planted(rnd)
        if len(w) < 2:
            continue
        g = R.Grammar(np.array(w, np.int64), k)

        def expand(x):
            return [x] if x < k else [y for z in g.rules[x - k] for y in expand(z)]

        assert [x for s in g.symbols.tolist() for x in expand(s)] == w
        for r, place in enumerate(g.places):  # each rule stands where its places say, more than once
            e = expand(k + r)
            assert len(e) == g.sizes[r] and w[place:place + len(e)] == e
            at = g.derivations({r})[r].tolist()
            assert len(at) > 1 and place in at and all(w[p:p + len(e)] == e for p in at)
        pairs = list(zip(g.symbols.tolist(), g.symbols[1:].tolist()))
        twice = {p for p in pairs if pairs.count(p) > 1}
        assert all(a == b for a, b in twice)  # only places that overlap are left


def test_long_and_hard_sequences():
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    assert R.runs_of(np.array(b), 2) == brute(b)  # Fibonacci words hold no fourth power
    rnd = random.Random(2)
    two = [rnd.randrange(2) for _ in range(3000)]
    assert R.runs_of(np.array(two), 2) == brute(two)
    blocks = sum(([0] * 33 + [rnd.randrange(1, 40)] for _ in range(80)), [])
    assert R.runs_of(np.array(blocks), 40) == brute(blocks)
    assert R.runs_of(np.zeros(200_000, np.int64), 1) == [(0, 200_000, 1)]
    assert R.runs_of(np.tile(np.arange(500), 4), 500) == [(0, 2000, 500)]
    assert R.runs_of(np.tile(np.arange(500), 4)[:-1], 500) == []


def collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_odd_tables(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("runs", F.lit("x")).withColumn("c0", F.lit("y"))
    out = R.find_runs(docs, [F.col("doc_id"), F.col("`a.b`"), F.col("runs").alias("kept")])
    assert out.columns == ["doc_id", "a.b", "kept", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = R.runs_of(np.array([words.index(w) for w in words], np.int64), max(1, len(words)))
        want.append((r.doc_id, len(words), tuple(runs), collapse(words, runs)))
    assert got == sorted(want, key=repr)
    assert any(n == 10400 and runs[0][2] == 13 for _, n, runs, _ in got)
    assert R.find_runs(no_docs, [F.col("doc_id")]).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = {r.doc_id: r for r in registry.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    checked = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if n > 2500:
            continue  # the plain way is quadratic
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            checked += 1
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = rows[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e},{q}\n" for s, e, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert checked > 5
