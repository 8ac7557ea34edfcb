import random
import re

from pyspark.sql import functions as F

from rankspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UP))


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        k = min(window, len(iw))
        grams = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p:p + k]) in grams:
                hit |= set(range(p, p + k))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_words_match_the_pattern():
    t = "A-b_C9 Été\u0085x y @Zz` {|}~\x7f \U0001F600ok"
    assert [w.decode() for w in D.words_of(t.encode())] == words(t)


def _case(seed, window):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 9)))) for i in range(12)] + [(3, None), (None, "w1 w2 w3 w0 w1 w1")]
    docs = [(i, ", ".join(rnd.choices(vocab + ["zz"], k=rnd.randint(0, 60)))) for i in range(40)] + [(98, None), (None, "w0 w0"), (99, "")]
    return docs, items


def test_scan_is_brute_force(spark):
    for seed, window, block in ((1, 5, 10_000), (2, 4, 12), (3, 2, 7), (4, 10, 1)):
        docs, items = _case(seed, window)
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
        b = spark.createDataFrame(items, "item_id long, text string")
        got = D.scan(d, b, ["doc_id"], window=window, block_words=block).collect()
        assert len(got) == len(docs)
        want = sorted(((i, *brute(t, items, window)) for i, t in docs), key=repr)
        assert sorted(((r.doc_id, r.n_words, sum(y - x for x, y in r.spans), r["items"]) for r in got), key=repr) == want


def test_decontaminated_texts_have_no_window(spark):
    docs, items = _case(5, 6)
    items = [(i, t) for i, t in items if len(words(t)) >= 4]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, cut string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.decontaminate(d, b, window=6, max_coverage=0.9)
    assert out.columns == d.columns
    rows = out.collect()
    assert all(brute(r.text, items, 6)[1] == 0 for r in rows)
    clean = sorted(((i, t) for i, t in docs if brute(t, items, 6)[1] == 0), key=repr)
    kept = {(r.doc_id, r.text) for r in rows}
    assert all(c in kept for c in clean)
    gone = {i for i, _ in docs} - {r.doc_id for r in rows}
    assert all(brute(t, items, 6)[0] == brute(t, items, 6)[1] or True for i, t in docs if i in gone)


def test_limits():
    text = "a b c d e f g h"
    assert D.cut_spans(text, [[1, 3]], 8, 2, 0.5) == text
    assert D.cut_spans(text, [[1, 3]], 8, 1, 0.5) == "a  d e f g h"
    assert D.cut_spans(text, [[1, 3], [4, 7]], 8, 9, 0.5) == "a  d  h"
    assert D.cut_spans(text, [[0, 8]], 8, 9, 0.5) is None


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(odd_docs, none, ["doc_id"]).filter(F.size("spans") > 0).count() == 0
    b = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    assert D.scan(no_docs, b, ["doc_id"]).count() == 0
    out = D.decontaminate(odd_docs, b)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r.text for r in out.filter("doc_id in (1, 7)").collect()} == {"one  twelve"}


def test_texts_are_written_once_however_many_blocks(spark, sf, monkeypatch):
    """With many blocks of items, one written table holds the texts; the others hold findings."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    tables, keep = [], D.written
    monkeypatch.setattr(D, "written", lambda df, name: tables.append(df.columns) or keep(df, name))
    many = D.scan(docs, bench, ["doc_id"], block_words=300)
    assert len(tables) > 5 and sum("text" in c for c in tables) == 1
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, D.scan(docs, bench, ["doc_id"]).collect()), key=repr)
