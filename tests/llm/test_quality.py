import random
import re
from collections import Counter

from rankspark.llm import quality as Q


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {q for i, g in enumerate(grams) if n[g] > 1 for q in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(hit), "n_distinct": len(set(w)),
            "n_letters": sum(c.isalpha() for c in t), "n_upper": sum(c.isupper() for c in t)}


def fails(m):
    return [m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
            m["n_dup_lines"] >= 3 and 10 * m["n_dup_lines"] > 3 * m["n_lines"], m["word_chars"] > 30 * m["n_words"],
            20 * m["n_distinct"] < m["n_words"], 2 * m["n_upper"] > m["n_letters"]]


def test_ledger_is_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a ", "b ", "B", "éÉ ", "\n", "# ", "| ", "\t", "word ", "\x0b"]) for _ in range(rnd.randint(0, 300)))
             for _ in range(150)]
    rep = " ".join(str(i) for i in range(40))
    texts += [rep + " " + rep, rep + " x " + " ".join(str(i) for i in range(8)), "a " * 500, "SHOUT " * 30, None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.id: r for r in Q.ledger(d).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: rows[i][k] for k in want} == want, repr(t)
        assert rows[i].failed == sum(1 << k for k, f in enumerate(fails(want)) if f)
    odd = Q.ledger(odd_docs)
    assert odd.count() == odd_docs.count() and Q.ledger(no_docs).count() == 0


def test_policies_and_ablations(spark):
    rnd = random.Random(4)
    bits = [rnd.choice([0, 0, 1, 2, 3, 4, 12, 64, 65]) for _ in range(300)]
    book = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "id long, failed long")
    got = {(r.policy, r.rule): r for r in Q.ablations(book, list(Q.POLICIES.values())).collect()}
    names = list(Q.RULES)
    assert len(got) == sum(len(p.rules) for p in Q.POLICIES.values())
    for p in Q.POLICIES.values():
        kept = Q.apply_policy(book, p).filter("kept").count()
        assert kept == sum(not b & p.mask for b in bits)
        for rule in p.rules:
            bit, r = 1 << names.index(rule), got[p.version, rule]
            assert (r.n_failed, r.n_only, r.kept, r.kept_without) == (
                sum(bool(b & bit) for b in bits), sum(b & p.mask == bit for b in bits), kept,
                sum(not b & p.mask & ~bit for b in bits))


def test_clean_documents_stay(spark, sf):
    book = Q.apply_policy(Q.ledger(spark.read.parquet(f"{sf}/documents.parquet")), Q.POLICIES["v3"])
    good = book.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), book.id == spark.read.parquet(f"{sf}/labels.parquet").doc_id) \
        if False else book.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").withColumnRenamed("doc_id", "id"), "id")
    assert good.filter("n_words >= 20 and not kept").count() == 0


def test_stored_ledger(spark, sf, tmp_path, odd_docs, no_docs):
    path = f"file://{tmp_path}/ledger"
    assert Q.read_ledger(spark, path) is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = docs.filter("doc_id % 2 = 0")
    assert Q.update_ledger(half, path).count() == half.count()
    whole = Q.update_ledger(docs, path)
    assert sorted(whole.drop("digest").select(Q.ledger(docs).columns).collect()) == sorted(Q.ledger(docs).collect())
    files = len(whole.inputFiles())
    assert Q.update_ledger(docs, path).count() == docs.count() and files > 0  # nothing to add
    # A known text under a new id takes its measurements over; a new text under a known id is measured.
    more = docs.filter("doc_id = 4").selectExpr("doc_id + 100000 doc_id", "text").unionByName(docs.filter("doc_id = 5").selectExpr("doc_id", "'new text' text"))
    grown = Q.update_ledger(more, path)
    assert grown.count() == docs.count() + 2
    a, b = (grown.filter(f"id = {i}").drop("id").first() for i in (4, 100004))
    assert a == b and grown.filter("id = 5").count() == 2
    # Policies and ablations of the stored ledger touch no document.
    out = Q.ablations(grown, list(Q.POLICIES.values()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "text" not in plan
    odd = f"file://{tmp_path}/odd"
    clashing = odd_docs.withColumnRenamed("fp", "failed").withColumnRenamed("component", "digest")
    assert Q.update_ledger(no_docs, odd).count() == 0
    assert Q.update_ledger(clashing, odd).count() == odd_docs.count()
    assert Q.update_ledger(clashing, odd).count() == odd_docs.count()
    assert Q.rules_version() in Q.read_ledger(spark, odd).inputFiles()[0]


def test_other_rules_have_a_ledger_of_their_own(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    d = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    Q.update_ledger(d, path)
    monkeypatch.setitem(Q.RULES, "min_words", "n_words < 1")
    assert Q.read_ledger(spark, path) is None
    assert [r.failed & 1 for r in Q.update_ledger(d, path).collect()] == [0]
