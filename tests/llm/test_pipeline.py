import re
from collections import Counter

import corpus_pipeline as CP
from tokenizers import Tokenizer
from rankspark.llm import packing, pii, registry
from rankspark.llm.common import written

from test_decontaminate import brute as windows_hit
from test_simhash import brute_components, brute_fp


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in CP.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), f"test-{name}"))
    before, lang, one, clean, masked, packed = (x.collect() for x in seen)
    assert all(x.columns == docs.columns for x in seen[1:5])
    # 7: only texts without a letter, or of no prevailing language, go.
    assert {r.doc_id for r in before} - {r.doc_id for r in lang} >= {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")}
    assert len(lang) >= 0.97 * len(before)
    # 6: one of each component.
    roots = brute_components({r.doc_id: brute_fp(r.text) for r in lang}, 3)
    assert sorted(r.doc_id for r in one) == sorted(set(roots.values()))
    # 2: untouched where no window is, none left anywhere.
    text = {r.doc_id: r.text for r in clean}
    for r in one:
        n, hit, _ = windows_hit(r.text, items, 10)
        assert text.get(r.doc_id) == r.text if not hit else (hit == n or r.doc_id in text)
    assert all(windows_hit(r.text, items, 10)[1] == 0 for r in clean)
    # 10: every document stays, no base span is left, texts without one keep their words.
    assert sorted(r.doc_id for r in masked) == sorted(text)
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in masked)
    same = {r.doc_id: r.text for r in masked}
    assert all(same[i] == t for i, t in text.items() if not re.search("[0-9@]", t))
    # 3: every token of every document is packed once, and no batch holds more than the budget.
    total, batches = Counter(), Counter()
    for r in packed:
        total[r.doc_id] += r.n_tokens
        batches[r.bucket, r.batch] += r.bucket_len
    tok = Tokenizer.from_str(registry.tokenizer_definition())
    assert dict(total) == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in masked}
    assert max(batches.values()) <= packing.BUDGET


def test_run_is_the_stages(spark, sf):
    rows = CP.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len", "batch", "slot"]
    assert rows.groupBy("bucket", "batch", "slot").count().filter("count > 1").count() == 0


def test_odd_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        cur = docs
        for _, stage in CP.STAGES[:-1]:
            cur = stage(spark, cur, sf)
            assert cur.columns == docs.columns
        assert CP.STAGES[-1][1](spark, cur, sf).count() >= 0
    assert cur.count() == 0
