import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from rankspark.llm import packing as P


def cost(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist.items())


def test_bounds_are_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        hist = {rnd.randint(0, 40): rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))}
        k = rnd.randint(1, 5)
        got = P.optimal_bounds([*hist], [*hist.values()], k)
        sizes = sorted(hist)
        best = min(cost(hist, (*c, sizes[-1])) for r in range(min(k, len(sizes)))
                   for c in itertools.combinations(sizes[:-1], r))
        assert cost(hist, got) == best and got[-1] == sizes[-1] and len(got) == min(k, len(sizes))
    assert P.optimal_bounds([], [], 3) == []


def test_pack(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    texts = [(i, " ".join("w" * 3 for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    rows = P.pack(d, max_len=32, n_buckets=3, budget=70).collect()
    total = Counter()
    for r in rows:
        total[r.id] += r.n_words
        assert r.start == 32 * r.piece and r.n_words <= r.bucket_len <= 32
    assert total == Counter({i: len(t.split()) for i, t in texts}) + Counter() or all(
        total[i] == len(t.split()) for i, t in texts)
    assert {r.id for r in rows} == {i for i, _ in texts}
    for b, own in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch, r.slot)), key=lambda r: r.bucket):
        own = list(own)
        m = max(1, 70 // max(1, own[0].bucket_len))
        assert [(r.batch, r.slot) for r in own] == [divmod(i, m) for i in range(len(own))]
        assert [(r.id, r.piece) for r in own] == sorted((r.id, r.piece) for r in own)
    assert P.pack(no_docs).count() == 0
    odd = P.pack(odd_docs, max_len=100)
    assert odd.select("id").distinct().count() == odd_docs.select("doc_id").distinct().count()
    words = lambda t: len((t or "").split())
    assert odd.agg(F.sum("n_words")).first()[0] == sum(words(r.text) for r in odd_docs.collect())


def test_token_batches_hold_the_budget_in_tokens(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline as CP
    from rankspark.llm import registry
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(registry.tokenizer_definition())
    texts = ["\u65e5\u672c\u8a9e\u306e\u6587" * 3000, "QUJD" * 4000 + "x", "a plain text of words", "", None] + ["\u6f22\u5b57" * 900] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert want[0] > P.MAX_LEN
    for rows in (registry.op3_length_buckets(spark, str(tmp_path)).collect(), CP.pack_batches(spark, docs, "").collect()):
        total, batches = Counter(), Counter()
        for r in rows:
            total[r.doc_id] += r.n_tokens
            batches[r.bucket, r.batch] += r.bucket_len
            assert r.start == P.MAX_LEN * r.piece and r.n_tokens <= r.bucket_len <= P.MAX_LEN
        assert dict(total) == want and max(batches.values()) <= P.BUDGET
    assert "pipeline_tokens" in entry.queries()


def test_token_slots_match_the_sql_over_their_lengths(spark, sf):
    """DuckDB cannot count tokens, but it can pack the counts."""
    import duckdb
    from rankspark.llm import registry, token_cache

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = token_cache.lengths(docs, registry.tokenizer_definition()).toPandas().rename(columns={"id": "doc_id", "n_tokens": "n"})
    con = duckdb.connect()
    con.register("lengths", lengths)
    rows = registry.op3_length_buckets(spark, sf)
    cols = rows.columns
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.op3_sql('SELECT doc_id, n::BIGINT AS n FROM lengths', 'n_tokens')})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)
