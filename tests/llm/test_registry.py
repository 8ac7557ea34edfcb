import duckdb

import __spark_entry__ as entry
from rankspark.llm import quality, registry


def test_queries_match_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in registry.ORACLE.items():
        got = registry.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols, name
        b = sorted(con.sql(f"SELECT {', '.join(cols)} FROM rel").fetchall(), key=repr)
        assert a == b, name


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(registry.ORACLE) <= set(entry.oracle_sql())


def test_other_queries_cover_their_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op4_token_cache", "op10_pii_bilstm_crf"):
        assert registry.QUERIES[name](spark, sf).count() == n


def test_ablations_reach_every_policy(spark, sf):
    assert registry.op8_policy_ablations.__name__ in registry.QUERIES and "op8_policy_ablations" in registry.ORACLE
    rows = registry.op8_policy_ablations(spark, sf).collect()
    assert {(r.policy, r.rule) for r in rows} == {(p.version, r) for p in quality.POLICIES.values() for r in p.rules}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = ["policy", "rule", "n_failed", "n_only", "kept", "kept_without"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.OP8_ABLATIONS_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(want)
    v3 = registry.op8_quality_ledger(spark, sf).filter("kept").count()
    assert {r.kept for r in rows if r.policy == "v3"} == {v3}
