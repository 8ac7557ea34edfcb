import duckdb

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
FAST = ["run_bm25_flat", "run_bm25_doc", "run_fusion_doc", "lexicon", "eval_summary", "term_ids", "merge_stored_index",
        "run_enriched", "response_nested", "xml_roundtrip", "topics_xml_roundtrip", "qrels_view", "run_bm25_doc_pipeline",
        "request_evaluate_topics"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["topic_id", "doc_id", "rank", "score"]
    assert df.count() > 0


def test_every_query_has_oracle():
    from rankspark.plans.queries import ORACLE, QUERIES

    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry_mod.queries())
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_oracle_stands_alone():
    """The SQL side of the evaluation takes nothing from the Spark side."""
    import inspect

    from rankspark.plans import oracle

    assert "operators" not in inspect.getsource(oracle)


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


def test_oracle_agreement_small(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in FAST:
        sp = entry_mod.queries()[name](spark, SF)
        cols = sorted(sp.columns)
        a = _norm([tuple(r[c] for c in cols) for r in sp.collect()])
        dk = con.sql(entry_mod.oracle_sql()[name])
        b = _norm(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM dk").fetchall())
        assert a == b, name
