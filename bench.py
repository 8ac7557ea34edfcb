"""Benchmark: index build once, then the headline searches and evaluation.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line. Each query is forced to completion with the ``noop``
sink (no collect to the driver). ``value`` is the sum of the query times;
index builds are reported separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankspark.functions.text import ARTICLE_FIELDS, article_fields  # noqa: E402
from rankspark.operators import evaluate as E  # noqa: E402
from rankspark.operators.index import build_index, write_index  # noqa: E402
from rankspark.operators.search import search, search_fused  # noqa: E402
from rankspark.plans import testbed as T  # noqa: E402
from rankspark.plans.queries import topic_queries  # noqa: E402
from rankspark.session import get_spark, scratch_path  # noqa: E402


def timed(fn):
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS") or 8)
    os.environ.setdefault("RANKSPARK_DRIVER_MEMORY", "16g")
    spark = get_spark(f"local[{cpus}]", app="rankspark-bench", shuffle_partitions=2 * cpus)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    builds, times = {}, {}

    holder = {}

    def build_docs():
        holder["docs"] = write_index(
            build_index(T.table(spark, sf_dir, "documents"), ("text",)), scratch_path(spark, "bench-docs"))

    def build_articles():
        holder["art"] = write_index(
            build_index(article_fields(T.articles_view(spark, sf_dir)), ARTICLE_FIELDS),
            scratch_path(spark, "bench-articles"))

    builds["index_docs"] = timed(build_docs)
    builds["index_articles"] = timed(build_articles)
    docs, art = holder["docs"], holder["art"]
    free = T.free_text_queries(spark, sf_dir)
    topics = topic_queries(spark, sf_dir)
    qrels = T.qrels_view(spark, sf_dir).persist()
    qrels.count()

    times["bm25_flat"] = timed(lambda: run(search(docs, free, "bm25_field", "field_max", 20)))
    times["bm25_fieldmax"] = timed(lambda: run(search(art, topics, "bm25_field", "field_max", 1000)))
    times["dfr_fieldmax"] = timed(lambda: run(search(art, topics, "dfr_gbh2", "field_max", 1000)))
    times["bm25_doc"] = timed(lambda: run(search(art, topics, "bm25_doc", "document", 20)))
    times["dfr_doc"] = timed(lambda: run(search(art, topics, "bb2", "document", 20)))
    times["fusion_doc"] = timed(lambda: run(search_fused(art, topics, "bm25_doc", "bb2", "document", 20)))
    times["find_text"] = timed(lambda: run(search(docs, free, "bm25_doc", "document", 10)))

    def evaluation():
        by_topic, summ = E.evaluate(search(art, topics, "bm25_field", "field_max", 1000), qrels, check=True)
        run(summ)
    times["evaluate_fieldmax"] = timed(evaluation)

    out = {"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "index_build_sec": builds, "sf": float(sf) if sf else sf_dir,
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
