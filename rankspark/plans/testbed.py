"""Bindings from the driver tables to the retrieval data model.

  articles_view  documents -> (id, title, abstract, keywords, meshHeadings):
                 title = text up to the first newline, abstract = the rest,
                 keywords = [lang, source], one mesh heading (lang, source)
  topics_all     benchmark -> topics of set 'bench': the words of the item in
                 three consecutive parts of equal length (the first ones take
                 the remainder) as disease / gene / treatment
  free text      benchmark (item_id, text) as queries
  qrels_view     by the share of an item's distinct word n-grams (GRAM words,
                 or all words of a shorter item) that the document has: grade
                 2 from FULL_SHARE on, 1 from PART_SHARE on; grade = quality
                 for labelled documents assigned to item
                 ``pmod(doc_id, n_items)`` (each labelled document is judged
                 for one item, so the judgement table grows linearly with the
                 labels); the higher grade counts
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.analysis import TOKEN_SPLIT, tokenize
from rankspark.operators.guards import BROADCAST_MAX_ROWS, checked_broadcast
from rankspark.session import map_arrow

TOPIC_SET = "bench"
GRAM = 5
FULL_SHARE = 0.5
PART_SHARE = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def articles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    nl = F.instr(text, "\n")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(nl > 0, F.expr("substring(coalesce(text, ''), 1, instr(coalesce(text, ''), '\n') - 1)"))
        .otherwise(text).alias("title"),
        F.when(nl > 0, F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)"))
        .otherwise(F.lit("")).alias("abstract"),
        F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("keywords"),
        F.array(F.struct(F.coalesce("lang", F.lit("")).alias("description"),
                         F.coalesce("source", F.lit("")).alias("name"))).alias("meshHeadings"),
    )


def topics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    n = F.size(words)
    first, second = F.floor((n + 2) / 3).cast("int"), F.floor((n + 1) / 3).cast("int")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    return b.select(
        F.lit(TOPIC_SET).alias("topic_set"),
        F.col("item_id").cast("int").alias("id"),
        part(F.lit(1), first).alias("disease"),
        part(first + 1, second).alias("gene"),
        part(first + second + 1, n - first - second).alias("treatment"),
    )


def free_text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("topic_id"), F.col("text"))


def _grams(df: DataFrame, keep: list, text: str, sizes: list[int] | None) -> DataFrame:
    """``keep`` + k + every k-gram of the tokens, k in ``sizes`` (None: min(GRAM, number of tokens)): its hash; without sizes, its words.

    The tokens come out of a generator so that they are not split anew for each gram.
    """
    rows = df.select(*keep, F.inline(F.array(F.struct(tokenize(F.col(text)).alias("_t")))))
    n = F.size("_t")
    ks = [F.least(F.lit(GRAM), n)] if sizes is None else [F.lit(k) for k in sizes]
    rows = rows.select(*keep, "_t", F.explode(F.array(*ks)).alias("k")).filter((F.col("k") > 0) & (n >= F.col("k")))
    toks, k = F.col("_t"), F.col("k")
    grams = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(toks, i, k) if sizes is None else F.xxhash64(F.slice(toks, i, k)))
    return rows.select(*keep, "k", F.explode(grams).alias("gram")).select(*keep, "k", "gram")


def _grams_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(topic_id, doc_id, total, gram) of the documents' n-grams that are among ``items``, few rows; ``gram`` is a number.

    A gram is found word by word: the first j words of some gram have a number
    (a node), and node and next word lead to the one of j + 1 words.
    """
    spark, asked = items.sparkSession, items.select("topic_id", "total", "gram").toArrow().combine_chunks()
    number: dict[tuple, int] = {}
    numbers = [number.setdefault(tuple(g), len(number)) for g in asked["gram"].to_pylist()]
    words = pa.array(sorted({w for g in number for w in g}), pa.string())
    known = {w: i for i, w in enumerate(words.to_pylist())}
    coded, steps, ends, nodes = {g: [known[w] for w in g] for g in number}, [], [], {(i,): i for i in range(len(words))}
    for j in range(1, max(map(len, number)) + 1):
        end = np.full(len(nodes), -1)
        for g, c in coded.items():
            if len(g) == j:
                end[nodes[tuple(c)]] = number[g]
        ends.append(end)
        longer = {tuple(c[:j + 1]): nodes[tuple(c[:j])] * len(words) + c[j] for c in coded.values() if len(c) > j}
        nodes = {c: i for i, c in enumerate(sorted(longer, key=longer.get))}
        steps.append(np.array(sorted(longer.values()), np.int64))
    plan = spark.sparkContext.broadcast((words, steps, ends))

    def run(batches):
        words, steps, ends = plan.value
        for batch in batches:
            word = pc.fill_null(pc.index_in(batch.column(1).flatten(), words), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
            at = np.flatnonzero(word >= 0)
            node, hits = word[at], []
            for j, (step, end) in enumerate(zip(steps, ends), 1):
                gram = end[node]
                hits.append(row[at[gram >= 0]] * (1 << 32) + gram[gram >= 0])
                on = np.flatnonzero(at + j < len(word))
                on = on[(row[at[on] + j] == row[at[on]]) & (word[at[on] + j] >= 0)]
                at, key = at[on], node[on] * len(words) + word[at[on] + j]
                node = np.searchsorted(step, key)
                on = np.flatnonzero(step[np.minimum(node, len(step) - 1)] == key) if len(step) else np.zeros(0, np.int64)
                at, node = at[on], node[on]
            row, gram = np.divmod(np.unique(np.concatenate(hits)), 1 << 32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(gram)], ["doc_id", "gram"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokenize(F.col("text")).alias("words"))
    each = spark.createDataFrame(pa.table({"topic_id": asked["topic_id"], "total": asked["total"], "gram": pa.array(numbers, pa.int64())}))
    return map_arrow(texts, run, "doc_id long, gram long").join(F.broadcast(each), "gram")


def passage_judgements(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(topic_id, doc_id, rel) from the share of the item's n-grams that the document has.

    The items' grams, counted and sent to every task under the bound, are looked
    for where the documents are read (beyond it they meet the documents' on
    their hashes); only hits are shuffled.
    """
    items = _grams(benchmark.select(F.col("item_id").cast("int").alias("topic_id"), "text"), ["topic_id"], "text", None)
    items, rows = checked_broadcast(items.distinct().groupBy("topic_id", "k").agg(F.collect_set("gram").alias("g"))
                                    .select("topic_id", "k", F.size("g").alias("total"), F.explode("g").alias("gram")))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most GRAM values
    if not sizes:
        return items.select("topic_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(2).alias("rel")).limit(0)
    if rows <= BROADCAST_MAX_ROWS:
        found = _grams_found(documents, items)
    else:
        found = _grams(documents.select("doc_id", "text"), ["doc_id"], "text", sizes).join(
            items.withColumn("gram", F.xxhash64("gram")), ["k", "gram"])
    hits = (found.select("topic_id", "doc_id", "total", "gram").distinct()
            .groupBy("topic_id", "doc_id").agg((F.count("gram") / F.max("total")).alias("share")))
    return (hits.filter(F.col("share") >= PART_SHARE)
            .select("topic_id", "doc_id", F.when(F.col("share") >= FULL_SHARE, 2).otherwise(1).alias("rel")))


def qrels_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    labels = table(spark, sf_dir, "labels")
    passages = passage_judgements(docs, bench)
    n_items = bench.count()  # one bounded scalar
    if n_items == 0:
        return passages.select(F.col("topic_id").cast("int"), F.lit("0").alias("iter"),
                               F.col("doc_id").cast("bigint"), F.col("rel").cast("int"))
    slots, _ = checked_broadcast(bench.select(
        F.col("item_id").cast("int").alias("topic_id"),
        F.pmod(F.col("item_id"), F.lit(n_items)).alias("slot")))
    judged = (labels.filter(F.col("quality").isNotNull())
              .select("doc_id", "quality", F.pmod(F.col("doc_id"), F.lit(n_items)).alias("slot"))
              .join(slots, "slot")
              .select("topic_id", "doc_id", F.col("quality").cast("int").alias("rel")))
    return (passages.unionByName(judged).groupBy("topic_id", "doc_id").agg(F.max("rel").alias("rel"))
            .select(F.col("topic_id").cast("int"), F.lit("0").alias("iter"),
                    F.col("doc_id").cast("bigint"), F.col("rel").cast("int")))
