"""Packing by optimal length buckets.

Texts longer than ``max_len`` tokens are cut into pieces of that length (the
last one shorter); nothing is truncated. The global histogram of piece
lengths (at most ``max_len`` + 1 rows) goes to the driver, where dynamic
programming over it picks the ``n_buckets`` bucket lengths with the least
padding. Inside a bucket, pieces in order of (id, piece) fill batches of
``budget // bucket length`` sequences, so a batch holds at most ``budget``
padded tokens and only the last of a bucket is short.

The running number inside a bucket comes without a task per bucket: pieces
are range-partitioned and sorted once, numbered per partition and bucket,
and the counts of earlier partitions are added.

Lengths are the caller's (token counts); without them they are the words
between white space, and the column is called n_words.

Defined results: null and empty texts are one piece of length 0 (all
padding); a very long text becomes as many pieces as it needs; ids may be null
or repeated (ties follow the order of reading); an empty table gives no rows.
Id and length are all that is read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankspark.llm.common import broadcast_if, map_arrow, written

MAX_LEN = 2048
N_BUCKETS = 8
BUDGET = 16384
BROADCAST_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Words between white space (the six ASCII characters); a caller with token counts passes those instead."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), "")).cast("long")


def optimal_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Bucket lengths, ascending, with the least total padding; of equal plans the one with the earliest cuts, last first."""
    order = np.argsort(lengths)
    size = np.array(lengths, np.int64)[order]
    count = np.array(counts, np.int64)[order]
    m = len(size)
    if not m:
        return []
    c = np.concatenate(([0], np.cumsum(count)))
    s = np.concatenate(([0], np.cumsum(count * size)))
    big = np.int64(1) << 62
    best = np.full(m + 1, big)
    best[0] = 0
    cuts = []
    lower = np.tril(np.ones((m, m), bool))  # [j - 1, i]: a bucket of lengths i .. j - 1
    pad = size[:, None] * (c[1:, None] - c[None, :-1]) - (s[1:, None] - s[None, :-1])
    for _ in range(min(n_buckets, m)):
        total = np.where(lower & (best[None, :-1] < big), best[None, :-1] + pad, big)
        at = total.argmin(axis=1)
        best = np.concatenate(([big], total[np.arange(m), at]))
        cuts.append(np.concatenate(([0], at)))
    bounds, j = [], m
    for at in reversed(cuts):
        bounds.append(int(size[j - 1]))
        j = int(at[j])
    return bounds[::-1]


def pieces_of(docs: DataFrame, id_col: str, length: Column, max_len: int) -> DataFrame:
    """(id, piece, start, n, rid): the pieces of each document."""
    n = docs.select(F.col(id_col).alias("id"), length.alias("all"))
    last = F.greatest(F.lit(0), F.floor((F.col("all") - 1) / max_len)).cast("int")
    cut = n.select("id", "all", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return cut.select("id", "piece", start.alias("start"),
                      F.least(F.lit(max_len).cast("long"), F.col("all") - start).alias("n"),
                      F.monotonically_increasing_id().alias("rid"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
         max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, piece, start, n_tokens or n_words, bucket, bucket_len, batch, slot), one row per piece."""
    if budget < max_len:
        raise ValueError("the token budget is smaller than the longest sequence")
    spark = docs.sparkSession
    unit = "n_words" if length is None else "n_tokens"
    length = word_count(F.col(text_col).cast("string")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    pieces = written(pieces_of(docs, id_col, length, max_len), "packing")
    hist = pieces.groupBy("n").count().collect()  # at most max_len + 1 rows
    bounds = optimal_bounds([r["n"] for r in hist], [r["count"] for r in hist], n_buckets) or [max_len]
    bucket = sum((F.when(F.col("n") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    dealt = (pieces.withColumn("bucket", bucket).repartitionByRange("id", "piece", "rid")
             .sortWithinPartitions("id", "piece", "rid").withColumn("part", F.spark_partition_id()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(bounds), np.int64)
        for b in batches:
            own = b.column("bucket").to_numpy()
            local = np.zeros(len(own), np.int64)
            for k in range(len(bounds)):
                mine = own == k
                local[mine] = held[k] + np.arange(mine.sum())
                held[k] += mine.sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])

    dealt = written(map_arrow(dealt, number, StructType([*dealt.schema.fields, StructField("local", LongType())])), "packing")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("part", "bucket").count()
               .select("part", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("offset") + F.col("local")
    size = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1)
    batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (dealt.join(broadcast_if(offsets, parts * len(bounds) <= BROADCAST_ROWS), ["part", "bucket"])
            .select("id", "piece", "start", F.col("n").alias(unit), "bucket", size.alias("bucket_len"), at.alias("at"))
            .select("id", "piece", "start", unit, "bucket", "bucket_len",
                    F.floor(F.col("at") / batch).cast("long").alias("batch"),
                    F.pmod(F.col("at"), batch).cast("int").alias("slot")))
