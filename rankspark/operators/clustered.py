"""Parquet tables whose files each hold a range of a key.

Rows are range-partitioned and sorted by the key, so one key's rows lie in one
file or, where there are many, in neighbouring ones. A small table of the
files' first and last keys stands beside them: whoever wants some keys reads
only the files that can hold them, however many there are. The number of files
follows the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file on a large table; a small one still gets a file for each core that has LEAST_ROWS to write.
FILE_ROWS = 8_000_000
LEAST_ROWS = 100_000
#: Keys looked up at once by their files; beyond it the whole table is read.
MAX_KEYS = 100_000


def files_for(spark: SparkSession, rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int, change=lambda rows: rows) -> None:
    """``change``: what becomes of the rows once they are dealt out, such as a sum by ``keys``."""
    change(df.repartitionByRange(files, *keys)).sortWithinPartitions(*keys).write.parquet(path)


def file_ranges(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """(file, first, last, rows) of a clustered table, first and last as structs of ``keys``.

    Each file is sorted, so its first and last rows (numbered by the reader) have them: rows are counted
    without reading a column, and no key is compared.
    """
    rows, key = spark.read.schema(schema).parquet(path), F.struct(*keys)
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    counts = rows.select(*at).groupBy("file").agg((F.max("at") + 1).alias("rows"))
    last = {r["rows"] - 1 for r in counts.collect()}  # a row a file, as in the dictionary
    ends = rows.select(*at, *keys).filter(F.col("at").isin(0, *last)).join(F.broadcast(counts), "file") \
        .filter((F.col("at") == 0) | (F.col("at") == F.col("rows") - 1))
    return ends.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("rows").alias("rows"))


def files_holding(ranges: list[tuple], keys: list[tuple]) -> list[str]:
    """Files of (file, first, last) whose range holds one of the sorted ``keys``."""
    out = []
    for file, first, last in ranges:
        at = bisect_left(keys, first)
        if at < len(keys) and keys[at] <= last:
            out.append(file)
    return out
