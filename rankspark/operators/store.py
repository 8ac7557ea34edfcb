"""Article store clustered by id.

Articles lie in files by range of the id, with a small table of the files'
ranges and Bloom filters on the id in every row group. Whoever asks for a
counted, bounded list of ids reads only the files whose range holds one of
them, and of these only the row groups that may.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankspark.operators.clustered import MAX_KEYS, file_ranges, files_for, files_holding

#: Ids that go into the scan as a filter; more of them choose files only.
FILTER_IDS = 1000
#: Bytes of text in a file, which a task sorts in memory.
FILE_BYTES = 256 << 20


def write_store(articles: DataFrame, path: str, id_col: str = "id", files: int | None = None) -> "Store":
    """Write ``articles`` (ids: long, unique) as a store at a new ``path``."""
    base, spark = path.rstrip("/"), articles.sparkSession
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in articles.schema if isinstance(f.dataType, StringType)), F.lit(0))
    rows, length = articles.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    files = files or max(files_for(spark, rows), -(-(length or 0) // FILE_BYTES))
    (articles.repartitionByRange(files, id_col).sortWithinPartitions(id_col).write
     .option(f"parquet.bloom.filter.enabled#{id_col}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(max(1, rows // files)))
     .parquet(f"{base}/articles"))
    key = F.struct(F.col(id_col).cast("long").alias("id"))
    ranges = (spark.read.schema(articles.schema).parquet(f"{base}/articles")
              .select(F.col("_metadata.file_name").alias("file"), key.alias("key")).filter("key.id IS NOT NULL")
              .groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows")))
    ranges.coalesce(1).write.parquet(f"{base}/files")
    return read_store(spark, base, id_col)


def read_store(spark: SparkSession, path: str, id_col: str = "id") -> "Store":
    base = path.rstrip("/")
    rows = spark.read.parquet(f"{base}/files").collect()  # a row for each file
    return Store(spark.read.parquet(f"{base}/articles"), base, id_col, [(r["file"], tuple(r["first"]), tuple(r["last"])) for r in rows])


@dataclass
class Store:
    articles: DataFrame
    path: str
    id_col: str
    ranges: list = dc_field(repr=False)

    def files_with(self, ids: list[int]) -> list[str]:
        return [f"{self.path}/articles/{f}" for f in files_holding(self.ranges, sorted((i,) for i in ids))]

    def holding(self, ids: list[int] | None) -> DataFrame:
        """Articles from the files that can hold ``ids`` (None or very many: all); few ids also filter the scan."""
        if ids is None or len(ids) > MAX_KEYS:
            return self.articles
        files = self.files_with(ids)
        if not files:
            return self.articles.limit(0)
        rows = self.articles.sparkSession.read.schema(self.articles.schema).parquet(*files)
        return rows.filter(F.col(self.id_col).isin(ids)) if len(ids) <= FILTER_IDS else rows
