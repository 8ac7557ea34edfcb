"""Insert with create-only semantics.

A batch is first de-duplicated on id (the first row by the given order wins,
as the first create of an id in one bulk request does), then rows whose id
already exists are rejected, and the rest are appended.

The batch goes to the stored ids, not they to it: its ids are counted and, under
the bound, broadcast to where the stored ids lie; only the few that are there
already come back. Beyond the bound both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators.guards import BROADCAST_MAX_ROWS
from rankspark.operators.versions import file_system
from rankspark.session import materialize

# Fixed value: articles per bulk chunk in the reference loader.
CHUNK_ROWS = 20_000


def insert_if_absent(existing: DataFrame, batch: DataFrame, id_col: str = "id",
                     order_col: str | None = None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows of ``batch`` to append: new ids only, one row per id.

    Rows without id are never taken as present; of several one is kept.
    """
    if order_col:
        # min_by aggregates map-side first, so an id with very many copies is
        # reduced inside each task before the shuffle.
        others = [c for c in batch.columns if c != id_col]
        batch = (batch.groupBy(id_col)
                 .agg(F.min_by(F.struct(*others), F.struct(order_col, *others)).alias("_r"))
                 .select(id_col, "_r.*"))
    else:
        batch = batch.dropDuplicates([id_col])
    batch = materialize(batch, "batch")  # counted, and the same rows at every use
    if batch.count() > max_rows:
        return batch.join(existing.select(id_col), id_col, "left_anti")
    present = materialize(existing.select(id_col).join(F.broadcast(batch.select(id_col)), id_col, "left_semi").distinct(), "present")
    return batch.join(F.broadcast(present), id_col, "left_anti")  # at most as many as the batch has


def append_articles(existing: DataFrame, batch: DataFrame, path: str, id_col: str = "id",
                    order_col: str | None = None, batch_key: str | None = None) -> DataFrame:
    """Append the accepted rows to a Parquet table in files of at most CHUNK_ROWS rows; returns them as written.

    With ``batch_key`` the rows go to a partition ``batch=<key>`` of their own.
    A call that broke off is made good by calling again: the partition is
    written anew. Once it is complete, a repeated call adds nothing.
    """
    if batch_key is None:
        new = materialize(insert_if_absent(existing, batch, id_col, order_col), "accepted")
        new.write.mode("append").option("maxRecordsPerFile", CHUNK_ROWS).parquet(path)
        return new
    spark, target = batch.sparkSession, f"{path.rstrip('/')}/batch={batch_key}"
    fs, done = file_system(spark, f"{target}/_SUCCESS")  # which Spark writes last
    if not fs.exists(done):
        (insert_if_absent(existing, batch, id_col, order_col).write.mode("overwrite")
         .option("maxRecordsPerFile", CHUNK_ROWS).parquet(target))
    return spark.read.parquet(target)
