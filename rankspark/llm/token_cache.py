"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens), partitioned by
version: the SHA-256 of the tokenizer file with the library's version. Texts
are normalised (null becomes empty, nothing else, so that counts are those of
the text itself) and reduced to their SHA-256. One text per digest that the
cache lacks is encoded and appended; then every document takes its count from
the cache by its digest. Appending is Spark's own job commit, so a lost
executor leaves nothing behind; rows of two writers that raced agree and
count once.

Encoding itself: a byte-level tokenizer splits at every change from a
non-space to a space first, so a text's count is the sum over its pieces, and
only pieces not seen before in the task go to the library. Texts with white
space other than blanks and line feeds go to the library whole, as runs of
mixed white space may be split in other ways.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null id
stays null; repeated rows share one encoding; a very long text is encoded
whole, in pieces; an empty table gives no rows. Id and text are all that is
read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankspark.llm.common import map_arrow

PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
MEMO_PIECES = 500_000
CACHE_SCHEMA = "digest string, n_tokens long, version string"


def tokenizer_version(definition: str) -> str:
    import tokenizers

    return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{definition}".encode()).hexdigest()


class Counter:
    """Token counts of texts as the library's encoding gives them, without added special tokens."""

    def __init__(self, definition: str, by_piece: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = by_piece
        self.memo: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.encode(texts)
        if len(self.memo) > MEMO_PIECES:
            self.memo = {}
        memo, out = self.memo, []
        for text in texts:
            if OTHER_SPACE.search(text):
                out += self.encode([text])
                continue
            pieces = PIECE.findall(text)
            new = [p for p in {*pieces} if p not in memo]
            if new:
                memo.update(zip(new, self.encode(new)))
            out.append(sum(map(memo.__getitem__, pieces)))
        return out


def splits_at_spaces(definition: str) -> bool:
    """Whether the tokenizer file is a byte-level one whose pieces never reach over a non-space before a space."""
    import json

    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    plain = not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
    return bool(plain and not pre.get("add_prefix_space") and all(
        not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
        for t in d.get("added_tokens", [])))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; an absent cache is created empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").partitionBy("version").parquet(path)
    return (spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def encode_misses(docs: DataFrame, cache: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """(digest, n_tokens) of the distinct texts that ``cache`` lacks."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, splits_at_spaces(definition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(*shared.value)
        for b in batches:
            counts = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    distinct = (docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
                .groupBy("digest").agg(F.first("text").alias("text")))
    return map_arrow(distinct.join(cache, "digest", "left_anti"), run, "digest string, n_tokens long")


def lengths(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row, without a cache: nothing is shuffled, copies are counted again."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, splits_at_spaces(definition)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = StructType([rows.schema["id"], StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(*shared.value)
        for b in batches:
            counts = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return map_arrow(rows, run, schema)


def token_counts(docs: DataFrame, cache_path: str, definition: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, n_tokens) per document; encodes and appends what the cache lacks."""
    spark, version = docs.sparkSession, tokenizer_version(definition)
    misses = encode_misses(docs, read_cache(spark, cache_path, version), definition, text_col)
    (misses.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache_path))
    counts = read_cache(spark, cache_path, version).repartition(F.xxhash64("digest"))  # see a hot digest split
    return _keyed(docs, id_col, text_col).drop("text").join(counts, "digest", "left") \
        .select("id", "digest", "n_bytes", "n_tokens")
