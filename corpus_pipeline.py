"""Corpus pipeline: language ID, near-duplicates, decontamination, PII, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; ``run`` writes each stage's result to the shared checkpoint folder and
reads it back for the next. The first four return the columns of
``documents``; where a text changes, ``n_chars`` follows it.

Defined results: null and empty texts, and those without a letter, go in the
first stage; a row without id is treated like any other but never stands for a
document with one; of repeated rows one stays; very long texts pass whole and
are packed in pieces; ties are settled by the smallest id; an empty table gives
no rows; other columns, whatever their names, pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import decontaminate, langid, pii, registry, simhash
from rankspark.llm.common import named, table, written

MIN_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of which no learned language holds MIN_SHARE of the letters: mixtures,
    and texts in a script or of words unlike anything learned, which count for no language."""
    model = langid.train(langid.training_sample(docs, "doc_id", "text", "lang", langid.SAMPLE_DOCS))
    keys = [f"c{k}" for k in range(len(docs.columns))]
    found = langid.identify(docs, model, [named(c).alias(k) for c, k in zip(docs.columns, keys)], with_spans=False)
    # Without labelled text there is no language to reject by: all that has a letter stays.
    fine = (F.col("score") >= MIN_SHARE) if model.languages else F.col(keys[docs.columns.index("text")]).rlike(r"\p{L}")
    return found.filter(fine).select(*[F.col(k).alias(c) for c, k in zip(docs.columns, keys)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every benchmark span out; a document that is nothing else goes."""
    return _counted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(docs, pii.redact(docs))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot) of every piece, lengths in tokens, so that a
    batch holds at most the budget of them."""
    return registry.pack_tokens(docs)


pack_token_batches = pack_batches


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    if "n_chars" not in after.columns:
        return after
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The same pipeline under its earlier name.
run_tokens = run


#: The language, fingerprint and model stages cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None
