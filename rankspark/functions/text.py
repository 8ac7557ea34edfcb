"""Field projections of articles and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The article fields indexed by default, in order. "mesh" is the
# text of the mesh headings (descriptor and qualifier words).
ARTICLE_FIELDS = ("title", "abstract", "keywords", "mesh")

# Inline tags known to appear inside titles and abstracts; only
# these are stripped (a general <...> strip would eat un-escaped "<" and ">").
INLINE_TAG_PATTERN = r'</?(i|b|u|sup|sub|mml:[a-z]+|DispFormula)(\s+[\w:.-]+="[^"]*")*\s*/?>'


def strip_inline_tags(c: Column) -> Column:
    return F.regexp_replace(c, INLINE_TAG_PATTERN, "")


def mesh_text(mesh: Column) -> Column:
    """One string from array<struct<description, name>> (D3)."""
    return F.array_join(F.transform(mesh, lambda m: F.concat_ws(" ", m["description"], m["name"])), " ")


def article_fields(articles: DataFrame, fields=ARTICLE_FIELDS) -> DataFrame:
    """Wide (doc_id, <field text>...) projection of articles (C4, D3)."""
    exprs = {
        "title": F.coalesce(F.col("title"), F.lit("")),
        "abstract": F.coalesce(F.col("abstract"), F.lit("")),
        "keywords": F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), " "),
        "mesh": mesh_text(F.coalesce(F.col("meshHeadings"),
                                     F.array().cast("array<struct<description:string,name:string>>"))),
    }
    return articles.select(F.col("id").cast("bigint").alias("doc_id"),
                           *[exprs[f].alias(f) for f in fields])


def topic_text(topics: DataFrame) -> DataFrame:
    """(topic_id, text) with text = "disease gene treatment" (C1)."""
    return topics.select(F.col("id").cast("int").alias("topic_id"),
                         F.concat_ws(" ", F.coalesce("disease", F.lit("")), F.coalesce("gene", F.lit("")),
                                     F.coalesce("treatment", F.lit(""))).alias("text"))
