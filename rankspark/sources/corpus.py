"""Corpus, topic, judgement and run readers (A1-A5, A10).

XML goes through Spark's built-in XML source with an explicit schema (no
inference pass, no DOCTYPE resolution); text formats through ``read.text`` and
``split``. Files are split across tasks by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.text import strip_inline_tags

ARTICLE_READ_SCHEMA = T.StructType([
    T.StructField("MedlineCitation", T.StructType([
        T.StructField("PMID", T.StructType([T.StructField("_VALUE", T.LongType())])),
        T.StructField("Article", T.StructType([
            T.StructField("ArticleTitle", T.StringType()),
            T.StructField("Abstract", T.StructType([
                T.StructField("AbstractText", T.ArrayType(T.StringType()))])),
        ])),
        T.StructField("KeywordList", T.ArrayType(T.StructType([
            T.StructField("Keyword", T.ArrayType(T.StringType()))]))),
        T.StructField("MeshHeadingList", T.StructType([
            T.StructField("MeshHeading", T.ArrayType(T.StructType([
                T.StructField("DescriptorName", T.StringType()),
                T.StructField("QualifierName", T.ArrayType(T.StringType())),
            ])))])),
    ])),
])

MESH_TYPE = "array<struct<description:string,name:string>>"


def list_corpus_files(spark: SparkSession, path: str, max_files: int = 0) -> list[str]:
    """A1: corpus files, sorted by path; ``max_files > 0`` keeps the first n.

    Only file paths reach the driver (bounded by the listing itself).
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path"))
    if max_files > 0:
        files = files.limit(max_files)
    return [r["path"] for r in files.collect()]


def read_articles(spark: SparkSession, path: str, max_files: int = 0,
                  reference_compat: bool = False) -> DataFrame:
    """A2/A3: (id, title, abstract, keywords, meshHeadings) from PubMed-style XML.

    Plain or gzip files, one or many articles each. Missing parts become ''
    or an empty list; known inline tags are stripped from title/abstract;
    several abstract parts are joined with a space; an article without PMID fails; every keyword of every
    keyword list is kept; a heading gets one entry per qualifier (or one with
    name '' when it has none). ``reference_compat`` blanks titles with markup
    and abstracts with markup or several parts, as the original extraction did.
    """
    paths = list_corpus_files(spark, path, max_files) if max_files > 0 else [path]
    raw = (spark.read.format("xml").option("rowTag", "PubmedArticle").option("ignoreSurroundingSpaces", "false")
           .schema(ARTICLE_READ_SCHEMA).load(paths))
    mc = F.col("MedlineCitation")
    title_raw = F.coalesce(mc["Article"]["ArticleTitle"], F.lit(""))
    parts = F.filter(F.coalesce(mc["Article"]["Abstract"]["AbstractText"], F.array().cast("array<string>")),
                     lambda x: x.isNotNull())
    title = strip_inline_tags(title_raw)
    abstract = F.array_join(F.transform(parts, strip_inline_tags), " ")
    if reference_compat:
        title = F.when(title_raw != title, F.lit("")).otherwise(title_raw)
        abstract = F.when((F.size(parts) == 1) & (F.get(parts, F.lit(0)) == abstract), abstract).otherwise(F.lit(""))
    keywords = F.filter(F.flatten(F.transform(
        F.coalesce(mc["KeywordList"], F.array().cast("array<struct<Keyword:array<string>>>")),
        lambda kl: F.coalesce(kl["Keyword"], F.array().cast("array<string>")))), lambda x: x.isNotNull())
    headings = F.coalesce(mc["MeshHeadingList"]["MeshHeading"],
                          F.array().cast("array<struct<DescriptorName:string,QualifierName:array<string>>>"))
    mesh = F.flatten(F.transform(headings, lambda h: F.transform(
        F.when(F.size(F.coalesce(h["QualifierName"], F.array().cast("array<string>"))) > 0,
               h["QualifierName"]).otherwise(F.array(F.lit(""))),
        lambda q: F.struct(F.coalesce(h["DescriptorName"], F.lit("")).alias("description"),
                           F.coalesce(q, F.lit("")).alias("name")))))
    pmid = _required(mc["PMID"]["_VALUE"], "article without PMID", title_raw)
    return raw.select(pmid.alias("id"), title.alias("title"), abstract.alias("abstract"),
                      keywords.alias("keywords"), mesh.cast(MESH_TYPE).alias("meshHeadings"))


def write_articles_xml(articles: DataFrame, path: str, compression: str = "none") -> None:
    """Articles back to PubMed-style XML (one element per article), plain or ``gzip``."""
    mc = F.struct(
        F.struct(F.col("id").alias("_VALUE")).alias("PMID"),
        F.struct(F.col("title").alias("ArticleTitle"),
                 F.struct(F.array(F.col("abstract")).alias("AbstractText")).alias("Abstract")).alias("Article"),
        F.array(F.struct(F.col("keywords").alias("Keyword"))).alias("KeywordList"),
        F.struct(F.transform("meshHeadings", lambda m: F.struct(
            m["description"].alias("DescriptorName"),
            F.array(m["name"]).alias("QualifierName"))).alias("MeshHeading")).alias("MeshHeadingList"),
    )
    (articles.select(mc.alias("MedlineCitation")).write.mode("overwrite").format("xml")
     .option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle")
     .option("compression", compression).save(path))


TOPIC_SCHEMA = T.StructType([
    T.StructField("_number", T.StringType()), T.StructField("number", T.StringType()),
    T.StructField("disease", T.StringType()), T.StructField("gene", T.StringType()),
    T.StructField("treatment", T.StringType()),
])


def read_topics(spark: SparkSession, path: str, topic_set: str) -> DataFrame:
    """A4: (topic_set, id, disease, gene, treatment); number as attribute or child."""
    raw = spark.read.format("xml").option("rowTag", "topic").schema(TOPIC_SCHEMA).load(path)
    return raw.select(F.lit(topic_set).alias("topic_set"),
                      _required(F.trim(F.coalesce("_number", "number")).cast("int"), "topic without number",
                                F.col("disease")).alias("id"),
                      F.coalesce("disease", F.lit("")).alias("disease"),
                      F.coalesce("gene", F.lit("")).alias("gene"),
                      F.coalesce("treatment", F.lit("")).alias("treatment"))


def topic_by_id(topics: DataFrame, topic_set: str, topic_id: int) -> DataFrame:
    """The topic, which must exist."""
    hit = topics.filter((F.col("topic_set") == topic_set) & (F.col("id") == topic_id))
    if not hit.limit(1).collect():
        raise LookupError(f"no topic {topic_id} in set {topic_set}")
    return hit


def topics_subset(topics: DataFrame, requested: DataFrame) -> DataFrame:
    """Topics named by a request list (topic_set, id), each with its own set."""
    return topics.join(requested.select("topic_set", "id"), ["topic_set", "id"], "left_semi")


def _required(value: Column, what: str, shown: Column) -> Column:
    """The value; a row without it fails the read."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(shown.cast("string"), F.lit("")))))


def _fields(path_df: DataFrame, n: int) -> DataFrame:
    """White-space parts ``p`` of every line that is not blank; a line with fewer than ``n`` fails."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (path_df.filter(F.trim(F.col("value")) != "")
            .select(_required(F.when(F.size(parts) >= n, parts), f"line with fewer than {n} columns", F.col("value")).alias("p")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """A5: 'topic iter docno rel' lines -> (topic_id, iter, doc_id, rel)."""
    p = _fields(spark.read.text(path), 4)
    return p.select(F.col("p")[0].cast("int").alias("topic_id"), F.col("p")[1].alias("iter"),
                    F.col("p")[2].cast("bigint").alias("doc_id"), F.col("p")[3].cast("int").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A10: 'topic Q0 docno rank score tag' lines -> run rows."""
    p = _fields(spark.read.text(path), 6)
    return p.select(F.col("p")[0].cast("int").alias("topic_id"), F.col("p")[2].cast("bigint").alias("doc_id"),
                    F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"),
                    F.col("p")[5].alias("name"))


def write_topics_xml(topics: DataFrame, path: str) -> None:
    """Topics of one set as XML with the number as attribute."""
    (topics.select(F.col("id").cast("string").alias("_number"), "disease", "gene", "treatment")
     .write.mode("overwrite").format("xml").option("rootTag", "topics").option("rowTag", "topic").save(path))
