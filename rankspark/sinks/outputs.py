"""Output formats.

All are column expressions or bounded per-topic collections; file sinks are
plain ``write.text`` so each task writes its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators.search import enrich
from rankspark.operators.store import Store

ARTICLE_JSON_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("meshHeadings", T.ArrayType(T.StructType([
        T.StructField("description", T.StringType()), T.StructField("name", T.StringType())]))),
])


def run_lines(run: DataFrame, name: str) -> DataFrame:
    """B7: 'topic Q0 doc rank score name' lines (score with 6 decimals)."""
    return run.select(F.format_string(RUN_LINE, F.col("topic_id"), F.col("doc_id"),
                                      F.col("rank"), F.col("score"), F.lit(name)).alias("line"))


def write_run(run: DataFrame, name: str, path: str) -> None:
    run_lines(run, name).write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.format_string("%d %s %d %d", "topic_id", "iter", "doc_id", "rel")).write \
        .mode("overwrite").text(path)


# Formats of the run line, the report's header and the LaTeX table.
RUN_LINE = "%d Q0 %d %d %.6f %s"
REPORT_LINE, HEADER_NAME = "%-22s\t%s\t%s", "runid"
LATEX_HEAD, LATEX_ROW, LATEX_TAIL = "\\begin{tabular}{ |c|c| }\n\\hline\n", "%s & %.4f \\\\", "\n\\hline\n\\end{tabular}"


def report_lines(summary: DataFrame, run_name: str = "run") -> DataFrame:
    """Evaluator-style report (ord, line): a header with the run's name, then 'name<TAB>all<TAB>value' rows."""
    line = lambda name, value: F.format_string(REPORT_LINE, name, F.lit("all"), value).alias("line")
    rows = summary.select("ord", line(F.col("name"), F.format_string("%.4f", F.round("value", 4))))
    header = summary.agg(F.lit(-1).alias("ord")).select("ord", line(F.lit(HEADER_NAME), F.lit(run_name)))
    return header.unionByName(rows)


def parse_report(lines: DataFrame) -> DataFrame:
    """(name, value) of report lines with at least three parts, the header left out."""
    parts = F.split(F.trim("line"), r"\s+")
    return (lines.select(parts[0].alias("name"), F.get(parts, F.lit(2)).alias("value"))
            .filter(F.col("value").isNotNull() & (F.col("name") != HEADER_NAME)))


def latex_report(summary: DataFrame) -> DataFrame:
    """One LaTeX tabular with a 'name & value \\\\' row per measure, in order.

    The summary has one row per measure (about a hundred), so collecting it
    into one row is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", F.round("value", 4).alias("v"))))
    body = F.array_join(F.transform(rows, lambda r: F.format_string(LATEX_ROW, r["name"], r["v"])), "\n")
    return summary.agg(F.concat(F.lit(LATEX_HEAD), body, F.lit(LATEX_TAIL)).alias("latex"))


def nested_response(run: DataFrame, articles: DataFrame | Store, id_col: str = "id") -> DataFrame:
    """Per topic, its ranked documents as array<struct<rank, score, article>>.

    Built after top-k, so each topic's list is bounded by k; a hit without
    stored article fails.
    """
    hits = enrich(run, articles, id_col)
    cols = ["doc_id", *[c for c in hits.columns if c not in (*run.columns, "doc_id")]]
    return hits.groupBy("topic_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "score", F.struct(*cols).alias("article")))).alias("documents"))


def response(run: DataFrame, articles: DataFrame | Store, asked: DataFrame, algorithm: str, engine: str, id_col: str = "id") -> DataFrame:
    """The whole response record, one row for each query or topic of ``asked``, without matches too.

    ``asked``: topic_id and the columns that say what was asked (a query's text,
    or a topic's set, id and parts), which become the struct ``request``. The
    record is (topic_id, request, options struct<algorithm, engine>, documents).
    """
    nested = nested_response(run, articles, id_col)
    said = asked.select("topic_id", F.struct(*[c for c in asked.columns if c != "topic_id"]).alias("request"))
    empty = F.array().cast(nested.schema["documents"].dataType)
    options = F.struct(F.lit(algorithm).alias("algorithm"), F.lit(engine).alias("engine"))
    return said.join(nested, "topic_id", "left").select(
        "topic_id", "request", options.alias("options"), F.coalesce("documents", empty).alias("documents"))


def to_json_documents(articles: DataFrame) -> DataFrame:
    """Article -> JSON document."""
    return articles.select("id", F.to_json(F.struct("id", "title", "abstract", "keywords", "meshHeadings"))
                           .alias("json"))


def from_json_documents(docs: DataFrame) -> DataFrame:
    """JSON document -> article."""
    return docs.select(F.from_json("json", ARTICLE_JSON_SCHEMA).alias("a")).select("a.*")
