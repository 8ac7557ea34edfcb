"""Run evaluation against relevance judgements.

Conventions of the standard evaluator: order by score desc, then doc id as a
string desc (the rank column is ignored); relevant = rel >= 1; judged
nonrelevant = 0 <= rel < 1; rel < 0 = pooled but unjudged; a retrieved
document missing from the judgements is nonrelevant and not pooled. Topics are
evaluated when they are in both the run and the judgements. Cutoffs of recall
levels and R-precision multiples, floor(x * R + 0.9), are exact decimals here
(0.7 * 3 + 0.9 is 3), as the definition reads; an evaluator that computes them
in binary floating point gets 2 for that one.

Plan: run ⋈ qrels (left, on topic+doc) → one window per topic over the run
(bounded by the run depth k) → per-topic measures as conditional aggregates in
a single groupBy → summary = one global aggregate, unpivoted to (name, value).
The ideal DCG comes from per-(topic, grade) counts, so a topic with very many
judgements is never ordered inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import materialize

# Cutoffs and levels of the standard measure set.
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
SUCCESS_CUTOFFS = (1, 5, 10)
RECALL_LEVELS = ("0.00", "0.10", "0.20", "0.30", "0.40", "0.50", "0.60", "0.70", "0.80", "0.90", "1.00")
RPREC_MULTS = ("0.20", "0.40", "0.60", "0.80", "1.00", "1.20", "1.40", "1.60", "1.80", "2.00")
MIN_GEO_MEAN = 0.00001
INFAP_EPSILON = 0.00001
IDEAL_CHUNK = 4096


def div(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0e0 ELSE CAST(({n}) AS DOUBLE) / ({d}) END)"


def _col(name: str) -> str:
    return name.replace(".", "_")


def measure_specs() -> list[tuple[str, str, str, str]]:
    """(column, per-topic aggregate SQL over the base table, summary kind, report name).

    Base columns: pos, is_rel, is_nonrel, cum_rel, cum_nonrel, cum_pool, gain;
    per-topic: r (relevant judged), n_nonrel (judged nonrelevant), idcg, idcg_<k>.
    Summary kinds: sum, mean, gm (geometric mean with a floor).
    """
    c = {k: f"sum(CASE WHEN is_rel = 1 AND pos <= {k} THEN 1 ELSE 0 END)" for k in CUTOFFS}
    specs = [
        ("num_ret", "count(*)", "sum", "num_ret"),
        ("num_rel", "max(r)", "sum", "num_rel"),
        ("num_rel_ret", "CAST(sum(is_rel) AS BIGINT)", "sum", "num_rel_ret"),
        ("num_nonrel_judged_ret", "CAST(sum(is_nonrel) AS BIGINT)", "sum", "num_nonrel_judged_ret"),
        ("map", div("sum(CASE WHEN is_rel = 1 THEN CAST(cum_rel AS DOUBLE) / pos ELSE 0e0 END)", "max(r)"),
         "mean", "map"),
        ("Rprec", div("sum(CASE WHEN is_rel = 1 AND pos <= r THEN 1 ELSE 0 END)", "max(r)"), "mean", "Rprec"),
        ("bpref", div("sum(CASE WHEN is_rel = 1 THEN (CASE WHEN cum_nonrel = 0 THEN 1e0 ELSE 1e0 - "
                      + div("least(cum_nonrel, r)", "least(n_nonrel, r)") + " END) ELSE 0e0 END)", "max(r)"),
         "mean", "bpref"),
        ("recip_rank", "coalesce(1e0 / min(CASE WHEN is_rel = 1 THEN pos END), 0e0)", "mean", "recip_rank"),
    ]
    for lv in RECALL_LEVELS:
        specs.append((f"iprec_at_recall_{_col(lv)}",
                      f"coalesce(max(CASE WHEN is_rel = 1 AND cum_rel >= floor({lv} * r + 0.9) "
                      f"THEN CAST(cum_rel AS DOUBLE) / pos END), 0e0)", "mean", f"iprec_at_recall_{lv}"))
    for k in CUTOFFS:
        specs.append((f"P_{k}", f"CAST({c[k]} AS DOUBLE) / {k}", "mean", f"P_{k}"))
    for k in CUTOFFS:
        specs.append((f"recall_{k}", div(c[k], "max(r)"), "mean", f"recall_{k}"))
    for k in CUTOFFS:
        specs.append((f"relative_P_{k}", div(c[k], f"least({k}, max(r))"), "mean", f"relative_P_{k}"))
    for k in CUTOFFS:
        specs.append((f"map_cut_{k}", div(f"sum(CASE WHEN is_rel = 1 AND pos <= {k} "
                                          f"THEN CAST(cum_rel AS DOUBLE) / pos ELSE 0e0 END)", "max(r)"),
                      "mean", f"map_cut_{k}"))
    for k in CUTOFFS:
        specs.append((f"ndcg_cut_{k}", div(f"sum(CASE WHEN pos <= {k} THEN gain / log2(pos + 1e0) ELSE 0e0 END)",
                                           f"max(idcg_{k})"), "mean", f"ndcg_cut_{k}"))
    for m in RPREC_MULTS:
        cut = f"floor({m} * r + 0.9)"
        specs.append((f"Rprec_mult_{_col(m)}",
                      div(f"sum(CASE WHEN is_rel = 1 AND pos <= {cut} THEN 1 ELSE 0 END)", f"max({cut})"),
                      "mean", f"Rprec_mult_{m}"))
    for k in SUCCESS_CUTOFFS:
        specs.append((f"success_{k}", f"max(CASE WHEN is_rel = 1 AND pos <= {k} THEN 1e0 ELSE 0e0 END)",
                      "mean", f"success_{k}"))
    eps = INFAP_EPSILON
    specs += [
        ("ndcg", div("sum(gain / log2(pos + 1e0))", "max(idcg)"), "mean", "ndcg"),
        ("set_P", div("sum(is_rel)", "count(*)"), "mean", "set_P"),
        ("set_recall", div("sum(is_rel)", "max(r)"), "mean", "set_recall"),
        ("set_relative_P", div("sum(is_rel)", "least(count(*), max(r))"), "mean", "set_relative_P"),
        ("utility", "CAST(sum(is_rel) - (count(*) - sum(is_rel)) AS DOUBLE)", "mean", "utility"),
        ("infAP", div(f"sum(CASE WHEN is_rel = 1 THEN (1e0 + (cum_pool - 1) * ((cum_rel - 1) + {eps}) / "
                      f"((cum_rel - 1) + cum_nonrel + {2 * eps})) / pos ELSE 0e0 END)", "max(r)"),
         "mean", "infAP"),
    ]
    return specs


# Measures derived from other per-topic measures (second projection).
DERIVED = [
    ("11pt_avg", "(" + " + ".join(f"iprec_at_recall_{_col(lv)}" for lv in RECALL_LEVELS) + ") / 11e0",
     "mean", "11pt_avg"),
    ("set_F", div("2e0 * set_P * set_recall", "set_P + set_recall"), "mean", "set_F"),
    ("set_map", "set_P * set_recall", "mean", "set_map"),
]
GEOMETRIC = [("gm_map", "map"), ("gm_bpref", "bpref")]


def validate(run: DataFrame, qrels: DataFrame) -> None:
    """What makes the external evaluator fail also fails here. One pass over the run."""
    judged = qrels.select(F.col("topic_id").alias("judged")).distinct()
    pairs = run.groupBy("topic_id", "doc_id").count()
    found = (pairs.groupBy("topic_id").agg(F.max("count").alias("most"))
             .join(judged, F.col("topic_id") == F.col("judged"), "left")
             .agg(F.max("most").alias("most"), F.count("judged").alias("common")).first())
    if (found["most"] or 0) > 1:
        raise ValueError("duplicate document in run")
    if not found["common"]:
        raise ValueError("run and judgements share no topic")


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows of evaluated topics with position and cumulative counts."""
    q = qrels.select(F.col("topic_id").cast("int").alias("topic_id"),
                     F.col("doc_id").cast("bigint").alias("doc_id"), F.col("rel").cast("int").alias("rel"))
    r = (run.select(F.col("topic_id").cast("int").alias("topic_id"),
                    F.col("doc_id").cast("bigint").alias("doc_id"), F.col("score").cast("double"))
         .join(q.select("topic_id").distinct(), "topic_id", "left_semi"))
    base = r.join(q, ["topic_id", "doc_id"], "left")
    order = Window.partitionBy("topic_id").orderBy(F.col("score").desc(),
                                                   F.col("doc_id").cast("string").desc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_rel = F.when(F.col("rel") >= 1, 1).otherwise(0)
    is_nonrel = F.when((F.col("rel") >= 0) & (F.col("rel") < 1), 1).otherwise(0)
    in_pool = F.when(F.col("rel").isNotNull(), 1).otherwise(0)
    return (base.select("topic_id", "doc_id", "score", "rel",
                        is_rel.alias("is_rel"), is_nonrel.alias("is_nonrel"), in_pool.alias("in_pool"),
                        F.when(F.col("rel") > 0, F.col("rel")).otherwise(0).cast("double").alias("gain"))
            .withColumn("pos", F.row_number().over(order))
            .withColumn("cum_rel", F.sum("is_rel").over(upto))
            .withColumn("cum_nonrel", F.sum("is_nonrel").over(upto))
            .withColumn("cum_pool", F.sum("in_pool").over(upto)))


def topic_judgements(qrels: DataFrame) -> DataFrame:
    """Per topic: r, n_nonrel, idcg and idcg_<k> for the cutoffs.

    Ideal order = grades descending. Count documents per (topic, grade), give
    each grade its first position (a window over the few grades of a topic),
    then expand positions in chunks spread over tasks and sum the discounted
    gains.
    """
    q = qrels.select(F.col("topic_id").cast("int").alias("topic_id"), F.col("rel").cast("int").alias("rel"))
    counts = q.groupBy("topic_id").agg(
        F.count(F.when(F.col("rel") >= 1, 1)).alias("r"),
        F.count(F.when((F.col("rel") >= 0) & (F.col("rel") < 1), 1)).alias("n_nonrel"))
    grades = q.filter(F.col("rel") > 0).groupBy("topic_id", "rel").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("topic_id").orderBy(F.col("rel").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    grades = grades.withColumn("start", F.coalesce(F.sum("c").over(w), F.lit(0)) + 1)
    nchunks = F.floor((F.col("c") - 1) / IDEAL_CHUNK)
    chunks = grades.select("topic_id", "rel", "start", "c",
                           F.explode(F.sequence(F.lit(0).cast("bigint"), nchunks.cast("bigint"))).alias("chunk"))
    chunks = chunks.repartition("topic_id", "rel", "chunk")
    lo = F.col("start") + F.col("chunk") * IDEAL_CHUNK
    hi = F.least(F.col("start") + F.col("c") - 1, lo + IDEAL_CHUNK - 1)
    pos = chunks.select("topic_id", "rel", F.explode(F.sequence(lo, hi)).alias("pos"))
    disc = F.col("rel") / F.log2(F.col("pos") + 1e0)
    ideal = pos.groupBy("topic_id").agg(
        F.sum(disc).alias("idcg"),
        *[F.sum(F.when(F.col("pos") <= k, disc).otherwise(0e0)).alias(f"idcg_{k}") for k in CUTOFFS])
    filled = [F.coalesce(F.col("idcg"), F.lit(0e0)).alias("idcg")] + \
             [F.coalesce(F.col(f"idcg_{k}"), F.lit(0e0)).alias(f"idcg_{k}") for k in CUTOFFS]
    return counts.join(ideal, "topic_id", "left").select("topic_id", "r", "n_nonrel", *filled)


def evaluate_by_topic(run: DataFrame, qrels: DataFrame, check: bool = False) -> DataFrame:
    """One row per evaluated topic with every measure (wide).

    With ``check`` the run and the judgements are written to the shared
    checkpoint folder first, so that the search runs once.
    """
    if check:
        run = materialize(run.select("topic_id", "doc_id", "score"), "run")
        qrels = materialize(qrels.select("topic_id", "doc_id", "rel"), "qrels")
        validate(run, qrels)
    base = judged_run(run, qrels).join(topic_judgements(qrels), "topic_id")
    specs = measure_specs()
    per = base.groupBy("topic_id").agg(*[F.expr(e).alias(n) for n, e, _, _ in specs])
    return per.select("*", *[F.expr(e).alias(n) for n, e, _, _ in DERIVED])


def summary(by_topic: DataFrame) -> DataFrame:
    """All-topics (name, value) in the evaluator's order, one aggregate."""
    aggs = [F.count(F.lit(1)).cast("double").alias("num_q")]
    names = ["num_q"]
    for n, _, kind, _ in measure_specs() + DERIVED:
        aggs.append((F.sum(n) if kind == "sum" else F.avg(n)).cast("double").alias(n))
        names.append(n)
    for g, src in GEOMETRIC:
        aggs.append(F.exp(F.avg(F.log(F.greatest(F.col(src), F.lit(MIN_GEO_MEAN))))).alias(g))
        names.append(g)
    wide = by_topic.agg(*aggs)
    report = report_names()
    stack = ", ".join(f"{i}, '{report[n]}', `{n}`" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stack}) AS (ord, name, value)")


def report_names() -> dict:
    out = {"num_q": "num_q"}
    for n, _, _, rep in measure_specs() + DERIVED:
        out[n] = rep
    for g, _ in GEOMETRIC:
        out[g] = g
    return out


def evaluate(run: DataFrame, qrels: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per-topic measures, summary (ord, name, value))."""
    by_topic = materialize(evaluate_by_topic(run, qrels, check), "by-topic")
    return by_topic, summary(by_topic)


def relevance_strings(run: DataFrame, qrels: DataFrame, first: int = 10) -> DataFrame:
    """(topic_id, relstring_<first>): one character for each of the first documents of a topic.

    A grade of one digit stands as it is, a higher one as ``>``, one below 0 as
    ``<`` and a document without judgement as ``-``. At most ``first`` characters a topic.
    """
    top = judged_run(run, qrels).filter(F.col("pos") <= first)
    rel = F.col("rel").cast("int")
    sign = F.when(F.col("rel").isNull(), "-").when(rel < 0, "<").when(rel > 9, ">").otherwise(rel.cast("string"))
    signs = F.array_sort(F.collect_list(F.struct("pos", sign.alias("sign"))))
    return top.groupBy("topic_id").agg(F.array_join(F.transform(signs, lambda s: s["sign"]), "").alias(f"relstring_{first}"))
