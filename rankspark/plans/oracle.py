"""DuckDB SQL builders for the oracle check.

Written in DuckDB's dialect straight from the definitions (not generated from
the Spark plans), so the two sides check each other. The driver tables are
views named after the parquet files.
"""

from __future__ import annotations

from rankspark.functions import models as M
from rankspark.functions.text import ARTICLE_FIELDS

SPLIT = r"'[^\p{L}\p{N}]+'"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {SPLIT}), lambda t: t <> '')"


NL = "chr(10)"

ARTICLES = f"""
SELECT doc_id AS id,
  CASE WHEN instr(coalesce(text, ''), {NL}) > 0
       THEN substr(coalesce(text, ''), 1, instr(coalesce(text, ''), {NL}) - 1)
       ELSE coalesce(text, '') END AS title,
  CASE WHEN instr(coalesce(text, ''), {NL}) > 0
       THEN substr(coalesce(text, ''), instr(coalesce(text, ''), {NL}) + 1)
       ELSE '' END AS abstract,
  [coalesce(lang, ''), coalesce(source, '')] AS keywords,
  [{{'description': coalesce(lang, ''), 'name': coalesce(source, '')}}] AS meshHeadings
FROM documents"""

ARTICLE_WIDE = f"""
SELECT id AS doc_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract,
  array_to_string(keywords, ' ') AS keywords,
  array_to_string(list_transform(meshHeadings, lambda m: concat_ws(' ', m.description, m.name)), ' ') AS mesh
FROM ({ARTICLES})"""

DOCS_WIDE = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"
TOPICS = f"""
SELECT 'bench' AS topic_set, item_id::INTEGER AS id,
  array_to_string(w[1:a], ' ') AS disease, array_to_string(w[a + 1:a + b], ' ') AS gene,
  array_to_string(w[a + b + 1:], ' ') AS treatment
FROM (SELECT item_id, w, ((len(w) + 2) // 3)::BIGINT AS a, ((len(w) + 1) // 3)::BIGINT AS b
      FROM (SELECT item_id, {WORDS} AS w FROM benchmark))"""

TOPIC_QUERIES = f"SELECT id AS topic_id, concat_ws(' ', disease, gene, treatment) AS text FROM ({TOPICS})"
FREE_QUERIES = "SELECT item_id::INTEGER AS topic_id, text FROM benchmark"

QRELS = f"""
WITH it AS (SELECT item_id, {tokens('text')} AS t FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(5, len(t)) AS k, array_to_string(t[p:p + least(5, len(t)) - 1], ' ') AS g
       FROM (SELECT item_id, t, unnest(range(1, len(t) - least(5, len(t)) + 2)) AS p FROM it WHERE len(t) > 0)),
nt AS (SELECT item_id, count(*) AS total FROM ig GROUP BY item_id),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(t[p:p + k - 1], ' ') AS g
       FROM (SELECT doc_id, t, k, unnest(range(1, (len(t) - k + 2)::BIGINT)) AS p
             FROM (SELECT doc_id, {tokens('text')} AS t FROM documents), (SELECT DISTINCT k FROM ig) WHERE len(t) >= k)),
sh AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(total) AS share
       FROM dg JOIN ig USING (k, g) JOIN nt USING (item_id) GROUP BY item_id, doc_id)
SELECT topic_id::INTEGER AS topic_id, '0' AS iter, doc_id::BIGINT AS doc_id, max(rel)::INTEGER AS rel FROM (
  SELECT item_id AS topic_id, doc_id, CASE WHEN share >= 0.5 THEN 2 ELSE 1 END AS rel FROM sh WHERE share >= 0.1
  UNION ALL
  SELECT b.item_id, l.doc_id, l.quality
  FROM labels l JOIN benchmark b
    ON l.doc_id % (SELECT count(*) FROM benchmark) = b.item_id % (SELECT count(*) FROM benchmark)
  WHERE l.quality IS NOT NULL
) GROUP BY topic_id, doc_id"""


def index_ctes(src_sql: str, fields=("text",), doc_field: str | None = "_doc",
               stop: tuple | None = None, stem: bool = False, prefix: str = "x") -> str:
    """CTEs {p}_src, {p}_tok, {p}_dl, {p}_post, {p}_lex, {p}_st for an index."""
    def tk(col: str) -> str:
        t = tokens(col)
        if stop:
            words = ", ".join(f"'{w}'" for w in stop)
            t = f"list_filter({t}, lambda s: NOT list_contains([{words}], s))"
        if stem:
            t = f"list_transform({t}, lambda s: {sql_s_stem('s')})"
        return t

    parts = [f"SELECT doc_id::BIGINT AS doc_id, '{f}' AS field, {tk(f)} AS toks FROM {prefix}_src"
             for f in fields]
    if doc_field and len(fields) > 1:
        cat = tk(fields[0])
        for f in fields[1:]:
            cat = f"list_concat({cat}, {tk(f)})"
        parts.append(f"SELECT doc_id::BIGINT, '{doc_field}', {cat} FROM {prefix}_src")
    p = prefix
    return f"""{p}_src AS ({src_sql}),
{p}_tok AS ({' UNION ALL '.join(parts)}),
{p}_dl AS (SELECT doc_id, field, len(toks) AS dl FROM {p}_tok),
{p}_post AS (SELECT field, term, doc_id, count(*) AS tf
             FROM (SELECT doc_id, field, unnest(toks) AS term FROM {p}_tok) GROUP BY field, term, doc_id),
{p}_lex AS (SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {p}_post GROUP BY field, term),
{p}_st AS (SELECT field, count(*) AS n_docs, count(*) FILTER (WHERE dl > 0) AS n_with_field,
           sum(dl)::BIGINT AS total_len FROM {p}_dl GROUP BY field)"""


def sql_s_stem(s: str) -> str:
    return (f"CASE WHEN regexp_matches({s}, 'ies$') AND NOT regexp_matches({s}, '[ea]ies$') "
            f"THEN regexp_replace({s}, 'ies$', 'y') "
            f"WHEN regexp_matches({s}, 'es$') AND NOT regexp_matches({s}, '[aeo]es$') "
            f"THEN regexp_replace({s}, 'es$', 'e') "
            f"WHEN regexp_matches({s}, 's$') AND NOT regexp_matches({s}, '[us]s$') "
            f"THEN regexp_replace({s}, 's$', '') ELSE {s} END")


def _f(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def model_sql(model: str, params: dict | None = None) -> str:
    p = params or {}
    k1, b, k3, c = (_f(p.get("k1", M.BM25_K1)), _f(p.get("b", M.BM25_B)),
                    _f(p.get("k3", M.BM25_K3)), _f(p.get("c", M.DFR_C)))
    tfn = f"(tf * log2(1.0 + {c} * avgdl / dl))"
    lam = "(cf / n)"
    g = f"(log2(1.0 + {lam}) + {tfn} * log2((1.0 + {lam}) / {lam}))"
    after_b = f"((cf + 1.0) / (df * ({tfn} + 1.0)))"
    if model == "bm25_field":
        return (f"qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * ({k1} + 1.0) * tf"
                f" / (tf + {k1} * (1.0 - {b} + {b} * dl / avgdl))")
    if model == "bm25_doc":
        return (f"log2((n - df + 0.5) / (df + 0.5)) * (({k1} + 1.0) * tf / ({k1} * ((1.0 - {b}) + {b} * dl / avgdl) + tf))"
                f" * (({k3} + 1.0) * qtf / ({k3} + qtf))")
    if model == "dfr_gbh2":
        return f"qtf * {after_b} * {g}"
    if model == "bb2":
        t = f"least({tfn}, cf - 0.5)"

        def st(nn: str, mm: str) -> str:
            return f"(({mm}) + 0.5) * log2(({nn}) / ({mm})) + (({nn}) - ({mm})) * log2({nn})"
        bose = (f"(-log2(n - 1.0) - {M.LOG2_E!r}::DOUBLE + ({st('n + cf - 1.0', f'n + cf - {t} - 2.0')})"
                f" - ({st('cf', f'cf - {t}')}))")
        return f"qtf * {after_b} * (CASE WHEN cf - {tfn} < 0.5 THEN {g} ELSE {bose} END)"
    if model == "dfr_bm25":
        return f"qtf * {tfn} / ({tfn} + 1.0) * log2((n - df + 0.5) / (df + 0.5))"
    if model == "tf_idf":
        return "qtf * tf * log2(n / df)"
    raise KeyError(model)


def scores_cte(queries_sql: str, models: dict, mode: str, fields, doc_field: str,
               prefix: str = "x", analyzer_sql=None) -> str:
    """CTEs {p}_qsrc, {p}_qt, {p}_cand, {p}_sc(topic_id, doc_id, <label>...)."""
    p = prefix
    sel = [doc_field] if mode == "document" else list(fields)
    n_col = "n_docs" if mode == "document" else "n_with_field"
    in_list = ", ".join(f"'{f}'" for f in sel)
    qtok = analyzer_sql("text") if analyzer_sql else tokens("text")
    aggs = []
    for label, (model, params) in models.items():
        e = model_sql(model, params)
        if mode == "document" or len(sel) == 1:
            aggs.append(f"sum({e}) AS {label}")
        else:
            per = ", ".join(f"sum(CASE WHEN field = '{f}' THEN {e} END)" for f in sel)
            aggs.append(f"greatest({per}) AS {label}")
    return f"""{p}_qsrc AS ({queries_sql}),
{p}_qt AS (SELECT topic_id, term, count(*) AS qtf
           FROM (SELECT topic_id::INTEGER AS topic_id, unnest({qtok}) AS term FROM {p}_qsrc)
           GROUP BY topic_id, term),
{p}_cand AS (
  SELECT q.topic_id, po.doc_id, po.field, po.tf::DOUBLE AS tf, d.dl::DOUBLE AS dl, q.qtf::DOUBLE AS qtf,
         l.df::DOUBLE AS df, l.cf::DOUBLE AS cf, s.{n_col}::DOUBLE AS n,
         s.total_len::DOUBLE / s.{n_col} AS avgdl
  FROM {p}_qt q JOIN {p}_post po ON po.term = q.term AND po.field IN ({in_list})
  JOIN {p}_lex l ON l.field = po.field AND l.term = po.term
  JOIN {p}_dl d ON d.doc_id = po.doc_id AND d.field = po.field
  JOIN {p}_st s ON s.field = po.field),
{p}_sc AS (SELECT topic_id, doc_id, {', '.join(aggs)} FROM {p}_cand GROUP BY topic_id, doc_id)"""


def topk_cte(name: str, src: str, col: str, k: int) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT topic_id, doc_id, round({col}, 6) AS score,
           row_number() OVER (PARTITION BY topic_id ORDER BY round({col}, 6) DESC, doc_id ASC) AS rank
    FROM {src} WHERE {col} IS NOT NULL) WHERE rank <= {k})"""


RUN_SELECT = ("SELECT topic_id::INTEGER AS topic_id, doc_id::BIGINT AS doc_id, rank::INTEGER AS rank, "
              "score::DOUBLE AS score FROM {src}")


def pipeline_tokens(stop, stem):
    """The term pipeline applied to a text column, for queries."""
    def of(x: str) -> str:
        t = tokens(x)
        if stop:
            t = f"list_filter({t}, lambda s: NOT list_contains([{', '.join(repr(w) for w in stop)}], s))"
        return f"list_transform({t}, lambda s: {sql_s_stem('s')})" if stem else t
    return of


def run_sql(src_kind: str, queries: str, model: str, mode: str, k: int, params=None,
            fields=None, stop=None, stem=False) -> str:
    """Full run query: index CTEs + scores + top-k."""
    if src_kind == "docs":
        idx = index_ctes(DOCS_WIDE, ("text",), None, stop, stem)
        flds, docf = ("text",), "text"
    else:
        idx = index_ctes(ARTICLE_WIDE, ARTICLE_FIELDS, "_doc", stop, stem)
        flds, docf = (fields or ARTICLE_FIELDS), "_doc"
    return ("WITH " + idx + ",\n" + scores_cte(queries, {"s": (model, params)}, mode, flds, docf,
                                               analyzer_sql=pipeline_tokens(stop, stem))
            + ",\n" + topk_cte("x_run", "x_sc", "s", k) + "\n" + RUN_SELECT.format(src="x_run"))


def run_cte_sql(src_kind: str, queries: str, model: str, mode: str, k: int, params=None,
                fields=None) -> str:
    """CTE list (without WITH) ending in x_run(topic_id, doc_id, score, rank)."""
    if src_kind == "docs":
        idx = index_ctes(DOCS_WIDE, ("text",), None)
        flds, docf = ("text",), "text"
    else:
        idx = index_ctes(ARTICLE_WIDE, ARTICLE_FIELDS, "_doc")
        flds, docf = (fields or ARTICLE_FIELDS), "_doc"
    return (idx + ",\n" + scores_cte(queries, {"s": (model, params)}, mode, flds, docf)
            + ",\n" + topk_cte("x_run", "x_sc", "s", k))


def fused_cte_sql(src_kind: str, queries: str, first: str, second: str, mode: str, k: int) -> str:
    """CTE list ending in x_fused(topic_id, doc_id, rank, score)."""
    if src_kind == "docs":
        idx = index_ctes(DOCS_WIDE, ("text",), None)
        flds, docf = ("text",), "text"
    else:
        idx = index_ctes(ARTICLE_WIDE, ARTICLE_FIELDS, "_doc")
        flds, docf = ARTICLE_FIELDS, "_doc"
    sc = scores_cte(queries, {"a": (first, None), "b": (second, None)}, mode, flds, docf)
    return (idx + ",\n" + sc + ",\n"
            + topk_cte("x_ra", "x_sc", "a", k) + ",\n"
            + topk_cte("x_rb", "x_sc", "b", k) + ",\n"
            + """x_both AS (SELECT topic_id, doc_id, score, 0 AS src, rank AS src_rank FROM x_ra
             UNION ALL SELECT topic_id, doc_id, score, 1, rank FROM x_rb),
x_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY src) AS o
            FROM x_both) WHERE o = 1),
x_fused AS (SELECT topic_id, doc_id, score,
            row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, src, src_rank) AS rank FROM x_first)""")


# The evaluation, written out by hand from the measures' definitions; nothing here comes from the Spark side.
_K = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
_LEVELS = tuple(f"{i / 10:.2f}" for i in range(11))
_MULTS = tuple(f"{i / 5:.2f}" for i in range(1, 11))


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def eval_ctes(run_ctes: str, run_name: str = "x_run") -> str:
    """CTE list ending in e_topic (per-topic measures) and e_base (judged run).

    Each measure is an aggregate over the topic's ranked list ``f``: pos and
    grade of every document, with the relevant (cr), judged nonrelevant (cn)
    and pooled (cp) ones up to it.
    """
    m = {"num_ret": "count(*)", "num_rel": "any_value(r)", "num_rel_ret": "count(*) FILTER (WHERE hit)",
         "num_nonrel_judged_ret": "count(*) FILTER (WHERE rel = 0)",
         "map": _ratio("sum(cr::DOUBLE / pos) FILTER (WHERE hit)", "any_value(r)"),
         "Rprec": _ratio("count(*) FILTER (WHERE hit AND pos <= r)", "any_value(r)"),
         "bpref": _ratio("sum(1 - coalesce(least(cn, r)::DOUBLE / nullif(least(nn, r), 0), 0)) FILTER (WHERE hit)",
                         "any_value(r)"),
         "recip_rank": "coalesce(1::DOUBLE / min(pos) FILTER (WHERE hit), 0)"}
    for x in _LEVELS:
        m[f"iprec_at_recall_{x.replace('.', '_')}"] = (
            f"coalesce(max(cr::DOUBLE / pos) FILTER (WHERE hit AND cr >= floor({x}::DECIMAL(9,2) * r + 0.9::DECIMAL(9,2))), 0)")
    for k in _K:
        top = f"count(*) FILTER (WHERE hit AND pos <= {k})"
        m[f"P_{k}"] = f"{top}::DOUBLE / {k}"
        m[f"recall_{k}"] = _ratio(top, "any_value(r)")
        m[f"relative_P_{k}"] = _ratio(top, f"least({k}, any_value(r))")
        m[f"map_cut_{k}"] = _ratio(f"sum(cr::DOUBLE / pos) FILTER (WHERE hit AND pos <= {k})", "any_value(r)")
        m[f"ndcg_cut_{k}"] = _ratio(f"sum(greatest(rel, 0) / log2(pos + 1)) FILTER (WHERE pos <= {k})", f"any_value(best_{k})")
    for x in _MULTS:
        cut = f"floor({x}::DECIMAL(9,2) * r + 0.9::DECIMAL(9,2))"
        m[f"Rprec_mult_{x.replace('.', '_')}"] = _ratio(f"count(*) FILTER (WHERE hit AND pos <= {cut})", f"any_value({cut})")
    for k in (1, 5, 10):
        m[f"success_{k}"] = f"(count(*) FILTER (WHERE hit AND pos <= {k}) > 0)::INTEGER::DOUBLE"
    m |= {"ndcg": _ratio("sum(greatest(rel, 0) / log2(pos + 1))", "any_value(best)"),
          "set_P": "count(*) FILTER (WHERE hit)::DOUBLE / count(*)",
          "set_recall": _ratio("count(*) FILTER (WHERE hit)", "any_value(r)"),
          "set_relative_P": _ratio("count(*) FILTER (WHERE hit)", "least(count(*), any_value(r))"),
          "utility": "(2 * count(*) FILTER (WHERE hit) - count(*))::DOUBLE",
          "infAP": _ratio("sum(1::DOUBLE / pos + CASE WHEN pos > 1 THEN (pos - 1)::DOUBLE / pos * (cp - 1) / (pos - 1)"
                          " * (cr - 1 + 0.00001) / (cr - 1 + cn + 0.00002) ELSE 0 END) FILTER (WHERE hit)", "any_value(r)")}
    per = ",\n  ".join(f'{e} AS "{n}"' for n, e in m.items())
    best = ", ".join(f"sum(rel / log2(pos + 1)) FILTER (WHERE pos <= {k}) AS best_{k}" for k in _K)
    points = ", ".join(f"iprec_at_recall_{x.replace('.', '_')}" for x in _LEVELS)
    return f"""{run_ctes},
e_q AS ({QRELS}),
e_b0 AS (SELECT topic_id, doc_id, score::DOUBLE AS score, q.rel, coalesce(q.rel >= 1, false) AS hit
         FROM {run_name} LEFT JOIN e_q q USING (topic_id, doc_id) WHERE topic_id IN (SELECT topic_id FROM e_q)),
e_run AS (SELECT topic_id FROM e_b0),
e_base AS (SELECT *, row_number() OVER w AS pos, count(*) FILTER (WHERE hit) OVER w AS cr,
                  count(*) FILTER (WHERE rel = 0) OVER w AS cn, count(rel) OVER w AS cp
           FROM e_b0 WINDOW w AS (PARTITION BY topic_id ORDER BY score DESC, doc_id::VARCHAR DESC
                                  ROWS UNBOUNDED PRECEDING)),
e_best AS (SELECT topic_id, sum(rel / log2(pos + 1)) AS best, {best}
           FROM (SELECT topic_id, rel, row_number() OVER (PARTITION BY topic_id ORDER BY rel DESC) AS pos FROM e_q WHERE rel > 0)
           GROUP BY topic_id),
e_t AS (SELECT topic_id, count(*) FILTER (WHERE rel >= 1) AS r, count(*) FILTER (WHERE rel = 0) AS nn FROM e_q GROUP BY topic_id),
e_per AS (SELECT topic_id,
  {per}
  FROM e_base JOIN e_t USING (topic_id) LEFT JOIN e_best USING (topic_id) GROUP BY topic_id),
e_topic AS (SELECT *, list_avg([{points}]) AS "11pt_avg",
            {_ratio('2 * set_P * set_recall', 'set_P + set_recall')} AS "set_F", set_P * set_recall AS "set_map" FROM e_per)"""


#: Names of the report in its order; sums over topics first, means after.
_SUMS = ("num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret")
_MEANS = ("map", "Rprec", "bpref", "recip_rank", *(f"iprec_at_recall_{x}" for x in _LEVELS),
          *(f"{n}_{k}" for n in ("P", "recall", "relative_P", "map_cut", "ndcg_cut") for k in _K),
          *(f"Rprec_mult_{x}" for x in _MULTS), "success_1", "success_5", "success_10", "ndcg", "set_P", "set_recall",
          "set_relative_P", "utility", "infAP", "11pt_avg", "set_F", "set_map")


def eval_summary_select() -> str:
    rows = [("num_q", "count(*)")]
    rows += [(n, f'sum("{n}")') for n in _SUMS]
    rows += [(n, f'avg("{n.replace(".", "_")}")') for n in _MEANS]
    rows += [(f"gm_{n}", f'exp(avg(ln(greatest("{n}", 0.00001))))') for n in ("map", "bpref")]
    return "SELECT ord::INTEGER AS ord, name, value FROM (" + "\nUNION ALL ".join(
        f"SELECT {i} AS ord, '{n}' AS name, ({e})::DOUBLE AS value FROM e_topic" for i, (n, e) in enumerate(rows)) + ")"
