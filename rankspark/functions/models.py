"""Weighting models as Column expressions.

A model is ``fn(t: Terms, **params) -> Column`` giving one matched query
term's contribution; a document's score is the sum over its matched terms.
Being plain expressions, models stay inside whole-stage code generation.
``register_model`` is the extension point for new models.

Symbols: tf, qtf, df, cf (collection frequency), n (documents), dl, avgdl.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default parameters of the reference configuration.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_K3 = 8.0
DFR_C = 1.0
LOG2_E = math.log2(math.e)


@dataclass(frozen=True)
class Terms:
    tf: Column
    qtf: Column
    df: Column
    cf: Column
    n: Column
    dl: Column
    avgdl: Column

    @staticmethod
    def from_columns() -> "Terms":
        return Terms(*(F.col(c).cast("double") for c in
                       ("tf", "qtf", "df", "cf", "n", "dl", "avgdl")))


def _tfn(t: Terms, c: float) -> Column:
    """Normalization H2: tf * log2(1 + c * avgdl / dl)."""
    return t.tf * F.log2(1.0 + c * t.avgdl / t.dl)


def bm25_field(t: Terms, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """G1: field-index BM25, natural-log idf that never goes negative."""
    idf = F.log(1.0 + (t.n - t.df + 0.5) / (t.df + 0.5))
    return t.qtf * idf * (k1 + 1.0) * t.tf / (t.tf + k1 * (1.0 - b + b * t.dl / t.avgdl))


def bm25_doc(t: Terms, k1: float = BM25_K1, b: float = BM25_B, k3: float = BM25_K3) -> Column:
    """Document-engine BM25, log2 idf (negative for df > n/2, kept)."""
    k = k1 * ((1.0 - b) + b * t.dl / t.avgdl)
    idf = F.log2((t.n - t.df + 0.5) / (t.df + 0.5))
    return idf * ((k1 + 1.0) * t.tf / (k + t.tf)) * ((k3 + 1.0) * t.qtf / (k3 + t.qtf))


def _g_term(t: Terms, tfn: Column) -> Column:
    lam = t.cf / t.n
    return F.log2(1.0 + lam) + tfn * F.log2((1.0 + lam) / lam)


def _after_effect_b(t: Terms, tfn: Column) -> Column:
    return (t.cf + 1.0) / (t.df * (tfn + 1.0))


def dfr_gbh2(t: Terms, c: float = DFR_C) -> Column:
    """DFR with basic model G, after-effect B, normalization H2."""
    tfn = _tfn(t, c)
    return t.qtf * _after_effect_b(t, tfn) * _g_term(t, tfn)


def _stirling(n: Column, m: Column) -> Column:
    return (m + 0.5) * F.log2(n / m) + (n - m) * F.log2(n)


def bb2(t: Terms, c: float = DFR_C) -> Column:
    """Bose-Einstein BB2 with after-effect B and H2.

    When cf - tfn < 0.5 the Stirling terms leave their domain; the G term is
    used there instead, and the Stirling branch is written with
    least(tfn, cf - 0.5) so it stays finite even if evaluated.
    """
    tfn = _tfn(t, c)
    safe = F.least(tfn, t.cf - 0.5)
    bose = (-F.log2(t.n - 1.0) - LOG2_E
            + _stirling(t.n + t.cf - 1.0, t.n + t.cf - safe - 2.0)
            - _stirling(t.cf, t.cf - safe))
    body = F.when(t.cf - tfn < 0.5, _g_term(t, tfn)).otherwise(bose)
    return t.qtf * _after_effect_b(t, tfn) * body


def dfr_bm25(t: Terms, c: float = DFR_C) -> Column:
    """DFR-style BM25: tfn/(tfn+1) * log2 idf."""
    tfn = _tfn(t, c)
    return t.qtf * tfn / (tfn + 1.0) * F.log2((t.n - t.df + 0.5) / (t.df + 0.5))


def tf_idf(t: Terms) -> Column:
    """Example user model (K1), for ``register_model``: qtf * tf * log2(n / df)."""
    return t.qtf * t.tf * F.log2(t.n / t.df)


MODELS: dict[str, Callable[..., Column]] = {
    "bm25_field": bm25_field,
    "bm25_doc": bm25_doc,
    "dfr_gbh2": dfr_gbh2,
    "bb2": bb2,
    "dfr_bm25": dfr_bm25,
}


#: Models whose contribution, for fixed statistics, rises or falls all the way with tf and the other way with dl
#: (falling where a weight is negative), so that its largest value in a block stands at a corner.
MONOTONE = {"bm25_field", "bm25_doc", "dfr_gbh2", "dfr_bm25"}


def register_model(name: str, fn: Callable[..., Column], monotone: bool = False) -> None:
    """Add a model: ``fn(t: Terms, **params) -> Column``; ``monotone`` (see MONOTONE) lets it prune."""
    MODELS[name] = fn
    (MONOTONE.add if monotone else MONOTONE.discard)(name)


def contribution_bounds(model: str, params: dict | None = None) -> tuple[Column, Column] | None:
    """What the model can contribute at least and at most where tf lies in min_tf .. max_tf and dl in min_dl .. max_dl.

    None where no bounds are known: models not declared monotone, or parameters
    for which they are not.

    G and B: (A + B tfn) / (tfn + 1) has no turning point. BB2: the information
    is convex in tfn while cf - tfn >= 1 (there 1/(cf - tfn) + 1/(n + cf - tfn - 2) <= 2),
    and a convex function over tfn + 1 falls, then rises: its largest value is at
    an end too. Beyond that (terms that nearly one document holds alone) the
    upper bound is infinite. From five documents on the information rises with
    tfn throughout, so it is nowhere below 0 and what the weaker corner gives.
    """
    p = params or {}
    if p.get("k1", 0) < 0 or not 0 <= p.get("b", 0) <= 1 or p.get("k3", 0) < 0 or p.get("c", 1) <= 0:
        return None
    if model not in MONOTONE and model != "bb2":
        return None

    def at(tf: str, dl: str) -> Terms:
        return Terms(*(F.col(c).cast("double") for c in (tf, "qtf", "df", "cf", "n", dl, "avgdl")))

    strong, weak = at("max_tf", "min_dl"), at("min_tf", "max_dl")
    corners = MODELS[model](strong, **p), MODELS[model](weak, **p)
    low, high = F.least(*corners), F.greatest(*corners)
    if model == "bb2":
        inf = float("inf")
        sure = (strong.cf - _tfn(strong, p.get("c", DFR_C)) >= 1) & (strong.n >= 3)
        return F.when(strong.n >= 5, F.least(F.lit(0.0), corners[1])).otherwise(-inf), F.when(sure, high).otherwise(inf)
    return low, high


def contribution(model: str, params: dict | None = None) -> Column:
    return MODELS[model](Terms.from_columns(), **(params or {}))


# Algorithm dispatch (C10) per engine mode (C11): which model each request
# algorithm maps to. BM25_PLUS_DFR fuses the BM25 and DFR runs.
ALGORITHMS = {
    "field_max": {"BM25": "bm25_field", "DFR": "dfr_gbh2", "DFR_BM25": "dfr_bm25"},
    "document": {"BM25": "bm25_doc", "DFR": "bb2", "DFR_BM25": "dfr_bm25"},
}
ENGINE_MODES = {"ELASTICSEARCH": "field_max", "TERRIER": "document"}
DEFAULT_K = {"field_max": 1000, "document": 20}
