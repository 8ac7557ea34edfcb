"""Quality rules: one ledger of failure bits and measurements, policies on top.

``ledger`` measures every document once and evaluates every rule once: bit k
of ``failed`` is set when rule k fails. A policy is a version with the set of
rules it enforces; it keeps a document when ``failed`` and its mask share no
bit, so a new policy, or a rule taken out, needs no second look at a text.
``ablations`` counts, from the distinct bit patterns alone, what each rule of
a policy removes and what the policy would keep without it.

``update_ledger`` stores the ledger under the version of the rules, with each
text's SHA-256: a document that stands there is not looked at again, a text
that stands there under another id is not measured again, and other rules have
a ledger of their own. Policies and ablations of a stored ledger read no text.

Only DataFrame functions are used. Repeated 8-word windows are found inside
the row: words are hashed once, windows of 2, 4 and 8 words by pairing
shifted arrays, and only rows where a window hash repeats sort theirs. A
repeat is one of 64-bit hashes.

Words are runs of other than the six ASCII white-space characters. Defined
results: null and empty texts have 0 words and fail ``min_words``; a very long
text is measured whole, inside its row; repeated rows and null ids are measured
row by row (a stored ledger takes a row in whose id and text it has as known);
an empty table gives no rows. Id and text are read by their exact names, so
other columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import named, written

SPACE = r"[ \t-\r]+"
WINDOW = 8

# name -> failing condition over the measurements, in bit order. Bits are never reused.
RULES: dict[str, str] = {
    "min_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 30 * n_words",
    "few_distinct": "20 * n_distinct < n_words",
    "shouting": "2 * n_upper > n_letters",
}
BASE = ("min_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", (*BASE, "symbols", "duplicate_lines")),
    "v3": Policy("v3", tuple(RULES)),
}


def _paired(a: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places on, for the places that have one."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and measurements of every document.

    Arrays that a lambda or several measures use are columns of a generator's
    output, so that Spark does not compute them anew for each use.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    row = docs.select(named(id_col).alias("id"), F.inline(F.array(F.struct(
        words.alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper")))))
    row = row.select("id", "n_symbols", "n_letters", "n_upper",
                     F.size("words").cast("long").alias("n_words"),
                     F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                     F.size("lines").cast("long").alias("n_lines"),
                     (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                     F.inline(F.array(F.struct(F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")))))
    row = row.withColumn("n_distinct", F.size(F.array_distinct("hashes")).cast("long"))
    for source, target, by in (("hashes", "pairs", 1), ("pairs", "fours", 2), ("fours", "grams", 4)):
        row = row.select("*", F.inline(F.array(F.struct(_paired(F.col(source), by).alias(target))))).drop(source)
    places = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size("grams") > F.size(F.array_distinct("grams"))
    row = row.select("*", F.inline(F.array(F.struct(F.when(repeats, places).alias("places"))))).drop("grams")
    before, after = _shifted("places")
    same = F.zip_with(before, after, lambda p, q: F.when(p["g"] == q["g"], F.array(p["i"], q["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))
    row = row.select("*", F.inline(F.array(F.struct(at.alias("at"))))).drop("places")
    before, after = _shifted("at")
    gaps = F.zip_with(before, after, lambda p, q: F.least(q - p, F.lit(WINDOW)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda a, g: a + g)).otherwise(0)
    return row.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def _shifted(name: str) -> tuple[Column, Column]:
    """An array without its last and without its first element."""
    n = F.greatest(F.size(name) - 1, F.lit(0))
    return F.slice(name, F.lit(1), n), F.slice(name, F.lit(2), n)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed`` (bit k: rule k of RULES) of every document."""
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failed", failed.cast("long"))


def rules_version() -> str:
    """Tells apart what was measured and by which rules."""
    return hashlib.sha256(repr((SPACE, WINDOW, list(RULES.items()))).encode()).hexdigest()[:16]


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored ledger of the present rules, with ``digest``; None if there is none."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/rules={rules_version()}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the documents that the stored ledger lacks; the whole ledger as stored."""
    spark, target = docs.sparkSession, f"{path.rstrip('/')}/rules={rules_version()}"
    keyed = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = read_ledger(spark, path)
    if known is None:
        _digested(keyed).write.mode("append").parquet(target)
        return read_ledger(spark, path)
    old = known.select(F.col("id").alias("old_id"), F.col("digest").alias("old_digest")).distinct()
    new = keyed.join(old, (F.col("digest") == F.col("old_digest")) & F.col("id").eqNullSafe(F.col("old_id")), "left_anti")
    by_text = known.drop("id").dropDuplicates(["digest"])
    same = new.select("id", "digest").join(by_text, "digest").select(known.columns)
    other = _digested(new.join(by_text.select("digest"), "digest", "left_anti")).select(known.columns)
    # Written beside the ledger first: it cannot be appended to while it is read.
    written(same.unionByName(other), "ledger").write.mode("append").parquet(target)
    return read_ledger(spark, path)


def _digested(keyed: DataFrame) -> DataFrame:
    """The ledger of (id, text, digest) rows, with the digest."""
    key = F.struct("id", "digest")
    book = ledger(keyed.select(key.alias("key"), "text"), "key", "text")
    return book.select(F.col("id.id").alias("id"), F.col("id.digest").alias("digest"), *[c for c in book.columns if c != "id"])


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` (its version) and ``kept``."""
    return book.withColumn("policy", F.lit(policy.version)).withColumn(
        "kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policies: list[Policy]) -> DataFrame:
    """(policy, rule, n_failed, n_only, kept, kept_without): what each rule of each policy does.

    The ledger shrinks to one row per bit pattern (at most 2**rules) before
    policies are looked at.
    """
    patterns = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    table = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"),
                               F.lit(1 << names.index(r)).cast("long").alias("bit"), F.lit(p.mask).cast("long").alias("mask"))
                      for p in policies for r in p.rules])
    each = patterns.select("failed", "n", F.inline(table))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"), total(hit == 0).alias("kept"),
        total((hit == 0) | (hit == F.col("bit"))).alias("kept_without"))
