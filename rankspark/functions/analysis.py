"""Text analysis as Column expressions.

Everything here stays JVM-side: tokenizing is ``split``/``lower``/``filter``,
stop-word removal is an ``array_contains`` test against a literal array, and
stemming is a ``regexp_replace`` chain applied inside ``transform``. Term
counting per document is done inside the row (sort the token array, find the
run starts), so building postings needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word-split pattern of the default analysis (lowercase,
# split on anything that is not a letter or a digit).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# The English stop set used by the default analyzers of the
# field-index library family (public list, 33 words).
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """lower + split on non letter/digit runs, empty pieces dropped."""
    return F.filter(F.split(F.lower(F.coalesce(_as_col(text), F.lit(""))), TOKEN_SPLIT),
                    lambda x: x != "")


def spaced(text: Column | str) -> Column:
    """The words of ``tokenize`` in one string, a space for each run between them (and before or after them)."""
    return F.regexp_replace(F.lower(F.coalesce(_as_col(text), F.lit(""))), TOKEN_SPLIT, " ")


def remove_stop_words(tokens: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda x: ~F.array_contains(stop, x))


def s_stem(term: Column) -> Column:
    """The 'S' stemmer (Harman, 1991): plural endings only.

    ies -> y unless eies/aies; es -> e unless aes/ees/oes; s -> '' unless us/ss.
    Endings are compared as strings; no pattern is run on the tokens.
    """
    def ends(*tails: str) -> Column:
        return reduce(lambda a, b: a | b, [F.endswith(term, F.lit(t)) for t in tails])

    def cut(n: int) -> Column:
        return F.substr(term, F.lit(1), F.char_length(term) - n)

    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
        .when(ends("s") & ~ends("us", "ss"), cut(1))
        .otherwise(term)
    )


@dataclass(frozen=True)
class Analyzer:
    """Term pipeline. Default: lowercase word split only."""

    stop_words: tuple | None = None
    stem: bool = False

    @property
    def plain(self) -> bool:
        """Whether its terms are just the words."""
        return not self.stop_words and not self.stem

    def tokens(self, text: Column | str) -> Column:
        toks = tokenize(text)
        if self.stop_words:
            toks = remove_stop_words(toks, self.stop_words)
        if self.stem:
            toks = F.transform(toks, s_stem)
        return toks


DEFAULT = Analyzer()
# The document engine's pipeline switch (stop words + stemming).
PIPELINE = Analyzer(stop_words=ENGLISH_STOP_WORDS, stem=True)


def counted(df: DataFrame, tokens: Column, keep: list, out: str = "entries") -> DataFrame:
    """``keep`` + dl + ``out`` array<struct<term, tf>>, term counts computed in-row.

    Sort the tokens, keep the indexes where a new term starts, and the run
    length up to the next start is the term frequency: O(n log n) per row and
    no shuffle, unlike explode + groupBy(doc, term). The sorted array and the
    start list are separate projected columns because the lambdas read them
    per element; the optimizer keeps such multiply-referenced expressions in
    their own projection instead of inlining (re-sorting) them.
    """
    s1 = df.select(*keep, F.sort_array(tokens).alias("_sorted"))
    toks = F.col("_sorted")
    s2 = s1.select(*keep, "_sorted", F.filter(
        F.transform(toks, lambda x, i: F.when((i == 0) | (x != F.get(toks, i - 1)), i)
                    .otherwise(F.lit(-1))),
        lambda j: j >= 0).alias("_starts"))
    starts, n = F.col("_starts"), F.size(toks)
    entries = F.transform(
        starts,
        lambda st, j: F.struct(F.get(toks, st).alias("term"),
                               (F.coalesce(F.get(starts, j + 1), n) - st).cast("int").alias("tf")))
    return s2.select(*keep, n.cast("int").alias("dl"), entries.alias(out))


def query_terms(queries: DataFrame, analyzer: Analyzer = DEFAULT,
                id_col: str = "topic_id", text_col: str = "text") -> DataFrame:
    """(topic_id, term, qtf): query-term multiplicity (D5), in-row like postings."""
    q = queries.select(F.col(id_col).alias("topic_id"), F.col(text_col).alias("_text"))
    return (counted(q, analyzer.tokens("_text"), ["topic_id"])
            .select("topic_id", F.inline_outer("entries"))
            .filter(F.col("term").isNotNull())
            .withColumnRenamed("tf", "qtf"))
