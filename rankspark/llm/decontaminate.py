"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of the normalised items. A document's
words stream through it; at each word it gives the longest suffix that occurs
in an item. A window (``window`` consecutive words of an item, or all words of
a shorter one) ends at a word when that suffix is long enough, and its items
stand at the state of exactly that suffix. Before the walk, runs of
neighbouring words that follow each other in some item are found with arrays;
no window lies outside them, so the walk leaves the rest out.

The items come in blocks of at most ``block_words`` words: one automaton is
built and broadcast at a time, so driver and workers hold one block. With
several blocks the documents are written once, with a row number; each block
writes what it finds of them, (row, spans, items, longest match), and no text;
the findings are put together by row at the end.

Normalisation: A-Z become lower case; words are runs of digits, ASCII letters
and non-ASCII characters.

Defined results: null or wordless texts have no words, no hits; null item
texts and wordless items have no window; items without id hit words but are
not listed; repeated items and ids count once; an empty benchmark hits
nothing; an empty table gives no rows; a very long text is streamed whole.
Columns are read by their exact names and carried by position, so other
columns don't matter. Documents are never cut by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.llm.common import map_arrow, named, prepare, written

WINDOW = 10
BLOCK_WORDS = 200_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the windows' items at its states."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = []
        for _, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            sequences.append(ids)
            state = 0
            for w in ids:
                state = self._extend(state, w)
        self.shortest = min([min(len(s), window) for s in sequences if s], default=window)
        self._mark(sequences)
        pairs = {a * len(self.vocab) + b for s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _mark(self, sequences: list[list[int]]) -> None:
        """holders[state]: items with a window that is the state's window-long suffix, or short
        items that the state spells; short[state]: nearest such state up the links, itself included."""
        self.holders: dict[int, set[int]] = {}
        spells = set()
        for k, ids in enumerate(sequences):
            state, n = 0, 0
            for i, w in enumerate(ids):
                state, n = self.step(state, n, w)
                if i + 1 >= self.window:
                    self.holders.setdefault(self.windowed(state), set()).add(k)
            if 0 < len(ids) < self.window:
                spells.add(state)
                self.holders.setdefault(state, set()).add(k)
        self.short = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = s if s in spells else self.short[self.link[s]]

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            n = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], n + 1
        return 0, 0

    def windowed(self, state: int) -> int:
        """The state of the window-long suffix of a match that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], list[int], int]:
        """Runs [start, end) of hit words, the items hit, and the longest match."""
        n = len(words)
        if n < self.shortest or not self.vocab:
            return [], [], 0
        ids = np.fromiter(map(self.vocab.get, words, [-1] * n), np.int64, n)
        known = ids >= 0
        if self.shortest > 1:
            code = ids[:-1] * len(self.vocab) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            follows = known[:-1] & known[1:] & (self.pairs[at] == code)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], follows.view(np.int8), [0]))))
            runs = [(a, b + 1) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.shortest]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            runs = list(zip(edge[::2], edge[1::2]))
        spans: list[list[int]] = []
        states: set[int] = set()
        longest = 0
        for a, b in runs:
            state, m = 0, 0
            for i, w in enumerate(ids[a:b].tolist(), int(a)):
                state, m = self.step(state, m, w)
                longest = max(longest, m)
                back = 0
                if m >= self.window:
                    states.add(self.windowed(state))
                    back = self.window
                s = self.short[state]
                if s and self.length[s] > m:
                    s = self.short[self.link[s]]
                while s:
                    states.add(s)
                    back = max(back, self.length[s])
                    s = self.short[self.link[s]]
                if back:
                    start = i + 1 - back
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, sorted(set().union(*(self.holders[s] for s in states))), longest


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in blocks of at most ``block_words`` words (an item longer than that is a block).

    Blocks are planned from per-slot word counts, each fetched alone: the
    driver holds one block of the test set at a time.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), text.alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    slots = 1 + int(size // (3 * block_words))  # most words and their space take at least so many bytes
    for k in range(slots):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slots)) == k) if slots > 1 else rows
        block, held = [], 0
        for r in part.toLocalIterator():
            words = words_of(r["text"].encode())
            if words:
                if block and held + len(words) > block_words:
                    yield block
                    block, held = [], 0
                block.append((r["item"], words))
                held += len(words)
        if block:
            yield block


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text",
         item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``carry`` columns plus n_words, spans array<array<int>> (word runs hit), items array<string>, longest."""
    blocks = item_blocks(benchmark, item_col, bench_text, block_words)
    block, following = next(blocks, []), next(blocks, None)
    keys = [f"k{k}" for k in range(len(carry))]
    rows = docs.select(*[named(c).alias(k) for c, k in zip(carry, keys)], named(text_col).cast("string").alias("text"))
    if following is None:
        found = _scanned(rows, keys, block, window)
    else:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        hits = []
        while block is not None:
            own = _scanned(rows, ["row"], block, window).filter(F.col("longest") > 0).drop("n_words")
            hits.append(written(own, "decontaminate-hits"))
            block, following = following, next(blocks, None)
        found = _put_together(rows, keys, hits)
    return found.select(*[F.col(k).alias(c) for c, k in zip(carry, keys)], *FOUND)


FOUND = ["n_words", "spans", "items", "longest"]


def _scanned(rows: DataFrame, keys: list[str], block: list, window: int) -> DataFrame:
    """``keys`` and what one block of items finds in each text."""
    shared = rows.sparkSession.sparkContext.broadcast((Automaton(block, window), [i for i, _ in block]))
    rows = rows.select(*keys, "text")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(
        "n_words long, spans array<array<int>>, items array<string>, longest int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, ids = shared.value
        for b in batches:
            n, spans, items, longest = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text) if text else []
                s, i, m = auto.hits(words)
                n.append(len(words))
                spans.append(_merge(s))
                items.append(sorted({ids[k] for k in i if ids[k] is not None}))
                longest.append(m)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                 pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())], names=schema.names)

    return map_arrow(rows, run, schema)


def _put_together(rows: DataFrame, keys: list[str], hits: list[DataFrame]) -> DataFrame:
    """The blocks' findings joined to the rows; only rows that some block has something of are grouped."""
    every = reduce(DataFrame.unionByName, hits).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [_merge(s or []) for s in b.column("spans").to_pylist()]
            yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(merged, pa.list_(pa.list_(pa.int32()))))

    every = map_arrow(every, run, every.schema)
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    none = {"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>"), "longest": F.lit(0)}
    return rows.select(*keys, "row", n_words.cast("long").alias("n_words")).join(every, "row", "left").select(
        *keys, "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def cut_spans(text: str, spans: list, n_words: int, max_span: int, max_coverage: float) -> str | None:
    """The text without the hit runs over a limit; None if the document itself goes.

    A run goes when it is longer than ``max_span`` words; every run goes, and
    the document with them when no word is left, once they cover more than
    ``max_coverage`` of the words.
    """
    covered = sum(b - a for a, b in spans)
    over = covered > max_coverage * n_words
    gone = [(a, b) for a, b in spans if over or b - a > max_span]
    if not gone:
        return text
    if covered == n_words and over:
        return None
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in gone:
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return "".join(out) + text[end:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_span: int = 0,
                  max_coverage: float = 0.8, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                  **names) -> DataFrame:
    """``docs`` with hit runs removed from their texts; documents that are nothing else go.

    Words on both sides of a removed run become neighbours and may spell a
    window anew, so changed documents are scanned again until none changes.
    """
    columns = docs.columns
    keys = [f"c{k}" for k in range(len(columns))]
    text = keys[columns.index(text_col)]
    whole = docs.select(*[named(c).alias(k) for c, k in zip(columns, keys)])
    prepare(docs.sparkSession)
    cut = F.udf(cut_spans, "string", useArrow=True).asNondeterministic()  # else Spark cuts once more for the filter
    done = []
    while not done or not whole.isEmpty():
        found = written(scan(whole, benchmark, keys, text, window=window, block_words=block_words, **names),
                        "decontaminate")
        fixed = (found.filter(F.size("spans") > 0)
                 .withColumn("cut", cut(F.col(text), "spans", "n_words", F.lit(max_span), F.lit(float(max_coverage))))
                 .filter(F.col("cut").isNotNull()))
        whole = written(fixed.select(*keys, "cut"), "decontaminate")
        done += [found.filter(F.size("spans") == 0).select(*keys),
                 whole.filter(F.col("cut") == F.col(text)).select(*keys)]
        whole = whole.filter(F.col("cut") != F.col(text)).withColumn(text, F.col("cut")).select(*keys)
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(k).alias(c) for c, k in zip(columns, keys)])
