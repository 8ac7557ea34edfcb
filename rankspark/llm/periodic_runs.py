"""Periodic runs of words, found in a Re-Pair grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same), of at least ``max(MIN_WORDS, MIN_EXPONENT * q)`` words, that
neither neighbour extends.

``repair`` replaces the most frequent pair of neighbouring symbols by a new
nonterminal until no pair occurs twice. Every nonterminal's expansion is told
by its first place in the text. The start rule, which holds what is left, is
read as a balanced binary tree over its symbols. A run then lies whole inside
the expansion of some lowest node, and crosses that node's boundary between
left and right part:

* each node's boundary is looked at once, however often the node is derived:
  at a run of exponent two or more that crosses c, either the q words from c
  are repeated right after, or the q words before c right before. ``crossing``
  takes the periods for which that can hold from the words equal to the one at
  the boundary and extends the match both ways;
* what a nonterminal has is translated to all its derivation positions;
* the intervals found are merged: one that is part of a longer interval of
  its period was cut off by its node's edge; of several periods of one
  interval the smallest counts.

A boundary is passed over at once when the pair of words across it occurs less
than ``MIN_EXPONENT - 1`` times in the text: no run can hold such a pair.

Rows are worked on one by one where they lie, without a shuffle. The time for
a text of n words is about n log n.

Defined results: null and empty texts have no words and no runs; a very long
text is worked on whole; ids may be null or repeat; an empty table gives no
rows. ``id_col`` and ``text_col`` are read by their exact names, so other
columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.llm.common import map_arrow, named

MIN_EXPONENT = 4
MIN_WORDS = 6
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Re-Pair of a sequence: ``rules[k] = (left, right)`` is symbol ``terminals + k``.

    ``places[k]`` is where the rule's expansion first stands and ``sizes[k]``
    how many words it has. ``symbols`` and ``starts`` are the start rule's
    symbols and where each begins.
    """

    def __init__(self, words: np.ndarray, terminals: int):
        self.words, self.terminals = words, terminals
        self.rules: list[tuple[int, int]] = []
        self.places: list[int] = []
        self.sizes: list[int] = []
        n = len(words)
        key = words[:-1] * np.int64(terminals) + words[1:]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
        counts = np.diff(np.append(cuts, len(key)))
        #: For each two neighbours, how often their pair occurs.
        self.pair_counts = np.empty(len(key), np.int64)
        self.pair_counts[order] = np.repeat(counts, counts)
        often = np.flatnonzero(counts > 1)
        if not len(often):
            self.symbols, self.starts = words, np.arange(n)
            return
        at = {}
        for a, c in zip(cuts[often].tolist(), counts[often].tolist()):
            own = order[a:a + c].tolist()
            at[(int(words[own[0]]), int(words[own[0] + 1]))] = own
        symbols = words.tolist()
        self._replace(symbols, at)
        left = np.array(symbols)
        self.starts = np.flatnonzero(left >= 0)
        self.symbols = left[self.starts]

    def _replace(self, symbols: list[int], at: dict[tuple[int, int], list[int]]) -> None:
        """``at``: the places of the pairs that occur twice or more. A place that was taken in becomes -1."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(-len(own), pair) for pair, own in at.items()]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            a, b = pair
            live, last = [], -1
            for i in at[pair]:
                if symbols[i] == a and i != last and (j := after[i]) < n and symbols[j] == b:
                    live.append(i)
                    last = j  # a place of aaa that overlaps does not count
            if len(live) < -count:  # other rules took some
                if len(live) > 1:
                    at[pair] = live
                    heapq.heappush(heap, (-len(live), pair))
                else:
                    del at[pair]
                continue
            del at[pair]
            new = self.terminals + len(self.rules)
            self.rules.append(pair)
            self.places.append(live[0])
            self.sizes.append(self.size(a) + self.size(b))
            for i in live:
                j = after[i]
                symbols[i], symbols[j] = new, -1
                after[i] = k = after[j]
                before[k] = i
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in live:
                if (p := before[i]) >= 0:
                    fresh.setdefault((symbols[p], new), []).append(p)
                if (k := after[i]) < n and symbols[k] != new:
                    fresh.setdefault((new, symbols[k]), []).append(i)
            for pair, own in fresh.items():
                if len(own) > 1:
                    at[pair] = own
                    heapq.heappush(heap, (-len(own), pair))

    def size(self, symbol: int) -> int:
        return 1 if symbol < self.terminals else self.sizes[symbol - self.terminals]

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rule or -1 for the start rule, begin, boundary, end) of every node, in the text."""
        place, size = np.array(self.places, np.int64), np.array(self.sizes, np.int64)
        left = np.fromiter((self.size(a) for a, _ in self.rules), np.int64, len(self.rules))
        # The start rule's tree: node k joins the symbols that share all higher bits of their number with k.
        m = len(self.starts)
        k = np.arange(1, m)
        low = k & -k
        ends = np.append(self.starts, len(self.words))
        return (np.concatenate((np.arange(len(place)), np.full(max(0, m - 1), -1))),
                np.concatenate((place, ends[k - low])), np.concatenate((place + left, ends[k])),
                np.concatenate((place + size, ends[np.minimum(m, k + low)])))

    def derivations(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """All places at which each of the ``wanted`` rules is derived."""
        inner = set(wanted)
        for k, (a, b) in enumerate(self.rules):  # a rule stands after those that it uses
            if a - self.terminals in inner or b - self.terminals in inner:
                inner.add(k)
        order = np.argsort(self.symbols, kind="stable")
        symbols = self.symbols[order]
        places: dict[int, list[np.ndarray]] = {}
        for k in sorted(inner, reverse=True):
            a, z = np.searchsorted(symbols, [self.terminals + k, self.terminals + k + 1])
            own = np.concatenate([self.starts[order[a:z]], *places.pop(k, [])])
            places[k] = [own]
            left, right = self.rules[k]
            for child, shift in ((left, 0), (right, self.size(left))):
                if child - self.terminals in inner:
                    places.setdefault(child - self.terminals, []).append(own + shift)
        return {k: places[k][0] for k in wanted}


def alike(words: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and from j on (backwards for step -1) are the same, ``most`` at most."""
    done, width = 0, 32
    while done < most:
        w = min(width, most - done)
        if step > 0:
            same = words[i + done:i + done + w] == words[j + done:j + done + w]
        else:
            same = (words[i - done - w + 1:i - done + 1] == words[j - done - w + 1:j - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, width = done + w, 2 * width
    return most


def _periods(words: np.ndarray, at: int, step: int, most: int) -> np.ndarray:
    """Periods q up to ``most`` for which the first words from ``at`` on equal those q further (in direction ``step``)."""
    if most < 1:
        return np.zeros(0, np.int64)
    view = words[at::step] if step > 0 else words[:at + 1][::-1]
    q = 1 + np.flatnonzero(view[1:most + 1] == view[0])
    for k in range(1, 32):
        if not len(q) or q[-1] <= k:
            break
        q = q[(q <= k) | (view[np.minimum(q + k, len(view) - 1)] == view[k])]
    return q


def crossing(words: np.ndarray, begin: int, at: int, end: int) -> list[tuple[int, int, int]]:
    """(begin, end, period) of the runs inside begin .. end that have words on both sides of ``at``, one for each interval."""
    found = []
    most = (end - begin) // MIN_EXPONENT
    covered = 0
    for q in _periods(words, at, 1, min(most, (end - at) // 2)).tolist():
        if q <= covered:  # the same stretch by a multiple of its period
            continue
        right = alike(words, at, at + q, end - at - q, 1)
        if right < q:
            continue
        left = alike(words, at - 1, at + q - 1, at - begin, -1)
        covered = (q + right) // 2
        if q + left + right >= max(MIN_WORDS, MIN_EXPONENT * q):
            found.append((at - left, at + q + right, q))
    covered = 0
    for q in _periods(words, at - 1, -1, min(most, (at - begin) // 2)).tolist():
        if q <= covered:
            continue
        left = alike(words, at - 1 - q, at - 1, at - q - begin, -1)
        if left < q:
            continue
        right = alike(words, at - q, at, end - at, 1)
        covered = (q + left) // 2
        if q + left + right >= max(MIN_WORDS, MIN_EXPONENT * q):
            found.append((at - q - left, at + right, q))
    return found


def runs_of(words: np.ndarray, terminals: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    if len(words) < MIN_WORDS:
        return []
    g = Grammar(words, terminals)
    rule, begin, at, end = g.nodes()
    rare = g.pair_counts < MIN_EXPONENT - 1  # between words k and k + 1
    keep = ~rare[at - 1] & (end - begin >= MIN_WORDS)
    rule, begin, at, end = rule[keep], begin[keep], at[keep], end[keep]
    if not len(at):
        return []
    # No run reaches over a rare pair either.
    walls = np.concatenate(([0], np.flatnonzero(rare) + 1, [len(words)]))
    k = np.searchsorted(walls, at, side="right")
    begin, end = np.maximum(begin, walls[k - 1]), np.minimum(end, walls[k])
    keep = end - begin >= MIN_WORDS
    own: dict[int, list[tuple[int, int, int]]] = {}
    for r, b, c, e in zip(*(x[keep].tolist() for x in (rule, begin, at, end))):
        if found := crossing(words, b, c, e):
            own.setdefault(r, []).extend(found)
    everywhere = set(own.pop(-1, []))
    for r, places in g.derivations(set(own)).items():
        for shift in (places - g.places[r]).tolist():
            everywhere.update((b + shift, e + shift, q) for b, e, q in own[r])
    return merged(everywhere)


def merged(intervals: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Whole runs (start, length, period) of the intervals (begin, end, period), of which some are parts of others."""
    whole: dict[tuple[int, int], int] = {}
    reach: dict[int, int] = {}
    for b, e, q in sorted(intervals, key=lambda x: (x[0], -x[1], x[2])):
        if e > reach.get(q, 0):  # an interval that lies inside an earlier one of its period is a part of it
            reach[q] = e
            whole[b, e] = min(q, whole.get((b, e), q))
    return sorted(((b, e - b, q) for (b, e), q in whole.items()), key=lambda x: (x[0], x[2]))


def find_runs(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` and (n_words, runs, collapsed) of every row; collapsed: the words, one blank between, without the
    repetitions: of each run its first q words stay."""
    names = docs.select(*keep).schema
    # Positions in place of names, so that no name can clash on the way.
    rows = docs.select(named(text_col).cast("string").cast("binary").alias("text"), *[c.alias(f"c{k}") for k, c in enumerate(keep)])
    schema = StructType([*rows.schema.fields[1:], *StructType.fromDDL(RUNS).fields])
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(text: bytes | None) -> tuple[int, list[dict], bytes]:
        words = (text or b"").split()  # bytes: at ASCII white space alone
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        runs = runs_of(ids, max(1, len(number)))
        if runs:
            edge = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                edge[start + period] += 1
                edge[start + length] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        return len(ids), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, collapsed = zip(*map(one, b.column(0).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(n, pa.int64()), pa.array(runs, pa.list_(item)),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    out = map_arrow(rows, run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(names.fields)], "n_words", "runs", "collapsed")
