"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 of every word shingle, one vote per bit. Rows with equal
fingerprints are one node, so copies cost nothing further.

Candidates: the 64 bits are cut into ``radius + agree`` blocks; two
fingerprints within ``radius`` bits agree in at least ``agree`` whole blocks,
so they meet in a bucket of one of the C(radius + agree, agree) tables keyed
by those blocks. ``agree`` only sets how selective a bucket is (it follows
the number of fingerprints); the links found are the same for each.

Comparison: the rows of many buckets lie side by side in bit planes (plane b
holds bit b of every row). The planes are compared with themselves shifted by
d rows: one exclusive-or per plane updates all distances, which carry-save
counters hold as bit vectors. A block of rows is abandoned once every lane
has passed the radius. A bucket above ``bucket_rows`` is dealt out as pairs
of its parts, so no task gets more than two parts at once.

From each bucket a spanning set of its links is kept (at most one per row),
then connected components over the fingerprints themselves give each document
the smallest id that its component holds.

Defined results: null text and texts without words have fingerprint zero and
link like any other; a document without id is neither a node nor a label of
others (its component is that of its fingerprint, null if nobody with an id
has it); repeated rows are copies; a very long text is one fingerprint like
any other; an empty table gives no rows. Columns are read by their exact
names, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import broadcast_if, connected_components, map_arrow, named, prepare, written

SEED = 42
SHINGLE = 3
RADIUS = 3
BUCKET_ROWS = 4096
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, [SEED] * n), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, fp long")


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks of the tables: every choice of ``agree`` of the ``radius + agree`` blocks of 64 bits."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def agree_for(n: int, radius: int, per_bucket: int = 64) -> int:
    """Blocks that a table's key takes so that about ``per_bucket`` spread fingerprints share it at most."""
    for agree in range(1, 9):
        if n >> (64 * agree // (radius + agree)) <= per_bucket or comb(radius + agree + 1, agree + 1) > 128:
            break
    return agree


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: row b holds bit b of every fingerprint."""
    n = len(fps)
    bits = np.zeros((64, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _shift(planes: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the result is lane i + d of ``planes`` (zero past the end)."""
    q, s = divmod(d, 64)
    out = np.zeros_like(planes)
    w = planes.shape[-1]
    if q < w:
        out[..., :w - q] = planes[..., q:] >> np.uint64(s)
        if s and q + 1 < w:
            out[..., :w - q - 1] |= planes[..., q + 1:] << np.uint64(64 - s)
    return out


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def within(planes: np.ndarray, other: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``live`` whose distance is at most ``radius``, as a bit vector.

    Counter bit j of every lane stands in counters[j]; a carry out of the top
    one means the lane has passed the radius for good.
    """
    width = radius.bit_length()
    counters = [np.zeros_like(live) for _ in range(width)]
    past = ~live
    diff = planes ^ other
    for b in range(64):
        carry = diff[b]
        for c in counters:
            c_next = c & carry
            c ^= carry
            carry = c_next
        past |= carry
        if b % 8 == 7 and not np.any(~past):
            return np.zeros_like(live)
    if radius + 1 < 1 << width:  # the counters hold up to 2**width - 1: drop lanes above the radius
        above = np.zeros_like(live)
        same = np.full_like(live, ~np.uint64(0))
        for j in reversed(range(width)):
            if radius >> j & 1:
                same &= counters[j]
            else:
                above |= same & counters[j]
                same &= ~counters[j]
        past |= above
    return ~past


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def links(fps: np.ndarray, unit: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning set of the pairs within ``radius`` among rows of the same unit (rows sorted by unit)."""
    n = len(fps)
    out: list[tuple[int, int]] = []
    if n < 2:
        return out
    forest = _Forest(n)
    planes = _planes(np.ascontiguousarray(fps, np.uint64))
    start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.concatenate((start, [n])))
    end = np.repeat(start + sizes, sizes)  # of each row's unit
    trees = n
    roots = np.arange(n)
    row = np.arange(n)
    for d in range(1, int(sizes.max())):
        live_rows = row + d < end
        if not live_rows.any() or trees == len(start):
            break
        pad = np.zeros(planes.shape[1] * 64, np.uint8)
        pad[:n] = live_rows
        live = np.packbits(pad, bitorder="little").view("<u8")
        near = _lanes(within(planes, _shift(planes, d), live, radius))
        if not len(near):
            continue
        fresh = near[roots[near] != roots[near + d]]
        joined = False
        for i in fresh.tolist():
            a, b = forest.find(i), forest.find(i + d)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                out.append((i, i + d))
                trees -= 1
                joined = True
        if joined:
            roots = np.fromiter(map(forest.find, range(n)), np.int64, n)
    return out


def near_pairs(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS,
               agree: int | None = None) -> DataFrame:
    """(a, b): links of ``nodes`` (id, fp; distinct fp) within ``radius``, a spanning set per bucket."""
    if agree is None:
        agree = agree_for(nodes.count(), radius)
    masks = block_masks(radius, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("id", "fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(signed)])).alias("b")).select("id", "fp", "b.t", "b.key")
    big = (keyed.groupBy("t", "key").count().filter(F.col("count") > bucket_rows)
           .select("t", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts"))
           .repartition(F.xxhash64("key", "t")))
    dealt = keyed.join(big, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", part).select(
        "id", "fp", "t", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mate"))
    dealt = (dealt.select("id", "fp", F.xxhash64("t", "key", F.least("part", "mate"),
                                                 F.greatest("part", "mate")).alias("unit"), "t", "key",
                          F.least("part", "mate").alias("p"), F.greatest("part", "mate").alias("q"))
             .repartition("unit").sortWithinPartitions("unit", "t", "key", "p", "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, fps, unit in unit_blocks(batches):
            found = links(fps, unit, radius)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def unit_blocks(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[tuple]:
    """Whole units in blocks: small ones side by side, one of over 64 rows on its own; lone rows left out."""
    held: list[np.ndarray] = []

    def split(rows: np.ndarray) -> Iterator[tuple]:
        key = rows[:, 2:]
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        sizes = np.diff(np.concatenate((start, [len(rows)])))
        unit = np.repeat(np.arange(len(start)), sizes)
        size = sizes[unit]
        for k in np.flatnonzero(sizes > 64):
            own = slice(start[k], start[k] + sizes[k])
            yield rows[own, 0], rows[own, 1].view(np.uint64), unit[own]
        small = np.flatnonzero((size > 1) & (size <= 64))
        cuts = np.searchsorted(unit[small], np.arange(0, len(start) + 1))
        at = 0
        while at < len(small):  # blocks end where a unit ends
            to = len(small) if at + most >= len(small) else cuts[unit[small[at + most]]]
            own = small[at:to]
            yield rows[own, 0], np.ascontiguousarray(rows[own, 1]).view(np.uint64), unit[own]
            at = to

    count = 0
    for b in batches:
        rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                for c in ("id", "fp", "unit", "t", "key", "p", "q")])
        if not len(rows):
            continue
        held.append(rows)
        count += len(rows)
        if count < 4 * most:
            continue
        rows = np.concatenate(held)
        last = rows[-1, 2:]
        whole = len(rows) - int(np.argmin((rows[::-1, 2:] == last).all(axis=1))) \
            if not (rows[:, 2:] == last).all() else 0
        yield from split(rows[:whole]) if whole else ()
        held, count = [rows[whole:]], len(rows) - whole
    if held:
        yield from split(np.concatenate(held))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, agree: int | None = None) -> DataFrame:
    """(id, fp, component): one row per document, component = smallest id of its connected component."""
    return _grouped(docs, id_col, text_col, shingle, radius, bucket_rows, agree).drop("root")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, agree: int | None = None) -> DataFrame:
    """(id, fp, root, component): root = smallest fingerprint of the component, which no other component shares."""
    docs_fp = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = written(docs_fp.filter(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("id")), "simhash")
    own = nodes.select(F.col("fp").alias("id"), "fp")  # an id may stand on rows of several fingerprints
    roots = connected_components(near_pairs(own, radius, bucket_rows, agree), "simhash")
    placed = written(nodes.join(roots, nodes["fp"] == roots["node"], "left")
                     .select("fp", "id", F.coalesce("root", "fp").alias("root")), "simhash")
    lowest = placed.groupBy("root").agg(F.min("id").alias("component"))
    classes = (placed.drop("id").join(lowest, "root").select("fp", "root", "component")
               .repartition(F.xxhash64("fp", F.lit(7))))  # its own deal, so a hot fingerprint's rows can be split
    return docs_fp.join(classes, "fp", "left").select("id", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **options) -> DataFrame:
    """``docs`` with one row of each group: the first by (id, fingerprint, text).

    Only rows whose id repeats are compared by fingerprint and text (then by
    all columns, so that the choice is fixed). Of rows without id whose text
    has words, one of each fingerprint stays, and none if a document with an id
    has it; wordless rows without id all stay, as none can stand for another.
    Copies are reduced in the tasks that read them, however many there are.
    Columns travel by position, so no name can clash.
    """
    names = docs.columns
    cols = [f"c{k}" for k in range(len(names))]
    docs = docs.select(*[named(c).alias(k) for c, k in zip(names, cols)])
    doc_id, text = cols[names.index(id_col)], cols[names.index(text_col)]
    found = written(_grouped(docs, doc_id, text, shingle, **options), "simhash").filter(F.col("id").isNotNull())
    repeated = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("id")
    keepers = found.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k")).select("k.id", "k.fp")
    once = keepers.join(repeated, "id", "left_anti").select("id").repartition(F.xxhash64("id"))
    key = F.col(doc_id).cast("long")
    kept = docs.join(once, key == once["id"], "left_semi")
    many = written(keepers.join(repeated, "id", "left_semi").select("id", "fp"), "simhash")
    n = many.count()
    if n:
        ids = broadcast_if(many.select("id").distinct(), n <= BROADCAST_ROWS)
        rows = _with_fingerprint(docs.join(ids, key == ids["id"], "inner"), text, shingle)
        rows = rows.join(broadcast_if(many, n <= BROADCAST_ROWS), ["id", "fp"], "left_semi")
        kept = kept.unionByName(_first_of(rows, ["id", "fp"], text, cols))
    nameless = docs.filter(F.col(doc_id).isNull())
    has_words = F.coalesce(F.col(text).cast("string").rlike(r"[^ \t-\r]"), F.lit(False))
    known = found.select("fp").distinct().repartition(F.xxhash64("fp"))
    others = _first_of(_with_fingerprint(nameless.filter(has_words), text, shingle), ["fp"], text, cols, "fp").join(known, "fp", "left_anti")
    out = kept.unionByName(nameless.filter(~has_words)).unionByName(others.select(*cols))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, cols)])


def _first_of(rows: DataFrame, by: list[str], text: str, cols: list[str], *more: str) -> DataFrame:
    """The first row by (text, all columns) of each group; an aggregate, so that tasks reduce their own copies first."""
    row = F.struct(*cols)
    return rows.groupBy(*by).agg(F.min_by(row, F.struct(F.col(text).cast("string"), F.to_json(row))).alias("row")).select(*more, "row.*")


def _with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with column fp."""

    def run(text):
        import pandas as pd

        got = [fingerprint(t.encode() if t else None, shingle) for t in text.tolist()]
        return pd.Series(np.array(got, np.uint64).view(np.int64))

    prepare(docs.sparkSession)
    return docs.withColumn("fp", F.pandas_udf(run, "long")(named(text_col).cast("string")))
