"""Cross-entropy difference of two n-gram models (target against background).

Both models are interpolated bigram models over one vocabulary, the words of
all documents. The background model counts every document, the target model
those marked as target. With c the counts, N the words counted, V the size of
the vocabulary,

    P1(w)    = (c(w) + 1) / (N + V)
    P(w | v) = (c(v w) + mu * P1(w)) / (c(v) + mu)

the score of a document is the mean over its words of the target's loss less
the background's (nats; lower is closer to the target). A word or a pair is
told from others by a 64-bit hash; nothing shares a bucket, is left out or
has a fixed table size, so the models grow with the corpus.

Documents are dealt into blocks of about ``block_bytes`` of text. A block
counts its distinct words and pairs once; its sorted hashes, cut by their
leading bits into at most FAN = 2 ** ``fan_bits`` pieces, go up a tree: the pieces of FAN
neighbouring blocks with the same leading bits meet in one group, which adds
them up, cuts them by the next bits and hands them on, until one group holds
a range of hashes from all blocks. What came up goes down again: each group
answers each piece with the totals of just what the piece holds, in its own
order, down to the blocks, where they meet the documents, which are scored.
With n blocks there are log n / log FAN levels of n groups each, so what is
sent grows with the corpus (times the levels); a group gets FAN pieces of a
FAN-th of a block, so none holds more than about a block; a frequent word is
one entry a piece. Levels between are written to the shared folder. Sums
over the hashes of a group come down with the answers. Nothing goes to the driver. The marks are joined on the document id:
broadcast when their counted number is under ``BROADCAST_ROWS``, else by
shuffle.

With ``leave_one_out`` each document is scored by models from which its own
counts are taken, so that documents of the target do not look closer to it
than others like them.

Words: A-Z become lower case, split at ASCII white space; the whole text
counts. Defined results: null and wordless texts have 0 words and a null
score and add nothing to the models; a very long text is one document of a
block that is so much larger; a document without id is never a target;
repeated rows count each; without target documents the target model is
uniform and scores stay defined; an empty table gives no rows. Id and text are
all that is read, so other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.llm.common import broadcast_if, named, prepare
from rankspark.session import scratch_path

BLOCK_BYTES = 16 << 20
FAN_BITS = 6
MU = 8.0
BROADCAST_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 / golden ratio, odd

#: A piece on its way up to the group (sup, prefix); it comes from the group (child, prefix without its last bits).
PIECES = "sup long, prefix long, child long, keys binary, background binary, target binary"
#: The answer on its way down to the group (sup, prefix), whose piece number ``part`` it is about.
TOTALS = "sup long, prefix long, part int, crc long, background binary, target binary, " \
         "vocabulary long, n_background long, n_target long"
SUMS = ["vocabulary", "n_background", "n_target"]
SCORES = "n_words long, target_loss double, background_loss double, score double"


class Block:
    """Words and pairs of some texts: distinct hashes in order, and where each word and pair stands in them."""

    def __init__(self, texts: list[bytes | None]):
        number: dict[bytes, int] = {}
        ids = []
        for text in texts:
            words = text.lower().split() if text else ()
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        words = np.concatenate([*ids, np.zeros(0, np.int64)])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        inside = np.ones(len(words), bool)  # words that follow another one of their text
        inside[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        self.second = np.flatnonzero(inside)
        pairs, pair = np.unique(words[self.second - 1] * max(1, len(number)) + words[self.second], return_inverse=True)
        first, last = np.divmod(pairs, max(1, len(number)))
        self.keys, at = np.unique(np.concatenate((hashes << np.uint64(1), _pair_keys(hashes[first], hashes[last]))),
                                  return_inverse=True)
        self.words = at[words]
        self.pairs = at[len(number):][pair]

    def counts(self, of: np.ndarray | None = None) -> np.ndarray:
        """How often each hash occurs, in all texts or those where ``of`` is true."""
        words, pairs = self.words, self.pairs
        if of is not None:
            mine = np.repeat(of, self.lengths)
            words, pairs = words[mine], pairs[mine[self.second]]
        return np.bincount(words, minlength=len(self.keys)) + np.bincount(pairs, minlength=len(self.keys))

    def mean_losses(self, totals: np.ndarray, n: int, vocabulary: int, mu: float, without: np.ndarray | None = None) -> np.ndarray:
        """Mean loss per word of each text (0 for wordless ones) under the model with these totals; where ``without`` is
        true, the text's own counts are taken out first."""
        if without is None:
            p = (totals[self.words] + 1) / (n + vocabulary)
            context = totals[self.words[self.second - 1]]
            p[self.second] = (totals[self.pairs] + mu * p[self.second]) / (context + mu)
            text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        else:
            text = np.repeat(np.arange(len(self.lengths)), self.lengths)
            out = without[text]
            words = totals[self.words] - self._own(text, self.words) * out
            pairs = totals[self.pairs] - self._own(text[self.second], self.pairs) * out[self.second]
            p = (words + 1) / (n - self.lengths[text] * out + vocabulary)
            p[self.second] = (pairs + mu * p[self.second]) / (words[self.second - 1] + mu)
        return np.bincount(text, -np.log(p), len(self.lengths)) / np.maximum(1, self.lengths)

    def _own(self, text: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each occurrence, how often its key occurs in its own text."""
        _, at, count = np.unique(text * np.int64(len(self.keys)) + keys, return_inverse=True, return_counts=True)
        return count[at]


def _pair_keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of pairs, told from those of words by the lowest bit."""
    x = first * _MIX + last
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return ((x ^ (x >> np.uint64(29))) << np.uint64(1)) | np.uint64(1)


def packed(values: np.ndarray) -> bytes:
    """Eight planes of bytes, lowest first: those of small numbers are zeros, which Spark's codecs shrink."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)


def marked(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, row, target) with target = 1 for documents whose id is in ``targets`` (one column)."""
    ids = targets.select(named(targets.columns[0]).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    small = ids.count() <= BROADCAST_ROWS
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    return rows.join(broadcast_if(ids, small), F.col("id") == F.col("__t"), "left") \
        .select("id", "text", "row", F.when(F.col("__t").isNotNull(), 1).otherwise(0).alias("target"))


def _block(rows: pa.Table) -> Block:
    return Block(rows.column("text").cast(pa.binary()).to_pylist())


def _pieces(keys: np.ndarray, counts: list[np.ndarray], sup: int, prefix: int, level: int, bits: int = FAN_BITS) -> pa.Table:
    """What the group (sup, prefix) of a level sends up: a row for each value of the next leading bits."""
    part = (keys >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
    cuts = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=np.uint64))
    has = np.arange(1 << bits)  # empty pieces too: their answers bring the sums of their hashes
    begins = cuts[:-1][np.diff(cuts) > 0]
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[begins] = keys[begins]  # a piece starts anew
    alike = [np.full(len(has), sup >> bits, np.int64), (prefix << bits) + has, np.full(len(has), sup, np.int64)]
    return pa.Table.from_arrays(
        [*map(pa.array, alike), *(pa.array([packed(c[cuts[k]:cuts[k + 1]]) for k in has], pa.binary()) for c in (steps, *counts))],
        names=[f.split(" ")[0] for f in PIECES.split(", ")])


def block_counts(blocks: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """The pieces of every block: distinct hashes with their counts, 2 ** bits rows each."""

    def run(rows: pa.Table) -> pa.Table:
        own = _block(rows)
        return _pieces(own.keys, [own.counts(), own.counts(rows.column("target").to_numpy() == 1)], rows.column("block")[0].as_py(), 0, 0, bits)

    return blocks.groupBy("block").applyInArrow(run, PIECES)


class _Group:
    """The pieces that met in a group: their distinct hashes, where each piece's stand in them, and the sums."""

    def __init__(self, rows: pa.Table):
        self.keys = [np.cumsum(unpacked(x)) for x in rows.column("keys").to_pylist()]
        self.cuts = np.cumsum([0, *map(len, self.keys)])
        self.distinct, self.at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.sums = [np.bincount(self.at, np.concatenate([unpacked(x) for x in rows.column(name).to_pylist()]),
                                 len(self.distinct)).astype(np.int64) for name in ("background", "target")]

    def answers(self, rows: pa.Table, totals: list[np.ndarray], bits: int = FAN_BITS) -> list[pa.Array]:
        """The columns of TOTALS but the sums: for every piece the totals of its hashes, to the group that it came from."""
        prefix = rows.column("prefix").to_numpy()
        each = [self.at[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        return [rows.column("child").combine_chunks(), pa.array(prefix >> bits),
                pa.array((prefix & (1 << bits) - 1).astype(np.int32)),
                pa.array([zlib.crc32(k.tobytes()) for k in self.keys], pa.int64()),
                *(pa.array([packed(t[at]) for at in each], pa.binary()) for t in totals)]


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def merged(pieces: DataFrame, level: int, bits: int = FAN_BITS) -> DataFrame:
    """The pieces of the next level: those that meet in a group added up and cut by the next bits."""

    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows)
        return _pieces(group.distinct, group.sums, rows.column("sup")[0].as_py(), rows.column("prefix")[0].as_py(), level, bits)

    return pieces.groupBy("sup", "prefix").applyInArrow(run, PIECES)


def range_totals(pieces: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """The answers to the last level's pieces, of which a group has all for its hashes, with the sums over these hashes."""

    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows)
        word = (group.distinct & np.uint64(1)) == 0
        sums = (word.sum(), *(s[word].sum() for s in group.sums))
        return pa.Table.from_arrays([*group.answers(rows, group.sums, bits), *_repeated(sums, rows)], names=_names(TOTALS))

    return pieces.groupBy("sup", "prefix").applyInArrow(run, TOTALS)


def _repeated(sums, rows: pa.Table) -> list[pa.Array]:
    return [pa.array(np.full(rows.num_rows, int(x), np.int64)) for x in sums]


def _sums(found: pa.Table) -> list[int]:
    """Vocabulary and words of both models over all pieces of a group: of its part of the hashes, for a block all."""
    return [sum(found.column(c).to_pylist()) for c in SUMS]


def handed_down(pieces: DataFrame, totals: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """The answers to a level's pieces from the answers that its groups got."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        group = _Group(rows)
        totals = _joined(found, group.distinct)
        return pa.Table.from_arrays([*group.answers(rows, totals, bits), *_repeated(_sums(found), rows)], names=_names(TOTALS))

    key = ["sup", "prefix"]
    return pieces.groupBy(*key).cogroup(totals.groupBy(*key)).applyInArrow(run, TOTALS)


def _joined(found: pa.Table, keys: np.ndarray) -> list[np.ndarray]:
    """Totals (background, target) of the sorted ``keys`` from the answers to their pieces."""
    found = found.sort_by("part")
    out = [np.concatenate([np.zeros(0, np.uint64), *map(unpacked, found.column(name).to_pylist())]) for name in ("background", "target")]
    cuts = np.cumsum([0, *(len(x) // 8 for x in found.column("target").to_pylist())])
    own = [zlib.crc32(keys[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    if len(out[0]) != len(keys) or own != found.column("crc").to_pylist():
        raise ValueError("the documents of a block differ from those it counted")
    return out


def _kept(pieces: DataFrame) -> DataFrame:
    """Written to the shared folder in small row groups, as its rows are large and are read a row group at a time."""
    path = scratch_path(pieces.sparkSession, "lm-pieces")
    pieces.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             mu: float = MU, block_bytes: int = BLOCK_BYTES, leave_one_out: bool = False, fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, target, n_words, target_loss, background_loss, score) per document."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(named(text_col).cast("string")) + 1).alias("n")).first()["n"] or 0
    n_blocks = int(1 + size // block_bytes)
    blocks = marked(docs, targets, id_col, text_col).select(
        "id", "text", "target", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    levels = [block_counts(blocks, fan_bits)]
    while n_blocks > 1 << fan_bits * len(levels):
        levels[-1] = _kept(levels[-1])  # needed again on the way down
        levels.append(merged(levels[-1], len(levels), fan_bits))
    totals = range_totals(levels[-1], fan_bits)
    for pieces in reversed(levels[:-1]):
        totals = handed_down(pieces, totals, fan_bits)
    schema = StructType([*blocks.select("id", "target").schema.fields, *StructType.fromDDL(SCORES).fields])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        own = _block(rows)
        has, target = own.lengths > 0, rows.column("target").to_numpy() == 1
        total = _joined(found, own.keys)
        vocabulary, *sizes = _sums(found)
        out = (np.ones(len(target), bool), target) if leave_one_out else (None, None)
        back, goal = (own.mean_losses(t.astype(np.int64), n, vocabulary, mu, x) for t, n, x in zip(total, sizes, out))
        return pa.Table.from_arrays(
            [rows.column("id"), rows.column("target"), pa.array(own.lengths),
             *(pa.array(x, pa.float64(), mask=~has) for x in (goal, back, goal - back))], names=schema.names)

    totals = totals.withColumn("block", F.col("sup").cast("int"))
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, schema)
