"""Byte-level BPE encoding and decoding by a rank file.

A text is split by the tokenizer's pattern; every match is encoded on its
own. A match that is a token as a whole is that token. Otherwise its bytes
start as single tokens and the leftmost of the adjacent pairs with the lowest
rank is merged until no pair has a rank.

A segment tree over the byte positions finds that pair: the leaf of a live
position holds (rank of the pair that starts there, position), a node the
lesser of its two children, so the root is the leftmost minimum. A merge
changes three leaves (the live neighbour before, the position itself and the
position that was taken in) and the nodes above them: O(log n) each, O(n log n)
for a match, whatever it is made of. Matches of up to ``SHORT`` bytes have
trees of few sizes and are advanced side by side as numpy arrays, one merge of
every match a step; a longer one has a tree of its own.

Distinct matches are encoded once per task, in a memory of at most
``MEMO_PIECES`` of them (then it starts anew). Nothing is shuffled; a task
holds one batch of texts and that memory.

Defined results: null and empty texts have no ids; a null list of ids decodes
to null, an id that the file lacks raises; ids and texts may repeat or be null;
very long texts and very long matches are encoded whole; an empty table gives
no rows. The columns named are read by their exact names, so other columns
(``ids``, ``bytes`` and names with dots too) don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from rankspark.llm.common import map_arrow, named

SHORT = 64
MEMO_PIECES = 400_000
#: Nodes of trees that are advanced side by side.
LOCKSTEP_NODES = 1 << 21
_POSITION_BITS = 32
_NONE = np.iinfo(np.int64).max


class Ranks:
    """A rank file (a base64 token and its rank on each line): tokens, and the rank of every pair of tokens that has one."""

    def __init__(self, definition: bytes):
        lines = (line.split() for line in definition.splitlines())
        self.of = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
        missing = [b for b in range(256) if bytes([b]) not in self.of]
        if missing:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.of.items():
            for cut in range(1, len(token)):
                a, b = self.of.get(token[:cut]), self.of.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self._keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(self._keys)
        self._keys = np.append(self._keys[order], _NONE)
        self._ranks = np.append(np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order], 0)
        self.tokens = [b""] * (1 + max(self.of.values()))
        for token, rank in self.of.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.known = np.zeros(len(self.tokens), bool)
        self.known[[*self.of.values()]] = True

    def leaves(self, first: np.ndarray, second: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of tokens at their positions."""
        key = first << 32 | second
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at] << _POSITION_BITS | position, _NONE)


@lru_cache(maxsize=4)
def ranks_of(definition: bytes) -> Ranks:
    return Ranks(definition)


def merge_one(data: bytes, ranks: Ranks) -> list[int]:
    """Token ids of one match, by a segment tree of its own."""
    n, pairs = len(data), ranks.pairs
    ids = ranks.byte[np.frombuffer(data, np.uint8)].tolist()
    size = 1 << max(0, (n - 2).bit_length())
    none = int(_NONE)
    tree = [none] * (2 * size)

    def leaf(i: int, j: int) -> int:
        rank = pairs.get(ids[i] << 32 | ids[j])
        return none if rank is None else rank << _POSITION_BITS | i

    for i in range(n - 1):
        tree[size + i] = leaf(i, i + 1)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:  # nothing above changes
                break
            tree[k] = low

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        rank, i = tree[1] >> _POSITION_BITS, tree[1] & (1 << _POSITION_BITS) - 1
        taken, prior = after[i], before[i]
        after[i] = following = after[taken]
        ids[i], ids[taken] = rank, -1
        if taken < n - 1:
            put(taken, none)
        if following < n:
            before[following] = i
            put(i, leaf(i, following))
        else:
            put(i, none)
        if prior >= 0:
            put(prior, leaf(prior, i))
    return [x for x in ids if x >= 0]


def merge_side_by_side(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all matches, number of ids of each) of matches of 2 bytes or more whose trees have one size."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    size = 1 << max(0, int(lengths.max() - 2).bit_length())
    width, count = size + 1, len(pieces)
    # One row for each match; cell ``width`` is the end, cell -1 (of the row before) never a live one.
    ids = np.full((count, width), -1, np.int64)
    inside = np.arange(width) < lengths[:, None]
    ids[inside] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((count, 2 * size), _NONE)
    row, col = np.nonzero(inside[:, 1:])
    tree[row, size + col] = ranks.leaves(ids[row, col], ids[row, col + 1], col)
    for low in (1 << k for k in reversed(range(size.bit_length() - 1))):
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    after = np.tile(np.arange(1, width + 1), (count, 1))
    before = np.tile(np.arange(-1, width), (count, 1))  # one cell more: the end's
    ids_, tree_, after_, before_ = (x.reshape(-1) for x in (ids, tree, after, before))
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        top = tree_[live * (2 * size) + 1]
        rank, i = top >> _POSITION_BITS, top & (1 << _POSITION_BITS) - 1
        cell = live * width
        taken = after_[cell + i]
        following = after_[cell + taken]
        prior = before_[live * (width + 1) + i]
        ids_[cell + i] = rank
        ids_[cell + taken] = -1
        after_[cell + i] = following
        ends, starts = following >= lengths[live], prior < 0
        before_[live * (width + 1) + following] = i
        own = np.where(ends, _NONE, ranks.leaves(rank, ids_[cell + np.where(ends, i, following)], i))
        left = np.where(starts, i, prior)  # where nothing stands before, the own leaf is put twice
        prior_leaf = np.where(starts, own, ranks.leaves(ids_[cell + left], rank, left))
        base = np.concatenate((live, live, live)) * (2 * size)
        node = np.concatenate((np.minimum(taken, size - 1), i, left)) + size
        value = np.concatenate((np.full(len(live), _NONE), own, prior_leaf))
        tree_[base + node] = value
        while node[0] > 1:  # all leaves stand at one depth
            node >>= 1
            child = base + 2 * node
            tree_[base + node] = np.minimum(tree_[child], tree_[child + 1])
        live = live[tree_[live * (2 * size) + 1] != _NONE]
    kept = ids >= 0
    return ids[kept], kept.sum(axis=1)


class Encoder:
    """Ids of texts; remembers the matches that it has encoded."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes, self.starts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.number) > MEMO_PIECES:
            self._forget()
        number, at = self.number, []
        for text in texts:
            pieces = self.split(text) if text else ()
            for p in {*pieces}:
                if p not in number:
                    number[p] = len(number)
            at.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
        self._learn([p.encode() for p in list(number)[len(self.sizes):]])
        ends = np.cumsum([0, *map(len, at)])
        at = np.concatenate([*at, np.zeros(0, np.int32)])
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], sizes)
        return self.pool[where], np.diff(total[ends])

    def _learn(self, pieces: list[bytes]) -> None:
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        pool, filled = [self.pool], len(self.pool)
        alone, by_size = [], {}
        for k, p in enumerate(pieces):
            if p in self.ranks.of or len(p) > SHORT:
                alone.append(k)
            else:
                by_size.setdefault((len(p) - 2).bit_length(), []).append(k)

        def add(part: list[int], ids: np.ndarray, each: np.ndarray) -> None:
            nonlocal filled
            sizes[part] = each
            starts[part] = filled + np.cumsum(each) - each
            pool.append(ids.astype(np.int32))
            filled += len(ids)

        for bits, own in by_size.items():
            step = max(1, LOCKSTEP_NODES >> bits + 1)
            for part in (own[k:k + step] for k in range(0, len(own), step)):
                add(part, *merge_side_by_side([pieces[k] for k in part], self.ranks))
        if alone:
            found = [[rank] if (rank := self.ranks.of.get(pieces[k])) is not None else merge_one(pieces[k], self.ranks)
                     for k in alone]
            add(alone, np.array([x for ids in found for x in ids], np.int64), np.fromiter(map(len, found), np.int64, len(found)))
        self.sizes, self.starts = np.concatenate((self.sizes, sizes)), np.concatenate((self.starts, starts))
        self.pool = np.concatenate(pool)


def encode(docs: DataFrame, definition: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the token ids of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, pattern))
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["id"], StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, split = shared.value
        encoder = Encoder(ranks_of(file), split)
        for b in batches:
            ids, sizes = encoder.encode(b.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "ids"])

    return map_arrow(rows, run, schema)


def decoded(ids: np.ndarray, sizes: np.ndarray, ranks: Ranks) -> list[bytes]:
    """The bytes that each list of ids stands for."""
    if len(ids) and not (0 <= ids.min() and ids.max() < len(ranks.tokens) and ranks.known[ids].all()):
        raise ValueError("an id that the rank file lacks")
    data = b"".join(map(ranks.tokens.__getitem__, ids.tolist()))
    ends = np.concatenate(([0], np.cumsum(ranks.sizes[ids])))[np.concatenate(([0], np.cumsum(sizes)))]
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def decode(frame: DataFrame, definition: bytes, keep: list[Column], ids_col: str = "ids") -> DataFrame:
    """``keep`` and ``bytes``: what the ids of each row stand for."""
    shared = frame.sparkSession.sparkContext.broadcast(definition)
    names = frame.select(*keep).schema
    # Positions in place of names, so that no name can clash on the way.
    rows = frame.select(named(ids_col).cast("array<int>").alias("ids"), *[c.alias(f"c{k}") for k, c in enumerate(keep)])
    schema = StructType([*rows.schema.fields[1:], StructField("bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(shared.value)
        for b in batches:
            lists = b.column(0)
            if lists.flatten().null_count:
                raise ValueError("a null among the ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = decoded(lists.flatten().to_numpy(zero_copy_only=False), sizes, ranks)
            none = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.binary(), mask=none)], names=schema.names)

    out = map_arrow(rows, run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(names.fields)], "bytes")
