"""Inverted index as DataFrames.

Layout
  postings (field, term, doc_id, tf, dl)   one row per (doc, field, term)
  doclen   (doc_id, field, dl)             one row per (doc, field)
  lexicon  (field, term, df, cf)           one row per (field, term)
  stats    (field, n_docs, n_with_field, total_len)

``dl`` is carried on every posting so scoring never joins the document
table. Postings come straight out of the tokenized row (in-row term counts),
so an in-session index needs no shuffle for postings or lengths; only the
lexicon is a (partially pre-aggregated) ``groupBy``.

A stored index is a list of segments, each written once and never changed:

  forward   (doc_id, field, dl, n_terms, block, words, sizes, tfs)  the direct index, by document (E9; optional): a
                                                            row's terms one after the other, their lengths, their tf
  doclen    (doc_id, field, dl)                             only where there is no forward table
  postings  (field, term, block, n, cf, tf and dl from .. to, bounds, docs, tfs, dls)  files by range of (field,
                                                            term, block); a term's postings in a stretch of blocks
                                                            as numbers (documents as steps, like bytes
                                                            together), beside what they can
                                                            contribute, in all and (bounds) in each block
  lexicon   (field, term, df, cf, tf and dl from .. to)     files by range of (field, term)
  files     (kind, file, first, last, rows)                 sparse dictionary: the range of each file

The text is tokenized once, for the forward table; the others come from it.
``read("postings")`` gives a row for each posting, ``read("blocks")`` one for each
block of a term, from the bounds alone. A
search reads only the files that can hold its terms. A batch of documents is a
new segment, statistics are summed when read, and segments of like size are
put together as they gather (E10). Versions, which are lists of segments with
the collection statistics, are published by compare-and-set (B6).

Field modes: every listed field is indexed on its own (field-max search) and,
when there are several fields, a whole-document field ``_doc`` holds the
concatenated tokens (document search).
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from dataclasses import dataclass, field as dc_field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.functions.analysis import DEFAULT, Analyzer, s_stem, spaced
from rankspark.operators import versions
from rankspark.operators.clustered import MAX_KEYS, file_ranges, files_for, files_holding, write_clustered
from rankspark.session import map_arrow, materialize, scratch_path, shuffles_dropped

DOC_FIELD = "_doc"
#: A block is 2 ** BLOCK_BITS consecutive rows of the forward table.
BLOCK_BITS = 10
#: Postings of a part of a file; a task gathers twice as many before it puts them together by term.
PACK_ROWS = 1_000_000
#: Sampled postings for each file, to cut the terms' ranges by.
SAMPLE = 1_000
#: Postings of a stored row, beyond which a term's next block begins another one.
ROW_POSTINGS = 16_384
#: Stretches of blocks that bounds are looked at for, and blocks (as a power of 2) that a task scores together.
STRETCHES = 2048
UNIT_BITS = 4
#: Postings that a task of a search reads.
TASK_POSTINGS = 4_000_000
#: Postings of stored rows that are made from bytes, or into bytes, at once.
PORTION = 200_000
#: Segments of one size (powers of FAN postings) that are put together.
FAN = 4
#: Times that a publisher starts again from a newer version.
RETRIES = 20
_POSTING = ["field", "term", "doc_id", "tf", "dl"]
_LENGTH = ["doc_id", "field", "dl"]
_LEXICON = ["field", "term", "df", "cf"]
_STATS = ["field", "n_docs", "n_with_field", "total_len"]
_EXTENT = "min_tf int, max_tf int, min_dl int, max_dl int"
_SCHEMAS = {
    "postings": f"field string, term string, block long, n long, cf long, {_EXTENT}, bounds binary, docs binary, tfs binary, dls binary",
    "blocks": f"field string, term string, block long, n long, cf long, {_EXTENT}",
    "lexicon": f"field string, term string, df long, cf long, {_EXTENT}",
    "forward": "doc_id long, field string, dl int, n_terms int, block long, words binary, sizes binary, tfs binary",
    "doclen": "doc_id long, field string, dl int",
    "files": "kind string, file string, first struct<field:string,term:string>, last struct<field:string,term:string>, rows long",
}
#: Tables that are columns of another one.
_TABLE = {"blocks": "postings", "stored": "postings"}
_CODED = "doc_id long, field string, dl int, n_terms int, words binary, sizes binary, tfs binary"
_COUNTED = "doc_id long, field string, dl int, entries array<struct<term:string,tf:int>>"
_PIECES = "pid int, part int, pieces binary"
_PLAIN = "field string, term string, block long, doc_id long, tf int, dl int"
_PIECE = pa.schema([("key", pa.string()), ("block", pa.int64()), ("postings", pa.binary())])
#: A bundle's pieces: the bytes of a piece's postings, and in its first row those of all, by their place in a posting.
_BUNDLE = pa.schema([("key", pa.string()), ("block", pa.int64()), ("size", pa.int32()), ("postings", pa.binary())])
#: Steps from document to document, blocks after the piece's first one, tf (negative: the document's id is null), dl.
_POSTING_BYTES = np.dtype([("doc", "<i8"), ("block", "<i4"), ("tf", "<i4"), ("dl", "<i4")])
#: A block of a stored row that has several.
_BOUNDS = np.dtype([("block", "<i8"), ("n", "<i4"), ("cf", "<i8"), *[(c, "<i4") for c in ("min_tf", "max_tf", "min_dl", "max_dl")]])


@dataclass
class Index:
    postings: DataFrame
    doclen: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    fields: tuple
    doc_field: str
    analyzer: Analyzer = DEFAULT
    path: str | None = None
    version: int = 0
    segments: tuple = ()  # manifest entries of a stored index
    coded: DataFrame | None = dc_field(default=None, repr=False)  # the direct index's rows as stored
    unstemmed: Index | None = dc_field(default=None, repr=False)  # what ``stemmed_index`` was made of
    _ranges: dict = dc_field(default_factory=dict, repr=False)

    @property
    def tokenized(self) -> DataFrame | None:
        """(doc_id, field, dl, entries) of the direct index."""
        return None if self.coded is None else _decoded(self.coded)

    @property
    def forward(self) -> DataFrame | None:
        if self.tokenized is None:
            return None
        # Filter on dl, never on entries: a predicate on entries would be pushed
        # below the projections and re-run the counting lambdas per element.
        return self.tokenized.filter(F.col("dl") > 0).select("doc_id", "field", "entries")

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def files_with(self, kind: str, fields: list[str], terms: list[str] | None) -> list[str]:
        """Paths of the files of postings, blocks or lexicon that can hold one of ``terms`` (None: any) in ``fields``.

        The sparse dictionary has a row for each file, as many as Spark's own file listing.
        """
        keys = None if terms is None or len(terms) * len(fields) > MAX_KEYS else sorted((f, t) for f in fields for t in terms)
        out = []
        for s in self.segments:
            base = f"{self.path}/segments/{s['id']}"
            if s["id"] not in self._ranges:
                rows = self.spark.read.schema(_SCHEMAS["files"]).parquet(f"{base}/files").collect()
                self._ranges[s["id"]] = [(r["kind"], (r["file"], tuple(r["first"]), tuple(r["last"]))) for r in rows]
            own = [r for k, r in self._ranges[s["id"]] if k == _TABLE.get(kind, kind)]
            found = files_holding(own, keys) if keys is not None else [
                f for f, first, last in own if any(first[0] <= x <= last[0] for x in fields)]
            out += [f"{base}/{_TABLE.get(kind, kind)}/{f}" for f in found]
        return out

    def read(self, kind: str, fields: list[str], terms: list[str] | None = None) -> DataFrame:
        """Rows of postings, blocks or lexicon (stored: postings as they are stored) of ``fields``, from the files that can hold ``terms`` alone.

        Rows of other terms that share these files come too; the lexicon has a row for each segment.
        """
        schema, files = _SCHEMAS[_TABLE.get(kind, kind)], self.files_with(kind, fields, terms)
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        rows = rows.filter(F.col("field").isin(fields))
        return _entries(rows) if kind == "postings" else _bounds(rows) if kind == "blocks" else rows

    def postings_of(self, fields: list[str], terms: list[str] | None = None) -> DataFrame:
        """Postings of ``fields``; of a stored index only the files that can hold ``terms``."""
        if self.segments:
            return self.read("postings", fields, terms)
        return self.postings.filter(F.col("field").isin(fields))

    def lexicon_of(self, fields: list[str], terms: DataFrame, known: list[str] | None = None) -> DataFrame:
        """(field, term, df, cf) of the terms of ``terms`` (column term) in ``fields``; ``known``: the same as a list."""
        if known is not None and _by_stem(self, fields):
            return _stemmed_lexicon(self, fields[0], known)
        rows = self.read("lexicon", fields, known) if self.segments else self.lexicon.filter(F.col("field").isin(fields))
        rows = rows.select(*_LEXICON).join(terms, "term", "left_semi")
        if len(self.segments) > 1:
            rows = rows.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return rows


def token_rows(docs: DataFrame, fields, id_col: str = "doc_id",
               analyzer: Analyzer = DEFAULT, doc_field: str | None = DOC_FIELD) -> DataFrame:
    """(doc_id, field, tokens): one row per field, and one for the whole document.

    The first generator makes Spark tokenize each field once, though its
    tokens are used twice (its own row and the whole document's).
    """
    fields = tuple(fields)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.inline(F.array(F.struct(*[
        analyzer.tokens(F.col(f)).alias(f"_t{k}") for k, f in enumerate(fields)]))))
    items = [F.struct(F.lit(f).alias("field"), F.col(f"_t{k}").alias("tokens")) for k, f in enumerate(fields)]
    if doc_field and len(fields) > 1:
        items.append(F.struct(F.lit(doc_field).alias("field"),
                              F.concat(*[F.col(f"_t{k}") for k in range(len(fields))]).alias("tokens")))
    return rows.select("doc_id", F.inline(F.array(*items)))


def coded_rows(docs: DataFrame, fields: tuple, id_col: str, analyzer: Analyzer, doc_field: str | None) -> DataFrame:
    """The rows of ``token_rows`` with their terms counted, in term order, as stored.

    The tokens of a batch of documents are numbered in term order and sorted
    as numbers (row, term), so nothing is shuffled and no string is compared
    but once a batch.
    """
    whole = doc_field if len(fields) > 1 else None
    words = spaced if analyzer.plain else analyzer.tokens  # plain words are cut apart in Arrow
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[words(F.col(f)).alias(f"_t{k}") for k, f in enumerate(fields)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _counted(batch, fields, whole)

    return map_arrow(rows, run, _CODED)


def _ranked(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in order (of their bytes, as Spark's), and each one's number."""
    coded = strings.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _words(column: pa.Array) -> pa.Array:
    """Lists of words, from these or from words with a space between them."""
    if not pa.types.is_string(column.type):
        return column
    text = pc.ascii_trim(column, " ")
    return pc.split_pattern(pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text), " ")


def _counted(batch: pa.RecordBatch, fields: tuple, whole: str | None) -> pa.RecordBatch:
    n, names = batch.num_rows, [*fields, *([whole] if whole else [])]
    lists = [_words(batch.column(1 + k)) for k in range(len(fields))]
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists]
    terms, rank = _ranked(pa.concat_arrays([x.flatten() for x in lists]))
    row = np.concatenate([np.repeat(np.arange(n) * len(names) + k, x) for k, x in enumerate(lengths)])
    size = max(1, len(terms))
    keys = row * size + rank
    if whole:
        keys = np.concatenate([keys, (row // len(names) * len(names) + len(fields)) * size + rank])
        lengths.append(sum(lengths))
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    row, rank = np.divmod(keys[starts], size)
    found = terms.take(pa.array(rank))
    offsets = np.searchsorted(row, np.arange(n * len(names) + 1))
    _, at, data = found.buffers()
    at = np.frombuffer(at, np.int32)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    words = pa.Array.from_buffers(pa.binary(), n * len(names), [None, pa.py_buffer(at[offsets].tobytes()), data])
    n_terms = np.diff(offsets)
    return pa.RecordBatch.from_arrays([
        batch.column(0).take(pa.array(np.repeat(np.arange(n), len(names)))),
        pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), n))),
        pa.array(np.stack(lengths, axis=1).ravel().astype(np.int32)), pa.array(n_terms.astype(np.int32)), words, _as_bytes(np.diff(at), n_terms),
        _as_bytes(np.diff([*starts, len(keys)]).astype(np.int32), n_terms)],
        ["doc_id", "field", "dl", "n_terms", "words", "sizes", "tfs"])


def _listed(batch: pa.RecordBatch) -> pa.ListArray:
    """The entries (term, tf) of coded rows."""
    sizes, tf = (_numbers(batch.column(c), "<i4") for c in ("sizes", "tfs"))
    words = batch.column("words")
    _, ends, data = words.buffers()
    first = np.frombuffer(ends, np.int32)[words.offset] if len(words) else 0
    at = (first + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at.tobytes()), data]) if len(sizes) else pa.array([], pa.string())
    n = pc.binary_length(batch.column("tfs")).to_numpy() // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([terms, pa.array(tf)], ["term", "tf"]))


def _entered(batches, names: list[str]):
    """Batches of coded rows: the columns ``names``, and their entries."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _listed(batch)], [*names, "entries"])


def _decoded(coded: DataFrame) -> DataFrame:
    names = ["doc_id", "field", "dl"]
    return map_arrow(coded.select(*names, "words", "sizes", "tfs"), lambda batches: _entered(batches, names), _COUNTED)


def _postings(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("field", F.inline("entries"), "doc_id", "dl").select(*_POSTING)


def _entries(stored: DataFrame) -> DataFrame:
    """A row for each posting of the stored rows."""
    def run(batches):
        for batch in _portioned(batches):
            at, block, n = _blocks_in(batch)
            of = np.repeat(at, n)
            docs, tf, dl = _stored_numbers(batch)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(of)) for c in ("field", "term")], pa.array(np.repeat(block, n)),
                pa.array(docs, mask=tf < 0), pa.array(np.abs(tf)), pa.array(dl)], ["field", "term", "block", "doc_id", "tf", "dl"])

    return map_arrow(stored.select("field", "term", "block", "n", "bounds", "docs", "tfs", "dls"), run, _PLAIN)


def _bounds(stored: DataFrame) -> DataFrame:
    """A row for each block of the stored rows."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, block, n = _blocks_in(batch)
                out = {c: batch.column(c).take(pa.array(at)) for c in ("field", "term")} | {"block": block, "n": n}
                yield from pa.table(out | _extents_in(batch, at)).to_batches()

    return map_arrow(stored.drop("docs", "tfs", "dls"), run, _SCHEMAS["blocks"])


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The numbers in the bytes of ``column``, one row's after the other's."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    kind = np.dtype(kind)
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0]) if data is not None else np.zeros(0, kind)


def _blocks_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block in the stored rows: its row, its number and how many postings it has."""
    sizes = pc.binary_length(batch.column("bounds")).to_numpy() // _BOUNDS.itemsize
    at = np.repeat(np.arange(batch.num_rows), np.maximum(sizes, 1))
    block, n = batch.column("block").to_numpy()[at], batch.column("n").to_numpy()[at]
    many, own = sizes[at] > 0, _numbers(batch.column("bounds"), np.uint8)
    block[many] = _sums(_column_of(own, sizes, "block"), sizes)
    n[many] = _column_of(own, sizes, "n")
    return at, block, n


def _extents_in(batch: pa.RecordBatch, at: np.ndarray) -> dict:
    """cf and extents of each block in the stored rows; ``at``: the blocks' rows."""
    sizes = pc.binary_length(batch.column("bounds")).to_numpy() // _BOUNDS.itemsize
    many, own = sizes[at] > 0, _numbers(batch.column("bounds"), np.uint8)
    found = {c: _column_of(own, sizes, c) for c in ("n", "cf", "min_tf", "max_tf", "min_dl", "max_dl")}
    found["cf"] += found.pop("n").astype(np.int64) * found["min_tf"]
    for c in ("tf", "dl"):
        found[f"max_{c}"] += found[f"min_{c}"]
    out = {c: batch.column(c).to_numpy()[at] for c in found}
    for c, values in found.items():
        out[c][many] = values
    return out


def _column_of(woven: np.ndarray, sizes: np.ndarray, name: str) -> np.ndarray:
    """One number of each block from the bytes of ``_woven_bounds``."""
    kind, first = _BOUNDS.fields[name]
    starts, n = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    at = starts * _BOUNDS.itemsize + np.arange(len(n)) - starts + first * n
    out = np.empty((len(n), kind.itemsize), np.uint8)
    for i in range(kind.itemsize):
        out[:, i] = woven[at + i * n]
    return out.view(kind).ravel()


def _woven_bounds(bounds: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """So many blocks a row: steps from block to block, what is over the least possible, and like bytes beside each other."""
    bounds["cf"] -= bounds["n"].astype(np.int64) * bounds["min_tf"]
    for c in ("tf", "dl"):
        bounds[f"max_{c}"] -= bounds[f"min_{c}"]
    bounds["block"] = _steps(bounds["block"], (np.cumsum(sizes) - sizes)[sizes > 0])
    starts, n = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    at, plain = starts * _BOUNDS.itemsize + np.arange(len(n)) - starts, bounds.view(np.uint8).reshape(len(n), _BOUNDS.itemsize)
    out = np.empty(plain.size, np.uint8)
    for i in range(_BOUNDS.itemsize):
        out[at + i * n] = plain[:, i]
    return _as_bytes(out, sizes * _BOUNDS.itemsize)


def _stored_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, tf (negative: the document's id is null) and dl of the postings in rows with ``n`` of them."""
    n = batch.column("n").to_numpy()
    return _sums(_unplaned(batch.column("docs"), n), n), _unplaned(batch.column("tfs"), n).astype(np.int32), _unplaned(batch.column("dls"), n).astype(np.int32)


def _portions(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Rows from .. to that have about PORTION postings together."""
    at = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PORTION, prepend=-1))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(sizes)]))


def _portioned(batches):
    """Batches of stored rows (with ``n``) cut into portions, as their bytes are few for what they hold."""
    for batch in batches:
        if batch.num_rows:
            for lo, hi in _portions(batch.column("n").to_numpy()):
                yield batch.slice(lo, hi - lo)


def _planed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """So many whole numbers a row: their lowest bytes, the next ones ..., no more than the row's largest number needs."""
    sizes = np.asarray(sizes, np.int64)
    parts, at = [], 0
    for lo, hi in _portions(sizes):
        end = at + int(sizes[lo:hi].sum())
        parts.append(_planes(values[at:end], sizes[lo:hi]))
        at = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _planes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    values = values.astype(np.int64)
    values = ((values << 1) ^ (values >> 63)).view(np.uint64)  # the sign is the lowest bit
    width = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    largest = np.bitwise_or.reduceat(values, (np.cumsum(sizes) - sizes)[some]) if len(some) else values[:0]
    width[some] = 1
    for i in range(1, 8):
        width[some] += largest >> np.uint64(8 * i) != 0
    ends = np.cumsum(sizes * width)
    n, wide = np.repeat(sizes, sizes), np.repeat(width, sizes)
    at = np.repeat(ends - sizes * width - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        if (width[some] > i).all():
            out[at + i * n] = values >> np.uint64(8 * i) & np.uint64(255)
        else:
            own = np.flatnonzero(wide > i)
            out[at[own] + i * n[own]] = values[own] >> np.uint64(8 * i) & np.uint64(255)
    return _as_bytes(out, sizes * width)


def _unplaned(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``_planed``."""
    raw, lengths = _numbers(column, np.uint8), pc.binary_length(column).to_numpy().astype(np.int64)
    width = lengths // np.maximum(sizes, 1)
    n, wide = np.repeat(sizes, sizes), np.repeat(width, sizes)
    at = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(n))
    values = np.zeros(len(n), np.uint64)
    for i in range(int(width.max(initial=0))):
        own = np.flatnonzero(wide > i)
        if len(own) == len(wide):
            values |= raw[at + i * n].astype(np.uint64) << np.uint64(8 * i)
        else:
            values[own] |= raw[at[own] + i * n[own]].astype(np.uint64) << np.uint64(8 * i)
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def stretch_bounds(stored: DataFrame, shift: int) -> DataFrame:
    """(key, stretch, rows, tf and dl from .. to) of stored rows, for every 2 ** ``shift`` blocks; one may come in several rows."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, block, n = _blocks_in(batch)
                own, stretch = _extents_in(batch, at), block >> shift
                starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (stretch[1:] != stretch[:-1])]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(at[starts])), pa.array(stretch[starts]), pa.array(np.add.reduceat(n, starts)),
                    *[pa.array((np.minimum if c.startswith("min") else np.maximum).reduceat(own[c], starts)) for c in ("min_tf", "max_tf", "min_dl", "max_dl")]],
                    ["key", "stretch", "rows", "min_tf", "max_tf", "min_dl", "max_dl"])

    return map_arrow(stored.drop("docs", "tfs", "dls"), run, f"key long, stretch long, rows long, {_EXTENT}")


def stretch_postings(stored: DataFrame, shift: int, finer: int, stretches: np.ndarray | None, postings: int) -> DataFrame:
    """(unit, key, doc_id, tf, dl): the postings in ``stretches`` (None: all), dealt out and sorted by unit.

    A unit is 2 ** ``finer`` blocks, ``postings`` about how many there are. What is shuffled is a row for a term's postings in a unit, not one for each posting.
    """
    sc = stored.sparkSession.sparkContext
    wanted, tasks = sc.broadcast(stretches), max(sc.defaultParallelism, -(-postings // TASK_POSTINGS))

    def split(batches):
        for batch in _portioned(batches):
            at, block, n = _blocks_in(batch)
            unit = block >> finer
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (unit[1:] != unit[:-1])]))
            n, unit, at = np.add.reduceat(n, starts), unit[starts], at[starts]
            kept = np.isin(unit >> (shift - finer), wanted.value) if wanted.value is not None else np.ones(len(unit), bool)
            if not kept.any():
                continue
            own, (docs, tf, dl) = np.repeat(kept, n), _stored_numbers(batch)
            n, docs = n[kept], docs[own]
            first = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(unit[kept]), batch.column("key").take(pa.array(at[kept])), pa.array(n),
                                              _planed(_steps(docs, first), n), _planed(tf[own], n), _planed(dl[own], n)],
                                             ["unit", "key", "n", "docs", "tfs", "dls"])

    def plain(batches):
        for batch in _portioned(batches):
            docs, tf, dl = _stored_numbers(batch)
            at = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(at), batch.column("key").take(at), pa.array(docs), pa.array(np.abs(tf)), pa.array(dl)],
                                             ["unit", "key", "doc_id", "tf", "dl"])

    pieces = map_arrow(stored.select("key", "block", "n", "bounds", "docs", "tfs", "dls"), split, "unit long, key long, n long, docs binary, tfs binary, dls binary")
    return map_arrow(pieces.repartition(tasks, "unit").sortWithinPartitions("unit"), plain, "unit long, key long, doc_id long, tf int, dl int")


def stretch_bits(index: Index) -> int:
    """Blocks of a stretch, as a power of 2."""
    rows = index.stats.agg(F.sum("n_docs")).first()[0] or 0
    return max(0, (int(rows) >> BLOCK_BITS) // STRETCHES).bit_length()


def runs_of(batches):
    """The columns of all rows of each value of the first column, from rows in its order."""
    kept = []

    def whole():
        rows = pa.Table.from_batches(kept).combine_chunks()
        return [rows.column(i) for i in range(rows.num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *starts], [*starts, len(at)]):
            if kept and kept[0].column(0)[0].as_py() != at[lo]:
                yield whole()
                kept = []
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield whole()


def repeated_ids(index: Index, field: str) -> bool:
    """Whether a document's id repeats or is null in a stored index."""
    if ("repeated", field) not in index._ranges:
        ids = index.doclen.filter(F.col("field") == field).groupBy("doc_id").count()
        index._ranges["repeated", field] = ids.filter((F.col("count") > 1) | F.col("doc_id").isNull()).first() is not None
    return index._ranges["repeated", field]


def postings_by_document(index: Index, fields: list[str], terms: pa.Array | None = None, numbered: bool = False) -> tuple[DataFrame, bool]:
    """Postings of ``fields``, and whether each document's rows of a field come together, in one task.

    Where there is a direct index, those of ``terms`` (few; None: all) alone; ``numbered``: with a number ``key``, the
    term's place in ``terms`` times the fields plus the field's place, instead of the two strings.

    They do in a stored direct index, unless an id repeats or is null: whoever
    needs whole documents then has to group them.
    """
    if numbered and terms is not None and _by_stem(index, fields):
        places = {t: i for i, t in enumerate(terms.to_pylist())}
        return _stemmed_postings(index, fields[0], places), True
    if index.coded is None:
        return index.postings.filter(F.col("field").isin(fields)).select(*_POSTING), False
    asked = index.spark.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            entries = _listed(batch).flatten()
            at = np.arange(len(entries))
            if asked.value is not None:
                place = pc.fill_null(pc.index_in(entries.field("term"), asked.value), -1).to_numpy()
                at = np.flatnonzero(place >= 0)
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n_terms").to_numpy())[at])
            if numbered:
                field = pc.index_in(batch.column("field"), pa.array(fields, pa.string())).to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array(place[at].astype(np.int64) * len(fields) + field[row.to_numpy()]), batch.column("doc_id").take(row),
                    entries.field("tf").take(pa.array(at)), batch.column("dl").take(row)], ["key", "doc_id", "tf", "dl"])
                continue
            found = entries.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column("field").take(row), found.field("term"), batch.column("doc_id").take(row),
                                              found.field("tf"), batch.column("dl").take(row)], _POSTING)

    rows = map_arrow(index.coded.filter(F.col("field").isin(fields)).select("doc_id", "field", "dl", "n_terms", "words", "sizes", "tfs"), run,
                     "key long, doc_id long, tf int, dl int" if numbered else "field string, term string, doc_id long, tf int, dl int")
    if not index.segments:
        return rows, False
    return rows, not repeated_ids(index, fields[0])


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf) (E3): map-side partial aggregation, then shuffle."""
    return postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def stats_of(doclen: DataFrame) -> DataFrame:
    """Per-field collection statistics (E4), one small row per field."""
    return doclen.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(F.col("dl") > 0, 1)).alias("n_with_field"),
        F.sum("dl").alias("total_len"))


def build_index(docs: DataFrame, fields=("text",), id_col: str = "doc_id",
                analyzer: Analyzer = DEFAULT, doc_field: str | None = DOC_FIELD) -> Index:
    """Lazy in-session index over a wide frame (id + one text column per field)."""
    fields = tuple(fields)
    rows = token_rows(docs, fields, id_col, analyzer, doc_field)
    coded = coded_rows(docs, fields, id_col, analyzer, doc_field)
    postings = _postings(_decoded(coded))
    doclen = rows.select("doc_id", "field", F.size("tokens").cast("int").alias("dl"))
    effective_doc_field = doc_field if (doc_field and len(fields) > 1) else fields[0]
    return Index(postings, doclen, lexicon_of(postings), stats_of(doclen), fields,
                 effective_doc_field, analyzer, coded=coded)


def _write_postings(rows: DataFrame, fields: list[str], path: str, files: int, count: int) -> None:
    """Files by range of (field, term, block), sorted by these, from forward rows.

    A task puts the postings of some blocks together by term, and these pieces
    by ranges of terms (parts of a file with about PACK_ROWS postings), so that
    the shuffle carries a row for a part and some blocks, neither one for each
    posting nor for each term. Field and term are one string there (a character
    for the field, in the fields' order), the postings fixed numbers of bytes.
    A sample of the postings says where the parts end. A file's parts come in
    order, each is sorted as arrays.
    """
    names = ["doc_id", "field", "dl", "block"]
    rows = rows.select(*names, "words", "sizes", "tfs")
    per = max(1, -(-count // (files * PACK_ROWS)))
    cuts = _cuts(rows, fields, files, count, per)
    pieces = map_arrow(rows, lambda batches: _bundles(_pieces(_entered(batches, names), fields, cuts), per), _PIECES)
    map_arrow(pieces.repartitionById(files, F.col("pid")).sortWithinPartitions("part").select("part", "pieces"),
              lambda batches: _by_term(_block_extents(_unpacked(p, fields) for p in _parts(batches))), _SCHEMAS["postings"]).write.parquet(path, compression="zstd")


def _cuts(rows: DataFrame, fields: list[str], files: int, count: int, per: int = 1) -> list[tuple[str, int]]:
    """(key, block) at which the 2nd, 3rd ... part starts, ``per`` a file, by a sample of SAMPLE postings for each file."""
    if files * per == 1:
        return []
    share = min(1.0, SAMPLE * files / max(1, count))
    near = min(1.0, 16 * share)  # of the rows first, then of what they hold
    some = rows.sample(near, 1) if near < 1 else rows
    some = map_arrow(some, lambda batches: _entered(batches, ["field", "block"]), "field string, block long, entries array<struct<term:string,tf:int>>") \
        .select("field", "block", F.explode("entries.term").alias("term"))
    some = some.sample(share / near, 2) if share < near else some
    found = sorted((chr(33 + fields.index(r["field"])) + r["term"], r["block"]) for r in some.collect())
    return sorted({found[len(found) * i // (files * per)] for i in range(1, files * per)}) if found else []


def _bundles(pieces, per: int):
    """A row for the pieces of a part (``pid`` of ``_pieces``) that come together; ``per`` parts make a file."""
    compressed, width = pa.ipc.IpcWriteOptions(compression="zstd"), _POSTING_BYTES.itemsize
    for batch in pieces:
        part = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(part)]):
            sink = pa.BufferOutputStream()
            own = batch.slice(lo, hi - lo)
            raw = _numbers(own.column("postings"), np.uint8)
            woven = pa.array([np.concatenate([raw[i::width] for i in range(width)]).tobytes(), *[b""] * (hi - lo - 1)], pa.binary())
            with pa.ipc.new_stream(sink, _BUNDLE, options=compressed) as to:
                to.write_batch(pa.RecordBatch.from_arrays([own.column("key"), own.column("block"), pc.binary_length(own.column("postings")), woven], schema=_BUNDLE))
            yield pa.RecordBatch.from_arrays([pa.array([part[lo] // per], pa.int32()), pa.array([part[lo]], pa.int32()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pid", "part", "pieces"])


def _unbundled(data: pa.Buffer):
    """The pieces of a bundle as they were."""
    width = _POSTING_BYTES.itemsize
    for own in pa.ipc.open_stream(data).read_all().to_batches():
        woven, at = _numbers(own.column("postings"), np.uint8), 0
        raw = np.empty_like(woven)
        for i in range(width):
            end = at + len(raw[i::width])
            raw[i::width], at = woven[at:end], end
        yield pa.RecordBatch.from_arrays([own.column("key"), own.column("block"), _as_bytes(raw, own.column("size").to_numpy())], schema=_PIECE)


def _parts(batches):
    """The pieces of each part, sorted by key and block, from bundles in order of their parts."""
    kept, last = [], None

    def whole() -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept, _PIECE).combine_chunks().to_batches()[0]
        _, rank = _ranked(rows.column(0))
        return rows.take(pa.array(np.lexsort((rows.column(1).to_numpy(), rank))))

    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if kept and part != last:
                yield whole()
                kept = []
            kept += _unbundled(data.as_buffer())
            last = part
    if kept:
        yield whole()


def _by_term(batches):
    """Stored rows from the rows of blocks in their files' order: one for a term's neighbouring blocks of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term = (batch.column(c).dictionary_encode().indices.to_numpy() for c in ("field", "term"))
        n = batch.column("n").to_numpy()
        same = (field[1:] == field[:-1]) & (term[1:] == term[:-1])
        before = np.cumsum(n) - n
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        chunk = (before - np.repeat(before[first], np.diff([*first, len(n)]))) // ROW_POSTINGS
        starts = np.flatnonzero(np.concatenate([[True], ~same | (chunk[1:] != chunk[:-1])]))
        sizes = np.diff([*starts, len(n)])
        rows = pa.table({c: batch.column(c).take(pa.array(starts)) for c in ("field", "term", "block")})
        bounds, out = np.empty(len(n), _BOUNDS), {}
        for c in _BOUNDS.names:
            bounds[c] = values = batch.column(c).to_numpy()
            if c != "block":
                how = np.minimum if c.startswith("min") else np.maximum if c.startswith("max") else np.add
                out[c] = how.reduceat(values, starts)
        many = sizes > 1
        out["bounds"] = _woven_bounds(bounds[np.repeat(many, sizes)], np.where(many, sizes, 0))
        docs, tf, dl = (batch.column(c).flatten() for c in ("docs", "tfs", "dls"))
        tf = np.where(docs.is_null().to_numpy(zero_copy_only=False), -tf.to_numpy(), tf.to_numpy())
        steps = _steps(pc.fill_null(docs, 0).to_numpy(), np.cumsum(out["n"]) - out["n"])
        for c, values in (("docs", steps), ("tfs", tf), ("dls", dl.to_numpy())):
            out[c] = _planed(values, out["n"])
        for c, values in out.items():
            rows = rows.append_column(c, values if isinstance(values, pa.Array) else pa.array(values))
        yield from rows.combine_chunks().to_batches()


def _as_bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``values`` as bytes, so many a row."""
    ends = (np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """From each number to the next one; those at ``starts``, where a row begins, as they are."""
    steps = np.diff(values, prepend=0)
    steps[starts] = values[starts]
    return steps


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``_steps``, so many a row."""
    values = np.cumsum(steps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return values - np.repeat(values[starts] - steps[starts], sizes[sizes > 0])


def _pieces(batches, fields: list[str], cuts: list[tuple[str, int]]):
    """Forward rows' postings by (field, term), for whole blocks, twice PACK_ROWS of them or more at once."""
    kept, held = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            held += len(batch.column(4).flatten())
            if held >= 2 * PACK_ROWS:
                rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                block = rows.column(3).to_numpy()
                done = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
                if done:
                    yield from _packed_runs(rows.slice(0, done), fields, cuts)
                kept = [rows.slice(done)]
                held = len(kept[0].column(4).flatten()) if done else 0
    if kept:
        yield from _packed_runs(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], fields, cuts)


def _packed_runs(rows: pa.RecordBatch, fields: list[str], cuts: list[tuple[str, int]]):
    """Rows of several files may come one after another; only neighbouring blocks are put together."""
    jumps = np.flatnonzero((np.diff(rows.column(3).to_numpy()) >> 1) != 0) + 1
    for lo, hi in zip([0, *jumps], [*jumps, rows.num_rows]):
        yield from _packed(rows.slice(lo, hi - lo), fields, cuts)


def _packed(rows: pa.RecordBatch, fields: list[str], cuts: list[tuple[str, int]]):
    entries = rows.column(4).flatten()
    if not len(entries):
        return
    at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(4)).to_numpy())
    terms, rank = _ranked(entries.field("term"))
    field = pc.index_in(rows.column(1), pa.array(fields, pa.string())).to_numpy()
    key = field[at] * len(terms) + rank
    order = np.argsort(key, kind="stable")  # within a key by row, so by block
    key, at = key[order], at[order]
    block = rows.column(3).to_numpy()[at]
    docs = rows.column(0)
    null = docs.is_null().to_numpy(zero_copy_only=False)[at]
    tf = entries.field("tf").to_numpy()[order]
    postings = np.empty(len(key), _POSTING_BYTES)
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    postings["doc"] = _steps(pc.fill_null(docs, 0).to_numpy()[at], starts)
    postings["tf"], postings["dl"] = np.where(null, -tf, tf), rows.column(2).to_numpy()[at]
    names = pc.binary_join_element_wise(pa.array([chr(33 + i) for i in range(len(fields))]).take(pa.array(key[starts] // len(terms))),
                                        terms.take(pa.array(key[starts] % len(terms))), "")
    first = block[starts]
    at = [bisect_left(range(len(starts)), c, key=lambda i: (names[i].as_py(), int(first[i]))) for c in cuts]
    pid = np.searchsorted(at, np.arange(len(starts)), side="right").astype(np.int32)
    sizes = np.diff([*starts, len(key)])
    postings["block"] = block - np.repeat(first, sizes)
    ends = (np.array([*starts, len(key)]) * _POSTING_BYTES.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(postings.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(pid), names, pa.array(first), packed], ["pid", "key", "block", "postings"])


def _unpacked(pieces: pa.RecordBatch, fields: list[str]) -> pa.RecordBatch:
    """The postings of sorted pieces, field and term as numbers of a dictionary."""
    lengths = pc.binary_length(pieces.column(2)).to_numpy() // _POSTING_BYTES.itemsize
    _, ends, data = pieces.column(2).buffers()
    start = np.frombuffer(ends, np.int32)[pieces.column(2).offset]
    postings = np.frombuffer(data, _POSTING_BYTES, int(lengths.sum()), int(start))
    coded = pieces.column(0).dictionary_encode()
    at = pa.array(np.repeat(coded.indices.to_numpy(), lengths))
    names = pc.index_in(pc.utf8_slice_codeunits(coded.dictionary, 0, 1), pa.array([chr(33 + i) for i in range(len(fields))]))
    return pa.RecordBatch.from_arrays([
        pa.DictionaryArray.from_arrays(names.take(at), pa.array(fields, pa.string())),
        pa.DictionaryArray.from_arrays(at, pc.utf8_slice_codeunits(coded.dictionary, 1)),
        pa.array(np.repeat(pieces.column(1).to_numpy(), lengths) + postings["block"]),
        pa.array(_sums(postings["doc"], lengths), mask=postings["tf"] < 0), pa.array(np.abs(postings["tf"])),
        pa.array(np.ascontiguousarray(postings["dl"]))],
        ["field", "term", "block", "doc_id", "tf", "dl"])


def _write_flat(postings: DataFrame, fields: list[str], path: str, files: int) -> None:
    """The same from postings that no direct index goes with, each shuffled as a row."""
    marks = [(F.lit(f), F.lit(chr(33 + i))) for i, f in enumerate(fields)]
    mark = F.element_at(F.create_map(*[x for m in marks for x in m]), F.col("field"))
    name = F.element_at(F.create_map(*[x for f, m in marks for x in (m, f)]), F.substring("key", 1, 1))
    whole = F.shiftleft(F.col("tf").cast("long"), 32) + F.col("dl")
    rows = (postings.select(F.concat(mark, "term").alias("key"), "block", "doc_id", whole.alias("whole"))
            .repartitionByRange(files, "key", "block").sortWithinPartitions("key", "block", "doc_id")
            .select(name.alias("field"), F.expr("substring(key, 2)").alias("term"), "block", "doc_id", F.shiftright("whole", 32).cast("int").alias("tf"),
                    F.col("whole").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("dl")))
    map_arrow(rows, lambda batches: _by_term(_block_extents(batches)), _SCHEMAS["postings"]).write.parquet(path, compression="zstd")


def _block_extents(batches):
    """Rows of blocks from postings in their files' order: a row for each stretch of one (field, term, block).

    With ``doc_id`` the postings come along as lists. A forward table that is read in parts may give a block of a
    term in two rows; whoever needs one adds them up.
    """
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        field, term = (rows[c].combine_chunks().dictionary_encode() for c in ("field", "term"))
        block, code = rows["block"].to_numpy(), [c.indices.to_numpy() for c in (field, term)]
        new = (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1]) | (block[1:] != block[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        tf, dl = rows["tf"].to_numpy(), rows["dl"].to_numpy()
        out = {"field": field.take(starts).dictionary_decode(), "term": term.take(starts).dictionary_decode(), "block": block[starts],
               "n": np.diff([*starts, len(block)]).astype(np.int64), "cf": np.add.reduceat(tf.astype(np.int64), starts)}
        for name, values in (("tf", tf), ("dl", dl)):
            out[f"min_{name}"], out[f"max_{name}"] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        if "doc_id" in rows.column_names:
            ends = pa.array([*starts, len(block)], pa.int32())
            out |= {to: pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c, to in (("doc_id", "docs"), ("tf", "tfs"), ("dl", "dls"))}
        found = pa.table(out)
        if left is not None:
            found = _joined(left, found)
        left = found.slice(len(found) - 1).to_pylist()[0]
        yield from found.slice(0, len(found) - 1).combine_chunks().to_batches()
    if left is not None:
        yield pa.RecordBatch.from_pylist([left], found.schema)


def _joined(left: dict, found: pa.Table) -> pa.Table:
    """``found`` with the row ``left`` before it, as one with its first row if both are of one block."""
    first = found.slice(0, 1).to_pylist()[0]
    if all(left[c] == first[c] for c in ("field", "term", "block")):
        both = {"n": left["n"] + first["n"], "cf": left["cf"] + first["cf"],
                **{c: left[c] + first[c] for c in ("docs", "tfs", "dls") if c in left},
                **{f"{name}_{c}": f(left[f"{name}_{c}"], first[f"{name}_{c}"]) for c in ("tf", "dl") for name, f in (("min", min), ("max", max))}}
        left, found = {**left, **both}, found.slice(1)
    return pa.concat_tables([pa.Table.from_pylist([left], found.schema), found])


def _segment(index: Index, base: str, forward: bool, files: int | None) -> dict:
    """Write one segment of ``index``'s documents and return its manifest entry.

    Anything that has postings and lengths will do. With coded rows (a new
    index, or stored forward tables) blocks are consecutive rows of the forward
    table; without, hashes of the document ids.
    """
    spark, name = index.spark, uuid.uuid4().hex[:12]
    at = f"{base}/segments/{name}"
    forward = forward and index.coded is not None

    def read(kind: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[kind]).parquet(f"{at}/{kind}")

    if index.coded is not None:
        direct = f"{at}/forward" if forward else scratch_path(spark, "forward")
        # Blocks of several segments hardly ever share a number; where they do, a bound holds for both.
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS) + F.lit(int(name[:5], 16) << 43)
        (index.coded.select("doc_id", "field", "dl", "n_terms", block.alias("block"), "words", "sizes", "tfs")
         .write.parquet(direct, compression="zstd"))
        rows = spark.read.schema(_SCHEMAS["forward"]).parquet(direct)
        count = rows.agg(F.sum("n_terms").cast("long").alias("n")).first()["n"] or 0
        lengths = rows.select(*_LENGTH)
    else:
        postings = materialize(index.postings.select(*_POSTING, F.shiftrightunsigned(F.xxhash64("doc_id"), 52).alias("block")), "postings")
        count, lengths = postings.count(), index.doclen.select(*_LENGTH)
    if not forward:
        lengths.write.parquet(f"{at}/doclen")
    files = files or files_for(spark, count)
    fields = sorted({*index.fields, index.doc_field})
    with shuffles_dropped(spark):
        if index.coded is not None:
            _write_postings(rows, fields, f"{at}/postings", files, count)
        else:
            _write_flat(postings, fields, f"{at}/postings", files)
    whole = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("tf", "dl") for n, f in (("min", F.min), ("max", F.max))]
    # Dealt out by range first: adding up then needs no shuffle of its own.
    with shuffles_dropped(spark):
        write_clustered(read("postings").drop("block", "bounds", "docs", "tfs", "dls"), f"{at}/lexicon", ["field", "term"], -(-files // 4),
                        lambda rows: rows.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), *whole))
    ranges = None
    for kind in ("postings", "lexicon"):
        own = file_ranges(spark, f"{at}/{kind}", _SCHEMAS[kind], ["field", "term"]).select(F.lit(kind).alias("kind"), "*")
        ranges = own if ranges is None else ranges.unionByName(own)
    ranges.coalesce(1).write.parquet(f"{at}/files")
    stats = [list(r) for r in stats_of(read("forward" if forward else "doclen")).select(*_STATS).collect()]  # a row per field
    return {"id": name, "postings": count, "forward": forward, "stats": stats}


def _meta(index: Index) -> dict:
    return {"fields": list(index.fields), "doc_field": index.doc_field, "stop_words": list(index.analyzer.stop_words or []),
            "stem": index.analyzer.stem}


def write_index(index: Index, path: str, buckets: int | None = None, forward: bool = True) -> Index:
    """Persist an index (B1/B5/B6) as a new version of ``path`` that holds nothing else.

    Any index will do, merged and stored ones included. ``buckets`` is the number of files of
    postings (default: from their number); ``forward`` stores the direct index too, if
    there is one. A version that is being read stays as it is; if another one is
    published meanwhile, ``versions.Conflict`` is raised and nothing changes.
    """
    base = path.rstrip("/")
    number, _ = versions.latest(index.spark, base)
    segment = _segment(index, base, forward, buckets)
    versions.publish(index.spark, base, number + 1, {**_meta(index), "segments": [segment]})
    return read_index(index.spark, base, number + 1)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """Open the latest published version of a persisted index (A8), or the one named."""
    base = path.rstrip("/")
    number, manifest = versions.latest(spark, base) if version is None else versions.version(spark, base, version)
    if manifest is None:
        raise FileNotFoundError(f"no published index at {base}")
    return _opened(spark, base, number, manifest)


def _opened(spark: SparkSession, base: str, number: int, manifest: dict) -> Index:
    segments = manifest["segments"]

    def union(kind: str, of: list[dict]) -> DataFrame | None:
        paths = [f"{base}/segments/{s['id']}/{kind}" for s in of]
        return spark.read.schema(_SCHEMAS[kind]).parquet(*paths) if paths else None

    lexicon = union("lexicon", segments).select(*_LEXICON)
    if len(segments) > 1:
        lexicon = lexicon.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    with_forward = [s for s in segments if s["forward"]]
    coded = union("forward", with_forward) if len(with_forward) == len(segments) else None
    direct, plain = union("forward", with_forward), union("doclen", [s for s in segments if not s["forward"]])
    lengths = [d.select(*_LENGTH) for d in (direct, plain) if d is not None]
    total: dict[str, list[int]] = {}
    for s in segments:
        for name, *values in s["stats"]:
            total[name] = [a + b for a, b in zip(total.get(name, [0, 0, 0]), values)]
    stats = spark.createDataFrame([(n, *v) for n, v in sorted(total.items())],
                                  "field string, n_docs long, n_with_field long, total_len long")
    return Index(_entries(union("postings", segments)).select(*_POSTING), lengths[0] if len(lengths) == 1 else lengths[0].unionByName(lengths[1]),
                 lexicon, stats, tuple(manifest["fields"]), manifest["doc_field"],
                 Analyzer(tuple(manifest["stop_words"]) or None, manifest["stem"]), base, number, tuple(segments), coded)


def _rebased(spark: SparkSession, base: str, change) -> Index:
    """Publish ``change(manifest)`` of the newest version, again from the next one where another writer was first."""
    for _ in range(RETRIES):
        number, manifest = versions.latest(spark, base)
        try:
            versions.publish(spark, base, number + 1, change(manifest))
            return read_index(spark, base, number + 1)
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{base}: other writers were first {RETRIES} times")


def add_documents(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", compact: bool = True) -> Index:
    """Index a batch as a segment of its own and publish the stored segments and this one.

    What is written follows the batch, not the index. Writers may add at the
    same time: whoever is second adds to the other's version. Ids that the
    index already has are the caller's to leave out (see ``ingest``).
    """
    base = path.rstrip("/")
    stored = read_index(spark, base)
    doc_field = stored.doc_field if len(stored.fields) > 1 else None
    batch = build_index(docs, stored.fields, id_col, stored.analyzer, doc_field)
    segment = _segment(batch, base, all(s["forward"] for s in stored.segments), None)

    def with_batch(manifest: dict) -> dict:
        if {k: manifest[k] for k in _meta(batch)} != _meta(batch):
            raise ValueError("the index was replaced by one with other fields or another term pipeline")
        return {**manifest, "segments": [*manifest["segments"], segment]}

    index = _rebased(spark, base, with_batch)
    return compact_index(spark, base) if compact else index


def _tier(segment: dict) -> int:
    return int(math.log(max(1, segment["postings"]), FAN))


def compact_index(spark: SparkSession, path: str) -> Index:
    """Put FAN or more segments of one size together, until no size has that many.

    A posting is so written again once for each power of FAN that the index
    has grown by. The merge reads the segments' forward tables (or postings)
    and tokenizes nothing. Documents added meanwhile stay; if one of the merged
    segments is gone (another writer compacted or replaced the index), the
    work is dropped.
    """
    base = path.rstrip("/")
    while True:
        index = read_index(spark, base)
        by_tier: dict[int, list[dict]] = {}
        for s in index.segments:
            by_tier.setdefault(_tier(s), []).append(s)
        full = [own for _, own in sorted(by_tier.items()) if len(own) >= FAN]
        if not full:
            return index
        own = full[0]
        part = _opened(spark, base, index.version, {**_meta(index), "segments": own})
        merged = _segment(part, base, all(s["forward"] for s in own), None)
        gone = {s["id"] for s in own}

        def replaced(manifest: dict) -> dict:
            if not gone <= {s["id"] for s in manifest["segments"]}:
                raise LookupError
            return {**manifest, "segments": [s for s in manifest["segments"] if s["id"] not in gone] + [merged]}

        try:
            _rebased(spark, base, replaced)
        except LookupError:
            continue


def remove_old_versions(spark: SparkSession, path: str, grace_s: float = 86_400) -> list[str]:
    """Delete versions, and segments that no version names any more, once they have been out of date for ``grace_s``."""
    return versions.remove_old(spark, path.rstrip("/"), grace_s, "segments", lambda m: [s["id"] for s in m["segments"]])


def _check_mergeable(a: Index, b: Index) -> None:
    """Merge guards (E11): same fields, same doc field, same analysis."""
    if tuple(a.fields) != tuple(b.fields) or a.doc_field != b.doc_field:
        raise ValueError(f"field lists differ: {a.fields} vs {b.fields}")
    if a.analyzer != b.analyzer:
        raise ValueError("indexes were built with different term pipelines")
    for side in (a, b):
        for part, need in (("postings", _POSTING), ("doclen", _LENGTH)):
            missing = set(need) - set(getattr(side, part).columns)
            if missing:
                raise ValueError(f"{part} without key columns {sorted(missing)}")


def merge_index(a: Index, b: Index, shift_ids: int | None = None) -> Index:
    """Merge two indexes.

    Postings and lengths are appended (the second side's ids shifted by
    ``shift_ids`` when given); lexicon and statistics are summed per key,
    which equals a full outer join with coalesced counts. Ids present on both
    sides are the caller's to resolve (see ``insert_if_absent``).
    """
    _check_mergeable(a, b)
    bp, bd = b.postings.select(*_POSTING), b.doclen.select(*_LENGTH)
    if shift_ids:
        bp = bp.withColumn("doc_id", F.col("doc_id") + F.lit(shift_ids))
        bd = bd.withColumn("doc_id", F.col("doc_id") + F.lit(shift_ids))
    postings = a.postings.select(*_POSTING).unionByName(bp)
    doclen = a.doclen.select(*_LENGTH).unionByName(bd)
    lexicon = a.lexicon.select("field", "term", "df", "cf") \
        .unionByName(b.lexicon.select("field", "term", "df", "cf")) \
        .groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    stat_cols = ["field", "n_docs", "n_with_field", "total_len"]
    stats = a.stats.select(*stat_cols).unionByName(b.stats.select(*stat_cols)) \
        .groupBy("field").agg(*[F.sum(c).alias(c) for c in stat_cols[1:]])
    coded = None
    if a.coded is not None and b.coded is not None:
        own = [*_LENGTH, "n_terms", "words", "sizes", "tfs"]
        bt = b.coded.select(*own)
        if shift_ids:
            bt = bt.withColumn("doc_id", F.col("doc_id") + F.lit(shift_ids))
        coded = a.coded.select(*own).unionByName(bt)
    return Index(postings, doclen, lexicon, stats, a.fields, a.doc_field, a.analyzer,
                 coded=coded)


def forward_index(index: Index) -> DataFrame:
    """Direct index (E9): doc -> term-sorted (term, tf) list.

    An in-session index already holds it per row and a persisted one as its
    forward table (no shuffle); only one stored without it regroups its
    postings by document.
    """
    if index.coded is not None:
        return index.forward
    return (index.postings.groupBy("doc_id", "field")
            .agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("entries")))


def _numbered(terms: DataFrame) -> DataFrame:
    """(term, term_id): dense 0-based numbers of distinct terms in their order, without a single-task window.

    Range-partition and sort by term, write that to the shared checkpoint
    folder with each row's partition and position (a range exchange evaluated
    twice need not cut at the same terms), count rows per partition, turn the
    counts (one row per partition, so bounded) into offsets and add them up.
    """
    ranged = materialize(terms.select("term").repartitionByRange("term").sortWithinPartitions("term")
                         .select("term", F.spark_partition_id().alias("pid"),
                                 F.monotonically_increasing_id().alias("mid")), "term-ids")
    counts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"),
                                       F.min("mid").alias("first_mid"))
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "first_mid",
                            F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("offset"))
    return (ranged.join(F.broadcast(offsets), "pid")
            .select("term", (F.col("offset") + F.col("mid") - F.col("first_mid"))
                    .cast("bigint").alias("term_id")))


def term_ids(lexicon: DataFrame, field_name: str) -> DataFrame:
    """Dense 0-based term ids in term order."""
    return _numbered(lexicon.filter(F.col("field") == field_name))


def merge_term_ids(first: DataFrame, second: DataFrame, keep_first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two dictionaries (term, term_id) put together: (merged dictionary, map of the first's ids, map of the second's).

    The maps are (old_id, new_id). Ids are dense in term order over both; with
    ``keep_first`` the first side's ids stay (its lists need no change) and the
    second's own terms are numbered after them.
    """
    if keep_first:
        own = _numbered(second.join(first, "term", "left_anti"))
        merged = first.select("term", "term_id").unionByName(own.withColumn("term_id", F.col("term_id") + F.lit(first.count())))
    else:
        merged = _numbered(first.select("term").unionByName(second.select("term")).distinct())
    new = merged.withColumnRenamed("term_id", "new_id")
    maps = [d.select("term", F.col("term_id").alias("old_id")).join(new, "term").select("old_id", "new_id") for d in (first, second)]
    return merged, *maps


def forward_by_ids(forward: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, field, entries array<struct<term_id, tf>>): a direct index whose lists hold term ids, in their order."""
    # inline_outer and a filter, as in _postings: a plain inline would have the counting run again for each element.
    rows = forward.select("doc_id", "field", F.inline_outer("entries")).filter(F.col("term").isNotNull())
    return _lists(rows.join(ids.select("term", "term_id"), "term"))


def remap_forward(forward: DataFrame, old_to_new: DataFrame) -> DataFrame:
    """The lists of ``forward_by_ids`` under new ids, each sorted again."""
    rows = forward.select("doc_id", "field", F.inline("entries")).withColumnRenamed("term_id", "old_id")
    return _lists(rows.join(old_to_new, "old_id").withColumnRenamed("new_id", "term_id"))


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("term_id", "tf"))).alias("entries"))


def stem_map(lexicon: DataFrame) -> DataFrame:
    """(term, stem) over the distinct terms of a lexicon."""
    return lexicon.select("term").distinct().select("term", s_stem(F.col("term")).alias("stem"))


def stemmed_index(index: Index) -> Index:
    """The index under the stemming pipeline, from one without: each distinct term is stemmed once and the postings
    of terms with one stem are added up. Texts are not read again; lengths and collection statistics stay.

    A search of one field of a stored index reads the postings of the terms behind the asked stems alone (``_stemmed_postings``).
    """
    if index.analyzer.stem:
        return index
    postings = (index.postings.select(*_POSTING).join(stem_map(index.lexicon), "term")
                .groupBy("field", F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"))
                .select(*_POSTING))
    return Index(postings, index.doclen, lexicon_of(postings), index.stats, index.fields, index.doc_field,
                 Analyzer(index.analyzer.stop_words, True), unstemmed=index)


def _by_stem(index: Index, fields: list[str]) -> bool:
    """Whether stems' postings can be put together by document: of repeated ids those of one id count as one document's."""
    base = index.unstemmed
    return base is not None and bool(base.segments) and len(fields) == 1 and not repeated_ids(base, fields[0])


def _behind(index: Index, field: str, stems: list[str]) -> list[tuple[str, str, int, int]]:
    """(term, stem, df, cf) of the terms behind ``stems`` (few), by the map of the distinct terms; a stem has two or three at most."""
    known = index._ranges.setdefault(("behind", field), {})
    new = [s for s in stems if s not in known]
    if new:
        base, spark = index.unstemmed, index.spark
        asked = F.broadcast(spark.createDataFrame([(s,) for s in new], "stem string"))
        found = stem_map(base.lexicon.filter(F.col("field") == field)).join(asked, "stem", "left_semi").collect()
        known.update({s: [] for s in new})
        stem = {r["term"]: r["stem"] for r in found}
        if stem:
            terms = F.broadcast(spark.createDataFrame([(t,) for t in stem], "term string"))
            for r in base.lexicon_of([field], terms, sorted(stem)).collect():
                known[stem[r["term"]]].append((r["term"], stem[r["term"]], r["df"], r["cf"]))
    return [r for s in stems for r in known[s]]


def _stemmed_postings(index: Index, field: str, places: dict[str, int]) -> DataFrame:
    """(key, doc_id, tf, dl) of the stems of ``places``, which has their keys; the rows of a document come together."""
    base, spark = index.unstemmed, index.spark
    behind = _behind(index, field, list(places))
    keys = spark.createDataFrame([(field, term, places[stem]) for term, stem, *_ in behind], "field string, term string, key long")
    stored = base.read("stored", [field], sorted(r[0] for r in behind)).join(F.broadcast(keys), ["field", "term"])
    bits = min(stretch_bits(base), UNIT_BITS)
    rows = stretch_postings(stored, bits, bits, None, sum(r[2] for r in behind))

    def added(batches):
        for _, key, doc, tf, dl in runs_of(batches):
            key, doc = key.to_numpy(), doc.to_numpy()
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(doc[starts]), pa.array(np.add.reduceat(tf.to_numpy()[order], starts).astype(np.int32)),
                                              pa.array(dl.to_numpy()[order[starts]])], ["key", "doc_id", "tf", "dl"])

    return map_arrow(rows, added, "key long, doc_id long, tf int, dl int")


def _stemmed_lexicon(index: Index, field: str, stems: list[str]) -> DataFrame:
    """(field, term, df, cf) of ``stems``: as counted where one term is behind a stem, else from the postings put together."""
    by_stem: dict[str, list] = {}
    for r in _behind(index, field, stems):
        by_stem.setdefault(r[1], []).append(r)
    out = [(field, stem, rows[0][2], rows[0][3]) for stem, rows in by_stem.items() if len(rows) == 1]
    several = [stem for stem, rows in by_stem.items() if len(rows) > 1]

    def counted(batches):
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0).to_numpy()
                df, cf = np.bincount(key), np.bincount(key, batch.column(1).to_numpy()).astype(np.int64)
                at = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(cf[at])], ["key", "df", "cf"])

    if several:
        rows = _stemmed_postings(index, field, {stem: i for i, stem in enumerate(several)}).select("key", "tf")
        sums = map_arrow(rows, counted, "key long, df long, cf long").groupBy("key").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        out += [(field, several[r["key"]], r["df"], r["cf"]) for r in sums.collect()]  # a row a stem
    return index.spark.createDataFrame(out, "field string, term string, df long, cf long")
