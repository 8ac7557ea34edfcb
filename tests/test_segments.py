import threading

import pytest
from pyspark.sql import functions as F

from rankspark.operators import index as I
from rankspark.operators import versions
from rankspark.operators.clustered import files_holding
from rankspark.operators.index import (add_documents, build_index, compact_index, forward_index, merge_index, read_index,
                                       remove_old_versions, write_index)
from rankspark.operators.search import search
from rankspark.session import scratch_path

SF = "/root/testdata/sf0.001"


def words(spark, ids):
    return spark.createDataFrame([(i, f"common w{i % 7} word{i}") for i in ids], "doc_id long, text string")


def ids_of(index):
    return sorted(r.doc_id for r in index.doclen.collect())


def size(spark, path):
    fs, p = versions.file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def test_two_writers_lose_nothing(spark, monkeypatch):
    """A second writer publishes between the first one's reading and publishing: the first adds to what it finds."""
    path = scratch_path(spark, "race")
    write_index(build_index(words(spark, range(10)), ("text",)), path)
    publish, other = versions.publish, []

    def late(spark_, base, number, manifest):
        if not other:
            other.append(number)
            add_documents(spark, path, words(spark, range(10, 20)))
        return publish(spark_, base, number, manifest)

    monkeypatch.setattr(versions, "publish", late)
    mine = add_documents(spark, path, words(spark, range(20, 30)))
    assert other == [2] and mine.version == 3
    assert ids_of(mine) == ids_of(read_index(spark, path)) == list(range(30))


def test_a_whole_write_over_another_one_raises(spark, monkeypatch):
    path = scratch_path(spark, "conflict")
    write_index(build_index(words(spark, range(3)), ("text",)), path)
    segment = I._segment

    def slow(*a):
        out = segment(*a)
        monkeypatch.setattr(I, "_segment", segment)
        add_documents(spark, path, words(spark, range(3, 6)))
        return out

    monkeypatch.setattr(I, "_segment", slow)
    with pytest.raises(versions.Conflict):
        write_index(build_index(words(spark, range(90, 95)), ("text",)), path)
    assert ids_of(read_index(spark, path)) == list(range(6))


def test_a_number_is_published_once(spark):
    base = scratch_path(spark, "numbers")
    won = []

    def go(k):
        try:
            versions.publish(spark, base, 1, {"k": k})
            won.append(k)
        except versions.Conflict:
            pass

    threads = [threading.Thread(target=go, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and versions.latest(spark, base)[1]["k"] == won[0]
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, 1, {"k": 99})
    fs, p = versions.file_system(spark, base)
    assert [s.getPath().getName() for s in fs.listStatus(p)] == ["versions"]  # the losers left nothing


def test_writers_at_the_same_time(spark):
    path = scratch_path(spark, "parallel")
    write_index(build_index(words(spark, range(5)), ("text",)), path)
    threads = [threading.Thread(target=lambda k=k: add_documents(spark, path, words(spark, range(5 * k, 5 * k + 5)), compact=False))
               for k in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids_of(read_index(spark, path)) == list(range(20))


def test_batches_equal_one_build(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = build_index(docs, ("text",))
    path = scratch_path(spark, "batches")
    write_index(build_index(docs.filter("doc_id % 4 = 0"), ("text",)), path)
    first = size(spark, path)
    grown = [first]
    for k in (1, 2, 3):
        index = add_documents(spark, path, docs.filter(f"doc_id % 4 = {k}"), compact=False)
        grown.append(size(spark, path))
    # A batch costs what it holds, not what the index holds.
    assert all(b - a < 1.6 * first for a, b in zip(grown, grown[1:]))
    assert len(index.segments) == 4
    q = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id as int) topic_id", "text")
    want = sorted(search(full, q, "bm25_doc", "document", 20).collect())
    for prune in (False, True):
        assert sorted(search(index, q, "bm25_doc", "document", 20, prune=prune).collect()) == want
    assert sorted(index.stats.select(*full.stats.columns).collect()) == sorted(full.stats.collect())
    whole = compact_index(spark, path)
    assert len(whole.segments) == 1 and sorted(whole.lexicon.collect()) == sorted(full.lexicon.collect())
    assert sorted(search(whole, q, "bb2", "document", 20).collect()) == sorted(search(full, q, "bb2", "document", 20).collect())
    assert sorted(index.postings.collect()) == sorted(whole.postings.collect())  # the old version can still be read


def test_segments_of_one_size_are_put_together(spark):
    path = scratch_path(spark, "tiers")
    write_index(build_index(words(spark, range(400)), ("text",)), path)
    counts = [len(add_documents(spark, path, words(spark, range(400 + 4 * k, 404 + 4 * k))).segments) for k in range(6)]
    assert counts == [2, 3, 4, 2, 3, 4]  # the large one is never written again
    assert ids_of(read_index(spark, path)) == list(range(424))
    big = max(read_index(spark, path).segments, key=lambda s: s["postings"])
    assert big["postings"] == 1200


def test_old_versions_go_after_the_grace_time(spark):
    path = scratch_path(spark, "old")
    write_index(build_index(words(spark, range(5)), ("text",)), path)
    add_documents(spark, path, words(spark, range(5, 9)))
    write_index(build_index(words(spark, range(3)), ("text",)), path)
    assert remove_old_versions(spark, path, grace_s=3600) == []
    assert ids_of(read_index(spark, path, 2)) == list(range(9))
    gone = remove_old_versions(spark, path, grace_s=-1)
    assert sorted(g.split("/")[-2] for g in gone) == ["segments", "segments", "versions", "versions"]
    assert ids_of(read_index(spark, path)) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        read_index(spark, path, 1)


def test_forward_table_is_read_as_stored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path, other = scratch_path(spark, "forward"), scratch_path(spark, "other")
    a = write_index(build_index(docs.filter("doc_id % 2 = 0"), ("text",)), path)
    b = write_index(build_index(docs.filter("doc_id % 2 = 1"), ("text",)), other)
    merged = write_index(merge_index(a, b), path)
    want = sorted(forward_index(build_index(docs, ("text",))).collect())
    assert sorted(forward_index(merged).collect()) == want
    plan = forward_index(merged)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # Optional: without it the postings are regrouped, and lengths have a table of their own.
    bare = write_index(build_index(docs, ("text",)), scratch_path(spark, "bare"), forward=False)
    assert bare.tokenized is None and sorted(forward_index(bare).collect()) == want
    assert sorted(bare.doclen.collect()) == sorted(merged.doclen.collect())
    grown = add_documents(spark, bare.path, words(spark, [10 ** 6]))
    assert not any(s["forward"] for s in grown.segments) and 10 ** 6 in ids_of(grown)


def test_files_read_follow_the_terms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = write_index(build_index(docs, ("text",)), scratch_path(spark, "files"), buckets=16)
    every = sorted(r.term for r in index.lexicon.select("term").collect())
    counts = [len(index.files_with("postings", ["text"], every[::step])) for step in (1, len(every) // 8, len(every) // 2)]
    assert counts[0] == 16 and counts[0] > counts[1] > counts[2] > 0
    assert len(index.files_with("postings", ["text"], ["\U0010FFFF none"])) == 0
    assert index.read("postings", ["text"], ["\U0010FFFF none"]).count() == 0
    term = every[len(every) // 3]
    few = index.read("postings", ["text"], [term])
    assert sorted(few.filter(F.col("term") == term).select("doc_id", "tf").collect()) == \
        sorted(index.postings.filter(F.col("term") == term).select("doc_id", "tf").collect())
    assert few.count() < index.postings.count() / 4
    assert files_holding([("a", ("f", "b"), ("f", "d")), ("b", ("f", "d"), ("f", "x"))], [("f", "d")]) == ["a", "b"]


def test_an_empty_index(spark):
    index = write_index(build_index(words(spark, []), ("text",)), scratch_path(spark, "empty"))
    q = spark.createDataFrame([(1, "common word")], "topic_id int, text string")
    assert index.postings.count() == 0 and search(index, q, "bm25_doc", "document", 5).count() == 0
    assert search(index, q, "bm25_doc", "document", 5, prune=True).count() == 0
    assert ids_of(add_documents(spark, index.path, words(spark, [1, 2]))) == [1, 2]


def test_blocks_come_from_the_sorted_postings(spark, monkeypatch):
    """A row for each (field, term, block) however the postings are cut into batches, without a shuffle of them."""
    import pyarrow as pa

    from rankspark.operators import clustered
    from rankspark.operators import index as I

    rows = [("abstract", t, b, tf, 9 + tf) for t in ("a", "b", "bb") for b in (1, 7) for tf in (3, 1, 2)] + [("title", "bb", 7, 4, 5)]
    names = ["field", "term", "block", "tf", "dl"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    want = [("abstract", t, b, 3, 6, 1, 3, 10, 12) for t in ("a", "b", "bb") for b in (1, 7)] + [("title", "bb", 7, 1, 4, 4, 4, 5, 5)]
    for size in (1, 2, 3, 4, 100):
        parts = [batch.slice(i, size) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in I._block_extents(parts) for r in b.to_pylist()] == want, size
    assert list(I._block_extents([])) == []

    written = []
    monkeypatch.setattr(I, "write_clustered", lambda df, path, *a: (written.append(path.rsplit("/")[-1]), clustered.write_clustered(df, path, *a)))
    docs = spark.createDataFrame([(i, f"x{i % 7} y Z{i % 3}", f"y é{i % 5} {'x1 ' * (i % 4)}") for i in range(200)],
                                 "doc_id long, title string, abstract string")
    index = write_index(build_index(docs, ("title", "abstract")), scratch_path(spark, "blocks"), buckets=3)
    assert written == ["lexicon"]  # postings and blocks are not dealt out by it
    grouped = index.read("postings", ["title", "abstract", "_doc"]).groupBy("field", "term", "block").agg(
        F.count("*").alias("n"), F.sum("tf").alias("cf"), F.min("tf").alias("min_tf"), F.max("tf").alias("max_tf"),
        F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))
    blocks = index.read("blocks", ["title", "abstract", "_doc"])
    assert sorted(blocks.collect()) == sorted(grouped.collect())
    ranges = spark.read.parquet(f"{index.path}/segments/{index.segments[0]['id']}/files")
    for r in ranges.collect():
        keys = [(x["field"], x["term"]) for x in spark.read.parquet(f"{index.path}/segments/{index.segments[0]['id']}/{r['kind']}/{r['file']}").collect()]
        assert keys == sorted(keys) and (tuple(r["first"]), tuple(r["last"]), r["rows"]) == (keys[0], keys[-1], len(keys))


def _forward_batch(rows):
    """Forward rows (doc_id, field, dl, block, {term: tf}) as the direct index has them."""
    import pyarrow as pa
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    columns = [*zip(*[(*r[:4], [{"term": t, "tf": n} for t, n in sorted(r[4].items())]) for r in rows])]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "field", "dl", "block", "entries"])


def test_postings_are_put_together_by_term_before_the_shuffle(monkeypatch):
    """A term's postings in a stretch of blocks are one row, and nothing is lost on the way."""
    import pyarrow as pa

    monkeypatch.setattr(I, "PACK_ROWS", 7)
    rows = [(None if d == 3 else d, f, 4, d // 2, {"a": 1 + d, "é": 2, f"x{d % 3}": 1} if d != 4 else {}) for d in range(12) for f in ("_doc", "title")]
    rows += [(90 + d, "title", 4, 500, {"a": 1}) for d in range(2)]  # another file's rows: their blocks do not follow
    want = sorted((f, t, b, d, tf, dl) if d is not None else (f, t, b, -1, tf, dl) for d, f, dl, b, e in rows for t, tf in e.items())
    for size, cuts in ((1, []), (5, [("!é", 3), ('"a', 2)]), (100, [("!é", 3)])):
        batches = [_forward_batch(rows[i:i + size]) for i in range(0, len(rows), size)]
        pieces = [p for b in I._pieces(batches, ["_doc", "title"], cuts) for p in b.to_pylist()]
        assert len(pieces) < len(want) * 0.8
        assert all(p["pid"] == sum(c <= (p["key"], p["block"]) for c in cuts) for p in pieces)
        pieces.sort(key=lambda p: (p["pid"], p["key"], p["block"]))
        kind = pa.schema([("key", pa.string()), ("block", pa.int64()), ("postings", pa.binary())])
        table = pa.RecordBatch.from_pylist([{c: p[c] for c in kind.names} for p in pieces], kind)
        found = [r for part in (table.slice(0, 3), table.slice(3)) for b in I._block_extents([I._unpacked(part, ["_doc", "title"])]) for r in b.to_pylist()]
        assert sorted((r["field"], r["term"], r["block"], -1 if d is None else d, tf, dl) for r in found
                      for d, tf, dl in zip(r["docs"], r["tfs"], r["dls"])) == want
        assert all(r["n"] == len(r["tfs"]) and r["cf"] == sum(r["tfs"]) and r["max_tf"] == max(r["tfs"]) for r in found)


def test_stored_postings_equal_the_lazy_ones(spark, monkeypatch):
    """Ids that repeat or are null, empty texts, several tasks and files; counting as by the rows' own expressions."""
    from rankspark.functions.analysis import PIPELINE, counted

    monkeypatch.setattr(I, "BLOCK_BITS", 3)
    docs = spark.createDataFrame([(None if i == 7 else i % 50, f"Straße x{i % 9} s", None if i % 5 else f"b a A é{i % 4} {'w ' * (i % 3)}")
                                  for i in range(120)], "doc_id long, title string, abstract string").repartition(3)
    for analyzer in (I.DEFAULT, PIPELINE):
        index = build_index(docs, ("title", "abstract"), analyzer=analyzer)
        rows = I.token_rows(docs, ("title", "abstract"), analyzer=analyzer)
        old = counted(rows, F.col("tokens"), ["doc_id", "field"])
        assert sorted(index.tokenized.collect(), key=repr) == sorted(old.collect(), key=repr)
        stored = write_index(index, scratch_path(spark, "same"), buckets=4)
        assert sorted(stored.postings.collect(), key=repr) == sorted(index.postings.collect(), key=repr)
        assert sorted(stored.lexicon.collect()) == sorted(index.lexicon.collect())
        assert stored.read("blocks", ["title"]).agg(F.sum("n")).first()[0] == index.postings.filter("field = 'title'").count()


def test_stored_rows_hold_a_term_and_its_blocks(spark, monkeypatch):
    """The shuffle has a row for a part of a file and some blocks, a file one for a term and its blocks."""
    monkeypatch.setattr(I, "BLOCK_BITS", 2)
    monkeypatch.setattr(I, "PACK_ROWS", 100)
    docs = spark.createDataFrame([(None if i == 5 else i, f"a {'a ' * (i % 3)}b x{i % 11}", f"y{i % 7} ö a") for i in range(160)],
                                 "doc_id long, title string, abstract string").coalesce(1)
    kept = []
    cuts = I._cuts
    monkeypatch.setattr(I, "_cuts", lambda *a: kept.append(a[4]) or cuts(*a))
    lazy = build_index(docs, ("title", "abstract"))
    for most in (16_384, 8):
        monkeypatch.setattr(I, "ROW_POSTINGS", most)
        stored = write_index(lazy, scratch_path(spark, "rows"), buckets=2)
        whole = spark.read.parquet(f"{stored.path}/segments/{stored.segments[0]['id']}/postings")
        assert kept.pop() > 1  # parts a file
        blocks = stored.read("blocks", ["title", "abstract", "_doc"])
        assert whole.count() < blocks.count() / 3
        assert sorted(stored.postings.collect(), key=repr) == sorted(lazy.postings.collect(), key=repr)
        want = stored.read("postings", ["title", "abstract", "_doc"]).groupBy("field", "term", "block").agg(
            F.count("*").alias("n"), F.sum("tf").alias("cf"), F.min("tf").alias("min_tf"), F.max("tf").alias("max_tf"),
            F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))
        assert sorted(blocks.collect()) == sorted(want.collect())
    pieces = [b for r in ([(1, "!a", 0)], [(2, "!b", 4), (7, "!c", 0)]) for b in [I.pa.RecordBatch.from_pylist(
        [{"pid": p, "key": k, "block": b, "postings": b"x"} for p, k, b in r], I.pa.schema([("pid", I.pa.int32()), *I._PIECE]))]]
    rows = [r for b in I._bundles(iter([*pieces, pieces[0]]), 4) for r in b.to_pylist()]
    assert [(r["pid"], r["part"]) for r in rows] == [(0, 1), (0, 2), (1, 7), (0, 1)]


def test_coded_rows_give_the_counted_terms(spark, monkeypatch):
    """The direct index is stored as bytes a row; a scan takes the asked terms' postings alone."""
    import pyarrow as pa

    from rankspark.operators.index import postings_by_document

    docs = spark.createDataFrame([(1, "é b é " + "w" * 70_000, ""), (None, None, "b"), (3, "", None), (4, "ß ß ß", "b ö")],
                                 "doc_id long, title string, abstract string").coalesce(1)
    lazy = build_index(docs, ("title", "abstract"))
    stored = write_index(lazy, scratch_path(spark, "coded"))
    assert "array" not in str(stored.coded.schema).lower()
    want = {(1, "title"): [("b", 1), ("w" * 70_000, 1), ("é", 2)], (4, "_doc"): [("b", 1), ("ß", 3), ("ö", 1)], (3, "_doc"): []}
    for index in (lazy, stored, merge_index(stored, build_index(docs.limit(0), ("title", "abstract")))):
        rows = {(r.doc_id, r.field): (r.dl, [tuple(e) for e in r.entries]) for r in index.tokenized.collect()}
        assert len(rows) == 12 and all(rows[k][1] == v for k, v in want.items()) and rows[(4, "_doc")][0] == 5
        found = postings_by_document(index, ["title", "_doc"], pa.array(["b", "none"]))[0]
        assert sorted((r.field, r.term, r.doc_id or 0, r.tf, r.dl) for r in found.collect()) == [
            ("_doc", "b", 0, 1, 1), ("_doc", "b", 1, 1, 4), ("_doc", "b", 4, 1, 5), ("title", "b", 1, 1, 4)]


def test_shuffled_postings_take_little_room(spark, monkeypatch):
    """documents as steps and like bytes together in the shuffle; the lexicon is shuffled once."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([0, 3, 1, 0, 4, 0])
    docs = np.array([5, 5, -2 ** 63, 2 ** 63 - 1, -7, 0, 10 ** 12, 3])
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    assert I._sums(I._steps(docs, starts), sizes).tolist() == docs.tolist()
    none = np.zeros(0, np.int64)
    assert not len(I._sums(I._steps(none, none), none))

    rnd = np.random.default_rng(1)
    rows = [(int(d), "text", int(x), d >> 7, {f"w{t}": int(n) for t, n in zip(rnd.choice(300, 40, False), rnd.integers(1, 4, 40))})
            for d, x in enumerate(rnd.integers(40, 2000, 1000))]
    pieces = [*I._pieces([_forward_batch(rows)], ["text"], [("!w2", 0)])]
    bundles = [*I._bundles(iter(pieces), 4)]
    assert sum(b.column("pieces").nbytes for b in bundles) < 6 * 40 * 1000  # 20 bytes a posting as they are
    back = pa.Table.from_batches([p for b in bundles for data in b.column("pieces") for p in I._unbundled(data.as_buffer())])
    assert back.to_pylist() == pa.Table.from_batches([p.select(["key", "block", "postings"]) for p in pieces]).to_pylist()

    plans, write = [], I.write_clustered

    def planned(df, path, keys, files, change):
        plans.append(change(df.repartitionByRange(files, *keys))._jdf.queryExecution().executedPlan().toString())
        write(df, path, keys, files, change)

    monkeypatch.setattr(I, "write_clustered", planned)
    write_index(build_index(words(spark, range(50)), ("text",)), scratch_path(spark, "once"), buckets=8)
    assert plans[0].count("Exchange") == 1
