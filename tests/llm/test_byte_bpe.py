import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rankspark.llm import byte_bpe as B
from rankspark.llm import registry


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(definition):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks_of(definition).of, special_tokens={})


def split(ids, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(ids[at:at + n].tolist())
        at += n
    return out


def test_ids_are_those_of_the_library(definition, library):
    rnd, ranks = random.Random(4), B.ranks_of(definition)
    texts = ["".join(rnd.choice("aabáé中文字 的 \n\t1'sxyz_!?.\U0001F600") for _ in range(rnd.randint(0, 300))) for _ in range(500)]
    texts += [None, "", " ", "\n\n ", "<|endoftext|>", "a" * 5000, "é" * 70, "x y " * 3000, "ab" * 33]
    encoder = B.Encoder(ranks, public_tokenizers.PATTERN)
    want = [library.encode_ordinary(t or "") for t in texts]
    assert split(*encoder.encode(texts)) == want
    assert split(*encoder.encode(texts)) == want  # now from memory
    ids, sizes = encoder.encode(texts)
    assert B.decoded(ids, sizes, ranks) == [(t or "").encode() for t in texts]


def test_memory_starts_anew(definition, library, monkeypatch):
    monkeypatch.setattr(B, "MEMO_PIECES", 5)
    encoder = B.Encoder(B.ranks_of(definition), public_tokenizers.PATTERN)
    for text in ("one two three four five six seven", "eight ninety two", "one more"):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert len(encoder.number) < 10


def test_both_trees_merge_alike(definition):
    """A plain search for the leftmost lowest pair, against the single tree and the trees side by side."""
    rnd, ranks = random.Random(5), B.ranks_of(definition)

    def plain(data):
        ids = [int(ranks.byte[b]) for b in data]
        while True:
            found = [(ranks.pairs[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in ranks.pairs]
            if not found:
                return ids
            rank, k = min(found)
            ids[k:k + 2] = [rank]

    for top in (2, 3, 5, 9, 17, 33, 64):
        pieces = [bytes(rnd.choice(b"aabbcd \xc3\xa9\xff\x00") for _ in range(rnd.randint(2, top))) for _ in range(60)]
        assert [B.merge_one(p, ranks) for p in pieces] == [plain(p) for p in pieces]
        by_size = {}
        for p in pieces:
            by_size.setdefault((len(p) - 2).bit_length(), []).append(p)
        for own in by_size.values():
            assert split(*B.merge_side_by_side(own, ranks)) == [plain(p) for p in own]
    assert B.merge_one(b"a", ranks) == [int(ranks.byte[97])]


def test_odd_tables(spark, definition, library, odd_docs, no_docs):
    docs = odd_docs.withColumn("ids", F.lit("x")).withColumn("bytes", F.lit("y"))
    encoded = B.encode(docs, definition, public_tokenizers.PATTERN)
    assert encoded.columns == ["id", "ids"]
    rows = sorted(((r.id, tuple(r.ids)) for r in encoded.collect()), key=repr)
    assert rows == sorted(((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in odd_docs.collect()), key=repr)
    back = B.decode(encoded.withColumn("a.b", F.lit(1)).withColumn("bytes", F.lit("z")), definition,
                    [F.col("id"), F.col("`a.b`"), F.size("ids").alias("c0")])
    assert back.columns == ["id", "a.b", "c0", "bytes"]
    assert sorted(((r.id, bytes(r.bytes)) for r in back.collect()), key=repr) == \
        sorted(((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()), key=repr)
    assert B.decode(B.encode(no_docs, definition, public_tokenizers.PATTERN), definition, [F.col("id")]).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert {r.id: r.bytes for r in B.decode(none, definition, [F.col("id")]).collect()} == {1: None, 2: b""}
    with pytest.raises(Exception, match="lacks"):
        B.decode(spark.createDataFrame([(1, [1 << 20])], "id int, ids array<int>"), definition, [F.col("id")]).collect()
    with pytest.raises(ValueError, match="lacks the bytes"):
        B.Ranks(b"YQ== 0\n")


def test_query_against_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in registry.op11_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
