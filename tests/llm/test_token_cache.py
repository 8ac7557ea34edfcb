import random

from rankspark.llm import token_cache as T
from rankspark.llm.registry import tokenizer_definition


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_definition())
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_count_like_whole_texts():
    rnd = random.Random(2)
    alphabet = ["a", "Th", "é", "9", "12", " ", "  ", "\n", "\n\n", "'s", "'ll", ".", "!?", "<|endoftext|>", "中", "\t", " ",
                "\x1c", " ", "\r\n", "\U0001F600", "_", "\x85", "　"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rnd.choices(alphabet[:15], k=rnd.randint(0, 40))) for _ in range(4000)]
    definition = tokenizer_definition()
    assert T.splits_at_spaces(definition)
    assert T.Counter(definition).counts(texts) == direct(texts)
    assert not T.splits_at_spaces(tokenizer_definition("word_bpe_49k.json"))


def test_cache(spark, tmp_path, odd_docs, no_docs):
    path, definition = f"file://{tmp_path}/cache", tokenizer_definition()
    version = T.tokenizer_version(definition)
    rows = T.token_counts(odd_docs, path, definition).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    want = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(sorted(texts, key=repr), direct([t for _, t in sorted(texts, key=repr)]))), key=repr)
    assert len(rows) == odd_docs.count()
    assert sorted({(r.id, r.n_bytes, r.n_tokens) for r in rows}, key=repr) == want
    stored = spark.read.parquet(path)
    assert stored.count() == len({t or "" for _, t in texts})
    # A second run meets no miss; only a new text is encoded and appended.
    assert T.encode_misses(odd_docs, T.read_cache(spark, path, version), definition).count() == 0
    more = spark.createDataFrame([(70, "something entirely new"), (71, None)], "doc_id long, text string")
    assert [r.digest for r in T.encode_misses(more, T.read_cache(spark, path, version), definition).collect()] != []
    T.token_counts(more, path, definition).count()
    assert spark.read.parquet(path).count() == stored.count() + 1
    # Another version shares nothing.
    assert T.read_cache(spark, path, "other").count() == 0
    assert T.token_counts(no_docs, path, definition).count() == 0
