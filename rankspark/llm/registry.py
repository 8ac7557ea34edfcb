"""Registered queries of the operators and their DuckDB SQL (None where SQL cannot express one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import byte_bpe, chat, decontaminate, hard_negatives, langid, lm_score, packing, periodic_runs, pii, \
    quality, simhash, token_cache, warc
from rankspark.llm.common import table
from rankspark.session import scratch_path

OVER_LIMIT = 512

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages`` written, read back, reassembled and decoded."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    pages = warc.read_archives(spark, path, with_payload=False)
    return pages.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (d)"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items hit in every document."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


_NORM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
        r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_NORM} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_NORM} AS w FROM documents),
gram AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS p
               FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, p, item FROM gram JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with bucket, batch and slot: cut, bucketed and held to the budget by what the tokenizer counts."""
    return pack_tokens(table(spark, sf_dir, "documents"))


def op3_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under their earlier name."""
    return op3_length_buckets(spark, sf_dir)


def op3_word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words between white space, which SQL can count."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pack_tokens(docs: DataFrame) -> DataFrame:
    counts = token_cache.lengths(docs, tokenizer_definition())
    return packing.pack(counts, "id", length=F.col("n_tokens")).withColumnRenamed("id", "doc_id")


OP3_WORDS = f"SELECT doc_id, len({_WORDS})::BIGINT AS n FROM documents"


def op3_sql(lengths: str, unit: str) -> str:
    """The packing of a table of lengths (doc_id, n)."""
    steps = ", ".join(
        f"""f{k} AS MATERIALIZED (SELECT j, min({{'c': f.c + h.l * (h.cn - f.cn) - (h.sn - f.sn), 'i': f.j}}) AS b
              FROM (SELECT p.j, p.c, coalesce(h.cn, 0) AS cn, coalesce(h.sn, 0) AS sn FROM g{k - 1} p LEFT JOIN h ON h.j = p.j) f
              JOIN h ON h.j > f.j GROUP BY h.j),
        g{k} AS (SELECT j, b.c AS c, b.i AS i FROM f{k})"""
        for k in range(1, packing.N_BUCKETS + 1))
    steps = steps.replace("SELECT j, min(", "SELECT h.j AS j, min(")
    back = [f"""t{packing.N_BUCKETS} AS (SELECT least({packing.N_BUCKETS}, max(j)) AS k, max(j) AS j FROM h)"""]
    for k in range(packing.N_BUCKETS, 0, -1):
        back.append(f"t{k - 1} AS (SELECT t.k, CASE WHEN t.k >= {k} THEN g.i ELSE t.j END AS j FROM t{k} t LEFT JOIN g{k} g ON g.j = t.j)")
    cuts = " UNION ALL ".join(f"SELECT {k} AS k, j FROM t{k} WHERE k >= {k}" for k in range(1, packing.N_BUCKETS + 1))
    return f"""
WITH n AS ({lengths}),
p AS (SELECT doc_id, piece::INTEGER AS piece, piece * {packing.MAX_LEN} AS start,
             least({packing.MAX_LEN}, n - piece * {packing.MAX_LEN}) AS n
      FROM (SELECT doc_id, n, unnest(range(greatest(1, (n + {packing.MAX_LEN - 1}) // {packing.MAX_LEN}))) AS piece FROM n)),
h0 AS (SELECT n AS l, count(*) AS c FROM p GROUP BY n),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l) AS j, l, sum(c) OVER (ORDER BY l)::BIGINT AS cn,
      sum(c * l) OVER (ORDER BY l)::BIGINT AS sn FROM h0),
g0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS c, 0::BIGINT AS i),
{steps},
{', '.join(back)},
cut AS (SELECT (row_number() OVER (ORDER BY l) - 1)::INTEGER AS bucket, l, coalesce(lag(l) OVER (ORDER BY l), -1) AS lo
        FROM ({cuts}) x JOIN h USING (j)),
b AS (SELECT p.*, bucket, l, greatest(1, {packing.BUDGET} // greatest(l, 1)) AS m,
             row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS pos
      FROM p JOIN cut ON p.n > lo AND p.n <= l)
SELECT doc_id, piece, start::BIGINT AS start, n::BIGINT AS {unit}, bucket, l::INTEGER AS bucket_len,
       (pos // m)::BIGINT AS batch, (pos % m)::INTEGER AS slot FROM b"""


def tokenizer_definition(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op4_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts through a cache that starts empty, so that every distinct text is encoded once."""
    counts = token_cache.token_counts(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"),
                                      tokenizer_definition())
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, target = documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(langid.training_sample(docs.filter(fold != 2), "doc_id", "text", "lang", langid.SAMPLE_DOCS))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model, [F.col("doc_id"), held_out], with_spans=False) \
        .withColumnRenamed("lang", "lang_pred")


_LEDGERS: dict[tuple, str] = {}


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a data folder, measured and stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, quality.rules_version())
    if key not in _LEDGERS:
        path = scratch_path(spark, "ledger")
        quality.update_ledger(table(spark, sf_dir, "documents"), path)
        _LEDGERS[key] = path
    return quality.read_ledger(spark, _LEDGERS[key])


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base rules and the verdict of policy v3, from the stored ledger."""
    base = quality.Policy("base", quality.BASE)
    book = quality.apply_policy(stored_ledger(spark, sf_dir), quality.POLICIES["v3"])
    return book.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed").bitwiseAND(F.lit(base.mask)) != 0).alias("base_failed"), "kept")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines
           FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
        SELECT doc_id, unnest(range(p, p + 8)) AS q
        FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct,
             length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM d LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars > 30 * n_words
            OR 20 * n_distinct < n_words OR 2 * n_upper > n_letters) AS kept
FROM v"""


def op8_policy_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, and what the policy keeps with and without it, over the whole ledger."""
    return quality.ablations(stored_ledger(spark, sf_dir), list(quality.POLICIES.values()))


OP8_ABLATIONS_SQL = OP8_SQL[:OP8_SQL.index("v AS (")] + """
f AS (SELECT [n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words,
              n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines, word_chars > 30 * n_words,
              20 * n_distinct < n_words, 2 * n_upper > n_letters] AS bad FROM m),
r7 AS (SELECT * FROM (VALUES (1, 'min_words'), (2, 'repeated_words'), (3, 'symbols'), (4, 'duplicate_lines'), (5, 'long_words'),
       (6, 'few_distinct'), (7, 'shouting')) x(k, rule)),
p3 AS (SELECT policy, size, k, rule FROM (VALUES ('v1', 2), ('v2', 4), ('v3', 7)) x(policy, size) JOIN r7 ON k <= size),
e AS (SELECT policy, rule, bad[k] AS own, len(list_filter(bad[1:size], lambda x: x)) AS n_bad FROM f, p3)
SELECT policy, rule, count(*) FILTER (WHERE own) AS n_failed, count(*) FILTER (WHERE own AND n_bad = 1) AS n_only,
       count(*) FILTER (WHERE n_bad = 0) AS kept, count(*) FILTER (WHERE n_bad = own::INTEGER) AS kept_without
FROM e GROUP BY policy, rule"""


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, formatted and read back."""
    said = r"\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '" + said + "'), "
                      "(CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '" + said + "') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.digests(chat.format_trees(chat.chain(rows)))
    return out.withColumnRenamed("conv", "conv_id").drop("rank")


_ESC = r"replace(replace(replace({}, '\', '\\'), '#', '\h'), '<', '\l')"
OP9_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(13 + length(replace({_ESC.format('role')}, chr(10), '\n')) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def op10_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(pii.training_windows(docs)), [F.col("doc_id")])

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                    s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        definition = f.read()
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), definition, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    back = byte_bpe.decode(encoded, definition, [F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                                                 F.sha2(joined, 256).alias("ids_sha256")])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts whose id's checksum ends in 0 made periodic from a place on, the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, F.array_remove(F.split("text", "[ \t-\r]+"), "")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("IF(n > 0, g % n, 0)")) \
        .withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]))")
    return rows.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, the longest one, and the words without their repetitions."""
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")), [F.col("doc_id")])
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    # Of the longest runs the first, of those the one with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    length, start, period = best["length"], -best["col2"], -best["col3"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP13_SQL = """
WITH v AS (SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT * FROM (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM s JOIN p USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) WHERE rank <= 10"""


QUERIES = {f.__name__: f for f in (
    op1_warc_reassembly, op2_benchmark_decontamination, op3_length_buckets, op3_token_buckets, op3_word_buckets, op4_token_cache, op5_cross_entropy_difference,
    op6_simhash, op7_language_spans, op8_quality_ledger, op8_policy_ablations, op9_reply_trees, op10_pii_bilstm_crf,
    op11_byte_bpe, op12_periodic_runs, op13_hard_negatives)}
ORACLE = {"op1_warc_reassembly": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL, "op3_word_buckets": op3_sql(OP3_WORDS, "n_words"),
          "op8_quality_ledger": OP8_SQL,
          "op8_policy_ablations": OP8_ABLATIONS_SQL, "op9_reply_trees": OP9_SQL, "op13_hard_negatives": OP13_SQL}
