import hashlib
import random

from pyspark.sql import functions as F

from rankspark.llm import chat as C

TREE = "conv long, node long, parent long, role string, text string, score double"


def paths(rows):
    """Brute force: {conv: [(mean score, leaf, [nodes])]} from roots to leaves."""
    by = {(c, n): (p, s) for c, n, p, _, _, s in rows}
    inner = {(c, p) for c, n, p, *_ in rows if p is not None}
    out = {}
    for c, n, *_ in rows:
        if (c, n) in inner:
            continue
        line, at = [], n
        while at is not None and (c, at) in by and at not in line:
            line.append(at)
            at = by[c, at][0]
        if at in line:
            continue
        out.setdefault(c, []).append((-sum(by[c, x][1] for x in line) / len(line), n, line[::-1]))
    return {c: sorted(v) for c, v in out.items()}


def test_trees(spark):
    rnd = random.Random(6)
    rows = []
    for c in (1, 2, None):
        for n in range(60):
            rows.append((c, n, rnd.randrange(n) if n and rnd.random() < 0.95 else None, rnd.choice(["user", "assistant"]),
                         rnd.choice(["", "a#<b>\\", "\\h", "</turn>\n", "### x\n", "é"]), float(rnd.randint(0, 5))))
    rows += [(3, 0, 99, "user", "orphan", 1.0), (4, 0, 1, "user", "cycle", 1.0), (4, 1, 0, "user", "cycle", 1.0),
             (4, 2, 0, "assistant", "on a cycle", 1.0)]
    rows += [(5, n, n - 1 if n else None, "user" if n % 2 == 0 else "assistant", f"t{n}", 0.0) for n in range(37)]
    want = paths(rows)
    text = {(c, n): (role, t) for c, n, _, role, t, _ in rows}
    got = C.read_back(C.format_trees(spark.createDataFrame(rows, TREE), branches=2)).collect()
    assert {(r.conv, r["rank"]) for r in got} == {(c, k + 1) for c, v in want.items() for k in range(min(2, len(v)))}
    for r in got:
        line = [text[r.conv, n] for n in want[r.conv][r["rank"] - 1][2]]
        assert [(t.role, t.text, t.loss) for t in r.turns] == [(a, b, b if a == "assistant" else None) for a, b in line]


def test_escapes_are_reversible(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(["\\", "#", "<", "h", "l", "n", "\n", "### ", "</turn>", "\\h", "é"], k=rnd.randint(0, 12))) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    d = d.select("t", C.escape(F.col("t")).alias("e"), C.escape(F.col("t"), role=True).alias("r"))
    for r in d.select("t", "e", "r", C.unescape(F.col("e")).alias("u"), C.unescape(F.col("r")).alias("v")).collect():
        assert r.t == r.u == r.v
        assert not set("#<") & set(r.e) and not set("#<\n") & set(r.r)


def test_plain_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x"), (None, 0, "assistant", "n"),
            (None, None, "user", "m"), (2, 5, "assistant", "one"), (2, 9, "assistant", "two")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = {r.conv: r for r in C.digests(C.format_trees(C.chain(d))).collect()}
    order = {1: rows[:4], None: [rows[5], rows[4]], 2: rows[6:]}
    for c, own in order.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == set(order)
    assert C.digests(C.format_trees(C.chain(d.limit(0)))).count() == 0
