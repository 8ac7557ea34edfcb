"""Language identification with spans of mixed-language text.

Training: hashed byte n-grams (1 to 4, with word edges) of labelled texts are
counted per language; each bucket gives every language a smoothed
log-probability. The scripts of the training words give each script its
candidate languages. At most about ``SAMPLE_DOCS`` documents per language are
used, drawn by a hash of the id at a rate set from the language's own count.

Prediction, per word: Unicode ranges give the word's script and with it the
candidates; others are out. Candidates score the mean of their n-gram
log-probabilities times the root of the number of n-grams, relative to the
best one and bounded below by ``-CLIP``. Viterbi then finds the sequence of
languages with the highest sum of word scores less ``SWITCH`` for each change
of language. Documents whose best single language cannot be beaten (no
language gains more than half a switch over any stretch of words) need no
search; the others advance side by side, one word per step.

The document's language is that with the most letters in its spans. A word is
unfamiliar if no training text had its script, or if its n-grams are, for every
candidate, nearer to ones never seen than to that language's own average
(``STRANGE`` of the way). The score is the share of the document's letters that
stand in familiar words of its language: text unlike anything learned gets a
language, but a score near 0. Words are runs of letters.

Memory: what a task remembers of words and what it scores at once is bounded
by ``CELLS`` numbers (words x languages); only one very long text may take
more, which is why there are at most ``MAX_LANGUAGES``.

Defined results: null and empty texts and texts without a letter are ``und``
with score 0; a very long text is read whole; words of a script that no
training text had keep all languages alike; ties go to the language that comes
first in alphabetical order; without labelled text everything is ``und``; rows
with null or repeated ids are treated one by one; an empty table gives no
rows. Columns are read by their exact names and carried by position, so other
columns, ``lang`` and ``score`` among them, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.llm.common import map_arrow, named

BUCKET_BITS = 17
SAMPLE_DOCS = 3000
MAX_LANGUAGES = 128
MIN_SHARE = 0.01
SWITCH = 6.0
CLIP = 3.0
GRAMS = (1, 2, 3, 4)
_WORD = re.compile(r"[^\W\d_]+")
STRANGE = 0.5
CELLS = 4_000_000

# Unicode ranges of scripts (first, last code point); letters outside are "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
NAMES = [*SCRIPTS, "other"]
_STARTS = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])


def script_of(word: str) -> int:
    """Index in NAMES of the first letter's script; words mix scripts rarely."""
    c = ord(word[0])
    if c < 0x250:
        return 0
    return next((k for a, b, k in _STARTS if a <= c <= b), len(SCRIPTS))


def gram_ids(words: list[bytes], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its word), words taken with a blank at each end."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # the blank before each word
    end = first + lengths + 2  # past the blank after it
    ids, owner = [], []
    for n in GRAMS:
        h = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(257) + data[i:len(data) - n + 1 + i]) & np.uint64((1 << 40) - 1)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        per = np.maximum(end - first - n + 1, 0)  # n-grams of each word
        if n == 1:
            per = lengths
        word = np.repeat(np.arange(len(words)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first, per) + (n == 1)
        ids.append(h[at].astype(np.int64))
        owner.append(word)
    return np.concatenate(ids), np.concatenate(owner)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> DataFrame:
    """(lang, text) of labelled rows, at most about ``sample_docs`` a language.

    The rates come from the languages' counts, so nothing is gathered to draw
    the sample; there are at most ``MAX_LANGUAGES`` of them.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rate = F.lit(0)
    for r in sizes:
        rate = F.when(F.col(lang_col) == r[0], F.lit(min(1 << 20, sample_docs * (1 << 20) // r[1]))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid sample")), F.lit(1 << 20))
    return labelled.filter(draw < rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


class Model:
    """Languages, their log-probabilities by bucket, and the candidates of every script."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        n = grams.sum(axis=1, keepdims=True)
        self.table = np.log((grams + 0.5) / (n + 0.5 * grams.shape[1])).T.astype(np.float32).copy()
        own = (grams * self.table.T).sum(axis=1) / np.maximum(1, n[:, 0])
        never = np.log(0.5 / (n[:, 0] + 0.5 * grams.shape[1]))
        self.least = (own - STRANGE * (own - never)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = share.T >= MIN_SHARE  # [script, language]
        self.allowed[~self.allowed.any(axis=1)] = True
        self.unseen = ~(share.T >= MIN_SHARE).any(axis=1)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[word, language], at most 0 (the best candidate), at least -CLIP; and whether each word is familiar."""
        ids, owner = gram_ids([w.encode() for w in words])
        total = np.zeros((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(owner, self.table[ids, k], len(words))
        root = np.sqrt(np.bincount(owner, minlength=len(words)))[:, None].astype(np.float32)
        total /= root
        script = np.fromiter(map(script_of, words), np.int64, len(words))
        total[~self.allowed[script]] = -np.inf
        familiar = ~self.unseen[script] & (total >= self.least * root).any(axis=1)
        out = np.maximum(total - total.max(axis=1, keepdims=True), -CLIP)
        out[self.unseen[script]] = 0
        return out, familiar


def train(sample: DataFrame) -> Model:
    """Counts in one dense array per task and language, summed by bucket; the driver gets the sums."""
    size = (1 << BUCKET_BITS) + len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = _WORD.findall(text.lower())
                if words:
                    own = counts.setdefault(lang, np.zeros(size, np.int64))
                    ids, _ = gram_ids([w.encode() for w in words])
                    own += np.bincount(ids, minlength=size)
                    own[1 << BUCKET_BITS:] += np.bincount([script_of(w) for w in words], minlength=len(NAMES))
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                                             names=["lang", "bucket", "n"])

    got = (map_arrow(sample, run, "lang string, bucket int, n long").groupBy("lang", "bucket")
           .agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), size), np.int64)
    row = {name: k for k, name in enumerate(languages)}
    counts[[row[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts[:, :1 << BUCKET_BITS], counts[:, 1 << BUCKET_BITS:])


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best language of each word, for many documents at once ([word, language] scores each)."""
    out: list = [None] * len(scores)
    hard = []
    for d, s in enumerate(scores):
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best:best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack((np.zeros((1, s.shape[1])), gain)), axis=0)[:-1]
        if (gain - low).max() <= switch / 2:
            out[d] = np.full(len(s), best)
        else:
            hard.append(d)
    hard.sort(key=lambda d: -len(scores[d]))
    for group in (hard[i:i + 512] for i in range(0, len(hard), 512)):
        lengths = np.array([len(scores[d]) for d in group])
        steps, langs = lengths[0], scores[group[0]].shape[1]
        # Step t holds the documents longer than t, which come first.
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        flat = np.concatenate([scores[d] for d in group])
        at = np.cumsum(lengths) - lengths
        came = np.zeros((int(active.sum()), langs), np.int16)
        place = np.cumsum(active) - active
        value = flat[at].copy()
        for t in range(1, steps):
            k = active[t]
            top = value[:k].argmax(axis=1)
            alt = value[np.arange(k), top] - switch
            stay = value[:k] >= alt[:, None]
            came[place[t]:place[t] + k] = np.where(stay, np.arange(langs), top[:, None])
            value[:k] = np.where(stay, value[:k], alt[:, None]) + flat[at[:k] + t]
        now = value.argmax(axis=1)
        paths = np.zeros(len(flat), np.int64)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            paths[at[:k] + t] = now[:k]
            if t:
                now[:k] = came[place[t]:place[t] + k][np.arange(k), now[:k]]
        for j, d in enumerate(group):
            out[d] = paths[at[j]:at[j] + lengths[j]]
    return out


class Words:
    """What is known of the words met so far: their number, scores and letters."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.familiar = np.zeros(0, bool)

    def full(self) -> bool:
        return self.scores.size > CELLS

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if new and self.model.languages:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            scores, familiar = self.model.word_scores([w.lower() for w in new])
            self.scores = np.concatenate((self.scores, scores))
            self.familiar = np.concatenate((self.familiar, familiar))
            self.letters = np.concatenate((self.letters, np.fromiter(map(len, new), np.int64, len(new))))


def label(texts: list[str | None], known: Words, with_spans: bool = True) -> list[tuple]:
    """(language, score, spans [start, end, language] in code points) of each text."""
    languages = known.model.languages
    found = [ws if any(c.isalpha() for w in ws for c in w) else []  # such as fractions: words, but no letter
             for ws in (_WORD.findall(t) if t else [] for t in texts)]
    known.learn(set().union(*found))
    own = [d for d, ws in enumerate(found) if ws and languages]
    number = [np.fromiter(map(known.number.__getitem__, found[d]), np.int64, len(found[d])) for d in own]
    out: list[tuple] = [("und", 0.0, [])] * len(texts)
    for d, ids, path in zip(own, number, viterbi([known.scores[ids].astype(np.float64) for ids in number])):
        letters = known.letters[ids]
        share = np.bincount(path, letters, len(languages))
        best, spans = int(share.argmax()), []
        familiar = letters[known.familiar[ids] & (path == best)].sum()
        if with_spans:
            at = [m.span() for m in _WORD.finditer(texts[d])]
            edges = np.flatnonzero(np.diff(path)) + 1
            spans = [(at[a][0], at[b - 1][1], languages[path[a]])
                     for a, b in zip([0, *edges], [*edges, len(path)])]
        out[d] = languages[best], float(familiar / share.sum()), spans
    return out


def identify(docs: DataFrame, model: Model, carry: list[Column], text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """``carry`` columns plus lang, score and spans array<struct<start, end, lang>>."""
    names = docs.select(*carry).schema
    # Positions in place of names, so that no name can clash on the way.
    rows = docs.select(*[c.alias(f"c{k}") for k, c in enumerate(carry)], named(text_col).cast("string").alias("text"))
    extra = "lang string, score double" + (", spans array<struct<start: int, end: int, lang: string>>" if with_spans else "")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(extra).fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_once = max(1, CELLS // max(1, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for big in batches:
            # A text has at most half as many words as characters; 300 texts of the usual length go together.
            sizes = np.fromiter((len(t or "") // 2 + 1 for t in big.columns[-1].to_pylist()), np.int64, len(big))
            at = 0
            while at < len(big):
                count = max(1, int(np.searchsorted(np.cumsum(sizes[at:at + 300]), at_once, side="right")))
                b = big.slice(at, count)
                at += count
                if known.full():
                    known = Words(shared.value)
                got = label(b.columns[-1].to_pylist(), known, with_spans)
                cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if with_spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    cols.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in g[2]] for g in got], kind))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    out = map_arrow(rows, run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(names.fields)], *schema.names[len(carry):])
