"""Personal data: base patterns plus a character BiLSTM-CRF.

Base patterns find email addresses, IP addresses, card numbers and phone
numbers (leftmost, non-overlapping, per kind; a match that fails its check is
dropped and not tried again). They are written so that each takes time in
proportion to the text, whatever the text.

The model: character classes -> bidirectional LSTM -> CRF over O and B/I tags
of the four kinds, in numpy. It is trained from labelled spans: windows of
the corpus around the triggers, labelled by the base patterns, some of them
varied in ways the patterns do not know (phone numbers without plus sign, in
one or two groups; spelled-out at signs and dots). At most ``KIND_WINDOWS``
that hold a kind are drawn for every kind, however rare its windows are, and
``TRAIN_WINDOWS`` without a span, in the order of a hash; windows with a spelled-out address of the
corpus itself have no sure label and are left out. Triggers are digits, at
signs and spelled-out addresses (``SPELLED``). Every text is decoded by
overlapping windows around each trigger: ``plausible`` asks every span for a
digit or an address sign with its domain, so no other window can give one. Windows
are reconciled for the whole text: a span counts in the window in which its
middle lies most centrally, must beat the reading without it by ``MARGIN``,
and spans that overlap a base span or a better one go.

An address that the model finds is widened or cut to the address form around
it, at most a window to either side.

Defined results: null and empty texts have no spans and stay as they are when
masked; a very long text is read whole, window by window; rows are treated one
by one, whatever their ids, repeated rows alike; without a training window (an
empty table too) only the base patterns apply, and an empty table gives no
rows. Columns are read by their exact names and pass as they are, so other
columns, ``base``, ``spans`` and names with dots among them, don't matter.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.llm.common import map_arrow, named, prepare, written

KINDS = ("email", "ip", "card", "phone")
_AT = r"(?: [Aa][Tt] | ?[(\[][Aa][Tt][)\]] ?)"
_DOT = r"(?:\.| [Dd][Oo][Tt] | ?[(\[][Dd][Oo][Tt][)\]] ?)"
#: The middle of a spelled-out address; Java and Python read it alike.
SPELLED = rf"[A-Za-z0-9]{_AT}[A-Za-z0-9-]+{_DOT}[A-Za-z]"
TRIGGER = rf"{SPELLED}|[0-9@]"
WINDOW, STRIDE, CONTEXT = 64, 32, 24
TRAIN_WINDOWS = 3000  # without a span
KIND_WINDOWS = 1000  # with one, for every kind
LEAST_EXAMPLES = 6000
LANES = 64
EPOCHS, BATCH, RATE = 4, 64, 0.02
EMBED, HIDDEN = 16, 24
MARGIN = 6.0
TAGS = 1 + 2 * len(KINDS)

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(TRIGGER)
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z]{2,12}")
_SPELLED = re.compile(SPELLED)
#: A whole address; looked for in the neighbourhood of a span alone, as it takes more than linear time.
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]*[A-Za-z0-9](?:@|{_AT})[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_MAILISH = re.compile(rf"[A-Za-z0-9](?:@|{_AT})[A-Za-z0-9-]+{_DOT}[A-Za-z]")


def emails(text: str) -> list[tuple[int, int]]:
    """The local part reaches left from the sign as far as its characters and the last match allow."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            out.append(("phone", *m.span()))
    return out


# ------------------------------------------------------------------ model

_PUNCT = " \n\t.,;:!?@+-_()[]/%=#*'\"<>&|$"


def char_classes(text: str) -> np.ndarray:
    """Class of every character: digits are one, letters are told apart without case."""
    return np.fromiter((_CLASS.get(c, 3 if c.isalpha() else 2) for c in text), np.int64, len(text))


_CLASS = {c: 1 for c in "0123456789"}
_CLASS |= {c: 4 + i for i, c in enumerate(_PUNCT)}
_CLASS |= {x: 4 + len(_PUNCT) + i for i in range(26) for x in (chr(97 + i), chr(65 + i))}
CLASSES = 4 + len(_PUNCT) + 26  # 0 pads, 2 is any other sign, 3 any other letter


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init_params(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)),
         "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"x{d}": rng.normal(0, 0.25, (EMBED, 4 * HIDDEN)), f"h{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)),
              f"c{d}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))}
    return {k: v.astype(np.float32) for k, v in p.items()}


#: Not allowed: an I tag after anything but B or I of its kind.
FORBIDDEN = np.array([[t and t % 2 == 0 and s not in (t - 1, t) for t in range(TAGS)] for s in range(TAGS)], bool)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states [T, batch, H] of inputs [T, batch, E]; ``keep`` gets what the gradient needs."""
    h = np.zeros((x.shape[1], HIDDEN), x.dtype)
    c = np.zeros_like(h)
    pre = x @ wx + b
    out = np.empty((*x.shape[:2], HIDDEN), x.dtype)
    for t in range(len(x)):
        z = pre[t] + h @ wh
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(z[:, 3 * HIDDEN:])
        c_old, h_old = c, h
        c = f * c_old + i * u
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, u, c_old, tc, h_old))
    return out


def _lstm_grad(x, wx, wh, keep, dout):
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, x.dtype)
    dx = np.empty_like(x)
    dh = np.zeros((x.shape[1], HIDDEN), x.dtype)
    dc = np.zeros_like(dh)
    for t in reversed(range(len(x))):
        i, f, o, u, c_old, tc, h_old = keep[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * u * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)), axis=1)
        dwx += x[t].T @ dz
        dwh += h_old.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ wx.T
        dh = dz @ wh.T
        dc = dc * f
    return dx, dwx, dwh, db


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def emissions(p: dict, classes: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Tag scores [T, batch, TAGS] of windows [batch, T]."""
    x = p["emb"][classes.T]
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = _lstm(x, p["xf"], p["hf"], p["cf"], kf)
    hb = _lstm(x[::-1], p["xb"], p["hb"], p["cb"], kb)[::-1]
    h = np.concatenate((hf, hb), axis=2)
    if keep is not None:
        keep |= {"x": x, "f": kf, "b": kb, "h": h}
    return h @ p["out"] + p["bias"]


def loss_and_grad(p: dict, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tag sequences and its gradient."""
    keep: dict = {}
    e = emissions(p, classes, keep).astype(np.float64)
    steps, n, _ = e.shape
    trans = np.where(FORBIDDEN, -1e4, p["trans"].astype(np.float64))
    start = np.where(FORBIDDEN[0], -1e4, 0.0)
    alpha = np.empty_like(e)
    alpha[0] = e[0] + start
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
    z = _logsum(alpha[-1], 1)
    beta = np.zeros_like(e)
    dtrans = np.zeros_like(trans)
    for t in range(steps - 2, -1, -1):
        ahead = trans + (e[t + 1] + beta[t + 1])[:, None, :]
        beta[t] = _logsum(ahead, 2)
        dtrans += np.exp(alpha[t][:, :, None] + ahead - z[:, None, None]).sum(axis=0)
    de = np.exp(alpha + beta - z[None, :, None])
    gold = tags.T
    rows = np.arange(n)
    score = sum(e[t, rows, gold[t]].sum() for t in range(steps)) + sum(trans[gold[t], gold[t + 1]].sum() for t in range(steps - 1))
    for t in range(steps):
        de[t, rows, gold[t]] -= 1
    np.add.at(dtrans, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    dtrans[FORBIDDEN] = 0
    de = (de / n).astype(p["out"].dtype)
    dh = de @ p["out"].T
    g = {"out": np.tensordot(keep["h"], de, ([0, 1], [0, 1])), "bias": de.sum(axis=(0, 1)), "trans": (dtrans / n).astype(p["out"].dtype)}
    dxf, g["xf"], g["hf"], g["cf"] = _lstm_grad(keep["x"], p["xf"], p["hf"], keep["f"], dh[:, :, :HIDDEN])
    dxb, g["xb"], g["hb"], g["cb"] = _lstm_grad(keep["x"][::-1], p["xb"], p["hb"], keep["b"], dh[::-1, :, HIDDEN:])
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], classes.T, dxf + dxb[::-1])
    return float((z.sum() - score) / n), g


def fit(windows: list[tuple[str, list]], epochs: int = EPOCHS, seed: int = 7) -> dict | None:
    """Parameters from (text, spans) windows by Adam.

    In double precision: machines that add up in another order then end so
    close to each other that the rounded parameters read alike.
    """
    if not windows:
        return None
    rng = np.random.default_rng(seed)
    words = [w for text, _ in windows for w in _LETTERS.findall(text)]
    again = max(1, -(-LEAST_EXAMPLES // len(windows)))  # a small table's windows serve more than once, each time varied anew
    data = [_example(*_varied(w, s, rng, words)) for _ in range(again) for w, s in windows]
    classes, tags = (np.array(x) for x in zip(*data))
    p = {k: v.astype(np.float64) for k, v in init_params(seed).items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(classes))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            _, g = loss_and_grad(p, classes[own], tags[own])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-8))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                rate = RATE * (1 - epoch / epochs)
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _varied(text: str, spans: list, rng: np.random.Generator, corpus: list[str]) -> tuple[str, list]:
    """Some windows with one form of data that the base patterns leave out."""
    for n, (kind, a, b) in enumerate(spans):
        new = None
        if kind == "phone" and rng.random() < 0.6:
            digits = "".join(_DIGITS.findall(text[a:b]))
            digits = digits[rng.integers(len(digits) - 8):]
            new = (text[a + 1:b], digits, f"{digits[:4]} {digits[4:]}")[rng.integers(3)]
        elif kind == "email" and rng.random() < 0.7:
            new = _spelled_out(corpus, *text[a:b].split("@", 1), rng)
            if len(spans) == 1 and rng.random() < 0.6:  # other neighbours, so that its ends are known by itself
                before, after = (" ".join(corpus[k].lower() for k in rng.integers(len(corpus), size=3)) if corpus else "" for _ in "ab")
                text = f"{before} {text[a:b]} {after} {text[b + 1:]}"
                a, b = len(before) + 1, len(before) + 1 + b - a
                spans = [(kind, a, b)]
        if new is not None:
            moved = len(new) - (b - a)
            shift = [(k, s + moved if s >= b else s, e + moved if e >= b else e) for k, s, e in spans]
            shift[n] = (kind, a, a + len(new))
            return text[:a] + new + text[b:], shift
    return text, spans


def _spelled_out(words: list[str], name: str, host: str, rng: np.random.Generator) -> str:
    """An address without its at sign, half of the time of the corpus's words, as it may know few hosts and names."""
    if words and rng.random() < 0.5:
        pick = lambda: words[rng.integers(len(words))].lower()
        name = pick() + ("", f".{pick()}", f"_{pick()}", f"-{pick()}", str(rng.integers(100)))[rng.integers(5)]
        host = f"{pick()}{('', f'-{pick()}', f'.{pick()}')[rng.integers(3)]}.{('com', 'org', 'net', 'de', 'edu', 'fr')[rng.integers(6)]}"
    at = (" at ", " at ", "(at)", " (at) ", " [at] ")[rng.integers(5)]
    return name + at + (host.replace(".", " dot ") if rng.random() < 0.5 else host)


def _example(text: str, spans: list) -> tuple[np.ndarray, np.ndarray]:
    classes, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    own = char_classes(text[:WINDOW])
    classes[:len(own)] = own
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        a, b = max(0, a), min(b, len(own))
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
    return classes, tags


def window_starts(text: str) -> list[tuple[int, int, int]]:
    """(start, core start, core end): overlapping windows around every trigger; cores part their regions."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        n = max(1, -(-(b - a - WINDOW) // STRIDE) + 1)
        side = (WINDOW - STRIDE) // 2
        for i in range(n):
            s = a + i * STRIDE
            out.append((s, a if i == 0 else s + side, b if i == n - 1 else s + side + STRIDE))
    return out


def decode(p: dict, classes: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
    """Spans (kind, start, end, margin over leaving the span out) of each window [batch, T]."""
    e = emissions(p, classes)
    steps, n, _ = e.shape
    trans = np.where(FORBIDDEN, np.float32(-1e4), p["trans"])
    value = e[0] + np.where(FORBIDDEN[0], np.float32(-1e4), 0)
    back = np.zeros((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        all_ = value[:, :, None] + trans
        back[t] = all_.argmax(axis=1)
        value = all_.max(axis=1) + e[t]
    tags = np.empty((steps, n), np.int64)
    tags[-1] = value.argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t, rows, tags[t]]
    out: list[list] = [[] for _ in range(n)]
    for w in np.flatnonzero(tags.any(axis=0)):
        own = tags[:, w]
        t = 0
        while t < steps:
            if own[t] == 0:
                t += 1
                continue
            a, k = t, (own[t] - 1) // 2
            t += 1
            while t < steps and own[t] == 2 + 2 * k:
                t += 1
            path = own[a:t]
            gain = (e[np.arange(a, t), w, path] - e[a:t, w, 0]).sum() + trans[path[:-1], path[1:]].sum() - (t - a - 1) * trans[0, 0]
            out[w].append((KINDS[k], a, t, float(gain)))
    return out


def model_spans(texts: list[str], p: dict | None, batch: int = 512) -> list[list[tuple[str, int, int, float]]]:
    """Reconciled spans of whole texts."""
    out: list[list] = [[] for _ in texts]
    if p is None:
        return out

    def flush(held: list) -> None:
        for (d, s, lo, hi, _), spans in zip(held, decode(p, np.array([h[4] for h in held]))):
            size = len(texts[d])
            for kind, a, b, gain in spans:
                a, b = s + a, min(s + b, size)
                if gain >= MARGIN and 2 * lo <= a + b < 2 * hi and plausible(kind, texts[d][a:b]):
                    if kind == "email":
                        a, b = whole_address(texts[d], a, b)
                    out[d].append((kind, a, b, gain))

    held = []
    for d, text in enumerate(texts):
        for s, lo, hi in window_starts(text):
            classes = np.zeros(WINDOW, np.int64)
            own = char_classes(text[s:s + WINDOW])
            classes[:len(own)] = own
            held.append((d, s, lo, hi, classes))
            if len(held) == batch:
                flush(held)
                held = []
    if held:
        flush(held)
    return out


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The address that a span of the model holds or is part of, at most WINDOW characters to either side."""
    low = max(0, a - WINDOW)
    for m in _ADDRESS.finditer(text, low, min(len(text), b + WINDOW)):
        if m.start() < b and a < m.end():
            return m.span()
    return a, b


def plausible(kind: str, span: str) -> bool:
    """What any form of the kind must show: what the tags cannot count."""
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    if kind == "email":
        return bool(_MAILISH.search(span))
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in span)


def all_spans(texts: list[str], p: dict | None) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text, by kind, then start."""
    out = []
    for text, more in zip(texts, model_spans(texts, p)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b, _ in sorted(more, key=lambda s: -s[3]):
            if not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                added.append((kind, a, b))
        out.append((base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


# ------------------------------------------------------------------ Spark

def _texts(docs: DataFrame, text_col: str) -> Column:
    """The text where a span is possible, else null: Python need not see the rest."""
    text = named(text_col).cast("string")
    return F.when(has_trigger(text), text)


def has_trigger(text: Column) -> Column:
    """Whether TRIGGER is found; the long pattern is tried only where an "at" stands by itself."""
    return text.rlike("[0-9@]") | (text.rlike(r"[ (\[][Aa][Tt][ )\]]") & text.rlike(SPELLED))


def training_windows(docs: DataFrame, text_col: str = "text", most: int = TRAIN_WINDOWS, each: int = KIND_WINDOWS) -> list[tuple[str, list]]:
    """Distinct windows with their base spans: of those that hold a kind at most ``each``, for every kind,
    and at most ``most`` without a span, all in the order of a hash.

    A task hands on its own first ones only, so what is gathered is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[str, dict] = {k: {} for k in ("", *KINDS)}

        def cut(k: str) -> None:
            held[k] = dict(sorted(held[k].items(), key=lambda x: (x[1], x[0]))[:each if k else most])

        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                starts = [s for s, _, _ in window_starts(text)]
                spelled = [m.span() for m in _SPELLED.finditer(text)]
                for s in starts:
                    own = [[k, a - s, e - s] for k, a, e in spans if a >= s and e <= s + WINDOW]
                    cuts = any(a < s < e or a < s + WINDOW < e for _, a, e in spans)
                    unsure = any(a < s + WINDOW and s < e for a, e in spelled)
                    if cuts or unsure:  # a span that the window cuts would teach its edge wrongly
                        continue
                    row = (text[s:s + WINDOW], ";".join(f"{k}:{a}:{e}" for k, a, e in own))
                    for k in {k for k, _, _ in own} or {""}:
                        held[k][row] = xxhash.xxh64_intdigest(row[0].encode(), 42)
                        if len(held[k]) >= 4 * (each if k else most) + 1000:
                            cut(k)
        for k in held:
            cut(k)
        out = [(k, *row, h - (1 << 64) if h >> 63 else h) for k, own in held.items() for row, h in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                                         names=["kind", "window", "spans", "h"])

    got = written(map_arrow(docs.select(_texts(docs, text_col).alias("text")).filter(F.col("text").isNotNull()),
                            run, "kind string, window string, spans string, h long").distinct(), "pii-windows")
    # The same order as in the tasks: unsigned hash, window, spans. Every task sends its first windows of a kind, so
    # they are cut in parts first: no task gets more of a kind than LANES times what is kept, however many tasks there are.
    # A literal bound lets Spark cut before it shuffles.
    kept = []
    for bound, own in ((most, F.col("kind") == ""), (each, F.col("kind") != "")):
        part = got.filter(own).withColumn("lane", F.pmod(F.xxhash64("window"), F.lit(LANES)))
        for by in (["kind", "lane"], ["kind"]):
            place = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("h") < 0), "h", "window", "spans"))
            part = part.withColumn("place", place).filter(F.col("place") <= bound)
        kept.append(part)
    rows = (kept[0].unionByName(kept[1]).groupBy("window").agg(F.max("spans").alias("spans"), F.first("h").alias("h")).orderBy("h", "window").collect())
    return [(r["window"], [(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r["spans"].split(";") if x)]) for r in rows]


SPANS = ", ".join(f"{c} array<struct<kind: string, start: int, end: int>>" for c in ("base", "spans"))


def find(docs: DataFrame, params: dict | None, carry: list[Column], text_col: str = "text") -> DataFrame:
    """``carry`` columns plus base and spans (both array<struct<kind, start, end>>)."""
    names = docs.select(*carry).schema
    # Positions in place of names, so that no name can clash on the way.
    rows = docs.select(*[c.alias(f"c{k}") for k, c in enumerate(carry)], _texts(docs, text_col).alias("text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(SPANS).fields])
    shared = docs.sparkSession.sparkContext.broadcast(params)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 2000):
                b = big.slice(at, 2000)
                got = all_spans([t or "" for t in b.columns[-1].to_pylist()], shared.value)
                cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[k]] for g in got], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    out = map_arrow(rows, run, schema)
    return out.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(names.fields)], "base", "spans")


def mask(text: str | None, spans: list) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its kind in angle brackets."""
    if text is None or not spans:
        return text
    out, end, open_end = [], 0, -1
    for kind, a, b in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda s: (s[1], -s[2])):
        if a < open_end:
            end = open_end = max(open_end, b)
            continue
        out += [text[end:a], f"<{kind.upper()}>"]
        end = open_end = b
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text_col: str = "text", most: int = TRAIN_WINDOWS) -> DataFrame:
    """``docs`` with personal data masked in the texts; the model is trained on ``docs`` itself."""
    params = fit(training_windows(docs, text_col, most))
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(text):
        import pandas as pd

        own = [t for t in text.tolist() if t]
        spans = [g[1] for i in range(0, len(own), 2000) for g in all_spans(own[i:i + 2000], shared.value)]
        keys = ("kind", "start", "end")
        done = iter([mask(t, [dict(zip(keys, x)) for x in found]) for t, found in zip(own, spans)])
        return pd.Series([next(done) if t else None for t in text.tolist()], dtype=object)

    prepare(docs.sparkSession)
    masked = F.pandas_udf(run, "string")
    text = named(text_col)
    # One pass over the rows; texts without a trigger go to Python as null and stay what they are.
    return docs.select(*[F.coalesce(masked(_texts(docs, text_col)), text).alias(c) if c == text_col else named(c) for c in docs.columns])
