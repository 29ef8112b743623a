"""Language of documents and of their segments, by a bidirectional GRU over bytes.

The network reads bytes in both directions and labels every position; it is
trained here, in NumPy, by backpropagation through time, on a bounded sample of
labelled documents (``PER_LANGUAGE`` documents of each language, the first by hash of
the id).  A position sees the word it stands in and both neighbours; a word of more
than ``PIECE`` bytes is read as several pieces, each with its neighbours, so every
position is labelled.  A word's probabilities are the mean over its positions, a
sentence's those of its words, and a document's the shares of its sentences.  Equal (word, neighbours) windows
are computed once per task, so the cost follows the vocabulary, not the length.

Only prose is labelled: fenced blocks, lines that are mostly code punctuation,
inline code, and words with digits, underscores or inner capitals are left out.

Edge cases: null, empty or prose-free texts have no languages (shares are empty,
language null, confidence 0) and are not dropped from ``identify``; ties go to the
first of en, de, fr, es; repeated rows give repeated results; a table without any
usable label cannot train the network and raises ValueError, unless it is empty.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.llm.textarrays import chunks, mix, run_hashes, utf8
from corposcope.session import spread

LANGS = ("en", "de", "fr", "es")
PER_LANGUAGE = 400  #: labelled documents of each language that train the network
HIDDEN, EMBED, PIECE = 20, 12, 22
REACH = 3 * PIECE + 2  #: bytes of a window: a word and both neighbours
#: Usual spellings of the four languages' labels, without region. Fixed values.
SPELLINGS = {"en": ("en", "eng", "english", "anglais", "englisch", "ingles", "inglés"),
             "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "aleman", "alemán"),
             "fr": ("fr", "fra", "fre", "french", "francais", "français", "franzosisch", "französisch", "frances", "francés"),
             "es": ("es", "spa", "spanish", "espanol", "español", "spanisch", "espagnol", "castellano")}


def label(raw: Column) -> Column:
    """Language code of a label in any usual spelling or region, else null."""
    base = F.lower(F.regexp_extract(F.trim(raw), r"^([\p{L}]+)(?:[-_.@ ].*)?$", 1))
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(base.isin(*names), code).otherwise(out)
    return out


# ---- the network -------------------------------------------------------------------------------------------------

def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Gru:
    """One direction. Inputs are embedding rows; all gates' input products are one table lookup."""

    NAMES = ("W", "U", "b")

    def __init__(self, rng, n_in: int, n: int):
        self.n = n
        self.W = (rng.standard_normal((n_in, 3 * n)) / np.sqrt(n_in)).astype(np.float32)
        self.U = (rng.standard_normal((n, 3 * n)) / np.sqrt(n)).astype(np.float32)
        self.b = np.zeros(3 * n, np.float32)

    def run(self, xw, mask, keep=False):
        """xw: [T, B, 3n] input products; mask: [T, B, 1]. Returns states [T, B, n] and what backward needs."""
        n, (t, b, _) = self.n, xw.shape
        h = np.zeros((b, n), np.float32)
        hs, saved = np.empty((t, b, n), np.float32), []
        for i in range(t):
            hu = h @ self.U
            zr = _sigmoid(xw[i, :, :2 * n] + hu[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(xw[i, :, 2 * n:] + r * hu[:, 2 * n:])
            new = c + z * (h - c)
            if keep:
                saved.append((h, z, r, c, hu[:, 2 * n:]))
            h = h + mask[i] * (new - h)
            hs[i] = h
        return hs, saved

    def back(self, dhs, mask, saved):
        """Backpropagation through time: gradients of xw and U."""
        n, (t, b, _) = self.n, dhs.shape
        dxw, dU = np.empty((t, b, 3 * n), np.float32), np.zeros_like(self.U)
        dh = np.zeros((b, n), np.float32)
        for i in range(t - 1, -1, -1):
            h, z, r, c, hc = saved[i]
            dh = dh + dhs[i]
            dn = dh * mask[i]
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dxw[i] = np.concatenate((dz, dr, dc), 1)
            dhu = np.concatenate((dz, dr, dc * r), 1)
            dU += h.T @ dhu
            dh = dh * (1 - mask[i]) + dn * z + dhu @ self.U.T
        return dxw, dU


class Tagger:
    """Byte embedding, a GRU in each direction, and a softmax over languages at every position."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = (rng.standard_normal((256, EMBED)) * 0.3).astype(np.float32)
        self.f, self.g = Gru(rng, EMBED, HIDDEN), Gru(rng, EMBED, HIDDEN)
        self.V = (rng.standard_normal((2 * HIDDEN, len(LANGS))) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.c = np.zeros(len(LANGS), np.float32)

    def parameters(self):
        return [self.E, self.f.W, self.f.U, self.f.b, self.g.W, self.g.U, self.g.b, self.V, self.c]

    def forward(self, x, mask, keep=False):
        tf, tg = self.E @ self.f.W + self.f.b, self.E @ self.g.W + self.g.b
        hf, sf = self.f.run(tf[x], mask, keep)
        hg, sg = self.g.run(tg[x[::-1]], mask[::-1], keep)
        h = np.concatenate((hf, hg[::-1]), 2)
        logit = h @ self.V + self.c
        logit -= logit.max(2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(2, keepdims=True)
        return p, h, sf, sg

    def gradients(self, x, mask, y):
        p, h, sf, sg = self.forward(x, mask, keep=True)
        d = p.copy()
        d[:, np.arange(y.size), y] -= 1
        d *= mask / mask.sum()
        flat, df = h.reshape(-1, h.shape[2]), d.reshape(-1, d.shape[2])
        dV, dc = flat.T @ df, df.sum(0)
        dh = d @ self.V.T
        dxf, dUf = self.f.back(dh[:, :, :HIDDEN], mask, sf)
        dxg, dUg = self.g.back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), mask[::-1], sg)
        ef, eg = self.E[x].reshape(-1, EMBED), self.E[x[::-1]].reshape(-1, EMBED)
        xf, xg = dxf.reshape(-1, 3 * HIDDEN), dxg.reshape(-1, 3 * HIDDEN)
        dE = np.zeros_like(self.E)
        np.add.at(dE, x.ravel(), xf @ self.f.W.T)
        np.add.at(dE, x[::-1].ravel(), xg @ self.g.W.T)
        loss = -np.log(np.maximum(p[:, np.arange(y.size), y], 1e-9))[..., None] * mask
        return float(loss.sum() / mask.sum()), [dE, ef.T @ xf, dUf, xf.sum(0), eg.T @ xg, dUg, xg.sum(0), dV, dc]

    def words(self, texts: np.ndarray, sizes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """[N, languages]: mean probability over the positions [begin, end) of each window."""
        out = np.empty((sizes.size, len(LANGS)), np.float32)
        order = np.argsort(sizes, kind="stable")
        for a in range(0, order.size, 2048):
            rows = order[a:a + 2048]
            t = int(sizes[rows].max())
            x = texts[rows, :t].T
            at = np.arange(t)[:, None]
            p = self.forward(x, (at < sizes[rows]).astype(np.float32)[:, :, None])[0]
            own = ((at >= begin[rows]) & (at < end[rows])).astype(np.float32)[:, :, None]
            out[rows] = (p * own).sum(0) / np.maximum(own.sum(0), 1)
        return out


def train(texts: np.ndarray, sizes: np.ndarray, y: np.ndarray, *, batches: int = 320, size: int = 384,
          rate: float = 0.01, seed: int = 7) -> Tagger:
    """Adam (Kingma & Ba 2015) on random windows; labels that the half-trained network rejects are then left out."""
    net, rng = Tagger(seed), np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    pools = [np.flatnonzero(y == k) for k in range(len(LANGS)) if (y == k).any()]
    keep = np.ones(y.size, bool)
    for step in range(1, batches + 1):
        if step == batches // 2:
            p = net.words(texts, sizes, np.zeros_like(sizes), sizes)
            keep = p[np.arange(y.size), y] > 0.2
            pools = [q for q in (pool[keep[pool]] for pool in pools) if q.size]
        rows = np.concatenate([rng.choice(pool, size // len(pools)) for pool in pools])
        t = int(sizes[rows].max())
        mask = (np.arange(t)[:, None] < sizes[rows]).astype(np.float32)[:, :, None]
        _, grads = net.gradients(texts[rows, :t].T, mask, y[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1, 2 * (1 - step / (batches + 1)))
        for k, (p, g) in enumerate(zip(net.parameters(), grads)):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# ---- prose words and their windows -------------------------------------------------------------------------------

def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789_")
_HIGH = np.arange(256) >= 128
_WORD = _UPPER | _class(bytes(range(97, 123))) | _DIGIT | _HIGH
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = _class(b".!?\n\r")
_CODE = _class(b"{}();=<>_|&[]\\")
_SPACE = _class(b" \t\r\n")


def _pieces(start: np.ndarray, end: np.ndarray, h: np.ndarray, doc: np.ndarray):
    """The same words, with those of more than ``PIECE`` bytes cut into pieces of equal words and place."""
    n = np.maximum(1, -(-(end - start) // PIECE))
    if n.size == 0 or n.max() == 1:
        return start, end, h, doc
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(start, n) + k * PIECE
    return begin, np.minimum(begin + PIECE, np.repeat(end, n)), np.where(k > 0, mix(np.repeat(h, n) + k.astype(np.uint64)), np.repeat(h, n)), np.repeat(doc, n)


class Prose:
    """Prose words of a run of documents: positions, hashes, document and sentence numbers."""

    def __init__(self, flat: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        joined = np.full(flat.size + n + 4, 10, np.uint8)  # a line end after each document
        if flat.size:
            joined[np.arange(flat.size) + np.repeat(np.arange(n), np.diff(off))] = flat
        self.low = low = _LOWER[joined]
        base = off + np.arange(n + 1)
        start, end, hashes = run_hashes(low, _WORD[joined])
        count = lambda cls: np.r_[0, np.cumsum(cls[joined], dtype=np.int32)]
        digit, upper = count(_DIGIT), count(_UPPER)
        name = (digit[end] > digit[start]) | (upper[end] > upper[np.minimum(start + 1, end)])
        before, after, then = joined[start - 1], joined[end], joined[end + 1]
        before[start == 0] = 10
        inline = (before == 96) | (after == 96) | (after == 40) | (before == 47) | (after == 47) | (before == 46) & (start > 1) \
            & _WORD[joined[np.maximum(start - 2, 0)]] | (after == 46) & _WORD[then]
        newline = np.flatnonzero((joined == 10) | (joined == 13))
        line = np.searchsorted(newline, start)
        edges = np.r_[0, newline + 1]
        code, space = count(_CODE), count(_SPACE)
        stop_at = np.r_[newline, joined.size]
        ink = np.maximum(stop_at - edges - (space[stop_at] - space[edges]), 1)
        coded = (code[stop_at] - code[edges]) > 0.15 * ink
        tick = np.flatnonzero((joined[:-2] == 96) & (joined[1:-1] == 96) & (joined[2:] == 96))
        fence = np.zeros(edges.size, np.int32)
        fence[np.searchsorted(newline, tick)] = 1
        fences = np.r_[0, np.cumsum(fence)]
        doc = np.searchsorted(base, start, side="right") - 1
        first_line = np.searchsorted(newline, base[:-1])
        inside = ((fences[line] - fences[first_line[np.minimum(doc, n - 1)]]) % 2 == 1) | (fence[line] == 1) if n else np.zeros(0, bool)
        ok = ~(name | inline | coded[line] | inside) & (doc < n)
        self.start, self.end, self.hash, self.doc = _pieces(start[ok], end[ok], hashes[ok], doc[ok])
        stop = count(_STOP)
        cut = np.ones(self.start.size, bool)
        cut[1:] = (stop[self.start[1:]] > stop[self.end[:-1]]) | (self.doc[1:] != self.doc[:-1])
        self.cut, self.sentence = cut, np.cumsum(cut) - 1
        tail = np.r_[0, np.cumsum((joined & 0xC0) == 0x80, dtype=np.int32)]
        self.chars = self.end - self.start - (tail[self.end] - tail[self.start])
        self.base = base

    def windows(self):
        """(hash, previous, next) per word; -1 where a neighbour is in another sentence."""
        n = self.start.size
        i = np.arange(n)
        prev, nxt = np.where(self.cut, -1, i - 1), np.full(n, -1)
        nxt[:-1] = np.where(self.cut[1:], -1, i[1:])
        h = np.r_[self.hash, np.uint64(0)]
        k = mix(h[prev] * np.uint64(3) + mix(h[:-1]) + h[nxt] * np.uint64(0x9E3779B97F4A7C15)) if n else np.zeros(0, np.uint64)
        return k, prev, nxt

    def text(self, rows, prev, nxt):
        """(bytes [N, REACH], sizes, begin, end): the window of each row, its own word at [begin, end)."""
        out = np.full((rows.size, REACH), 32, np.uint8)
        sizes, begin, end = (np.zeros(rows.size, np.int64) for _ in range(3))
        at = np.zeros(rows.size, np.int64)
        for part, most in ((prev, PIECE), (rows, PIECE), (nxt, PIECE)):
            have = np.flatnonzero(part >= 0)
            w = part[have]
            size = np.minimum(self.end[w] - self.start[w], most)
            src = self.start[w] + np.where(part is prev, self.end[w] - self.start[w] - size, 0)
            col = np.arange(most)
            fill = col < size[:, None]
            r = np.broadcast_to(have[:, None], fill.shape)[fill]
            out[r, (at[have][:, None] + col)[fill]] = self.low[(src[:, None] + col)[fill]]
            if part is rows:
                begin, end = at.copy(), at + size
            at[have] += size
            if part is not nxt:
                at[have] += 1
        sizes = np.minimum(at, REACH)
        return out, sizes, begin, end


class Cache:
    """Window hash -> probabilities, kept for a task; started afresh beyond ``most`` entries."""

    def __init__(self, net: Tagger, most: int = 2_000_000):
        self.net, self.most = net, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(LANGS)), np.float32)

    def __call__(self, prose: Prose) -> np.ndarray:
        k, prev, nxt = prose.windows()
        unique, first, inverse = np.unique(k, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(unique.size, bool)
        inside = at < self.keys.size
        known[inside] = self.keys[at[inside]] == unique[inside]
        p = np.empty((unique.size, len(LANGS)), np.float32)
        p[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            rows = first[new]
            p[new] = self.net.words(*prose.text(rows, prev[rows], nxt[rows]))
            if self.keys.size + new.size > self.most:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(LANGS)), np.float32)
            keys, values = np.r_[self.keys, unique[new]], np.concatenate((self.values, p[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
        return p[inverse.ravel()]


# ---- documents ---------------------------------------------------------------------------------------------------

def _sentences(prose: Prose, p: np.ndarray):
    """(document, characters, language, confidence, first word, last word) of each sentence."""
    at = np.flatnonzero(prose.cut)
    if not at.size:
        return (np.zeros(0, np.int64),) * 6
    score = np.add.reduceat(np.log(np.maximum(p, 1e-4)).astype(np.float64) * np.sqrt(prose.chars)[:, None], at)
    score -= score.max(1, keepdims=True)
    q = np.exp(score)
    q /= q.sum(1, keepdims=True)
    chars = np.add.reduceat(prose.chars, at)
    last = np.r_[at[1:], prose.start.size] - 1
    return prose.doc[at], chars, q.argmax(1), q.max(1), at, last


def _document_rows(net: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(net)
        for batch in batches:
            _, whole = utf8(batch.column(1))
            for a, b in chunks(whole):
                flat, off = utf8(batch.column(1).slice(a, b - a))
                prose = Prose(flat, off)
                doc, chars, lang, sure, _, _ = _sentences(prose, cache(prose))
                n, k = b - a, len(LANGS)
                by = np.bincount(doc * k + lang, weights=chars, minlength=n * k).reshape(n, k)
                trust = np.bincount(doc * k + lang, weights=chars * sure, minlength=n * k).reshape(n, k)
                total = by.sum(1)
                share = by / np.maximum(total, 1)[:, None]
                main = by.argmax(1)
                conf = trust[np.arange(n), main] / np.maximum(by[np.arange(n), main], 1e-9) * (total > 0)
                names = pa.array([LANGS[m] if t else None for m, t in zip(main, total)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), names, pa.array(np.where(total > 0, share[np.arange(n), main], 0.0)), pa.array(conf),
                     pa.array(total.astype(np.int64)), *[pa.array(share[:, j]) for j in range(k)]],
                    ["doc_id", "lang", "share", "confidence", "prose_chars", *LANGS])
    return run


def _segment_rows(net: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(net)
        for batch in batches:
            _, whole = utf8(batch.column(1))
            for a, b in chunks(whole):
                flat, off = utf8(batch.column(1).slice(a, b - a))
                prose = Prose(flat, off)
                doc, chars, lang, sure, first, last = _sentences(prose, cache(prose))
                if not doc.size:
                    continue
                at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])
                end = np.r_[at[1:], doc.size] - 1
                size = np.add.reduceat(chars, at)
                conf = np.add.reduceat(chars * sure, at) / np.maximum(size, 1)
                d = doc[at]
                number = np.arange(at.size) - np.searchsorted(d, d)
                ids = batch.column(0).slice(a, b - a).take(pa.array(d))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number.astype(np.int32)), pa.array(prose.start[first[at]] - prose.base[d]),
                     pa.array(prose.end[last[end]] - prose.base[d]), pa.array([LANGS[x] for x in lang[at]]),
                     pa.array(conf), pa.array(size.astype(np.int64))],
                    ["doc_id", "segment", "begin", "finish", "lang", "confidence", "prose_chars"])
    return run


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *,
        per_language: int = PER_LANGUAGE) -> Tagger:
    """Train on at most ``per_language`` documents of each language, the first by hash of their id."""
    i = F.col(id_col)
    named = documents.select(i.alias("i"), F.xxhash64(i).alias("k"), label(F.col(label_col)).alias("y"), F.col(text_col).alias("t")).where("y is not null and i is not null")
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        if documents.isEmpty():
            return Tagger()
        raise ValueError("no document has a label of a known language")
    # A threshold on the hash, a little above the share that is wanted, keeps what reaches the driver to the sample.
    below = F.lit(False)
    for y, n in counts.items():
        part = min(1.0, 1.4 * per_language / n)
        below = below | (F.col("y") == y) & (F.col("k") <= F.lit(min(2**63 - 1, round((2 * part - 1) * 2.0**63))))
    some = named.where(below).groupBy("i").agg(F.min("k").alias("k"), F.min("y").alias("y"), F.min("t").alias("t")).collect()
    rows = [r for y in LANGS for r in sorted((r for r in some if r["y"] == y), key=lambda r: (r["k"], r["i"]))[:per_language]]
    rows.sort(key=lambda r: r["i"])
    picked = {r["i"]: r["y"] for r in rows}
    texts = pa.array([r["t"] or "" for r in rows], pa.string())
    flat, off = utf8(texts)
    prose = Prose(flat, off)
    if not prose.start.size:
        raise ValueError("no labelled document holds prose")
    k, prev, nxt = prose.windows()
    y = np.array([LANGS.index(picked[r["i"]]) for r in rows])[prose.doc]
    _, first = np.unique(k + y.astype(np.uint64), return_index=True)
    x, sizes, _, _ = prose.text(first, prev[first], nxt[first])
    return train(x, sizes, y[first])


def identify(documents: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, share, confidence, prose_chars, en, de, fr, es): one row per input row."""
    schema = ("doc_id long, lang string, share double, confidence double, prose_chars long, "
              + ", ".join(f"{x} double" for x in LANGS))
    return spread(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(_document_rows(net), schema)


def segments(documents: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment, begin, finish, lang, confidence, prose_chars): runs of sentences of one language.

    ``begin`` and ``finish`` are byte positions in the UTF-8 text.
    """
    schema = "doc_id long, segment int, begin long, finish long, lang string, confidence double, prose_chars long"
    return spread(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(_segment_rows(net), schema)


def mislabelled(documents: DataFrame, net: Tagger, *, fifth: float = 0.2) -> DataFrame:
    """(doc_id, lang): languages of documents whose label is missing, unknown or wrong, and of mixed documents."""
    schema = "doc_id long, given string, main string, " + ", ".join(f"{x} double" for x in LANGS)
    core = _document_rows(net)

    def run(batches):
        def halves(bs):
            for b in bs:
                given.append(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "text"])
        given: list = []
        left = None
        for out in core(halves(batches)):
            while left is None or len(left) == 0:  # empty batches give no rows
                left = given.pop(0)
            yield pa.RecordBatch.from_arrays([out.column(0), left.slice(0, out.num_rows), out.column(1), *[out.column(5 + j) for j in range(len(LANGS))]],
                                             ["doc_id", "given", "main", *LANGS])
            left = left.slice(out.num_rows)

    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", label(F.col("lang")).alias("given"))).mapInArrow(run, schema)
    held = F.filter(F.array(*[F.when(F.col(x) >= fifth, F.lit(x)) for x in LANGS]), lambda x: x.isNotNull())
    return (rows.withColumn("held", held)
                .where(F.col("given").isNull() | (F.size("held") > 1) | (F.col("given") != F.col("main")))
                .select("doc_id", F.explode("held").alias("lang")).distinct())
