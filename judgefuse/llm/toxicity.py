"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings (the word, its first four, five and six
characters).  An embedding starts along one direction, as long as its smoothed
log-odds among the labelled documents; buckets that fewer than ``MIN_DOCS`` of
them hold are zero, so unknown words are neutral.  Filters of several widths slide over the whole text, each is max
pooled, and a logistic layer gives the raw probability.  A threshold per
detected language is set on held-back labelled rows; scores are shifted so that
this threshold lands on ``CUT`` for every language.

Inputs of a score are the text's words only.  The fit uses a bounded sample of
labelled rows (``max_rows``, chosen by a hash of the id, half of each class);
scoring covers every row and the whole text, in tasks that share nothing but
the broadcast model, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import give_back, text_bytes
from judgefuse.llm.languages import LANGUAGES, STOP_WORDS

CUT = 0.7
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
BITS = 22       # hash buckets of the embeddings
MIN_DOCS = 3
PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


@dataclass
class Model:
    known: np.ndarray     # hash buckets with an embedding, ascending
    project: np.ndarray   # their contributions to every (filter, offset); row 0 is zero
    bias: np.ndarray      # of each filter
    out: np.ndarray       # weight of each filter
    out_bias: float
    cuts: dict            # language or "" -> threshold on the raw logit


STOP_BITS: dict[str, int] = {}
for _k, _lang in enumerate(LANGUAGES):
    for _w in STOP_WORDS[_lang]:
        STOP_BITS[_w] = STOP_BITS.get(_w, 0) | 1 << _k


def word_keys(word: bytes) -> tuple[tuple[int, ...], int]:
    """Buckets of a word and of its prefixes, and the languages it is a stop word of (bits)."""
    w = word.decode("utf-8", "replace").lower().strip(PUNCTUATION)
    if not w:
        return (-1,) * (1 + len(PREFIXES)), 0
    digest, mask = xxhash.xxh3_64_intdigest, (1 << BITS) - 1
    return (digest(w) & mask, *[digest(w[:n], n) & mask for n in PREFIXES]), STOP_BITS.get(w, 0)


class Words(dict):
    """word -> its row of buckets and stop-word bits, grown as words appear."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.stops = array("q"), array("b")

    def __missing__(self, word: bytes) -> int:
        keys, stop = word_keys(word)
        self.flat.extend(keys)
        self.stops.append(stop)
        n = self[word] = len(self)
        return n

    def keys_from(self, row: int) -> np.ndarray:
        """Buckets of the words from this row on, one row each."""
        wide = 1 + len(PREFIXES)
        return np.array(self.flat[row * wide:], dtype=np.int64).reshape(-1, wide)


def language(stops: np.ndarray) -> str:
    """The language most of whose stop words the text has; '' without any."""
    counts = [int(((stops >> k) & 1).sum()) for k in range(len(LANGUAGES))]
    best = max(range(len(counts)), key=counts.__getitem__)
    return LANGUAGES[best] if counts[best] else ""


def offsets(filters: int) -> list[tuple[int, list[int]]]:
    """For each width, the first column of every offset in the projection."""
    out, at = [], 0
    for w in WIDTHS:
        out.append((w, [at + o * filters for o in range(w)]))
        at += w * filters
    return out


def pooled(p: np.ndarray, filters: int, where: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Max over positions of every filter, and (if asked) where.  Texts shorter than a filter
    are padded with zero rows; so an empty text has zero everywhere."""
    longest = max(WIDTHS)
    if len(p) < longest:
        p = np.vstack([p, np.zeros((longest - len(p), p.shape[1]), p.dtype)])
    best, spot = [], []
    for w, cols in offsets(filters):
        n = len(p) - w + 1
        z = p[:n, cols[0]:cols[0] + filters]
        for o in range(1, w):
            z = z + p[o:o + n, cols[o]:cols[o] + filters]
        best.append(z.max(0))
        if where:
            spot.append(z.argmax(0))
    return np.concatenate(best), np.concatenate(spot) if where else None


def rows_of(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Embedding rows of hash buckets; 0 for those without one."""
    if not len(known):
        return np.zeros(keys.shape, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


def log_odds(docs: list[np.ndarray], keys: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that ``MIN_DOCS`` documents hold and their shrunken log-odds."""
    known, inv = np.unique(keys, return_inverse=True)
    inv = inv.reshape(keys.shape).astype(np.int32)
    n, hit = np.zeros(len(known)), np.zeros(len(known))
    for r, label in zip(docs, y):
        held = np.unique(inv[r])
        n[held] += 1
        hit[held] += label
    ok = (n >= MIN_DOCS) & (known >= 0)
    known, n, hit = known[ok], n[ok], hit[ok]
    p, q = (hit + 0.3) / (y.sum() + 1), (n - hit + 0.3) / ((1 - y).sum() + 1)
    return known, np.log(p / q) * n / (n + 4.0)


def train(texts: list[bytes], labels: list[int], dim: int = 12, filters: int = 4, epochs: int = 3,
          rate: float = 0.03, seed: int = 7) -> Model:
    """Adagrad on the logistic loss; gradients flow through the pooled positions only."""
    rng = np.random.default_rng(seed)
    words = Words(limit=1 << 60)
    rows = [np.fromiter(map(words.__getitem__, t.split()), np.int64) for t in texts]
    keys = words.keys_from(0) if len(words) else np.full((1, 1 + len(PREFIXES)), -1, np.int64)
    stops = np.array(words.stops or [0], dtype=np.int64)
    words.reset()  # the arrays hold what is needed
    y = np.asarray(labels, np.float32)
    held = np.array([i % 5 == 0 for i in range(len(texts))], bool)  # rows come in hash order
    fit = np.flatnonzero(~held)
    known, odds = log_odds([rows[i] for i in fit], keys, y[fit])
    keys = rows_of(known, keys)
    wide = sum(WIDTHS) * filters
    axis = np.full(dim, dim ** -0.5, np.float32)
    emb = np.zeros((len(known) + 1, dim), np.float32)
    emb[1:] = odds[:, None] * axis / keys.shape[1] + rng.normal(0, 0.02, (len(known), dim))
    conv = rng.normal(0, 0.1, (dim, wide)).astype(np.float32) + axis[:, None]
    bias = np.full(len(WIDTHS) * filters, -0.5, np.float32)
    out = rng.uniform(0.05, 0.15, len(bias)).astype(np.float32)
    out_bias = -2.0
    g_emb, g_conv = np.full(len(emb), 1e-2, np.float32), np.full(conv.shape, 1e-2, np.float32)
    g_bias, g_out, g_ob = np.full(bias.shape, 1e-2, np.float32), np.full(out.shape, 1e-2, np.float32), 1e-2
    share = max(1e-3, float(y[fit].mean())) if len(fit) else 0.5
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1e-3, 1 - share))
    cols = offsets(filters)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            r = rows[i]
            x = emb[keys[r]].sum(1) if len(r) else np.zeros((0, dim), np.float32)
            z, spot = pooled(x @ conv, filters)
            a = z + bias
            h = np.maximum(a, 0)
            s = float(h @ out) + out_bias
            d = (1 / (1 + math.exp(-max(-30, min(30, s)))) - y[i]) * weight[i]
            g_h = np.where(a > 0, d * out, 0.0).astype(np.float32)
            step = d * h
            g_out += step * step
            out -= rate * step / np.sqrt(g_out)
            g_ob += d * d
            out_bias -= rate * d / math.sqrt(g_ob)
            g_bias += g_h * g_h
            bias -= rate * g_h / np.sqrt(g_bias)
            if not len(r):
                continue
            change = np.zeros_like(conv)
            at, dx = [], []
            for k, (w, starts) in enumerate(cols):
                f = slice(k * filters, (k + 1) * filters)
                for o in range(w):
                    pos = spot[f] + o
                    ok = pos < len(r)
                    c = slice(starts[o], starts[o] + filters)
                    rows_at = np.where(ok, pos, 0)
                    g = np.where(ok, g_h[f], 0)
                    change[:, c] = (x[rows_at] * g[:, None]).T
                    at.append(rows_at)
                    dx.append(conv[:, c].T * g[:, None])
            g_conv += change * change
            conv -= rate * change / np.sqrt(g_conv)
            dx = np.concatenate(dx)
            live = np.abs(dx).sum(1) > 0
            if live.any():
                dx = np.repeat(dx[live], keys.shape[1], 0)
                k = keys[r[np.concatenate(at)[live]]].ravel()
                dx, k = dx[k > 0], k[k > 0]
                u, inv = np.unique(k, return_inverse=True)
                g = np.zeros((len(u), dim), np.float32)
                np.add.at(g, inv, dx)
                g_emb[u] += (g * g).mean(1)
                emb[u] -= rate * g / np.sqrt(g_emb[u])[:, None]
    model = Model(known, (emb @ conv).astype(np.float32), bias, out, float(out_bias), {})
    # Thresholds: per language, midway between what separates the held-back rows best.
    raw = np.array([logit(model, keys[r]) for r in rows])
    lang = [language(stops[r]) for r in rows]
    for name in ("", *LANGUAGES):
        pick = np.array([not name or x == name for x in lang], bool)
        own = pick & held
        if (y[own] > 0).sum() < 10 or (y[own] == 0).sum() < 10:
            own = pick  # few held-back rows of this language: all labelled ones
        if (y[own] > 0).any() and (y[own] == 0).any():
            model.cuts[name] = best_cut(raw[own], y[own])
    model.cuts.setdefault("", 0.0)
    return model


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The logit that gives the best F1; the middle of the widest best gap."""
    order = np.argsort(-raw, kind="stable")
    s, t = raw[order], y[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    gap = s - np.append(s[1:], s[-1] - 1)
    ok = gap > 0
    best = f1[ok].max()
    k = np.flatnonzero(ok & (f1 >= best - 1e-12))
    k = k[gap[k].argmax()]
    return float(s[k] - gap[k] / 2)


def logit(model: Model, keys: np.ndarray) -> float:
    filters = len(model.bias) // len(WIDTHS)
    p = model.project[keys].sum(1) if len(keys) else np.zeros((0, model.project.shape[1]), np.float32)
    z, _ = pooled(p, filters, where=False)
    return float(np.maximum(z + model.bias, 0) @ model.out) + model.out_bias


def score_texts(model: Model, words: Words, tables: dict, texts: list[bytes]) -> list[float]:
    """Scores of whole texts; ``tables`` keeps each known word's projection."""
    filters = len(model.bias) // len(WIDTHS)
    out = []
    for t in texts:
        if len(words) > words.limit:
            words.reset()
            tables.clear()
        r = np.fromiter(map(words.__getitem__, t.split()), np.int64)
        have = tables.get("n", 0)
        if have < len(words):
            room = tables.get("p")
            if room is None or len(room) < len(words):
                grown = np.zeros((max(1024, 2 * len(words)), model.project.shape[1]), np.float32)
                flags = np.zeros(len(grown), np.int64)
                if have:
                    grown[:have], flags[:have] = room[:have], tables["s"][:have]
                tables["p"], tables["s"] = grown, flags
            new = words.keys_from(have)
            tables["p"][have:have + len(new)] = model.project[rows_of(model.known, new)].sum(1)
            tables["s"][have:have + len(new)] = np.array(words.stops[have:], dtype=np.int64)
            tables["n"] = have + len(new)
        p = tables["p"][r] if len(r) else np.zeros((0, model.project.shape[1]), np.float32)
        z, _ = pooled(p, filters, where=False)
        s = float(np.maximum(z + model.bias, 0) @ model.out) + model.out_bias
        lang = language(tables["s"][r]) if len(r) else ""
        s -= model.cuts.get(lang, model.cuts[""]) - math.log(CUT / (1 - CUT))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
    return out


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_rows: int = 6000, seed: int = 7) -> Model:
    """Train on at most ``max_rows`` labelled rows: the first of each class by a hash
    of the key.  Labels other than 0 and 1, null keys, keys that carry both labels
    and keys without a document are left out; of repeated keys one text counts."""
    rows = (labelled.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
            .groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("y2"))
            .filter("y = y2").select("k", "y"))
    half = max_rows // 2
    picks = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(half)
        picks = part if picks is None else picks.unionByName(part)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    got = (texts.join(F.broadcast(picks), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
           .orderBy(F.xxhash64("k"), "k").collect())
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros((1, sum(WIDTHS)), np.float32), np.zeros(len(WIDTHS), np.float32),
                     np.zeros(len(WIDTHS), np.float32), 0.0, {"": CUT})
    labels, texts = [r.y for r in got], [r.t.encode() for r in got]
    del got
    model = train(texts, labels, seed=seed)
    del texts
    give_back()  # the driver goes on to other stages, beside its JVM
    return model


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` plus ``name``: 0 to 1, higher is likelier toxic, ``CUT`` or more is toxic.

    Null texts are scored as empty; repeated rows score alike; a column already
    called ``name`` is replaced; an empty table stays empty.
    """
    import pyarrow as pa

    keep = [c for c in df.columns if c.lower() != name.lower()]
    place = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        words, tables = Words(), {}
        for batch in batches:
            s = score_texts(m, words, tables, text_bytes(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*keep, name])

    return df.select(*keep).mapInArrow(run, df.select(*keep).schema.add(name, "double"))


def learnable(key: str = "doc_id"):
    """Rows whose labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1
