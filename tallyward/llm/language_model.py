"""Language-model scoring: a causal self-attention model over subword ids, trained and applied in numpy.

Words become subword ids of a public byte-level tokenizer, and ids become classes: frequent ids are
one each, the others share classes of about equal weight; ids that begin a word and ids inside words never
share a class. One attention layer predicts the class of the next id from the ids before it; the share of
an id in its class follows corpus counts. Inside a word, the prediction is mixed with counts of what
followed the same beginning of a word (another id, or the next word), the more of it the surer they are (the most
frequent counts are broadcast, the others joined);
which word comes next is the attention's alone. So the model is a proper distribution over sequences of ids
and one end, and scores whole texts. Texts are scored
in overlapping windows of two blocks: each window scores its second block, with the first as context,
so every token is scored once, with between one block and two of context, in batched matrix
products under a causal mask.

Counts of words, subwords and what follows the beginnings of words come from all training texts. The weights start from a fit on a
fixed number of distinct texts (WARM_DOCS) and are then refined by every task on all tokens of all training
texts it holds, in rows of two blocks; the refined weights are averaged by tokens seen.

Null text is an empty text, which is its end alone. A null id is no training row. Repeated rows are
scored each. Without training rows the base is uniform over one type and the model stays at its
start. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import CHUNK_BYTES, Scratch, Words, chunks, ragged, table
from tallyward.llm.quality import fold

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split of text before byte pairs are merged; words hold no white space, so letters, digits and the rest.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
VOCABULARY, END = 50257, 50256
#: Classes (the last pads), of them one id each for so many; block of scored tokens; width of the model.
CLASSES, SINGLE, BLOCK, WIDTH = 128, 111, 16, 16
WARM_DOCS = 1500
#: Words whose counts are broadcast; the counts of all others are joined.
COMMON = 1 << 18
#: Beginnings of words with what follows, as broadcast; beyond it, the rarest are joined.
FOLLOWERS = 1 << 19
NEXT_WORD = VOCABULARY
#: In place of a follower: rows of texts and of words.
TEXT, WORD = -2, -1
#: What a task holds of its own: words and ids of the tokenizer's cache; counts before they are summed; rows that it sends at a time.
KNOWN, POOL, HELD, SENT = 1 << 18, 1 << 20, 2_000_000, 1 << 16
#: The least chance of an id.
LEAST = 1e-35
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- subword ids ------------------------------------------------------------------------------------


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Spelling:
    """Shares of what follows the beginnings of words: own is what counts say of a follower, left what they leave to the attention.

    begin and rest: beginnings with all their followers here, and what they leave; a follower that is not here then has no count.
    """

    def __init__(self, key: np.ndarray, own: np.ndarray, left: np.ndarray, begin: np.ndarray, rest: np.ndarray):
        by, by2 = np.argsort(key), np.argsort(begin)
        self.key, self.shares = key[by], np.stack([own, left], 1).astype(np.float32)[by]
        self.begin, self.rest = begin[by2], rest[by2].astype(np.float32)

    @staticmethod
    def of(begin: np.ndarray, follower: np.ndarray, n: np.ndarray, c: np.ndarray | None = None, t: np.ndarray | None = None) -> Spelling:
        """From counts: a beginning seen c times with t followers leaves t of c + t (c and t of each row; where not given, all followers are here)."""
        begin = begin.astype(np.int64).view(np.uint64)
        u, first, back = np.unique(begin, return_index=True, return_inverse=True)
        here = np.bincount(back, minlength=len(u))
        if c is None:
            c, t = np.bincount(back, n, len(u))[back], here[back]
        left = t / (c + t)
        whole = here == t[first]
        return Spelling(_mix(begin, follower), n / (c + t), left, u[whole], left[first][whole])

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of wanted are among keys, and where."""
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[i] == wanted
        return hit, i[hit]

    def __call__(self, begin: np.ndarray, follower: np.ndarray) -> np.ndarray:
        out = np.tile(np.float32([0, 1]), (len(begin), 1))
        hit, at = self._find(self.begin, begin)
        out[hit, 1] = self.rest[at]
        hit, at = self._find(self.key, _mix(begin, follower))
        out[hit] = self.shares[at]
        return out


def word_starts(path: str) -> np.ndarray:
    """Which ids begin a word or end a text."""
    with open(path, "rb") as f:
        starts = [int(i) for b, i in map(bytes.split, f) if base64.b64decode(b)[:1] == b" "]
    out = np.zeros(VOCABULARY, bool)
    out[[*starts, END]] = True
    return out


_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text; a process reads the tokenizer once."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[path]


class Subwords:
    """Ids of texts, word by word; words met before come from a cache of KNOWN words and POOL ids, as far as the texts of one call fit."""

    def __init__(self, path: str, spelling: Spelling | None = None):
        self.spelling, self.encode = spelling, encoder(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of known words, in order
        self.place = np.zeros(0, np.int32)  # of each: which known word it is
        self.spans = np.zeros((0, 2), np.int32)  # of each known word: first place in pool, number of ids
        self.pool = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.uint64)  # the word up to each id of the pool
        self.whole = np.zeros(0, np.uint64)  # each known word
        self.inside, self.after = np.zeros((0, 2), np.float32), np.zeros((0, 2), np.float32)  # shares by spelling: of each id of the pool, of a next word

    def _learn(self, new: list[str]) -> None:
        found = [self.encode(x) for x in new]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        spans = np.stack([len(self.pool) + np.cumsum(lens) - lens, lens], 1)
        self.spans = np.concatenate([self.spans, spans.astype(np.int32)])
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))
        self.pool = np.concatenate([self.pool, ids])
        first, begins, whole = np.cumsum(lens) - lens, np.zeros(len(ids), np.uint64), np.zeros(len(lens), np.uint64)
        left, k = np.arange(len(lens)), 0
        while len(left := left[lens[left] > k]):
            at = first[left] + k
            begins[at] = whole[left]
            whole[left] = _mix(whole[left], ids[at] + 1)
            k += 1
        self.begins, self.whole = np.concatenate([self.begins, begins]), np.concatenate([self.whole, whole])
        if self.spelling:
            self.inside = np.concatenate([self.inside, self.spelling(begins, ids)])
            self.after = np.concatenate([self.after, self.spelling(whole, np.full(len(whole), NEXT_WORD))])

    def _words(self, texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words of texts, the known words among them, which each word is, and how often each occurs."""
        w = Words(texts)
        if len(self.known) > KNOWN or len(self.pool) > POOL:
            self._clear()
        u, first, back, times = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
        where, at = np.searchsorted(self.known, u), np.zeros(len(u), np.int64)
        seen = where < len(self.known)
        seen[seen] = self.known[where[seen]] == u[seen]
        at[seen] = self.place[where[seen]]
        if len(new := np.flatnonzero(~seen)):
            at[new] = len(self.known) + np.arange(len(new))
            self.known, self.place = np.insert(self.known, where[new], u[new]), np.insert(self.place, where[new], at[new])
            low = w.raw.translate(_LOWER)
            self._learn([" " + low[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
        return w, at, back, times

    def followers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As a call, with (beginning of a word, id or NEXT_WORD after it, times) of the distinct words."""
        w, at, back, times = found = self._words(texts)
        lens = self.spans[at, 1]
        where = ragged(self.spans[at, 0], lens)
        begin, n = self.begins[where], np.repeat(times, lens)
        inner = begin != 0
        events = np.concatenate([begin[inner], self.whole[at]]), np.concatenate([self.pool[where][inner], np.full(len(at), NEXT_WORD, np.int32)]), np.concatenate([n[inner], times])
        return *self._flat(texts, *found)[:3], events

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
        """Ids of all texts, each text with END last, and how many each text has."""
        return self._flat(texts, *self._words(texts))[:3]

    def spelled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
        """As a call, with what the spelling says of each id and what it leaves to the attention; of a word's first id: of a next word."""
        return self.opened(texts)[:4]

    def opened(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
        """As spelled(), with places and beginnings of the ids of which the spelling knows nothing."""
        return self._flat(texts, *self._words(texts))

    def _flat(self, texts: list[bytes], w: Words, at: np.ndarray, back: np.ndarray, times: np.ndarray) -> tuple:
        lens_u = self.spans[at, 1]
        where = ragged(self.spans[at, 0], lens_u)
        flat = self.pool[where]
        starts_u = np.cumsum(lens_u) - lens_u
        lens = lens_u[back]
        pick = ragged(starts_u[back], lens)
        doc = w.doc()
        per_text = np.bincount(doc, lens, len(texts)).astype(np.int64) + 1
        out = np.full(int(per_text.sum()), END, np.int64)
        ends = np.cumsum(per_text) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = flat[pick]
        if not self.spelling:
            return out, per_text, w
        shares = np.tile(np.float32([1, 0]), (len(out), 1))  # a text begins with a word or its end
        heads = np.cumsum(lens) - lens + doc
        shares[inner] = self.inside[where][pick]
        shares[heads] = (1, 0)
        shares[heads + lens] = self.after[at][back]  # what follows a word is the next or the end
        begins = np.zeros(len(out), np.uint64)
        begins[inner] = self.begins[where][pick]
        begins[heads + lens] = self.whole[at][back]
        open_ = np.flatnonzero(shares[:, 1] == 1)  # what is known leaves less than all
        return out, per_text, w, shares, open_, begins[open_]


def subwords(path: str) -> Subwords:
    """For one task: its cache goes with it."""
    return Subwords(path)


def pieces(batches: Iterator[pa.RecordBatch], steps: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many CHUNK_BYTES of text, of one chunk of chunks() each by default, so a task makes objects of a slice's texts only."""
    size = steps * CHUNK_BYTES
    for b in batches:
        lens = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lens + 1)
        at = 0
        while at < len(lens):
            before = ends[at - 1] if at else 0
            # as chunks(): the last text that still fits counts without its space
            to = max(at + 1, int(np.searchsorted(ends, before + size + 1, side="right")))
            yield b.slice(at, to - at)
            at = to


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of n of each, and where each stands first."""
    by = np.argsort(key, kind="stable")
    own = key[by]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    return own[first], np.add.reduceat(n[by], first) if len(first) else n[:0], by[first]


def class_map(counts: np.ndarray, starts_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and the log share of the id in its class; no class holds both ids that start words and others."""
    order = np.argsort(-counts, kind="stable")
    cls = np.zeros(VOCABULARY, np.int64)
    cls[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    bins = CLASSES - 1 - SINGLE
    share = (counts[rest] + 0.5)[starts_word[rest]].sum() / (counts[rest] + 0.5).sum()
    own = int(np.clip(round(share * bins), 1, bins - 1))
    for ids, at, n in ((rest[starts_word[rest]], SINGLE, own), (rest[~starts_word[rest]], SINGLE + own, bins - own)):
        weight = np.cumsum(counts[ids] + 0.5)
        cls[ids] = at + np.minimum(n - 1, (weight / weight[-1] * n).astype(np.int64))
    total = np.bincount(cls, counts + 0.5, CLASSES)
    return cls, np.log((counts + 0.5) / total[cls]).astype(np.float32)


def windows(cls: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of two blocks per window, targets of the second block (-1: none), text and place of each target row."""
    pad = CLASSES - 1
    blocks = -(-per_text // BLOCK)
    rows = np.cumsum(blocks + 1) - (blocks + 1)
    inputs = np.full((int((blocks + 1).sum()), BLOCK), pad, np.int64)
    targets = np.full(inputs.shape, -1, np.int64)
    starts = np.cumsum(per_text) - per_text
    where = ragged((rows + 1) * BLOCK, per_text)
    targets.ravel()[where] = np.arange(len(cls))
    shifted = np.empty_like(cls)
    shifted[1:] = cls[:-1]
    shifted[starts] = -1
    inputs.ravel()[where] = shifted
    use = np.ones(len(inputs), bool)
    use[rows] = False
    at = np.flatnonzero(use)
    return np.concatenate([inputs[at - 1], inputs[at]], 1), targets[at], np.repeat(np.arange(len(per_text)), blocks), at


# --- the model ---------------------------------------------------------------------------------------

_SHAPES = {"emb": (CLASSES, WIDTH), "pos": (2 * BLOCK, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "out": (WIDTH, CLASSES - 1), "bias": (CLASSES - 1,), "skip": (CLASSES, CLASSES - 1)}
_SIZES = {k: int(np.prod(s)) for k, s in _SHAPES.items()}
_MASK = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e9).astype(np.float32)

_ONES = np.ones(max(CLASSES, 2 * BLOCK), np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        out[k] = flat[at : at + _SIZES[k]].reshape(s)
        at += _SIZES[k]
    return out


def start_weights(class_share: np.ndarray, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(sum(_SIZES.values())) * 0.1).astype(np.float32)
    w = unpack(flat)
    w["skip"][:] = 0
    w["bias"][:] = np.log(class_share + 1e-6)
    return flat


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class logits for the second block of each window; x: classes, begin of text -1 counts as the pad's class embedding."""
    c = np.where(x < 0, CLASSES - 1, x)
    scale = np.float32(WIDTH**-0.5)
    e = w["emb"][c] + w["pos"]
    own = e[:, BLOCK:]
    q, k, v = (own @ w["q"]) * scale, e @ w["k"], e @ w["v"]
    s = q @ k.transpose(0, 2, 1)
    s += _MASK
    s += np.where(x == CLASSES - 1, np.float32(-1e9), np.float32(0))[:, None, :]
    s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(-1, keepdims=True)
    h = s @ v
    h += own
    flat = h.reshape(-1, WIDTH)
    logits = flat @ w["out"]
    logits += w["bias"]
    logits += w["skip"][c[:, BLOCK:].ravel()]
    return logits


def sequences(cls: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For training: texts in rows of two blocks, each place an input and a target, so every token is a target once."""
    pad, wide = CLASSES - 1, 2 * BLOCK
    rows = -(-per_text // wide)
    first = np.cumsum(rows) - rows
    inputs = np.full((int(rows.sum()), wide), pad, np.int64)
    targets = np.full(inputs.shape, -1, np.int64)
    where = ragged(first * wide, per_text)
    shifted = np.empty_like(cls)
    shifted[1:] = cls[:-1]
    shifted[np.cumsum(per_text) - per_text] = -1
    inputs.ravel()[where], targets.ravel()[where] = shifted, cls
    return inputs, targets


_CAUSAL = np.where(np.arange(2 * BLOCK)[None, :] <= np.arange(2 * BLOCK)[:, None], 0, -1e9).astype(np.float32)


def _sum_by(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by class."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    own = classes[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((CLASSES, rows.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _shares(s: np.ndarray, total: np.float32 = np.float32(1)) -> np.ndarray:
    """exp of each row over its sum, times total; may use the space of s."""
    top = s.max()
    s -= top  # one shift for all rows
    raw = np.exp(s)
    sums = raw @ _ONES[: s.shape[-1]]
    if sums.size and sums.min() < 1e-20:  # rows far below the largest: each by its own
        s -= s.max(-1, keepdims=True)
        raw = np.exp(s, out=s)
        sums = raw @ _ONES[: s.shape[-1]]
    raw *= (total / sums)[..., None]
    return raw


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Mean cross-entropy over targets y (class, -1 none) of rows of two blocks, each place seeing those up to it, and its gradient."""
    w = unpack(flat)
    c = np.where(x < 0, CLASSES - 1, x)
    scale = np.float32(WIDTH**-0.5)
    e = w["emb"][c]
    e += w["pos"]
    two = e.reshape(-1, WIDTH)
    q, k, v = ((two @ w[name]).reshape(e.shape) for name in ("q", "k", "v"))
    q *= scale
    a = q @ k.transpose(0, 2, 1)
    a += _CAUSAL
    a = _shares(a)
    h = a @ v
    h += e
    h = h.reshape(-1, WIDTH)
    y, last = y.ravel(), c.ravel()
    # places without a target are at the ends of texts: they take no part from here on
    rows = np.flatnonzero(y >= 0)
    n, y, last = len(rows), y[rows], last[rows]
    whole = n == len(h)
    own = h if whole else h[rows]
    p = own @ w["out"]
    p += (w["skip"] + w["bias"]).take(last, axis=0)
    p = _shares(p, np.float32(1 / max(1, n)))
    at = np.arange(n)
    hit = p[at, y]
    loss = -float(np.log(hit * np.float32(max(1, n)) + 1e-30).sum())
    p[at, y] = hit - np.float32(1 / max(1, n))
    out = np.zeros_like(flat)
    g = unpack(out)
    g["out"][:] = own.T @ p
    g["skip"][:] = _sum_by(last, p)
    g["bias"][:] = g["skip"].sum(0)
    dh = np.zeros_like(h)
    dh[rows] = p @ w["out"].T
    dh = dh.reshape(e.shape)
    da = dh @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dh
    da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
    da *= a
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    dq *= scale
    flat2 = lambda t: t.reshape(-1, WIDTH)
    g["q"][:], g["k"][:], g["v"][:] = two.T @ flat2(dq), two.T @ flat2(dk), two.T @ flat2(dv)
    de = flat2(dq) @ w["q"].T
    de += flat2(dk) @ w["k"].T
    de += flat2(dv) @ w["v"].T
    de += flat2(dh)
    g["pos"][:] = de.reshape(e.shape).sum(0)
    g["emb"][:] = _sum_by(c.ravel(), de)
    return out, loss, n


def fit(flat: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float, epochs: int, batch: int = 64, seed: int = 3) -> np.ndarray:
    """Adam with a falling rate."""
    flat, m, s = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    rng, t, total = np.random.default_rng(seed), 0, max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            g, _, _ = gradient(flat, x[order[i : i + batch]], y[order[i : i + batch]])
            t += 1
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            flat -= np.float32(rate * (1 - t / (total + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + np.float32(1e-8))
    return flat.astype(np.float32)


class Scorer:
    """The model with what does not depend on the text multiplied out: tables by class and by place."""

    def __init__(self, w: dict[str, np.ndarray]):
        scale = np.float32(WIDTH**-0.5)
        own = w["pos"][BLOCK:]
        self.q, self.q_at = (w["emb"] @ w["q"]) * scale, (own @ w["q"]) * scale
        self.k, self.k_at = w["emb"] @ w["k"], w["pos"] @ w["k"]
        self.v, self.v_at = w["emb"] @ w["v"], w["pos"] @ w["v"]
        self.direct = w["emb"] @ w["out"] + w["skip"] + w["bias"]  # of the last id, by class
        self.direct_at, self.out = own @ w["out"], w["out"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Class logits of each place of the second blocks, as forward()."""
        c = np.where(x < 0, CLASSES - 1, x)
        own = c[:, BLOCK:]
        q = self.q.take(own, axis=0)
        q += self.q_at
        k = self.k.take(c, axis=0)
        k += self.k_at
        v = self.v.take(c, axis=0)
        v += self.v_at
        s = q @ k.transpose(0, 2, 1)
        s += _MASK
        pad = x == CLASSES - 1
        if pad.any():
            s += np.where(pad, np.float32(-1e9), np.float32(0))[:, None, :]
        raw = s - s.max()  # one shift for all rows
        np.exp(raw, out=raw)
        total = raw @ _ONES[: 2 * BLOCK]
        if total.min() < 1e-20:  # rows far below the largest: each by its own
            s -= s.max(-1, keepdims=True)
            raw = np.exp(s)
            total = raw @ _ONES[: 2 * BLOCK]
        h = raw @ v
        h /= total[:, :, None]
        logits = h.reshape(-1, WIDTH) @ self.out
        logits += self.direct.take(own.ravel(), axis=0)
        deep = logits.reshape(len(x), BLOCK, -1)
        deep += self.direct_at
        return logits


def log_probabilities(w: dict[str, np.ndarray], cls: np.ndarray, share: np.ndarray, per_text: np.ndarray, shares: np.ndarray | None = None, new: np.ndarray | None = None, chances: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text.

    With shares (what spelling says of each id, what it leaves) and new (classes of ids that start words), inside words
    both are added; a word's first id has the mixed chance of a next word times its chance among such ids.
    chances, if given, takes what the attention's part of each mixture is.
    """
    model = Scorer(w)
    x, targets, text, _ = windows(cls, per_text)
    total = np.zeros(len(per_text))
    ones = _ONES[: CLASSES - 1]
    parts = np.stack([ones, ones if new is None else new], 1)  # all classes, those of ids that start words
    for i in range(0, len(x), 64):
        logits = model(x[i : i + 64])
        t = targets[i : i + 64].ravel()
        rows = np.flatnonzero(t >= 0)
        hit = logits[rows, cls[t[rows]]]
        top = np.float32(logits.max())  # one shift for all rows, unless their logits differ by too much
        if top - logits.min() > 60:
            logits -= logits.max(1, keepdims=True)
            hit, top = logits[rows, cls[t[rows]]], np.float32(0)
        logits -= top
        np.exp(logits, out=logits)
        at = t[rows]
        whole, begun = (logits @ parts)[rows].T
        lp = hit - top - np.log(whole) + share[at]
        if shares is not None:
            said, left = shares[at].T
            starts = begun / whole
            first = new[cls[at]] > 0
            chance = np.where(first, starts, np.exp(lp))
            if chances is not None:
                chances[at] = chance
            mixed = np.log(np.maximum(said + left * chance, LEAST))
            lp = np.where(first, lp - np.log(np.maximum(starts, 1e-35)) + mixed, mixed)
        total += np.bincount(np.repeat(text[i : i + 64], BLOCK)[rows], lp.astype(np.float64), len(per_text))
    return total


# --- on Spark ------------------------------------------------------------------------------------------


def counted(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """From (text, learn): rows of (kind, item, part, n), which are words (0), subword ids (1) and followers (2) with counts that are still to be summed."""
    sub, ids = subwords(tokenizer), np.zeros(VOCABULARY, np.int64)
    words, follow, held = [], [], 0  # (hash, times) and (beginning, follower, times)

    def rows(kind: int, item: np.ndarray, part: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(item), SENT):
            x, p, t = item[i : i + SENT], part[i : i + SENT], n[i : i + SENT]
            yield pa.record_batch([pa.array(np.full(len(x), kind, np.int8)), pa.array(x.astype(np.uint64).view(np.int64)), pa.array(p.astype(np.int32)), pa.array(t.astype(np.int64))], names=["kind", "item", "part", "n"])

    def merge() -> None:
        h, n = (np.concatenate(x) for x in zip(*words, strict=True))
        words[:] = [summed(h, n)[:2]]
        begin, part, n = (np.concatenate(x) for x in zip(*follow, strict=True))
        follow.clear()  # the sums take its place
        _, n, at = summed(_mix(begin, part), n)
        follow.append((begin[at], part[at], n))

    def flush(below: float) -> Iterator[pa.RecordBatch]:
        """Sends the sums below this, keeps the others."""
        (h, n), (begin, part, times) = words[0], follow[0]
        for kind, go, item, of, sums in ((0, n < below, h, np.zeros(len(h), np.int32), n), (2, times < below, begin, part, times)):
            yield from rows(kind, item[go], of[go], sums[go])
        words[:], follow[:] = [(h[n >= below], n[n >= below])], [tuple(x[times >= below] for x in follow[0])]

    def texts_of(b: pa.RecordBatch) -> Iterator[tuple[bool, list[bytes]]]:
        for learn in (True, False):
            for _, _, texts in chunks(b.filter(pc.equal(b.column(1), learn))):
                yield learn, texts

    for b in pieces(batches, 8):
        for learn, texts in texts_of(b):
            own, _, w, events = sub.followers(texts)
            if learn:
                ids += np.bincount(own, minlength=VOCABULARY)
            words.append(np.unique(w.hash if learn else w.hash[:0], return_counts=True))
            follow.append(events if learn else (*events[:2], np.zeros(len(events[0]), np.int64)))
            held += len(words[-1][0]) + len(events[0])
            if held > HELD:  # bounded: if merging does not shrink the sums, send the ones so far, or all
                merge()
                for below in (2, np.inf):
                    if len(words[0][0]) + len(follow[0][0]) > HELD // 2:
                        yield from flush(below)
                held = len(words[0][0]) + len(follow[0][0])
    if words:
        merge()
        yield from flush(np.inf)
    seen = np.flatnonzero(ids)
    yield from rows(1, seen, np.zeros(len(seen), np.int32), ids[seen])


def _counts(train: DataFrame, tokenizer: str, scratch: Scratch, unseen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of word hashes, of subword ids (END is the number of texts), and of what follows beginnings of words, over all training texts.

    The last come with the times a beginning was seen (all) and how many followers it has; with n = 0 they hold what
    only the texts of unseen have after such a beginning.
    """

    texts = train.select("text", F.lit(True).alias("learn"))
    if unseen is not None:
        texts = texts.unionByName(unseen.select("text", F.lit(False).alias("learn")))
    # dealt by item once, for the sums and for the totals of an item
    found = texts.mapInArrow(lambda batches: counted(batches, tokenizer), "kind tinyint, item long, part int, n long").repartition("item")
    sums = found.groupBy("kind", "item", "part").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("kind", "item")
    sums = sums.select("*", F.sum("n").over(own).alias("all"), F.count_if(F.col("n") > 0).over(own).alias("followers")).where(F.col("all") > 0)
    sums = scratch.save(sums, "counts")
    of = lambda kind, *names: sums.where(F.col("kind") == kind).select(*names)
    return of(0, "item", "n"), of(1, "item", "n"), of(2, "item", "part", "n", "all", "followers")


def frequent(table_: DataFrame, n: str, bound: int, size: str = "1") -> Column:
    """Whether a row has one of the largest n, down to a floor on n chosen so that the sizes of such rows sum to no more than bound: nothing is sorted."""
    step = F.floor(F.log2(F.col(n)) * 8)
    steps = table_.where(F.col(n) > 0).groupBy(step.alias("step")).agg(F.sum(F.expr(size)).alias("size")).orderBy(F.desc("step")).collect()  # a few hundred rows at most
    floor, total = None, 0
    for r in steps:
        total += r["size"]
        if total > bound:
            break
        floor = r["step"]
    return F.coalesce(step >= floor, F.lit(False)) if floor is not None else F.lit(False)


def largest(table_: DataFrame, n: str, bound: int, size: str = "1") -> DataFrame:
    """Rows of the largest n, as frequent() has them."""
    return table_.where(frequent(table_, n, bound, size))


def spelling_parts(events: DataFrame) -> tuple[Spelling, DataFrame]:
    """From (item: beginning, part: follower, n, all, followers): the most frequent, FOLLOWERS at most, and the rows of all others."""
    top = frequent(events, "n", FOLLOWERS)
    found = events.where(top).toArrow()  # FOLLOWERS rows at most
    return Spelling.of(*(found[x].to_numpy() for x in ("item", "part", "n", "all", "followers"))), events.where(~top)


def spelling(events: DataFrame, scratch: Scratch) -> Spelling:
    """The part of spelling_parts() that is broadcast."""
    return spelling_parts(events)[0]


def train_attention(train: DataFrame, cls: np.ndarray, ids: np.ndarray, tokenizer: str, scratch: Scratch) -> np.ndarray:
    spark = train.sparkSession
    share = np.bincount(cls, ids, CLASSES)[:-1]
    begin = start_weights(share / max(1.0, share.sum()))

    def blocks(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sub, found = subwords(tokenizer), []
        for b in pieces(batches):
            for _, _, texts in chunks(b):
                own, per_text, _ = sub(texts)
                # a byte each, so the rows of a task take less than its texts
                found.append([z.astype(np.int8) for z in sequences(classes[own], per_text)])
        x = np.concatenate([z[0] for z in found]) if found else np.zeros((0, 2 * BLOCK), np.int8)
        return x, np.concatenate([z[1] for z in found]) if found else x

    shared = spark.sparkContext.broadcast((cls, begin))
    # hashes are ordered first, so no task gets texts but those chosen
    keyed = train.select("text", F.xxhash64("text", F.lit("warm")).alias("at"))
    chosen = keyed.select("at").distinct().orderBy("at").limit(WARM_DOCS)
    warm = keyed.join(F.broadcast(chosen), "at").groupBy("at").agg(F.first("text").alias("text")).repartition(1).sortWithinPartitions("at").select("text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, flat = shared.value
        x, y = blocks(batches, classes)
        if len(x):
            flat = fit(flat, x, y, 0.01, 2)
        yield pa.record_batch([pa.array([flat.tobytes()])], names=["w"])

    row = scratch.save(warm.mapInArrow(first, "w binary"), "warm").first()
    warmed = np.frombuffer(row["w"], np.float32) if row else begin
    shared2 = spark.sparkContext.broadcast((cls, warmed))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, flat = shared2.value
        x, y = blocks(batches, classes)
        if len(x):
            flat = fit(flat, x, y, 0.002, 1)
            seen = float((y >= 0).sum())
            yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))], names=["i", "w", "seen"])

    mean = train.select("text").mapInArrow(refine, "i int, w double, seen double").groupBy("i").agg((F.sum("w") / F.sum("seen")).alias("w"), F.sum("seen").alias("seen"))
    mean = scratch.save(mean, "weights").toPandas()  # one row per weight: a fixed size
    if not len(mean):
        return warmed
    out = np.zeros(len(warmed), np.float32)
    out[mean.i] = mean.w
    return out


def score_texts(docs: DataFrame, train: DataFrame, *, unseen: DataFrame | None = None, tokenizer: str = TOKENIZER, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, other columns of any name) with n_tokens, n_known, train_tokens, base_score, score.

    Columns of docs that have one of these five names give way to them. unseen: the rows of docs that are not in train, if known.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "language-model")
    train = train.select("doc_id", "text")
    words, subs, events = _counts(train, tokenizer, scratch, docs if unseen is None else unseen)
    s = subs.toPandas()  # one row per subword id at most
    ids = np.zeros(VOCABULARY)
    ids[s.item] = s.n
    ends = int(ids[END])
    facts = words.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, types = facts["n"] + ends, facts["types"] + (1 if ends else 0)
    starts_word = word_starts(tokenizer)
    cls, log_share = class_map(ids, starts_word)
    spelled, rare_events = spelling_parts(events)
    weights = train_attention(train, cls, ids, tokenizer, scratch)
    scratch.release()

    is_common = frequent(words, "n", COMMON)
    top = words.where(is_common).toArrow().sort_by("item")
    new = np.zeros(CLASSES - 1, np.float32)
    new[cls[starts_word]] = 1
    shared = spark.sparkContext.broadcast((top["item"].to_numpy(), np.log10(top["n"].to_numpy() + 1.0), cls, log_share, weights, spelled, new))
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    keyed = docs.select(row, F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("_k1"), F.hash("text", "doc_id").alias("_k2"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logs, cls, log_share, flat, spelled, new = shared.value
        w, sub = unpack(flat), Subwords(tokenizer, spelled)

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for b in pieces(batches):
            for lo, hi, texts in chunks(b):
                own, per_text, words_, shares, open_, begins = sub.opened(texts)
                chances = np.zeros(len(own), np.float32)
                lp = log_probabilities(w, cls[own], log_share[own], per_text, shares, new, chances) / np.log(10)
                h, doc = words_.hash.view(np.int64), words_.doc()
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                hit = common[at] == h if len(common) else np.zeros(len(h), bool)
                known = np.bincount(doc[hit], minlength=len(texts))
                logsum = np.bincount(doc[hit], logs[at[hit]], len(texts))
                r, k1, k2 = (c.slice(lo, hi - lo) for c in b.columns[:3])
                yield rows(
                    len(texts), r=r, item=k1, part=pa.array(np.full(len(texts), TEXT, np.int32)), k1=k1, k2=k2, n_tokens=pa.array(np.diff(words_.bounds).astype(np.int64) + 1),
                    known=pa.array(known.astype(np.int64)), logsum=pa.array(logsum.astype(np.float64)), score=pa.array(lp),
                )
                # words and spellings that are not broadcast: their counts, if any, are joined
                rare = np.flatnonzero(~hit)
                follower = np.where(starts_word[own[open_]], NEXT_WORD, own[open_])
                of = np.concatenate([doc[rare], np.searchsorted(np.cumsum(per_text), open_, side="right")])
                yield rows(
                    len(of), r=r.take(pa.array(of)), item=pa.array(np.concatenate([h[rare], begins.view(np.int64)])),
                    part=pa.array(np.concatenate([np.full(len(rare), WORD), follower]).astype(np.int32)), chance=pa.array(np.concatenate([np.zeros(len(rare), np.float32), chances[open_]])),
                )

    # a row for each text and for each word or spelling to look up: they are dealt by what they look up once, and only sums by text are kept
    names = {"r": pa.int64(), "item": pa.int64(), "part": pa.int32(), "chance": pa.float32(), "k1": pa.int64(), "k2": pa.int32(), "n_tokens": pa.int64(), "known": pa.int64(), "logsum": pa.float64(), "score": pa.float64()}
    schema = pa.schema(names.items())
    asked = keyed.select(F.monotonically_increasing_id().alias("r"), "_k1", "_k2", "text")
    asked = asked.mapInArrow(work, "r long, item long, part int, chance float, k1 long, k2 int, n_tokens long, known long, logsum double, score double")
    seen = F.col("all") + F.col("followers")
    rare = rare_events.select("item", "part", "n", (F.col("n") / seen).alias("said"), (F.col("followers") / seen).alias("left"))
    rare = rare.unionByName(words.where(~is_common).select("item", F.lit(WORD).alias("part"), "n"), allowMissingColumns=True)
    # n_known and base score: of the rarer words; score: what counts add to the attention's part
    chance = F.col("chance").cast("double")
    gain = F.log10(F.greatest(F.col("said") + F.col("left") * chance, F.lit(LEAST))) - F.log10(F.greatest(chance, F.lit(LEAST)))
    is_word = F.col("part") == WORD
    firsts = [F.max(c).alias(c) for c in ("k1", "k2", "n_tokens", "known", "logsum", "score")]
    scored = asked.join(rare, ["item", "part"], "left").groupBy("r").agg(
        *firsts, F.count(F.when(is_word, F.col("n"))).alias("more"), F.sum(F.when(is_word, F.log10(F.col("n") + 1))).alias("more_log"), F.sum(F.when(~is_word & F.col("n").isNotNull(), gain)).alias("spelled")
    )
    out = scratch.save(scored, "scored").dropDuplicates(["k1", "k2"])
    scratch.release()
    end_log = float(np.log10(ends + 1))
    total = float(np.log10(n + types + 1))
    base_ = F.col("logsum") + F.coalesce("more_log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(total)
    out = out.select("k1", "k2", "n_tokens", (F.col("known") + F.col("more") + F.lit(1 if ends else 0)).alias("n_known"), base_.alias("base_score"), (F.col("score") + F.coalesce("spelled", F.lit(0.0))).alias("score"))
    joined = keyed.join(out, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    learnt = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(False))
    out = score_texts(docs, docs.where(learnt), unseen=docs.where(~learnt))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_attention_lm": op7_attention_lm}
SQL: dict[str, str] = {}  # the trained model is not expressible; the base score is tested against brute force
