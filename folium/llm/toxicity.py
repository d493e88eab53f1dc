"""Operator 8: toxicity by a bidirectional gated recurrent network, in numpy.

A word enters as its own embedding beside the largest values of its character n-grams'
embeddings.  A gated recurrent unit reads a window of words in both directions,
attention pools the states, and a logistic output scores the window.  All overlapping
windows of ``WINDOW`` words, ``STRIDE`` apart, are scored; the text takes the largest.
Every input is learned by the network's own gradient from a random start: no word list
and no label statistic enters.  Words and n-grams have a row of their own if at least
``MIN_TEXTS`` texts of the sample hold them; all others share a row of zeros, so rare
words cannot be learned by heart.

Training is multi-instance, as only texts are labelled: the first round gives windows
the label of their text, later rounds keep the strongest windows of each text (and
random ones of clean texts).  A fifth of the sample is never trained on and places the
threshold.  The sample is bounded by ``PER_CLASS`` and holds no held-out row.

Scoring computes gate inputs once per distinct word and keeps them in a bounded table;
texts are taken in groups whose windows are scored before the table may be emptied.

Defined cases: null, empty and blank texts are one window without words and get a
score; a text of any length is read whole (a long one in pieces that share whole
windows); without rows of both labels the score is the smoothed share of label 1;
repeated rows score alike; an empty table gives an empty result; columns besides the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import held_out, text_of, training_rows

#: Labelled rows that the network is fitted on, at most: clean ones, toxic ones.
PER_CLASS = (2400, 1200)
WINDOW, STRIDE = 16, 8
#: Rows of the two embedding tables, at most, and texts that must hold a word or n-gram.
WORDS, GRAMS, MIN_TEXTS = 1 << 14, 1 << 15, 4
SIZES = (3, 5)
EMBED, HIDDEN, ATTEND = 8, 12, 8
ROUNDS, EPOCHS, RATE, DECAY = 3, 4, 0.01, 1e-5
#: Steps of a round at least, for small samples.
STEPS = 60
#: Share of the words whose own row is hidden in a step, and of those whose n-grams are.
HIDE = 0.2
#: N-grams of a training word that are looked at (all of a word of ``WIDE`` characters).
TRAIN_GRAMS = 40
#: Windows that a text gives a round at most, by its label.
PICKED = (6, 4)
THRESHOLD = 0.7
#: Windows that are scored at a time, words whose gate inputs are kept, tokens of a group.
BATCH, KEPT_WORDS, GROUP = 1024, 1 << 17, 1 << 15
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»„“”…¡¿"


#: Words longer than this take their n-grams in a batch of their own width.
WIDE = 22
#: Slots through which a hash finds its embedding row; rows keep the whole hash.
SLOTS = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def clean_word(token: str) -> str:
    return token.lower().strip(_STRIP)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h * _MUL
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hash_block(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (words,) and of their n-grams, the start marked (grams, words).

    Places without an n-gram have hash zero, which no row answers to."""
    width = max(max(map(len, words)) + 1, max(SIZES))
    codes = np.array(["^" + w for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    codes = np.ascontiguousarray(codes.T).astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    whole = np.zeros(len(words), dtype=np.uint64)
    for i in range(width):
        whole = np.where(i < length, whole * np.uint64(1_000_003) + codes[i], whole)
    parts = []
    for n in SIZES:
        count = width - n + 1
        h = codes[:count]
        for k in range(1, n):
            h = h * np.uint64(65_599) + codes[k : k + count]
        h = _scramble(h + np.uint64(n << 56))
        parts.append(np.where(np.arange(count)[:, None] <= length - n, h, np.uint64(0)))
    return _scramble(whole), np.concatenate(parts, axis=0)


def hash_words(words: list[str]):
    """``_hash_block`` over blocks of words of one width each, and over long ones alone."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for low, high in ((-1, 6), (6, 12), (12, WIDE)):
        pick = np.flatnonzero((size > low) & (size <= high))
        for at in range(0, len(pick), 4096):
            part = pick[at : at + 4096]
            yield part, _hash_block([words[i] for i in part])
    for i in np.flatnonzero(size > WIDE):
        yield np.array([i]), _hash_block([words[i]])


class Rows:
    """Embedding rows of known hashes; every other hash has row 0."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.concatenate([[np.uint64(1)], hashes]).astype(np.uint64)
        self.slots = np.zeros(SLOTS, dtype=np.uint16)
        # Where two known hashes share a slot the earlier (more frequent) one has it.
        self.slots[(hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)[::-1]] = np.arange(len(hashes), 0, -1)

    def find(self, h: np.ndarray) -> np.ndarray:
        row = self.slots[(h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)].astype(np.int64)
        return np.where(self.keys[row] == h, row, 0)


def _frequent(hashes: np.ndarray, texts: np.ndarray, most: int) -> np.ndarray:
    """The hashes that at least ``MIN_TEXTS`` texts hold, the most frequent first."""
    some = np.flatnonzero(texts >= MIN_TEXTS)
    return hashes[some[np.lexsort((hashes[some], -texts[some]))]][: most - 1]


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_parameters(seed: int = 11, words: int = WORDS, grams: int = GRAMS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    p = {"Ew": rng.normal(0, 0.1, (words, EMBED)), "Ec": rng.normal(0, 0.1, (grams, EMBED))}
    for side in "fb":
        p[f"W{side}"] = rng.normal(0, d**-0.5, (d, 3 * h))
        p[f"b{side}"] = np.zeros(3 * h)
        p[f"U{side}"] = rng.normal(0, h**-0.5, (h, 3 * h))
    p |= {"Wa": rng.normal(0, (2 * h) ** -0.5, (2 * h, ATTEND)), "ba": np.zeros(ATTEND), "va": rng.normal(0, 0.3, ATTEND)}
    p |= {"wo": rng.normal(0, 0.3, 2 * h), "bo": np.zeros(1)}
    p["Ew"][0] = p["Ec"][0] = 0
    return p


def _read(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: list) -> np.ndarray:
    """States (T, B, H) of one direction; gates is (T, B, 3H), mask (T, B, 1)."""
    t_all, b, h3 = gates.shape
    h = h3 // 3
    state = np.zeros((b, h), dtype=gates.dtype)
    out = np.empty((t_all, b, h), dtype=gates.dtype)
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        rec = state @ U
        zr = _sigmoid(gates[t, :, : 2 * h] + rec[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(gates[t, :, 2 * h :] + r * rec[:, 2 * h :])
        keep.append((t, state, z, r, n, rec[:, 2 * h :]))
        state = state + mask[t] * (n + z * (state - n) - state)
        out[t] = state
    return out


def _pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """Attention weights (T, B), the pooled state and the logit of each window."""
    u = np.tanh(states @ p["Wa"] + p["ba"])
    e = np.where(mask[:, :, 0] > 0, u @ p["va"], -1e9)
    e -= e.max(axis=0)
    a = np.exp(e)
    a /= a.sum(axis=0)
    c = (a[:, :, None] * states).sum(axis=0)
    return u, a, c, c @ p["wo"] + p["bo"][0]


def _read_back(keep: list, mask, U, d_out, d_gates, d_U) -> None:
    """Gradients of one direction; walks the kept steps in reverse."""
    h = U.shape[0]
    d_state = np.zeros_like(d_out[0])
    for t, before, z, r, n, rec_n in reversed(keep):
        d_state = d_state + d_out[t]
        d_new = mask[t] * d_state
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (before - n) * z * (1 - z)
        d_r = d_n * rec_n * r * (1 - r)
        d_gates[t, :, :h], d_gates[t, :, h : 2 * h], d_gates[t, :, 2 * h :] = d_z, d_r, d_n
        d_rec = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_U += before.T @ d_rec
        d_state = d_state * (1 - mask[t]) + d_new * z + d_rec @ U.T


def windows_of(n: int) -> np.ndarray:
    """Word positions (windows, WINDOW) of a text of n words; -1 where there is none."""
    if n <= WINDOW:
        at = np.arange(WINDOW)
        return np.where(at < n, at, -1)[None, :]
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    if starts[-1] + WINDOW < n:
        starts = np.append(starts, n - WINDOW)
    return starts[:, None] + np.arange(WINDOW)


def gradients(p: dict, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Loss and gradients for windows of word ids (B, T) into word inputs x (V, D)."""
    at = ids.T
    mask = (at > 0).astype(x.dtype)[:, :, None]
    xs = x[at]
    keeps, states, gates = {}, [], {}
    for side in "fb":
        gates[side] = xs @ p[f"W{side}"] + p[f"b{side}"]
        keeps[side] = []
        states.append(_read(gates[side], mask, p[f"U{side}"], side == "b", keeps[side]))
    s = np.concatenate(states, axis=2)
    u, a, c, logit = _pool(p, s, mask)
    prob = _sigmoid(logit)
    loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum()
    d_logit = weight * (prob - y)
    g = {"wo": c.T @ d_logit, "bo": np.array([d_logit.sum()])}
    d_c = d_logit[:, None] * p["wo"]
    d_a = (s * d_c).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["va"] = np.tensordot(d_e, u, axes=([0, 1], [0, 1]))
    d_u = d_e[:, :, None] * p["va"] * (1 - u * u)
    g["Wa"], g["ba"] = np.tensordot(s, d_u, axes=([0, 1], [0, 1])), d_u.sum(axis=(0, 1))
    d_s = a[:, :, None] * d_c + d_u @ p["Wa"].T
    d_x = np.zeros_like(xs)
    for k, side in enumerate("fb"):
        d_gates, d_U = np.zeros_like(gates[side]), np.zeros_like(p[f"U{side}"])
        _read_back(keeps[side], mask, p[f"U{side}"], d_s[:, :, k * HIDDEN : (k + 1) * HIDDEN], d_gates, d_U)
        g[f"U{side}"] = d_U
        g[f"W{side}"], g[f"b{side}"] = np.tensordot(xs, d_gates, axes=([0, 1], [0, 1])), d_gates.sum(axis=(0, 1))
        d_x += d_gates @ p[f"W{side}"].T
    return loss, g, spread(at.ravel(), d_x.reshape(-1, x.shape[1]), len(x))


def spread(where: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of value rows by place."""
    return np.stack([np.bincount(where, weights=v, minlength=size) for v in values.T], axis=1)


def word_inputs(p: dict, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Inputs (words, D): the word's row, and the largest of zero and its n-grams' rows.

    ``gram`` is (grams, words), so that the largest is taken over whole rows."""
    return np.concatenate([p["Ew"][word], np.maximum(p["Ec"][gram].max(axis=0), 0)], axis=1)


def word_gradients(p: dict, word: np.ndarray, gram: np.ndarray, d_rows: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the embedding tables; the largest n-gram of each column takes its own."""
    found = p["Ec"][gram]
    best = found.argmax(axis=0)
    d_char = np.where(found.max(axis=0) > 0, d_rows[:, EMBED:], 0)
    g = {"Ew": spread(word, d_rows[:, :EMBED], len(p["Ew"])), "Ec": np.empty_like(p["Ec"])}
    for k in range(EMBED):
        g["Ec"][:, k] = np.bincount(gram[best[:, k], np.arange(len(word))], weights=d_char[:, k], minlength=len(p["Ec"]))
    g["Ew"][0] = g["Ec"][0] = 0
    return g


class Network:
    """A fitted network and the rows of its inputs; ``constant`` if none could be fitted."""

    def __init__(self, p: dict | None, rows: tuple[Rows, Rows] | None, constant: float | None = None):
        self.p = None if p is None else {k: v.astype(np.float32) for k, v in p.items()}
        self.rows, self.constant = rows, constant
        self.gates: np.ndarray | None = None
        if p is not None:
            h, self.U = HIDDEN, np.stack([self.p["Uf"], self.p["Ub"]])
            # A sigmoid is half a tanh of half its argument; the halves go into the weights.
            self.half = np.repeat(np.array([0.5, 0.5, 1.0], dtype=np.float32), h)
            self.U = self.U * self.half
            self.head = np.concatenate([self.p["Wa"], self.p["wo"][:, None]], axis=1)

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.filled = 1
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        """Gate inputs of unseen tokens; those without letters or digits get row 0."""
        cleaned = list(map(clean_word, new))
        worded = [(t, w) for t, w in zip(new, cleaned, strict=True) if w]
        self.memo.update(dict.fromkeys((t for t, w in zip(new, cleaned, strict=True) if not w), 0))
        base = self.filled
        while base + len(worded) > self.gates.shape[1]:
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
        for at, hashes in hash_words([w for _, w in worded]):
            self.gates[:, base + at] = self.gate_inputs(*hashes)
        self.memo.update(zip((t for t, _ in worded), range(base, base + len(worded)), strict=True))
        self.filled += len(worded)

    def gate_inputs(self, whole: np.ndarray, parts: np.ndarray) -> np.ndarray:
        x = word_inputs(self.p, self.rows[0].find(whole), self.rows[1].find(parts))
        return np.stack([(x @ self.p[f"W{s}"] + self.p[f"b{s}"]) * self.half for s in "fb"])

    def _states(self, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """States (T, B, 2H) of both directions, which step together."""
        t_all, b = ids.shape
        h = HIDDEN
        state = np.zeros((2, b, h), dtype=np.float32)
        out = np.empty((t_all, b, 2 * h), dtype=np.float32)
        gate, rec, zr = (np.empty((2, b, k * h), dtype=np.float32) for k in (3, 3, 2))
        for t in range(t_all):
            for side, at in ((0, t), (1, t_all - 1 - t)):
                np.take(self.gates[side], ids[at], axis=0, out=gate[side], mode="clip")
            np.matmul(state, self.U, out=rec)
            np.add(gate[:, :, : 2 * h], rec[:, :, : 2 * h], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n = rec[:, :, 2 * h :]
            n *= zr[:, :, h:]
            n += gate[:, :, 2 * h :]
            new = np.tanh(n)
            step = state - new
            step *= zr[:, :, :h]
            new += step
            if mask is not None:
                m = np.stack([mask[t], mask[t_all - 1 - t]])[:, :, None]
                new = state + m * (new - state)
            state = new
            out[t, :, :h], out[t_all - 1 - t, :, h:] = state[0], state[1]
        return out

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """Logits of windows (B, T) of gate rows, 0 where a window has no word."""
        out = np.empty(len(ids), dtype=np.float32)
        full = ids[:, -1] > 0
        for whole in (True, False):
            pick = np.flatnonzero(full == whole)
            for at in range(0, len(pick), BATCH):
                part = np.ascontiguousarray(ids[pick[at : at + BATCH]].T)
                mask = None if whole else (part > 0).astype(np.float32)
                found = self._states(part, mask) @ self.head
                e = np.tanh(found[:, :, :-1] + self.p["ba"]) @ self.p["va"]
                if mask is not None:
                    e = np.where(mask > 0, e, np.where(mask.any(axis=0), -np.inf, 0))
                a = np.exp(e - e.max(axis=0))
                out[pick[at : at + BATCH]] = (a * found[:, :, -1]).sum(axis=0) / a.sum(axis=0) + self.p["bo"][0]
        return out

    def score(self, texts) -> np.ndarray:
        """The largest window score of each text."""
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        if self.gates is None:
            self._reset()
        out = np.full(len(texts), -np.inf)
        held, count = [], 0
        for k, text in enumerate(texts):
            for piece in self._pieces((text or "").split()):
                held.append((k, piece))
                count += len(piece)
                if count >= GROUP:
                    self._score_group(held, out)
                    held, count = [], 0
        self._score_group(held, out)
        return _sigmoid(out)

    @staticmethod
    def _pieces(tokens: list[str]):
        """A text's tokens; those of a long text without bare symbols, in pieces of whole
        strides that overlap by a window, so the pieces' windows are the text's."""
        if len(tokens) <= GROUP:
            yield tokens
            return
        worded = {t for t in set(tokens) if clean_word(t)}
        tokens = [t for t in tokens if t in worded]
        size = GROUP // STRIDE * STRIDE
        for at in range(0, max(len(tokens) - WINDOW, 1), size):
            yield tokens[at : at + size + WINDOW]

    def _score_group(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Scores all windows of the pieces; the table is emptied only before."""
        if not held:
            return
        new = set().union(*(p for _, p in held)).difference(self.memo)
        if new and len(self.memo) + len(new) > KEPT_WORDS:
            self._reset()
            new = set().union(*(p for _, p in held))
        if new:
            self._learn(list(new))
        windows, owners = [], []
        for k, piece in held:
            ids = np.fromiter(map(self.memo.__getitem__, piece), dtype=np.int32, count=len(piece))
            ids = ids[ids > 0]
            at = windows_of(len(ids))
            windows.append(ids[at] if len(ids) >= WINDOW else np.pad(ids, (0, WINDOW - len(ids)))[None, :])
            owners.append(np.full(len(at), k))
        np.maximum.at(out, np.concatenate(owners), self.logits(np.concatenate(windows)))


def _rows_of(names: list[str], texts: list[np.ndarray]) -> tuple[np.ndarray, Rows, np.ndarray, Rows]:
    """Embedding rows of the sample's words (names[0] is none) and of their n-grams.

    ``texts`` are the distinct words of the texts that count.  N-grams are (grams, words),
    the known ones first; they are hashed twice rather than kept, to spare memory."""
    whole = np.zeros(len(names), dtype=np.uint64)
    seen = [np.zeros(1, dtype=np.uint64)]
    for at, (h, parts) in hash_words(names[1:]):
        whole[at + 1] = h
        seen.append(np.unique(parts[:TRAIN_GRAMS]))
    distinct = np.unique(np.concatenate(seen))  # zero, no n-gram, comes first
    gram = np.zeros((TRAIN_GRAMS, len(names)), dtype=np.int32)
    for at, (_, parts) in hash_words(names[1:]):
        part = parts[:TRAIN_GRAMS]
        gram[: len(part), at + 1] = np.searchsorted(distinct, part)
    held, holding = np.zeros(len(names), dtype=np.int32), np.zeros(len(distinct), dtype=np.int32)
    for words in texts:
        held[words] += 1
        holding[np.unique(gram[:, words])] += 1
    held[0] = holding[0] = 0
    word_rows, gram_rows = Rows(_frequent(whole, held, WORDS)), Rows(_frequent(distinct, holding, GRAMS))
    row = gram_rows.find(distinct).astype(np.int32)
    gram = row[gram]
    gram[::-1].sort(axis=0)
    return word_rows.find(whole), word_rows, gram[: max(int((gram > 0).sum(axis=0).max()), 1)].copy(), gram_rows


def fit(rows: list[tuple[str, int]], seed: int = 11) -> Network:
    """Multi-instance training on labelled texts."""
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return Network(None, None, float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {"": 0}
    encoded = [
        np.array([index.setdefault(w, len(index)) for w in map(clean_word, (t or "").split()) if w], dtype=np.int64)
        for t, _ in rows
    ]
    # A fifth of either label places the threshold and is not trained on.
    apart = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == label))
        apart[mine[: len(mine) // 5]] = True
    names, counted = list(index), ~apart
    del index
    word_of, word_rows, gram_of, gram_rows = _rows_of(names, [np.unique(e) for e, c in zip(encoded, counted, strict=True) if c])
    p = {k: v.astype(np.float32) for k, v in new_parameters(seed, len(word_rows.keys), len(gram_rows.keys)).items()}
    ids = [
        np.where(w >= 0, e[w] if len(e) else 0, 0).astype(np.int32) for w, e in zip(map(windows_of, map(len, encoded)), encoded, strict=True)
    ]
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    strength: list[np.ndarray | None] = [None] * len(y)
    for _ in range(ROUNDS):
        chosen, labels = [], []
        for i in np.flatnonzero(counted):
            n, most = len(ids[i]), PICKED[int(y[i])]
            if strength[i] is None:
                pick = rng.permutation(n)[: 2 * most]
            else:
                pick = np.argsort(-strength[i], kind="stable")[: most // 2]
                if y[i] == 0:
                    pick = np.unique(np.concatenate([pick, rng.integers(0, n, most // 2)]))
            chosen.append(ids[i][pick])
            labels.append(np.full(len(pick), y[i]))
        win, lab = np.concatenate(chosen), np.concatenate(labels).astype(np.float32)
        share = lab.mean()
        weight = np.where(lab == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _epoch in range(max(EPOCHS, -(-STEPS * 256 // len(lab)))):
            order = rng.permutation(len(lab))
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                use, local = np.unique(np.concatenate([[0], win[part].ravel()]), return_inverse=True)
                local = local[1:].reshape(win[part].shape)
                # Some words are hidden in each step, so no single one can be relied on.
                word = word_of[use] * (rng.random(len(use)) >= HIDE)
                gram = gram_of[:, use] * (rng.random(len(use)) >= HIDE)
                x = word_inputs(p, word, gram)
                _, g, d_rows = gradients(p, x, local, lab[part], weight[part] / len(part))
                g |= word_gradients(p, word, gram, d_rows)
                step += 1
                for n, grad in g.items():
                    grad = grad + DECAY * p[n]
                    first[n] += 0.1 * (grad - first[n])
                    second[n] += 0.001 * (grad * grad - second[n])
                    p[n] -= RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        net = Network(p, (word_rows, gram_rows))
        gates = np.zeros((2, len(names), 3 * HIDDEN), dtype=np.float32)
        for at in range(1, len(names), 8192):
            x = word_inputs(net.p, word_of[at : at + 8192], gram_of[:, at : at + 8192])
            for k, s in enumerate("fb"):
                gates[k, at : at + 8192] = (x @ net.p[f"W{s}"] + net.p[f"b{s}"]) * net.half
        net.gates = gates
        scored = net.logits(np.concatenate(ids))
        strength = np.split(scored, np.cumsum([len(i) for i in ids])[:-1])
    top = np.array([x.max() for x in strength], dtype=float)
    # Samples too small to spare a fifth place the threshold on what they were fitted on.
    use = apart if len(set(y[apart])) == 2 else np.ones(len(y), dtype=bool)
    a, b = calibrate(top[use], y[use])
    p["wo"], p["bo"] = p["wo"] * a, p["bo"] * a + b
    return Network(p, (word_rows, gram_rows))


#: A clean text above the threshold costs as much as so many toxic ones below it.
CLEAN_COST = 4.0


def calibrate(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the largest window's logit, so that ``THRESHOLD`` falls where
    the sample's errors cost least (the middle of the best gap between values)."""
    order = np.argsort(top, kind="stable")
    value, label = top[order], y[order]
    missed = np.concatenate([[0], np.cumsum(label)]) / max(label.sum(), 1)
    false = np.concatenate([[0], np.cumsum(1 - label)])
    false = (false[-1] - false) / max((1 - label).sum(), 1)
    cost = missed + CLEAN_COST * false
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    edges = np.concatenate([[value[0] - 2.0], value, [value[-1] + 2.0]])
    lo, hi = edges[best], edges[best + 1]
    cut = ((lo + hi) / 2)[np.argmax(hi - lo)]
    spread = max(float(value.std()), 1e-3)
    scale = 4.0 / spread
    return scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * cut)


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, id_col="doc_id", text_col="text") -> Network:
    return fit(training_rows(docs, labels, "toxic", per_class, id_col, text_col))


def score_column(spark: SparkSession, net: Network, text_col: str = "text") -> Column:
    """The score of a text column as an expression."""
    shared = spark.sparkContext.broadcast((net.p, net.rows, net.constant))
    local = None

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        nonlocal local
        if local is None:
            local = Network(*shared.value)
        return pd.Series(local.score(texts.tolist()))

    return score(text_of(text_col))


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row. No shuffle."""
    scored = docs.select(F.col(id_col).alias("_id"), score_column(docs.sparkSession, net, text_col).alias("score"))
    return scored.select(
        F.col("_id").alias(id_col),
        held_out("_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
