"""Subword-bag text classifiers: hashed word and n-gram vectors, averaged, then a softmax.

A model holds a vector for each of 2**bits buckets.  A bag is averaged and fed
to a linear softmax; vectors and softmax are trained jointly by stochastic
gradient descent (Adagrad steps) in NumPy.  Because averaging and the softmax
are linear, scoring needs only each bucket's dot product with the difference of
the two softmax rows: one float a bucket, looked up for every n-gram of every
byte of the text.

Features of a word: its own hash and all byte n-grams of 3 to 5 bytes that lie
in it or reach one separator beyond it.  A word that repeats the one before has
a single feature of its own instead (the word bigram "the same again").
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from readloom.llm import _text as T

SIZES = (3, 4, 5)
#: Characters of labelled texts that are cut into words at a time; types are numbered in that order.
GROUP = 1 << 20
_MUL = np.uint32(0x01000193)
_FIB = np.uint32(0x9E3779B1)
_CODE = np.random.default_rng(40961).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class Settings:
    """How texts become features, and how a model is fitted.

    window: words of a passage, scored at a stride of half of it; 0 scores the
    whole document as one bag.  rows and max_bytes bound the labelled sample;
    balanced takes at most half of it from either label.
    """

    lower: bool
    alnum: bool
    window: int = 0
    bits: int = 17
    dims: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.5
    adaptive: bool = True
    rows: int = 3000
    balanced: bool = False
    max_bytes: int = 24 << 20
    seed: int = 11

    @property
    def kind(self) -> np.ndarray:
        return T.ALNUM if self.alnum else T.NON_SPACE


@dataclass
class Model:
    settings: Settings
    logits: np.ndarray
    bias: float
    trained_on: int = 0
    history: list[float] = field(default_factory=list)


def _codes(data: np.ndarray, inside: np.ndarray, lower: bool) -> np.ndarray:
    code = _CODE[T.LOWER] if lower else _CODE
    out = code[data]
    out *= inside
    return out


def _ngrams(code: np.ndarray, inside: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size n: bucket and validity of the n-gram that starts at each byte."""
    shift = np.uint32(32 - bits)
    have = SIZES[0] - 1
    h = code[: len(code) - have + 1].copy()
    for j in range(1, have):
        h *= _MUL
        h += code[j : len(code) - have + 1 + j]
    valid = None
    for n in SIZES:
        if len(code) < n:
            return
        h = h[: len(code) - n + 1] * _MUL
        h += code[n - 1 :]
        inner = inside[n - 2 : len(inside) - 1]
        valid = inner.copy() if valid is None else valid[: len(inner)] & inner
        salted = h ^ np.uint32(n * 0x9E37)
        salted ^= salted >> np.uint32(15)
        yield n, (salted * _FIB) >> shift, valid


def _word_bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sizes(lengths: np.ndarray) -> np.ndarray:
    """Number of features of a word of so many bytes."""
    return 1 + sum(np.maximum(lengths - (n - 3), 0) for n in SIZES)


def _repeats(w: T.Words) -> np.ndarray:
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    begin = w.first[:-1][w.counts > 0]
    again[begin] = False
    return again


def _passages(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last-plus-one word (within the document) of each passage."""
    step = max(window // 2, 1)
    number = np.where(counts > window, -(-(counts - window) // step) + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    lo = np.minimum(nth * step, np.maximum(counts[doc] - window, 0))
    return doc, lo, np.minimum(lo + window, counts[doc])


def score(model: Model, column: pa.Array) -> np.ndarray:
    """The probability of label 1 for each text; an empty or null text gets that of an empty bag."""
    s, out = model.settings, np.empty(len(column))
    again_bucket = _again_bucket(s.bits)
    for lo, hi in T.slices(column):
        data, offsets = T.padded(column.slice(lo, hi - lo))
        w = T.words(data, offsets, s.kind, s.lower)
        z = np.full(hi - lo, model.bias)
        if len(w.starts):
            inside = s.kind[data]
            total = np.zeros(len(data), np.float32)
            for n, bucket, valid in _ngrams(_codes(data, inside, s.lower), inside, s.bits):
                got = model.logits[bucket]
                got *= valid
                total[: len(got)] += got
            value = np.add.reduceat(total, w.starts - 1).astype(np.float64)
            value += model.logits[_word_bucket(w.hashes, s.bits)]
            number = _sizes(w.ends - w.starts).astype(np.float64)
            again = _repeats(w)
            value[again] = model.logits[again_bucket]
            number[again] = 1
            value = np.concatenate(([0], np.cumsum(value)))
            number = np.concatenate(([0], np.cumsum(number)))
            if s.window:
                doc, a, b = _passages(w.counts, s.window)
                a, b = a + w.first[doc], b + w.first[doc]
                mean = (value[b] - value[a]) / (number[b] - number[a])
                best = np.full(hi - lo, -np.inf)
                np.maximum.at(best, doc, mean)
                z = np.where(w.counts > 0, best + model.bias, z)
            else:
                of = number[w.first[1:]] - number[w.first[:-1]]
                sums = value[w.first[1:]] - value[w.first[:-1]]
                z = z + np.divide(sums, of, out=np.zeros_like(sums), where=of > 0)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return out


def _again_bucket(bits: int) -> int:
    return int(_word_bucket(T.mix(np.array([0xA6A1], np.uint64)), bits)[0])


class _Corpus:
    """Labelled texts as sequences of word types, with the feature list of each type."""

    def __init__(self, settings: Settings, texts: Iterable[tuple[str, int]]):
        s = settings
        rows, labels = [], []
        kinds: dict[int, int] = {0: 0}
        spelled: list[bytes] = [b""]
        for group in _groups(texts, GROUP):
            labels += [y for _, y in group]
            w = T.text_words([x for x, _ in group], s.kind, s.lower)
            again = _repeats(w)
            unique, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            ids = np.empty(len(unique), np.int32)
            for i, (h, p) in enumerate(zip(unique.tolist(), at.tolist(), strict=True)):
                k = kinds.get(h)
                if k is None:
                    k = kinds[h] = len(spelled)
                    spelled.append(w.data[w.starts[p] : w.ends[p]].tobytes())
                ids[i] = k
            seq = ids[inverse] if len(unique) else np.zeros(0, np.int32)
            seq[again] = 0
            rows += [seq[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.rows, self.labels = rows, np.array(labels, np.int64)
        self.begin, self.feature = self._features(s, spelled)
        self.sizes = np.diff(self.begin)

    @staticmethod
    def _features(s: Settings, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """CSR lists of buckets, made for some types at a time; type 0 is the repeated word."""
        numbers, lists = [np.array([1])], [np.array([_again_bucket(s.bits)], np.int32)]
        for at in range(1, len(spelled), 1 << 14):
            some = spelled[at : at + (1 << 14)]
            data = np.frombuffer(b" " + b"".join(x + b" " for x in some), np.uint8)
            w = T.words(data, np.array([0, len(data)]), s.kind, s.lower)
            inside = s.kind[data]
            owner = np.append(np.repeat(np.arange(len(some), dtype=np.int32), w.ends - w.starts + 1), np.int32(0))
            owners = [np.arange(len(some), dtype=np.int32)]
            buckets = [_word_bucket(w.hashes, s.bits).astype(np.int32)]
            for _, bucket, valid in _ngrams(_codes(data, inside, s.lower), inside, s.bits):
                where = np.flatnonzero(valid)
                buckets.append(bucket[where].astype(np.int32))
                owners.append(owner[where])
            every = np.concatenate(owners)
            lists.append(np.concatenate(buckets)[np.argsort(every, kind="stable")])
            numbers.append(np.bincount(every, minlength=len(some)))
        return np.concatenate(([0], np.cumsum(np.concatenate(numbers)))), np.concatenate(lists)


def _groups(texts: Iterable[tuple[str, int]], limit: int) -> Iterator[list[tuple[str, int]]]:
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x[0])
        if size > limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _segments(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + size[i] - 1 of all i, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class _Trainer:
    def __init__(self, settings: Settings, corpus: _Corpus):
        self.s, self.c = settings, corpus
        rng = self.rng = np.random.default_rng(settings.seed)
        self.vectors = rng.uniform(-0.5, 0.5, (1 << settings.bits, settings.dims)).astype(np.float32) / settings.dims
        self.vectors_g = np.full((1 << settings.bits, 1), 1e-6, np.float32)
        self.soft = rng.normal(0, 0.3, (settings.dims, 2)).astype(np.float32)
        share = np.clip(corpus.labels.mean() if len(corpus.labels) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = np.log(np.array([1 - share, share], np.float32))
        self.soft_g = np.full(self.soft.shape, 1e-6, np.float32)
        self.bias_g = np.full(2, 1e-6, np.float32)

    def step(self, bags: list[np.ndarray], labels: np.ndarray, rate: float) -> float:
        """One mini-batch: forward, backward and an Adagrad step; returns the mean loss."""
        c = self.c
        sizes = np.array([len(b) for b in bags])
        flat = np.concatenate(bags)
        types, inverse = np.unique(flat, return_inverse=True)
        n = c.sizes[types]
        feats = c.feature[_segments(c.begin[types], n)]
        begin = np.cumsum(n) - n
        typed = np.add.reduceat(self.vectors[feats], begin, axis=0)
        doc_begin = np.cumsum(sizes) - sizes
        weight = 1 / np.add.reduceat(n[inverse].astype(np.float32), doc_begin)
        mean = np.add.reduceat(typed[inverse], doc_begin, axis=0) * weight[:, None]
        z = mean @ self.soft + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(bags)), labels] + 1e-12).mean())
        d = p
        d[np.arange(len(bags)), labels] -= 1
        g_soft, g_bias = mean.T @ d / len(bags), d.mean(axis=0)
        g_doc = (d @ self.soft.T) * weight[:, None]
        per_doc = np.repeat(np.arange(len(bags)), sizes)
        order = np.argsort(inverse, kind="stable")
        g_type = np.add.reduceat(g_doc[per_doc[order]], np.searchsorted(inverse[order], np.arange(len(types))), axis=0)
        order = np.argsort(feats, kind="stable")
        ordered = feats[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        g = np.add.reduceat(np.repeat(g_type, n, axis=0)[order], first, axis=0)
        rows = ordered[first]
        if self.s.adaptive:
            self.vectors_g[rows] += (g * g).mean(axis=1, keepdims=True)
            g /= np.sqrt(self.vectors_g[rows])
        self.vectors[rows] -= rate * g
        self.soft_g += g_soft * g_soft
        self.soft -= 0.1 * rate * g_soft / np.sqrt(self.soft_g)
        self.bias_g += g_bias * g_bias
        self.bias -= 0.1 * rate * g_bias / np.sqrt(self.bias_g)
        return loss

    def logits(self) -> np.ndarray:
        return (self.vectors @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32)

    def _best(self, logits: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """The highest-scoring passage (or whole document) of each document, and its mean."""
        c = self.c
        of_type = np.add.reduceat(logits[c.feature], c.begin[:-1])
        for row in c.rows:
            if not len(row):
                yield 0, 0, 0.0
                continue
            v = np.concatenate(([0], np.cumsum(of_type[row], dtype=np.float64)))
            m = np.concatenate(([0], np.cumsum(c.sizes[row])))
            _, a, b = _passages(np.array([len(row)]), self.s.window or len(row))
            mean = (v[b] - v[a]) / (m[b] - m[a])
            k = int(np.argmax(mean))
            yield int(a[k]), int(b[k]), float(mean[k])

    def outputs(self, logits: np.ndarray) -> np.ndarray:
        return np.array([x for _, _, x in self._best(logits)])

    def bags(self, epoch: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Whole documents; or, for passages, the best one of each document and a random one of those labelled 0.

        The first epochs take whole documents in either case, to tell the classes apart at all.
        """
        c, window = self.c, self.s.window
        keep = [i for i, r in enumerate(c.rows) if len(r)]
        if not window or epoch < 2:
            return [c.rows[i] for i in keep], c.labels[keep]
        best, bags, labels = list(self._best(self.logits())), [], []
        for i in keep:
            row, (a, b, _) = c.rows[i], best[i]
            bags.append(row[a:b])
            labels.append(int(c.labels[i]))
            if not c.labels[i]:
                a = int(self.rng.integers(0, max(len(row) - window, 0) + 1))
                bags.append(row[a : a + window])
                labels.append(0)
        return bags, np.array(labels)

    def fit(self) -> list[float]:
        history = []
        for epoch in range(self.s.epochs):
            bags, labels = self.bags(epoch)
            order = self.rng.permutation(len(bags))
            batch = self.s.batch * (4 if self.s.window and epoch >= 2 else 1)
            losses = [
                self.step([bags[i] for i in order[k : k + batch]], labels[order[k : k + batch]], self.s.rate)
                for k in range(0, len(order), batch)
            ]
            history.append(float(np.mean(losses)) if losses else 0.0)
        return history


def fit(settings: Settings, texts: Iterable[tuple[str, int]]) -> Model:
    """Fit a model on (text, label) pairs, all held in memory as word types.

    Without texts, or with one class only, the model gives that class's share
    (one half without any) to every text.
    """
    corpus = _Corpus(settings, texts)
    labels = corpus.labels
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(settings, np.zeros(1 << settings.bits, np.float32), float(np.log(share / (1 - share))), len(labels))
    apart = np.arange(len(labels)) % 4 == 3
    kept = corpus.rows, labels
    corpus.rows = [r for r, out in zip(kept[0], apart, strict=True) if not out]
    corpus.labels = labels[~apart]
    trainer = _Trainer(settings, corpus)
    history = trainer.fit()
    logits, bias = trainer.logits(), float(trainer.bias[1] - trainer.bias[0])
    corpus.rows = [r for r, out in zip(kept[0], apart, strict=True) if out]
    scale, shift = _calibration(trainer.outputs(logits) + bias, labels[apart])
    return Model(settings, logits * np.float32(scale), bias * scale + shift, len(labels), history)


def _calibration(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of the output for labels that the vectors weren't fitted to (Platt's smoothed targets)."""
    if len(y) < 20 or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        d, w = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        move *= min(1, 2 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
