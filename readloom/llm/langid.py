"""Language identification with a byte convolutional network, in NumPy.

Filters of 2, 3 and 4 bytes over learned byte embeddings, the maximum of each
filter over a window of 256 bytes, and a softmax.  Training is mini-batch Adam
on windows of labelled texts.

For scoring, embedding and filters are folded into tables: a filter's response
to two neighbouring bytes is one row of a 65 536-row table, so a window of any
text costs a few look-ups a byte and no multiplication.  A text is cut into
windows that overlap by three bytes and cover all of it; its score is the mean
of the windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import _text as T
from readloom.llm._common import fold

WINDOW, OVERLAP, WIDTHS = 256, 3, (2, 3, 4)
FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
_BATCH = 256


@dataclass(frozen=True)
class Settings:
    """The sample is about rows texts for each language, at most max_rows and max_bytes of windows in all, dealt evenly.

    Every language is learnt, from one text at least, however many there are.
    """

    rows: int = 400
    max_rows: int = 4000
    max_bytes: int = 24 << 20
    windows: int = 3
    filters: int = 16
    dims: int = 8
    epochs: int = 6
    rate: float = 0.01
    seed: int = 5


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]
    filter_bias: list[np.ndarray]
    soft: np.ndarray
    bias: np.ndarray


def _padded(data: bytes) -> np.ndarray:
    """A window, zero-padded."""
    row = np.zeros(WINDOW, np.uint8)
    row[: len(data)] = np.frombuffer(data, np.uint8)
    return row


class _Trainer:
    def __init__(self, s: Settings, classes: int):
        rng = self.rng = np.random.default_rng(s.seed)
        self.s = s
        self.p = {"e": rng.normal(0, 0.5, (256, s.dims)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * s.dims), (w * s.dims, s.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(s.filters, np.float32)
        wide = s.filters * len(WIDTHS)
        self.p["w"] = rng.normal(0, 1 / np.sqrt(wide), (wide, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, places = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            h = cols @ p[f"k{w}"] + p[f"b{w}"]
            at = h.argmax(axis=1)
            pooled.append(np.take_along_axis(h, at[:, None, :], axis=1)[:, 0, :])
            places.append(at)
        raw = np.concatenate(pooled, axis=1)
        a = np.maximum(raw, 0)
        z = a @ p["w"] + p["c"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-12).mean())
        q[np.arange(n), y] -= 1
        q /= n
        g = {"w": a.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        d_raw = (q @ p["w"].T) * (raw > 0)
        f = self.s.filters
        for i, w in enumerate(WIDTHS):
            d, at = d_raw[:, i * f : (i + 1) * f], places[i]
            taps = at[:, :, None] + np.arange(w)
            seen = x[np.arange(n)[:, None, None], taps]
            cols = p["e"][seen].reshape(n, f, -1)
            g[f"k{w}"] = np.einsum("nf,nfd->df", d, cols)
            g[f"b{w}"] = d.sum(axis=0)
            back = (d[:, :, None] * p[f"k{w}"].T[None]).reshape(n, f, w, -1)
            np.add.at(g["e"], seen.ravel(), back.reshape(-1, back.shape[-1]))
        self.t += 1
        for k, grad in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad * grad
            hat = self.m[k] / (1 - 0.9**self.t)
            p[k] -= self.s.rate * hat / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return loss


def fit(settings: Settings, windows: Iterator[tuple[bytes, str]]) -> Network | None:
    """A network for the languages of (window, language) pairs; None without any."""
    rng = np.random.default_rng(settings.seed)
    rows, labels = [], []
    for data, language in windows:
        rows.append(_padded(data))
        labels.append(language)
    if not rows:
        return None
    languages = sorted(set(labels))
    x, y = np.array(rows), np.searchsorted(languages, labels)
    trainer = _Trainer(settings, len(languages))
    for _ in range(settings.epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            trainer.step(x[order[k : k + 64]], y[order[k : k + 64]])
    return _folded(trainer.p, languages, settings)


def _folded(p: dict[str, np.ndarray], languages: list[str], s: Settings) -> Network:
    """Tables of pairs of bytes: one for width 2, a pair and a byte for 3, two pairs for 4."""
    one = {w: [p["e"] @ p[f"k{w}"][j * s.dims : (j + 1) * s.dims] for j in range(w)] for w in WIDTHS}
    pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
    tables = [pair(*one[2]), pair(one[3][0], one[3][1]), one[3][2].astype(np.float32), pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3])]
    return Network(languages, tables, [p[f"b{w}"] for w in WIDTHS], p["w"], p["c"])


def windows_proba(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of the languages for rows of WINDOW bytes."""
    out = np.empty((len(x), len(net.languages)), np.float32)
    t2, t3, t3c, t4, t4b = net.tables
    for k in range(0, len(x), _BATCH):
        part = x[k : k + _BATCH]
        pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        h2 = t2[pairs].max(axis=1)
        h3 = t3[pairs[:, :-1]]
        h3 += t3c[part[:, 2:]]
        h4 = t4[pairs[:, :-2]]
        h4 += t4b[pairs[:, 2:]]
        a = np.concatenate([h2 + net.filter_bias[0], h3.max(axis=1) + net.filter_bias[1], h4.max(axis=1) + net.filter_bias[2]], axis=1)
        z = np.maximum(a, 0) @ net.soft + net.bias
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        out[k : k + len(part)] = q / q.sum(axis=1, keepdims=True)
    return out


def classify(net: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its mean probability for each text; index -1 for no bytes."""
    best, score = np.full(len(column), -1), np.zeros(len(column))
    step = WINDOW - OVERLAP
    for lo, hi in T.slices(column, 1 << 20):
        data, offsets = T.padded(column.slice(lo, hi - lo))
        size = np.diff(offsets) - 2
        number = np.where(size > WINDOW, -(-(size - OVERLAP) // step), (size > 0).astype(np.int64))
        doc = np.repeat(np.arange(hi - lo), number)
        nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        begin = nth * step
        length = np.minimum(size[doc] - begin, WINDOW)
        total = np.zeros((hi - lo, len(net.languages)))
        for k in range(0, len(doc), _BATCH):
            b, n = (offsets[:-1][doc] + 1 + begin)[k : k + _BATCH], length[k : k + _BATCH]
            at = b[:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < n[:, None]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
            np.add.at(total, doc[k : k + _BATCH], windows_proba(net, x) * n[:, None])
        weight = np.bincount(doc, length, minlength=hi - lo)
        some = weight > 0
        mean = total[some] / weight[some][:, None]
        best[lo:hi][some], score[lo:hi][some] = mean.argmax(axis=1), mean.max(axis=1)
    return best, score


def labelled(docs: DataFrame, s: Settings) -> Iterator[tuple[bytes, str]]:
    """Windows of texts with their lang, from outside the held-out fold.

    All languages share max_rows and max_bytes evenly; of each, up to 1.2 * rows
    documents with the smallest id hashes are taken, one at least.  Windows are
    cut in the executors, so a text's length doesn't matter.  A repeated doc_id
    counts once in a language.
    """
    usable = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).collect()
    if not counts:
        return
    most = max(1, min(int(1.2 * s.rows), s.max_rows // len(counts), s.max_bytes // (len(counts) * s.windows * WINDOW)))
    # Twice as many as wanted pass by their hash, so that few rows are ordered and hardly ever too few.
    shares = [(r.lang, min(1.0, (2 * most + 20) / max(r.ids, 1))) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    data = F.col("text").cast("binary")
    last = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    starts = (F.pmod(F.xxhash64("doc_id", F.lit(k)), last + 1).cast("int") for k in range(s.windows))
    pieces = F.array_distinct(F.array(*(F.substring(data, at + 1, F.lit(WINDOW)) for at in starts)))
    picked = (
        usable.join(share, "lang")
        .where(uniform < F.col("share"))
        .groupBy("lang", "doc_id")
        .agg(F.min(pieces).alias("pieces"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(uniform, "doc_id")))
        .where(F.col("nth") <= most)
    )
    for r in sorted(picked.collect(), key=lambda r: (r.nth, r.lang)):
        for piece in r.pieces:
            yield bytes(piece), r.lang


def languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang, ...).

    Held out are ids with crc32 mod 3 = 1.  lang_pred is `und` with score 0 for a
    null text or one without any letter, and for every text if nothing could be
    learnt.  A null doc_id is not held out and never learnt from.  Other columns
    are ignored, repeated rows are scored each, an empty docs gives an empty
    result.  The network has a fixed size; scoring is one scan and one Arrow map.
    """
    net = fit(settings, labelled(docs, settings))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score = classify(net, batch.column("text")) if net else (np.full(n, -1), np.zeros(n))
            letters = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            known = letters & (best >= 0)
            names = np.array([*(net.languages if net else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0))],
                ["doc_id", "lang_pred", "score"],
            )

    text = F.col("text").cast("string")
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")
