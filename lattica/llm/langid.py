"""Language of whole texts by a bidirectional gated recurrent network over bytes.

A window of ``WINDOW`` bytes runs through a forward and a backward gated unit
(update gate, reset gate, candidate; x / (1 + |x|) as the squashing function,
which is cheap and keeps gradients alive). Every position gets a distribution
over the learned languages from both states; a text's distribution is the mean
over its letter positions, all windows of the whole text counted. Training is
plain backpropagation through time in NumPy with Adam on windows of a bounded
sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lattica.llm.sampling import under
from lattica.llm.textbytes import Block, blocks, release

WINDOW = 96
HIDDEN = 12
#: Labelled rows per language, windows per row, and training steps.
SAMPLE_ROWS, SAMPLE_WINDOWS = 600, 8
STEPS, BATCH, RATE = 220, 256, 0.02
PAD = 256
#: Mean probability of the best language below which a text counts as in none.
LEAST_SCORE = 0.5

LETTER = np.zeros(257, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Gru:
    """One direction: byte rows ``e`` (257, 3h) for update, reset, candidate; ``u`` (2h, h) and ``v`` (h, h)."""

    e: np.ndarray
    u: np.ndarray
    v: np.ndarray


@dataclass
class Model:
    langs: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray  # (langs, 2h + 1), the last column is the bias


def _cell(x: np.ndarray, h: np.ndarray, net: Gru) -> tuple[np.ndarray, ...]:
    """New state (h, batch) and what the way back needs; ``x`` is overwritten."""
    n = len(h)
    g = x[: 2 * n]
    g += net.u @ h
    d = np.abs(g)
    d += 1
    g /= d
    g *= 0.5
    g += 0.5
    z, r = g[:n], g[n:]
    c = x[2 * n :]
    c += net.v @ (r * h)
    d = np.abs(c)
    d += 1
    c /= d
    new = c - h
    new *= z
    new += h
    return new, z, r, c


def _inputs(net: Gru) -> np.ndarray:
    """Byte rows by column, with a padding byte that keeps the state."""
    e = net.e.T.copy()
    e[: net.u.shape[1], PAD] = -1e9
    return e


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Model:
    """Fit on ``(lang, window)`` pairs; languages weigh alike."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    rows = np.full((len(samples), WINDOW), PAD, np.intp)
    for row, (_, raw) in zip(rows, samples, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)[:WINDOW]
    label = np.array([langs.index(lang) for lang, _ in samples])
    by_lang = [np.flatnonzero(label == i) for i in range(len(langs))]

    def fresh(*shape: int, scale: float) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    nets = [Gru(fresh(257, 3 * hidden, scale=0.6), fresh(2 * hidden, hidden, scale=0.3), fresh(hidden, hidden, scale=0.3)) for _ in range(2)]
    out = fresh(len(langs), 2 * hidden + 1, scale=0.3)
    params = [p for net in nets for p in (net.e, net.u, net.v)] + [out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, BATCH // len(langs))) for own in by_lang])
        grads = _gradients(nets, out, rows[pick].T, label[pick])
        rate = RATE * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(langs, nets[0], nets[1], out)


def _gradients(nets: list[Gru], out: np.ndarray, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over letter positions; ``x`` is (time, batch)."""
    steps, batch = x.shape
    hidden = nets[0].u.shape[1]
    orders = [range(steps), range(steps - 1, -1, -1)]
    states = np.zeros((2, steps, hidden, batch), np.float32)
    kept: list[dict[int, tuple]] = [{}, {}]
    for side, (net, order) in enumerate(zip(nets, orders, strict=True)):
        rows = _inputs(net)
        h = np.zeros((hidden, batch), np.float32)
        for t in order:
            before = h
            h, z, r, c = _cell(rows.take(x[t], axis=1), h, net)
            kept[side][t] = before, z, r, c
            states[side, t] = h
    both = np.concatenate([states[0], states[1], np.ones((steps, 1, batch), np.float32)], axis=1)
    logits = out @ both
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[:, label, np.arange(batch)] -= 1
    weight = LETTER[x]
    p *= (weight / max(1.0, weight.sum()))[:, None, :]
    grad_out = np.einsum("tcb,thb->ch", p, both)
    down = np.einsum("ch,tcb->thb", out, p)
    grads = []
    for side, (net, order) in enumerate(zip(nets, orders, strict=True)):
        ge, gu, gv = np.zeros_like(net.e), np.zeros_like(net.u), np.zeros_like(net.v)
        dh = np.zeros((hidden, batch), np.float32)
        pre = np.zeros((steps, 3 * hidden, batch), np.float32)
        for t in reversed(order):
            before, z, r, c = kept[side][t]
            dh = dh + down[t, side * hidden : (side + 1) * hidden]
            dc = dh * z * (1 - np.abs(c)) ** 2
            back = net.v.T @ dc
            slope = 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dz = dh * (c - before) * slope
            dr = back * before * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            gates = np.concatenate([dz, dr])
            gv += dc @ (r * before).T
            gu += gates @ before.T
            dh = dh * (1 - z) + back * r + net.u.T @ gates
            pre[t, : 2 * hidden], pre[t, 2 * hidden :] = gates, dc
        np.add.at(ge, x.ravel(), pre.transpose(0, 2, 1).reshape(-1, 3 * hidden))
        ge[PAD] = 0
        grads += [ge, gu, gv]
    return [np.clip(g, -1, 1) for g in grads] + [grad_out]


def _windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all windows, (window, time), and each text's first window."""
    sizes = np.diff(block.offsets)
    n = -(-sizes // WINDOW)
    first = np.zeros(block.n + 1, np.int64)
    np.cumsum(n, out=first[1:])
    text = np.repeat(np.arange(block.n), n)
    start = block.offsets[text] + (np.arange(first[-1]) - first[text]) * WINDOW
    x = np.full((first[-1], WINDOW), PAD, np.intp)
    at = start[:, None] + np.arange(WINDOW)
    real = at < block.offsets[text + 1][:, None]
    x[real] = block.data[at[real]]
    return x, first


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Distribution at every position of windows ``x`` (time, batch): (time, langs, batch)."""
    hidden = model.forward.u.shape[1]
    logits = np.empty((len(x), len(model.langs), x.shape[1]), np.float32)
    for side, net in enumerate((model.forward, model.backward)):
        rows = _inputs(net)
        w = np.ascontiguousarray(model.out[:, side * hidden : (side + 1) * hidden])
        h = np.zeros((hidden, x.shape[1]), np.float32)
        for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
            h = _cell(rows.take(x[t], axis=1), h, net)[0]
            if side == 0:
                np.matmul(w, h, out=logits[t])
            else:
                logits[t] += w @ h
    logits += model.out[:, -1:]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(model: Model, block: Block, at_once: int = 1536) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean distribution over letter positions, and the number of these."""
    x, first = _windows(block)
    total = np.zeros((len(x) + 1, len(model.langs) + 1))
    for a in range(0, len(x), at_once):
        own = np.ascontiguousarray(x[a : a + at_once].T)
        weight = LETTER[own]
        p = positions(model, own)
        total[a + 1 : a + 1 + own.shape[1], :-1] = np.einsum("tcb,tb->bc", p, weight)
        total[a + 1 : a + 1 + own.shape[1], -1] = weight.sum(axis=0)
    total = np.cumsum(total, axis=0)
    total = total[first[1:]] - total[first[:-1]]
    letters = np.rint(total[:, -1])
    return total[:, :-1] / np.maximum(letters, 1)[:, None], letters


def training_windows(labelled: DataFrame, rows_per_lang: int = SAMPLE_ROWS, per_row: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """Evenly spread windows of a bounded sample of ``labelled(doc_id, text, lang)``: ``rows_per_lang`` rows, also where ids repeat.

    The rows with the least hashes of doc_id and text, found for all languages at once; only hashes are moved to find them.
    """
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(11)).alias("k")).filter("text is not null and lang is not null")
    count = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    few = F.lit(False)  # hashes that can be among the least; the others are not moved
    for lang, n in count.items():
        few = few | (F.col("lang") == lang) & under(F.col("k"), 4 * rows_per_lang / n)
    labelled = labelled.filter(few)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    last = labelled.select("lang", "k").withColumn("n", rank).filter(F.col("n") <= rows_per_lang).groupBy("lang").agg(F.max("k").alias("k"))
    bounds = {r.lang: r.k for r in last.collect()}
    if not bounds:
        return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, cut = [], [], []
            for lang, text, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                langs.append(lang)
                keys.append(k)
                cut.append([raw[a : a + WINDOW] for a in np.linspace(0, max(0, len(raw) - WINDOW), min(per_row, 1 + len(raw) // WINDOW)).astype(int)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(cut, pa.list_(pa.binary()))], ["lang", "k", "raw"])

    low = F.create_map(*[x for lang, k in bounds.items() for x in (F.lit(lang), F.lit(k))])
    found: list[tuple[str, bytes]] = []
    chosen = labelled.filter(F.col("k") <= low[F.col("lang")]).select("lang", "text", "k").mapInArrow(work, "lang string, k long, raw array<binary>")
    for r in chosen.withColumn("n", rank).filter(F.col("n") <= rows_per_lang).collect():
        found += [(r.lang, bytes(x)) for x in r.raw if x]
    return sorted(found)


def labels(model: Model | None, block: Block) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a block."""
    lang: list[str] = ["und"] * block.n
    score = np.zeros(block.n)
    if model is None or not len(block.data):
        return lang, score
    p, letters = pooled(model, block)
    best = p.argmax(axis=1)
    plain = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((LETTER[block.data] > 0) & (block.data < 128), out=plain[1:])
    plain = plain[block.offsets[1:]] - plain[block.offsets[:-1]]
    for i in np.flatnonzero(letters):
        if plain[i] or any(map(str.isalpha, block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
            lang[i], score[i] = model.langs[best[i]], min(1.0, float(p[i, best[i]]))
    return lang, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``, repeated rows each; an empty table gives none.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    could be learned. Ties go to the language first in order. Texts of any length
    count whole; a null doc_id stays null; other columns are ignored, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                lang, score = labels(model, block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n).cast(pa.int64()), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least_score: float = LEAST_SCORE, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of ``docs`` whose text is in a language, columns as they were; no shuffle.

    A row goes if its text is null or has no letter, if no language reaches
    ``least_score`` of the mean distribution over its letters (mixed or garbled
    texts, or too short to tell), or if the language found is not among
    ``languages`` (None: all learned ones). Without a model only null and
    letterless texts go. Each of several equal rows is judged, null ids don't
    matter, an empty table stays empty.
    """
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for block in blocks(batch.column(at)):
                found, score = labels(model, block)
                keep += [x != "und" and s >= least_score and (languages is None or x in languages) for x, s in zip(found, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
            release()

    return docs.mapInArrow(work, docs.schema) if model is not None else docs.filter(F.col("text").rlike(r"\p{L}"))


def learn(labelled: DataFrame, **bounds: int) -> Model | None:
    """Model of the languages in ``labelled(doc_id, text, lang)``; None if there is nothing to learn from."""
    samples = training_windows(labelled, **bounds)
    return train(samples) if samples else None
