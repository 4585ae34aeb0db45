"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts drawn from all (U, toxic or not) train a
linear scorer. With class prior pi the risk is

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),

where R_x(s) is the mean logistic loss of x taken as s; when the bracket turns
negative the step undoes it instead (the non-negative correction). Known clean
rows are used for the prior alone.

A text's features are its distinct words, the beginnings of its words, and
beginnings that several of its words share (insults often have many endings).
Only features clearly commoner in P than in U are learned, with weights of zero
and more, by proximal gradient steps; the penalty and the cut are chosen on
margins of models that did not see the text (cross-fitting on the learned side).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.sampling import some_rows
from lattica.llm.textbytes import U, Block, blocks, mix, release, spans, words

BITS = 22
#: Bytes of the beginnings of words, and how many distinct words must share one to count again.
BEGINNINGS, SHARED = (4, 5, 6, 7, 8), (2, 4)
#: Confirmed toxic rows and unlabelled rows that are learned from; longer texts (in bytes) are not learned from, but scored whole.
POSITIVE_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 2000, 6000, 1 << 16
#: A feature counts if it stands in so many sampled texts, two of them toxic, and is so many times as common in P as in U.
LEAST_TEXTS, LIFT = 4, 2.0
STEPS, RATE, FOLDS = 200, 0.3, 3
#: Penalties on weights that cross-fitting chooses from.
PENALTIES = (1e-3, 3e-3, 6e-3)
THRESHOLD = 0.7

#: Word characters are ASCII letters and digits and all bytes of other characters.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, end to end, and each text's first."""
    w = words(block, space=BREAK)
    low, bits = U(64 - BITS), U(BITS)
    text = np.repeat(np.arange(block.n, dtype=np.uint64), np.diff(w.bounds)) << bits
    own, at = np.unique(text | w.hashes >> low, return_index=True)
    starts, ends, text = w.starts[at], w.ends[at], text[at]
    found = [own]
    for n in BEGINNINGS:
        k = np.flatnonzero(ends - starts > n)
        h = mix(spans(block.data, starts[k], starts[k] + n) ^ U(0x5851F42D4C957F2D))
        own, count = np.unique(text[k] | h >> low, return_counts=True)
        found.append(own)
        for least in SHARED:
            often = own[count >= least]
            again = mix((often & U((1 << BITS) - 1)) + U(least << BITS))
            found.append(often >> bits << bits | again >> low)
    both = np.unique(np.concatenate(found)).astype(np.int64)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(block.n + 1))


@dataclass
class Model:
    used: np.ndarray  # features with a weight, ascending
    weights: np.ndarray
    bias: float
    cut: float
    scale: float

    def margins(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(f) + 1)
        if len(self.used):
            at = np.minimum(np.searchsorted(self.used, f), len(self.used) - 1)
            np.cumsum(np.where(self.used[at] == f, self.weights[at], 0.0), out=total[1:])
        return total[first[1:]] - total[first[:-1]] + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the margin; THRESHOLD at the cut."""
        x = self.scale * (margins - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(m: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """``pi * R_p(+)``, the bracket, and the slope by margin of what the step goes down: their sum, or minus a negative bracket."""
    n_pos, n_un = max(1, positive.sum()), max(1, unlabelled.sum())
    p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
    as_negative = np.logaddexp(0, m)
    right = prior * np.logaddexp(0, -m)[positive].sum() / n_pos
    bracket = as_negative[unlabelled].sum() / n_un - prior * as_negative[positive].sum() / n_pos
    d = np.zeros(len(m))
    if bracket >= 0:
        d[positive] = -prior / n_pos  # (p - 1) from R_p(+), -p from the bracket
        d[unlabelled] = p[unlabelled] / n_un
    else:
        d[positive] = prior * p[positive] / n_pos
        d[unlabelled] = -p[unlabelled] / n_un
    return float(right), float(bracket), d


class Problem:
    """Texts as rows, the features worth learning as columns."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]):
        self.n_pos, self.n = len(positive), len(positive) + len(unlabelled)
        in_pos, in_un = (sum((np.bincount(t, minlength=1 << BITS).astype(np.int32) for t in _parts(own)), np.zeros(1 << BITS, np.int32)) for own in (positive, unlabelled))
        good = (in_pos + in_un >= LEAST_TEXTS) & (in_pos >= 2) & (in_pos * max(1, len(unlabelled)) >= LIFT * in_un * self.n_pos)
        self.used = np.flatnonzero(good)
        kept = [t[good[t]] for t in positive + unlabelled]
        self.col = np.searchsorted(self.used, np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(t) for t in kept])

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + bias

    def fit(self, take: np.ndarray, prior: float, penalty: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
        """Weights and bias from the rows of ``take``: accelerated proximal steps, scaled by how common a feature is."""
        is_pos = np.arange(self.n) < self.n_pos
        positive, unlabelled = take & is_pos, take & ~is_pos
        known = take[self.row]
        col, row = self.col[known], self.row[known]
        n = len(self.used)
        share = prior * np.bincount(col[is_pos[row]], minlength=n) / max(1, positive.sum()) + np.bincount(col[~is_pos[row]], minlength=n) / max(1, unlabelled.sum())
        rate = RATE / np.sqrt(share + 1e-4)
        w, ahead, bias, t = np.zeros(n), np.zeros(n), float(np.log(prior / (1 - prior))), 1.0
        for _ in range(steps):
            d = risk(np.bincount(row, ahead[col], self.n) + bias, positive, unlabelled, prior)[2]
            new = np.maximum(0, ahead - rate * (np.bincount(col, d[row], n) + penalty))
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + min((t - 1) / later, 0.9) * (new - w), new, later
            bias -= 0.5 * RATE * d.sum()
        return w, float(bias)


def _parts(texts: list[np.ndarray], at_once: int = 256) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), at_once):
        yield np.concatenate(texts[i : i + at_once])


def best_cut(m: np.ndarray, n_pos: int, prior: float) -> tuple[float, float]:
    """Cut where recall on P squared over the share of U taken as toxic is largest, as F1 is there; and that merit."""
    cuts = np.unique(np.quantile(m, np.linspace(0, 1, 2000)))
    p, u = np.sort(m[:n_pos]), np.sort(m[n_pos:])
    recall = 1 - np.searchsorted(p, cuts) / max(1, len(p))
    share = 1 - np.searchsorted(u, cuts) / len(u) if len(u) else np.ones(len(cuts))
    merit = recall**2 / np.maximum(share, prior / 2)
    good = np.flatnonzero(merit >= merit.max() * 0.99)
    k = good[0]  # of nearly equal ones the lowest: unseen texts score lower than those learned from
    return float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[0] - 1.0), float(merit.max())


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit on the non-negative risk; each text an array of its distinct features."""
    problem = Problem(positive, unlabelled)
    fold = np.random.default_rng(1).permutation(problem.n) % FOLDS
    best: tuple[float, float, float] | None = None  # a larger penalty must be better by more than chance
    for penalty in PENALTIES:
        m = np.zeros(problem.n)
        for k in range(FOLDS):
            m[fold == k] = problem.margins(*problem.fit(fold != k, prior, penalty))[fold == k]
        cut, merit = best_cut(m, problem.n_pos, prior)
        if best is None or merit > best[0] * 1.02:
            best = merit, penalty, cut
    w, bias = problem.fit(np.ones(problem.n, bool), prior, best[1])
    spread = float(np.std(problem.margins(w, bias)))
    return Model(problem.used[w > 0], w[w > 0], bias, best[2], 4 / max(1e-6, spread))


def _sampled(rows: DataFrame, n: int, seed: int) -> list[np.ndarray]:
    """Features of at most ``n`` of ``rows(doc_id, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                f, first = features(block)
                raw = [f[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(block.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n).cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "f"])
        release()

    rows = rows.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    found = some_rows(rows, n, seed).mapInArrow(work, "doc_id long, f binary").limit(n).collect()
    return [np.frombuffer(r.f, np.int32) for r in sorted(found, key=lambda r: (r.doc_id, r.f))]


def learn(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without confirmed toxic texts.

    Both tables hold only what may be learned from. At most ``positive_rows`` and
    ``unlabelled_rows`` rows reach the driver, also where ids or rows repeat;
    null ids, texts or labels and texts over ``SAMPLE_BYTES`` are not learned
    from. Empty tables give None. Other columns are ignored.
    """
    labels = labels.select("doc_id", "toxic").dropna()
    share = labels.agg(F.avg("toxic").alias("prior")).first()["prior"]
    if not share:
        return None
    docs = docs.select("doc_id", "text").dropna()
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    toxic = toxic.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(positive_rows)  # so few ids can go to all texts
    positive = _sampled(docs.join(F.broadcast(toxic), "doc_id", "left_semi"), positive_rows, 11)
    if not positive:
        return None
    return train(positive, _sampled(docs, unlabelled_rows, 12), min(0.9, float(share)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row of ``docs(doc_id, text)``, repeated rows each; an empty table gives none.

    Null and empty texts get the score of a text without words; without a model all score 0.
    Texts of any length are scored whole. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                s = np.zeros(block.n) if model is None else model.scores(model.margins(*features(block)))
                ids = batch.column(0).slice(block.first, block.n).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, predicted int")
