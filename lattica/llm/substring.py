"""Repeated passages: sliding runs of consecutive sentences, joined by hash.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or at a line
break. One of more than ``LONG`` words is cut where two neighbouring words hash
lower than all others in some ``WINDOW`` places between words, so a passage is
cut alike wherever it stands; its pieces count as sentences, and a piece that is
still as long is a run by itself. At every sentence starts a run and at every sentence ends one: the
shortest of at least ``SENTENCES`` sentences and ``LEAST_WORDS`` words. The
first place of a run is the least doc_id, then the least position; sentences
covered by a run at any other place go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.columns import fresh
from lattica.llm.textbytes import BASE, U, Block, blocks, mix, powers, release, words
from lattica.plans.scratch import Scratch

SENTENCES, LEAST_WORDS = 2, 20
#: Words from which a sentence is cut, and places between words of which the least may be a cut: at most so many words
#: are left out at each end of a passage, and one of LEAST_WORDS + 2 * WINDOW distinct words always has a run.
LONG, WINDOW = 20, 12

RUNS = "doc_id long, hash_a long, hash_b long, start int, end int, again boolean"


def _cuts(hashes: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Words of long sentences (each ends at a ``final`` word) after which a piece ends: the one least place of a window."""
    ends = np.flatnonzero(final) + 1
    count = np.diff(ends, prepend=0)
    long = np.repeat(count > LONG, count)
    at = np.flatnonzero(long[:-1] & ~final[:-1])  # places are named by the word before them
    if len(at) < WINDOW:
        return at[:0]
    place = mix(hashes[at] * U(BASE) + hashes[at + 1])
    n = len(at) - WINDOW + 1
    low, where, once = place[:n].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(1, WINDOW):
        here = place[k : k + n]
        less = here < low
        once = less | (once & (here != low))
        low[less], where[less] = here[less], k
    whole = at[WINDOW - 1 :] - at[:n] == WINDOW - 1  # all places of one sentence
    return at[np.unique((np.arange(n) + where)[once & whole])]


def runs(block: Block, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Text, two hashes, first and last byte and "stands earlier in its text" of every distinct run."""
    w = words(block)
    n = len(w.hashes)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, bool))
    if not n:
        return none
    data = block.data
    final = np.isin(data[w.ends - 1], [46, 33, 63])
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    final[:-1] |= breaks[w.starts[1:]] > breaks[w.ends[:-1]]
    last_of_text = w.bounds[1:][np.diff(w.bounds) > 0] - 1
    final[last_of_text] = True
    final[_cuts(w.hashes, final)] = True
    ends = np.flatnonzero(final) + 1  # in words, one per sentence
    starts = np.append(0, ends[:-1])
    text = np.searchsorted(w.bounds, starts, "right") - 1
    lo = np.searchsorted(text, np.arange(block.n))  # each text's first sentence
    hi = np.searchsorted(text, np.arange(block.n), "right")
    edge = np.append(starts, n)
    s = np.arange(len(starts))
    forward_end = np.maximum(s + sentences, np.searchsorted(edge, starts + least_words))
    backward_start = np.minimum(s + 1 - sentences, np.searchsorted(edge, ends - least_words, "right") - 1)
    ok_f, ok_b = forward_end <= hi[text], backward_start >= lo[text]
    alone = s[ends - starts > max(LONG, least_words)]
    a = np.concatenate([s[ok_f], backward_start[ok_b], alone])
    b = np.concatenate([forward_end[ok_f], s[ok_b] + 1, alone + 1])
    if not len(a):
        return none
    span = np.unique(a.astype(np.int64) << 32 | b)
    a, b = span >> 32, span & 0xFFFFFFFF
    first, last = edge[a], edge[b]  # words
    hashes = []
    for salt in (U(0), U(0x5851F42D4C957F2D)):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(w.hashes ^ salt) * powers(BASE, n), out=total[1:])
        back = powers(pow(BASE, -1, 1 << 64), n + 1)[first]
        hashes.append(mix((total[last] - total[first]) * back + (last - first).astype(np.uint64)).view(np.int64))
    text = text[a]
    base = block.offsets[text]
    begin, end = w.starts[first] - base, w.ends[last - 1] - base
    order = np.lexsort((begin, hashes[1], hashes[0], text))
    again = np.zeros(len(a), bool)
    x, y = order[1:], order[:-1]
    again[x] = (text[x] == text[y]) & (hashes[0][x] == hashes[0][y]) & (hashes[1][x] == hashes[1][y])
    return text, hashes[0], hashes[1], begin.astype(np.int32), end.astype(np.int32), again


def sentence_runs(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All runs of all texts; start and end are bytes in the text."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                text, *rest = runs(block, sentences, least_words)
                ids = batch.column(0).slice(block.first, block.n).cast(pa.int64()).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rest)], names)
            release()

    return docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(work, RUNS)


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, start, end)``: maximal byte spans of sentences covered by a run that is not its first.

    Null texts or ids have none. Rows that share a doc_id are one document, whose
    texts each keep what is first in it. Equal texts repeat each other: all but
    the least doc_id lose every sentence in a run. Texts of any length count
    whole; an empty table has no spans; other columns are ignored, whatever their names.
    """
    found = sentence_runs(docs, sentences, least_words)  # mapped twice: written runs would take as much disk as the texts
    key = ["hash_a", "hash_b"]
    shared = found.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("any_again"))
    shared = shared.filter("last > first or any_again").select(*key, "first")
    shared = Scratch(docs.sparkSession).keep(shared, "shared")  # written, so that the join can split a large key
    gone = found.join(shared, key).filter("doc_id > first or again").select("doc_id", "start", "end")
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return per_doc.mapInArrow(_merged, "doc_id long, start int, end int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document that touch become one."""
    for batch in batches:
        spans = batch.column(1)
        flat = spans.flatten()
        doc = np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
        start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        order = np.lexsort((start, doc))
        base = doc[order] << 32  # places of later documents lie beyond all of earlier ones
        start, end = start[order] + base, end[order] + base
        reach = np.maximum.accumulate(end)
        first = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(start)) - 1 if len(start) else first
        ids = batch.column(0).take(pa.array(start[first] >> 32))
        places = [pa.array(x.astype(np.int32)) for x in (start[first] & 0xFFFFFFFF, reach[last] & 0xFFFFFFFF)]
        yield pa.RecordBatch.from_arrays([ids, *places], ["doc_id", "start", "end"])
    release()


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with covered sentences cut out of ``text``; all rows and columns stay, ``n_chars`` follows the text if there is one.

    White space left around a cut becomes one line break; a text cut whole is empty.
    Null texts and ids stay as they are, an empty table stays empty, columns may have any names.
    """
    key, cuts = fresh(docs, "key", "cuts")
    spans = repeated_spans(docs, sentences, least_words).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    both = docs.join(spans, docs["doc_id"] == spans[key], "left").drop(key)
    schema = docs.schema
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            spans = batch.column(len(cols)).to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                texts = cols[at].to_pylist()
                for i in hit:
                    texts[i] = cut_out(texts[i], [(s["start"], s["end"]) for s in spans[i]])
                cols[at] = pa.array(texts, cols[at].type)
                if count is not None:
                    new = cols[count].to_pylist()
                    for i in hit:
                        new[i] = len(texts[i])
                    cols[count] = pa.array(new, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])
        release()

    return both.mapInArrow(work, schema)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    kept, at = [], 0
    for a, b in sorted(spans):
        kept.append(raw[at:a])
        at = max(at, b)
    kept.append(raw[at:])
    parts = [p.decode("utf-8", "ignore").strip() for p in kept]
    return "\n".join(p for p in parts if p)
