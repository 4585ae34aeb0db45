"""Benchmark passages in documents, with up to a share of edits.

An item of n characters may differ by ``errors`` = n * ``rate`` edits. Cut into
errors + 1 pieces, at least one piece stands unchanged in every such copy
(pigeonhole). One automaton finds all pieces of all items in a document in one
pass; each hit is verified by Myers' bit-parallel edit distance over the window
where the copy must lie.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.textbytes import release

#: Edits per character of an item.
RATE = 0.05
#: Shorter normalised items may not differ at all and must stand between word bounds.
EXACT_BELOW = 40
#: Characters of benchmark text that one pass over the documents carries.
PASS_CHARS = 8_000_000

HITS = "doc_id long, item_id long, start long, end long, distance int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    n = errors + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def best_match(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to any substring of ``text`` and that substring's first end, if within ``errors``."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere, so nothing is carried in
        mh = mh << 1 & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= errors and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """All items of one pass."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact_below: int = EXACT_BELOW):
        import ahocorasick

        self.exact_below = exact_below
        self.items = {i: (text, budget(text, rate) if len(text) >= exact_below else 0) for i, text in items}
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (text, errors) in self.items.items():
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((i, offset))
        self.auto = ahocorasick.Automaton()
        for piece, places in where.items():
            self.auto.add_word(piece, (len(piece), places))
        self.auto.make_automaton()

    def _within(self, i: int, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """``(distance, start, end)`` of copies in ``text[a:b]`` that do not overlap: the best one, then what is left on both sides."""
        item, errors = self.items[i]
        n, found, todo = len(item), [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < n - errors:
                continue
            exact = text.find(item, a, b)
            got = (0, exact + n - a) if exact >= 0 else best_match(item, text[a:b], errors) if errors else None
            if got:
                start, end = max(a, a + got[1] - n), a + got[1]
                found.append((got[0], start, end))
                todo += [(a, start), (end, b)]
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, distance)`` of all copies of each item that do not overlap; ends in the normalised text, start at the latest."""
        spots: dict[int, list[int]] = {}
        for end, (n, places) in self.auto.iter(text):
            for i, offset in places:
                spots.setdefault(i, []).append(end + 1 - n - offset)
        found = []
        for i, starts in spots.items():
            item, errors = self.items[i]
            n = len(item)
            if n < self.exact_below:
                bounds = [s for s in sorted(starts) if (not s or text[s - 1] == " ") and text[s + n : s + n + 1] in ("", " ")]
                copies = [(0, s, s + n) for s in bounds]
            else:
                copies, last = [], None
                windows: list[list[int]] = []
                for s in sorted(set(starts)):  # hits of nearly one diagonal share a window
                    if last is not None and s <= last + 2 * errors + 1:
                        windows[-1][1] = s
                    else:
                        windows.append([s, s])
                    last = s
                for a, b in windows:
                    copies += self._within(i, text, max(0, a - errors), min(len(text), b + n + errors))
            taken: list[tuple[int, int]] = []
            for distance, a, b in sorted(copies):
                k = bisect(taken, (a, b))
                if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    found.append((i, a, b, distance))
        return found


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``(doc_id, item_id, start, end, distance)``: every copy of an item in a document, copies of one item not overlapping.

    Texts are compared in lower case with runs of white space as one blank;
    start and end count characters of that form; whole texts of any length count.
    Of overlapping copies the nearest, then the first is given. Items under
    ``exact_below`` characters match exactly and between word bounds. Null or
    blank texts and null ids on either side take no part. Equal rows, of
    repeated documents or items, are given once; texts that share an id are each
    searched. Other columns are ignored, whatever their names; an empty table
    on either side gives no rows. Items go to the executors in passes of at most
    ``pass_chars`` characters, so what a task holds is bounded; more items mean
    more passes over the documents.
    """
    out = docs.sparkSession.createDataFrame([], HITS)
    for texts in _passes(benchmark, pass_chars):
        out = out.unionByName(_scan(docs, texts, rate, exact_below))
    return out.distinct()


def _passes(benchmark: DataFrame, pass_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in lists of about ``pass_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    passes = 1 + total // pass_chars
    for k in range(passes):
        own = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        texts = sorted({(r.item_id, normalise(r.text)) for r in own.toLocalIterator()})
        texts = [(i, t) for i, t in texts if t]
        if texts:
            yield texts


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float, exact_below: int) -> DataFrame:
    names = [c.split()[0] for c in HITS.split(", ")]
    # an item_id with several texts keeps them apart by place in the list
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        matcher = Matcher([(k, text) for k, (_, text) in enumerate(items)], rate, exact_below)
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0), batch.column(1)
            for at in range(len(batch)):
                text = texts[at].as_py()
                if text is None or not ids[at].is_valid:
                    continue
                rows += [(ids[at].as_py(), items[k][0], *rest) for k, *rest in matcher.find(normalise(text))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Rows of ``docs`` with no copy of an item, columns as they were; no shuffle. Null texts stay, null ids don't matter, each of equal rows is judged."""
    at = docs.columns.index("text")
    for items in _passes(benchmark, pass_chars):
        docs = _without(docs, at, docs.sparkSession.sparkContext.broadcast(items), rate, exact_below)
    return docs


def _without(docs: DataFrame, at: int, shared, rate: float, exact_below: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(k, text) for k, (_, text) in enumerate(shared.value)], rate, exact_below)
        for batch in batches:
            keep = [not matcher.find(normalise(t)) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
            release()

    return docs.mapInArrow(work, docs.schema)
