"""Factors of a large system by parts of its separator tree: no pattern is analysed in one place.

Rows are matched by joins and cut by ``dissection``. A task takes a part, orders its
supernodes, factors them and hands what is left, a dense matrix for each root, to the
separator above; separators are factored height by height, the highest few by one task.
The driver holds the parts and separators alone, not their rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.functions import complexnum as C
from lattica.functions.machine import TINY_SHARE
from lattica.operators import elementwise as E, products as P, solver as S
from lattica.operators.dissection import dissect
from lattica.operators.matching import heavy_perfect_matching, product_matching
from lattica.plans import kernels as K
from lattica.plans.local import Options
from lattica.plans.scratch import Scratch

#: Rows of a part about at most.
PART_ROWS = 1 << 16
#: Rows of the highest separators that one task factors together.
TOP_ROWS = 1 << 12


@dataclass
class PartedFactor(S.Factor):
    """A factor whose analysis stays in tables; places inside a part follow its own tree."""

    ends: DataFrame | None = None  # (i, m, rs, cs): row i goes to column m; scales of row i and of column i
    order: DataFrame | None = None  # (i, pos, task) of column i before parts are ordered
    owned: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # first position and rows of what each task eliminates

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._tables

    def nonzeros(self) -> tuple[int, int]:
        p, q = F.col("p").cast("long"), F.octet_length("index") / 8 - F.col("p")
        count = int(self.blocks.agg(F.sum((p * (p + 1) / 2 + p * q).cast("long"))).first()[0] or 0)
        return count, count

    def logdet(self) -> tuple[complex, float]:
        kind = np.dtype(self.dtype)
        diag = self.triangle(False).filter("i = j")
        size = C.size(F.col("v"), kind.kind == "c")
        turned = self.ends.filter("i != m")
        sign = 1 if turned.isEmpty() else E.permutation_sign(self.ends.select(F.col("i").alias("src"), F.col("m").alias("dst")), self.n)
        if kind.kind == "c":
            got = diag.agg(F.sum(F.log(size)).alias("t"), F.sum(F.atan2("v.im", "v.re")).alias("a")).first()
            unit = complex(np.cos(got.a), np.sin(got.a)) * sign
        else:
            got = diag.agg(F.sum(F.log(size)).alias("t"), F.sum((F.col("v") < 0).cast("int")).alias("a")).first()
            unit = float(sign * (-1) ** int(got.a))
        scales = self.ends.agg(F.sum(F.log("rs") + F.log("cs")).alias("s")).first().s
        return unit, got.t - scales

    def save(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        for name, table in zip(("places", "needs", "ends", "order"), (self._tables[0], self._tables[2], self.ends, self.order), strict=True):
            table.write.parquet(f"{path}/{name}")
        plain = {k: getattr(self, k) for k in ("n", "equed", "tasks", "dtype", "info", "tiny", "anorm")} | {"options": vars(self.options)}
        plain |= {"owned": [[t, r] for t, r in self.owned.items()], "steps": self.steps.tolist(), "task": self.task.tolist(), "rows": self._rows()}
        self.blocks.sparkSession.createDataFrame([(json.dumps(plain, default=float),)], "value string").write.text(f"{path}/plain")

    def _rows(self) -> list[int]:
        found = self.blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum((F.octet_length("index") / 8).cast("long")).alias("r")).first()
        return [int(x or 0) for x in found]


def load_parted(spark: SparkSession, path: str, plain: dict) -> PartedFactor:
    """A factor that ``PartedFactor.save`` wrote; raises where its blocks are not those that were written."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    kept = {k: plain[k] for k in ("n", "equed", "tasks", "dtype", "info", "tiny", "anorm")}
    owned = {int(t): [(int(a), int(b)) for a, b in r] for t, r in plain["owned"]}
    arrays = {k: np.array(plain[k], np.int64) for k in ("task", "steps")}
    blocks = spark.read.schema(S.BLOCKS).parquet(f"{path}/blocks")
    factor = PartedFactor(options=Options(**plain["options"]), analysis=None, rows=None, cols=None, blocks=blocks, ends=read("ends"), order=read("order"), owned=owned, **arrays, **kept)
    factor._tables = (read("places"), blocks.limit(0), read("needs"))
    if (found := factor._rows()) != plain["rows"]:
        raise ValueError(f"blocks, columns and rows {found} are not {plain['rows']}")
    return factor


def goes_by_parts(o: Options, entries: int, previous: S.Factor | None = None) -> bool:
    """Whether a matrix is too large for one place and ordered by what parts can do; a factor by parts is followed by such."""
    if o.fact != "dofact":
        return isinstance(previous, PartedFactor)
    return entries > o.part_entries and o.col_perm not in ("natural", "given") and (o.row_perm != "large_diag" or o.match_job == 5)


def _ends(a: DataFrame, n: int, o: Options, row_perm: DataFrame | None) -> tuple[DataFrame | None, str, int]:
    """``(i, m, rs, cs)`` of equilibration and matching, the kind of the scaling, and info."""
    ids = a.sparkSession.range(n).withColumnRenamed("id", "i")
    rows = cols = None
    equed, work = "N", a
    if o.equilibrate:
        e = P.equilibrate(a, n, n)
        if e.info:
            return None, "N", e.info
        equed = P.equilibration_kind(e.rowcnd, e.colcnd, e.amax)
        rows, cols = e.rows if equed in "RB" else None, e.cols if equed in "CB" else None
        work = E.scale(a, rows, cols) if equed != "N" else a
    one = F.lit(1.0)
    if o.row_perm == "none":
        to = ids.select("i", F.col("i").alias("m"), one.alias("rs"), one.alias("cs"))
    elif o.row_perm == "large_diag":
        found = product_matching(work, n)
        if not found.filter("info > 0").isEmpty():
            return None, equed, n + 1
        by = [F.exp(c) if o.equilibrate else one for c in ("u", "v")]
        to = found.select(F.col("src").alias("i"), F.col("dst").alias("m"), by[0].alias("rs"), by[1].alias("cs"))
        equed = "B" if o.equilibrate else equed
    else:
        if o.row_perm == "heavy_weight":
            found = heavy_perfect_matching(a, n)
            if found.missing:
                return None, equed, n + 1
            row_perm = found.pairs
        to = row_perm.select(F.col("src").alias("i"), F.col("dst").alias("m"), one.alias("rs"), one.alias("cs"))
    for c, scales in (("rs", rows), ("cs", cols)):
        if scales is not None:
            to = to.join(scales.hint("merge"), "i").withColumn(c, F.col(c) * F.col("s")).drop("s")
    return to, equed, 0


def _divided(found, n: int, part_rows: int, top_rows: int) -> tuple[DataFrame, dict[int, list[tuple[int, int]]], np.ndarray]:
    """``(i, pos, task)`` of a dissection, what each task owns, and the step of each task but the last."""
    spark = found.order.sparkSession
    low = max(0, found.depth - max(0, int(np.ceil(np.log2(n / part_rows)))))
    at = [F.greatest("height", F.lit(low)).alias("kh"), F.expr(f"shiftright(node, int(greatest({low} - height, 0)))").alias("kn")]
    nodes = found.tree.select(*at, "size", "first").groupBy("kh", "kn").agg(F.sum("size").alias("size"), F.min("first").alias("first"))
    nodes = sorted(nodes.collect(), key=lambda r: (r.kh, r.kn))  # parts and separators above them, not their rows
    top, left = max((r.kh for r in nodes), default=low) + 1, top_rows
    while top > low + 1 and (rows := sum(r.size for r in nodes if r.kh == top - 1)) <= left:
        top, left = top - 1, left - rows
    if len(nodes) == 1:
        top = low
    heights = {h: k for k, h in enumerate(sorted({r.kh for r in nodes if r.kh < top}))}
    owned: dict[int, list[tuple[int, int]]] = {}
    steps, rows = [], []
    for r in nodes:
        task = -1 if r.kh >= top else len(steps)
        if task >= 0:
            steps.append(heights[r.kh])
        owned.setdefault(task, []).append((int(r.first), int(r.size)))
        rows.append((int(r.kh), int(r.kn), task))
    tasks = spark.createDataFrame(rows, "kh int, kn long, task int")
    order = found.order.select("i", "pos", *at).join(tasks, ["kh", "kn"]).select("i", "pos", "task")
    return order, {t: sorted(r) for t, r in owned.items()}, np.array(steps, np.int64)


def _part_task(owned: dict[int, list[tuple[int, int]]], steps: np.ndarray, kind: np.dtype, relax: int, maxsup: int, threshold: float) -> Callable:
    """Factors of what a task owns, from entries and from what lower tasks left; rows of kind place and need tell of its order and of later places it meets."""
    ranges = sorted((first, task) for task, own in owned.items() for first, _ in own)
    starts, tasks = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64)

    def work(key: tuple, cells: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        t = int(key[0])
        own = np.concatenate([np.arange(first, first + size) for first, size in owned[t]])
        v = (cells["re"].to_numpy() + 1j * cells["im"].to_numpy() if kind.kind == "c" else cells["re"].to_numpy()).astype(kind)
        left = [(np.frombuffer(x, np.int64), m) for x, m in zip(given["at"], given["m"], strict=True)]
        i, j = cells["i"].to_numpy(np.int64), cells["j"].to_numpy(np.int64)
        beyond = np.setdiff1d(np.concatenate([i, j, *(x for x, _ in left)]), own)
        ids, n = np.concatenate([own, beyond]), len(own)
        i, j = np.searchsorted(ids, i), np.searchsorted(ids, j)
        left = [(np.searchsorted(ids, x), np.frombuffer(m, kind).reshape(len(x), len(x))) for x, m in left]
        # what is left is a clique, but its first column hands on all others
        u = np.concatenate([i, *(np.repeat(x[:1], len(x)) for x, _ in left)])
        w = np.concatenate([j, *(x for x, _ in left)])
        cols = K.symmetric_columns(len(ids), u, w)[:n]
        tree = K.symmetric_tree(cols)
        to = np.arange(len(ids))
        if t >= 0 and steps[t] == 0:  # places of separators are known to the tasks below
            to[:n] = post = K.postorder(tree)
            tree, cols = K.relabel_tree(tree, post), K.symmetric_columns(len(ids), to[u], to[w])[:n]
            i, j = to[i], to[j]
            f = K.fronts(cols, tree, relax, maxsup)
        else:
            f = K.fronts(cols, tree, 1, maxsup)
        del cols, u, w
        owner = np.repeat(np.arange(len(f.first)), f.last - f.first + 1)
        blocks, rest, tiny, info = K.eliminate(np.arange(len(f.first)), f, owner, i, j, v, threshold, left)
        out = [(t, int(ids[f.first[b.s]]), b.p, "block", ids[b.index].tobytes(), b.lu.tobytes(), np.ascontiguousarray(b.low).tobytes(), np.ascontiguousarray(b.right).tobytes(), 0, 0) for b in blocks]
        for at, m in rest:
            there = int(tasks[np.searchsorted(starts, ids[at[0]], "right") - 1])
            out.append((t, there, 0, "update", ids[at].tobytes(), np.ascontiguousarray(m).tobytes(), b"", b"", 0, 0))
        out.append((t, 0, 0, "place", own.tobytes(), own[to[:n]].tobytes(), b"", b"", 0, 0))
        out.append((t, 0, 0, "need", beyond.tobytes(), b"", b"", b"", 0, 0))
        out.append((t, 0, 0, "count", b"", b"", b"", b"", tiny, int(ids[info - 1]) + 1 if info else 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in S.BLOCKS.split(", ")])

    return work


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at, to in zip(frame["at"], frame["m"], strict=True):
            yield pd.DataFrame({"pos": np.frombuffer(at, np.int64), "place": np.frombuffer(to, np.int64)})


def _wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for task, at in zip(frame["task"], frame["at"], strict=True):
            yield pd.DataFrame({"want": int(task), "i": np.frombuffer(at, np.int64)})


def factorize_parts(
    a: DataFrame, n: int, options: Options | None = None, previous: PartedFactor | None = None, row_perm: DataFrame | None = None, part_rows: int = PART_ROWS, top_rows: int = TOP_ROWS
) -> PartedFactor:
    """``solver.factorize`` by parts; the order of columns is that of the separator tree.

    same_pattern keeps that order as long as rows are matched with the same columns; else the new pattern is cut anew.
    """
    o = options or Options()
    spark, scratch = a.sparkSession, Scratch(a.sparkSession)
    wide = C.is_complex(a, "v")
    kind = np.dtype({(False, False): "float64", (False, True): "float32", (True, False): "complex128", (True, True): "complex64"}[wide, o.precision == "single"])
    empty = spark.createDataFrame([], S.BLOCKS)
    same = o.fact == "same_pattern_same_row_perm"
    if same:
        ends, equed, info = previous.ends, previous.equed, previous.info if previous.ends is None else 0
    else:
        ends, equed, info = _ends(a, n, o, row_perm)
        ends = ends if info else scratch.keep(ends, "ends")
    none = np.zeros(0, np.int64)
    factor = PartedFactor(n, o, None, None, None, equed, none, 0, empty, kind.name, info, 0, 0.0, [], none, ends=ends)
    if info:
        return factor
    keeps = same or o.fact == "same_pattern" and ends.join(previous.ends.select("i", F.col("m").alias("was")), "i").filter("m != was").isEmpty()
    if keeps:
        order, owned, steps = previous.order, previous.owned, previous.steps
    else:
        moved = a.select("i", "j").join(ends.select("i", "m").hint("merge"), "i").select(F.col("m").alias("i"), "j", F.lit(1.0).alias("v"))
        order, owned, steps = _divided(dissect(scratch.keep(moved, "moved"), n, min(256, part_rows)), n, part_rows, top_rows)
        order = scratch.keep(order, "order")
    factor.order, factor.owned, factor.steps, factor.tasks = order, owned, steps, len(owned)
    factor.task = np.array(sorted(owned), np.int64)

    cols = ends.select("i", "cs").join(order.hint("merge"), "i").select("i", F.col("pos").alias("c"), "cs", F.col("task").alias("ct"))
    rows = ends.select("i", "m", "rs").join(order.select(F.col("i").alias("m"), F.col("pos").alias("r"), F.col("task").alias("rt")).hint("merge"), "m").drop("m")
    at = scratch.keep(rows.join(cols.hint("merge"), "i"), "at")
    values = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if wide else [F.col("v").alias("re"), F.lit(0.0).alias("im")]
    placed = a.select("i", "j", *values).join(at.select("i", "r", "rs", "rt").hint("merge"), "i").join(at.select(F.col("i").alias("j"), "c", "cs", "ct").hint("merge"), "j")
    by = F.col("rs") * F.col("cs")
    task = F.when(F.col("r") <= F.col("c"), F.col("rt")).otherwise(F.col("ct"))
    placed = scratch.keep(placed.select(task.alias("task"), F.col("r").alias("i"), F.col("c").alias("j"), (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im")), "placed")
    sums = placed.groupBy("i" if o.trans else "j").agg(F.sum(F.hypot("re", "im") if wide else F.abs("re")).alias("t"))
    factor.anorm = float(sums.agg(F.max("t")).first()[0] or 0.0)

    work = _part_task(owned, steps, kind, o.relax, o.maxsup, TINY_SHARE * factor.anorm if o.replace_tiny_pivot else 0.0)
    sent = empty.select(F.col("s").cast("int").alias("to"), F.col("index").alias("at"), F.col("lu").alias("m"))
    done = empty
    for k, tasks in enumerate(factor.ranges()):
        due = sent.filter(S._within(tasks, "to")).groupBy("to")
        got = scratch.keep(placed.filter(S._within(tasks)).groupBy("task").cogroup(due).applyInPandas(work, S.BLOCKS), f"factor{k}")
        done = got if k == 0 else done.unionByName(got)
        sent = sent.unionByName(got.filter("kind = 'update'").select(F.col("s").cast("int").alias("to"), F.col("index").alias("at"), F.col("lu").alias("m")))
    told = done.filter("kind in ('place', 'need', 'count')").select("task", "kind", F.col("index").alias("at"), F.col("lu").alias("m"), "tiny", "info")
    told = scratch.keep(told, "told")
    counted = told.agg(F.sum("tiny").alias("tiny"), F.min(F.when(F.col("info") > 0, F.col("info"))).alias("info"), F.sum(F.when(F.col("kind") == "place", F.octet_length("at") / 8)).alias("n")).first()
    factor.blocks = done.filter("kind = 'block'")
    # a task that nothing reaches has zero pivots only
    factor.tiny, factor.info = int(counted.tiny or 0), int(counted.info or 0) or (n + 1 if int(counted.n or 0) < n else 0)
    final = scratch.keep(told.filter("kind = 'place'").select("at", "m").mapInPandas(_pairs, "pos long, place long"), "final")
    places = at.join(final.select(F.col("pos").alias("r"), F.col("place").alias("fr")).hint("merge"), "r").join(final.select(F.col("pos").alias("c"), F.col("place").alias("fc")).hint("merge"), "c")
    places = scratch.keep(places.select("i", F.col("fr").alias("r"), "rs", F.col("rt").cast("long").alias("rt"), F.col("fc").alias("c"), "cs", F.col("ct").cast("long").alias("ct")), "places")
    needs = scratch.keep(told.filter("kind = 'need'").select("task", "at").mapInPandas(_wanted, "want long, i long"), "needs")
    factor._tables = (places, empty, needs)
    return factor
