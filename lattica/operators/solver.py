"""Direct solution of A X = B: analysis once, factorization by subtrees, solves, refinement.

Entries of the matrix stay a DataFrame. Its pattern (and for the matching its
sizes) is analysed in one place, which ``Options.analysis_entries`` bounds; what
comes of it is written as tables, of which a task reads its own part only. The
elimination tree is divided: each task factors whole subtrees and sends what is
left of them to the top, which one task factors, or several steps of tasks where
it has more than ``STEP_ROWS`` rows. Solves follow the same steps up and down.
Factors are a written table and can be solved with again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.functions import complexnum as C
from lattica.functions.machine import EPS, TINY_SHARE
from lattica.operators import products as P
from lattica.operators.distributed import BlockSystem, factorize_system
from lattica.operators.elementwise import scale
from lattica.operators.graph import contracted_components
from lattica.operators.matching import heavy_perfect_matching
from lattica.plans import kernels as K
from lattica.plans import local
from lattica.plans.local import Options
from lattica.plans.scratch import Scratch
from lattica.sources.tables import MATRIX, VECTOR

#: Rows of a task about at most.
STEP_ROWS = 1 << 17

BLOCKS = "task int, s long, p int, kind string, index binary, lu binary, low binary, right binary, tiny int, info long"


@dataclass
class Factor:
    """What later calls can use again."""

    n: int
    options: Options
    analysis: local.Analysis
    rows: np.ndarray  # scale factors that were applied
    cols: np.ndarray
    equed: str
    task: np.ndarray
    tasks: int
    blocks: DataFrame
    dtype: str
    info: int
    tiny: int
    anorm: float
    stats: list[tuple[str, float]] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each task; -1 comes last
    _tables: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What tasks need of the analysis, written once.

        ``(i, r, rs, rt, c, cs, ct)``: place, scale and task of row i and of column i; ``(own, s, first, last, parent, below)``: supernodes
        by task; ``(want, i)``: the tasks that need the solution at a place of a later task.
        """
        if self._tables is None:
            a, f = self.analysis, self.analysis.fronts
            spark, scratch = self.blocks.sparkSession, Scratch(self.blocks.sparkSession)
            of = self.task[a.owner]
            sizes = np.array([len(b) for b in f.below], np.int64)
            below = np.concatenate([*f.below, np.zeros(0, np.int64)])
            by, there = np.repeat(self.task, sizes), of[below]
            needs = np.divmod(np.unique(by[by != there] * self.n + below[by != there]), max(1, self.n))
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [
                {"i": np.arange(self.n), "r": a.row_to, "rs": self.rows, "rt": of[a.row_to], "c": a.col_to, "cs": self.cols, "ct": of[a.col_to]},
                {"own": self.task, "s": np.arange(len(f.first)), "first": f.first, "last": f.last, "parent": f.parent, "below": pa.ListArray.from_arrays(starts, pa.array(below))},
                {"want": needs[0], "i": needs[1]},
            ]
            self._tables = tuple(scratch.keep(spark.createDataFrame(pa.table(c)), name) for c, name in zip(columns, ("places", "fronts", "needs"), strict=True))
        return self._tables

    def ranges(self) -> list[tuple[int, int]]:
        """Tasks of each step, from the first to before the last; the top, task -1, is a step of its own."""
        cuts = np.searchsorted(self.steps, np.arange(int(self.steps.max(initial=-1)) + 2)).tolist()
        return [*zip(cuts[:-1], cuts[1:], strict=True)] + ([(-1, 0)] if (self.task < 0).any() else [])

    def stat_table(self) -> DataFrame:
        """``(phase, seconds)`` in order of the phases."""
        return self.blocks.sparkSession.createDataFrame([(n, float(s)) for n, s in self.stats], "phase string, seconds double")

    def nonzeros(self) -> tuple[int, int]:
        """Stored entries of L (with its diagonal) and of U, explicit zeros of supernodes included."""
        f = self.analysis.fronts
        p = f.last - f.first + 1
        below = np.array([len(b) for b in f.below], np.int64)
        return int((p * (p + 1) // 2 + p * below).sum()), int((p * (p + 1) // 2 + p * below).sum())

    def triangle(self, lower: bool) -> DataFrame:
        """Entries of L (unit diagonal stored) or U in the permuted order."""
        kind = np.dtype(self.dtype)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    b = _block(row, kind)
                    own = b.index[: b.p]
                    if lower:
                        tri = np.vstack([np.tril(b.lu, -1) + np.eye(b.p), b.low])
                        i, j = np.repeat(b.index, b.p), np.tile(own, len(b.index))
                    else:
                        tri = np.hstack([np.triu(b.lu), b.right])
                        i, j = np.repeat(own, len(b.index)), np.tile(b.index, b.p)
                    flat = tri.ravel()
                    on = flat != 0
                    yield pd.DataFrame({"i": i[on], "j": j[on], "re": np.real(flat[on]).astype(float), "im": np.imag(flat[on]).astype(float)})

        cells = self.blocks.mapInPandas(work, "i long, j long, re double, im double")
        return cells.select("i", "j", (C.make(F.col("re"), F.col("im")) if kind.kind == "c" else F.col("re")).alias("v"))

    def extremes(self) -> tuple[float, float]:
        """Greatest entries of L and U; a complex one counts as |re| + |im|."""
        size = C.size1(F.col("v"), np.dtype(self.dtype).kind == "c")
        low, up = (self.triangle(lower).agg(F.max(size)).first()[0] or 0.0 for lower in (True, False))
        return low, up

    def memory(self) -> DataFrame:
        """``(task, blocks, value_bytes, index_bytes)``: what the factors take in each task."""
        values = F.octet_length("lu") + F.octet_length("low") + F.octet_length("right")
        sums = [F.count(F.lit(1)).alias("blocks"), F.sum(values.cast("long")).alias("value_bytes"), F.sum(F.octet_length("index").cast("long")).alias("index_bytes")]
        return self.blocks.groupBy("task").agg(*sums)

    def diagonal_inverses(self, lower: bool) -> DataFrame:
        """``(s, i, j, v)``: the inverse of each supernode's own block of L (unit diagonal) or U, in the permuted order.

        A block with a zero pivot has no inverse and raises.
        """
        kind = np.dtype(self.dtype)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    b = _block(row, kind)
                    own = b.index[: b.p]
                    flat = np.linalg.inv(np.tril(b.lu, -1) + np.eye(b.p) if lower else np.triu(b.lu)).ravel()
                    on = flat != 0
                    i, j = np.repeat(own, b.p)[on], np.tile(own, b.p)[on]
                    yield pd.DataFrame({"s": b.s, "i": i, "j": j, "re": np.real(flat[on]).astype(float), "im": np.imag(flat[on]).astype(float)})

        cells = self.blocks.mapInPandas(work, "s long, i long, j long, re double, im double")
        return cells.select("s", "i", "j", (C.make(F.col("re"), F.col("im")) if kind.kind == "c" else F.col("re")).alias("v"))

    def diagonal(self) -> DataFrame:
        """``(i, v)`` of U's diagonal, in the permuted order."""
        return self.triangle(False).filter("i = j").select("i", "v")

    def logdet(self) -> tuple[complex, float]:
        """Sign and logarithm of the absolute determinant."""
        kind = np.dtype(self.dtype)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                d = np.concatenate([np.diag(_block(row, kind).lu) for row in frame.itertuples()] or [np.ones(0, kind)])
                unit = np.prod(d / np.abs(d)) if len(d) else 1.0
                yield pd.DataFrame({"t": [float(np.log(np.abs(d)).sum())], "re": [float(np.real(unit))], "im": [float(np.imag(unit))]})

        sign, total = complex(K.permutation_sign(self.analysis.row_match)), 0.0
        for r in self.blocks.mapInPandas(work, "t double, re double, im double").toLocalIterator():
            sign, total = sign * complex(r.re, r.im), total + r.t
        return (sign.real if kind.kind == "f" else sign), total - float(np.log(self.rows).sum() + np.log(self.cols).sum())

    def solve(self, b: DataFrame, trans: bool = False) -> DataFrame:
        """X of A X = B (or A' X = B) by the factors alone."""
        return _solve(self, b, trans)

    def zeroed(self) -> Factor:
        """The same blocks with zero values, ready to be filled again."""
        blank = [F.unhex(F.repeat(F.lit("00"), F.octet_length(c))).alias(c) if c in ("lu", "low", "right") else F.col(c) for c in self.blocks.columns]
        return replace(self, blocks=self.blocks.select(*blank))

    def save(self, path: str) -> None:
        """Blocks, permutations, scale factors and tree in a folder that ``load_factor`` reads."""
        self.blocks.write.parquet(f"{path}/blocks")
        a, f = self.analysis, self.analysis.fronts
        arrays = {k: getattr(a, k) for k in ANALYSIS_ARRAYS} | {"first": f.first, "last": f.last, "front_parent": f.parent, "rows": self.rows, "cols": self.cols, "task": self.task, "steps": self.steps}
        arrays |= {"below": np.concatenate([*f.below, np.zeros(0, np.int64)]), "below_sizes": np.array([len(b) for b in f.below], np.int64)}
        rows = [(k, str(np.asarray(v).dtype), np.ascontiguousarray(v).tobytes()) for k, v in arrays.items()]
        self.blocks.sparkSession.createDataFrame(rows, "name string, kind string, raw binary").write.parquet(f"{path}/arrays")
        plain = {k: getattr(self, k) for k in ("n", "equed", "tasks", "dtype", "info", "tiny", "anorm")} | {"analysis_info": a.info, "options": vars(self.options)}
        self.blocks.sparkSession.createDataFrame([(json.dumps(plain, default=float),)], "value string").write.text(f"{path}/plain")


ANALYSIS_ARRAYS = ("row_to", "col_to", "col_perm", "row_match", "log_row", "log_col", "tree", "owner")


def load_factor(spark: SparkSession, path: str) -> Factor:
    """A factor that ``Factor.save`` wrote; raises where its blocks and its analysis do not belong together."""
    plain = json.loads(spark.read.text(f"{path}/plain").first()["value"])
    if "owned" in plain:
        return parted.load_parted(spark, path, plain)
    arrays = {r.name: np.frombuffer(r.raw, np.dtype(r.kind)) for r in spark.read.parquet(f"{path}/arrays").collect()}
    below = np.split(arrays["below"], np.cumsum(arrays["below_sizes"])[:-1]) if len(arrays["below_sizes"]) else []
    fronts = K.Fronts(arrays["first"], arrays["last"], below, arrays["front_parent"])
    analysis = local.Analysis(**{k: arrays[k] for k in ANALYSIS_ARRAYS}, fronts=fronts, info=plain["analysis_info"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.octet_length("index") / 8
    found = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum(size.cast("long")).alias("rows")).first()
    want = (len(fronts.first), plain["n"], plain["n"] + int(arrays["below_sizes"].sum()))
    if (found.n, found.p or 0, found.rows or 0) != want:
        raise ValueError(f"blocks, columns and rows {(found.n, found.p, found.rows)} are not {want}")
    kept = {k: plain[k] for k in ("n", "equed", "tasks", "dtype", "info", "tiny", "anorm")}
    return Factor(options=Options(**plain["options"]), analysis=analysis, rows=arrays["rows"], cols=arrays["cols"], task=arrays["task"], steps=arrays["steps"], blocks=blocks, **kept)


def _block(row, kind: np.dtype) -> K.Block:
    index = np.frombuffer(row.index if isinstance(row.index, bytes) else getattr(row, "index_", row[5]), np.int64)
    p = int(row.p)
    q = len(index) - p
    raw = lambda x, shape: np.frombuffer(x, kind).reshape(shape)
    return K.Block(int(row.s), p, index, raw(row.lu, (p, p)), raw(row.low, (q, p)), raw(row.right, (p, q)))


def _arrays(matrix: DataFrame, *names: str, ints: tuple[str, ...] = ()) -> list[np.ndarray]:
    """Columns on the driver; places travel in half the bytes where they fit (``ints``)."""
    table: pa.Table = matrix.select(*[F.col(c).cast("int") if c in ints else F.col(c) for c in names]).toArrow()
    return [c.to_numpy().astype(np.int64) if name in ints else c.to_numpy() for name, c in zip(names, table.columns, strict=True)]


def _within(tasks: tuple[int, int], column: str = "task") -> str:
    return f"{column} >= {tasks[0]} and {column} < {tasks[1]}"


def factorize(a: DataFrame, n: int, options: Options | None = None, previous: Factor | None = None, row_perm: DataFrame | None = None, col_perm: DataFrame | None = None) -> Factor:
    """Factors of the n by n matrix ``a``; ``previous`` lends what ``options.fact`` says.

    same_pattern keeps the column order; same_pattern_same_row_perm keeps order,
    matching, scalings and the pattern of the factors; factored keeps all.
    ``info`` tells of zero rows (i + 1), zero columns (n + j + 1), structural
    singularity (n + 1 without scaling) and zero pivots (their place + 1).
    """
    o = options or Options()
    if o.fact != "dofact" and previous is None:
        raise ValueError(f"fact={o.fact} needs a previous factor")
    if o.fact == "factored":
        return previous
    if o.col_perm == "parallel_dissection":  # of a matrix that is analysed in one place
        o = o.but(col_perm="nested_dissection")
    spark, scratch = a.sparkSession, Scratch(a.sparkSession)
    stats: list[tuple[str, float]] = []
    clock = [time.time()]

    def phase(name: str) -> None:
        stats.append((name, time.time() - clock[0]))
        clock[0] = time.time()

    complex_values = C.is_complex(a, "v")
    size = F.hypot("v.re", "v.im") if complex_values else F.abs("v")
    same_rows = o.fact == "same_pattern_same_row_perm"
    entries = a.count()
    if parted.goes_by_parts(o, entries, previous):
        return parted.factorize_parts(a, n, o, previous, row_perm)
    if entries > o.analysis_entries:
        raise ValueError(f"{entries} entries are more than Options.analysis_entries; solve() goes by blocks then, factorize_system() keeps the factors")
    rows = cols = np.ones(n)
    equed, info = "N", 0
    if not same_rows:
        i, j, v = _arrays(a.withColumn("t", size), "i", "j", "t", ints=("i", "j") if n <= 1 << 31 else ())
    if same_rows:
        rows, cols, equed = previous.rows, previous.cols, previous.equed
    elif o.equilibrate:
        rows, cols, equed, info = local.factors_of(n, i, j, v)
    phase("EQUIL")
    if same_rows:
        an = previous.analysis
    else:
        if o.row_perm == "heavy_weight" and not info:
            found = heavy_perfect_matching(a, n)
            info = n + 1 if found.missing else 0
            row_perm = None if info else found.pairs
        to = _arrays(row_perm.orderBy("src"), "dst")[0] if row_perm is not None and o.row_perm in ("given", "heavy_weight") else None
        given = _arrays(col_perm.orderBy("src"), "dst")[0] if o.col_perm == "given" else None
        if o.fact == "same_pattern":
            given = previous.analysis.col_perm
        if info:
            to = np.arange(n)  # nothing to match; the factorization is not run
        an = local.analyse(n, i, j, v * rows[i] * cols[j], o, to, given)
        info = info or (n + 1 if an.info else 0)
        if o.equilibrate and not an.info and o.row_perm == "large_diag" and o.match_job == 5 and to is None:
            rows, cols, equed = rows * np.exp(an.log_row), cols * np.exp(an.log_col), "B"
    phase("ANALYSIS")

    parts = 1 if n <= o.task_rows else max(spark.sparkContext.defaultParallelism, -(-n // STEP_ROWS))
    task, steps = K.subtree_steps(an.fronts, parts, STEP_ROWS) if parts > 1 else (np.full(len(an.fronts.first), -1, np.int64), np.zeros(0, np.int64))
    kind = np.dtype(np.complex64 if o.precision == "single" else np.complex128) if complex_values else np.dtype(np.float32 if o.precision == "single" else np.float64)
    factor = Factor(n, o, an, rows, cols, equed, task, parts, spark.createDataFrame([], BLOCKS), kind.name, info, 0, 0.0, stats, steps)
    if same_rows and n and not info:
        at = factor.tables()[0]
        scaled = a.select("i", "j", size.alias("t")).join(at.select("i", "rs"), "i").join(at.select(F.col("i").alias("j"), "cs"), "j")
        sums = scaled.groupBy("i" if o.trans else "j").agg(F.sum(F.col("t") * F.col("rs") * F.col("cs")).alias("t"))
        factor.anorm = float(sums.agg(F.max("t")).first()[0] or 0.0)
    elif n and not same_rows:
        factor.anorm = float(np.bincount(i if o.trans else j, v * rows[i] * cols[j], n).max(initial=0))
        del i, j, v
    if info or not n:
        return factor
    places, fronts, _ = factor.tables()
    threshold = TINY_SHARE * factor.anorm if o.replace_tiny_pivot else 0.0

    values = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if complex_values else [F.col("v").alias("re"), F.lit(0.0).alias("im")]
    by = F.col("rs") * F.col("cs")
    placed = a.select("i", "j", *values).join(places.select("i", "r", "rs", "rt"), "i").join(places.select(F.col("i").alias("j"), "c", "cs", "ct"), "j")
    placed = placed.select(F.when(F.col("r") <= F.col("c"), F.col("rt")).otherwise(F.col("ct")).alias("task"), F.col("r").alias("i"), F.col("c").alias("j"), (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im"))

    def factor_task(cells: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("s")
        t, s = int(own["own"].iloc[0]), own["s"].to_numpy()
        v = (cells["re"].to_numpy() + 1j * cells["im"].to_numpy() if kind.kind == "c" else cells["re"].to_numpy()).astype(kind)
        ids, f, owner = _local_fronts(own)
        i, j = (np.searchsorted(ids, cells[c].to_numpy(np.int64)) for c in ("i", "j"))
        blocks, left, tiny, info = K.eliminate(np.arange(len(s)), f, owner, i, j, v, threshold)
        info = int(ids[info - 1]) + 1 if info else 0
        out = [(t, s[b.s], b.p, "block", ids[b.index].tobytes(), b.lu.tobytes(), np.ascontiguousarray(b.low).tobytes(), np.ascontiguousarray(b.right).tobytes(), 0, 0) for b in blocks]
        out += [(t, -1, 0, "update", ids[at].tobytes(), np.ascontiguousarray(m).tobytes(), b"", b"", 0, 0) for at, m in left]
        out.append((t, -1, 0, "count", b"", b"", b"", b"", tiny, info))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                index = np.frombuffer(row[5], np.int64)
                m = np.frombuffer(row.lu, kind)
                yield pd.DataFrame({"task": -1, "i": np.repeat(index, len(index)), "j": np.tile(index, len(index)), "re": np.real(m).astype(float), "im": np.imag(m).astype(float)})

    ranges = factor.ranges()
    of = places.select(F.col("r").alias("at"), F.col("rt").alias("task"))
    if len(ranges) > 1:
        placed = scratch.keep(placed, "placed")
    done, sent = None, None
    for k, tasks in enumerate(ranges):
        due = placed.filter(_within(tasks))
        if sent is not None:
            due = due.unionByName(sent.filter(_within(tasks))).groupBy("task", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        got = due.groupBy("task").cogroup(fronts.filter(_within(tasks, "own")).groupBy("own")).applyInPandas(factor_task, BLOCKS)
        got = scratch.keep(got, f"factor{k}")
        done = got if done is None else done.unionByName(got)
        if k + 1 < len(ranges):
            on = got.filter("kind = 'update'").mapInPandas(spread, "task long, i long, j long, re double, im double")
            if ranges[1:] != [(-1, 0)]:  # not all goes to the top
                on = scratch.keep(on.drop("task").join(of, F.least("i", "j") == F.col("at")).select("task", "i", "j", "re", "im"), f"sent{k}")
            sent = on if sent is None else sent.unionByName(on)
    counted = done.filter("kind = 'count'").agg(F.sum("tiny").alias("tiny"), F.min(F.when(F.col("info") > 0, F.col("info"))).alias("info")).first()
    factor.blocks = done.filter("kind = 'block'")
    factor.tiny, factor.info = int(counted["tiny"] or 0), int(counted["info"] or 0)
    phase("FACT")
    return factor


def _solve(f: Factor, b: DataFrame, trans: bool) -> DataFrame:
    """Forward through subtrees and top, then back; vectors are keyed by task."""
    spark = b.sparkSession
    kind = np.dtype(f.dtype)
    wide = kind.kind == "c"
    schema = "i long, k int, x struct<re:double,im:double>" if wide else VECTOR
    if f.info:
        return b.select("i", "k", F.lit(None).cast("double").alias("x")) if not wide else b.select("i", "k", F.lit(None).cast("struct<re:double,im:double>").alias("x"))
    if not f.n:
        return spark.createDataFrame([], schema)
    if C.is_complex(b, "x") and not wide:  # real factors take the two parts as sides of their own
        sides = [b.select("i", (2 * F.col("k") + c).cast("int").alias("k"), F.col(f"x.{part}").alias("x")) for c, part in enumerate(("re", "im"))]
        got = _solve(f, sides[0].unionByName(sides[1]), trans).withColumn("c", F.col("k") % 2)
        both = [F.sum(F.when(F.col("c") == c, F.col("x"))).alias(part) for c, part in enumerate(("re", "im"))]
        return got.groupBy("i", F.shiftright("k", 1).alias("k")).agg(*both).select("i", "k", F.struct("re", "im").alias("x"))
    places, _, needs = f.tables()
    flat = "task long, i long, k int, re double, im double"
    complex_b = C.is_complex(b, "x")
    parted = b.select("i", "k", *([F.col("x.re").alias("re"), F.col("x.im").alias("im")] if complex_b else [F.col("x").alias("re"), F.lit(0.0).alias("im")]))
    (to, scale_to, own_to), (back, scale_back) = (("c", "cs", "ct"), ("r", "rs")) if trans else (("r", "rs", "rt"), ("c", "cs"))
    scaled = lambda s: [(F.col(c) * F.col(s)).alias(c) for c in ("re", "im")]

    def dense(frame: pd.DataFrame, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ks = np.unique(frame["k"])
        x = np.zeros((len(index), len(ks)), kind)
        v = frame["re"].to_numpy() + 1j * frame["im"].to_numpy() if wide else frame["re"].to_numpy()
        np.add.at(x, (np.searchsorted(index, frame["i"]), np.searchsorted(ks, frame["k"])), v.astype(kind))
        return x, ks

    def rows_of(t: int, index: np.ndarray, ks: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"task": t, "i": np.repeat(index, len(ks)), "k": np.tile(ks, len(index)).astype(np.int32), "re": np.real(x).ravel().astype(float), "im": np.imag(x).ravel().astype(float)})

    def run(step: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def work(block_rows: pd.DataFrame, vector: pd.DataFrame) -> pd.DataFrame:
            if not len(block_rows) or not len(vector):
                return rows_of(-1, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 0)))
            t = int(block_rows["task"].iloc[0])
            blocks = sorted((_block(r, kind) for r in block_rows.itertuples()), key=lambda b: b.s)
            index = np.unique(np.concatenate([b.index for b in blocks]))
            mine = np.unique(np.concatenate([b.index[: b.p] for b in blocks]))
            x, ks = dense(vector, index)
            for b in blocks:
                b.index = np.searchsorted(index, b.index)
            if step == "both":
                (K.backward_transposed if trans else _both)(blocks, x)
            elif step == "down":
                (_forward_transposed if trans else K.forward)(blocks, x)
            else:
                (_backward_transposed if trans else K.backward)(blocks, x)
            if step == "down":  # own rows go on to the way back, the rest is the top's
                here = np.isin(index, mine)
                return pd.concat([rows_of(t, index[here], ks, x[here]), rows_of(-1, index[~here], ks, x[~here])])
            return rows_of(t, mine, ks, x[np.searchsorted(index, mine)])

        return work

    def cogrouped(blocks: DataFrame, vector: DataFrame, step: str) -> DataFrame:
        blocks = blocks.select(F.col("task").cast("long").alias("own"), *blocks.columns)
        return blocks.groupBy("own").cogroup(vector.groupBy("task")).applyInPandas(run(step), flat)

    entered = parted.join(places.select("i", to, scale_to, own_to), "i").select(F.col(own_to).alias("task"), F.col(to).alias("i"), "k", *scaled(scale_to))
    ranges = f.ranges()
    if len(ranges) == 1:
        out = cogrouped(f.blocks, entered, "both")
    else:
        scratch = Scratch(spark)
        entered = scratch.keep(entered, "entered")
        of = places.select(F.col("r").alias("i"), F.col("rt").alias("task"))
        due, halves = entered, []
        for k, tasks in enumerate(ranges[:-1]):
            got = scratch.keep(cogrouped(f.blocks.filter(_within(tasks)), _summed(due.filter(_within(tasks)), k), "down"), f"down{k}")
            halves.append(got.filter(_within(tasks)))
            rest = got.filter("task < 0")
            due = due.unionByName(rest if ranges[1:] == [(-1, 0)] else scratch.keep(rest.drop("task").join(of, "i").select(*due.columns), f"sent{k}"))
        out = scratch.keep(cogrouped(f.blocks.filter(_within(ranges[-1])), _summed(due.filter(_within(ranges[-1])), 1), "both"), "top")
        lent = _lent(out, needs)
        for tasks, half in zip(reversed(ranges[:-1]), reversed(halves), strict=True):
            up = cogrouped(f.blocks.filter(_within(tasks)), half.unionByName(lent.filter(_within(tasks))), "up")
            if tasks != ranges[0]:
                up = scratch.keep(up, "up")
                lent = lent.unionByName(scratch.keep(_lent(up, needs), "lent"))
            out = out.unionByName(up)
    left = out.join(places.select(F.col(back).alias("at"), F.col("i").alias("own"), scale_back), F.col("i") == F.col("at")).select(F.col("own").alias("i"), "k", *scaled(scale_back))
    return left.select("i", "k", F.struct("re", "im").alias("x") if wide else F.col("re").alias("x"))


def _summed(vector: DataFrame, step: int) -> DataFrame:
    """Parts of a vector from several tasks as one; before the first step there is one only."""
    return vector.groupBy("task", "i", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im")) if step else vector


def _lent(x: DataFrame, needs: DataFrame) -> DataFrame:
    """A solution's values for the tasks that want them."""
    return x.join(needs, "i").select(F.col("want").alias("task"), "i", "k", "re", "im")


def _local_fronts(own: pd.DataFrame) -> tuple[np.ndarray, K.Fronts, np.ndarray]:
    """A task's places in order, its supernodes in terms of these, and the supernode of each place."""
    s, first, last = (own[c].to_numpy(np.int64) for c in ("s", "first", "last"))
    size, sizes = last - first + 1, np.array([len(b) for b in own["below"]], np.int64)
    cols = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    flat = np.concatenate([*own["below"], np.zeros(0, np.int64)]).astype(np.int64)
    ids = np.unique(np.concatenate([cols, flat]))
    below = np.split(np.searchsorted(ids, flat), np.cumsum(sizes)[:-1])
    owner = np.zeros(len(ids), np.int64)
    owner[np.searchsorted(ids, cols)] = np.repeat(np.arange(len(s)), size)
    up = np.searchsorted(s, own["parent"].to_numpy(np.int64))
    up[(up < len(s)) & (s[np.minimum(up, len(s) - 1)] != own["parent"].to_numpy())] = len(s)
    return ids, K.Fronts(np.searchsorted(ids, first), np.searchsorted(ids, last), below, up), owner


def _both(blocks: list[K.Block], x: np.ndarray) -> None:
    K.forward(blocks, x)
    K.backward(blocks, x)


def _flipped(blocks: list[K.Block]) -> list[K.Block]:
    """Blocks of the transposed matrix: U' is made unit lower by its diagonal."""
    out = []
    for b in blocks:
        d = np.diag(b.lu)
        lower = (np.triu(b.lu, 1) / d[:, None]).T
        upper = (np.tril(b.lu, -1) @ np.diag(d) + np.diag(d)).T
        out.append(K.Block(b.s, b.p, b.index, lower + upper, (b.right / d[:, None]).T, (b.low * d[None, :]).T))
    return out


def _forward_transposed(blocks: list[K.Block], x: np.ndarray) -> None:
    K.forward(_flipped(blocks), x)


def _backward_transposed(blocks: list[K.Block], x: np.ndarray) -> None:
    K.backward(_flipped(blocks), x)


@dataclass
class Solved:
    x: DataFrame
    meta: DataFrame  # (k, berr, refine_steps, info)
    factor: Factor | BlockSystem


def refine(a: DataFrame, f: Factor | BlockSystem, b: DataFrame, x: DataFrame, trans: bool = False, precision: str = "double", limit: int = 20) -> tuple[DataFrame, dict[int, tuple[float, int]]]:
    """Iterative refinement in double precision; each right-hand side stops by itself. Returns X and (berr, steps) by k."""
    scratch = Scratch(a.sparkSession)
    matrix = scratch.keep(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if trans else a, "matrix")
    b = scratch.keep(b, "rhs")
    x = scratch.keep(x, "x")
    state: dict[int, tuple[float, int]] = {}
    last: dict[int, float] = {}
    while True:
        rest = scratch.keep(P.residual_rows(matrix, x, b), "residual")
        berr = {r.k: r.berr for r in P.worst_ratio(rest, f.n).collect()}
        going = []
        for k, e in berr.items():
            steps = state.get(k, (0.0, 0))[1]
            active = k not in state or k in last
            state[k] = (e, steps) if active else state[k]
            if active and e > EPS[precision] and 2 * e <= last.get(k, 3.0) and steps < limit:
                last[k] = e
                state[k] = (e, steps + 1)
                going.append(k)
            else:
                last.pop(k, None)
        if not going:
            return x, state
        r = rest.filter(F.col("k").isin(going)).select("i", "k", "x")
        x = scratch.keep(P.add_vectors(x, f.solve(r, trans)), "x")


def solve(a: DataFrame, b: DataFrame, n: int, options: Options | None = None, previous: Factor | None = None, **perms: DataFrame) -> Solved:
    """X of A X = B, or A' X = B with ``options.trans``; X is null where ``info`` is not 0.

    Rows of B that are missing are zeros; no right-hand side gives no rows.
    """
    o = options or Options()
    spark = a.sparkSession
    if previous is None and not perms:
        entries = a.count()
        if not parted.goes_by_parts(o, entries) and (o.col_perm == "parallel_dissection" or entries > o.analysis_entries):
            return solve_blocks(a, b, n, o)
    f = factorize(a, n, o, previous, **perms)
    ks = b.select("k").distinct()
    zero = C.widen(F.lit(0.0), not C.is_complex(b, "x"))
    full = spark.range(n).withColumnRenamed("id", "i").crossJoin(F.broadcast(ks)).join(b, ["i", "k"], "left").select("i", "k", F.coalesce("x", zero).alias("x"))
    x = f.solve(full, o.trans)
    state: dict[int, tuple[float, int]] = {}
    if o.refine != "none" and not f.info and n:
        x, state = refine(a, f, full, x, o.trans, o.refine, o.refine_limit)
    rows = [(int(r.k), *state.get(r.k, (None, 0)), f.info) for r in ks.collect()]
    return Solved(x, spark.createDataFrame(rows, "k int, berr double, refine_steps int, info long"), f)


def solve_blocks(a: DataFrame, b: DataFrame, n: int, options: Options | None = None, leaf: int = 256, size: int = 256) -> Solved:
    """``solve`` without a step in one task: separator tree, factors by blocks and levels (``distributed.factorize_system``), refinement.

    Parts of the tree have about ``leaf`` rows, blocks at most ``size``. The steps for a level take a few seconds of
    fixed cost, so small systems are better solved by subtrees.
    """
    o = options or Options()
    work = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if o.trans else a
    work = Scratch(a.sparkSession).keep(work, "matrix")
    f = factorize_system(work, n, o, leaf, size)
    ks = b.select("k").distinct()
    zero = C.widen(F.lit(0.0), not C.is_complex(b, "x"))
    full = a.sparkSession.range(n).withColumnRenamed("id", "i").crossJoin(F.broadcast(ks)).join(b, ["i", "k"], "left").select("i", "k", F.coalesce("x", zero).alias("x"))
    state: dict[int, tuple[float, int]] = {}
    if f.info:
        x = full.select("i", "k", F.lit(None).cast(full.schema["x"].dataType).alias("x"))
    else:
        x = f.solve(full)
        if o.refine != "none" and n:
            x, state = refine(work, f, full, x, False, o.refine, o.refine_limit)
    rows = [(int(r.k), *state.get(r.k, (None, 0)), f.info) for r in ks.collect()]
    return Solved(x, a.sparkSession.createDataFrame(rows, "k int, berr double, refine_steps int, info long"), f)


def _parts(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """The value column as ``re`` and ``im``; every column under a new name, so that a side made from the other can be told apart."""
    value = C.widen(F.col(name), C.is_complex(df, name))
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns if c != name], value["re"].alias(prefix + "re"), value["im"].alias(prefix + "im"))


def _values(frame: pd.DataFrame, wide: bool) -> np.ndarray:
    re = frame["re"].to_numpy(float)
    return re + 1j * frame["im"].to_numpy(float) if wide else re


def _joined(df: DataFrame, name: str, wide: bool) -> DataFrame:
    """``re`` and ``im`` as one value column again, in the place of ``re``."""
    value = C.make(F.col("re"), F.col("im")) if wide else F.col("re")
    return df.select(*[value.alias(name) if c == "re" else F.col(c) for c in df.columns if c != "im"])


def _dense_sides(r: pd.DataFrame, at: np.ndarray, n: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    ks = np.unique(r["k"])
    rhs = np.zeros((n, len(ks)), complex if wide else float)
    np.add.at(rhs, (at, np.searchsorted(ks, r["k"])), _values(r, wide))
    return rhs, ks


def _solved_rows(ids: np.ndarray, ks: np.ndarray, got: local.Solution) -> pd.DataFrame:
    n = len(ids)
    return pd.DataFrame(
        {"i": np.repeat(ids, len(ks)), "k": np.tile(ks, n).astype(np.int32), "re": np.real(got.x).ravel(), "im": np.imag(got.x).ravel(), "berr": np.tile(got.berr, n), "info": got.info}
    )


SOLVED = "i long, k int, re double, im double, berr double, info long"


def solve_batch(a: DataFrame, b: DataFrame, options: Options | None = None) -> DataFrame:
    """``(batch_id, i, k, x, berr, info)`` of many systems ``a(batch_id, i, j, v)``, ``b(batch_id, i, k, x)``; one task a system.

    Complex entries or right-hand sides give complex X.
    """
    o = options or Options()
    wide = C.is_complex(a, "v") or C.is_complex(b, "x")

    def work(m: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.rename(columns=lambda c: c[2:])
        if not len(r):
            return pd.DataFrame({c.split()[0]: [] for c in f"batch_id long, {SOLVED}".split(", ")})
        n = int(max(m["i"].max(), m["j"].max(), r["i"].max())) + 1 if len(m) else int(r["i"].max()) + 1
        rhs, ks = _dense_sides(r, r["i"].to_numpy(np.int64), n, wide)
        got = local.solve(n, m["i"].to_numpy(np.int64), m["j"].to_numpy(np.int64), _values(m, wide), rhs, o)
        out = _solved_rows(np.arange(n), ks, got)
        out.insert(0, "batch_id", int(r["batch_id"].iloc[0]))
        return out

    left, right = _parts(a.select("batch_id", "i", "j", "v"), "v"), _parts(b.select("batch_id", "i", "k", "x"), "x", "r_")
    return _joined(left.groupBy("batch_id").cogroup(right.groupBy("r_batch_id")).applyInPandas(work, f"batch_id long, {SOLVED}"), "x", wide)


def logdet_batch(a: DataFrame, options: Options | None = None) -> DataFrame:
    """``(batch_id, sign, logdet, info)`` of each system; the sign of complex systems is a complex unit."""
    o = (options or Options()).but(refine="none")
    wide = C.is_complex(a, "v")

    def work(m: pd.DataFrame) -> pd.DataFrame:
        n = int(max(m["i"].max(), m["j"].max())) + 1
        got = local.solve(n, m["i"].to_numpy(np.int64), m["j"].to_numpy(np.int64), _values(m, wide), np.zeros((n, 0)), o)
        return pd.DataFrame({"batch_id": [m["batch_id"].iloc[0]], "re": [float(np.real(got.sign))], "im": [float(np.imag(got.sign))], "logdet": [got.logdet], "info": [got.info]})

    parts = _parts(a.select("batch_id", "i", "j", "v"), "v")
    return _joined(parts.groupBy("batch_id").applyInPandas(work, "batch_id long, re double, im double, logdet double, info long"), "sign", wide)


def solve_components(a: DataFrame, b: DataFrame, options: Options | None = None) -> DataFrame:
    """A system that falls into independent blocks, each solved by its own task: ``(i, k, x, berr, info)``.

    Blocks are the connected components of the pattern; indices are renumbered inside each.
    """
    scratch = Scratch(a.sparkSession)
    comp = scratch.keep(contracted_components(a.select(F.col("i").alias("src"), F.col("j").alias("dst")), scratch), "components")
    o = options or Options()
    wide = C.is_complex(a, "v") or C.is_complex(b, "x")
    of = comp.select(F.col("node").alias("i"), F.col("component").alias("batch_id"))
    left = _parts(a.join(of, "i").select("batch_id", "i", "j", "v"), "v")
    right = _parts(b.join(of, "i").select("batch_id", "i", "k", "x"), "x", "r_")

    def work(m: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.rename(columns=lambda c: c[2:])
        ids = np.unique(np.concatenate([m["i"], m["j"], r["i"]]).astype(np.int64))
        rhs, ks = _dense_sides(r, np.searchsorted(ids, r["i"]), len(ids), wide)
        got = local.solve(len(ids), np.searchsorted(ids, m["i"]), np.searchsorted(ids, m["j"]), _values(m, wide), rhs, o)
        return _solved_rows(ids, ks, got)

    return _joined(left.groupBy("batch_id").cogroup(right.groupBy("r_batch_id")).applyInPandas(work, SOLVED), "x", wide)


class Solver:
    """A matrix factored once and solved with many times; ``free`` or leaving a ``with`` block drops it.

    A later matrix of the same pattern can be given to ``refactor``, which keeps
    the column order, or order, matching and scalings with ``same_rows``.
    """

    def __init__(self, a: DataFrame, n: int, options: Options | None = None):
        self.n, self.options = n, options or Options()
        self.matrix: DataFrame | None = a
        self.factor: Factor | None = factorize(a, n, self.options)

    def __enter__(self) -> Solver:
        return self

    def __exit__(self, *_) -> None:
        self.free()

    def _held(self) -> Factor:
        if self.factor is None:
            raise ValueError("the factors were freed")
        return self.factor

    def refactor(self, a: DataFrame, same_rows: bool = False) -> None:
        how = "same_pattern_same_row_perm" if same_rows else "same_pattern"
        self.factor, self.matrix = factorize(a, self.n, self.options.but(fact=how), self._held()), a

    def solve(self, b: DataFrame) -> Solved:
        return solve(self.matrix, b, self.n, self.options.but(fact="factored"), self._held())

    def logdet(self) -> tuple[complex, float]:
        return self._held().logdet()

    def free(self) -> None:
        self.factor = self.matrix = None


def mixed_precision(a: DataFrame, b: DataFrame, n: int, options: Options | None = None, limit: int = 10, ratio: float = 0.5, settled: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Factor in single, refine in double precision: X and ``(k, norm_bound, comp_bound, berr, steps)``.

    With dx the corrections, a right-hand side stops when dx no longer falls by
    ``ratio``, is below eps, or after ``limit`` steps. The bounds are the last
    correction over 1 - the worst ratio, as a share of X by its greatest entry
    (norm) and by component; the latter only counts once components move by less
    than ``settled``.
    """
    o = (options or Options()).but(precision="single", refine="none")
    scratch = Scratch(a.sparkSession)
    a, b = scratch.keep(a, "matrix"), scratch.keep(b, "rhs")
    f = factorize(a, n, o)
    x = scratch.keep(f.solve(b), "x")
    floor = max(10.0, float(np.sqrt(n))) * EPS["double"]
    state: dict[int, dict] = {r.k: {"dx": np.inf, "dz": np.inf, "rho": 0.0, "rho_z": 0.0, "steps": 0} for r in b.select("k").distinct().collect()}
    active = set() if f.info else set(state)
    while active:
        dx = scratch.keep(f.solve(P.residual_vector(a, x, b).filter(F.col("k").isin(sorted(active)))), "dx")
        both = x.join(dx.select("i", "k", F.abs("x").alias("d")), ["i", "k"])
        size = both.groupBy("k").agg(F.try_divide(F.max("d"), F.max(F.abs("x"))).alias("dx"), F.max(F.try_divide(F.col("d"), F.abs("x"))).alias("dz"))
        x = scratch.keep(P.add_vectors(x, dx), "x")
        for r in size.collect():
            s = state[r.k]
            new, new_z = r.dx or 0.0, r.dz or 0.0
            step, step_z = new / s["dx"], new_z / s["dz"]
            s["steps"] += 1
            going = new > EPS["double"] and (s["steps"] == 1 or step <= ratio) and s["steps"] < limit
            if s["steps"] > 1 and new > EPS["double"]:
                s["rho"] = max(s["rho"], min(step, 0.99))
            if s["steps"] > 1 and new_z > EPS["double"] and s["dz"] < settled:
                s["rho_z"] = max(s["rho_z"], min(step_z, 0.99))
            s["dx"], s["dz"] = new, new_z
            if not going:
                active.discard(r.k)
    berr = {r.k: r.berr for r in P.backward_error(a, x, b, n).collect()}
    rows = [(k, max(s["dx"] / (1 - s["rho"]), floor), max(s["dz"] / (1 - s["rho_z"]), floor), berr.get(k), s["steps"]) for k, s in sorted(state.items())]
    return x, a.sparkSession.createDataFrame(rows, "k int, norm_bound double, comp_bound double, berr double, steps int")


def scaled_matrix(a: DataFrame, n: int) -> tuple[DataFrame, str]:
    """A with the equilibration that is worth applying, and its kind."""
    e = P.equilibrate(a, n, n)
    kind = P.equilibration_kind(e.rowcnd, e.colcnd, e.amax) if not e.info else "N"
    return scale(a, e.rows if kind in "RB" else None, e.cols if kind in "CB" else None), kind


from lattica.operators import parted  # noqa: E402 - builds on the names above
