"""Orderings, matchings, trees and factor patterns as tables.

Those that work in one task on ``(i, j, v)`` serve systems of a batch side by side, with ``per`` = their key; for
one large system there are ``dissection``, ``blocks``, ``matching`` and ``trees``, on which some of these build.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lattica.functions import complexnum as C
from lattica.operators import blocks as B, degree as G, dissection as D, ranges as L
from lattica.operators.matching import product_matching
from lattica.plans import kernels as K, local
from lattica.plans.scratch import Scratch

#: Columns of a range whose factor entries one task counts.
COUNTED = 1 << 17


def _per(a: DataFrame, per: str | None, schema: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    if per is None:
        return a.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda frame: fn(frame), schema)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = fn(frame)
        out.insert(0, per, frame[per].iloc[0])
        return out

    return a.groupBy(per).applyInPandas(work, f"{per} long, {schema}")


def _size(frame: pd.DataFrame, n: int | None) -> int:
    return n if n is not None else int(max(frame["i"].max(), frame["j"].max())) + 1


def match_rows(a: DataFrame, n: int | None = None, job: int = 5, per: str | None = None) -> DataFrame:
    """``(src, dst, u, v, info)``: row ``src`` goes to ``dst``; u is the log scale of row src, v of column src.

    One system of more than ``degree.PIECE`` rows is matched by joins for the greatest product (job 5), else by one task.
    """
    if per is None and job == 5 and n is not None and n > G.PIECE:
        return product_matching(a, n)
    a = a.withColumn("v", C.size(F.col("v"), C.is_complex(a, "v")))

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        got = K.match_rows(size, m["i"].to_numpy(), m["j"].to_numpy(), m["v"].to_numpy(), job)
        return pd.DataFrame({"src": np.arange(size), "dst": got.perm, "u": got.u, "v": got.v, "info": got.info})

    return _per(a, per, "src long, dst long, u double, v double, info int", fn)


def heavy_matching(a: DataFrame, max_rounds: int = 50, task_entries: int = 5_000_000) -> DataFrame:
    """``(src, dst)`` of locally dominant entries, by rounds of joins: at least half the greatest weight, not always perfect.

    In each round an entry that is the largest of its row and of its column is
    taken, and both go, until no entry is left. That takes the entries by
    falling weight, equal ones by row and column, so after ``max_rounds``
    rounds (weights that rise along a chain free one row a round) one task
    goes through the rest in that order, once it has ``task_entries`` at most.
    """
    scratch = Scratch(a.sparkSession)
    left = scratch.keep(a.select("i", "j", C.size(F.col("v"), C.is_complex(a, "v")).alias("w")).filter("w != 0"), "edges")
    found = left.select("i", "j").limit(0)
    rounds = 0
    while not left.isEmpty():
        if rounds >= max_rounds and left.count() <= task_entries:
            rest = _per(left, None, "i long, j long", _by_weight)
            found = found.unionByName(rest)
            break
        by_row = left.groupBy("i").agg(F.max(F.struct("w", (-F.col("j")).alias("o"))).alias("b")).select("i", (-F.col("b.o")).alias("j"))
        by_col = left.groupBy("j").agg(F.max(F.struct("w", (-F.col("i")).alias("o"))).alias("b")).select((-F.col("b.o")).alias("i"), "j")
        taken = scratch.keep(by_row.join(by_col, ["i", "j"]), "taken")
        found = found.unionByName(taken)
        rounds += 1
        if rounds % 50 == 0:  # short plans
            found = scratch.keep(found, "found")
        fewer = scratch.keep(left.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti"), "edges")
        if rounds > 1:  # the first is the schema of what is found
            scratch.drop(left)
        left = fewer
    return found.select(F.col("i").alias("src"), F.col("j").alias("dst"))


def _by_weight(m: pd.DataFrame) -> pd.DataFrame:
    """Entries of a matching by falling weight (NaN first), then row, then column."""
    i, j, w = m["i"].to_numpy(), m["j"].to_numpy(), m["w"].to_numpy()
    rows, cols, taken = set(), set(), []
    for k in np.lexsort((j, i, np.where(np.isnan(w), -np.inf, -w), ~np.isnan(w))).tolist():
        r, c = i[k], j[k]
        if r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            taken.append(k)
    return pd.DataFrame({"i": i[taken], "j": j[taken]})


def order_columns(a: DataFrame, how: str, n: int | None = None, per: str | None = None) -> DataFrame:
    """``(src, dst)`` of a fill-reducing order. Of one system the natural order needs no task, and minimum degree and nested
    dissection of more than ``degree.PIECE`` rows go by pieces.
    """
    if per is None and n is not None:
        if how == "natural":
            return a.sparkSession.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
        if n > G.PIECE and how in ("mmd_at_plus_a", "mmd_ata", "colamd"):
            return G.minimum_degree_by_pieces(a, n, "symmetric" if how == "mmd_at_plus_a" else "column")
        if n > G.PIECE and how == "nested_dissection":
            return D.dissect(a, n).permutation()

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        return pd.DataFrame({"src": np.arange(size), "dst": K.order_columns(size, m["i"].to_numpy(), m["j"].to_numpy(), how)})

    return _per(a, per, "src long, dst long", fn)


def elimination_tree(a: DataFrame, n: int | None = None, kind: str = "symmetric", per: str | None = None) -> DataFrame:
    """``(node, parent, post, level, descendants)`` of A + A' ("symmetric") or A' A ("column"); a root's parent is n."""

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        i, j = m["i"].to_numpy(), m["j"].to_numpy()
        if kind == "column":
            tree = K.column_tree(size, K.columns(size, i, j), int(i.max()) + 1 if len(i) else 0)
        else:
            tree = K.symmetric_tree(K.symmetric_columns(size, i, j))
        post = K.postorder(tree)
        return pd.DataFrame({"node": np.arange(size), "parent": tree, "post": post, "level": K.depths(tree), "descendants": K.descendants(K.relabel_tree(tree, post))[post]})

    return _per(a, per, "node long, parent long, post long, level long, descendants long", fn)


def supernodes(a: DataFrame, n: int | None = None, relax: int = 30, maxsup: int = 256, parts: int = 1, per: str | None = None) -> DataFrame:
    """``(s, first, last, rows, parent, level, task)`` in postorder; task -1 is the top of the division into ``parts``."""

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        i, j = m["i"].to_numpy(), m["j"].to_numpy()
        tree = K.symmetric_tree(K.symmetric_columns(size, i, j))
        post = K.postorder(tree)
        f = K.fronts(K.symmetric_columns(size, post[i], post[j]), K.relabel_tree(tree, post), relax, maxsup)
        rows = f.last - f.first + 1 + np.array([len(b) for b in f.below], np.int64)
        task = K.subtree_tasks(f, parts) if parts > 1 else np.full(len(rows), -1)
        return pd.DataFrame({"s": np.arange(len(rows)), "first": f.first, "last": f.last, "rows": rows, "parent": f.parent, "level": K.depths(f.parent), "task": task})

    return _per(a, per, "s long, first long, last long, rows long, parent long, level long, task long", fn)


def symbolic_parallel(a: DataFrame, n: int, layout: B.Layout | None = None) -> DataFrame:
    """``(part, i, j)`` as ``symbolic``, by blocks of ``layout`` (the separator tree's, or neighbouring rows): level by level
    each block's pattern is the union of its entries and of products of the panels before it. Indices are the matrix's own,
    the order of elimination is the layout's. Without a layout rows go one after another by ranges (``ranges``), unless they may fill in too much for that.
    """
    if layout is None and L.patterns_fit(n, entries := L.envelope(a)):
        found = L.eliminate_rows(a, n, True, L.range_rows(n, entries))
        return found.withColumn("part", F.explode(F.expr("case when i = j then array('L', 'U') when i > j then array('L') else array('U') end"))).select("part", "i", "j")
    return B.factorize_blocks(a, n, layout or B.in_order(a, n), B.Pattern()).entries().select("part", "i", "j")


def symbolic(a: DataFrame, n: int | None = None, per: str | None = None) -> DataFrame:
    """``(part, i, j)``: the exact patterns of L (with its diagonal) and U (with it) for diagonal pivots."""

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        low, up = K.symbolic(size, m["i"].to_numpy(), m["j"].to_numpy())
        up = [np.append(u, c) for c, u in enumerate(up)]
        parts = []
        for name, cols in (("L", low), ("U", up)):
            count = [len(c) for c in cols]
            parts.append(pd.DataFrame({"part": name, "i": np.concatenate(cols) if cols else [], "j": np.repeat(np.arange(size), count)}))
        return pd.concat(parts)

    return _per(a, per, "part string, i long, j long", fn)


def _range_counted(size: int) -> Callable:
    """Entries of L in a range's columns (``lo`` -1), and what is left of its columns for later ranges: links ``(lo, hi)`` of the next column to the further ones."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) * size
        frame = frame.sort_values("lo", kind="stable")
        lo, hi = frame["lo"].to_numpy(), frame["hi"].to_numpy()
        ids, start = np.unique(lo, return_index=True)
        own = dict(zip(ids.tolist(), np.split(hi, start[1:]), strict=True))
        waiting: dict[int, set[int]] = {}
        order = ids.tolist()
        heapq.heapify(order)
        count, last, rest = 0, -1, []
        while order:
            c = heapq.heappop(order)
            if c == last:
                continue
            last = c
            struct = waiting.pop(c, None) or set()
            if c in own:
                struct.update(own[c].tolist())
            struct.discard(c)
            count += len(struct)
            if not struct:
                continue
            p = c + 1 if c + 1 in struct else min(struct)
            if p >= base + size:
                rest.append((p, struct))
                continue
            have = waiting.get(p)
            if have is None:
                heapq.heappush(order, p)
                waiting[p] = struct
            else:  # the smaller set goes into the larger
                small, large = sorted((have, struct), key=len)
                large |= small
                waiting[p] = large
        out_lo = np.repeat(np.array([-1, *(p for p, _ in rest)], np.int64), [1, *(len(x) for _, x in rest)])
        return pd.DataFrame({"lo": out_lo, "hi": np.array([count, *(y for _, x in rest for y in x)], np.int64)})

    return work


def factor_entries(a: DataFrame, n: int, order: DataFrame | None = None, size: int = COUNTED) -> int:
    """How many entries L (with its diagonal) of the pattern A + A' has in an order ``(src, dst)``, without making them.

    Ranges of ``size`` neighbouring columns are counted level by level as their links allow, each by one task; of a finished
    range only the columns that later ones must take over go on. The ranges alone are looked at in one place.
    """
    spark = a.sparkSession
    scratch = Scratch(spark)
    ends = a.select("i", "j")
    if order is not None:
        at = scratch.keep(order, "order")
        rows, cols = at.select(F.col("src").alias("i"), F.col("dst").alias("x")), at.select(F.col("src").alias("j"), F.col("dst").alias("y"))
        ends = ends.join(rows.hint("merge"), "i").join(cols.hint("merge"), "j").select(F.col("x").alias("i"), F.col("y").alias("j"))
    links = ends.filter("i != j").select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    links = scratch.keep(links.withColumn("r", F.expr(f"lo div {size}")), "links")
    pairs = links.select("r", F.expr(f"hi div {size}").alias("to")).distinct().collect()  # ranges, not rows
    count = -(-n // size)
    tree = K.symmetric_tree(K.symmetric_columns(count, np.array([p.r for p in pairs], np.int64), np.array([p.to for p in pairs], np.int64)))
    levels = np.zeros(count, np.int64)
    for r, p in enumerate(tree.tolist()):
        if p < count:
            levels[p] = max(levels[p], levels[r] + 1)
    total, sent = n, []
    for level in range(int(levels.max(initial=-1)) + 1):
        mine = np.flatnonzero(levels == level).tolist()
        due = links.filter(F.col("r").isin(mine))
        for df in sent:
            due = due.unionByName(df.filter(F.col("r").isin(mine)))
        out = scratch.keep(due.groupBy("r").applyInPandas(_range_counted(size), "lo long, hi long"), "counted")
        total += out.filter("lo < 0").agg(F.sum("hi")).first()[0] or 0
        sent.append(out.filter("lo >= 0").withColumn("r", F.expr(f"lo div {size}")))
    return total


def _rows_of(*frames: tuple[DataFrame, list[str]]) -> int:
    """One more than the greatest index of some columns."""
    most = [frame.agg(F.greatest(*[F.coalesce(F.max(c), F.lit(-1)) for c in columns], F.lit(-1)).alias("m")).first()["m"] for frame, columns in frames]
    return int(max(most)) + 1


def incomplete_lu(a: DataFrame, n: int | None = None, per: str | None = None) -> DataFrame:
    """ILU of level 0, ``(i, j, v)`` on the pattern of A: L below the diagonal (units not stored), U on and above.

    One system is factored by ranges of neighbouring rows, a batch member in a task of its own.
    """
    wide = C.is_complex(a, "v")
    if per is None:
        n = _rows_of((a, ["i", "j"])) if n is None else n
        return L.eliminate_rows(a, n, False)
    parts = a.withColumn("re", C.widen(F.col("v"), wide)["re"]).withColumn("im", C.widen(F.col("v"), wide)["im"]).drop("v")

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        given = m["re"].to_numpy() + 1j * m["im"].to_numpy() if wide else m["re"].to_numpy()
        v = local.ilu0(_size(m, n), m["i"].to_numpy(), m["j"].to_numpy(), given)
        return pd.DataFrame({"i": m["i"], "j": m["j"], "re": np.real(v), "im": np.imag(v)})

    out = _per(parts, per, "i long, j long, re double, im double", fn)
    value = C.make(F.col("re"), F.col("im")) if wide else F.col("re")
    return out.select(per, "i", "j", value.alias("v"))


def triangular_solve(a: DataFrame, b: DataFrame, lower: bool = True, unit: bool = False, trans: bool = False, conj: bool = False, size: int | None = None) -> DataFrame:
    """X of T X = B with T the lower or upper triangle of ``a`` (its transpose, its conjugate); a zero diagonal gives infinities.

    Ranges of neighbouring rows (``size``, by default as many as a task may hold) are solved level by level, as their entries allow.
    """
    wide = C.is_complex(a, "v")
    v = C.conjugate(F.col("v")) if conj and wide else F.col("v")
    t = a.filter("i >= j" if lower else "i <= j").select("i", "j", v.alias("v"))
    if trans:
        t, lower = t.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), not lower
    n = _rows_of((a, ["i", "j"]), (b, ["i"]))
    if unit and not lower:
        ones = C.widen(F.lit(1.0), False) if wide else F.lit(1.0)
        t = t.filter("i != j").unionByName(a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), ones.alias("v")))
    elif not unit and lower:  # rows divided by their diagonal: a unit lower triangle
        t = Scratch(a.sparkSession).keep(t, "triangle")
        diag = t.filter("i = j").select("i", F.col("v").alias("d"))
        endless, none = C.make(F.lit(float("inf")), F.lit(0.0)) if wide else F.lit(float("inf")), C.size(F.coalesce("d", C.widen(F.lit(0.0), not wide)), wide) == 0
        one = C.widen(F.lit(1.0), False) if wide else F.lit(1.0)
        by = F.when(none, endless).otherwise(C.divide(one, F.col("d")) if wide else F.try_divide(one, F.col("d")))
        s = b.sparkSession.range(n).withColumnRenamed("id", "i").join(diag, "i", "left").select("i", by.alias("s"))
        times = lambda x, w: C.multiply(C.widen(x, w), F.col("s")) if wide else C.times(x, F.col("s"), w)
        t = t.join(s, "i").select("i", "j", times(F.col("v"), wide).alias("v"))
        b = b.join(s, "i").select("i", "k", times(F.col("x"), C.is_complex(b, "x")).alias("x"))
    return L.solve_triangle(t, b, n, lower, size)


def level_sets(low: DataFrame, n: int | None = None, per: str | None = None) -> DataFrame:
    """``(node, level)`` of a lower triangle's rows: level 0 needs no other row, each next level only lower ones. Rows of a level are solved side by side."""

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        size = _size(m, n)
        m = m[m["i"] > m["j"]].sort_values("j")
        start = np.searchsorted(m["j"], np.arange(size + 1))
        rows, level = m["i"].to_numpy(np.int64), np.zeros(size, np.int64)
        for c in range(size):
            at = rows[start[c] : start[c + 1]]
            level[at] = np.maximum(level[at], level[c] + 1)
        return pd.DataFrame({"node": np.arange(size), "level": level})

    return _per(low, per, "node long, level long", fn)


def static_partition(work: DataFrame, parts: int) -> DataFrame:
    """``(item, load, part)``: the greatest load first, each to the part with the least so far; ties to the smaller item and part.

    One task: the items are supernodes or subtrees, which the bound on the analysis bounds too.
    """

    def fn(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["load", "item"], ascending=[False, True])
        heap = [(0.0, p) for p in range(parts)]
        to = []
        for load in m["load"]:
            has, p = heapq.heappop(heap)
            to.append(p)
            heapq.heappush(heap, (has + load, p))
        return pd.DataFrame({"item": m["item"], "load": m["load"], "part": to})

    given = work.select(F.col("item").cast("long").alias("item"), F.col("load").cast("double").alias("load"))
    return _per(given, None, "item long, load double, part int", fn)


def solve_factored(a: DataFrame, b: DataFrame) -> DataFrame:
    """X for a matrix whose entries are L (unit, below the diagonal) and U already."""
    return triangular_solve(a, triangular_solve(a, b, lower=True, unit=True), lower=False)


def load_imbalance(nodes: DataFrame) -> DataFrame:
    """``(tasks, total, most, imbalance)`` of a table of supernodes: most work of a task over the mean."""
    size = F.col("last") - F.col("first") + 1
    load = nodes.filter("task >= 0").groupBy("task").agg(F.sum((size * F.col("rows") * F.col("rows")).cast("double")).alias("load"))
    return load.agg(F.count(F.lit(1)).alias("tasks"), F.sum("load").alias("total"), F.max("load").alias("most"), F.try_divide(F.max("load"), F.avg("load")).alias("imbalance"))
