"""Factorization and solves by blocks, level by level: no task sees more than a few blocks.

Rows are laid out in blocks (``Layout``), each with a level; blocks of one level share no
entry and none of a level needs a later one. A level's blocks get what is due to them: their
own entries and the updates of earlier levels, which wait in files by the level
they are due at, so each update is written once and read once. Then diagonal blocks are
factored, the panels beside and below them are finished, and products of panels become updates
of later blocks. The same rounds serve values (``Values``), exact patterns
(``Pattern``: products of truth values) and factors without fill (``NoFill``); solves send parts
of vectors down and up through the levels in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.functions import complexnum as C
from lattica.operators.dissection import Dissection
from lattica.plans import kernels as K
from lattica.plans.scratch import Scratch, _file_system

#: Rows of a block at most.
BLOCK = 256
#: Panels of one pivot that are multiplied together in one row of a task: as many beside as below.
FAN = 8
#: Sums a task holds before it writes them.
HELD = 64

PIECE = "bi long, bj long, ni int, nj int, li int, lj int, data binary"


# --- arithmetic on blocks -------------------------------------------------------------------------------------------


def pack(block: np.ndarray, mask: np.ndarray | None = None) -> bytes:
    """A block as bytes: all of it, or the places and values of its entries, whichever is shorter. ``mask`` names the entries."""
    flat = np.ascontiguousarray(block).ravel()
    at = np.flatnonzero(flat if mask is None else mask.ravel())
    if mask is None and len(at) * (4 + flat.itemsize) >= flat.nbytes:
        return b"d" + flat.tobytes()
    return b"s" + at.astype(np.int32).tobytes() + flat[at].tobytes()


def unpack(data: bytes, shape: tuple[int, int], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray | None]:
    """The block and, of a packed one, where its entries are."""
    if data[:1] == b"d":
        return np.frombuffer(data, dtype, offset=1).reshape(shape).copy(), None
    count = (len(data) - 1) // (4 + np.dtype(dtype).itemsize)
    at = np.frombuffer(data, np.int32, count, 1)
    out, mask = np.zeros(shape[0] * shape[1], dtype), np.zeros(shape[0] * shape[1], bool)
    out[at] = np.frombuffer(data, dtype, count, 1 + 4 * count)
    mask[at] = True
    return out.reshape(shape), mask.reshape(shape)


@dataclass(frozen=True)
class Values:
    """LU without pivoting in real or complex numbers; with a threshold, tiny pivots are replaced."""

    dtype: str = "float64"
    threshold: float = 0.0

    own_only = False

    def add(self, total: np.ndarray, block: np.ndarray) -> None:
        total += block

    def factor(self, block: np.ndarray, mask: np.ndarray | None) -> tuple[int, int]:
        return K.dense_lu(block, self.threshold, 0)

    def beside(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """A block of U: inv(L) block."""
        return K.lower_solve(diag, block)

    def below(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """A block of L: block inv(U)."""
        flipped = np.triu(diag).T[::-1, ::-1]  # lower triangle of U' reversed is upper again
        return np.ascontiguousarray(K.upper_solve(np.ascontiguousarray(flipped), np.ascontiguousarray(block.T[::-1]))[::-1].T)

    def product(self, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        return -(low @ up)


@dataclass(frozen=True)
class Pattern:
    """Exact patterns of L and U for diagonal pivots, every diagonal entry taken as there."""

    dtype: str = "bool"

    own_only = False

    def add(self, total: np.ndarray, block: np.ndarray) -> None:
        total |= block

    def factor(self, block: np.ndarray, mask: np.ndarray | None) -> tuple[int, int]:
        np.fill_diagonal(block, True)
        for k in range(len(block) - 1):
            rows = k + 1 + np.flatnonzero(block[k + 1 :, k])
            block[rows, k + 1 :] |= block[k, k + 1 :]
        return 0, 0

    def beside(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        for k in range(len(diag) - 1):
            block[k + 1 + np.flatnonzero(diag[k + 1 :, k])] |= block[k]
        return block

    def below(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        for k in range(len(diag) - 1):
            block[:, k + 1 + np.flatnonzero(diag[k, k + 1 :])] |= block[:, [k]]
        return block

    def product(self, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        return (low.astype(np.float32) @ up.astype(np.float32)) > 0


@dataclass(frozen=True)
class NoFill:
    """Incomplete LU of level 0: only the entries of the matrix, whatever their value."""

    dtype: str = "float64"

    own_only = True

    def add(self, total: np.ndarray, block: np.ndarray) -> None:
        total += block

    def factor(self, block: np.ndarray, mask: np.ndarray | None) -> tuple[int, int]:
        info = 0
        for k in range(len(block)):
            if block[k, k] == 0:
                info = info or k + 1
                continue
            rows = k + 1 + np.flatnonzero(mask[k + 1 :, k])
            block[rows, k] /= block[k, k]
            block[rows, k + 1 :] -= np.outer(block[rows, k], block[k, k + 1 :]) * mask[rows, k + 1 :]
        return 0, info

    def beside(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        for k in range(len(diag) - 1):
            block[k + 1 :] -= np.outer(diag[k + 1 :, k], block[k]) * mask[k + 1 :]
        return block

    def below(self, diag: np.ndarray, block: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        for k in range(len(diag)):
            block[:, k] /= diag[k, k]
            block[:, k + 1 :] -= np.outer(block[:, k], diag[k, k + 1 :]) * mask[:, k + 1 :]
        return block

    def product(self, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        return -(low @ up)


# --- layouts --------------------------------------------------------------------------------------------------------


@dataclass
class Layout:
    """``places(i, block, at, n, level)``: each row's block (its first position), its place there, the block's rows and level; ``levels`` in all."""

    places: DataFrame
    levels: int


def in_order(a: DataFrame, n: int, size: int = BLOCK, order: DataFrame | None = None) -> Layout:
    """Neighbouring rows (of ``order(src, dst)``, else of the matrix) as blocks, each a level of its own."""
    rows = a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("pos"))
    if order is not None:
        rows = order.select(F.col("src").alias("i"), F.col("dst").alias("pos"))
    turn = F.expr(f"pos div {size}")
    width = F.least(F.lit(size), F.lit(n) - turn * size).cast("int")
    places = rows.select("i", (turn * size).alias("block"), (F.col("pos") % size).cast("int").alias("at"), width.alias("n"), turn.cast("int").alias("level"))
    return Layout(Scratch(a.sparkSession).keep(places, "places"), -(-n // size))


def by_tree(d: Dissection, size: int = BLOCK) -> Layout:
    """Nodes of a separator tree as blocks, large ones cut; all nodes of one height go side by side."""
    spark = d.order.sparkSession
    cuts = d.tree.withColumn("cuts", F.expr(f"(size + {size - 1}) div {size}"))
    most = {r.height: r.most for r in cuts.groupBy("height").agg(F.max("cuts").alias("most")).collect()}  # one row a height
    base, levels = {}, 0
    for h in range(d.depth + 1):
        base[h] = levels
        levels += most.get(h, 0)
    starts = spark.createDataFrame([(h, b) for h, b in base.items()], "height int, base int")
    inner = F.expr(f"rank div {size}")
    rows = d.order.join(cuts.select("height", "node", "size", "first").hint("merge"), ["height", "node"]).join(F.broadcast(starts), "height")  # one row a height
    width = F.least(F.lit(size), F.col("size") - inner * size).cast("int")
    places = rows.select("i", (F.col("first") + inner * size).alias("block"), (F.col("rank") % size).cast("int").alias("at"), width.alias("n"), (F.col("base") + inner).cast("int").alias("level"))
    return Layout(Scratch(spark).keep(places, "places"), levels)


def needed_levels(low: DataFrame, n: int, size: int, upper: bool = False) -> tuple[DataFrame, int]:
    """``(block, level)`` of blocks of ``size`` neighbouring rows, the least levels that a triangle's entries allow, and how many levels; by rounds of joins on blocks."""
    scratch = Scratch(low.sparkSession)
    links = low.select(F.expr(f"(i div {size}) * {size}").alias("to"), F.expr(f"(j div {size}) * {size}").alias("of")).filter("to < of" if upper else "to > of").distinct()
    links = scratch.keep(links, "links")
    count = -(-n // size)
    level = scratch.keep(low.sparkSession.range(count).select((F.col("id") * size).alias("block"), F.lit(0).alias("level")), "levels", count)
    while True:
        need = links.join(level.withColumnRenamed("block", "of"), "of").groupBy(F.col("to").alias("block")).agg((F.max("level") + 1).alias("need"))
        nxt = scratch.keep(level.join(need, "block", "left").select("block", F.coalesce("need", F.lit(0)).cast("int").alias("level"), (F.coalesce("need", F.lit(0)) != F.col("level")).alias("moved")), "levels", count)
        if nxt.filter("moved").isEmpty():
            break
        level = nxt.select("block", "level")
    most = level.agg(F.max("level")).first()[0]
    if upper:  # solves go up from the highest level, so what needs nothing is highest
        level = level.withColumn("level", F.lit(most) - F.col("level"))
    return level, 0 if most is None else most + 1


def by_need(low: DataFrame, n: int, size: int = BLOCK, upper: bool = False) -> Layout:
    """Neighbouring rows as blocks with the least levels that a triangle's entries allow."""
    level, levels = needed_levels(low, n, size, upper)
    places = in_order(low, n, size).places.drop("level").join(level, "block")
    return Layout(Scratch(low.sparkSession).keep(places, "places"), levels)


# --- rounds ---------------------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(x)[k].as_py() for x, c in enumerate(batch.schema.names)}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PIECE = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("ni", pa.int32()), ("nj", pa.int32()), ("li", pa.int32()), ("lj", pa.int32()), ("data", pa.binary())])
_DONE = pa.schema([*_PIECE, ("tiny", pa.int32()), ("info", pa.int32())])


def _entries(a: DataFrame, layout: Layout) -> DataFrame:
    """Entries with the blocks and places of their rows and columns; values as ``re`` and ``im``."""
    wide = C.is_complex(a, "v")
    v = C.widen(F.col("v"), wide)
    side = lambda x, i: layout.places.select(F.col("i").alias(i), F.col("block").alias(f"b{x}"), F.col("at").alias(f"a{x}"), F.col("n").alias(f"n{x}"), F.col("level").alias(f"l{x}"))
    cells = a.select(F.col("i").alias("r"), F.col("j").alias("c"), v["re"].alias("re"), v["im"].alias("im"))
    return cells.join(side("i", "r").hint("merge"), "r").join(side("j", "c").hint("merge"), "c").select("bi", "bj", "ni", "nj", "li", "lj", "ai", "aj", "re", "im")


def _packed(entries: DataFrame, dtype: str) -> DataFrame:
    """Pieces of the matrix itself, one a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, values = None, [], []

        def piece() -> tuple:
            bi, bj, ni, nj, li, lj = now
            flat = np.concatenate(at)
            got = np.concatenate(values).astype(dtype) if dtype != "bool" else np.ones(len(flat), bool)
            order = np.argsort(flat, kind="stable")
            flat, got = flat[order], got[order]
            if len(flat) > 1 and (flat[1:] == flat[:-1]).any():  # places that were not merged
                first = np.concatenate(([True], flat[1:] != flat[:-1]))
                got = np.add.reduceat(got, np.flatnonzero(first)).astype(dtype)
                flat = flat[first]
            return bi, bj, ni, nj, li, lj, b"s" + flat.astype(np.int32).tobytes() + got.tobytes()

        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            keys = frame[["bi", "bj"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
                part = frame.iloc[a:b]
                head = tuple(int(x) for x in part[["bi", "bj", "ni", "nj", "li", "lj"]].iloc[0])
                if now is not None and head != now:
                    out.append(piece())
                    at, values = [], []
                now = head
                at.append(part["ai"].to_numpy(np.int64) * head[3] + part["aj"].to_numpy(np.int64))
                values.append(part["re"].to_numpy(float) + 1j * part["im"].to_numpy(float) if np.dtype(dtype).kind == "c" else part["re"].to_numpy(float))
            if out:
                yield _batch(out, _PIECE)
        if now is not None:
            yield _batch([piece()], _PIECE)

    return entries.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(work, PIECE)


def _finished(arith) -> Callable:
    """Sums pieces of a block, sorted by (bi, bj); factors diagonal ones. With ``own_only`` blocks without an entry of the matrix go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = total = mask = None

        def done() -> list[tuple]:
            bi, bj, ni, nj, li, lj = now
            tiny = info = 0
            if arith.own_only and mask is None:
                return []
            own = mask if arith.own_only else None
            if own is not None:
                total[~own] = 0
            if bi == bj:
                tiny, info = arith.factor(total, own)
            return [(*now, pack(total, own), tiny, info and bi + info)]

        for r in _rows(batches):
            head = tuple(r[c] for c in ("bi", "bj", "ni", "nj", "li", "lj"))
            if head != now:
                if now is not None and (out := done()):
                    yield _batch(out, _DONE)
                now, total, mask = head, np.zeros((head[2], head[3]), arith.dtype), None
            block, where = unpack(r["data"], total.shape, arith.dtype)
            arith.add(total, block)
            if r["own"]:
                mask = where
        if now is not None and (out := done()):
            yield _batch(out, _DONE)

    return work


def _panels(arith) -> Callable:
    """Panels with the diagonal block of their pivot in ``diag`` finished."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            shape = (r["ni"], r["nj"])
            block, mask = unpack(r["data"], shape, arith.dtype)
            k = r["nj"] if r["lj"] < r["li"] else r["ni"]
            diag, _ = unpack(r["diag"], (k, k), arith.dtype)
            block = (arith.below if r["lj"] < r["li"] else arith.beside)(diag, block, mask)
            data = pack(block, mask if arith.own_only else None)
            yield _batch([(r["bi"], r["bj"], r["ni"], r["nj"], r["li"], r["lj"], data)], _PIECE)

    return work


def _updates(arith) -> Callable:
    """Products of a pivot's panels, summed by block within the task as far as few sums are open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def full() -> pa.RecordBatch:
            out = _batch([(*head, pack(block)) for head, block in held.items()], _PIECE)
            held.clear()
            return out

        for r in _rows(batches):
            lows = [(x, unpack(x["data"], (x["n"], r["n"]), arith.dtype)[0]) for x in r["lows"]]
            for y in r["ups"]:
                up = unpack(y["data"], (r["n"], y["n"]), arith.dtype)[0]
                for x, low in lows:
                    head = (x["b"], y["b"], x["n"], y["n"], x["l"], y["l"])
                    got = arith.product(low, up)
                    if not got.any():
                        continue
                    if head in held:
                        arith.add(held[head], got)
                    else:
                        held[head] = got
            if len(held) >= HELD:
                yield full()
        if held:
            yield full()

    return work


def _products(arith) -> Callable:
    """L times U of a pivot's blocks, its own with its triangles, summed by block within the task as far as few sums are open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for r in _rows(batches):
            lows = [(x, unpack(x["data"], (x["n"], r["n"]), arith.dtype)[0]) for x in r["lows"]]
            lows = [(x, np.tril(low, -1) + np.eye(r["n"], dtype=arith.dtype) if x["b"] == r["k"] else low) for x, low in lows]
            for y in r["ups"]:
                up = unpack(y["data"], (r["n"], y["n"]), arith.dtype)[0]
                up = np.triu(up) if y["b"] == r["k"] else up
                for x, low in lows:
                    head = (x["b"], y["b"], x["n"], y["n"], x["l"], y["l"])
                    got = low @ up
                    if head in held:
                        arith.add(held[head], got)
                    elif got.any():
                        held[head] = got
            if len(held) >= HELD:
                yield _batch([(*head, pack(block)) for head, block in held.items()], _PIECE)
                held.clear()
        if held:
            yield _batch([(*head, pack(block)) for head, block in held.items()], _PIECE)

    return work


def _worst(arith) -> Callable:
    """Greatest size in each block of the sum of its pieces, sorted by (bi, bj), less those of the matrix itself (``own``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("worst", pa.float64())])
        now = total = None
        for r in _rows(batches):
            head = (r["bi"], r["bj"])
            if head != now:
                if now is not None:
                    yield _batch([(*now, float(np.abs(total).max()))], schema)
                now, total = head, np.zeros((r["ni"], r["nj"]), arith.dtype)
            block, _ = unpack(r["data"], total.shape, arith.dtype)
            arith.add(total, -block if r["own"] else block)
        if now is not None:
            yield _batch([(*now, float(np.abs(total).max()))], schema)

    return work


def _fans(blocks: DataFrame, low: bool) -> DataFrame:
    """Blocks of each pivot in groups of neighbours: ``(k, g, n, lows, bytes)`` below it, ``(uk, h, ups, more)`` beside it."""
    k, b, n, own, level, names = ("bj", "bi", "nj", "ni", "li", ("k", "g", "lows", "bytes")) if low else ("bi", "bj", "ni", "nj", "lj", ("uk", "h", "ups", "more"))
    group = [F.col(k).alias(names[0]), F.expr(f"{b} div {FAN * BLOCK}").alias(names[1]), *([F.col(n).alias("n")] if low else [])]
    held = F.struct(F.col(b).alias("b"), F.col(own).alias("n"), F.col(level).alias("l"), "data")
    return blocks.groupBy(*group).agg(F.collect_list(held).alias(names[2]), F.sum(F.length("data")).alias(names[3]))


@dataclass
class BlockFactor:
    """Factors as written blocks: ``path/diag`` and ``path/panels`` by level."""

    n: int
    layout: Layout
    path: str
    scratch: Scratch
    dtype: str
    tiny: int
    info: int
    largest: int  # bytes of the largest group of panels that one task held

    def _read(self, kind: str, level: int | str = "*") -> DataFrame | None:
        return _due(self.scratch, f"{self.path}/{kind}/level={level}")

    def blocks(self) -> DataFrame:
        """All blocks of L and U: ``(bi, bj, ni, nj, li, lj, data)``; diagonal ones hold both."""
        out = self._read("diag").select(*_PIECE.names)
        panels = self._read("panels")
        return out if panels is None else out.unionByName(panels.select(*_PIECE.names))

    def entries(self) -> DataFrame:
        """``(part, i, j, v)`` of L (units included) and U by the matrix's own rows; truth values as 1."""
        dtype, wide = self.dtype, np.dtype(self.dtype).kind == "c"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("part", pa.string()), ("bi", pa.int64()), ("bj", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("re", pa.float64()), ("im", pa.float64())])
            for x in _rows(batches):
                block, mask = unpack(x["data"], (x["ni"], x["nj"]), dtype)
                there = block.astype(bool) if mask is None else mask
                sides = [("L", np.tril(there, -1)), ("U", np.triu(there))] if x["bi"] == x["bj"] else [("L" if x["li"] > x["lj"] else "U", there)]
                for part, own in sides:
                    r, c = np.nonzero(own)
                    v = block[r, c]
                    if part == "L" and x["bi"] == x["bj"]:
                        units = np.arange(len(block))
                        r, c, v = np.concatenate((r, units)), np.concatenate((c, units)), np.concatenate((v, np.ones(len(block), v.dtype)))
                    both = [np.real(v).astype(float), np.imag(v).astype(float) if wide else np.zeros(len(v))]
                    at = [np.full(len(r), x["bi"]), np.full(len(r), x["bj"]), r.astype(np.int32), c.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(r), pa.string()), *[pa.array(z) for z in (*at, *both)]], schema=schema)

        cells = self.blocks().mapInArrow(work, "part string, bi long, bj long, r int, c int, re double, im double")
        rows = self.layout.places.select(F.col("block").alias("bi"), F.col("at").alias("r"), "i")
        cols = self.layout.places.select(F.col("block").alias("bj"), F.col("at").alias("c"), F.col("i").alias("j"))
        value = C.make(F.col("re"), F.col("im")) if wide else F.col("re")
        return cells.join(rows.hint("merge"), ["bi", "r"]).join(cols.hint("merge"), ["bj", "c"]).select("part", "i", "j", value.alias("v"))

    def worst_gap(self, a: DataFrame) -> DataFrame:
        """``(worst)``: the greatest size of an entry of L U - A, multiplied block by block and summed where blocks meet."""
        arith, every = Values(self.dtype), self.blocks()
        pairs = _fans(every.filter("li >= lj"), True).join(_fans(every.filter("li <= lj"), False).hint("merge"), F.col("k") == F.col("uk"))
        made = pairs.select("k", "n", "lows", "ups").mapInArrow(_products(arith), PIECE).withColumn("own", F.lit(False))
        pieces = made.unionByName(_packed(_entries(a, self.layout), self.dtype).withColumn("own", F.lit(True)))
        found = pieces.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_worst(arith), "bi long, bj long, worst double")
        return found.agg(F.max("worst").alias("worst"))

    def solve(self, b: DataFrame, trans: bool = False, lower: bool = True, upper: bool = True) -> DataFrame:
        """X of L U X = B for ``b(i, k, x)``, or with one factor only; missing rows of B are zeros."""
        if trans:
            raise ValueError("block factors solve the system itself; factor the transposed matrix for the other")
        return _solved(self, b, lower, upper)


def _due(scratch: Scratch, path: str) -> DataFrame | None:
    """What is written under a pattern of folders, if anything."""
    system, target = _file_system(scratch.spark, path)
    found = system.globStatus(target)
    names = [found[k].getPath().toString() for k in range(len(found))] if found is not None else []
    return scratch.spark.read.option("basePath", path.split("/level=")[0].split("/round=")[0]).parquet(*names) if names else None


def _gone(scratch: Scratch, path: str) -> None:
    """Delete what is written under a pattern of folders."""
    system, target = _file_system(scratch.spark, path)
    found = system.globStatus(target)
    for k in range(len(found) if found is not None else 0):
        system.delete(found[k].getPath(), True)


def factorize_blocks(a: DataFrame, n: int, layout: Layout, arith=None) -> BlockFactor:
    """LU of ``a`` by levels of ``layout``. Missing diagonal blocks count as zero blocks; entries at one place are summed.

    ``info`` is 1 + the position of a zero pivot; then solves give infinities. n = 0 gives empty factors.
    """
    spark = a.sparkSession
    arith = arith or Values("complex128" if C.is_complex(a, "v") else "float64")
    scratch = Scratch(spark)
    path = scratch.path
    own = _packed(_entries(a, layout), arith.dtype).withColumn("own", F.lit(True))
    each = layout.places.groupBy("block").agg(F.first("n").alias("n"), F.first("level").alias("level"))
    empty = F.lit(b"s")
    zero = each.select(F.col("block").alias("bi"), F.col("block").alias("bj"), F.col("n").alias("ni"), F.col("n").alias("nj"), F.col("level").alias("li"), F.col("level").alias("lj"), empty.alias("data"), F.lit(arith.own_only is False).alias("own"))
    given = own.unionByName(zero) if not arith.own_only else own
    given.withColumn("level", F.least("li", "lj")).write.partitionBy("level").parquet(f"{path}/pieces/round=0")
    tiny, info, largest = 0, 0, 0
    for level in range(layout.levels):
        pieces = _due(scratch, f"{path}/pieces/round=*/level={level}")
        if pieces is None:
            continue
        pieces = pieces.select("bi", "bj", "ni", "nj", "li", "lj", "data", "own")
        done = pieces.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_finished(arith), f"{PIECE}, tiny int, info int")
        done = scratch.keep(done, f"due{level}")
        counted = done.agg(F.sum("tiny").alias("tiny"), F.min(F.when(F.col("info") > 0, F.col("info"))).alias("info"), F.sum(F.when(F.col("bi") != F.col("bj"), 1)).alias("panels")).first()
        tiny += counted["tiny"] or 0
        info = info or counted["info"] or 0
        diag = done.filter("bi = bj")
        diag.select(*_PIECE.names).write.parquet(f"{path}/diag/level={level}")
        if not counted["panels"]:
            continue
        pivot = F.when(F.col("lj") < F.col("li"), F.col("bj")).otherwise(F.col("bi"))
        own_diag = diag.select(F.col("bi").alias("k"), F.col("data").alias("diag"))
        panels = done.filter("bi != bj").withColumn("k", pivot).join(own_diag.hint("merge"), "k").select(*_PIECE.names, "diag")
        far = F.greatest("li", "lj")
        panels.mapInArrow(_panels(arith), PIECE).withColumn("side", F.when(F.col("li") > F.col("lj"), "L").otherwise("U")).withColumn("far", far).write.partitionBy("side", "far").parquet(f"{path}/panels/level={level}")
        written = spark.read.parquet(f"{path}/panels/level={level}")
        lows, ups = _fans(written.filter("side = 'L'"), True), _fans(written.filter("side = 'U'"), False)
        pairs = lows.join(ups.hint("merge"), F.col("k") == F.col("uk"))
        out = pairs.select("n", "lows", "ups").mapInArrow(_updates(arith), PIECE).withColumn("own", F.lit(False)).withColumn("level", F.least("li", "lj"))
        out.write.partitionBy("level").parquet(f"{path}/pieces/round={level + 1}")
        most = pairs.agg(F.max(F.col("bytes") + F.col("more"))).first()[0]
        largest = max(largest, most or 0)
        scratch.drop(done)
        _gone(scratch, f"{path}/pieces/round=*/level={level}")
    return BlockFactor(n, layout, path, scratch, arith.dtype, tiny, info, largest)


def triangle_factor(t: DataFrame, n: int, layout: Layout, lower: bool) -> BlockFactor:
    """A triangle as written blocks to solve with: a lower one counts as unit lower, an upper one with its own diagonal."""
    scratch = Scratch(t.sparkSession)
    dtype = "complex128" if C.is_complex(t, "v") else "float64"
    own = scratch.keep(_packed(_entries(t, layout), dtype), "blocks")
    each = layout.places.groupBy("block").agg(F.first("n").alias("n"), F.first("level").alias("level"))
    diag = each.join(own.filter("bi = bj").select(F.col("bi").alias("block"), "data").hint("merge"), "block", "left")
    b, n_, level = F.col("block"), F.col("n"), F.col("level")
    diag = diag.select(b.alias("bi"), b.alias("bj"), n_.alias("ni"), n_.alias("nj"), level.alias("li"), level.alias("lj"), F.coalesce("data", F.lit(b"s")).alias("data"), level.alias("level"))
    diag.write.partitionBy("level").parquet(f"{scratch.path}/diag")
    side, far = F.lit("L" if lower else "U").alias("side"), F.greatest("li", "lj").alias("far")
    panels = own.filter("bi != bj").select(*_PIECE.names, side, far, F.least("li", "lj").alias("level"))
    panels.write.partitionBy("level", "side", "far").parquet(f"{scratch.path}/panels")
    return BlockFactor(n, layout, scratch.path, scratch, dtype, 0, 0, 0)


# --- solves ---------------------------------------------------------------------------------------------------------

VECTOR = "b long, n int, level int, data binary"
_VECTOR = pa.schema([("b", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("data", pa.binary())])


def _sides(f: BlockFactor, b: DataFrame, ks: list, dtype: str) -> DataFrame:
    """Right-hand sides as pieces by block."""
    wide = C.is_complex(b, "x")
    x = C.widen(F.col("x"), wide)
    at_k = {k: p for p, k in enumerate(ks)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            frame = batch.to_pandas()
            for block, part in frame.groupby("block", sort=True):
                head = (int(block), int(part["n"].iloc[0]), int(part["level"].iloc[0]))
                if head != now:
                    if now is not None:
                        yield _batch([(*now, total.tobytes())], _VECTOR)
                    now, total = head, np.zeros((head[1], len(ks)), dtype)
                v = part["re"].to_numpy(float) + 1j * part["im"].to_numpy(float) if np.dtype(dtype).kind == "c" else part["re"].to_numpy(float)
                np.add.at(total, (part["at"].to_numpy(), part["k"].map(at_k).to_numpy()), v)
        if now is not None:
            yield _batch([(*now, total.tobytes())], _VECTOR)

    rows = b.select("i", "k", x["re"].alias("re"), x["im"].alias("im")).join(f.layout.places.hint("merge"), "i")
    return rows.select("block", "n", "level", "at", "k", "re", "im").repartition("block").sortWithinPartitions("block").mapInArrow(work, VECTOR)


def _steps(dtype: str, width: int, way: str) -> Callable:
    """Sums a block's pieces, sorted by block, and solves with its diagonal block (in the row that holds ``diag``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = total = diag = None

        def done() -> pa.RecordBatch:
            if way != "none":
                lu, _ = unpack(diag, (now[1], now[1]), dtype)
                with np.errstate(all="ignore"):
                    (K.lower_solve if way == "lower" else K.upper_solve)(lu, total)
            return _batch([(*now, total.tobytes())], _VECTOR)

        for r in _rows(batches):
            head = (r["b"], r["n"], r["level"])
            if head != now:
                if now is not None:
                    yield done()
                now, total, diag = head, np.zeros((r["n"], width), dtype), None
            if r["diag"] is not None:
                diag = r["diag"]
            if r["data"]:
                total += np.frombuffer(r["data"], dtype).reshape(r["n"], width)
        if now is not None:
            yield done()

    return work


def _sent(dtype: str, width: int) -> Callable:
    """What a solved block takes from another: minus the panel times it; sums of one block are joined within the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for r in _rows(batches):
            panel, _ = unpack(r["panel"], (r["n"], r["m"]), dtype)
            x = np.frombuffer(r["data"], dtype).reshape(r["m"], width)
            head = (r["b"], r["n"], r["level"])
            with np.errstate(all="ignore"):
                got = panel @ x
            held[head] = held[head] - got if head in held else -got
            if len(held) >= HELD * 16:
                yield _batch([(*k, v.tobytes()) for k, v in held.items()], _VECTOR)
                held.clear()
        if held:
            yield _batch([(*k, v.tobytes()) for k, v in held.items()], _VECTOR)

    return work


def _solved(f: BlockFactor, b: DataFrame, lower: bool, upper: bool) -> DataFrame:
    spark, places = b.sparkSession, f.layout.places
    scratch = Scratch(spark)
    ks = sorted(r.k for r in b.select("k").distinct().collect())  # right-hand sides, not rows
    wide = C.is_complex(b, "x") or np.dtype(f.dtype).kind == "c"
    if not ks or not f.n:
        return b.limit(0).select("i", "k", C.widen(F.col("x"), C.is_complex(b, "x")).alias("x") if wide else "x")
    if wide and np.dtype(f.dtype).kind != "c":  # real factors, complex sides: two real solves
        part = lambda p: _solved(f, b.select("i", "k", F.col(f"x.{p}").alias("x")), lower, upper).withColumnRenamed("x", p)
        return part("re").join(part("im"), ["i", "k"]).select("i", "k", C.make(F.col("re"), F.col("im")).alias("x"))
    width, none = len(ks), F.lit(None).cast("binary")
    _sides(f, b, ks, f.dtype).write.partitionBy("level").parquet(f"{scratch.path}/down/round=0")
    state = "down"
    for state in [s for s, wanted in (("down", lower), ("up", upper)) if wanted]:
        down = state == "down"
        levels = range(f.layout.levels) if down else range(f.layout.levels - 1, -1, -1)
        if not down and lower:  # results of the way down are what is due on the way up
            _due(scratch, f"{scratch.path}/solved-down/level=*").write.partitionBy("level").parquet(f"{scratch.path}/up/round=0")
        elif not down:
            _due(scratch, f"{scratch.path}/down/round=0/level=*").write.partitionBy("level").parquet(f"{scratch.path}/up/round=0")
        for step, level in enumerate(levels):
            diag = f._read("diag", level)
            if diag is None:
                continue
            rows = diag.select(F.col("bi").alias("b"), F.col("ni").alias("n"), F.lit(level).alias("level"), F.lit(None).cast("binary").alias("data"), F.col("data").alias("diag"))
            pieces = _due(scratch, f"{scratch.path}/{state}/round=*/level={level}")
            if pieces is not None:
                rows = rows.unionByName(pieces.select("b", "n", F.lit(level).alias("level"), "data", none.alias("diag")))
            rows.repartition("b").sortWithinPartitions("b").mapInArrow(_steps(f.dtype, width, "lower" if down else "upper"), VECTOR).drop("level").write.parquet(f"{scratch.path}/solved-{state}/level={level}")
            x = spark.read.parquet(f"{scratch.path}/solved-{state}/level={level}")
            panels = _due(f.scratch, f"{f.path}/panels/level={level if down else '*'}")
            if panels is None:
                continue
            panels = panels.filter(F.col("side") == ("L" if down else "U"))
            if not down:
                panels = panels.filter(F.col("far") == level)
            panels = panels.select(F.col("bi").alias("b"), F.col("ni").alias("n"), F.col("nj").alias("m"), F.col("li").alias("level"), F.col("data").alias("panel"), F.col("bj").alias("from"))
            sent = panels.join(x.select(F.col("b").alias("from"), "data").hint("merge"), "from").select("b", "n", "m", "level", "panel", "data")
            sent.mapInArrow(_sent(f.dtype, width), VECTOR).write.partitionBy("level").parquet(f"{scratch.path}/{state}/round={step + 1}")
    solved = _due(scratch, f"{scratch.path}/solved-{state}/level=*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            x = np.frombuffer(r["data"], f_dtype).reshape(r["n"], width)
            at, k = np.repeat(np.arange(r["n"]), width), np.tile(np.array(ks), r["n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["b"])), pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(np.real(x).ravel().astype(float)), pa.array(np.imag(x).ravel().astype(float))], ["block", "at", "k", "re", "im"])

    f_dtype = f.dtype
    cells = solved.select("b", "n", "data").mapInArrow(work, "block long, at int, k int, re double, im double")
    out = cells.join(places.select("i", "block", "at").hint("merge"), ["block", "at"])
    return out.select("i", "k", (C.make(F.col("re"), F.col("im")) if wide else F.col("re")).alias("x"))
