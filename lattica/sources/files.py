"""Matrix files in and out.

Line formats and fixed-column formats are read line by line on the executors, the latter's numbers joined by their
places; the binary form is one object a file and decoded whole, file by file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattica.functions import complexnum as C
from lattica.plans.scratch import Scratch
from lattica.sources.tables import MATRIX, pointers

COMPLEX = "i long, j long, v struct<re:double,im:double>"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    return lines.withColumn("f", F.split("line", r"\s+"))


def _zero_based(cells: DataFrame, size: tuple[int, int, int] | None = None) -> DataFrame:
    """Indices that never reach 0 are taken as 1-based; with the header's ``size`` (rows, columns, entries) all are held
    against it in the same pass. Entries that can't be read raise ValueError."""
    found = cells.agg(F.min("i"), F.min("j"), F.max("i"), F.max("j"), F.count(F.lit(1)), F.count_if(F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull())).first()
    rows, cols, most_rows, most_cols, entries, broken = found
    shift = 1 if rows is not None and cols is not None and min(rows, cols) >= 1 else 0
    if broken:
        raise ValueError("an entry can't be read")
    if size is not None:
        if entries != size[2]:
            raise ValueError(f"{size[2]} entries are announced, {entries} are there")
        if entries and (min(rows, cols) < 0 or most_rows - shift >= size[0] or most_cols - shift >= size[1]):
            raise ValueError("an index is out of range")
    return cells.withColumn("i", F.col("i") - shift).withColumn("j", F.col("j") - shift)


def _cells(rows: DataFrame, kind: str = "real") -> DataFrame:
    """What can't be read becomes null; ``_zero_based`` refuses it."""
    number = lambda n: F.regexp_replace(F.get("f", F.lit(n)), "[dD]", "e").try_cast("double")
    index = lambda n: F.get("f", F.lit(n)).try_cast("long")
    pair = F.when(number(2).isNotNull() & number(3).isNotNull(), F.struct(number(2).alias("re"), number(3).alias("im")))
    return rows.select(index(0).alias("i"), index(1).alias("j"), (pair if kind == "complex" else number(2)).alias("v"))


def _header(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, columns and entries of the first line."""
    first = rows.orderBy("at").first()
    words = first["f"] if first else []
    if len(words) != 3 or not all(w.isdecimal() for w in words):
        raise ValueError("the line of sizes must hold rows, columns and entries")
    return int(words[0]), int(words[1]), int(words[2])


def read_matrix_market(spark: SparkSession, path: str, complex_values: bool = False) -> DataFrame:
    """Coordinate files, real or complex, general, symmetric or hermitian (expanded); square only.

    Pattern files and complex values where real ones are asked raise ValueError.
    """
    head = spark.read.text(path).limit(1).first()
    words = (head["value"] if head else "").lower().split()
    if len(words) < 5 or words[0] != "%%matrixmarket" or words[1:3] != ["matrix", "coordinate"]:
        raise ValueError("not a Matrix Market coordinate file")
    kind, symmetry = words[3], words[4]
    if kind != ("complex" if complex_values else "real"):
        raise ValueError(f"values of type {kind} are not read here")
    if symmetry not in ("general", "symmetric", "hermitian"):
        raise ValueError(f"symmetry {symmetry} is not read here")
    rows = _fields(spark, path).filter("line != '' and not startswith(line, '%')")
    size = _header(rows)
    if size[0] != size[1]:
        raise ValueError("the matrix is not square")
    first = rows.agg(F.min("at")).first()[0]
    cells = _zero_based(_cells(rows.filter(F.col("at") != first), kind), size)
    if symmetry != "general":
        flip = F.struct(F.col("v.re"), (-F.col("v.im")).alias("im")) if symmetry == "hermitian" and kind == "complex" else F.col("v")
        cells = cells.unionByName(cells.filter("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), flip.alias("v")))
    return cells


def read_unit_lower(spark: SparkSession, path: str) -> DataFrame:
    """Lower triangle of a Matrix Market file, its stored diagonal set to 1."""
    return unit_lower(read_matrix_market(spark, path))


def unit_lower(matrix: DataFrame) -> DataFrame:
    return matrix.filter("i >= j").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v")).alias("v"))


def read_triplets(spark: SparkSession, path: str, header: bool = True, complex_values: bool = False) -> DataFrame:
    """Lines ``i j v``, after a line ``m n nnz`` if ``header``; 0- or 1-based by the least index.

    With a header, a missing or unreadable entry or an index beyond the sizes raises ValueError.
    """
    rows = _fields(spark, path).filter("line != ''")
    size = _header(rows) if header else None
    if header:
        first = rows.agg(F.min("at")).first()[0]
        rows = rows.filter(F.col("at") != first)
    return _zero_based(_cells(rows, "complex" if complex_values else "real"), size)


def read_rhs(spark: SparkSession, path: str) -> DataFrame:
    """Values between white space in the order of the file (files by name), as right-hand side 0.

    Parts of a file are read side by side; their counts say where each part's values begin.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.explode(F.split("value", r"\s+")).alias("x"))
    values = lines.filter("x != ''").withColumn("at", F.monotonically_increasing_id())
    parts = values.groupBy("file", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"))
    before = F.sum("rows").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    starts = parts.select("file", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("start"))
    number = F.regexp_replace("x", "[dD]", "e").cast("double")
    return values.join(starts, ["file", "part"]).select((F.col("at") + F.col("start")).alias("i"), F.lit(0).alias("k"), number.alias("x"))


def _layout(spec: str) -> tuple[int, int]:
    """Numbers a line and characters a number of a Fortran format like (1P,4E20.12) or (10I8)."""
    m = re.search(r"(\d*)\s*[IEFDG](\d+)", re.sub(r"\d*P,?", "", spec.upper()))
    if not m:
        raise ValueError(f"format {spec!r} is not understood")
    return int(m[1] or 1), int(m[2])


def _card_numbers(lines: list[str], count: int, spec: str) -> tuple[list[str], list[str]]:
    """``count`` fixed-width fields from the front of ``lines``, and the lines left."""
    per, width = _layout(spec)
    out: list[str] = []
    used = -(-count // per)
    for line in lines[:used]:
        take = min(per, count - len(out))
        out += [line[k * width : (k + 1) * width].strip() for k in range(take)]
    return out, lines[used:]


def _card_header(lines: list[str], rutherford: bool) -> tuple[str, int, int, int, list[str]]:
    """Kind, order, entries, lines of the header and the formats of starts, rows and values."""
    if len(lines) < 4:
        raise ValueError("the header is cut short")
    right_sides = 0 if rutherford else int(lines[1][56:70].strip() or 0)
    kind = lines[2][:3].upper()
    nrow, ncol, nnz = (int(x) for x in lines[2][3:].split()[:3])
    formats = re.findall(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", lines[3])
    if kind[2] != "A" or nrow != ncol:
        raise ValueError("only assembled square matrices are read")
    if kind[0] == "P":
        raise ValueError("pattern matrices are not read")
    return kind, ncol, nnz, 5 if right_sides else 4, formats


def decode_cards(text: str, rutherford: bool) -> tuple[int, list[tuple[int, int, complex]]]:
    """Order and 0-based cells of the text of a small Harwell-Boeing or Rutherford-Boeing file; symmetric ones are expanded."""
    lines = text.splitlines()
    kind, ncol, nnz, head, formats = _card_header(lines, rutherford)
    ptr, body = _card_numbers(lines[head:], ncol + 1, formats[0])
    ind, body = _card_numbers(body, nnz, formats[1])
    cells = []
    raw, _ = _card_numbers(body, nnz * (2 if kind[0] == "C" else 1), formats[2])
    num = [float(re.sub(r"(?<=\d|\.)([+-]\d+)$", r"e\1", x.lower().replace("d", "e")) if "e" not in x.lower() and "d" not in x.lower() else x.lower().replace("d", "e")) for x in raw]
    values = [complex(num[2 * p], num[2 * p + 1]) for p in range(nnz)] if kind[0] == "C" else num
    starts = [int(x) - 1 for x in ptr]
    for j in range(ncol):
        for p in range(starts[j], starts[j + 1]):
            i = int(ind[p]) - 1
            cells.append((i, j, values[p]))
            if kind[1] in "SHZ" and i != j:
                mirror = values[p]
                if kind[1] == "H":
                    mirror = mirror.conjugate()
                elif kind[1] == "Z":
                    mirror = -mirror
                cells.append((j, i, mirror))
    return ncol, cells


def _boeing_lines(matrix: DataFrame, n: int, rutherford: bool) -> DataFrame:
    """``(section, line, value)`` of a real, assembled, unsymmetric file: places are counted by ranges, a line is a group of them."""
    spark = matrix.sparkSession
    scratch = Scratch(spark)
    a = scratch.keep(matrix.select("i", "j", "v"), "cells")
    ranged = a.repartitionByRange("j", "i").sortWithinPartitions("j", "i").select("i", "v", F.monotonically_increasing_id().alias("at"))
    ranged = scratch.keep(ranged, "ranged").withColumn("piece", F.shiftright("at", 33))
    pieces = ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = pieces.select("piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    cells = ranged.join(starts, "piece").select("i", "v", (F.col("start") + F.col("at") - F.shiftleft("piece", 33)).alias("at"))
    nnz = a.count()
    end = spark.range(1).select(F.lit(n).cast("long").alias("at"), F.lit(nnz).cast("long").alias("start"))
    ptr = pointers(a, "j", n).select(F.col("p").alias("at"), "start").unionByName(end)

    def cards(section: int, numbers: DataFrame, form: str, per: int) -> DataFrame:
        words = F.array_sort(F.collect_list(F.struct("at", F.format_string(form, "x").alias("word"))))
        lines = numbers.groupBy(F.expr(f"at div {per}").alias("line")).agg(words.alias("w"))
        return lines.select(F.lit(section).alias("section"), "line", F.array_join(F.col("w.word"), "").alias("value"))

    counts = [-(-(n + 1) // 5), -(-nnz // 5), -(-nnz // 3)]
    title = ["matrix".ljust(72) + "key".ljust(8), "".join(f"{x:14d}" for x in [sum(counts), *counts] + ([] if rutherford else [0]))]
    title += [("rua" if rutherford else "RUA") + " " * 11 + "".join(f"{x:14d}" for x in (n, n, nnz, 0)), f"{'(5I14)':16}{'(5I14)':16}{'(3E25.16)':20}"]
    out = spark.createDataFrame([(0, k, x) for k, x in enumerate(title)], "section int, line long, value string")
    out = out.unionByName(cards(1, ptr.select("at", (F.col("start") + 1).alias("x")), "%14d", 5))
    out = out.unionByName(cards(2, cells.select("at", (F.col("i") + 1).alias("x")), "%14d", 5))
    return out.unionByName(cards(3, cells.select("at", F.col("v").cast("double").alias("x")), "%25.16E", 3))


def write_rhs(b: DataFrame, path: str) -> None:
    """The values of ``b(i, x)`` by index, one a line, in one file."""
    b.repartition(1).sortWithinPartitions("i").select(F.col("x").cast("string")).write.text(path)


def read_boeing(spark: SparkSession, path: str, rutherford: bool = False, complex_values: bool = False) -> DataFrame:
    """A Harwell-Boeing (or Rutherford-Boeing) file, or all of a folder; files are read in parts, their numbers joined by place.

    A file with too few lines or with column starts that do not cover its entries raises ValueError, a number that can't be read fails the query.
    """
    scratch = Scratch(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    parts = scratch.keep(lines.groupBy("file", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low")), "parts")
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("file", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("start"))
    numbered = lines.join(starts, ["file", "part"]).select("file", (F.col("at") + F.col("start")).alias("line"), "value")
    heads: dict[str, list[str]] = {}
    for r in numbered.filter("line < 4").orderBy("file", "line").collect():  # four lines a file
        heads.setdefault(r.file, []).append(r.value)
    length = {r.file: r.rows for r in parts.groupBy("file").agg(F.sum("rows").alias("rows")).collect()}
    sections, kinds = [], []
    for f, (file, head) in enumerate(sorted(heads.items())):
        kind, n, nnz, low, formats = _card_header(head, rutherford)
        kinds.append((f, n, nnz, kind[0] == "C", kind[1]))
        for section, count in enumerate((n + 1, nnz, nnz * (2 if kind[0] == "C" else 1))):
            per, width = _layout(formats[section])
            sections.append((file, f, section, low, low + -(-count // per), count, per, width))
            low += -(-count // per)
        if low > length[file]:
            raise ValueError("the file is cut short")
    if not kinds:
        return spark.createDataFrame([], COMPLEX if complex_values else MATRIX)
    sections = F.broadcast(spark.createDataFrame(sections, "file string, f int, section int, low long, high long, count long, per int, width int"))
    kinds = F.broadcast(spark.createDataFrame(kinds, "f int, n long, nnz long, wide boolean, symmetry string"))
    found = numbered.join(sections, "file").filter("line >= low and line < high")
    words = F.posexplode(F.expr("transform(sequence(0, per - 1), k -> trim(substring(value, k * width + 1, width)))")).alias("k", "word")
    found = found.select("f", "section", "count", ((F.col("line") - F.col("low")) * F.col("per")).alias("at"), words)
    found = scratch.keep(found.select("f", "section", "count", (F.col("at") + F.col("k")).alias("at"), "word").filter("at < count").drop("count"), "numbers")
    ptr = found.filter("section = 0").select("f", F.col("at").alias("j"), (F.col("word").cast("long") - 1).alias("first"))
    columns = ptr.join(kinds, "f").filter("j < n").join(ptr.select("f", (F.col("j") - 1).alias("j"), F.col("first").alias("end")), ["f", "j"])
    columns = scratch.keep(columns.select("f", "j", "first", "end", "n", "nnz"), "columns")
    if not columns.filter("first is null or end is null or end < first or (j = 0 and first != 0) or (j = n - 1 and end != nnz)").isEmpty():
        raise ValueError("the starts of the columns do not cover the entries")
    columns = columns.filter("end > first").select("f", "j", F.explode(F.sequence("first", F.col("end") - 1)).alias("at"))
    rows = found.filter("section = 1").select("f", "at", (F.col("word").cast("long") - 1).alias("i"))
    word = F.regexp_replace(F.lower("word"), "d", "e")
    word = F.when(F.contains(word, F.lit("e")), word).otherwise(F.regexp_replace(word, r"(?<=[0-9.])([+-][0-9]+)$", "e$1"))
    values = found.filter("section = 2").select("f", "at", word.cast("double").alias("x")).join(kinds, "f")
    one = F.expr("case when wide then at div 2 else at end")
    if complex_values:
        second = F.col("wide") & (F.col("at") % 2 == 1)
        values = values.groupBy("f", one.alias("at"), "wide", "symmetry").agg(F.sum(F.when(~second, F.col("x"))).alias("re"), F.coalesce(F.sum(F.when(second, F.col("x"))), F.lit(0.0)).alias("im"))
    else:
        values = values.filter("not wide or at % 2 = 0").select("f", one.alias("at"), F.col("x").alias("re"), F.lit(0.0).alias("im"), "symmetry")
    cells = columns.join(rows, ["f", "at"]).join(values, ["f", "at"])
    own = lambda i, j, re, im: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.struct(re.alias("re"), im.alias("im")) if complex_values else re).alias("v"))
    re, im, symmetry = F.col("re"), F.col("im"), F.col("symmetry")
    mirror = own("j", "i", F.when(symmetry == "Z", -re).otherwise(re), F.when(symmetry.isin("Z", "H"), -im).otherwise(im))
    both = F.when(symmetry.isin("S", "H", "Z") & (F.col("i") != F.col("j")), F.array(own("i", "j", re, im), mirror)).otherwise(F.array(own("i", "j", re, im)))
    return cells.select(F.inline(both))


def encode_binary(n: int, colptr: np.ndarray, rowind: np.ndarray, values: np.ndarray) -> bytes:
    """n, nnz, column starts, row indices (int64), values (double), little-endian."""
    head = struct.pack("<qq", n, len(values))
    return head + np.asarray(colptr, "<i8").tobytes() + np.asarray(rowind, "<i8").tobytes() + np.asarray(values, "<f8").tobytes()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                n, nnz = struct.unpack_from("<qq", raw)
                ptr = np.frombuffer(raw, "<i8", n + 1, 16)
                ind = np.frombuffer(raw, "<i8", nnz, 16 + 8 * (n + 1))
                val = np.frombuffer(raw, "<f8", nnz, 16 + 8 * (n + 1 + nnz))
                yield pd.DataFrame({"i": ind, "j": np.repeat(np.arange(n), np.diff(ptr)), "v": val})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, MATRIX)


def read_matrix(spark: SparkSession, path: str, complex_values: bool = False) -> DataFrame:
    """Choose the reader by the file's suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("mtx", "mm"):
        return read_matrix_market(spark, path, complex_values)
    if suffix in ("rua", "cua", "rsa", "csa", "hb"):
        return read_boeing(spark, path, False, complex_values)
    if suffix == "rb":
        return read_boeing(spark, path, True, complex_values)
    if suffix in ("dat", "datnh"):
        return read_triplets(spark, path, suffix == "dat", complex_values)
    if suffix == "bin":
        return read_binary(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def write_matrix(matrix: DataFrame, path: str, kind: str = "parquet", n: int | None = None) -> None:
    """Parquet, text lines ``i j v`` in column order ("triplets"), or one file of an n by n matrix: Matrix Market ("market"),
    1-based triplets after a line of sizes ("sized_triplets"), real Harwell-Boeing ("boeing") or Rutherford-Boeing ("rutherford").

    A header must come first, so one task writes such a file; sorting spills to disk.
    """
    wide = C.is_complex(matrix, "v")
    values = [F.col("v.re").cast("string"), F.col("v.im").cast("string")] if wide else [F.col("v").cast("string")]
    if kind == "parquet":
        matrix.write.parquet(path)
    elif kind == "triplets":
        ordered = matrix.repartitionByRange("j", "i").sortWithinPartitions("j", "i")
        ordered.select(F.concat_ws(" ", "i", "j", *values)).write.text(path)
    elif kind in ("boeing", "rutherford"):
        if n is None or wide:
            raise ValueError("a Boeing file needs the order n and real values")
        every = _boeing_lines(matrix, n, kind == "rutherford").repartition(1).sortWithinPartitions("section", "line")
        every.select("value").write.text(path)
    elif kind in ("market", "sized_triplets"):
        if n is None:
            raise ValueError("a file with a header needs the order n")
        spark = matrix.sparkSession
        title = f"%%MatrixMarket matrix coordinate {'complex' if wide else 'real'} general"
        head = spark.createDataFrame([(-2, title)], "j long, value string").withColumn("i", F.lit(0).cast("long"))
        size = matrix.agg(F.concat(F.lit(f"{n} {n} "), F.count(F.lit(1)).cast("string")).alias("value")).select(F.lit(-1).cast("long").alias("j"), "value", F.lit(0).cast("long").alias("i"))
        lines = matrix.select("j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *values).alias("value"), "i")
        every = (head if kind == "market" else head.limit(0)).unionByName(size).unionByName(lines).repartition(1).sortWithinPartitions("j", "i")
        every.select("value").write.text(path)
    else:
        raise ValueError(f"no writer for {kind}")
