"""Quality rules: counts of each text, and lines that too many documents of a host share.

A word is a run of bytes other than blank and 0x09-0x0D; a line is what stands
between line feeds and counts if it holds a word. Lines are compared normalised:
A-Z lower-cased, digits as 0, white space as one blank, ends trimmed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.columns import fresh
from lattica.llm.textbytes import release, text_array
from lattica.plans.scratch import Scratch

#: A line is common on a host if more than this share of its distinct texts hold it, and more than so many of them.
SHARE, LEAST = 0.05, 10
#: A document with common lines is depleted if they hold more than this share of its words, or leave it fewer words than this.
DEPLETED, LEFT = 0.5, 50
#: Copies of a common line's key in the join, so that a line of many documents is many tasks' work.
SALTS = 16

NORMAL = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
NOT_SPACE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point
FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]
LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, n)
    pair = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:  # three ids don't fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * n + ids[2:]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def normal(line: bytes) -> bytes:
    return b" ".join(line.translate(NORMAL).split())


def _lines(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words of each normalised line by its hash."""
    seen: set[bytes] = set()
    again, held = 0, {}
    for line in text.split(b"\n"):
        words = line.translate(NORMAL).split()
        if not words:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        key = _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))
        held[key] = held.get(key, 0) + len(words)
    return again, held


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_array(batch.column(batch.num_columns - 1))
        ids = [batch.column(k) for k in range(batch.num_columns - 1)]
        counts, prints, lines = [], [], []
        for text in texts:
            text = text.as_py()
            data = np.frombuffer(text, np.uint8)
            words = text.split()
            again, held = _lines(text)
            solid = STARTS & NOT_SPACE
            counts.append((len(words), int(solid[data].sum()), int(SYMBOL[data].sum()), again, repeated_words(words)))
            prints.append(_signed(xxhash.xxh3_64_intdigest(text)))
            lines.append([{"line": k, "words": w} for k, w in held.items()])
        columns = zip(*counts, strict=True) if counts else [()] * len(FIELDS)
        yield pa.RecordBatch.from_arrays(
            [*ids, *[pa.array(c, pa.int64()) for c in columns], pa.array(prints, pa.int64()), pa.array(lines, LINES)], [*batch.schema.names[:-1], *[f for f, _ in FIELDS], "print_", "lines_"]
        )
    release()


def measure(docs: DataFrame, ids: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """``ids`` of every row with its host, counts, a hash of the text (``print_``) and its distinct lines (``lines_``)."""
    clash = {c.lower() for c in ids} & {"host_", "print_", "lines_", *[f for f, _ in FIELDS]}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results")
    given = docs.select(*ids, F.col(host).cast("string").alias("host_"), F.col(text).alias("text_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + [f"{n} {t}" for n, t in FIELDS])
    return given.mapInArrow(_measured, f"{schema}, print_ long, lines_ array<struct<line: long, words: long>>")


def common_lines(measured: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(host_, line, texts, limit)`` of the lines of a host that too many of its distinct texts hold; no host is one, too.

    Copies of one text count once, so a page that is copied a lot does not make its lines common.
    """
    sizes = measured.filter("n_words > 0").groupBy("host_").agg(F.countDistinct("print_").alias("of"))
    held = measured.select("host_", "print_", F.explode("lines_.line").alias("line"))
    held = held.groupBy("host_", "line").agg(F.countDistinct("print_").alias("texts")).filter(F.col("texts") > least)
    limit = F.greatest(F.lit(float(least)), F.col("of") * F.lit(share))
    return held.join(sizes.withColumnRenamed("host_", "of_host"), F.col("host_").eqNullSafe(F.col("of_host"))).withColumn("limit", limit).filter("texts > limit").select("host_", "line", "texts", "limit")


def _depleted(words: Column, common: Column, share: float, left: int) -> Column:
    return (common > 0) & ((common > words * F.lit(share)) | (words - common < left))


def judge(docs: DataFrame, ids: list[str], host: str = "source", text: str = "text", share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED, left: int = LEFT) -> DataFrame:
    """``ids`` of every row with its counts, ``n_common_words`` and ``depleted``.

    ``n_common_words`` are the words of lines that more than ``share`` of the host's distinct
    texts (and more than ``least``) hold; a document is depleted if it has such a line and they hold more than the share ``depleted``
    of its words, or leave fewer than ``left`` words.
    A null text counts as empty and is not depleted; rows without a host form a host of their own;
    repeated rows are judged each, alike; a text of any length is read whole; an empty table gives no rows.
    ``ids`` must not have the names of results; no other column is read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(measure(docs, ids, host, text).withColumn("row_", F.monotonically_increasing_id()), "measured")
    common = scratch.keep(common_lines(rows, share, least), "common")
    common = common.select(F.col("host_").alias("of_host"), F.col("line").alias("of_line"), F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("of_salt"))
    held = rows.select("row_", "host_", F.pmod(F.xxhash64("row_"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("lines_"))
    hit = held.join(common, (F.col("line") == F.col("of_line")) & (F.col("salt") == F.col("of_salt")) & F.col("host_").eqNullSafe(F.col("of_host")))
    lost = scratch.keep(hit.groupBy("row_").agg(F.sum("words").alias("n_common_words")), "lost")
    out = rows.join(lost, "row_", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)))
    out = out.withColumn("depleted", _depleted(F.col("n_words"), F.col("n_common_words"), depleted, left))
    return out.select(*ids, *[f for f, _ in FIELDS], "n_common_words", "depleted")


def without_common_lines(docs: DataFrame, host: str = "source", text: str = "text", share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED, left: int = LEFT) -> DataFrame:
    """``docs`` without depleted rows, and without common lines in the texts that stay; other columns, and texts without a common line, stay as they are.

    Nulls, repeated rows, long texts and empty tables as in ``judge``.
    """
    scratch = Scratch(docs.sparkSession)
    row, gone, told, lines = fresh(docs, "row", "gone", "told", "lines")
    kept = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    rows = scratch.keep(measure(kept, [row], host, text), "measured")
    common = common_lines(rows, share, least).select(F.col("host_").alias("of_host"), F.col("line").alias("of_line"))
    held = rows.select(row, "host_", "n_words", F.inline("lines_"))
    hit = held.join(common, (F.col("line") == F.col("of_line")) & F.col("host_").eqNullSafe(F.col("of_host")))
    hit = hit.groupBy(F.col(row).alias(told)).agg(_depleted(F.first("n_words"), F.sum("words"), depleted, left).alias(gone), F.collect_list("line").alias(lines))
    out = kept.join(hit, F.col(row) == F.col(told), "left").filter(~F.coalesce(F.col(gone), F.lit(False)))

    @F.pandas_udf("string")
    def cut(texts, drop):
        def one(text, hashes):
            if hashes is None or text is None:
                return text
            hashes = set(hashes)
            keep = [x for x in text.encode().split(b"\n") if not x.split() or _signed(xxhash.xxh3_64_intdigest(normal(x))) not in hashes]
            return b"\n".join(keep).decode()

        return texts.combine(drop, one)

    return out.select(*[(F.when(F.col(lines).isNull(), F.col(c)).otherwise(cut(F.col(c), F.col(lines))).alias(c) if c == text else F.col(c)) for c in docs.columns])
