"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def plain_siblings(levels: list[list[str]], at: int) -> str:
    out = ""
    for level in levels[:-1]:
        if at ^ 1 < len(level):
            out += level[at ^ 1]
        at //= 2
    return out


def plain(rows: list[tuple]) -> dict:
    """(order, leaf) -> subroot, root and siblings of rows (group, order, leaf)."""
    groups: dict = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    out: dict = {}
    for k, g in enumerate(names):
        for at, (some, o, leaf) in enumerate(sorted(groups[g])):
            out.setdefault((g, o if some else None, leaf), []).append((trees[g][-1][0], top[-1][0], plain_siblings(trees[g], at) + plain_siblings(top, k)))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 5, "b": 64, "é": 65, None: 3, "": 7}, {"big": 4500, "z": 129}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = [(g, (k * 37) % n - 3, H(f"{g}{k}")) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, doc_id long, leaf string, path string").repartition(5)
    out = merkle.manifest(df, "lang", "doc_id", "leaf", ["lang", "doc_id"])
    out = out.select("lang", "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s"), merkle.fold(F.col("leaf"), F.col("path")).alias("f"))
    want = plain(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(r.subroot, r.root, r.s)] == want[r.lang, r.doc_id, r.leaf]
        assert r.f == r.root


def test_null_and_repeated_orders(spark):
    rows = [("a", None, H("1")), ("a", None, H("0")), ("a", 4, H("2")), ("a", 4, H("2")), ("a", 4, H("9"))]
    out = merkle.manifest(spark.createDataFrame(rows, "g string, o long, leaf string"), "g", "o", "leaf", ["g", "o"])
    got: dict = {}
    for r in out.select("g", "o", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s")).collect():
        got.setdefault((r.g, r.o, r.leaf), []).append((r.subroot, r.root, r.s))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain(rows).items()}


def test_changed_leaf_leads_elsewhere_and_empty_table(spark):
    rows = [("a", k, H(str(k))) for k in range(70)]
    out = merkle.manifest(spark.createDataFrame(rows, "g string, o long, leaf string"), "g", "o", "leaf", ["o"])
    changed = [(g, o, H("other") if o == 69 else leaf) for g, o, leaf in rows]
    r = out.filter("o = 69").select(merkle.fold(F.lit(H("other")), F.col("path")).alias("f"), "root").first()
    assert r.f != r.root and r.f == next(iter(plain(changed).values()))[0][1]
    assert merkle.manifest(spark.createDataFrame([], "g string, o long, leaf string"), "g", "o", "leaf").count() == 0


def test_record_digest(spark):
    row = spark.createDataFrame([(12, None, "é:")], "a long, b string, c string").select(merkle.digest(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert row == H("2:12-3:é:")
