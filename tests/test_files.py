"""Line formats: sizes of headers are held against what is read; right sides of files that are read in parts."""

from __future__ import annotations

import pytest

from lattica.sources import files


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ("3 3 2\n1 1 5.0\n3 2 1d1\n", None),
        ("3 3 2\n0 0 5.0\n2 2 1.0\n", None),
        ("2 2 0\n", None),
        ("3 3 3\n1 1 5.0\n3 2 1.0\n", "announced"),
        ("3 3 1\n1 1 5.0\n3 2 1.0\n", "announced"),
        ("3 3 2\n1 1 5.0\n4 2 1.0\n", "range"),
        ("3 3 2\n1 1 5.0\n2 2\n", "read"),
        ("3 2\n1 1 5.0\n2 2 1.0\n", "sizes"),
        ("", "sizes"),
    ],
)
@pytest.mark.parametrize("market", [False, True])
def test_sizes_are_checked(spark, tmp_path, text, fault, market):
    path = tmp_path / "m.txt"
    path.write_text(("%%MatrixMarket matrix coordinate real general\n% note\n" if market else "") + text)
    read = files.read_matrix_market if market else files.read_triplets
    if fault:
        with pytest.raises(ValueError, match=fault):
            read(spark, str(path))
    else:
        got = sorted((r.i, r.j, r.v) for r in read(spark, str(path)).collect())
        assert got == {"3 3 2\n1": [(0, 0, 5.0), (2, 1, 10.0)], "3 3 2\n0": [(0, 0, 5.0), (2, 2, 1.0)], "2 2 0\n": []}[text[:7]]


def test_right_side_in_parts(spark, tmp_path):
    values = [k * 0.5 - 40 for k in range(700)]
    lines, at = [], 0
    while at < len(values):
        step = at % 4
        lines.append("  ".join(str(x) for x in values[at : at + step]))  # some lines are empty
        lines.append(str(values[at + step]) if at + step < len(values) else "")
        at += step + 1
    (tmp_path / "b.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = files.read_rhs(spark, str(tmp_path / "b.txt"))
        rows = sorted((r.i, r.k, r.x) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert rows == [(k, 0, x) for k, x in enumerate(values)]


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of 256 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(x) for x in names]
    for name, value in zip(names, ("256", "0"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def cards(kind, ptr, ind, values, sides=0):
    lines = ["title", "".join(f"{x:14d}" for x in (0, 0, 0, 0, sides)), kind.ljust(14) + "".join(f"{x:14d}" for x in (len(ptr) - 1, len(ptr) - 1, len(ind), 0)), "(7I6)".ljust(16) + "(10I6)".ljust(16) + "(1P,3D22.12)"]
    lines += ["sides"] * (sides > 0)
    for xs, per, width in ((ptr, 7, 6), (ind, 10, 6), (values, 3, 22)):
        lines += ["".join(str(x).rjust(width) for x in xs[k : k + per]) for k in range(0, len(xs), per)]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("kind", ["RUA", "rsa", "RZA", "CUA", "CHA"])
def test_boeing_files_in_parts_without_python(spark, tmp_path, small_parts, kind):
    n = 40
    counts = [k % 4 if k % 3 else 0 for k in range(n)]
    ptr = [1 + sum(counts[:k]) for k in range(n + 1)]
    ind = [j + 1 - k if kind[1] in "Uu" else min(n, j + 1 + k) for j in range(n) for k in range(counts[j])]
    values = [f"{k - 30}.25D+01" if k % 2 else f"{k}.5-102" for k in range(len(ind) * (2 if kind[0] == "C" else 1))]
    text = cards(kind, ptr, ind, values, sides=1)
    (tmp_path / "a.rua").write_text(text)
    got = files.read_matrix(spark, str(tmp_path / "a.rua"), kind[0] == "C")
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "InPandas" not in plan
    want = sorted((i, j, complex(v)) for i, j, v in files.decode_cards(text, False)[1])
    assert sorted(((r.i, r.j, complex(r.v.re, r.v.im) if kind[0] == "C" else complex(r.v)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_broken_boeing_files_are_refused(spark, tmp_path):
    for name, text, fault in (("cut", cards("RUA", [1, 2, 3], [1, 2], [1.0]).rsplit("\n", 2)[0], "short"), ("starts", cards("RUA", [1, 2, 2], [1, 2], [1.0, 2.0]), "cover")):
        (tmp_path / f"{name}.rua").write_text(text)
        with pytest.raises(ValueError, match=fault):
            files.read_matrix(spark, str(tmp_path / f"{name}.rua"))
