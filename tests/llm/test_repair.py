"""Conversation repair against a search through all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest

from lattica.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """Cheapest edits by best-first search over (cost, audit) with whole audits; at most two insertions in a row."""
    fault = faults(rows)
    heap = [(0, "", 0, "", ())]
    done: set = set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if (audit, i, roles) in done:
            continue
        done.add((audit, i, roles))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(lines)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r[0], (*lines, r + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if fault[i] in ("", "t"):
                role, text = rows[i]
                more = 5 if fault[i] == "t" else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + r[0], (*lines, f"{r}:{text}")))
    raise AssertionError


def conversations(seed: int, n: int, most: int) -> dict[int, list[tuple]]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "up"]
    texts = ["Hm.", "no end", "Yes!", "", " \n", "Why? ", "Fine."]
    return {c: [(rng.choice(roles), rng.choice(texts) + (str(rng.randint(0, 9)) + "." if rng.random() < 0.5 else "")) for _ in range(rng.randint(1, most))] for c in range(n)}


@pytest.mark.parametrize(("seed", "n", "most", "block"), [(1, 150, 7, 4096), (2, 60, 9, 2), (3, 30, 8, 1)])
def test_audits_equal_a_search(spark, seed, n, most, block):
    given = conversations(seed, n, most)
    rows = [(c, t * 2, role, text, "x") for c, turns in given.items() for t, (role, text) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv: r for r in repair.audits(df, block=block).collect()}
    assert set(got) == set(given)
    for c, turns in given.items():
        cost, audit, lines = plain(turns)
        r, fault = got[c], faults(turns)
        assert (r.cost, r.audit) == (cost, audit), (turns, r)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest(), (turns, r)
        assert (r.blank, r.duplicate, r.truncated) == (fault.count("b"), fault.count("d"), fault.count("t"))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        assert r.gaps == len(turns) - 1


def test_long_conversation_in_blocks(spark):
    rng = random.Random(7)
    turns = [(rng.choice(["user", "assistant", "tool"]), f"Text {k}" + rng.choice([".", "", "!"])) for k in range(700)]
    rows = [(1, t, *x, "x") for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = repair.audits(df).first(), repair.audits(df, block=13).first()
    assert whole == cut
    done = [(r.role, r.text) for r in repair.repaired(df, block=13).orderBy("place").collect()]
    assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest() == whole.repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in done))


def test_nulls_ties_and_nothing(spark):
    rows = [
        (None, None, "user", "A.", "x"), (None, 3, "assistant", "B.", "x"),
        (1, None, None, None, "x"),
        (2, 5, "user", "A.", "x"), (2, 5, "user", "A.", "x"), (2, 9, "assistant", "B?", "x"),
        (3, 0, "user", "long " * 50_000 + ".", "x"),
    ]
    got = {r.conv: r for r in repair.audits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[None].audit, got[None].gaps, got[None].cost) == ("KK", 0, 0)
    assert (got[1].audit, got[1].blank, got[1].gaps, got[1].repaired_sha256) == ("D", 1, 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].duplicate, got[2].gaps, got[2].illegal) == ("KDK", 1, 3, 1)
    assert got[3].audit == "D" and got[3].cost == 2
    assert repair.audits(spark.createDataFrame([], SCHEMA)).count() == 0
