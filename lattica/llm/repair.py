"""Cheapest repair of conversations to an optional system turn and pairs of user and assistant.

Which turns stay, as they are or in another role, is a shortest path over
retained turns. The price between two neighbours of it is what the turns between
them cost to delete (a difference of prefix sums) and the turns their two roles
need between them; running minima over later turns, one for each role, give the
best way on from every turn in one sweep from the end. Among cheapest ways the one
with the least audit is followed from the front: a deletion before an
insertion before a kept turn before a reroled one.

A long conversation is cut into blocks of turns. Each block is swept once for each
role that may stand at its end; these small tables say what leads from block to
block, then all blocks are repaired side by side. What one value of the
conversation needs (its audit, the digest of its repaired turns) is made by a task that
reads its turns in order and holds one batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.numbering import numbered
from lattica.plans.scratch import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that may stand last: none yet, then system, user, assistant.
NONE, S, U, A = range(4)
ROLES = {"s": S, "u": U, "a": A}
NAMES = ("", "system", "user", "assistant")
NEVER = 1 << 60
#: Turns to insert between a role and the next one; a system turn comes first only.
BETWEEN = ((NEVER, 0, 0, 1), (NEVER, NEVER, 0, 1), (NEVER, NEVER, 1, 0), (NEVER, NEVER, 0, 1))
#: Turns to insert after the last role.
AFTER = (0, 2, 1, 0)
#: Turns of a block.
BLOCK = 4096
FAULTS = ("", "blank", "duplicate", "truncated")
CLEAN, BLANK, DUPLICATE, CUT = range(4)


def sweep(first: list[int], fault: list[int], end: list[int]) -> list[list[int]]:
    """``way[i][r]``: least cost of turns i.. after role r, where ``end[r]`` is the cost behind the last of them.

    ``first`` has each turn's role (0 for one that is no role), ``fault`` its fault.
    """
    n = len(first)
    way = [[0] * 4 for _ in range(n)]
    way.append([min(e, NEVER) for e in end])
    deleted = DELETE * n  # prefix sum of deletions up to the turn
    behind = [min(NEVER, e + deleted) for e in end]
    best = [NEVER] * 4  # least of later retained turns in each role, counted from the front
    for i in range(n - 1, -1, -1):
        deleted -= DELETE
        if fault[i] in (CLEAN, CUT):
            extra, role, on = TRUNCATED * (fault[i] == CUT) + deleted, first[i], way[i + 1]
            for r in (S, U, A):
                if r == role or r != S:
                    got = extra + (KEEP if r == role else REROLE) + on[r]
                    if got < best[r]:
                        best[r] = got
        here = way[i]
        for r in range(4):
            need = BETWEEN[r]
            least = behind[r]
            for t in (S, U, A):
                if need[t] < NEVER and best[t] < NEVER:
                    got = best[t] + INSERT * need[t]
                    if got < least:
                        least = got
            here[r] = min(NEVER, least - deleted) if least < NEVER else NEVER
    return way


def follow(first: list[int], fault: list[int], way: list[list[int]], role: int) -> tuple[list[str], list[int], list[int], int]:
    """Each turn's letters, the role it gets (0 if deleted) and the role before it, and the last role, by the least audit."""
    letters, gets, before = [], [], []
    for i in range(len(first)):
        cost, on = way[i][role], way[i + 1]
        before.append(role)
        if DELETE + on[role] == cost:
            letters.append("D")
            gets.append(0)
            continue
        options = []
        for t in (S, U, A):
            need = BETWEEN[role][t]
            if need < NEVER and (t == first[i] or t != S) and fault[i] in (CLEAN, CUT):
                own = KEEP if t == first[i] else REROLE
                if INSERT * need + own + TRUNCATED * (fault[i] == CUT) + on[t] == cost:
                    options.append(("I" * need + ("K" if t == first[i] else "R"), t))
        said, role = min(options)
        letters.append(said)
        gets.append(role)
    return letters, gets, before, role


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames of whole blocks from rows sorted by key, block and pos."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        at = np.flatnonzero((frame["key"].to_numpy()[1:] != frame["key"].to_numpy()[:-1]) | (frame["block"].to_numpy()[1:] != frame["block"].to_numpy()[:-1])) + 1
        for k, (a, b) in enumerate(zip([0, *at], [*at, len(frame)], strict=True)):
            piece = frame.iloc[a:b]
            if held and not (k == 0 and held[-1]["key"].iloc[0] == piece["key"].iloc[0] and held[-1]["block"].iloc[0] == piece["block"].iloc[0]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, block, cost)``: of each block, the cost from each role before it to each role after it, row by row."""
    for frame in _blocks(batches):
        first, fault = frame["first"].tolist(), frame["fault"].tolist()
        costs = [sweep(first, fault, [0 if r == last else NEVER for r in range(4)])[0] for last in range(4)]
        out = [costs[last][r] for r in range(4) for last in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([frame["key"].iloc[0]]), pa.array([int(frame["block"].iloc[0])]), pa.array([out], pa.list_(pa.int64()))], ["key", "block", "cost"])


def _ends(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``(key, block, end)`` of the blocks of long conversations: the cost behind the block after each role.

    Tables of later blocks join up by doubling: after k rounds ``end`` covers 2**k blocks, so no task goes
    through a conversation.
    """
    tables = _sorted_blocks(rows).select("key", "block", "pos", "first", "fault").mapInArrow(_tables, "key string, block long, cost array<long>")
    have = scratch.keep(tables, "tables")
    count = have.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    have = have.join(count, "key")

    def joined(near: Column, far: Column) -> Column:
        def least(r: int, t: int) -> Column:
            return F.least(F.lit(NEVER), *[near[4 * r + m] + far[4 * m + t] for m in range(4)])

        return F.array(*[least(r, t) for r in range(4) for t in range(4)])

    span = 1
    most = have.agg(F.max("blocks")).first()[0] or 0
    while span < most:
        far = have.select(F.col("key").alias("far_key"), (F.col("block") - span).alias("far_block"), F.col("cost").alias("far"))
        both = have.join(far, (F.col("key") == F.col("far_key")) & (F.col("block") == F.col("far_block")), "left")
        have = scratch.keep(both.select("key", "block", "blocks", F.when(F.col("far").isNull(), F.col("cost")).otherwise(joined(F.col("cost"), F.col("far"))).alias("cost")), "spans")
        span *= 2
    end = F.array(*[F.least(*[F.col("cost")[4 * r + t] + INSERT * AFTER[t] for t in range(4)]) for r in range(4)])
    behind = have.select("key", (F.col("block") - 1).alias("block"), end.alias("end"))
    final = have.filter(F.col("block") == F.col("blocks") - 1).select("key", "block", F.array(*[F.lit(INSERT * a).cast("long") for a in AFTER]).alias("end"))
    return scratch.keep(behind.filter("block >= 0").unionByName(final), "ends")


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, block, leads)``: the role after each block for each role before it."""
    for frame in _blocks(batches):
        first, fault = frame["first"].tolist(), frame["fault"].tolist()
        way = sweep(first, fault, [int(x) for x in frame["end"].iloc[0]])
        leads = [follow(first, fault, way, r)[3] if way[0][r] < NEVER else r for r in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([frame["key"].iloc[0]]), pa.array([int(frame["block"].iloc[0])]), pa.array([leads], pa.list_(pa.int32()))], ["key", "block", "leads"])


def _starts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``(key, block, role)``: the role before each block but the first, by the same doubling from the front."""
    leads = _sorted_blocks(rows).select("key", "block", "pos", "first", "fault", "end").mapInArrow(_leads, "key string, block long, leads array<int>")
    have = scratch.keep(leads, "leads")
    most = have.agg(F.max("block")).first()[0]
    span = 1
    while span <= (most or 0):
        near = have.select(F.col("key").alias("near_key"), (F.col("block") + span).alias("near_block"), F.col("leads").alias("near"))
        both = have.join(near, (F.col("key") == F.col("near_key")) & (F.col("block") == F.col("near_block")), "left")
        through = F.transform("near", lambda role: F.element_at("leads", role + 1))
        have = scratch.keep(both.select("key", "block", F.when(F.col("near").isNull(), F.col("leads")).otherwise(through).alias("leads")), "leads")
        span *= 2
    return have.select("key", (F.col("block") + 1).alias("block"), F.col("leads")[NONE].alias("role"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, pos, letters, gets, ahead, behind, paid)`` of every turn: its part of the audit, its role, and the roles inserted before it and after the last."""
    held: dict[str, list] = {c: [] for c in ("key", "pos", "letters", "gets", "ahead", "behind", "paid")}

    def full() -> pa.RecordBatch:
        roles = pa.list_(pa.int32())
        kinds = {"key": pa.string(), "pos": pa.int64(), "letters": pa.string(), "gets": pa.int32(), "ahead": roles, "behind": roles, "paid": pa.int64()}
        out = pa.RecordBatch.from_arrays([pa.array(held[c], k) for c, k in kinds.items()], list(kinds))
        for c in held:
            held[c].clear()
        return out

    for frame in _blocks(batches):
        first, fault = frame["first"].tolist(), frame["fault"].tolist()
        end, start = frame["end"].iloc[0], frame["role"].iloc[0]
        way = sweep(first, fault, [INSERT * a for a in AFTER] if end is None else [int(x) for x in end])
        letters, gets, before, role = follow(first, fault, way, NONE if pd.isna(start) else int(start))
        fill = [[(A if r == U else U)] * BETWEEN[r][g] if g else [] for r, g in zip(before, gets, strict=True)]
        tails = [[] for _ in first]
        pos, n = frame["pos"].tolist(), int(frame["n"].iloc[0])
        if pos[-1] == n - 1:  # the conversation's last block
            tails[-1] = [U, A] if role == S else [A] if role == U else []
            letters[-1] += "I" * len(tails[-1])
        price = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}
        paid = [sum(price[c] for c in said) + TRUNCATED * (f == CUT and g > 0) for said, f, g in zip(letters, fault, gets, strict=True)]
        for c, values in zip(held, (frame["key"].tolist(), pos, letters, gets, fill, tails, paid), strict=True):
            held[c] += values
        if len(held["pos"]) >= 2 * BLOCK:
            yield full()
    if held["pos"]:
        yield full()


def edited(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Every turn in order with its edit: ``(key, conv, pos, n, turn, role, text, fault, letters, gets, ahead, behind, paid)``.

    Turns ascend by ``turn`` (nulls first), then role, then a digest of the text, so repeated rows stand side by side. Null roles and
    texts count as one blank, null conversations are one conversation. A turn's first fault is blank (no
    character but white space), duplicate (role and text stood earlier) or truncated (ends in none of ``.!?``).
    Roles count by their first letter, a role without one is none of the three. No row is left out: conversations and texts of any
    length are whole; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(turns.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    given = scratch.keep(given.withColumn("id", F.monotonically_increasing_id()), "turns")
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    cut = ~F.substr(ends, F.lit(-1), F.lit(1)).isin(".", "!", "?")
    state = F.when(F.length(ends) == 0, BLANK).when(cut, CUT).otherwise(CLEAN)
    letter = F.substr(F.col("role"), F.lit(1), F.lit(1))
    known = F.when(letter == "s", S).when(letter == "u", U).when(letter == "a", A).otherwise(NONE)
    says = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    narrow = scratch.keep(given.select("key", "turn", "role", says.alias("says"), "id", state.alias("state"), known.alias("first")), "narrow")
    rows = scratch.keep(numbered(scratch, narrow, "key", ["turn", "role", "says"]).drop("turn", "role"), "places")
    once = rows.groupBy(F.col("key").alias("k_"), F.col("says").alias("s_")).agg(F.min("pos").alias("earliest"))
    fault = F.when(F.col("state") == BLANK, BLANK).when(F.col("pos") > F.col("earliest"), DUPLICATE).otherwise(F.col("state"))
    rows = rows.join(once, (F.col("key") == F.col("k_")) & (F.col("says") == F.col("s_")))
    rows = rows.select("key", "id", "pos", "n", "first", fault.cast("int").alias("fault"), F.expr(f"pos div {block}").alias("block"))
    rows = scratch.keep(rows, "faults")
    long = rows.filter(F.col("n") > block)
    if long.isEmpty():
        work = rows.withColumn("end", F.lit(None).cast("array<long>")).withColumn("role", F.lit(None).cast("int"))
    else:
        ends = _ends(scratch, long)
        work = rows.join(ends, ["key", "block"], "left")
        starts = _starts(scratch, long.join(ends, ["key", "block"]))
        work = work.join(starts, ["key", "block"], "left")
    columns = ["key", "block", "pos", "n", "first", "fault", "end", "role"]
    schema = "key string, pos long, letters string, gets int, ahead array<int>, behind array<int>, paid long"
    edits = _sorted_blocks(work.select(*columns)).mapInArrow(_edits, schema)
    edits = scratch.keep(edits.join(rows.select("key", "pos", "n", "id", "fault"), ["key", "pos"]).drop("key"), "edits")
    return given.join(edits, "id").select("key", "conv", "pos", "n", "turn", "role", "text", "fault", "letters", "gets", "ahead", "behind", "paid")


def _new_role() -> Column:
    letter = F.substr(F.col("role"), F.lit(1), F.lit(1))
    named = F.element_at(F.array(*[F.lit(x) for x in NAMES]), F.col("gets") + 1)
    return F.when(letter == F.substr(named, F.lit(1), F.lit(1)), F.col("role")).otherwise(named)


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired turns ``(conv, place, role, text)``, ``place`` from 0 without gaps; inserted turns have an empty text.

    Nulls, ties, repeated rows, long texts and empty tables as in ``edited``.
    """
    scratch = Scratch(turns.sparkSession)
    name = lambda r: F.element_at(F.array(*[F.lit(x) for x in NAMES]), r + 1)
    empty = lambda c: F.transform(c, lambda r: F.struct(name(r).alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("gets") > 0, F.array(F.struct(_new_role().alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    out = edited(turns, conv, turn, role, text, block).select("key", "conv", "pos", F.posexplode(F.concat(empty("ahead"), own, empty("behind"))).alias("step", "said"))
    out = scratch.keep(out.select("key", "conv", F.col("pos").alias("after"), "step", "said.role", "said.text"), "repaired")
    return numbered(scratch, out, "key", ["after", "step"]).select("conv", F.col("pos").alias("place"), "role", "text")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from turns in order; holds the batch, the counts and the audit alone."""
    out: list[tuple] = []
    key = now = None

    def closed() -> None:
        if now is not None:
            gaps = now["high"] - now["low"] + 1 - now["distinct"] if now["low"] is not None else 0
            out.append((key, gaps, now["faults"][BLANK], now["faults"][DUPLICATE], now["faults"][CUT], now["illegal"], now["paid"], "".join(now["audit"]), now["hash"].hexdigest()))

    def full() -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "new_role", "fault", "letters", "gets", "ahead", "behind", "paid")], strict=True):
            k, turn, role, text, new_role, fault, letters, gets, ahead, behind, paid = row
            if now is None or k != key:
                closed()
                key, now = k, {"high": None, "low": None, "distinct": 0, "faults": [0] * 4, "illegal": 0, "paid": 0, "audit": [], "hash": hashlib.sha256(), "lines": 0, "last": None}
            if turn is not None and turn != now["high"]:
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"] = turn
                now["distinct"] += 1
            now["faults"][fault] += 1
            now["illegal"] += now["last"] is not None and now["last"] + role[:1] not in ("su", "ua", "au")
            now["last"] = role[:1]
            now["paid"] += paid
            now["audit"].append(letters)
            lines = [NAMES[r] + ":" for r in ahead] + ([f"{new_role}:{text}"] if gets else []) + [NAMES[r] + ":" for r in behind]
            for line in lines:
                if now["lines"]:
                    now["hash"].update(b"\n")
                now["hash"].update(line.encode())
                now["lines"] += 1
        if len(out) > 1000:
            yield full()
    closed()
    yield full()


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation.

    ``illegal`` counts neighbours whose roles' first letters are not su, ua or au; ``audit`` has the letters of the
    cheapest edits, the least of several; the digest is of the repaired turns ``role:text`` joined by line feeds.
    It and the audit need a conversation's turns in order, so one task reads them as a stream. Nulls, ties,
    repeated rows and empty tables as in ``edited``.
    """
    rows = edited(turns, conv, turn, role, text, block).withColumn("new_role", _new_role())
    names = Scratch(turns.sparkSession).keep(rows, "edited")
    columns = ["key", "pos", "turn", "role", "text", "new_role", "fault", "letters", "gets", "ahead", "behind", "paid"]
    schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    summed = names.select(*columns).repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_summed, schema)
    return summed.join(names.groupBy("key").agg(F.first("conv").alias("conv")), "key").select("conv", *[c.split()[0] for c in schema.split(", ")[1:]])
