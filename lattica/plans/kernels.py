"""NumPy kernels of the analysis and factorization of one system.

They run in one task for a system, a batch member, a subtree or the top of the
elimination tree. Patterns are lists of sorted arrays by column; permutations are
``perm[old] = new``; a root's parent is n.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


def columns(n: int, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct row indices of each column."""
    key = np.unique(j.astype(np.int64) * n + i) if n else np.zeros(0, np.int64)
    return np.split(key % n, np.searchsorted(key // n, np.arange(1, n))) if n else []


def symmetric_columns(n: int, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Columns of the pattern A + A' without the diagonal."""
    off = i != j
    return columns(n, np.concatenate([i[off], j[off]]), np.concatenate([j[off], i[off]]))


def gram_columns(n: int, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Columns of the pattern A' A without the diagonal."""
    near: list[set[int]] = [set() for _ in range(n)]
    order = np.argsort(i, kind="stable")
    for row in np.split(j[order], np.flatnonzero(np.diff(i[order])) + 1):
        own = set(row.tolist())
        for c in own:
            near[c] |= own
    return [np.array(sorted(s - {c}), np.int64) for c, s in enumerate(near)]


# --- matching -------------------------------------------------------------------------------------------------------


@dataclass
class Matching:
    perm: np.ndarray  # perm[row] = column it is matched with
    u: np.ndarray  # log scale of rows
    v: np.ndarray  # log scale of columns
    info: int  # 1: structurally singular, perm is the identity


def _cost_matching(n: int, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Perfect matching of least cost by shortest augmenting paths; row duals u and column duals v with cost >= u + v."""
    order = np.lexsort((i, j))
    i, j, cost = i[order], j[order], cost[order]
    start = np.searchsorted(j, np.arange(n + 1))
    row_of = [-1] * n
    col_of = [-1] * n
    u = np.full(n, np.inf)
    np.minimum.at(u, i, cost)
    if not np.isfinite(u).all():
        return None
    v = np.full(n, np.inf)
    np.minimum.at(v, j, cost - u[i])
    if not np.isfinite(v).all():
        return None
    rows, costs = i.tolist(), cost.tolist()
    for c in range(n):  # tight entries first
        for p in range(start[c], start[c + 1]):
            r = rows[p]
            if col_of[r] < 0 and costs[p] - u[r] - v[c] <= 1e-15:
                row_of[c], col_of[r] = r, c
                break
    for root in range(n):
        if row_of[root] >= 0:
            continue
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        c, base, sink = root, 0.0, -1
        while True:
            for p in range(start[c], start[c + 1]):
                r = rows[p]
                if r in done:
                    continue
                d = base + max(0.0, costs[p] - u[r] - v[c])
                if d < dist.get(r, np.inf):
                    dist[r], via[r] = d, c
                    heapq.heappush(heap, (d, r))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                return None
            base, r = heapq.heappop(heap)
            done[r] = base
            if col_of[r] < 0:
                sink = r
                break
            c = col_of[r]
        for r, d in done.items():
            if col_of[r] >= 0:
                v[col_of[r]] += base - d
            u[r] -= base - d
        v[root] += base
        r = sink
        while True:
            c = via[r]
            before, row_of[c], col_of[r] = row_of[c], r, c
            r = before
            if c == root:
                break
    return np.array(col_of), u, v


def match_rows(n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, job: int = 5) -> Matching:
    """Large-diagonal matching. 1: any; 2, 3: greatest least entry; 4: greatest sum; 5: greatest product, with scalings.

    Explicit zeros are no edges. Job 5: |a_ij| exp(u_i + v_j) <= 1, with equality on the matching.
    """
    size = np.abs(a)
    keep = size > 0
    i, j, size = i[keep], j[keep], size[keep]
    none = Matching(np.arange(n), np.zeros(n), np.zeros(n), 1)
    if job == 1:
        got = _cost_matching(n, i, j, np.zeros(len(i)))
    elif job in (2, 3):
        levels = np.unique(size)
        low, high, got = 0, len(levels) - 1, None
        while low <= high:
            mid = (low + high) // 2
            own = size >= levels[mid]
            found = _cost_matching(n, i[own], j[own], np.zeros(own.sum()))
            if found is None:
                high = mid - 1
            else:
                got, low = found, mid + 1
    elif job == 4:
        got = _cost_matching(n, i, j, -size)
    elif job == 5:
        top = np.zeros(n)
        np.maximum.at(top, j, size)
        if n and not (top > 0).all():
            return none
        got = _cost_matching(n, i, j, np.log(top[j]) - np.log(size))
    else:
        raise ValueError(f"no job {job}")
    if got is None:
        return none if n else Matching(np.zeros(0, int), np.zeros(0), np.zeros(0), 0)
    perm, u, v = got
    return Matching(perm, u, v - np.log(top), 0) if job == 5 else Matching(perm, np.zeros(n), np.zeros(n), 0)


# --- orderings ------------------------------------------------------------------------------------------------------


def minimum_degree(near: list[np.ndarray]) -> np.ndarray:
    """Order by least external degree on the quotient graph: eliminated nodes become cliques, absorbed by later ones.

    All nodes of the least degree that do not touch are taken in one pass, and
    nodes with equal neighbours go together. Ties go to the least index.
    """
    order, _, _ = partial_minimum_degree(near, np.zeros(len(near), bool))
    perm = np.empty(len(near), np.int64)
    perm[order] = np.arange(len(near))
    return perm


def partial_minimum_degree(near: list[np.ndarray], held: np.ndarray) -> tuple[list[int], dict[int, set[int]], list[set[int]]]:
    """``minimum_degree`` of the nodes not ``held``: their order, the cliques they leave and the edges left beside these."""
    n = len(near)
    stays = held.tolist()
    nodes = [set(x.tolist()) for x in near]  # uneliminated neighbours by edges of the matrix
    cliques: list[set[int]] = [set() for _ in range(n)]  # of which a node is part
    members: dict[int, set[int]] = {}
    weight = [1] * n
    twins: list[list[int]] = [[k] for k in range(n)]
    gone = [False] * n
    degree = [len(x) for x in near]
    heap = [(degree[k], k) for k in range(n) if not stays[k]]
    heapq.heapify(heap)
    order: list[int] = []
    while heap:
        d, k = heapq.heappop(heap)
        if gone[k] or d != degree[k]:
            continue
        batch, touched, front = [k], set(), [k]
        again = []
        reach_of = {}
        while front:
            p = front.pop()
            reach = set(nodes[p])
            for c in cliques[p]:
                reach |= members[c]
            reach.discard(p)
            reach_of[p] = reach
            touched |= reach
            while heap and heap[0][0] == d:
                d2, q = heapq.heappop(heap)
                if gone[q] or degree[q] != d2 or q in reach_of:
                    continue
                if q in touched:
                    again.append((d2, q))
                    continue
                batch.append(q)
                front.append(q)
                break
        for entry in again:
            heapq.heappush(heap, entry)
        for p in batch:
            reach = {x for x in reach_of[p] if not gone[x]}
            order += twins[p]
            gone[p] = True
            old = cliques[p]
            for c in old:
                members.pop(c, None)
            members[p] = reach
            for x in reach:
                nodes[x] -= reach
                nodes[x].discard(p)
                cliques[x] -= old
                cliques[x].add(p)
        changed = sorted({x for p in batch for x in reach_of[p] if not gone[x]})
        same: dict[tuple, int] = {}
        for x in changed:
            if stays[x]:
                continue
            key = (frozenset(nodes[x]), frozenset(cliques[x]))
            first = same.setdefault(key, x)
            if first != x:  # indistinguishable: one stands for both
                twins[first] += twins[x]
                weight[first] += weight[x]
                gone[x] = True
                for c in cliques[x]:
                    members[c].discard(x)
                for y in nodes[x]:
                    nodes[y].discard(x)
        for x in changed:
            if not gone[x] and not stays[x]:
                reach = set(nodes[x])
                for c in cliques[x]:
                    reach |= members[c]
                reach.discard(x)
                degree[x] = sum(weight[y] for y in reach)
                heapq.heappush(heap, (degree[x], x))
    return order, members, nodes


def nested_dissection(near: list[np.ndarray], leaf: int = 32) -> np.ndarray:
    """Order by level-set separators, each after both halves; small pieces by minimum degree."""
    n = len(near)
    order: list[int] = []

    def levels(root: int, inside: set[int]) -> list[list[int]]:
        seen, out = {root}, [[root]]
        while True:
            nxt = sorted({int(y) for x in out[-1] for y in near[x] if int(y) in inside} - seen)
            if not nxt:
                return out
            seen.update(nxt)
            out.append(nxt)

    work: list[tuple[str, list[int]]] = [("cut", list(range(n)))]
    while work:
        kind, part = work.pop()
        if kind == "take":
            order += part
            continue
        inside = set(part)
        found = levels(part[0], inside) if part else []
        reached = [x for level in found for x in level]
        if len(reached) < len(part):  # another component
            have = set(reached)
            work.append(("cut", [x for x in part if x not in have]))
            work.append(("cut", reached))
            continue
        if found:
            found = levels(found[-1][-1], inside)  # from the far end
        if len(part) <= leaf or len(found) < 3:
            index = {x: k for k, x in enumerate(part)}
            local = [np.array(sorted(index[int(y)] for y in near[x] if int(y) in index), np.int64) for x in part]
            perm = minimum_degree(local)
            order += [part[k] for k in np.argsort(perm)]
            continue
        total, mid = 0, 1
        for k, level in enumerate(found):
            total += len(level)
            if total * 2 >= len(part):
                mid = min(max(k, 1), len(found) - 2)
                break
        left = [x for level in found[:mid] for x in level]
        right = [x for level in found[mid + 1 :] for x in level]
        work += [("take", found[mid]), ("cut", sorted(right)), ("cut", sorted(left))]
    perm = np.empty(n, np.int64)
    perm[order] = np.arange(n)
    return perm


def order_columns(n: int, i: np.ndarray, j: np.ndarray, how: str) -> np.ndarray:
    if how == "natural":
        return np.arange(n)
    if how == "mmd_at_plus_a":
        return minimum_degree(symmetric_columns(n, i, j))
    if how in ("mmd_ata", "colamd"):
        return minimum_degree(gram_columns(n, i, j))
    if how == "nested_dissection":
        return nested_dissection(symmetric_columns(n, i, j))
    raise ValueError(f"no ordering {how!r}")


# --- trees ----------------------------------------------------------------------------------------------------------


def symmetric_tree(cols: list[np.ndarray]) -> np.ndarray:
    """Elimination tree of a symmetric pattern, from the entries above the diagonal; paths are compressed on the way up."""
    n = len(cols)
    parent, above = [n] * n, [n] * n
    for c in range(n):
        for r in cols[c].tolist():
            while r < c:
                up, above[r] = above[r], c
                if up == n:
                    parent[r] = c
                    break
                r = up
    return np.array(parent, np.int64)


def column_tree(n: int, cols: list[np.ndarray], rows: int) -> np.ndarray:
    """Elimination tree of A' A, without forming it: each row is a star on its first column."""
    first = [n] * rows
    for c in range(n):
        for r in cols[c].tolist():
            if first[r] == n:
                first[r] = c
    star: list[set[int]] = [set() for _ in range(n)]
    for c in range(n):
        for r in cols[c].tolist():
            if first[r] < c:
                star[c].add(first[r])
    return symmetric_tree([np.array(sorted(s), np.int64) for s in star])


def postorder(parent: np.ndarray) -> np.ndarray:
    """``post[node] = position``; children in order of index."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n + 1)]
    for c in range(n - 1, -1, -1):
        kids[parent[c]].append(c)
    post = np.empty(n, np.int64)
    at, stack = 0, kids[n][:]  # kids are listed from the last to the first
    while stack:
        x = stack.pop()
        if x < 0:
            post[~x] = at
            at += 1
        else:
            stack.append(~x)
            stack += kids[x]
    return post


def relabel_tree(parent: np.ndarray, post: np.ndarray) -> np.ndarray:
    out = np.empty_like(parent)
    out[post] = np.append(post, len(parent))[parent]
    return out


def descendants(parent: np.ndarray) -> np.ndarray:
    """Number of proper descendants; the tree must be postordered."""
    n = len(parent)
    count = np.zeros(n + 1, np.int64)
    for c in range(n):
        count[parent[c]] += count[c] + 1
    return count[:n]


def depths(parent: np.ndarray) -> np.ndarray:
    """Level of each node from the leaves: 0, else one more than its highest child."""
    level = np.zeros(len(parent) + 1, np.int64)
    for c, p in enumerate(parent):
        level[p] = max(level[p], level[c] + 1)
    return level[:-1]


def permutation_sign(perm: np.ndarray) -> int:
    seen, swaps = np.zeros(len(perm), bool), 0
    for k in range(len(perm)):
        length = 0
        while not seen[k]:
            seen[k] = True
            k = perm[k]
            length += 1
        swaps += max(0, length - 1)
    return -1 if swaps % 2 else 1


# --- symbolic factorization -----------------------------------------------------------------------------------------


def symbolic(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of the patterns of L (with the diagonal) and U (without) for diagonal pivots.

    Column j is what can be reached from the rows of A(:, j) through the columns of
    L to the left. A column's search stops at its first row in both L and U, as
    the columns beyond are reached through that one.
    """
    below: list[np.ndarray] = []
    above: list[np.ndarray] = []
    pruned: list[np.ndarray] = []
    for c, rows in enumerate(columns(n, i, j)):
        seen = set(rows.tolist()) | {c}
        stack = [r for r in rows.tolist() if r < c]
        while stack:
            k = stack.pop()
            for r in pruned[k].tolist():
                if r not in seen:
                    seen.add(r)
                    if r < c:
                        stack.append(r)
        every = np.array(sorted(seen), np.int64)
        cut = np.searchsorted(every, c)
        above.append(every[:cut])
        below.append(every[cut:])
        pruned.append(every[cut + 1 :])
        for k in every[:cut].tolist():  # symmetric pruning
            p = pruned[k]
            at = np.searchsorted(p, c)
            if at + 1 < len(p) and p[at] == c:
                pruned[k] = p[: at + 1]
    return below, above


@dataclass
class Fronts:
    """Supernodes of a symmetric pattern: columns ``first`` to ``last`` and the rows below."""

    first: np.ndarray
    last: np.ndarray
    below: list[np.ndarray]
    parent: np.ndarray  # supernode; their number for a root


def fronts(cols: list[np.ndarray], parent: np.ndarray, relax: int = 30, maxsup: int = 256) -> Fronts:
    """Supernodes of a postordered tree (with ``relax`` 1 of any): whole subtrees of fewer than ``relax`` descendants, else chains of nested columns.

    Rows beyond the columns that are given belong to later supernodes.

    A chain of fewer than ``relax`` columns also takes a parent that is not nested,
    as long as the zeros stored for that stay under ``relax`` squared; long thin
    trees, as of banded matrices, would else fall into single columns.
    """
    n = len(cols)
    relax = min(relax, maxsup)
    count = descendants(parent)
    first: list[int] = []
    last: list[int] = []
    below: list[np.ndarray] = []
    zeros: list[int] = []
    waiting: dict[int, list[int]] = {}  # supernodes by their first row below
    c = 0
    while c < n:
        top = c
        while parent[top] < n and count[parent[top]] < relax and parent[top] - count[parent[top]] <= c:
            top = int(parent[top])
        kids = [k for x in range(c, top + 1) for k in waiting.pop(x, [])]
        parts = [cols[x] for x in range(c, top + 1)] + [below[k] for k in kids]
        rows = np.unique(np.concatenate(parts))
        rows = rows[rows > top]
        s = len(first) - 1
        chain = top == c and kids == [s] and last[s] == c - 1 and top - first[s] < maxsup
        gap = (top - first[s]) * (len(rows) + 1 - len(below[s])) if chain else 0
        if chain and (gap == 0 or (top - first[s] < relax and zeros[s] + gap < relax * relax)):
            last[s], below[s] = top, rows
            zeros[s] += gap
        else:
            s += 1
            zeros.append(0)
            first.append(c)
            last.append(top)
            below.append(rows)
        if len(rows):
            waiting.setdefault(int(rows[0]), []).append(s)
        c = top + 1
    owner = np.repeat(np.arange(len(first)), np.array(last, np.int64) - np.array(first, np.int64) + 1) if n else np.zeros(0, np.int64)
    up = np.array([owner[r[0]] if len(r) and r[0] < n else len(first) for r in below], np.int64)
    return Fronts(np.array(first, np.int64), np.array(last, np.int64), below, up)


# --- numeric factorization ------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Factors of one supernode: rows ``index`` (its ``p`` pivots, then those below), L and U of the pivots in one, L below, U to the right."""

    s: int
    p: int
    index: np.ndarray
    lu: np.ndarray
    low: np.ndarray
    right: np.ndarray


def dense_lu(a: np.ndarray, threshold: float, at: int) -> tuple[int, int]:
    """In place without pivoting: (tiny pivots replaced, 1 + first zero pivot or 0); threshold 0 replaces none."""
    tiny = info = 0
    for k in range(len(a)):
        d = a[k, k]
        if threshold and abs(d) < threshold:
            a[k, k] = d = threshold * (d / abs(d) if d != 0 else 1.0)
            tiny += 1
        if d == 0:
            info = info or at + k + 1
            continue
        a[k + 1 :, k] /= d
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return tiny, info


def lower_solve(lu: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit lower triangle of ``lu`` into b, by halves."""
    n = len(lu)
    if n <= 16:
        for k in range(1, n):
            b[k] -= lu[k, :k] @ b[:k]
        return b
    h = n // 2
    lower_solve(lu[:h, :h], b[:h])
    b[h:] -= lu[h:, :h] @ b[:h]
    lower_solve(lu[h:, h:], b[h:])
    return b


def upper_solve(lu: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(lu)
    if n <= 16:
        for k in range(n - 1, -1, -1):
            b[k] = (b[k] - lu[k, k + 1 :] @ b[k + 1 :]) / lu[k, k]
        return b
    h = n // 2
    upper_solve(lu[h:, h:], b[h:])
    b[:h] -= lu[:h, h:] @ b[h:]
    upper_solve(lu[:h, :h], b[:h])
    return b


def eliminate(
    own: np.ndarray,
    f: Fronts,
    owner: np.ndarray,
    i: np.ndarray,
    j: np.ndarray,
    v: np.ndarray,
    threshold: float = 0.0,
    given: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> tuple[list[Block], list[tuple[np.ndarray, np.ndarray]], int, int]:
    """Factor the supernodes ``own`` (children before parents) from entries owned by them and updates ``given`` to them.

    Returns their blocks, the updates left for supernodes not among them (index, matrix), tiny pivots and info.
    """
    part = owner[np.minimum(i, j)]
    order = np.argsort(part, kind="stable")
    part, i, j, v = part[order], i[order], j[order], v[order]
    mine = set(own.tolist())
    updates: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for rows, m in given or []:
        updates.setdefault(int(owner[rows[0]]), []).append((rows, m))
    blocks, left, tiny, info = [], [], 0, 0
    for s in own.tolist():
        p = int(f.last[s] - f.first[s] + 1)
        index = np.concatenate([np.arange(f.first[s], f.last[s] + 1), f.below[s]])
        a = np.zeros((len(index), len(index)), v.dtype)
        lo, hi = np.searchsorted(part, [s, s + 1])
        np.add.at(a, (np.searchsorted(index, i[lo:hi]), np.searchsorted(index, j[lo:hi])), v[lo:hi])
        for rows, m in updates.pop(s, []):
            at = np.searchsorted(index, rows)
            a[np.ix_(at, at)] += m
        t, z = dense_lu(a[:p, :p], threshold, int(f.first[s]))
        tiny, info = tiny + t, info or z
        lu = a[:p, :p].copy()
        right = lower_solve(lu, a[:p, p:].copy())
        with np.errstate(all="ignore"):
            low = _right_divide(a[p:, :p], lu)
        if len(index) > p:
            rest = a[p:, p:] - low @ right
            if int(f.parent[s]) in mine:
                updates.setdefault(int(f.parent[s]), []).append((index[p:], rest))
            else:
                left.append((index[p:], rest))
        blocks.append(Block(s, p, index, lu, low, right))
    return blocks, left, tiny, info


def _right_divide(a: np.ndarray, lu: np.ndarray) -> np.ndarray:
    """a U^-1."""
    out = a.copy()
    for k in range(len(lu)):
        if k:
            out[:, k] -= out[:, :k] @ lu[:k, k]
        out[:, k] /= lu[k, k]
    return out


def forward(blocks: list[Block], x: np.ndarray) -> None:
    """L y = b in place; x has a row for every index."""
    for b in blocks:
        own = b.index[: b.p]
        x[own] = y = lower_solve(b.lu, x[own])
        if len(b.index) > b.p:
            x[b.index[b.p :]] -= b.low @ y


def backward(blocks: list[Block], x: np.ndarray) -> None:
    """U x = y in place."""
    for b in reversed(blocks):
        own = b.index[: b.p]
        y = x[own]
        if len(b.index) > b.p:
            y = y - b.right @ x[b.index[b.p :]]
        x[own] = upper_solve(b.lu, y)


def backward_transposed(blocks: list[Block], x: np.ndarray) -> None:
    """U' y = b, then L' x = y, in place."""
    for b in blocks:
        own = b.index[: b.p]
        flip = b.lu.T
        y = x[own].copy()
        for k in range(b.p):
            if k:
                y[k] -= flip[k, :k] @ y[:k]
            y[k] /= flip[k, k]
        x[own] = y
        if len(b.index) > b.p:
            x[b.index[b.p :]] -= b.right.T @ y
    for b in reversed(blocks):
        own = b.index[: b.p]
        y = x[own].copy()
        if len(b.index) > b.p:
            y -= b.low.T @ x[b.index[b.p :]]
        for k in range(b.p - 2, -1, -1):
            y[k] -= b.lu[k + 1 :, k] @ y[k + 1 :]
        x[own] = y


# --- division of the tree among tasks -------------------------------------------------------------------------------


def subtree_tasks(f: Fronts, parts: int) -> np.ndarray:
    """Task of each supernode: whole subtrees of at most 1 / parts of the work, packed largest first; -1 is the top."""
    n = len(f.first)
    p = (f.last - f.first + 1).astype(float)
    size = p + np.array([len(b) for b in f.below], float) if n else np.zeros(0)
    work = p * size * size
    total = np.append(work, 0.0)
    for s in range(n):
        total[f.parent[s]] += total[s]
    limit = work.sum() / max(1, parts)
    task = np.full(n, -1, np.int64)
    roots = [s for s in range(n) if total[s] <= limit and (f.parent[s] == n or total[f.parent[s]] > limit)]
    load = np.zeros(max(1, parts))
    for s in sorted(roots, key=lambda s: -total[s]):
        k = int(load.argmin())
        load[k] += total[s]
        task[s] = k
    for s in range(n - 1, -1, -1):
        up = f.parent[s]
        if task[s] < 0 and up < n and task[up] >= 0:
            task[s] = task[up]
    return task


def subtree_steps(f: Fronts, parts: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``subtree_tasks``, and the same again for what lies above as long as it has more than ``rows`` columns.

    Returns the task of each supernode, -1 for the last ones, and the step of each task: its children are done in earlier steps.
    """
    n = len(f.first)
    task = subtree_tasks(f, parts)
    steps = np.zeros(int(task.max(initial=-1)) + 1, np.int64)
    p = f.last - f.first + 1
    while (left := int(p[task < 0].sum())) > rows:
        above = np.flatnonzero(task < 0)
        local = np.append(np.full(n, len(above)), len(above))
        local[above] = np.arange(len(above))
        rest = Fronts(f.first[above], f.last[above], [f.below[s] for s in above.tolist()], local[f.parent[above]])
        more = subtree_tasks(rest, -(-left // rows))
        if (more < 0).all():  # one supernode is more than a task's share
            break
        named, more[more >= 0] = np.unique(more[more >= 0], return_inverse=True)
        task[above[more >= 0]] = len(steps) + more[more >= 0]
        steps = np.append(steps, np.full(len(named), (steps[-1] if len(steps) else -1) + 1))
    return task, steps
