"""Near duplicates, repeated passages and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontam, neardup, substring

PAIR = "doc_id long, text string"


def sets_of(text: str | None, k: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t, k)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and den * both >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
        if rng.random() < 0.5:
            base = w
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_CHUNK", 16)
    monkeypatch.setattr(neardup, "CLUSTER_CHUNK", 8)
    rng = random.Random(k)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for n in (60, 9, 4, 2, 2):
        texts += family(rng, [word() for _ in range(rng.choice([20, 60, 120]))], n, 4)
    texts += [" ".join(passage + [word() for _ in range(rng.choice([8, 20, 40]))]) for _ in range(60)]
    texts += ["one two", "One  TWO", "one", None, "", " \t ", texts[0].upper(), texts[0], texts[3]]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    rows += [rows[0], (None, texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, PAIR)
    for name in ("key", "members", "sig", "component_id", "cluster"):
        docs = docs.withColumn(name, F.lit("x"))
    got = neardup.near_duplicates(docs, k, num, 100).collect()
    want = brute(rows, k, num, 100)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(sets_of(dict(rows)[r.doc_id], k))
    kept = neardup.drop_near_duplicates(docs, words_per_shingle=k, num=num, den=100)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_near_duplicates_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    got = neardup.near_duplicates(spark.createDataFrame([(5, a), (9, a), (3, b), (5, b), (7, c)], PAIR), 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 9: 3, 7: 7}
    assert neardup.near_duplicates(spark.createDataFrame([], PAIR)).count() == 0


def test_match_threshold_is_rarely_missed():
    from math import comb

    for s in (0.8, 0.85):
        t = neardup.match_threshold(s)
        miss = sum(comb(40, i) * s**i * (1 - s) ** (40 - i) for i in range(t))
        assert miss <= neardup.MISS and t > 15


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    got = neardup.intersections(sets, step=7)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))


def sentences_of(text):
    """(start, end, words) in bytes by the rule, one by one."""
    raw = text.encode()
    out, words, at, start = [], [], 0, None
    breaks = b" \t\n\r\x0b\x0c"
    while at < len(raw):
        if raw[at] in breaks:
            if raw[at] == 10 and words:
                out.append((start, end, words))
                words = []
            at += 1
            continue
        b = at
        while at < len(raw) and raw[at] not in breaks:
            at += 1
        if not words:
            start = b
        words.append(raw[b:at].lower())
        end = at
        if raw[at - 1] in b".!?":
            out.append((start, end, words))
            words = []
    if words:
        out.append((start, end, words))
    return out


def brute_spans(rows, least):
    places: dict[tuple, list] = {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        s = sentences_of(text)
        own = set()
        for i in range(len(s)):
            for j in range(i + 2, len(s) + 1):
                if sum(len(x[2]) for x in s[i:j]) >= least:
                    own.add((i, j))
                    break
        for j in range(len(s), 0, -1):
            for i in range(j - 2, -1, -1):
                if sum(len(x[2]) for x in s[i:j]) >= least:
                    own.add((i, j))
                    break
        for i, j in own:
            places.setdefault(tuple(w for x in s[i:j] for w in x[2]), []).append((doc, s[i][0], s[j - 1][1]))
    gone: dict[int, list] = {}
    for found in places.values():
        first = min(found)
        for doc, a, b in found:
            if doc != first[0] or a != first[1]:
                gone.setdefault(doc, []).append((a, b))
    out = set()
    for doc, spans in gone.items():
        spans.sort()
        a, b = spans[0]
        for x, y in spans[1:]:
            if x <= b:
                b = max(b, y)
            else:
                out.add((doc, a, b))
                a, b = x, y
        out.add((doc, a, b))
    return out


def test_repeated_spans(spark):
    rng = random.Random(8)
    sent = lambda n=None: " ".join(f"ß{rng.randrange(400)}" for _ in range(n or rng.randint(1, 14))).capitalize() + rng.choice([". ", "! ", "?\n", "\n", ". "])
    passages = ["".join(sent() for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [sent() for _ in range(rng.randint(1, 12))]
        if i % 2:
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        if i % 9 == 0:
            parts += [passages[0], sent(), passages[0]]
        rows.append((i, "".join(parts)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, None), (93, ""), (94, "One. Two."), (95, "One. Two."), (None, rows[3][1]), (96, "long " * 5000)]
    docs = spark.createDataFrame(rows, PAIR)
    for least in (20, 5):
        got = {(r.doc_id, r.start, r.end) for r in substring.repeated_spans(docs, 2, least).collect()}
        assert got == brute_spans(rows, least) and got
    extra = docs.withColumn("key", F.lit(1)).withColumn("cuts", F.lit("c")).withColumn("n_chars", F.length("text").cast("long")).withColumn("start", F.lit(0))
    clean = substring.remove_repeats(extra)
    assert clean.columns == extra.columns
    left = {r.doc_id: r for r in clean.collect()}
    assert clean.count() == len(rows) and left[92].text is None and left[95].text == "One. Two." and left[None].text == rows[3][1]
    assert len(left[91].text) < len(rows[3][1]) and left[91].n_chars == len(left[91].text)
    raw = dict(rows)[91].encode()
    spans = sorted((a, b) for d, a, b in brute_spans(rows, substring.LEAST_WORDS) if d == 91)
    assert not any(raw[a:b].decode() in left[91].text for a, b in spans)


def test_long_passages_without_sentence_ends(spark):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, two = words(60), f"{words(18)}. {words(17)}. {words(18)}"
    alike = "la di " * 40
    rows = [(i, f"{words(30 + i)} {passage} {words(25)}") for i in range(3)] + [(10 + i, f"{words(9)} {two} {words(9)}") for i in range(3)]
    rows += [(20, words(101)), (22, alike), (23, alike), (24, words(30))]
    rows.append((21, rows[6][1]))
    spans: dict[int, list] = {}
    for r in substring.repeated_spans(spark.createDataFrame(rows, PAIR)).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = dict(rows)
    assert set(spans) == {1, 2, 11, 12, 21, 23}
    assert spans[21] == [(0, len(texts[21]))] and len(substring.cut_out(alike, spans[23])) == 0
    for doc, whole in ((1, passage), (2, passage), (11, two), (12, two)):
        ((a, b),) = spans[doc]
        at = texts[doc].index(whole)
        assert at <= a and b <= at + len(whole) and len(texts[doc][a:b].split()) >= len(whole.split()) - 2 * 18


def test_spans_of_repeated_rows_and_empty_tables(spark):
    text = "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen. " * 1 + "a b c d e f g h i."
    rows = spark.createDataFrame([(1, text), (1, text)], PAIR)
    assert substring.repeated_spans(rows).count() == 0
    assert substring.remove_repeats(spark.createDataFrame([], PAIR)).count() == 0


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(range(len(row)), key=lambda j: row[j]), min(row)


def test_myers_matches_dynamic_programming():
    rng = random.Random(9)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text = text[:20] + item[: len(item) // 2] + "x" + item[len(item) // 2 + 1 :] + text[20:]
        end, d = plain_distance(item, text)
        for errors in (0, 3, 100):
            got = decontam.best_match(item, text, errors)
            assert (got is None) == (d > errors or not text)
            if got:
                assert got[0] == d and plain_distance(item, text[: got[1]])[1] == d


def test_contaminations(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(12)]
    rows, want = [], set()
    for d in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if d % 3 == 0:
            i, item = rng.choice(items)
            copy = list(item)
            for _ in range(rng.randint(0, int(len(item) * decontam.RATE))):
                at = rng.randrange(len(copy))
                copy[at] = rng.choice(["", "Q", copy[at] + "z"])
            text += "\n " + "".join(copy).upper() + "  " + text
            want.add((d, i))
        rows.append((d, text))
    rows += [(100, None), (None, items[0][1]), (101, ""), (102, items[1][1] * 2), (102, items[1][1] * 2), (103, items[1][1][: len(items[1][1]) // 2])]
    rows += [(104, "a  Short\nONE here, and short one"), (105, "ashort one, short ones")]
    want |= {(102, 1), (104, 52)}
    docs = spark.createDataFrame(rows, PAIR).withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame(items + [(None, "x" * 99), (50, None), (51, ""), (52, "short one")], "item_id long, text string")
    for chars in (decontam.PASS_CHARS, 900):
        found = decontam.contaminations(docs, bench, pass_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
    texts = {d: decontam.normalise(t) for d, t in rows}
    asked = dict(items) | {52: "short one"}
    for r in found:
        least = plain_distance(decontam.normalise(asked[r.item_id]), texts[r.doc_id])[1]
        assert r.distance == least or r.doc_id == 102
    two = sorted((r.start, r.end) for r in found if r.doc_id == 102)
    n = len(items[1][1])
    assert len(two) == 2 and two[0][1] <= two[1][0] and {b - a for a, b in two} == {n}
    assert sorted((r.start, r.end) for r in found if r.doc_id == 104) == [(2, 11), (22, 31)]
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 20 - 4
    assert decontam.contaminations(docs, bench.limit(0)).count() == 0 and decontam.contaminations(docs.limit(0), bench).count() == 0


def test_contaminations_equal_a_search_of_all_pairs(spark):
    """Every document against every item by dynamic programming: no copy within the budget is missed, none is invented."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(16))) for i in range(8)]
    rows = []
    for d in range(90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _, item in rng.sample(items, rng.randint(0, 2)):
            copy = list(item)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(copy))
                copy[at] = rng.choice(["", copy[at] * 2, "x"])
            parts += ["".join(copy), " ".join(word() for _ in range(rng.randint(0, 9)))]
        rows.append((d, decontam.normalise(" ".join(parts))))
    want = {(d, i) for d, t in rows for i, item in items if t and plain_distance(item, t)[1] <= decontam.budget(item)}
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, PAIR).repartition(parts)
        found = decontam.contaminations(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 20


def test_contamination_of_repeated_rows_does_not_follow_the_layout(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away into the wood"
    rows = [(1, f"x {item} y {item} z")] * 4
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = [sorted(map(tuple, decontam.contaminations(spark.createDataFrame(rows, PAIR).repartition(n), bench).collect())) for n in (1, 2, 4)]
    n = len(item)
    assert got[0] == got[1] == got[2] == [(1, 7, 2, 2 + n, 0), (1, 7, 5 + n, 5 + 2 * n, 0)]
    long = "w " * 400_000 + item
    assert decontam.contaminations(spark.createDataFrame([(1, long)], PAIR), bench).count() == 1


def test_near_duplicates_of_a_large_group_link_once(spark, monkeypatch):
    """A group of near copies costs at most one link a member in each of the two steps, at any size."""
    rng = random.Random(40)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    counts = []
    edges = neardup.connected_components

    def counted(df, scratch=None, **kw):
        counts[-1].append(df.dropna().count())
        return edges(df, scratch, **kw)

    monkeypatch.setattr(neardup, "connected_components", counted)
    for n in (150, 600):
        rows = []
        for i in range(n):
            own = list(base)
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
        rows.append((n, " ".join(f"v{rng.randrange(10**6)}" for _ in range(20_000))))
        counts.append([])
        got = neardup.near_duplicates(spark.createDataFrame(rows, PAIR), 3, 85, 100).collect()
        want = brute(rows, 3, 85, 100)
        assert all(r.component_id == want[r.doc_id] for r in got)
        assert all(c <= n for c in counts[-1])
