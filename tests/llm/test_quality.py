"""Quality rules against a plain version."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from lattica.llm import quality


def plain(rows: list[tuple], share: float, least: int, left: int = 0) -> dict:
    """id -> counts, common words and whether depleted, of rows (id, host, text)."""
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    lines = {i: [x for x in (t or "").split("\n") if split(x)] for i, _, t in rows}
    norm = lambda x: " ".join(split(x.translate(low)))
    texts, held = defaultdict(set), defaultdict(set)
    for i, h, t in rows:
        if split(t):
            texts[h].add(t)
        for x in lines[i]:
            held[h, norm(x)].add(t)
    common = {k for k, v in held.items() if len(v) > max(least, share * len(texts[k[0]]))}
    out = {}
    for i, h, t in rows:
        w = split(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lost = sum(len(split(x)) for x in lines[i] if (h, norm(x)) in common)
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines[i]) - len(set(lines[i])), len(covered), lost, lost > 0 and (lost > len(w) * quality.DEPLETED or len(w) - lost < left))
    return out


ROWS = [
    (1, "a", "One two three.\nFooter 12 of HOST\nmore words stand here é ü"),
    (2, "a", "Other text # with * symbols\n  footer  34 of host\nand a line\nand a line"),
    (3, "a", "Footer 99 of host"),
    (4, "a", "footer 77 of host\nx"),
    (5, "b", "Footer 12 of HOST\nand more"),
    (6, None, "a b c d a b c e a b c"),
    (7, None, None),
    (8, "a", ""),
    (9, "a", " \n\t\n"),
    (9, "a", " \n\t\n"),
    (10, None, "word " * 5000),
    (11, "a", "Lone text of some length with odd blanks\nfooter 5 of host"),
    (12, "a", "Lone text of some length with odd blanks\nfooter 5 of host"),
    (13, "c", "copied\nall over"),
] + [(20 + k, "c", "copied\nall over") for k in range(30)]


def test_judge_equals_a_plain_version(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, source string, text string, n_words string")
    assert {r.doc_id for r in quality.judge(df, ["doc_id"], share=0.2, least=2, left=11).collect() if r.depleted} == {k for k, v in plain(ROWS, 0.2, 2, 11).items() if v[-1]} == {1, 3, 4}
    out = quality.judge(df, ["doc_id"], share=0.2, least=2, left=0)
    want = plain(ROWS, 0.2, 2)
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_common_words, r.depleted) == want[r.doc_id], r
    assert {r.doc_id for r in got if r.depleted} == {3, 4}


def test_without_common_lines(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, source string, text string, row string")
    got = {r.doc_id: r for r in quality.without_common_lines(df, share=0.2, least=2, left=0).collect()}
    assert set(got) == {r[0] for r in ROWS} - {3, 4}
    assert got[1].text == "One two three.\nmore words stand here é ü" and got[1].row == "x"
    assert got[5].text == "Footer 12 of HOST\nand more" and got[7].text is None


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert quality.judge(empty, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        quality.judge(empty.withColumnRenamed("doc_id", "n_words"), ["n_words"])


@pytest.mark.parametrize("n", [0, 2, 3, 7, 40])
def test_repeated_words_of_small_alphabets(n):
    words = [b"abca"[k * k % 4 : k * k % 4 + 1] for k in range(n)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    assert quality.repeated_words(words) == len({k + d for k in range(n - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)})
