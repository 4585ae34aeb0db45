"""Shared text handling, language, toxicity, BPE, sharding."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, langid, sharding, toxicity
from lattica.llm.textbytes import blocks, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SAMPLES = {"xx": "kaka koko rika tako kiri", "yy": "lulu melo numo lumi enol"}


def made(lang: str, n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(n))


def test_words_and_shingles_match_plain_python():
    rng = random.Random(1)
    texts = ["", "  ", "One", "a B\tc\nd\x0be\x0cf\rg", "é é É\u00a0x", "x " * 900] + [" ".join(rng.choice("ab cd Ef g".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    column = pa.array(texts + [None])
    seen, names = 0, {}
    for limit in (8, 1 << 20):
        sizes = []
        for block in blocks(column.slice(0), limit):
            w = words(block)
            for t in range(block.n):
                raw = (column[block.first + t].as_py() or "").encode().lower().split()
                own = w.hashes[w.bounds[t] : w.bounds[t + 1]]
                assert len(own) == len(raw)
                for h, word in zip(own, raw, strict=True):
                    assert names.setdefault(int(h), word) == word
                    seen += 1
            sets, first = shingles(w, 3)
            sizes += np.diff(first).tolist()
        want = []
        for t in texts + [""]:
            x = t.encode().lower().split()
            want.append(len({tuple(x[i : i + 3]) for i in range(len(x) - 2)} or ({tuple(x)} if x else set())))
        assert sizes == want
    assert len(set(names.values())) == len(names) and seen


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, made(lang, 30, rng), lang, "s", 1) for i in range(80) for lang in [["xx", "yy"][i % 2]]]
    model = langid.learn(spark.createDataFrame(rows, DOCS))
    assert model.langs == ["xx", "yy"]
    probe = [(1, made("xx", 4000, rng)), (2, made("yy", 9, rng)), (3, None), (4, ""), (5, "123 -- 5"), (None, made("yy", 50, rng)), (2, made("yy", 9, rng)), (6, "——")]
    got = langid.predict(spark.createDataFrame(probe, "doc_id long, text string").withColumn("lang_pred", F.lit("zz")), model).collect()
    assert len(got) == len(probe)
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "yy")}
    assert all(0 <= r.score <= 1 for r in got)
    mixed = " ".join(made("xx", 1, rng) + " " + made("yy", 1, rng) for _ in range(90))
    docs = spark.createDataFrame([*probe, (7, mixed)], "doc_id long, text string").withColumn("score", F.lit("s"))
    kept = langid.keep_identified(docs, model, least_score=0.8)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 2, None, 2]
    assert {r.doc_id for r in langid.keep_identified(docs, model, languages=("xx",)).collect()} - {7} == {1}
    assert [r.doc_id for r in langid.keep_identified(docs, None).collect()] == [1, 2, None, 2, 7]
    assert langid.keep_identified(docs.limit(0), model).count() == 0 and langid.predict(docs.limit(0), model).count() == 0


def test_samples_are_bounded_by_rows(spark):
    rows = [(1, "abc def " * 40, "xx", "s", 1)] * 300 + [(i, f"abc {i} def", "xx", "s", 1) for i in range(2, 60)] + [(1, "abc def", "yy", "s", 1)]
    windows = langid.training_windows(spark.createDataFrame(rows, DOCS), 5, 1)
    assert sum(lang == "xx" for lang, _ in windows) <= 5 and sum(lang == "yy" for lang, _ in windows) == 1
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    assert len(toxicity._sampled(docs, 7, 1)) <= 7
    assert toxicity._sampled(docs.limit(0), 7, 1) == []


def test_language_gradients():
    rng = np.random.default_rng(0)
    nets = [langid.Gru(*(rng.normal(size=s).astype(np.float64) for s in ((257, 6), (4, 2), (2, 2)))) for _ in range(2)]
    for net in nets:
        net.e[langid.PAD] = 0
    out = rng.normal(size=(3, 5))
    x = rng.integers(97, 123, (7, 4)).astype(np.intp)
    x[5:, 1] = langid.PAD
    label = np.array([0, 1, 2, 1])

    def loss() -> float:
        p = langid.positions(langid.Model(["a", "b", "c"], nets[0], nets[1], out), x)
        weight = langid.LETTER[x]
        return float(-(np.log(p[:, label, np.arange(4)]) * weight).sum() / weight.sum())

    grads = langid._gradients(nets, out, x, label)
    params = [p for net in nets for p in (net.e, net.u, net.v)] + [out]
    for p, g in zip(params, grads, strict=True):
        rows = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[rows]
        p[rows] = old + 1e-3
        up = loss()
        p[rows] = old - 1e-3
        down = loss()
        p[rows] = old
        assert abs((up - down) / 2e-3 - g[rows]) < 5e-3


def test_language_without_labels(spark):
    assert langid.learn(spark.createDataFrame([(1, "abc", None, None, None), (2, None, "xx", None, None)], DOCS)) is None
    got = langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["vile", "grim", "foul"]

    def text(toxic: bool) -> str:
        own = ["".join(rng.choice("abcdef") for _ in range(2)) for _ in range(40)]
        return " ".join(own[:20] + ([rng.choice(bad) + "!" for _ in range(3)] if toxic else []) + own[20:])

    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 1) if i % 3] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    more = [(1, text(True)), (2, text(False)), (3, None), (4, ""), (5, (text(False) + " ") * 50), (None, text(True)), (1, text(True))]
    got = toxicity.score(spark.createDataFrame(more, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.predicted) for r in got] == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (None, 1), (1, 1)]
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == bool(r.predicted) for r in got)
    none = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert none is None and toxicity.score(docs.limit(3), none).agg(F.sum("score")).first()[0] == 0


def test_toxicity_non_negative_risk():
    """Positives hidden in the unlabelled texts do not pull the scorer down."""
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(100, 160, 10), 7)) for _ in range(60)]
    unl = [np.unique(np.append(rng.integers(100, 160, 10), 7 if i % 4 == 0 else 8)) for i in range(240)]
    model = toxicity.train(pos, unl, 0.25)
    assert dict(zip(model.used, model.weights, strict=True))[7] > 1 and 8 not in model.used
    f, first = np.array([7, 8, 120]), np.array([0, 1, 2, 3])
    a, b, _ = model.scores(model.margins(f, first))
    assert a > 0.7 > b


def test_toxicity_gradient():
    rng = np.random.default_rng(4)
    m = rng.normal(size=30)
    is_pos = np.arange(30) < 10
    seen = set()
    for prior, shift in ((0.1, 0.0), (0.9, np.where(is_pos, 3.0, -3.0))):
        own = m + shift
        _, bracket, slope = toxicity.risk(own, is_pos, ~is_pos, prior)
        seen.add(bracket >= 0)

        def goal(x, sign=bracket >= 0, prior=prior):
            right, bracket, _ = toxicity.risk(x, is_pos, ~is_pos, prior)
            return right + bracket if sign else -bracket

        for i in range(30):
            step = np.zeros(30)
            step[i] = 1e-5
            assert abs((goal(own + step) - goal(own - step)) / 2e-5 - slope[i]) < 1e-6
    assert seen == {True, False}
    assert toxicity.best_cut(np.array([5.0, 4.0, 3.0, 0.0, 0.0, 4.5]), 3, 0.3)[0] < 3


def test_toxicity_on_held_out_rows(spark):
    """Insults with many endings, few of each: unseen texts are found, clean ones are not."""
    rng = random.Random(12)
    part = lambda: "".join(rng.choice("abcdefgh") for _ in range(2))
    ends = [part() + part() for _ in range(40)]

    def text(toxic: bool) -> str:
        own = [part() + part() for _ in range(30)]
        return " ".join(own[:9] + (["zuvi" + rng.choice(ends) for _ in range(3)] if toxic else []) + own[9:])

    rows = [(i, text(i % 8 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs.filter("doc_id < 600"), labels.filter("doc_id < 600"))
    got = toxicity.score(docs.filter("doc_id >= 600"), model).collect()
    toxic = [r.predicted for r in got if r.doc_id % 8 == 0]
    clean = [r.predicted for r in got if r.doc_id % 8]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs.limit(0), labels) is None and toxicity.learn(docs, labels.limit(0)) is None



def test_bpe_random(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = " \t\n\x0babcXYZ'sé\u0301ßΣσİıﬁ日1²½_-.…\u00a0\u2003\u200b🙂\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    for bits in (1, 3):
        encoder = bpe.Encoder(path)
        old = bpe.cuts.__defaults__
        bpe.cuts.__defaults__ = (bits,)
        try:
            for block in blocks(pa.array(texts)):
                for text, (n, ids, tokens) in zip(texts, encoder.block(block), strict=True):
                    want = tok.encode(text, add_special_tokens=False).ids
                    assert ids == " ".join(map(str, want)), text
                    assert tokens == tok.decode(want, skip_special_tokens=False)
        finally:
            bpe.cuts.__defaults__ = old


def test_bpe_frames(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Some text", 5), (2, None, None), (1, "Some text", 5)], "doc_id long, text string, n_tokens long")
    full = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.encode(docs, path).collect()}
    short = bpe.digests(docs, path).collect()
    assert len(short) == 3 and (2, 0, (), "") in full
    for r in short:
        _, n, ids, decoded = next(x for x in full if x[0] == r.doc_id)
        assert r.n_tokens == n and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_sharding(spark):
    rows = [(i, f"t{i % 50}") for i in range(4000)] + [(77, "t")] * 900 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, row string").repartition(7)
    a = sharding.assign_shards(df, "doc_id", [1.0] * 40)
    both = sharding.assign_shards(a, "doc_id", [1.0] * 41, "grown")
    got = sharding.number_slots(both).collect()
    assert len(got) == len(rows)
    slots: dict[int, list[int]] = {}
    for r in got:
        assert r.grown in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    moved = len({r.doc_id for r in got if r.grown == 40})
    assert 40 < moved < 180
    assert sharding.number_slots(both.limit(0)).count() == 0


def test_sharding_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = {r.shard: r["count"] for r in sharding.assign_shards(df, "k", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.72 < n[1] / 20000 < 0.78
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), [1.0, 0.0])


def test_crc_is_of_the_text(spark):
    from lattica.llm.sampling import crc_share

    got = spark.createDataFrame([(123,)], "doc_id long").select(crc_share("doc_id", 4)).first()[0]
    assert got == zlib.crc32(b"123") % 4


@pytest.mark.parametrize("kind", ["decoder", "byte level", "prefix space", "no pattern", "greedy added token"])
def test_bpe_refuses_what_it_cannot_encode_by_words(spark, tmp_path, kind):
    from tokenizers import AddedToken, models, pre_tokenizers

    if kind in ("decoder", "byte level"):
        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        if kind == "byte level":
            tok.decoder = None
    else:
        letters = " ▁abcdehlmnotwxyz!.,0123456789"
        tok = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(letters)}, merges=[], unk_token=None))
        if kind == "prefix space":
            tok.pre_tokenizer = pre_tokenizers.Metaspace()
        if kind == "greedy added token":
            tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            tok.add_tokens([AddedToken("ab", lstrip=True)])
    path = str(tmp_path / "tokenizer.json")
    tok.save(path)
    docs = spark.createDataFrame([(1, "hello world this")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode(docs, path)
