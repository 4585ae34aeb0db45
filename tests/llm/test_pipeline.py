"""The pipeline as a whole on a small corpus."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    word = lambda letters="abcdefgh": "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    sent = lambda letters="abcdefgh": " ".join(word(letters) for _ in range(10)) + ". "
    other, third = "stuvwxyz", "ijklmnop"
    item = " ".join(word() for _ in range(30))
    passage = "".join(sent() for _ in range(6))
    rows = [(i, "".join(sent(["abcdefgh", other, third][i % 3]) for _ in range(8)), ["en", "de", "fr"][i % 3], "s", 1) for i in range(60)]
    mixed = "".join(sent(x) for x in ("abcdefgh", other, third) for _ in range(12))
    near = rows[5][1].split()
    near[3] = "other"
    rows += [
        (100, " ".join(near), "en", "s", 1),
        (101, rows[6][1], "en", "s", 1),
        (102, sent() * 1 + item + " " + sent(), "en", "s", 1),
        (103, None, "en", "s", 1),
        (104, "123 456", "en", "s", 1),
        (106, mixed, "en", "s", 1),
        (105, "".join(sent(other) for _ in range(4)), "en", "s", 1),
        (110, sent() + sent() + passage, "en", "s", 1),
        (111, sent() + sent() + passage, "en", "s", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in rows} - {100, 101, 102, 103, 104, 106}
    assert out[111].n_tokens < out[110].n_tokens
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    score = {r.doc_id: r.score for r in langid.predict(docs, model).collect()}
    assert all(score[i] > langid.LEAST_SCORE for i in range(60)) and score[106] < langid.LEAST_SCORE, score[106]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.sum("n_tokens")).first()[0] is None
