import math
import re
import zlib

import numpy as np
import pytest

from siltstone.llm.quality import NAMES, Model, Rule, accepted, fit, learn, learned, op1_rule_ensemble, with_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op1_rule_ensemble(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    pos = np.array([r.score for r in rows if r.quality == 1])
    neg = np.array([r.score for r in rows if r.quality == 0])
    assert (pos[:, None] > neg[None, :]).mean() > 0.98
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_rules_are_sparse_and_compiled_exactly(spark):
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 8] <= 0.7)).astype(float)
    model = fit(x, y, list(NAMES))
    assert 0 < len(model.rules) < 120
    logit = np.full(len(x), model.intercept)
    for r in model.rules:
        hit = np.ones(len(x), bool)
        for n, upper, at in r.conditions:
            v = x[:, NAMES.index(n)]
            hit &= v <= at if upper else v > at
        logit += r.weight * hit
    assert ((logit > 0) == (y == 1)).mean() > 0.98
    df = spark.createDataFrame(x[:200].tolist(), [f"p{n}" for n in NAMES]).withColumn("i", __import__("pyspark").sql.functions.monotonically_increasing_id())
    got = [r.s for r in df.select("i", model.score("p").alias("s")).orderBy("i").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-logit[:200]))).tolist())


def statistics(text):
    """The statistics, written out in Python."""
    t = text or ""
    n, words, lines = len(t), re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")), t.split("\n")
    share = lambda p: len(re.findall(p, t)) / max(1, n)
    return (
        math.log1p(n), n / len(words), math.log1p(n / len(lines)), len(set(words)) / len(words), math.log1p(len(set(words))), len(set(lines)) / len(lines),
        share("[A-Z]"), share("[0-9]"), share(r"[#$%&*@^~<>{}\[\]\\/=_+]"), share(r"[|]"), share("[!?]"), share("[.,;:]"),
    )


def test_scores_of_the_whole_table(spark):
    """The query against statistics and rules worked out in Python, for the model that was learned."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = learned(spark, docs, sf)
    assert model.rules
    got = {r.doc_id: r for r in op1_rule_ensemble(spark, sf).collect()}
    for r in docs.collect():
        value = dict(zip(NAMES, statistics(r.text)))
        logit = model.intercept + sum(u.weight for u in model.rules if all((value[n] <= at) == upper for n, upper, at in u.conditions))
        want = 1 / (1 + math.exp(-logit))
        assert got[r.doc_id].score == pytest.approx(want), r.doc_id
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(got) == docs.count()


def test_repeated_ids_are_learned_from_once(spark):
    docs = [(k, ("good words " if k % 2 else "BAD!! ") * (k % 7 + 1)) for k in range(200)]
    labels = [(k, k % 2) for k in range(200)]
    schema = ("doc_id long, text string", "doc_id long, quality int")
    once = learn(spark.createDataFrame(docs, schema[0]), spark.createDataFrame(labels, schema[1]), sample_rows=150)
    often = learn(spark.createDataFrame(docs * 9, schema[0]), spark.createDataFrame(labels * 3, schema[1]), sample_rows=150)
    assert once == often and once.rules


def test_same_model_twice(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert learn(docs, labels) == learn(docs.repartition(5), labels.repartition(3))


def test_edges(spark):
    model = Model(0.5, (Rule((("upper", True, 0.5), ("log_chars", False, 1.0)), 2.0),))
    docs = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "UPPER ONLY"), (5, "a " * 50000), (6, " \n\t ")]
    df = spark.createDataFrame([(*d, 7.0, "s") for d in docs], "doc_id long, text string, SCORE double, _0 string")
    rows = with_quality(df, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == pytest.approx(1 / (1 + np.exp(-0.5)))
    assert by[3] == pytest.approx(1 / (1 + np.exp(-2.5))) and by[None] == by[1]
    kept = accepted(df, model, 0.9)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 5, 6} - ({6} if by[6] < 0.9 else set())
    assert with_quality(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert learn(df.drop("SCORE", "_0"), none) == Model(0.0, ())
    ones = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert learn(df.drop("SCORE", "_0"), ones).rules == ()
