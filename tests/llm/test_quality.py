"""Operator 12: risk, prior, calibration and held-out accuracy."""

import numpy as np

from tickflow.llm import quality as q
from tickflow.llm.registry import QUERIES


def test_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.7):
        positive, held = rng.normal(1.5, 1, (1000, 3)), rng.normal(1.5, 1, (1000, 3))
        bad = rng.normal(-1.5, 1, (int(3000 * (1 - prior)), 3))
        unlabelled = np.r_[rng.normal(1.5, 1, (int(3000 * prior), 3)), bad]
        scores = lambda x: x.sum(axis=1)
        assert abs(q.estimated_prior(scores(held), scores(unlabelled)) - prior) < 0.06
        w = q.non_negative_risk(positive, unlabelled, prior)
        assert ((np.c_[held, np.ones(len(held))] @ w) > 0).mean() > 0.97
        assert ((np.c_[bad, np.ones(len(bad))] @ w) < 0).mean() > 0.97


def test_negatives_only_calibrate():
    """The direction of the weights comes from positives and unlabelled rows: other negatives leave it as it is."""
    rng = np.random.default_rng(2)
    good, web = rng.normal(1, 1, (300, q.FEATURES)), rng.normal(0, 1, (600, q.FEATURES))
    one, other = (q.fit(good, web, rng.normal(m, 1, (100, q.FEATURES)), 0.5) for m in (-1, 3))
    assert (one.weights == other.weights).all() and one.prior == other.prior


def test_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").collect()}
    rows = QUERIES["op12_quality"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in judged if y == 1], [s for s, _, y in judged if y == 0]
    assert np.mean([p == y for _, p, y in judged]) >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_labels_lang_and_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(k, ("good words in a row. " if k % 3 else "XX!! ##%% ") * (5 + k % 7), "en", "a") for k in range(300)], "doc_id bigint, text string, lang string, label string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)], "doc_id bigint, quality int")
    held = q.held_out("doc_id", 5, 0)
    from pyspark.sql import functions as F

    swapped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    run = lambda d, l: sorted(map(tuple, q.quality(d, l).collect()))  # noqa: E731, E741
    assert run(docs, labels) == run(docs.drop("lang").withColumn("lang", F.lit("x")), swapped)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in q.quality(docs, labels).where("held_out").collect())


def test_nulls_empty_long_repeated_rows_and_nothing_to_learn(spark):
    rows = [(1, None), (2, ""), (None, "text"), (None, "text"), (3, "a " * 500_000), (4, " \n\n "), (4, "퟿😀"), (5, "x")]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id bigint, text string, score double, id int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert sorted(r.score for r in q.quality(docs, none).collect()) == [0.0] * len(rows)
    only = spark.createDataFrame([(k, 1) for k in (1, 2, 3, None)], "doc_id bigint, quality int")
    assert {r.score for r in q.quality(docs, only).collect()} == {1.0}
    assert q.quality(docs.where("false"), none).count() == 0
