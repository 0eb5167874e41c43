"""Many learners in one stream: each variant ends as a learner of its own does; replays change nothing."""

import numpy as np
from pyspark.sql import functions as F

from seedspread.session import scratch_dir
from seedspread.streaming.learner import LearnerConfig, StreamLearner
from seedspread.streaming.variants import POINT_SCHEMA, VariantConfig, VariantLearner

THETAS = {0: (0, 0.4), 1: (1, 0.1)}


def runs():
    """Two graphs over the same points, with different orders and labels; 14 rows of burn-in, two batches."""
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(13, 2)), draw.normal(size=(13, 2)) + 2.0])
    rows = []
    for g in (0, 1):
        order = np.random.default_rng(g).permutation(26)
        rows += [(g, seq, int(i), x[i].tolist(), int(i >= 13), bool((i + seq + g) % 3 == 0)) for seq, i in enumerate(order.tolist())]
    return rows


def table(rows):
    return {(r["id"], r["class"]): r["p"] for r in rows.collect()}


def test_variants_equal_single_learners(spark):
    rows = runs()
    everything = spark.createDataFrame(rows, POINT_SCHEMA)
    steps = [everything.where(f"seq >= {a} and seq < {b}") for a, b in ((0, 10), (10, 18), (18, 26))]
    test = spark.createDataFrame([(100, [0.1, 0.0], 0), (101, [2.0, 2.1], 1)], "id long, x array<double>, label int")
    truth = everything.where("g = 0").select("id", "label")
    common = dict(classes=[0, 1], k_labeled=2, k_unlabeled=2, n_burn_in=14)
    many = VariantLearner(spark, scratch_dir(spark, "variants"), VariantConfig(**common, run="many", thetas=THETAS), truth=truth, test=test)
    for b, step in enumerate(steps):
        many.process(step, b)
    many.process(steps[2].unionByName(steps[2]), 2)  # a replay of the last batch, its rows twice
    f = many.estimates(2)
    for v, (g, theta) in THETAS.items():
        one = StreamLearner(spark, scratch_dir(spark, "single"), LearnerConfig(**common, theta=theta, run=f"v{v}"), truth=truth, test=test)
        for b, step in enumerate(steps):
            one.process(step.where(F.col("g") == g).drop("g"), b)
        want, got = table(one.estimates(2)), table(f.where(F.col("v") == v))
        assert want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-9
        errors = {r["metric"]: r["score"] for r in one.finish().collect()}
        mine = many.finish().where(F.col("v") == v).first()
        assert mine["error_knn"] == errors["test_error_knn"] and mine["error_combined"] == errors["test_error_combined"]
    series = many.series().where("metric = 'n_labeled'").select("v", "batch_id").collect()
    assert sorted(map(tuple, series)) == [(v, b) for v in THETAS for b in (1, 2)]  # the burn-in ends in the second batch
    assert many.points(2).count() == len(rows) and many.points(2).where("not observed and label is not null").count() == 0
