"""Local propagation with wide rows in buckets, and the runs of a swept report in one job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedspread.operators import propagate as P
from seedspread.operators.sweep import seeded_masks, sweep_test_errors


def hops_of(p_ul, p_uu, y, f, new, theta, cap):
    """L5-L10 with dense matrices: estimates of all unlabelled nodes, hops and applied changes per hop."""
    f, static, n = f.copy(), p_ul @ y, len(p_uu)
    f[new] = 1.0 / y.shape[1]
    f[new] = (static + p_uu @ f)[new]
    front = (p_uu[:, new] > 0).any(axis=1)
    cur, tent, ever, applied = f.copy(), np.where(front[:, None], static + p_uu @ f, f), np.zeros(n, bool), []
    while front.any() and len(applied) < cap:
        go = front & (np.abs(tent - cur).sum(axis=1) > theta)
        d = (tent - cur) * go[:, None]
        cur[go] = tent[go]
        ever |= go
        tent = tent + p_uu @ d
        front = (p_uu[:, go] > 0).any(axis=1)
        applied.append(int(go.sum()))
    ever[new] = True
    cur = np.where(ever[:, None], cur, f)
    cur[ever] /= np.abs(cur[ever]).sum(axis=1, keepdims=True)
    return cur, len(applied), applied


@pytest.mark.parametrize("n_classes", [3, 70])
def test_a_hop_shuffles_only_its_products_and_keeps_a_row_per_node(spark, monkeypatch, n_classes):
    """The rows are wide (one per 64 classes), the touched rows and F lie in buckets by id: with one chunk nothing else is shuffled."""
    draw, n, n_l = np.random.default_rng(n_classes), 30, 6
    y = np.eye(n_classes)[draw.integers(0, n_classes, n_l)]
    p_uu, p_ul = np.zeros((n, n)), np.zeros((n, n_l))
    for i in range(n):
        p_uu[i, draw.choice([j for j in range(n) if j != i], 2, replace=False)] = (0.3, 0.4)
        p_ul[i, draw.integers(0, n_l)] = 0.3
    f = draw.dirichlet(np.ones(n_classes), n)
    new, groups = [3, 17], {0: (0.02, 4), 1: (0.3, 2)}
    trans = spark.createDataFrame([(g, int(i), int(j), False, float(p_uu[i, j])) for g in groups for i, j in zip(*np.nonzero(p_uu.astype(bool)))]
                                  + [(g, int(i), 100 + int(j), True, float(p_ul[i, j])) for g in groups for i, j in zip(*np.nonzero(p_ul))], "g long, src long, dst long, dst_obs boolean, p double")
    long = lambda rows, first: [(g, first + i, c, float(v)) for g in groups for i, row in enumerate(rows) for c, v in enumerate(row)]
    y_l, stored = (spark.createDataFrame(long(rows, first), "g long, id long, class int, p double") for rows, first in ((y, 100), (f, 0)))
    stored = stored.where(~F.col("id").isin(new))
    arrived = spark.createDataFrame([(g, i, False) for g in groups for i in new], "g long, id long, observed boolean")
    plans, kept = [], P._Graph.stored

    def spied(graph, rows, name):
        if name == "touched":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        table = kept(graph, rows, name)
        assert table.rows().count() <= len(groups) * n * -(-n_classes // P.WIDTH)
        return table

    monkeypatch.setattr(P._Graph, "stored", spied)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        out = P.propagate_local(trans, y_l, stored, arrived, list(range(n_classes)), theta={g: t for g, (t, _) in groups.items()},
                                max_hops={g: c for g, (_, c) in groups.items()}, group_col="g")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(plans) > 2
    if n_classes <= P.WIDTH:
        assert all(plan.count("Exchange") == 1 for plan in plans[1:]), plans[1]
    got = {(r["g"], r["id"], r["class"]): r["p"] for r in out.f.collect()}
    assert len(got) == len(groups) * n * n_classes
    for g, (theta, cap) in groups.items():
        want, hops, applied = hops_of(p_ul, p_uu, y, f, new, theta, cap)
        assert (out.hops[g], out.applied_per_hop[g]) == (hops, applied)
        assert max(abs(got[g, i, c] - want[i, c]) for i in range(n) for c in range(n_classes)) < 1e-9


def test_runs_of_a_swept_report_share_a_job(spark):
    """One search, graph and propagation for all runs gives what each run gives alone."""
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=2) + 2.0 * (i % 2)).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    train, test = df.where("id < 45"), df.where("id >= 45")
    masks = seeded_masks(train, [0, 42], 0.3).cache()
    cols = ("value", "est_error", "knn_error", "combined_error")
    together = {(r["g"], r["value"]): [r[c] for c in cols[1:]] for r in sweep_test_errors(masks, test, [0, 1], (1, 3), 2, 20, 1e-3, run_col="g").collect()}
    assert len(together) == 4
    alone = sweep_test_errors(masks.where("g = 1").drop("g"), test, [0, 1], (1, 3), 2, 20, 1e-3).collect()
    assert [set(together), {r["value"] for r in alone}] == [{(g, v) for g in (0, 1) for v in (1, 3)}, {1, 3}]
    for r in alone:
        assert together[1, r["value"]] == pytest.approx([r[c] for c in cols[1:]], abs=1e-12)
