"""Parameter sweeps and multi-run experiments (X1-X6) as grouped plans.

Every variant of a sweep is a value of one group column ``g``: the variants'
points are stacked, one grouped kNN join builds all graphs, one grouped
propagation runs all of them (each group stops at its own convergence), and
one grouped evaluation scores them.  Sweeps over the neighbour counts build the
graph once at the largest ``k`` and keep ``rank <= k`` per variant.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedspread.operators import graph as G
from seedspread.operators import metrics as M
from seedspread.operators import sampling as S
from seedspread.operators.knn import knn_join
from seedspread.operators.predict import from_neighbors
from seedspread.operators.propagate import OfflineResult, offline_propagate
from seedspread.session import cut_lineage, materialize

GROUP = "g"


def run_variants(points_g: DataFrame, classes: Sequence[int], k_labeled: int, k_unlabeled: int,
                 max_iter: int, tol: float, edges_g: DataFrame | None = None) -> tuple[DataFrame, DataFrame, OfflineResult]:
    """Graph (unless given), propagation and evaluation for every group of ``points_g``.

    ``points_g``: ``(g, id, x, label, observed)``.  Returns (estimates ``(g, id, class, p)``,
    evaluation per group, the propagation's result with iterations and changes per group).
    """
    if edges_g is None:
        edges_g = G.build_graph(points_g.select(GROUP, "id", "x", "observed"), k_labeled, k_unlabeled, group_col=GROUP)
    trans = G.transitions(edges_g, group_col=GROUP)
    y_l = S.one_hot(points_g.where("observed"), "id", "label", classes, keep=[GROUP])
    unl = points_g.where(~F.col("observed")).select(GROUP, "id")
    res = offline_propagate(trans, y_l, unl, classes, max_iter=max_iter, tol=tol, group_col=GROUP)
    f = res.f
    s = F.sum(F.abs("p")).over(Window.partitionBy(GROUP, "id"))
    f = materialize(f.withColumn("p", F.coalesce(F.col("p") / F.nullif(s, F.lit(0.0)), F.lit(0.0))), "estimates")
    truth = points_g.where(~F.col("observed")).select("id", "label").distinct()
    ev = M.evaluate(f, truth, len(classes), group_col=GROUP)
    return f, ev, res


def sweep_neighbors(points: DataFrame, classes: Sequence[int], values: Sequence[int], which: str,
                    fixed_k: int, max_iter: int, tol: float) -> DataFrame:
    """X3 (``which='labeled'``) / X4 (``'unlabeled'``): kNN at the largest k once, ``rank <= k`` per value."""
    kmax = max(values)
    k_l, k_u = (kmax, fixed_k) if which == "labeled" else (fixed_k, kmax)
    edges = cut_lineage(G.build_graph(points.select("id", "x", "observed"), k_l, k_u))
    swept = F.col("dst_obs") if which == "labeled" else ~F.col("dst_obs")
    vals = F.explode(F.array(*[F.lit(int(v)) for v in values])).alias(GROUP)
    edges_g = edges.select(vals, *edges.columns).where(~swept | (F.col("rank") <= F.col(GROUP)))
    points_g = points.select(F.explode(F.array(*[F.lit(int(v)) for v in values])).alias(GROUP), *points.columns)
    _, ev, res = run_variants(points_g, classes, k_l, k_u, max_iter, tol, edges_g=edges_g)
    return _with_iters(ev, res.n_iter)


def sweep_test_errors(points: DataFrame, test: DataFrame, classes: Sequence[int], values: Sequence[int],
                      k_unlabeled: int, max_iter: int, tol: float, run_col: str | None = None) -> DataFrame:
    """X3 with a test set: per number of labelled neighbours the errors that M16 reports.

    ``(value, runtime, est_error, knn_error, combined_error)``: the error of the estimates
    of the unlabelled points, and of the kNN part and the combined prediction (P4) on
    ``test``.  One search, one graph and one propagation serve all values; ``runtime`` is
    the seconds they took together.  With ``run_col`` (an int column of ``points``) they serve
    all runs too, and the result has that column.
    """
    tic = time.time()
    kmax, run = max(values), "_run"
    points = points.withColumnRenamed(run_col, run) if run_col else points.withColumn(run, F.lit(0))
    points = points.withColumn(run, F.col(run).cast("long"))
    # a group is a value of a run
    places = F.explode(F.array(*[F.struct((F.col(run) * len(values) + n).alias(GROUP), F.lit(int(v)).alias("most")) for n, v in enumerate(values)])).alias("_at")
    each = lambda rows, *cols: rows.select(*cols, run, places).select(*cols, run, F.col(f"_at.{GROUP}").alias(GROUP), F.col("_at.most").alias("most"))
    edges = materialize(G.build_graph(points.select(run, "id", "x", "observed"), kmax, k_unlabeled, group_col=run), "edges")
    edges_g = each(edges, *[c for c in edges.columns if c != run]).where(~F.col("dst_obs") | (F.col("rank") <= F.col("most"))).drop("most", run)
    points_g = each(points, *[c for c in points.columns if c != run]).drop("most", run)
    f, ev, _ = run_variants(points_g, classes, kmax, k_unlabeled, max_iter, tol, edges_g=edges_g)
    kinds = {G.KIND_LABELED: kmax, G.KIND_UNLABELED: k_unlabeled}
    # every run has the same test rows
    runs = [r[0] for r in points.select(run).distinct().collect()]
    asked = test.select("id", "x", F.explode(F.array(*[F.lit(int(r)).cast("long") for r in runs])).alias(run))
    nn = materialize(knn_join(asked, G._kinded(points, run), kinds, kind_col="kind", group_col=run), "neighbors")
    nn_g = each(nn, *[c for c in nn.columns if c != run]).where((F.col("kind") != G.KIND_LABELED) | (F.col("rank") <= F.col("most")))
    y_l = S.one_hot(points.where("observed"), "id", "label", classes, keep=[run])
    p_knn, p_lp = from_neighbors(nn_g, each(asked, "id"), f, y_l, classes, group_col=GROUP, label_keys=[run])
    both = p_knn.withColumnRenamed("p", "pk").join(p_lp, [GROUP, "id", "class"])
    best = lambda p: F.min_by(F.col("class"), F.struct(-p, F.col("class")))
    pred = both.groupBy(GROUP, "id").agg(best(F.col("pk")).alias("knn"), best(F.col("pk") + F.col("p")).alias("combined"))
    miss = lambda c: F.avg((F.col(c) != F.col("label")).cast("double"))
    errors = pred.join(test.select("id", "label"), "id").groupBy(GROUP).agg(miss("knn").alias("knn_error"), miss("combined").alias("combined_error"))
    out = materialize(ev.select(GROUP, F.col("clf_error_mixed").alias("est_error")).join(errors, GROUP), "errors")
    value = F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col(GROUP) % len(values) + 1).cast("int")).cast("long").alias("value")
    found = [value, F.lit(time.time() - tic).alias("runtime"), "est_error", "knn_error", "combined_error"]
    return out.select(*([F.floor(F.col(GROUP) / len(values)).alias(run_col)] if run_col else []), *found)


def prefixes(points_g: DataFrame, steps: int, seed_of: Mapping[int, int]) -> DataFrame:
    """The runs of ``points_g`` as they fill up: group ``g * (steps + 1) + t`` holds the first ``t / steps`` of run ``g`` in its arrival order."""
    out = None
    for g, seed in seed_of.items():
        run = S.replay(points_g.where(F.col(GROUP) == g), "id", shuffle=True, seed=seed)
        size = run.count()
        t = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_t")
        part = run.select(*run.columns, t).where(F.col("pos") < F.ceil(F.lit(float(size)) * F.col("_t") / steps))
        part = part.withColumn(GROUP, F.col(GROUP) * (steps + 1) + F.col("_t")).drop("pos", "_t")
        out = part if out is None else out.unionByName(part)
    return out


def _with_iters(ev: DataFrame, iters: dict) -> DataFrame:
    spark = ev.sparkSession
    it = spark.createDataFrame([(int(k), int(v)) for k, v in iters.items()], f"{GROUP} long, n_iter int")
    return ev.join(it, GROUP, "left")


def sweep_masks(points_g: DataFrame, classes: Sequence[int], k_labeled: int, k_unlabeled: int,
                max_iter: int, tol: float) -> DataFrame:
    """One variant per mask (seed, label budget or label ratio)."""
    _, ev, res = run_variants(points_g, classes, k_labeled, k_unlabeled, max_iter, tol)
    n_lab = points_g.groupBy(GROUP).agg(F.count_if("observed").alias("n_labeled"))
    return _with_iters(ev, res.n_iter).join(n_lab, GROUP)


def seeded_masks(points: DataFrame, seeds: Sequence[int], ratio: float) -> DataFrame:
    """The standard per-class mask for each run seed (``seed = 42 * run``), stacked by run."""
    parts = [S.mask_labels(points, "id", "label", ratio, s).withColumn(GROUP, F.lit(i).cast("long"))
             for i, s in enumerate(seeds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ratio_masks(points: DataFrame, ratios: Sequence[float], seed: int) -> DataFrame:
    """A uniform mask (D4) per stream label ratio, stacked by ratio index."""
    parts = [S.uniform_mask(points, "id", r, seed).withColumn(GROUP, F.lit(i).cast("long")) for i, r in enumerate(ratios)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def budget_masks(points: DataFrame, budgets: Sequence[int], n_labeled_per_class: int, ratio_labeled: float,
                 seed: int) -> DataFrame:
    """Burn-in split + label budget (D2 + D8) per labels-per-class value, stacked by value."""
    burn = cut_lineage(S.burn_in_split(points, "id", "label", n_labeled_per_class, ratio_labeled, seed))
    parts = []
    for b in budgets:
        rest = S.label_budget(burn, "id", "label", b, seed)
        m = burn.where("burn_in").unionByName(rest.select(*burn.columns))
        parts.append(m.drop("burn_in", "burn_rank").withColumn(GROUP, F.lit(int(b)).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
