"""Golden micro-graphs A and B (FIXTURES.md §3, §4): offline and local propagation, prediction."""

import pytest
from pyspark.sql import functions as F

from conftest import points_df
from seedspread.operators import graph as G
from seedspread.operators import sampling as S
from seedspread.operators.predict import predict_proba
from seedspread.operators.propagate import hop_cap, normalize_l1, offline_propagate, propagate_local

CLASSES = [0, 1]
A_STORED = [(1, [0.0], 0), (2, [2.0], 1), (11, [0.5], None), (12, [1.5], None), (13, [1.2], None)]


def class0(f):
    return {r["id"]: r["p"] for r in f.where(F.col("class") == 0).collect()}


def fit(spark, rows, k=2):
    pts = points_df(spark, rows)
    edges = G.build_graph(pts.select("id", "x", "observed"), k, k)
    y_l = S.one_hot(pts.where("observed"), "id", "label", CLASSES)
    res = offline_propagate(G.transitions(edges), y_l, pts.where(~F.col("observed")).select("id"), CLASSES, tol=1e-3)
    return pts, edges, res


def insert(spark, pts, edges, f, row, theta, k=2):
    new = points_df(spark, [row])
    cols = ["id", "x", "observed"]
    edges2 = G.insert_nodes(edges, pts.select(*cols), new.select(*cols), k, k)
    all_pts = pts.unionByName(new)
    y_l = S.one_hot(all_pts.where("observed"), "id", "label", CLASSES)
    n_unl = all_pts.where(~F.col("observed")).count()
    out = propagate_local(G.transitions(edges2), y_l, f, new.select("id", "observed"), CLASSES, theta=theta,
                          max_hops=hop_cap(n_unl, k))
    return all_pts, edges2, out


def test_graph_a_edges(spark):
    pts, edges, _ = fit(spark, A_STORED)
    p = {(r["src"], r["dst"]): r["p"] for r in G.transitions(edges).collect()}
    expected = {(11, 1): 0.417653, (11, 2): 0.056523, (11, 13): 0.328538, (11, 12): 0.197286,
                (12, 2): 0.359555, (12, 1): 0.048661, (12, 13): 0.421942, (12, 11): 0.169842,
                (13, 2): 0.230181, (13, 1): 0.103427, (13, 12): 0.398961, (13, 11): 0.267432}
    assert set(p) == set(expected)
    for key, v in expected.items():
        assert p[key] == pytest.approx(v, abs=1e-6)


def test_graph_a_offline(spark):
    _, _, res = fit(spark, A_STORED)
    assert res.n_iter == 8
    assert res.residuals[-1] == pytest.approx(0.00091268, abs=1e-8)
    c0 = class0(normalize_l1(res.f))
    assert c0[11] == pytest.approx(0.610870, abs=1e-6)
    assert c0[12] == pytest.approx(0.319518, abs=1e-6)
    assert c0[13] == pytest.approx(0.394815, abs=1e-6)


def test_graph_a_insertions_and_prediction(spark):
    pts, edges, res = fit(spark, A_STORED)
    f = normalize_l1(res.f)
    pts, edges, out = insert(spark, pts, edges, f, (14, [1.0], None), theta=0.1)
    assert out.frontier_sizes[0] == 3 and out.applied_per_hop == [0]
    row14 = {r["class"]: r["p"] for r in out.f.where("id = 14").collect()}
    assert row14[0] == pytest.approx(0.494055, abs=1e-6) and row14[1] == pytest.approx(0.505945, abs=1e-6)
    # exact tie: 14 keeps 13 and 11 (11 and 12 are both at 0.25, smaller id wins)
    uu14 = sorted(r["dst"] for r in edges.where("src = 14 AND NOT dst_obs").collect())
    assert uu14 == [11, 13]
    pts, edges, out = insert(spark, pts, edges, out.f, (3, [1.1], 1), theta=0.1)
    assert out.applied_per_hop == [4, 4]
    c0 = class0(out.f)
    for i, v in {11: 0.427056, 12: 0.154666, 13: 0.172273, 14: 0.312090}.items():
        assert c0[i] == pytest.approx(v, abs=1e-6)
    # predict x = 0.9 against the final state
    q = spark.createDataFrame([(100, [0.9])], "id long, x array<double>")
    y_l = S.one_hot(pts.where("observed"), "id", "label", CLASSES)
    pair = predict_proba(q, pts, out.f, y_l, CLASSES, 2, 2, mode="pair").collect()
    knn = {r["class"]: r["p_knn"] for r in pair}
    comb = {r["class"]: r["p_combined"] for r in pair}
    assert knn[0] == pytest.approx(0.316479, abs=1e-6) and knn[1] == pytest.approx(0.683521, abs=1e-6)
    assert comb[0] == pytest.approx(0.561455, abs=1e-6) and comb[1] == pytest.approx(1.438545, abs=1e-6)
    lp = {r["class"]: r["p"] for r in predict_proba(q, pts, out.f, y_l, CLASSES, 2, 2, mode="lp").collect()}
    assert lp[0] == pytest.approx(0.244976, abs=1e-6) and lp[1] == pytest.approx(0.755024, abs=1e-6)


B_STORED = [(1, [0.0], 0), (2, [4.0], 1), (11, [0.6], None), (12, [1.1], None), (13, [1.75], None),
            (14, [2.3], None), (15, [2.9], None), (16, [3.6], None)]
B_OFFLINE = {11: 0.829231, 12: 0.762549, 13: 0.576283, 14: 0.387847, 15: 0.215853, 16: 0.123523}
B_EXPECTED = {
    0.05: ([.829231, .715586, .503593, .453894, .267377, .123523, .479203],
           [.829231, .821691, .775831, .765246, .544648, .302105, .770047]),
    0.2: ([.829231, .762549, .452131, .506652, .215853, .123523, .479203],
          [.829231, .762549, .772054, .769754, .469032, .306338, .770413]),
    2.0: ([.829231, .762549, .576283, .387847, .215853, .123523, .479203],
          [.829231, .762549, .576283, .387847, .215853, .123523, .479203]),
}


def test_graph_b_offline(spark):
    _, _, res = fit(spark, B_STORED)
    assert res.n_iter == 15
    assert res.residuals[-1] == pytest.approx(0.0009176, abs=1e-7)
    c0 = class0(normalize_l1(res.f))
    for i, v in B_OFFLINE.items():
        assert c0[i] == pytest.approx(v, abs=1e-6)


@pytest.mark.parametrize("theta", [0.05, 0.2, 2.0])
def test_graph_b_theta(spark, theta):
    pts, edges, res = fit(spark, B_STORED)
    f = normalize_l1(res.f)
    ids = [11, 12, 13, 14, 15, 16, 17]
    after17, after3 = B_EXPECTED[theta]
    pts, edges, out = insert(spark, pts, edges, f, (17, [2.05], None), theta)
    c0 = class0(out.f)
    assert [round(c0[i], 6) for i in ids] == pytest.approx(after17, abs=1e-6)
    pts, edges, out = insert(spark, pts, edges, out.f, (3, [2.2], 0), theta)
    c0 = class0(out.f)
    assert [round(c0[i], 6) for i in ids] == pytest.approx(after3, abs=1e-6)


def test_hop_cap():
    assert hop_cap(243, 3) == 4          # float formula, as the reference computes it
    assert hop_cap(4, 2) == 2
    assert hop_cap(10, 1, max_iter=30) == 30
    assert hop_cap(2, 3) == 0


def test_an_iteration_shuffles_no_edge_and_salts_hubs(spark, monkeypatch):
    """L2: the graph is bucketed by the node that edges point at; hubs lie in several buckets; same result."""
    from seedspread.operators import propagate as P

    n = 60
    edges = [(i, 0, False, 0.5) for i in range(1, n)] + [(i, i % 7 + 1, False, 0.25) for i in range(8, n)] + [(i, 1000, True, 0.25) for i in range(1, n)]
    trans = spark.createDataFrame(edges, "src long, dst long, dst_obs boolean, p double")
    y = spark.createDataFrame([(1000, 0, 1.0), (1000, 1, 0.0)], "id long, class int, p double")
    ids = spark.range(n).withColumnRenamed("id", "id")
    runs = {}
    for hub in (100_000, 10):
        monkeypatch.setattr(P, "HUB_EDGES", hub)
        res = P.offline_propagate(trans, y, ids, [0, 1], max_iter=6, tol=0.0)
        runs[hub] = sorted((r["id"], r["class"], round(r["p"], 12)) for r in res.f.collect())
    assert runs[10] == runs[100_000] and len(runs[10]) == 2 * n
    many = list(range(150))  # more classes than a wide row has columns
    y150 = spark.createDataFrame([(1000, c, float(c == 149)) for c in many], "id long, class int, p double")
    wide = {(r["id"], r["class"]): r["p"] for r in P.offline_propagate(trans, y150, ids, many, max_iter=1).f.collect()}
    assert len(wide) == 150 * n and wide[5, 149] == pytest.approx(0.25 + 0.5 / 150) and wide[5, 3] == pytest.approx(0.5 / 150)

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        graph = P._Graph(trans.where("not dst_obs"), [])
        f = spark.createDataFrame([(i, 0, 0.5, 0.5) for i in range(n)], "id long, chunk int, c0 double, c1 double")
        plan = P._step(graph, f, f, ["id"], ["c0", "c1"])._jdf.queryExecution().executedPlan().toString()
        scan = next(k for k, x in enumerate(plan.splitlines()) if graph.name in x)
        join = max(k for k, x in enumerate(plan.splitlines()[:scan]) if "Join" in x)
        assert not any("Exchange" in x for x in plan.splitlines()[join:scan]), plan
        graph.drop()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_iteration_shuffles_only_the_products(spark):
    """L2: the static part and the iterates lie in buckets by id, like the graph's by the nodes pointed at: the products are shuffled, once."""
    from seedspread.operators import propagate as P
    from seedspread.session import buckets_kept

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    trans = spark.range(400).selectExpr("id % 2 as g", "id as src", "(id * 7 + 2) % 400 as dst", "0.5D as p")
    graph = P._Graph(trans, ["g"])
    rows = [(i % 2, i, 0, 0.5, 0.25) for i in range(400)] + [(0, None, 0, 0.5, 0.25)]
    f = spark.createDataFrame(rows, "g long, id long, chunk int, c0 double, c1 double")
    held = [graph.stored(graph.placed(f), n) for n in ("static", "estimates")]
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        with buckets_kept(spark):
            step = P._step(graph, held[0].rows(), held[1].rows(), ["g", "id"], ["c0", "c1"])
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan, plan
            got = {(r["g"], r["id"]): (r["c0"], r["c1"], r["d"]) for r in step.collect()}
        # the row without an id is one row, which nothing points at
        assert got == {(i % 2, i): (0.75, 0.375, 0.25) for i in range(400)} | {(0, None): (0.5, 0.25, 0.0)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        for x in (*held, graph):
            x.drop()
