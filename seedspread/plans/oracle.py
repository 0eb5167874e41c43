"""DuckDB SQL for the named queries (the correctness oracle).

Written independently of the Spark code: plain window functions, self-joins on the
pair distance, and the propagation unrolled as a chain of CTEs (the iteration
count is chosen in SQL by the same tolerance rule).  Tables are the views the
checker registers: ``embeddings``, ``orders``, ``events``, ``part``, ``documents``,
``labels``.  Float literals are cast to DOUBLE (a bare ``0.29`` is DECIMAL in DuckDB).
"""

from __future__ import annotations

from seedspread.plans import catalog as C
from seedspread.plans import fixtures as X

D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def pts_sql() -> str:
    return "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"


def mask_sql(src: str, id_col: str, label: str, ratio: float, seed: int, salt: str = "", out: str = "observed") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:{salt}' || {id_col}), {id_col}) "
        f"<= floor(count(*) OVER (PARTITION BY {label}) * {_dbl(ratio)}) AS {out} FROM {src}"
    )


def masked_pts(seed: int = X.SEED, ratio: float = X.OBS_RATIO) -> str:
    """CTE body list: pts0 -> pts (id, x, label, observed)."""
    return f"pts0 AS ({pts_sql()}), pts AS ({mask_sql('pts0', 'id', 'label', ratio, seed)})"


def knn_sql(q: str, r: str, k: int, exclude_self: bool) -> str:
    cond = "a.id <> b.id" if exclude_self else "TRUE"
    return (
        f"SELECT src, dst, d2, CAST(rk AS INTEGER) AS rank FROM ("
        f"SELECT a.id AS src, b.id AS dst, {D2} AS d2, "
        f"row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rk FROM {q} a JOIN {r} b ON {cond}) WHERE rk <= {k}"
    )


def edge_out(src: str) -> str:
    return f"SELECT src, dst, round(d2, 6) AS d2, rank FROM {src}"


def graph_cte(pts: str = "pts", k_l: int = X.K_L, k_u: int = X.K_U) -> str:
    """edges (src, dst, dst_obs, d2, w, rank) from unlabelled sources; trans adds p."""
    return (
        f"pairs AS (SELECT a.id AS src, b.id AS dst, b.observed AS dst_obs, {D2} AS d2 "
        f"FROM {pts} a JOIN {pts} b ON a.id <> b.id WHERE NOT a.observed), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst_obs ORDER BY d2, dst) AS rk FROM pairs), "
        f"edges AS (SELECT src, dst, dst_obs, d2, exp(-d2) AS w, CAST(rk AS INTEGER) AS rank FROM ranked "
        f"WHERE rk <= CASE WHEN dst_obs THEN {k_l} ELSE {k_u} END), "
        f"trans AS (SELECT *, w / CASE WHEN sum(w) OVER (PARTITION BY src) < {_dbl(2.220446049250313e-16)} "
        f"THEN 1.0 ELSE sum(w) OVER (PARTITION BY src) END AS p FROM edges)"
    )


def classes_cte(pts: str = "pts") -> str:
    return f"classes AS (SELECT DISTINCT label AS class FROM {pts} WHERE label IS NOT NULL)"


def lp_cte(pts: str = "pts", max_iter: int = X.MAX_ITER, tol: float = X.TOL, prefix: str = "f") -> str:
    """Offline propagation unrolled: f0 uniform, f{i} = static + P_uu f{i-1}; fin = normalised
    estimate at the first iteration whose max change is below tol (else the last one)."""
    parts = [
        classes_cte(pts),
        f"nc AS (SELECT count(*) AS c FROM classes)",
        f"unl AS (SELECT id FROM {pts} WHERE NOT observed)",
        f"yl AS (SELECT p.id, c.class, CASE WHEN p.label = c.class THEN 1.0 ELSE 0.0 END AS y FROM {pts} p, classes c WHERE p.observed)",
        f"skel AS (SELECT u.id, c.class FROM unl u, classes c)",
        f"stat AS (SELECT s.id, s.class, coalesce(sum(t.p * y.y), 0.0) AS p FROM skel s "
        f"LEFT JOIN trans t ON t.src = s.id AND t.dst_obs LEFT JOIN yl y ON y.id = t.dst AND y.class = s.class "
        f"GROUP BY s.id, s.class)",
        f"{prefix}0 AS (SELECT s.id, s.class, 1.0 / (SELECT c FROM nc) AS p FROM skel s)",
    ]
    for i in range(1, max_iter + 1):
        parts.append(
            f"{prefix}{i} AS (SELECT s.id, s.class, s.p + coalesce(sum(t.p * f.p), 0.0) AS p FROM stat s "
            f"LEFT JOIN trans t ON t.src = s.id AND NOT t.dst_obs "
            f"LEFT JOIN {prefix}{i - 1} f ON f.id = t.dst AND f.class = s.class GROUP BY s.id, s.class, s.p)"
        )
    deltas = " UNION ALL ".join(
        f"SELECT {i} AS it, max(abs(a.p - b.p)) AS d FROM {prefix}{i} a JOIN {prefix}{i - 1} b USING (id, class)"
        for i in range(1, max_iter + 1)
    )
    parts.append(f"deltas AS ({deltas})")
    parts.append(f"stop AS (SELECT coalesce(min(it) FILTER (WHERE d < {_dbl(tol)}), {max_iter}) AS it FROM deltas)")
    allf = " UNION ALL ".join(f"SELECT {i} AS it, id, class, p FROM {prefix}{i}" for i in range(1, max_iter + 1))
    parts.append(f"fall AS ({allf})")
    parts.append("fraw AS (SELECT id, class, p FROM fall WHERE it = (SELECT it FROM stop))")
    parts.append(
        "fin AS (SELECT id, class, coalesce(p / nullif(sum(abs(p)) OVER (PARTITION BY id), 0.0), 0.0) AS p FROM fraw)")
    return ", ".join(parts)


def decode_sql(src: str, out: str = "pred") -> str:
    return (f"SELECT id, CAST(min(class) FILTER (WHERE p = mx) AS INTEGER) AS {out} FROM "
            f"(SELECT *, max(p) OVER (PARTITION BY id) AS mx FROM {src}) GROUP BY id")


# ------------------------------------------------------------------ step 1
def predict_knn_cte() -> str:
    return (
        f"WITH {masked_pts()}, {classes_cte()}, "
        f"nn AS (SELECT * FROM ({knn_sql('(SELECT * FROM pts WHERE NOT observed)', '(SELECT * FROM pts WHERE observed)', X.K_L, False)})), "
        "wn AS (SELECT nn.src, l.label AS y, exp(-d2) AS w, sum(exp(-d2)) OVER (PARTITION BY nn.src) AS s "
        "FROM nn JOIN pts l ON l.id = nn.dst), "
        "pr AS (SELECT u.id, c.class, coalesce(sum(CASE WHEN wn.y = c.class THEN coalesce(wn.w / nullif(wn.s, 0.0), 0.0) ELSE 0.0 END), 0.0) AS p "
        "FROM (SELECT id FROM pts WHERE NOT observed) u CROSS JOIN classes c LEFT JOIN wn ON wn.src = u.id GROUP BY u.id, c.class), "
        f"dec AS ({decode_sql('pr')}), "
        "out AS (SELECT dec.id, dec.pred, p.label FROM dec JOIN pts p USING (id)) "
    )


def q_predict_knn() -> str:
    return predict_knn_cte() + "SELECT * FROM out"


def q_test_error() -> str:
    return predict_knn_cte() + (
        "SELECT round(avg(CASE WHEN pred <> label THEN 1.0 ELSE 0.0 END), 6) AS error, "
        "CAST(sum(CASE WHEN pred <> label THEN 1 ELSE 0 END) AS BIGINT) AS misses, count(*) AS n FROM out")


# ------------------------------------------------------------------ step 2
ORD = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"


def burn_cte(shuffle: bool = True) -> str:
    n_l, ratio, seed = C.BURN_N_LABELED, C.BURN_RATIO, X.SEED
    order = f"md5('{seed}:' || o_orderkey), o_orderkey" if shuffle else "o_orderkey, o_orderkey"
    s = (
        f"o AS ({ORD}), "
        f"sz AS (SELECT o_orderstatus, count(*) AS n FROM o GROUP BY 1), "
        f"sz2 AS (SELECT o_orderstatus, {n_l} + least(CAST(floor({_dbl(n_l)} * (1.0 / {_dbl(ratio)} - 1.0)) AS BIGINT), n - {n_l}) AS nb FROM sz), "
        f"r1 AS (SELECT o.*, sz2.nb, row_number() OVER (PARTITION BY o.o_orderstatus ORDER BY {order}) AS r FROM o JOIN sz2 USING (o_orderstatus)), "
    )
    if shuffle:
        s += (
            "bi AS (SELECT *, r <= nb AS burn_in FROM r1), "
            f"ob AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('{seed}:obs:' || o_orderkey), o_orderkey) <= {n_l} AS obs "
            "FROM bi WHERE burn_in), "
            "burn AS (SELECT bi.o_orderkey, bi.o_orderstatus, bi.o_orderpriority, bi.burn_in, coalesce(ob.obs, FALSE) AS observed, "
            "CASE WHEN bi.burn_in THEN bi.r END AS burn_rank FROM bi LEFT JOIN ob USING (o_orderkey))"
        )
    else:
        s += (
            f"burn AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, r <= nb AS burn_in, (r <= nb AND r <= {n_l}) AS observed, "
            "CASE WHEN r <= nb THEN r END AS burn_rank FROM r1)"
        )
    return s


def q_class_sizes() -> str:
    return "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"


def q_burn_in_split() -> str:
    return f"WITH {burn_cte(True)} SELECT o_orderkey, o_orderstatus, observed, burn_rank FROM burn WHERE burn_in"


def q_burn_in_split_ordered() -> str:
    return f"WITH {burn_cte(False)} SELECT o_orderkey, o_orderstatus, observed, burn_rank FROM burn WHERE burn_in"


def q_label_mask() -> str:
    return (f"WITH o AS ({ORD}), m AS ({mask_sql('o', 'o_orderkey', 'o_orderpriority', C.REST_RATIO, X.SEED)}) "
            "SELECT o_orderkey, o_orderpriority, observed FROM m")


def q_uniform_mask() -> str:
    return (f"SELECT o_orderkey, row_number() OVER (ORDER BY md5('{X.SEED}:' || o_orderkey), o_orderkey) "
            f"<= floor(count(*) OVER () * {_dbl(C.REST_RATIO)}) AS observed FROM orders")


def stream_cte() -> str:
    seed = X.SEED
    return (
        f"{burn_cte(True)}, "
        f"rest AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, burn_in, burn_rank, "
        f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('{seed}:' || o_orderkey), o_orderkey) "
        f"<= floor(count(*) OVER (PARTITION BY o_orderstatus) * {_dbl(C.REST_RATIO)}) AS observed FROM burn WHERE NOT burn_in), "
        "allr AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, burn_in, burn_rank, observed FROM burn WHERE burn_in "
        "UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, burn_in, burn_rank, observed FROM rest), "
        f"st AS (SELECT *, row_number() OVER (ORDER BY (NOT burn_in), CASE WHEN burn_in THEN o_orderstatus END NULLS FIRST, "
        f"burn_rank NULLS FIRST, CASE WHEN NOT burn_in THEN md5('{seed}:order:' || o_orderkey) END NULLS FIRST, o_orderkey) - 1 AS seq FROM allr)"
    )


def q_arrival_order() -> str:
    return f"WITH {stream_cte()} SELECT o_orderkey, seq, burn_in FROM st"


def q_hide_labels() -> str:
    return (f"WITH {stream_cte()} SELECT seq, o_orderkey, CASE WHEN observed THEN o_orderstatus END AS label_seen, observed FROM st")


def q_replay() -> str:
    return f"SELECT event_id, row_number() OVER (ORDER BY md5('{X.SEED}:order:' || event_id), event_id) - 1 AS pos FROM events"


def q_label_budget() -> str:
    per = C.BUDGET_PER_CLASS
    return (
        f"WITH {burn_cte(True)}, "
        "cnt AS (SELECT count(DISTINCT o_orderstatus) AS c, count(*) FILTER (WHERE observed) AS b, "
        "count(*) FILTER (WHERE NOT burn_in) AS r FROM burn), "
        f"ratio AS (SELECT CAST({per} * c - b AS DOUBLE) / CAST(r AS DOUBLE) AS q FROM cnt), "
        "rest AS (SELECT * FROM burn WHERE NOT burn_in) "
        f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('{X.SEED}:' || o_orderkey), o_orderkey) "
        "<= floor(count(*) OVER (PARTITION BY o_orderstatus) * (SELECT q FROM ratio)) AS observed FROM rest"
    )


def q_tail_split() -> str:
    return f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) <= {C.TAIL_N} AS is_test FROM orders"


def q_stratified_split() -> str:
    return (f"WITH o AS ({ORD}), m AS ({mask_sql('o', 'o_orderkey', 'o_orderstatus', 0.2, 7, out='is_test')}) "
            "SELECT o_orderkey, o_orderstatus, is_test FROM m")


HALF = ("half AS (SELECT d.doc_id, l.quality, CASE WHEN l.quality IS NOT NULL THEN d.doc_id % 97 END AS seq "
        "FROM documents d LEFT JOIN labels l USING (doc_id))")


def q_label_mask_nulls() -> str:
    return (f"WITH {HALF}, m AS ({mask_sql('half', 'doc_id', 'quality', C.REST_RATIO, X.SEED)}) "
            "SELECT doc_id, quality, observed AND quality IS NOT NULL AS observed FROM m")


def q_replay_nulls() -> str:
    return f"WITH {HALF} SELECT doc_id, seq, row_number() OVER (ORDER BY seq NULLS FIRST, doc_id) - 1 AS pos FROM half"


def q_tail_split_nulls() -> str:
    return (f"WITH {HALF} SELECT doc_id, seq, row_number() OVER (ORDER BY seq DESC NULLS LAST, doc_id DESC) "
            f"<= {C.TAIL_N_NULLS} AS is_test FROM half")


def q_one_hot() -> str:
    return (f"WITH {masked_pts()}, {classes_cte()} SELECT p.id, CAST(c.class AS INTEGER) AS class, "
            "CAST(CASE WHEN p.label = c.class THEN 1.0 ELSE 0.0 END AS DOUBLE) AS p FROM pts p, classes c WHERE p.observed")


def q_store_counts() -> str:
    return (f"WITH {masked_pts()} SELECT count(*) AS n_nodes, count(*) FILTER (WHERE observed) AS n_labeled, "
            "count(*) FILTER (WHERE NOT observed) AS n_unlabeled FROM pts")


def q_labeled_part() -> str:
    return f"WITH {masked_pts()} SELECT id, label FROM pts WHERE observed"


def q_scaled_features() -> str:
    d = _dbl(C.PART_DIVISOR)
    return (f"SELECT p_partkey AS id, round(CAST(p_size AS DOUBLE) / {d}, 6) AS x0, "
            f"round(p_retailprice / {d}, 6) AS x1 FROM part")


# ------------------------------------------------------------------ step 3
def q_knn_exact() -> str:
    return f"WITH pts AS ({pts_sql()}), nn AS ({knn_sql('pts', 'pts', 3, True)}) {edge_out('nn')}"


def q_knn_metric() -> str:
    base, step, period = C.METRIC_DIAGONAL_RULE
    proj = (f"list_transform(x, lambda v, i: v * ({_dbl(base)} + CAST((i - 1) % {period} AS DOUBLE) * {_dbl(step)}))")
    return (f"WITH p0 AS ({pts_sql()}), pts AS (SELECT id, {proj} AS x FROM p0), "
            f"nn AS ({knn_sql('pts', 'pts', 3, True)}) {edge_out('nn')}")


def q_knn_labeled() -> str:
    return (f"WITH {masked_pts()}, nn AS ({knn_sql('(SELECT * FROM pts WHERE NOT observed)', '(SELECT * FROM pts WHERE observed)', X.K_L, False)}) "
            f"{edge_out('nn')}")


def q_knn_unlabeled() -> str:
    return (f"WITH {masked_pts()}, nn AS ({knn_sql('(SELECT * FROM pts WHERE observed)', '(SELECT * FROM pts WHERE NOT observed)', X.K_U, False)}) "
            f"{edge_out('nn')}")


def q_knn_part() -> str:
    d = _dbl(1000.0)
    return (f"WITH pts AS (SELECT p_partkey AS id, [CAST(p_size AS DOUBLE) / {d}, p_retailprice / {d}] AS x FROM part), "
            f"nn AS ({knn_sql('pts', 'pts', 3, True)}) {edge_out('nn')}")


def g_with() -> str:
    return f"WITH {masked_pts()}, {graph_cte()} "


def q_knn_graph() -> str:
    return g_with() + "SELECT src, dst, dst_obs, round(d2, 6) AS d2, round(w, 6) AS w, rank FROM edges"


def q_adjacency() -> str:
    return g_with() + ("SELECT src, dst_obs, array_to_string(list(dst ORDER BY d2, dst), ',') AS neighbors, "
                       "count(*) AS degree FROM edges GROUP BY src, dst_obs")


def q_reverse_adjacency() -> str:
    return g_with() + ("SELECT dst AS node, FALSE AS src_obs, src, count(*) OVER (PARTITION BY dst) AS in_degree FROM edges")


def q_radii() -> str:
    return g_with() + "SELECT src, dst_obs, round(max(d2), 6) AS radius, count(*) AS n_neighbors FROM edges GROUP BY src, dst_obs"


def q_transitions() -> str:
    return g_with() + "SELECT src, dst, round(p, 6) AS p FROM trans WHERE w > 0"


def q_graph_incremental() -> str:
    return q_knn_graph()


# ------------------------------------------------------------------ step 4
def lp_with(pts_body: str | None = None, k_l: int = X.K_L) -> str:
    head = pts_body if pts_body is not None else masked_pts()
    return f"WITH {head}, {graph_cte('pts', k_l, X.K_U)}, {lp_cte()} "


def q_offline_lp() -> str:
    return lp_with() + "SELECT id, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM fin"


def q_lp_residuals() -> str:
    return lp_with() + "SELECT CAST(it AS INTEGER) AS iteration, round(d, 6) AS change FROM deltas WHERE it <= (SELECT it FROM stop)"


def q_decode_labels() -> str:
    return lp_with() + decode_sql("fin")


def q_two_class_lp() -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    cnt = ", ".join(
        f"CAST(length(text) - length(replace(replace(text, '{c}', ''), '{c.upper()}', '')) AS DOUBLE)" for c in letters)
    body = (
        f"d0 AS (SELECT doc_id AS id, [{cnt}] AS v FROM documents), "
        "d1 AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda t: t * t))) AS nrm FROM d0), "
        "dx AS (SELECT id, CASE WHEN nrm > 0 THEN list_transform(v, lambda t: t / nrm) ELSE list_transform(v, lambda t: 0.0) END AS x FROM d1), "
        "pts AS (SELECT dx.id, dx.x, l.quality AS label, l.doc_id IS NOT NULL AS observed FROM dx LEFT JOIN labels l ON l.doc_id = dx.id)"
    )
    return lp_with(body) + "SELECT id, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM fin"


# ------------------------------------------------------------------ step 5
def split_pts(seed: int = X.SEED) -> str:
    return (
        f"pts0 AS ({pts_sql()}), "
        f"sp AS ({mask_sql('pts0', 'id', 'label', X.TEST_RATIO, X.TEST_SEED, out='is_test')}), "
        "test AS (SELECT id, x, label FROM sp WHERE is_test), "
        "tr0 AS (SELECT id, x, label FROM sp WHERE NOT is_test), "
        f"pts AS ({mask_sql('tr0', 'id', 'label', X.OBS_RATIO, seed)})"
    )


def predict_cte(k_l: int = X.K_L, seed: int = X.SEED) -> str:
    return lp_with(split_pts(seed), k_l) + (
        f", nnl AS ({knn_sql('test', '(SELECT * FROM pts WHERE observed)', k_l, False)}), "
        f"nnu AS ({knn_sql('test', '(SELECT * FROM pts WHERE NOT observed)', X.K_U, False)}), "
        "wl AS (SELECT src, dst, coalesce(exp(-d2) / nullif(sum(exp(-d2)) OVER (PARTITION BY src), 0.0), 0.0) AS pn FROM nnl), "
        "wu AS (SELECT src, dst, coalesce(exp(-d2) / nullif(sum(exp(-d2)) OVER (PARTITION BY src), 0.0), 0.0) AS pn FROM nnu), "
        "tsk AS (SELECT t.id, c.class FROM test t, classes c), "
        "pk AS (SELECT s.id, s.class, coalesce(sum(wl.pn * y.y), 0.0) AS p FROM tsk s LEFT JOIN wl ON wl.src = s.id "
        "LEFT JOIN yl y ON y.id = wl.dst AND y.class = s.class GROUP BY s.id, s.class), "
        "pu AS (SELECT s.id, s.class, coalesce(sum(wu.pn * f.p), 0.0) AS p FROM tsk s LEFT JOIN wu ON wu.src = s.id "
        "LEFT JOIN fin f ON f.id = wu.dst AND f.class = s.class GROUP BY s.id, s.class), "
        "pc AS (SELECT id, class, pk.p AS p_knn, pu.p AS p_lp, pk.p + pu.p AS p FROM pk JOIN pu USING (id, class)), "
        f"dk AS ({decode_sql('pk', 'pred_knn')}), dc AS ({decode_sql('pc', 'pred_combined')}), "
        "pair AS (SELECT id, pred_knn, pred_combined FROM dk JOIN dc USING (id)) "
    )


def q_predict_lp() -> str:
    return predict_cte() + "SELECT id, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM pu"


def q_predict_combined() -> str:
    return predict_cte() + "SELECT id, CAST(class AS INTEGER) AS class, round(p, 6) AS p FROM pc"


def q_predict_pair() -> str:
    return predict_cte() + "SELECT * FROM pair"


# ------------------------------------------------------------------ step 6
EPS = "CAST(5e-324 AS DOUBLE)"


def rowm_cte(src: str = "fin", truth: str = "(SELECT id, label FROM pts WHERE NOT observed)") -> str:
    return (
        f"nclass AS (SELECT count(*) AS c FROM classes), "
        f"cl AS (SELECT f.id, f.class, f.p, t.label AS tru, least(greatest(f.p, {EPS}), 1.0 - {EPS}) AS q FROM {src} f JOIN {truth} t USING (id)), "
        "cn AS (SELECT *, q / sum(q) OVER (PARTITION BY id) AS qn, sum(abs(p)) OVER (PARTITION BY id) AS raw FROM cl), "
        "rowm AS (SELECT id, any_value(tru) AS tru, any_value(raw) <> 0 AS valid, "
        "arg_min(class, [-qn, class]) AS pred, "
        "sum(abs(qn - CASE WHEN class = tru THEN 1.0 ELSE 0.0 END)) / 2.0 AS l1, "
        "-sum(CASE WHEN class = tru THEN ln(qn) ELSE 0.0 END) / ln((SELECT c FROM nclass)) AS xent, "
        "-sum(qn * ln(qn)) / ln((SELECT c FROM nclass)) AS entropy FROM cn GROUP BY id)"
    )


def q_evaluate() -> str:
    return lp_with() + ", " + rowm_cte() + (
        " SELECT count(*) AS n, count(*) FILTER (WHERE NOT valid) AS n_invalid, "
        "round(count(*) FILTER (WHERE NOT valid) / count(*), 6) AS invalid_ratio, "
        "round(avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END), 6) AS clf_error_mixed, "
        "round(avg(l1), 6) AS l1_error_mixed, round(avg(xent), 6) AS cross_ent_mixed, "
        "round((coalesce(sum(entropy) FILTER (WHERE valid), 0.0) + count(*) FILTER (WHERE NOT valid)) / count(*), 6) AS entropy_pred_mixed, "
        "round(avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END) FILTER (WHERE valid), 6) AS clf_error_valid, "
        "round(avg(l1) FILTER (WHERE valid), 6) AS l1_error_valid, round(avg(xent) FILTER (WHERE valid), 6) AS cross_ent_valid, "
        "round(avg(entropy) FILTER (WHERE valid), 6) AS entropy_pred_valid FROM rowm")


def point_cte() -> str:
    return (", nclass AS (SELECT count(*) AS c FROM classes), "
            "ps AS (SELECT id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END) / ln((SELECT c FROM nclass)) AS entropy, "
            "max(p) AS confidence, CAST(arg_min(class, [-p, class]) AS INTEGER) AS pred FROM fin GROUP BY id) ")


def q_point_stats() -> str:
    return lp_with() + point_cte() + "SELECT id, round(entropy, 6) AS entropy, round(confidence, 6) AS confidence, pred FROM ps"


def q_test_error_pair() -> str:
    return predict_cte() + (
        "SELECT round(avg(CASE WHEN pred_knn <> t.label THEN 1.0 ELSE 0.0 END), 6) AS error_knn, "
        "round(avg(CASE WHEN pred_combined <> t.label THEN 1.0 ELSE 0.0 END), 6) AS error_combined, count(*) AS n "
        "FROM pair JOIN test t USING (id)")


def q_confusion() -> str:
    return predict_knn_cte() + (
        "SELECT CAST(label AS INTEGER) AS true, pred, count(*) AS n, "
        "round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS ratio FROM out GROUP BY label, pred")


def q_corrected_samples() -> str:
    return predict_cte() + (
        "SELECT id, pred_knn, pred_combined, t.label FROM pair JOIN test t USING (id) "
        "WHERE pred_knn <> t.label AND pred_combined = t.label")


def q_entropy_histogram() -> str:
    return lp_with() + point_cte() + (
        ", hs AS (SELECT ps.*, ps.pred = p.label AS hit FROM ps JOIN pts p USING (id)), "
        "tot AS (SELECT hit, count(*) AS t FROM hs GROUP BY hit) "
        "SELECT hs.hit, CAST(least(floor(entropy * 20), 19) AS INTEGER) AS bin, count(*) AS n, "
        "round(count(*) / any_value(tot.t), 6) AS ratio FROM hs JOIN tot USING (hit) "
        "WHERE entropy >= 0 AND entropy <= 1 GROUP BY hs.hit, bin")


def q_stream_profile() -> str:
    return (
        f"WITH m AS (SELECT event_id, event_type, row_number() OVER (ORDER BY md5('{X.SEED}:' || event_id), event_id) "
        f"<= floor(count(*) OVER () * {_dbl(C.REST_RATIO)}) AS observed FROM events) "
        "SELECT event_type, observed, CAST(floor(event_id / 1000) AS BIGINT) AS seq_bucket, count(*) AS n FROM m GROUP BY 1, 2, 3")


ORACLE = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {k: fn() for k, fn in ORACLE.items() if k in C.QUERIES}


# ------------------------------------------------------------------ step 8
def insert_sql(labeled: bool, theta: float | None = None, top_ratio: float | None = None, max_hops: int = X.MAX_ITER,
               tail=None) -> str:
    """One arrival: graph + propagation on the stored rows, rebuild with the new row,
    first estimate, then the hops unrolled up to max_iter (inactive beyond the cap)."""
    theta = X.THETA if theta is None else theta
    kind = "observed" if labeled else "NOT observed"
    head = (
        f"{masked_pts()}, "
        f"newp AS (SELECT * FROM pts WHERE {kind} ORDER BY md5('{X.SEED}:order:' || id) DESC, id DESC LIMIT 1), "
        "sto AS (SELECT * FROM pts WHERE id NOT IN (SELECT id FROM newp))"
    )
    # graph + LP on stored rows (names of graph_cte/lp_cte), then the full graph as g2
    g2 = graph_cte("pts").replace("pairs AS", "pairs2 AS").replace("FROM pairs)", "FROM pairs2)") \
        .replace("ranked AS", "ranked2 AS").replace("FROM ranked ", "FROM ranked2 ").replace("edges AS", "edges2 AS") \
        .replace("trans AS", "trans2 AS").replace("FROM edges)", "FROM edges2)")
    parts = [head, graph_cte("sto"), lp_cte("sto"), g2]
    parts.append(f"u2 AS (SELECT count(*) AS u FROM pts WHERE NOT observed)")
    parts.append(f"cap AS (SELECT CASE WHEN {X.K_U} > 1 THEN CAST(floor(ln(greatest(u, 1)) / ln({X.K_U})) AS INTEGER) ELSE {X.MAX_ITER} END AS h FROM u2)")
    parts.append("yl2 AS (SELECT p.id, c.class, CASE WHEN p.label = c.class THEN 1.0 ELSE 0.0 END AS y FROM pts p, classes c WHERE p.observed)")
    # new unlabelled rows start uniform, then get their own row product
    if labeled:
        parts.append("cur0 AS (SELECT id, class, p FROM fin)")
    else:
        parts.append(
            "unif AS (SELECT n.id, c.class, 1.0 / (SELECT c FROM nc) AS p FROM newp n, classes c), "
            "fb AS (SELECT id, class, p FROM fin UNION ALL SELECT * FROM unif), "
            "fnew AS (SELECT n.id, n.class, coalesce(sum(CASE WHEN t.dst_obs THEN t.p * y.y ELSE t.p * f.p END), 0.0) AS p FROM unif n "
            "LEFT JOIN trans2 t ON t.src = n.id LEFT JOIN yl2 y ON t.dst_obs AND y.id = t.dst AND y.class = n.class "
            "LEFT JOIN fb f ON NOT t.dst_obs AND f.id = t.dst AND f.class = n.class GROUP BY n.id, n.class), "
            "cur0 AS (SELECT id, class, p FROM fin UNION ALL SELECT * FROM fnew)"
        )
    parts.append("fr1 AS (SELECT DISTINCT src AS id FROM trans2 WHERE dst IN (SELECT id FROM newp))")
    parts.append(
        "tent0 AS (SELECT r.id, c.class, coalesce(sum(CASE WHEN t.dst_obs THEN t.p * y.y ELSE t.p * f.p END), 0.0) AS p "
        "FROM fr1 r CROSS JOIN classes c LEFT JOIN trans2 t ON t.src = r.id LEFT JOIN yl2 y ON t.dst_obs AND y.id = t.dst AND y.class = c.class "
        "LEFT JOIN cur0 f ON NOT t.dst_obs AND f.id = t.dst AND f.class = c.class GROUP BY r.id, c.class)"
    )
    for h in range(1, max_hops + 1):
        p = h - 1
        parts.append(
            f"cd{h} AS (SELECT t.id, t.class, t.p - c.p AS d FROM tent{p} t JOIN fr{h} USING (id) JOIN cur{p} c USING (id, class) "
            f"WHERE {h} <= (SELECT h FROM cap))"
        )
        if top_ratio is None:
            parts.append(f"ap{h} AS (SELECT id FROM cd{h} GROUP BY id HAVING sum(abs(d)) > {_dbl(max(theta, 1e-12))})")
        else:
            parts.append(
                f"nf{h} AS (SELECT count(*) AS n FROM (SELECT DISTINCT id FROM cd{h})), "
                f"ap{h} AS (SELECT id FROM (SELECT id, sum(abs(d)) AS nm FROM cd{h} GROUP BY id) "
                f"ORDER BY nm DESC, id LIMIT (SELECT CAST(floor({_dbl(top_ratio)} * n) AS BIGINT) FROM nf{h}))"
            )
        parts.append(
            f"cur{h} AS (SELECT c.id, c.class, coalesce(t.p, c.p) AS p FROM cur{p} c LEFT JOIN "
            f"(SELECT t.* FROM tent{p} t WHERE t.id IN (SELECT id FROM ap{h})) t USING (id, class))"
        )
        parts.append(f"up{h} AS (SELECT * FROM cd{h} WHERE id IN (SELECT id FROM ap{h}))")
        parts.append(
            f"ct{h} AS (SELECT tr.src AS id, u.class, sum(tr.p * u.d) AS p FROM trans2 tr JOIN up{h} u ON tr.dst = u.id "
            f"WHERE NOT tr.dst_obs GROUP BY tr.src, u.class)"
        )
        parts.append(f"fr{h + 1} AS (SELECT DISTINCT id FROM ct{h})")
        parts.append(
            f"tent{h} AS (SELECT id, class, sum(p) AS p FROM (SELECT * FROM tent{p} UNION ALL "
            f"SELECT c.id, c.class, c.p FROM cur{h} c WHERE c.id IN (SELECT id FROM fr{h + 1}) AND c.id NOT IN (SELECT id FROM tent{p}) "
            f"UNION ALL SELECT * FROM ct{h}) GROUP BY id, class)"
        )
    last = f"cur{max_hops}"
    if tail is not None:
        return "WITH " + ", ".join(parts) + tail(last, max_hops)
    return (
        "WITH " + ", ".join(parts) + f" SELECT id, CAST(class AS INTEGER) AS class, "
        f"round(coalesce(p / nullif(sum(abs(p)) OVER (PARTITION BY id), 0.0), 0.0), 6) AS p FROM {last}"
    )


def q_online_insert_unlabeled() -> str:
    return insert_sql(False)


def q_online_insert_labeled() -> str:
    return insert_sql(True)


def q_top_ratio_updates() -> str:
    return insert_sql(False, top_ratio=0.5)


ORACLE.update({"online_insert_unlabeled": q_online_insert_unlabeled, "online_insert_labeled": q_online_insert_labeled,
               "top_ratio_updates": q_top_ratio_updates})


# ------------------------------------------------------------------ step 10: sweeps and runs
EVAL_COLS = (
    "count(*) AS n, count(*) FILTER (WHERE NOT valid) AS n_invalid, "
    "round(avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END), 6) AS clf_error_mixed, "
    "round(avg(l1), 6) AS l1_error_mixed, round(avg(xent), 6) AS cross_ent_mixed, "
    "round((coalesce(sum(entropy) FILTER (WHERE valid), 0.0) + count(*) FILTER (WHERE NOT valid)) / count(*), 6) AS entropy_pred_mixed"
)


def variant_sql(head: str, key_sql: str, key: str, k_l: int = X.K_L, k_u: int = X.K_U, n_labeled: bool = False) -> str:
    extra = ", (SELECT count(*) FROM pts WHERE observed) AS n_labeled" if n_labeled else ""
    return (f"(WITH {head}, {graph_cte('pts', k_l, k_u)}, {lp_cte()}, {rowm_cte()} "
            f"SELECT {key_sql} AS {key}{extra}, CAST((SELECT it FROM stop) AS INTEGER) AS n_iter, {EVAL_COLS} FROM rowm)")


def q_sweep_k_labeled() -> str:
    return " UNION ALL ".join(variant_sql(masked_pts(), f"{k}", "k_labeled", k_l=k) for k in C.SWEEP_K)


def q_sweep_k_unlabeled() -> str:
    return " UNION ALL ".join(variant_sql(masked_pts(), f"{k}", "k_unlabeled", k_u=k) for k in C.SWEEP_K)


def uniform_pts(ratio: float, seed: int = X.SEED) -> str:
    return (f"pts0 AS ({pts_sql()}), pts AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || id), id) "
            f"<= floor(count(*) OVER () * {_dbl(ratio)}) AS observed FROM pts0)")


def q_sweep_label_ratio() -> str:
    parts = []
    for i, r in enumerate(C.SWEEP_RATIOS):
        v = variant_sql(uniform_pts(r), f"{i}", "ratio_index", n_labeled=True)
        parts.append(f"SELECT *, {_dbl(r)} AS ratio FROM {v}")
    return " UNION ALL ".join(parts)


def budget_pts(per_class: int, seed: int = X.SEED) -> str:
    n_l, ratio = C.BURN_N_LABELED, C.BURN_RATIO
    return (
        f"pts0 AS ({pts_sql()}), "
        "sz AS (SELECT label, count(*) AS n FROM pts0 GROUP BY 1), "
        f"sz2 AS (SELECT label, {n_l} + least(CAST(floor({_dbl(n_l)} * (1.0 / {_dbl(ratio)} - 1.0)) AS BIGINT), n - {n_l}) AS nb FROM sz), "
        f"r1 AS (SELECT p.*, sz2.nb, row_number() OVER (PARTITION BY p.label ORDER BY md5('{seed}:' || p.id), p.id) AS r FROM pts0 p JOIN sz2 USING (label)), "
        "bi AS (SELECT *, r <= nb AS burn_in FROM r1), "
        f"ob AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:obs:' || id), id) <= {n_l} AS obs FROM bi WHERE burn_in), "
        "burn AS (SELECT bi.id, bi.x, bi.label, bi.burn_in, coalesce(ob.obs, FALSE) AS observed FROM bi LEFT JOIN ob USING (id)), "
        "cnt AS (SELECT count(DISTINCT label) AS c, count(*) FILTER (WHERE observed) AS b, count(*) FILTER (WHERE NOT burn_in) AS r FROM burn), "
        f"ratio AS (SELECT CAST({per_class} * c - b AS DOUBLE) / CAST(r AS DOUBLE) AS q FROM cnt), "
        "rest AS (SELECT id, x, label, row_number() OVER (PARTITION BY label ORDER BY md5('" + str(seed) + ":' || id), id) "
        "<= floor(count(*) OVER (PARTITION BY label) * (SELECT q FROM ratio)) AS observed FROM burn WHERE NOT burn_in), "
        "pts AS (SELECT id, x, label, observed FROM burn WHERE burn_in UNION ALL SELECT * FROM rest)"
    )


def q_sweep_labels_per_class() -> str:
    return " UNION ALL ".join(variant_sql(budget_pts(b), f"{b}", "labels_per_class", n_labeled=True) for b in C.SWEEP_BUDGETS)


def run_seeds() -> list[int]:
    return [X.SEED * n for n in range(C.N_RUNS)]


def q_default_runs() -> str:
    return " UNION ALL ".join(variant_sql(masked_pts(seed=s), f"{i}", "run", n_labeled=True) for i, s in enumerate(run_seeds()))


FINALS = ("clf_error_mixed", "l1_error_mixed", "cross_ent_mixed", "entropy_pred_mixed", "invalid_ratio")


def prefix_pts(seed: int, t: int) -> str:
    """The first t / RUN_STEPS of a run's masked points in arrival order."""
    return (
        f"pts0 AS ({pts_sql()}), ptm AS ({mask_sql('pts0', 'id', 'label', X.OBS_RATIO, seed)}), "
        f"ptr AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:order:' || id), id) - 1 AS pos, count(*) OVER () AS n_all FROM ptm), "
        f"pts AS (SELECT id, x, label, observed FROM ptr WHERE pos < ceil(CAST(n_all AS DOUBLE) * {t} / {C.RUN_STEPS}))"
    )


def run_metric_sql() -> str:
    """(run, metric, t, score) of every run, as the Spark side stores them."""
    parts = []
    finals = (
        "SELECT count(*) FILTER (WHERE NOT valid) / count(*) AS invalid_ratio, "
        "avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END) AS clf_error_mixed, avg(l1) AS l1_error_mixed, "
        "avg(xent) AS cross_ent_mixed, "
        "(coalesce(sum(entropy) FILTER (WHERE valid), 0.0) + count(*) FILTER (WHERE NOT valid)) / count(*) AS entropy_pred_mixed FROM rowm"
    )
    for i, s in enumerate(run_seeds()):
        for t in range(1, C.RUN_STEPS + 1):
            series = " UNION ALL ".join(f"SELECT {i} AS run, '{m}' AS metric, {t} AS t, CAST({m} AS DOUBLE) AS score FROM ev" for m in FINALS)
            lp = lp_cte().replace("AS class FROM pts WHERE", "AS class FROM pts0 WHERE")
            last = ("" if t < C.RUN_STEPS else
                    f" UNION ALL SELECT {i} AS run, 'lp_change' AS metric, CAST(it AS INTEGER) AS t, d AS score FROM deltas WHERE it <= (SELECT it FROM stop)")
            parts.append(f"(WITH {prefix_pts(s, t)}, {graph_cte()}, {lp}, {rowm_cte()}, ev AS ({finals}) {series}{last})")
    return " UNION ALL ".join(parts)


def runs_agg_sql() -> str:
    return (f"WITH m AS ({run_metric_sql()}), agg AS (SELECT metric, t, avg(score) AS mean, stddev_pop(score) AS std, "
            f"count(*) AS n_runs FROM m GROUP BY metric, t HAVING count(*) = {C.N_RUNS}) ")


def q_runs_aggregate() -> str:
    return runs_agg_sql() + "SELECT metric, CAST(t AS INTEGER) AS t, round(mean, 6) AS mean, round(std, 6) AS std, n_runs FROM agg"


def q_run_summary() -> str:
    return runs_agg_sql() + (
        "SELECT round(arg_min(mean, t), 6) AS first_error, round(arg_max(mean, t), 6) AS last_error "
        "FROM agg WHERE metric = 'clf_error_mixed'")


def q_metric_series() -> str:
    return runs_agg_sql() + (
        "SELECT metric, CAST(t AS INTEGER) AS t, round(mean, 6) AS mean, round(mean - coalesce(std, 0.0), 6) AS lower, "
        "round(mean + coalesce(std, 0.0), 6) AS upper FROM agg WHERE metric IN ('lp_change', 'clf_error_mixed')")


def q_metric_sizes() -> str:
    return f"WITH m AS ({run_metric_sql()}) SELECT CAST(run AS BIGINT) AS run, metric, count(*) AS size FROM m GROUP BY run, metric"


def q_latest_run() -> str:
    last = C.N_RUNS - 1
    return (f"WITH m AS ({run_metric_sql()}) SELECT '{last}' AS run_id, metric, CAST(t AS INTEGER) AS t, round(score, 6) AS score "
            f"FROM m WHERE run = {last}")


def q_sweep_theta() -> str:
    def tail(th):
        def f(last, max_hops):
            hops = " + ".join(
                f"CASE WHEN {h} <= (SELECT h FROM cap) AND (SELECT count(*) FROM fr{h}) > 0 THEN 1 ELSE 0 END" for h in range(1, max_hops + 1))
            upd = " + ".join(f"(SELECT count(*) FROM ap{h})" for h in range(1, max_hops + 1))
            return (
                f", fin2 AS (SELECT id, class, coalesce(p / nullif(sum(abs(p)) OVER (PARTITION BY id), 0.0), 0.0) AS p FROM {last}), "
                + rowm_cte("fin2")
                + f" SELECT {_dbl(th)} AS theta, CAST({hops} AS INTEGER) AS hops, CAST({upd} AS INTEGER) AS n_updates, "
                "round(avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END), 6) AS clf_error_mixed, round(avg(l1), 6) AS l1_error_mixed FROM rowm"
            )
        return f

    return " UNION ALL ".join(f"({insert_sql(False, theta=th, tail=tail(th))})" for th in C.SWEEP_THETA)


ORACLE.update({
    "sweep_k_labeled": q_sweep_k_labeled, "sweep_k_unlabeled": q_sweep_k_unlabeled,
    "sweep_label_ratio": q_sweep_label_ratio, "sweep_labels_per_class": q_sweep_labels_per_class,
    "default_runs": q_default_runs, "runs_aggregate": q_runs_aggregate, "run_summary": q_run_summary,
    "metric_series": q_metric_series, "metric_sizes": q_metric_sizes, "latest_run": q_latest_run,
    "sweep_theta": q_sweep_theta,
})


# ------------------------------------------------------------------ sources, K16, M1
def q_labeled_text() -> str:
    return ("SELECT label, CAST(len(embedding) AS INTEGER) AS n_features, "
            "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS x_sum, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM embeddings")


def q_paired_text() -> str:
    return ("SELECT label, CAST(len(embedding) AS INTEGER) AS n_features, "
            "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS x_sum FROM embeddings")


def q_graph_metric() -> str:
    base, step, period = C.METRIC_DIAGONAL_RULE
    proj = f"list_transform(x, lambda v, i: v * ({_dbl(base)} + CAST((i - 1) % {period} AS DOUBLE) * {_dbl(step)}))"
    head = f"{masked_pts()}, ptsm AS (SELECT id, {proj} AS x, label, observed FROM pts)"
    return (f"WITH {head}, {graph_cte('ptsm')} "
            "SELECT src, dst, dst_obs, round(d2, 6) AS d2, round(w, 6) AS w, rank FROM edges")


def q_clip_normalize() -> str:
    return predict_knn_cte() + (
        f", cl2 AS (SELECT id, class, least(greatest(p, {EPS}), 1.0 - {EPS}) AS q FROM pr) "
        "SELECT id, CAST(class AS INTEGER) AS class, round(q / sum(q) OVER (PARTITION BY id), 6) AS p FROM cl2")


ORACLE.update({"labeled_text": q_labeled_text, "paired_text": q_paired_text, "graph_metric": q_graph_metric,
               "clip_normalize": q_clip_normalize})


def q_sweep_report() -> str:
    """M16 over runs x k_labeled values: per value, mean and population std of the run summaries."""
    per = []
    for n, s in enumerate(run_seeds()):
        for k in C.SWEEP_K:
            miss = lambda c: f"(SELECT avg(CASE WHEN {c} <> t.label THEN 1.0 ELSE 0.0 END) FROM pair JOIN test t USING (id))"
            per.append(
                f"({predict_cte(k, s)}, {rowm_cte()} SELECT {k} AS value, {n} AS run, "
                f"avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END) AS est_error, {miss('pred_knn')} AS knn_error, "
                f"{miss('pred_combined')} AS combined_error FROM rowm)")
    cols = ["est_error", "knn_error", "combined_error"]
    aggs = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in cols)
    return (f"WITH pr AS ({' UNION ALL '.join(per)}) SELECT CAST(value AS INTEGER) AS value, {aggs}, count(*) AS n_runs "
            "FROM pr GROUP BY value")


ORACLE.update({"sweep_report": q_sweep_report})


# ------------------------------------------------------------------ approximate kNN
def buckets_sql(src: str, tables: int, bits: int, seed: int) -> str:
    """Every row of ``src`` once per hash table, with its bucket ``g``: planes from the published formula."""
    sel = []
    for t in range(tables):
        terms = []
        for b in range(bits):
            n = t * bits + b + 1
            u = f"(sin(CAST(12.9898 AS DOUBLE) * {n} + CAST(78.233 AS DOUBLE) * i * {n} + {seed}) * CAST(43758.5453 AS DOUBLE))"
            dot = f"list_sum(list_transform(x, lambda v, i: v * ({u} - floor({u}) - 0.5)))"
            terms.append(f"(CASE WHEN {dot} > 0 THEN {1 << b} ELSE 0 END)")
        sel.append(f"SELECT *, CAST({' + '.join(terms)} AS BIGINT) + {t << 32} AS g FROM {src}")
    return " UNION ALL ".join(sel)


def q_knn_approx() -> str:
    return (
        f"WITH pts AS ({pts_sql()}), gp AS ({buckets_sql('pts', C.LSH_TABLES, C.LSH_BITS, C.LSH_SEED)}), "
        f"cand AS (SELECT DISTINCT a.id AS src, b.id AS dst, {D2} AS d2 FROM gp a JOIN gp b ON a.g = b.g AND a.id <> b.id), "
        "nn AS (SELECT src, dst, d2, CAST(row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS INTEGER) AS rank FROM cand) "
        "SELECT src, dst, round(d2, 6) AS d2, rank FROM nn WHERE rank <= 3"
    )


def _approx(src: str) -> str:
    return buckets_sql(src, C.APPROX["lsh_tables"], C.APPROX["lsh_bits"], C.APPROX["lsh_seed"])


def q_graph_approx() -> str:
    return (
        f"WITH {masked_pts()}, gp AS ({_approx('pts')}), "
        f"pairs AS (SELECT DISTINCT a.id AS src, b.id AS dst, b.observed AS dst_obs, {D2} AS d2 FROM gp a JOIN gp b ON a.g = b.g AND a.id <> b.id WHERE NOT a.observed), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst_obs ORDER BY d2, dst) AS rk FROM pairs) "
        f"SELECT src, dst, dst_obs, round(d2, 6) AS d2, round(exp(-d2), 6) AS w, CAST(rk AS INTEGER) AS rank FROM ranked "
        f"WHERE rk <= CASE WHEN dst_obs THEN {X.K_L} ELSE {X.K_U} END"
    )


def q_predict_approx() -> str:
    return (
        f"WITH {split_pts()}, {classes_cte()}, gq AS ({_approx('test')}), gr AS ({_approx('(SELECT * FROM pts WHERE observed)')}), "
        f"cand AS (SELECT DISTINCT a.id AS src, b.id AS dst, b.label AS y, {D2} AS d2 FROM gq a JOIN gr b ON a.g = b.g), "
        f"nn AS (SELECT *, exp(-d2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rk FROM cand) WHERE rk <= {X.K_L}), "
        "wn AS (SELECT src, y, coalesce(w / nullif(sum(w) OVER (PARTITION BY src), 0.0), 0.0) AS pn FROM nn) "
        "SELECT t.id, CAST(c.class AS INTEGER) AS class, round(coalesce(sum(wn.pn), 0.0), 6) AS p FROM test t CROSS JOIN classes c "
        "LEFT JOIN wn ON wn.src = t.id AND wn.y = c.class GROUP BY t.id, c.class"
    )


ORACLE.update({"graph_approx": q_graph_approx, "predict_approx": q_predict_approx})


def q_stream_points() -> str:
    return (f"WITH {split_pts()} SELECT row_number() OVER (ORDER BY md5('{X.SEED}:order:' || id), id) - 1 AS seq, id, "
            "CASE WHEN observed THEN label END AS label_seen, observed FROM pts")


def q_stream_edges() -> str:
    return f"WITH {split_pts()}, {graph_cte()} SELECT src, dst, dst_obs, round(d2, 6) AS d2, rank FROM edges"


ORACLE.update({"stream_points": q_stream_points, "stream_edges": q_stream_edges})


ORACLE.update({"knn_approx": q_knn_approx})


# ------------------------------------------------------------------ whole streaming runs
CHAIN_HOPS = 8  # the hop cap int(ln u / ln 3) stays below for u < 3^9


def stream_pts(seed: int, kind: str, value: float = 0.0) -> str:
    """The train part in arrival order: ``pts (id, x, label, observed, step)``, step 0 being the burn-in."""
    n_l, ratio = C.BURN_N_LABELED, C.BURN_RATIO
    order = f"ORDER BY md5('{seed}:' || id), id"
    masked = {
        "ratio": f"row_number() OVER (PARTITION BY label {order}) <= floor(count(*) OVER (PARTITION BY label) * {_dbl(value)})",
        "uniform": f"row_number() OVER ({order}) <= floor(count(*) OVER () * {_dbl(value)})",
        "budget": f"row_number() OVER (PARTITION BY label {order}) <= floor(count(*) OVER (PARTITION BY label) * (SELECT q FROM quota))",
    }[kind]
    return (
        f"pts0 AS ({pts_sql()}), sp AS ({mask_sql('pts0', 'id', 'label', X.TEST_RATIO, X.TEST_SEED, out='is_test')}), "
        "test AS (SELECT id, x, label FROM sp WHERE is_test), tr0 AS (SELECT id, x, label FROM sp WHERE NOT is_test), "
        "sz AS (SELECT label, count(*) AS n FROM tr0 GROUP BY 1), "
        f"sz2 AS (SELECT label, {n_l} + least(CAST(floor({_dbl(n_l)} * (1.0 / {_dbl(ratio)} - 1.0)) AS BIGINT), n - {n_l}) AS nb FROM sz), "
        f"r1 AS (SELECT p.*, sz2.nb, row_number() OVER (PARTITION BY p.label ORDER BY md5('{seed}:' || p.id), p.id) AS r FROM tr0 p JOIN sz2 USING (label)), "
        "bi AS (SELECT *, r <= nb AS burn_in FROM r1), "
        f"ob AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:obs:' || id), id) <= {n_l} AS obs FROM bi WHERE burn_in), "
        "burn AS (SELECT bi.id, bi.x, bi.label, bi.burn_in, coalesce(ob.obs, FALSE) AS observed, CASE WHEN bi.burn_in THEN bi.r END AS burn_rank FROM bi LEFT JOIN ob USING (id)), "
        "tally AS (SELECT count(DISTINCT label) AS c, count(*) FILTER (observed) AS b, count(*) FILTER (NOT burn_in) AS r, count(*) FILTER (burn_in) AS nb FROM burn), "
        f"quota AS (SELECT CAST({value} * c - b AS DOUBLE) / CAST(r AS DOUBLE) AS q FROM tally), "
        f"rest AS (SELECT id, x, label, burn_in, {masked} AS observed, burn_rank FROM burn WHERE NOT burn_in), "
        "allr AS (SELECT id, x, label, burn_in, observed, burn_rank FROM burn WHERE burn_in UNION ALL SELECT id, x, label, burn_in, observed, burn_rank FROM rest), "
        "st AS (SELECT *, row_number() OVER (ORDER BY (NOT burn_in), CASE WHEN burn_in THEN label END NULLS FIRST, burn_rank NULLS FIRST, "
        f"CASE WHEN NOT burn_in THEN md5('{seed}:order:' || id) END NULLS FIRST, id) - 1 AS seq FROM allr), "
        f"pts AS (SELECT id, x, label, observed, CASE WHEN seq < nb THEN 0 ELSE 1 + (seq - nb) // greatest(1, CAST(ceil(r / {_dbl(C.STREAM_STEPS)}) AS BIGINT)) END AS step FROM st, tally)"
    )


def _named(sql: str, names: list[str], t: int) -> str:
    """The CTE text with its tables ``names`` numbered by ``t``."""
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: f"{m[1]}_{t}", sql)


def step_cte(t: int, theta: float) -> str:
    """Step ``t`` of a run: rebuild with the rows of the batch, first estimates, hops, normalised estimates ``out_t``; errors ``ev_t``."""
    before = "fin" if t == 1 else f"out_{t - 1}"
    graph = _named(graph_cte(f"all_{t}"), ["pairs", "ranked", "edges", "trans"], t)
    parts = [
        f"all_{t} AS (SELECT * FROM pts WHERE step <= {t})", f"new_{t} AS (SELECT * FROM pts WHERE step = {t})", graph,
        f"cap_{t} AS (SELECT CAST(floor(ln(greatest(count(*), 1)) / ln({X.K_U})) AS INTEGER) AS h FROM all_{t} WHERE NOT observed)",
        f"yl_{t} AS (SELECT p.id, c.class, CASE WHEN p.label = c.class THEN 1.0 ELSE 0.0 END AS y FROM all_{t} p, classes c WHERE p.observed)",
        f"uni_{t} AS (SELECT n.id, c.class, 1.0 / (SELECT c FROM nc) AS p FROM new_{t} n, classes c WHERE NOT n.observed)",
        f"fb_{t} AS (SELECT id, class, p FROM {before} UNION ALL SELECT * FROM uni_{t})",
    ]
    product = (
        "coalesce(sum(CASE WHEN t.dst_obs THEN t.p * y.y ELSE t.p * f.p END), 0.0) AS p FROM {rows} r "
        f"LEFT JOIN trans_{t} t ON t.src = r.id LEFT JOIN yl_{t} y ON t.dst_obs AND y.id = t.dst AND y.class = r.class "
        "LEFT JOIN {f} f ON NOT t.dst_obs AND f.id = t.dst AND f.class = r.class GROUP BY r.id, r.class"
    )
    parts += [
        f"cur_{t}_0 AS (SELECT id, class, p FROM {before} UNION ALL SELECT r.id, r.class, " + product.format(rows=f"uni_{t}", f=f"fb_{t}") + ")",
        f"fr_{t}_1 AS (SELECT DISTINCT src AS id FROM trans_{t} WHERE dst IN (SELECT id FROM new_{t}))",
        f"tent_{t}_0 AS (SELECT r.id, r.class, " + product.format(rows=f"(SELECT x.id, c.class FROM fr_{t}_1 x, classes c)", f=f"cur_{t}_0") + ")",
    ]
    for h in range(1, CHAIN_HOPS + 1):
        a, b = f"{t}_{h - 1}", f"{t}_{h}"
        parts += [
            f"cd_{b} AS (SELECT t.id, t.class, t.p - c.p AS d FROM tent_{a} t JOIN fr_{b} USING (id) JOIN cur_{a} c USING (id, class) WHERE {h} <= (SELECT h FROM cap_{t}))",
            f"ap_{b} AS (SELECT id FROM cd_{b} GROUP BY id HAVING sum(abs(d)) > {_dbl(max(theta, 1e-12))})",
            f"cur_{b} AS (SELECT c.id, c.class, coalesce(t.p, c.p) AS p FROM cur_{a} c LEFT JOIN (SELECT * FROM tent_{a} WHERE id IN (SELECT id FROM ap_{b})) t USING (id, class))",
            f"ct_{b} AS (SELECT tr.src AS id, u.class, sum(tr.p * u.d) AS p FROM trans_{t} tr JOIN cd_{b} u ON tr.dst = u.id WHERE NOT tr.dst_obs AND u.id IN (SELECT id FROM ap_{b}) GROUP BY tr.src, u.class)",
            f"fr_{t}_{h + 1} AS (SELECT DISTINCT id FROM ct_{b})",
            f"tent_{b} AS (SELECT id, class, sum(p) AS p FROM (SELECT * FROM tent_{a} UNION ALL SELECT c.id, c.class, c.p FROM cur_{b} c WHERE c.id IN (SELECT id FROM fr_{t}_{h + 1}) "
            f"AND c.id NOT IN (SELECT id FROM tent_{a}) UNION ALL SELECT * FROM ct_{b}) GROUP BY id, class)",
        ]
    hops = " + ".join(f"CASE WHEN {h} <= (SELECT h FROM cap_{t}) AND (SELECT count(*) FROM fr_{t}_{h}) > 0 THEN 1 ELSE 0 END" for h in range(1, CHAIN_HOPS + 1))
    updates = " + ".join(f"(SELECT count(*) FROM ap_{t}_{h})" for h in range(1, CHAIN_HOPS + 1))
    parts.append(f"out_{t} AS (SELECT id, class, coalesce(p / nullif(sum(abs(p)) OVER (PARTITION BY id), 0.0), 0.0) AS p FROM cur_{t}_{CHAIN_HOPS})")
    return ", ".join(parts) + ", " + _errors(t, f"out_{t}", hops, updates)


def _errors(t: int, f: str, hops: str, updates: str) -> str:
    rows = _named(rowm_cte(f, f"(SELECT id, label FROM pts WHERE NOT observed AND step <= {t})"), ["nclass", "cl", "cn", "rowm"], t)
    return rows + (
        f", ev_{t} AS (SELECT CAST({t} AS INTEGER) AS step, (SELECT count(*) FROM pts WHERE observed AND step <= {t}) AS n_labeled, (SELECT count(*) FROM pts WHERE NOT observed AND step <= {t}) AS n_unlabeled, "
        f"CAST({hops} AS BIGINT) AS hops, CAST({updates} AS BIGINT) AS n_updates, round(avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END), 6) AS clf_error_mixed, round(avg(l1), 6) AS l1_error_mixed, "
        f"round((coalesce(sum(entropy) FILTER (WHERE valid), 0.0) + count(*) FILTER (WHERE NOT valid)) / count(*), 6) AS entropy_pred_mixed FROM rowm_{t})"
    )


def chain_sql(variant: int, pts: str, theta: float) -> str:
    """One variant's whole run: offline fit of the burn-in, the steps one after the other, test errors of the last."""
    last = C.STREAM_STEPS
    share = "coalesce(exp(-d2) / nullif(sum(exp(-d2)) OVER (PARTITION BY src), 0.0), 0.0) AS pn"
    parts = [
        pts, "s0 AS (SELECT * FROM pts WHERE step = 0)", graph_cte("s0"), lp_cte("s0"), _errors(0, "fin", "0", "0"), *[step_cte(t, theta) for t in range(1, last + 1)],
        f"wl AS (SELECT src, dst, {share} FROM ({knn_sql('test', '(SELECT * FROM pts WHERE observed)', X.K_L, False)}))",
        f"wu AS (SELECT src, dst, {share} FROM ({knn_sql('test', '(SELECT * FROM pts WHERE NOT observed)', X.K_U, False)}))",
        "tsk AS (SELECT t.id, c.class FROM test t, classes c)",
        f"pk AS (SELECT s.id, s.class, coalesce(sum(wl.pn * y.y), 0.0) AS p FROM tsk s LEFT JOIN wl ON wl.src = s.id LEFT JOIN yl_{last} y ON y.id = wl.dst AND y.class = s.class GROUP BY s.id, s.class)",
        f"pu AS (SELECT s.id, s.class, coalesce(sum(wu.pn * f.p), 0.0) AS p FROM tsk s LEFT JOIN wu ON wu.src = s.id LEFT JOIN out_{last} f ON f.id = wu.dst AND f.class = s.class GROUP BY s.id, s.class)",
        "pc AS (SELECT id, class, pk.p + pu.p AS p FROM pk JOIN pu USING (id, class))",
        f"dk AS ({decode_sql('pk', 'pred_knn')})", f"dc AS ({decode_sql('pc', 'pred_combined')})",
        "te AS (SELECT round(avg(CASE WHEN pred_knn <> label THEN 1.0 ELSE 0.0 END), 6) AS error_knn, round(avg(CASE WHEN pred_combined <> label THEN 1.0 ELSE 0.0 END), 6) AS error_combined "
        "FROM dk JOIN dc USING (id) JOIN test USING (id))",
    ]
    steps = " UNION ALL ".join(f"SELECT * FROM ev_{t}" for t in range(last + 1))
    return f"(WITH {', '.join(parts)} SELECT CAST({variant} AS INTEGER) AS variant, e.*, te.* FROM ({steps}) e, te)"


def q_stream_runs() -> str:
    return " UNION ALL ".join(chain_sql(n, stream_pts(X.SEED * n, "ratio", C.REST_RATIO), X.THETA) for n in range(C.N_RUNS))


def q_stream_theta() -> str:
    return " UNION ALL ".join(chain_sql(k, stream_pts(X.SEED, "ratio", C.REST_RATIO), th) for k, th in enumerate(C.SWEEP_THETA))


def q_stream_budgets() -> str:
    return " UNION ALL ".join(chain_sql(k, stream_pts(X.SEED, "budget", b), X.THETA) for k, b in enumerate(C.SWEEP_BUDGETS))


def q_stream_ratios() -> str:
    return " UNION ALL ".join(chain_sql(k, stream_pts(X.SEED, "uniform", r), X.THETA) for k, r in enumerate(C.SWEEP_RATIOS))


ORACLE.update({"stream_runs": q_stream_runs, "stream_theta": q_stream_theta, "stream_budgets": q_stream_budgets, "stream_ratios": q_stream_ratios})


def q_knn_ties() -> str:
    pts = ("pts AS (SELECT p_partkey AS id, [CAST(p_size % 8 AS DOUBLE), CAST(CAST(floor(p_retailprice / 50) AS BIGINT) % 8 AS DOUBLE)] AS x FROM part)")
    return f"WITH {pts}, nn AS ({knn_sql('pts', 'pts', 3, True)}) " + edge_out("nn")


ORACLE.update({"knn_ties": q_knn_ties, "knn_ties_pruned": q_knn_ties, "knn_pruned": q_knn_part, "graph_pruned": q_knn_graph, "predict_pruned": q_predict_knn})


def q_stored_report() -> str:
    """The report over all runs at once: what the merged moments of the stored parts have to equal."""
    cols = {"clf_error_mixed": "avg(CASE WHEN pred <> tru THEN 1.0 ELSE 0.0 END)", "l1_error_mixed": "avg(l1)"}
    runs = [
        f"(WITH {uniform_pts(r, seed)}, {graph_cte('pts')}, {lp_cte()}, {rowm_cte()}, ev AS (SELECT {', '.join(f'{x} AS {m}' for m, x in cols.items())} FROM rowm) "
        + " UNION ALL ".join(f"SELECT '{r}' AS value, '{m}' AS metric, CAST({m} AS DOUBLE) AS score FROM ev" for m in cols) + ")"
        for seed in C.STORED_SEEDS for r in C.STORED_RATIOS]
    return (f"WITH s AS ({' UNION ALL '.join(runs)}) SELECT value, metric, CAST(0 AS INTEGER) AS t, count(*) AS n_runs, "
            "round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY value, metric")


ORACLE.update({"stored_report": q_stored_report})
