"""Label propagation over the kNN graph.

Distributions are long form ``(id, class, p)``.  With ``P`` the transition
probabilities of unlabelled sources (``trans``: ``src, dst, dst_obs, p``), ``Y_l`` the
one-hot labels and ``F`` the estimates of unlabelled nodes:

* offline (L2):  ``F <- P_ul Y_l + P_uu F`` until ``max |dF| < tol`` or ``max_iter``;
  ``P_ul Y_l`` is computed once.  Inside the loop ``F`` is wide: one row per node and
  ``WIDTH`` classes, a column per class.  ``P_uu`` is written once as a table bucketed by
  ``dst``, the static part and every iterate as tables in as many buckets by id: an iteration
  shuffles the products to their ``src``, neither the graph nor ``F``.  A node with more than
  ``HUB_EDGES`` edges to it has them in several buckets (salted), and its row of ``F`` goes to
  each (only then ``F`` is shuffled).  Every iterate is written to the shared
  folder with its change, so lineage never grows and a lost executor costs one step;
* local (L5-L10): after new nodes arrive, only rows that point at changed rows are
  recomputed, hop by hop; a change is applied where ``||dF||_1 > theta``.
  The rows are wide here too.  The graph, ``F`` and the touched rows lie in buckets as above: a hop
  shuffles the products of the applied changes, and the driver only sees counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from seedspread.session import buckets_kept, discard, materialize, remove_path, scratch_dir, shuffles_dropped


# ---------------------------------------------------------------- L1
def uniform_start(ids: DataFrame, classes: Sequence[int], id_col: str = "id") -> DataFrame:
    """``1/C`` for every class of every given id."""
    c = len(classes)
    return ids.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.lit(int(k)) for k in classes])).alias("class")).withColumn(
        "p", F.lit(1.0 / c))


def zeros(ids: DataFrame, classes: Sequence[int], id_col: str = "id") -> DataFrame:
    return uniform_start(ids, classes, id_col).withColumn("p", F.lit(0.0))


# ---------------------------------------------------------------- L4
def normalize_l1(f: DataFrame, group_col: str | None = None) -> DataFrame:
    """Rows divided by their L1 norm; all-zero rows stay zero."""
    s = F.sum(F.abs("p")).over(Window.partitionBy(*([group_col] if group_col else []), "id"))
    return f.withColumn("p", F.coalesce(F.col("p") / F.nullif(s, F.lit(0.0)), F.lit(0.0)))


def _edge_products(edges: DataFrame, values: DataFrame, gc: Sequence[str], slots: Sequence[str]) -> DataFrame:
    """``p(src, dst) * values(dst)`` of each edge, as wide rows of ``src``."""
    met = edges.join(values.withColumnRenamed("id", "dst"), [*gc, "dst"])
    return met.selectExpr(*gc, "src as id", "chunk", *[f"p * {c} as {c}" for c in slots])


def labels_onehot(y_l: DataFrame) -> DataFrame:
    """``(id, class, p)`` one-hot rows -> ``(id, class, y)`` as used by the products."""
    return y_l.withColumnRenamed("p", "y")


@dataclass
class OfflineResult:
    f: DataFrame
    n_iter: int
    residuals: list = field(default_factory=list)


# a change of a row that rounding alone can make is no change, whatever theta
LEAST_CHANGE = 1e-12
# classes per wide row, and edges of one node in one bucket
WIDTH = 64
HUB_EDGES = 100_000
# edges of one bucket of the graph's table, and the most buckets that Spark allows by default
BUCKET_EDGES, MAX_BUCKETS = 2_000_000, 100_000


def bucket_count(n_edges: int) -> int:
    """Buckets of the graph's table: by its edges, whatever the session's shuffle partitions are."""
    return min(MAX_BUCKETS, max(1, math.ceil(n_edges / BUCKET_EDGES)))


def _slots(classes: Sequence[int]) -> list[str]:
    return [f"c{j}" for j in range(min(len(classes), WIDTH))]


def _chunked(ids: DataFrame, keys: Sequence[str], classes: Sequence[int], value: float) -> DataFrame:
    """One wide row per id and chunk of classes, with one value everywhere."""
    n_chunks = -(-len(classes) // WIDTH)
    rows = ids.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    return rows.selectExpr(*keys, "chunk", *[f"{float(value)!r}D as {c}" for c in _slots(classes)])


def _widened(rows: DataFrame, keys: Sequence[str], classes: Sequence[int], value: str) -> DataFrame:
    """Long ``(keys, class, value)`` rows, summed up per key, as wide rows."""
    at = F.array_position(F.array(*[F.lit(int(c)) for c in classes]), F.col("class").cast("int")) - 1
    placed = rows.select(*keys, at.alias("_at"), F.col(value).alias("_v")).where("_at >= 0")
    placed = placed.select(*keys, F.floor(F.col("_at") / WIDTH).cast("int").alias("chunk"), (F.col("_at") % WIDTH).alias("_slot"), "_v")
    sums = [F.expr(f"coalesce(sum(if(_slot = {j}, _v, null)), 0D) as {c}") for j, c in enumerate(_slots(classes))]
    return placed.groupBy(*keys, "chunk").agg(*sums)


def _long(f: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Wide rows as ``(keys, class, p)``."""
    slots = _slots(classes)
    entries = ", ".join(f"named_struct('at', chunk * {WIDTH} + {j}, 'p', {c})" for j, c in enumerate(slots))
    rows = f.selectExpr(*keys, f"explode(array({entries})) as e").where(F.col("e.at") < len(classes))
    return rows.select(*keys, F.element_at(F.array(*[F.lit(int(c)) for c in classes]), F.col("e.at") + 1).alias("class"), F.col("e.p").alias("p"))


class _Buckets:
    """A table in ``n`` buckets by ``by``, in the shared folder."""

    def __init__(self, df: DataFrame, n: int, by: Sequence[str], name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path, self.name = scratch_dir(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        try:
            with shuffles_dropped(self.spark), buckets_kept(self.spark):
                df.write.option("path", self.path).bucketBy(n, *by).sortBy(*by).saveAsTable(self.name)
        except Exception:
            self.drop()
            raise

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows without the name, which goes; ``discard`` removes the files."""
        self.forget()
        back = self.spark.read.schema(self.schema).parquet(self.path)
        back._materialized_path = self.path
        return back

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.forget()
        remove_path(self.spark, self.path)


class _Graph:
    """``P_uu`` as a table bucketed by the node that edges point at, with the hubs' salts."""

    def __init__(self, uu: DataFrame, keys: Sequence[str]):
        self.spark, self.keys = uu.sparkSession, list(keys)
        degrees = uu.groupBy(*self.keys, "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_EDGES)
        self.hubs = materialize(degrees.select(*self.keys, "dst", F.ceil(F.col("n") / HUB_EDGES).cast("int").alias("parts")), "hubs")
        self.salted = not self.hubs.isEmpty()
        # without hubs buckets are by the node alone, so that estimates in buckets by id meet it where they lie
        at, salt = [*self.keys, "dst"], []
        if self.salted:
            uu = uu.join(self.hubs, at, "left")
            salt = [F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")]
            at = [*at, "salt"]
        self.buckets = max(bucket_count(uu.count()), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism))
        rows = uu.select(*self.keys, "src", "dst", "p", *salt).repartition(self.buckets, *at)
        self.table = _Buckets(rows, self.buckets, at, "transitions")
        self.name = self.table.name

    def products(self, f: DataFrame, slots: Sequence[str]) -> DataFrame:
        """``p(src, dst) * f(dst)`` of each edge, as wide rows of ``src``."""
        rows, at = f.withColumnRenamed("id", "dst"), [*self.keys, "dst"]
        if self.salted:
            rows = rows.join(self.hubs, at, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            at = [*at, "salt"]
        met = self.table.rows().join(rows, at)
        return met.selectExpr(*self.keys, "src as id", "chunk", *[f"p * {c} as {c}" for c in slots])

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows by id dealt like the buckets of the estimates."""
        return rows.repartition(self.buckets, *self.keys, "id")

    def stored(self, rows: DataFrame, name: str) -> _Buckets:
        """Rows that are ``placed``, as a table in buckets by id."""
        return _Buckets(rows, self.buckets, [*self.keys, "id"], name)

    def drop(self) -> None:
        self.table.drop()
        discard(self.hubs)


def _step(graph: _Graph, base: DataFrame, f: DataFrame, keys: Sequence[str], slots: Sequence[str]) -> DataFrame:
    """The next iterate and the largest change of each row (``d``): one aggregation of the products, the static part and the last iterate.

    Where both are in buckets by id only the products are shuffled: a union of rows that are dealt alike is dealt so
    too (as Spark sees it, if the columns are alike to the last: hence the new names).
    """
    minus, node = [f"m_{c}" for c in slots], [f"{k} as _{k}" for k in keys]
    none = [f"0D as {m}" for m in minus]
    gain = base.selectExpr(*node, "chunk", *slots, *none).unionByName(graph.placed(graph.products(f, slots)).selectExpr(*node, "chunk", *slots, *none))
    last = f.selectExpr(*node, "chunk", *[f"0D as {c}" for c in slots], *[f"{c} as {m}" for c, m in zip(slots, minus)])
    new = gain.unionByName(last).groupBy(*[f"_{k}" for k in keys], "chunk").agg(*[F.expr(f"sum({c}) as {c}") for c in [*slots, *minus]])
    change = [f"abs({c} - {m})" for c, m in zip(slots, minus)]
    return new.selectExpr(*[f"_{k} as {k}" for k in keys], "chunk", *slots, (f"greatest({', '.join(change)})" if len(change) > 1 else change[0]) + " as d")


# ---------------------------------------------------------------- L2 / L3
def offline_propagate(
    trans: DataFrame,
    y_l: DataFrame,
    unlabeled_ids: DataFrame,
    classes: Sequence[int],
    *,
    f0: DataFrame | None = None,
    max_iter: int = 30,
    tol: float = 1e-3,
    group_col: str | None = None,
) -> OfflineResult:
    """Iterate ``F <- P_ul Y_l + P_uu F`` from ``f0`` (uniform by default).

    ``trans``: ``(src, dst, dst_obs, p)`` of unlabelled sources; ``y_l``: one-hot
    ``(id, class, p)`` of labelled nodes; ``unlabeled_ids``: ``(id)``.
    Returns the last ``F`` (not normalised; see ``normalize_l1``), the number of
    iterations and the max change of each iteration.

    With ``group_col`` on every input, independent propagations (sweep variants)
    run in the same jobs; each group stops at its own convergence and its rows are
    left where they are from then on; ``n_iter`` / ``residuals`` become dicts per group.
    """
    gc = [group_col] if group_col else []
    keys, slots = [*gc, "id"], _slots(classes)
    t = materialize(trans.select(*gc, "src", "dst", "dst_obs", "p"), "graph")
    ids = unlabeled_ids.select(*gc, "id")
    y = labels_onehot(y_l.where(F.col("p") != 0))  # zeros add nothing
    static = t.where(F.col("dst_obs")).join(y.withColumnRenamed("id", "dst"), gc + ["dst"]).select(
        *gc, F.col("src").alias("id"), "class", (F.col("p") * F.col("y")).alias("p"))
    graph = _Graph(t.where(~F.col("dst_obs")), gc)
    held: list[_Buckets] = []
    try:
        # the static term, with a row for every id and chunk
        rows = graph.placed(_chunked(ids, keys, classes, 0.0).unionByName(_widened(static, keys, classes, "p")))
        held.append(graph.stored(rows.groupBy(*keys, "chunk").agg(*[F.expr(f"sum({c}) as {c}") for c in slots]), "static"))
        base = held[0].rows()
        start = _chunked(ids, keys, classes, 1.0 / max(1, len(classes))) if f0 is None else _widened(f0, keys, classes, "p")
        f = graph.stored(graph.placed(start), "estimates")
        held.append(f)
        active = sorted(r[0] for r in base.select(group_col).distinct().collect()) if gc else []
        done: list[tuple[_Buckets, list]] = []
        residuals: dict | list = {} if gc else []
        n_iters: dict = {}
        n_iter = 0
        while n_iter < max_iter and (active or not gc):
            here, last = (x.where(F.col(group_col).isin(active)) if gc else x for x in (base, f.rows()))
            # the largest changes are observed while the iterate is written: no second job
            n_iter += 1
            obs = Observation(f"lp_change_{n_iter}")
            d = [F.max(F.when(F.col(group_col) == gv, F.col("d"))).alias(f"d{n}") for n, gv in enumerate(active)] if gc else [F.max("d").alias("d0")]
            step = graph.stored(_step(graph, here, last, keys, slots).observe(obs, *d), "estimates")
            held.append(step)
            if not any(f is x for x, _ in done):
                f.drop()
            f = step
            found = [float(obs.get.get(f"d{n}") or 0.0) for n in range(len(d))]
            if not gc:
                residuals.append(found[0])
                if found[0] < tol:
                    break
                continue
            per = dict(zip(active, found, strict=True))
            for gv in active:
                residuals.setdefault(gv, []).append(per[gv])
                n_iters[gv] = n_iter
            ended = [gv for gv in active if per[gv] < tol]
            if ended:
                # kept as they are: the files of this iterate stay
                done.append((f, ended))
                active = [gv for gv in active if gv not in ended]
    finally:
        for x in held:
            x.forget()
        if held:
            held[0].drop()
        graph.drop(), discard(t)
    if not gc:
        return OfflineResult(_long(f.files(), keys, classes), n_iter, residuals)
    parts = done + ([(f, active)] if active else [])
    out = None
    for x, groups in parts:
        part = _long(x.files().where(F.col(group_col).isin(groups)), keys, classes)
        out = part if out is None else out.unionByName(part)
    return OfflineResult(_long(f.files(), keys, classes) if out is None else out, n_iters, residuals)


# ---------------------------------------------------------------- L10 hop cap
def hop_cap(n_unlabeled: int, k_unlabeled: int, max_iter: int = 30) -> int:
    """``int(ln u / ln k_u)`` (same float formula as the reference, so 243 rows with k_u=3 give 4)."""
    u = max(n_unlabeled, 1)
    if k_unlabeled > 1:
        return int(math.log(u) / math.log(k_unlabeled))
    return max_iter


@dataclass
class LocalResult:
    f: DataFrame
    hops: int | dict
    frontier_sizes: list | dict = field(default_factory=list)
    applied_per_hop: list | dict = field(default_factory=list)
    changed_ids: DataFrame | None = None


def _of_group(values, group_col: str | None):
    """A parameter as a column: one value, or one per group."""
    if not isinstance(values, Mapping):
        return F.lit(values)
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(group_col))


# ---------------------------------------------------------------- L5 - L10
def propagate_local(
    trans: DataFrame,
    y_l: DataFrame,
    f: DataFrame,
    new_nodes: DataFrame,
    classes: Sequence[int],
    *,
    theta: float | Mapping,
    max_hops: int | Mapping,
    top_ratio: float | None = None,
    group_col: str | None = None,
) -> LocalResult:
    """Local propagation after a batch of arrivals (graph and ``trans`` already updated).

    ``new_nodes``: ``(id, observed)`` of the batch; ``f``: estimates of the stored
    unlabelled nodes (new unlabelled nodes may be missing: they start uniform).
    L5: a new unlabelled node gets its first estimate from its own row.
    L6: the first frontier are unlabelled sources pointing at a new node; their
    tentative label is their full row recomputed.
    L7 (or L8 with ``top_ratio``): apply tentative labels that changed by more than theta
    (and by more than ``LEAST_CHANGE``, which is rounding: it matters for a theta of 0).
    L9: each applied change ``d`` at node ``j`` adds ``p(i, j) * d`` to every source ``i``
    pointing at ``j``; those sources form the next frontier; unapplied tentative
    labels are kept for later hops of the same batch.
    Returns the new ``F`` (changed rows L1-normalised).

    With ``group_col`` on every input, many variants (seeds, thetas, label ratios) take the
    same hops together: ``theta`` and ``max_hops`` may be given per group, a group stops at
    its own cap or empty frontier, and the counts of the result are dicts by group.
    """
    if group_col and top_ratio is not None:
        raise ValueError("top_ratio takes the largest changes of one learner: not with group_col")
    gc = [group_col] if group_col else []
    keys, slots = [*gc, "id"], _slots(classes)
    at, one = [*keys, "chunk"], len(classes) <= WIDTH
    t = materialize(trans.select(*gc, "src", "dst", "dst_obs", "p"), "local-graph")
    y = _widened(y_l, keys, classes, "p")
    new_u = new_nodes.where(~F.col("observed")).select(*keys)
    stored = _widened(f, keys, classes, "p").join(new_u, keys, "left_anti")

    def full_rows(ids: DataFrame, estimates: DataFrame) -> DataFrame:
        """``P_ul Y_l + P_uu F`` of some sources, zeros where they have no edge."""
        edges = t.join(ids.withColumnRenamed("id", "src"), [*gc, "src"], "left_semi")
        parts = [_edge_products(edges.where(F.col("dst_obs") == obs), values, gc, slots) for obs, values in ((True, y), (False, estimates))]
        return _chunked(ids, keys, classes, 0.0).unionByName(parts[0]).unionByName(parts[1]).groupBy(*at).agg(*[F.expr(f"sum({c}) as {c}") for c in slots])

    graph = _Graph(t.where(~F.col("dst_obs")), gc)
    held: list[_Buckets] = []
    hops: dict = {}
    sizes: dict = {}
    applied_counts: dict = {}
    hop = 0
    cap = lambda g: max_hops[g] if isinstance(max_hops, Mapping) else max_hops
    thetas = {g: float(x) for g, x in theta.items()} if isinstance(theta, Mapping) else float(theta)
    tent, gain, known = ([f"{x}_{c}" for c in slots] for x in "tgk")
    # written with the rows: a filter on all the differences would make Spark derive 2^slots constraints
    moved_by = " + ".join(f"abs({x} - {c})" for x, c in zip(tent, slots)) + " as norm"
    try:
        # First estimates of the new unlabelled nodes (a neighbour inside the batch counts as uniform)
        first = full_rows(new_u, stored.unionByName(_chunked(new_u, keys, classes, 1.0 / max(1, len(classes)))))
        rows = stored.withColumn("fresh", F.lit(False)).unionByName(first.withColumn("fresh", F.lit(True)))
        base = graph.stored(graph.placed(rows), "local_estimates")
        held.append(base)
        # frontier = unlabelled sources that point at any new node
        new_ids = new_nodes.select(*gc, F.col("id").alias("dst"))
        frontier = t.join(new_ids, [*gc, "dst"], "left_semi").select(*gc, F.col("src").alias("id")).distinct()
        rows = full_rows(frontier, base.rows().drop("fresh")).withColumnsRenamed(dict(zip(slots, tent)))
        # the touched rows: their estimate, their tentative one, whether they are in the frontier, were just
        # applied, or ever; each hop writes them once and reads from F only what it reaches
        rows = rows.join(base.rows().drop("fresh"), at).selectExpr(*at, *slots, *tent, "true as front", "false as applied", "false as ever", moved_by)
        touched = graph.stored(graph.placed(rows), "touched")
        held.append(touched)
        # nodes in the frontier of each group; later counts are observed while the rows are written
        marks = touched.rows().where("chunk = 0").groupBy(*gc).agg(F.count_if("front").alias("n")).collect()
        counts = {r[group_col] if gc else None: r["n"] for r in marks}
        groups = list(counts)
        counts = {g: n for g, n in counts.items() if n and cap(g) > 0}
        while counts:
            for g, n in counts.items():
                hops[g] = hop + 1
                sizes.setdefault(g, []).append(n)
            live = F.col(group_col).isin(list(counts)) if gc else F.lit(True)
            if top_ratio is None:
                norm = F.col("norm") if one else F.sum("norm").over(Window.partitionBy(*keys))
                marked = touched.rows().withColumn("go", F.col("front") & live & (norm > F.greatest(_of_group(thetas, group_col), F.lit(LEAST_CHANGE))))
            else:
                # The int(ratio * n) largest changes (a top-k: the limit is the feature)
                norms = touched.rows().where("front").groupBy("id").agg(F.sum("norm").alias("norm"))
                top = norms.orderBy(F.col("norm").desc(), F.col("id")).limit(int(top_ratio * counts[None])).select("id", F.lit(True).alias("go"))
                marked = touched.rows().join(top, "id", "left").withColumn("go", F.coalesce("go", F.lit(False)))
            # Push each applied change to the sources pointing at it
            updates = marked.where("go").selectExpr(*at, *[f"{x} - {c} as {c}" for x, c in zip(tent, slots)])
            contrib = graph.placed(graph.products(updates, slots)).groupBy(*at).agg(*[F.expr(f"sum({c}) as {x}") for c, x in zip(slots, gain)])
            reached = base.rows().withColumnsRenamed(dict(zip(slots, known))).join(contrib.drop("chunk") if one else contrib, keys if one else at)
            # a union of rows that are dealt alike is dealt so too: new names, see _step
            node = [f"{k} as _{k}" for k in keys]
            moves = [f"if(go, {x}, {c}) as {c}" for x, c in zip(tent, slots)]
            rows = marked.selectExpr(*node, "chunk", *moves, *tent, *[f"cast(null as double) as {x}" for x in known], *[f"0D as {x}" for x in gain],
                                     "false as front", "go as applied", "ever or go as ever")
            rows = rows.unionByName(reached.selectExpr(*node, "chunk", *[f"cast(null as double) as {x}" for x in [*slots, *tent]], *known, *gain,
                                                       "true as front", "false as applied", "false as ever"))
            after = rows.groupBy(*[f"_{k}" for k in keys], "chunk").agg(
                *[F.expr(f"coalesce(max({c}), max({k})) as {c}") for c, k in zip(slots, known)],
                *[F.expr(f"coalesce(max({x}), max({k})) + sum({g}) as {x}") for x, k, g in zip(tent, known, gain)],
                *[F.max(m).alias(m) for m in ("front", "applied", "ever")])
            after = after.selectExpr(*[f"_{k} as {k}" for k in keys], "chunk", *slots, *tent, "front", "applied", "ever", moved_by)
            hop += 1
            obs = Observation(f"local_marks_{hop}")
            of = lambda g: (F.col("chunk") == 0) & ((F.col(group_col).eqNullSafe(F.lit(g))) if gc else F.lit(True))
            found = [F.count_if(of(g) & F.col(m)).alias(f"{m}{n}") for n, g in enumerate(groups) for m in ("front", "applied")]
            step = graph.stored(after.observe(obs, *found), "touched")
            held.append(step)
            touched.drop()
            touched = step
            seen, taken = obs.get, list(counts)
            done = {g: seen.get(f"applied{n}") or 0 for n, g in enumerate(groups)}
            counts = {g: c for g, c in ((g, seen.get(f"front{n}") or 0) for n, g in enumerate(groups)) if c and hop < cap(g)}
            for g in taken:
                applied_counts.setdefault(g, []).append(done[g])
    finally:
        for x in held:
            x.forget()
        graph.drop(), discard(t)
    base, touched = base.files(), touched.files()
    moved = touched.where("ever").select(*at, *slots)
    rest = base.join(moved.select(*keys).distinct(), keys, "left_anti")
    changed = rest.where("fresh").drop("fresh").unionByName(moved)
    # L4
    total = F.expr(" + ".join(f"abs({c})" for c in slots))
    total = F.nullif(total if one else F.sum(total).over(Window.partitionBy(*keys)), F.lit(0.0))
    fixed = changed.withColumn("_s", total).selectExpr(*at, *[f"coalesce({c} / _s, 0D) as {c}" for c in slots])
    out = _long(rest.where(~F.col("fresh")).drop("fresh").unionByName(fixed), keys, classes)
    ids = changed.select(*keys).distinct()
    if gc:
        return LocalResult(out, hops, sizes, applied_counts, ids)
    return LocalResult(out, hops.get(None, 0), sizes.get(None, []), applied_counts.get(None, []), ids)
