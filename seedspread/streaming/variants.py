"""Many learners in one stream (X1, X2, X5, X6): every micro-batch advances all variants together.

A *graph* ``g`` is one labelled arrival order (a seed, a label budget, a label ratio); a
*variant* ``v`` is a graph with a threshold theta.  Points and edges are kept per graph and
estimates per variant, so thetas share one graph and its searches.  A batch holds rows of
any graphs: one grouped insertion (K14, K15) enters them into all graphs, one grouped local
propagation (L5-L10) moves all variants, each with its own theta and hop cap.

The state is that of ``learner``: points per batch, versioned edges and estimates, a
commit row written last; replays and restarts behave alike.  Burn-in is counted per graph:
a graph that completes it in a batch is built and propagated offline (L12), the others go
on.  After each batch one row per variant tells counts, hops, applied updates and errors
(T3, M17), and ``finish`` adds the test errors of the newest version (T4).
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.operators import graph as G
from seedspread.operators import metrics as M
from seedspread.operators import sampling as S
from seedspread.operators.knn import knn_join
from seedspread.operators.predict import from_neighbors
from seedspread.operators.propagate import hop_cap, normalize_l1, offline_propagate, propagate_local
from seedspread.session import materialize, remove_path, scratch_dir, shuffles_dropped
from seedspread.streaming.learner import STREAM_SCHEMA, LearnerConfig, StreamLearner

GRAPH, VARIANT = "g", "v"
POINT_SCHEMA = T.StructType([T.StructField(GRAPH, T.LongType()), *STREAM_SCHEMA.fields])
STEP_METRICS = ("n_labeled", "n_unlabeled", "hops", "n_updates", "seconds")


@dataclass
class VariantConfig(LearnerConfig):
    """``thetas``: variant -> (graph, theta); ``burn_in``: graph -> rows (``n_burn_in`` where it has none)."""

    thetas: Mapping[int, tuple[int, float]] = field(default_factory=lambda: {0: (0, 0.1)})
    burn_in: Mapping[int, int] = field(default_factory=dict)


class VariantLearner(StreamLearner):
    """``foreachBatch`` target for batches ``(g, seq, id, x, label, observed)``."""

    def points(self, version: int | None) -> DataFrame:
        pts = self._read("points", T.StructType([*POINT_SCHEMA.fields, T.StructField("batch", T.IntegerType())]))
        if pts is None or version is None:
            return self.spark.createDataFrame([], POINT_SCHEMA)
        return pts.where(F.col("batch") <= version).drop("batch")

    def _need(self, g: int) -> int:
        return self.cfg.burn_in.get(g, self.cfg.n_burn_in)

    def _variants(self, rows: DataFrame) -> DataFrame:
        """Rows of a graph, once for each of its variants; graphs without one drop out."""
        of: dict[int, list[int]] = {}
        for v, (g, _) in self.cfg.thetas.items():
            of.setdefault(g, []).append(v)
        pairs = F.create_map(*[x for g, vs in of.items() for x in (F.lit(g).cast("long"), F.array(*[F.lit(v).cast("long") for v in vs]))])
        return rows.withColumn(VARIANT, F.explode(F.element_at(pairs, F.col(GRAPH)))).drop(GRAPH)

    def _sizes(self, pts: DataFrame) -> dict[int, tuple[int, int]]:
        """Labelled and unlabelled rows of each graph (a row per graph reaches the driver)."""
        rows = pts.groupBy(GRAPH).agg(F.count_if("observed").alias("l"), F.count_if(~F.col("observed")).alias("u")).collect()
        return {r[0]: (r["l"], r["u"]) for r in rows}

    def process(self, batch: DataFrame, batch_id: int) -> None:
        cfg, tic = self.cfg, time.time()
        self._claim(batch_id)
        prev = self.last_version(below=batch_id)
        stored = self.points(prev)
        rows = batch.select(*[f.name for f in POINT_SCHEMA.fields]).join(stored.select(GRAPH, "id"), [GRAPH, "id"], "left_anti")
        rows = rows.withColumn("observed", F.coalesce("observed", F.lit(False)) & F.col("label").isNotNull())
        # An id counts once per graph, labels that aren't observed aren't stored
        first = rows.groupBy(GRAPH, "id").agg(F.min_by(F.struct("seq", "x", "label", "observed"), F.struct("seq", F.hash("x", "label", "observed"))).alias("r"))
        rows = first.select(GRAPH, "r.seq", "id", "r.x", F.when(F.col("r.observed"), F.col("r.label")).alias("label"), "r.observed")
        rows.write.mode("overwrite").parquet(self._p(f"points/batch={batch_id}"))
        new = self.spark.read.schema(POINT_SCHEMA).parquet(self._p(f"points/batch={batch_id}"))
        arrived = {g: sum(n) for g, n in self._sizes(new).items()}
        if not arrived:
            return
        before = {g: sum(n) for g, n in self._sizes(stored).items()}
        fitted = {g for g, n in before.items() if n >= self._need(g)}
        fitting = {g for g, n in arrived.items() if g not in fitted and before.get(g, 0) + n >= self._need(g)}
        ready, base, entering = fitted | fitting, stored, new
        if fitting:
            left = F.element_at(F.create_map(*[x for g in fitting for x in (F.lit(g).cast("long"), F.lit(self._need(g) - before.get(g, 0)))]), F.col(GRAPH))
            ranked = materialize(S._ranked(new.where(F.col(GRAPH).isin(list(fitting))), [GRAPH], "id", 0, "", False, "seq", "_at"), "burn-in")
            base = stored.unionByName(ranked.where(F.col("_at") <= left).drop("_at"))
            entering = new.where(F.col(GRAPH).isin(list(fitted))).unionByName(ranked.where(F.col("_at") > left).drop("_at"))
        edges, f = (self.edges(prev), self.estimates(prev)) if prev is not None else (None, None)
        if fitting:
            edges, f = self._fit(base.where(F.col(GRAPH).isin(list(fitting))), edges, f)
        if not ready:
            self._end(batch_id, prev, None, None, {}, {}, tic)
            return
        base, entering = (t.where(F.col(GRAPH).isin(list(ready))) for t in (base, entering))
        hops, applied = {}, {}
        if not entering.isEmpty():
            cols = [GRAPH, "id", "x", "observed"]
            edges = materialize(G.insert_nodes(edges, base.select(*cols), entering.select(*cols), cfg.k_labeled, cfg.k_unlabeled, group_col=GRAPH), "edges")
            everything = base.unionByName(entering)
            y_l = S.one_hot(everything.where("observed"), "id", "label", list(cfg.classes), keep=[GRAPH])
            sizes = self._sizes(everything)
            res = propagate_local(
                self._variants(G.transitions(edges, group_col=GRAPH)), self._variants(y_l), f, self._variants(entering.select(GRAPH, "id", "observed")),
                list(cfg.classes), theta={v: float(th) for v, (_, th) in cfg.thetas.items()}, group_col=VARIANT,
                max_hops={v: hop_cap(sizes.get(g, (0, 0))[1], cfg.k_unlabeled, cfg.max_iter) for v, (g, _) in cfg.thetas.items()})
            f, hops, applied = res.f, res.hops, {v: sum(n) for v, n in res.applied_per_hop.items()}
        self._end(batch_id, prev, edges, f, hops, applied, tic)

    def _fit(self, burn: DataFrame, edges: DataFrame | None, f: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """L12 for the graphs of ``burn``, beside those that are there."""
        cfg = self.cfg
        built = materialize(G.build_graph(burn.select(GRAPH, "id", "x", "observed"), cfg.k_labeled, cfg.k_unlabeled, group_col=GRAPH), "edges")
        y_l = S.one_hot(burn.where("observed"), "id", "label", list(cfg.classes), keep=[GRAPH])
        res = offline_propagate(G.transitions(built, group_col=GRAPH), y_l, burn.where(~F.col("observed")).select(GRAPH, "id"), list(cfg.classes),
                                max_iter=cfg.max_iter, tol=cfg.tol, group_col=GRAPH)
        own = materialize(self._variants(normalize_l1(res.f, GRAPH)).select(VARIANT, "id", "class", "p"), "estimates")
        if edges is None:
            return built, own
        return edges.unionByName(built.select(*edges.columns)), f.unionByName(own)

    def _end(self, batch_id, prev, edges, f, hops: dict, applied: dict, tic: float) -> None:
        """Commit the version; then the series of the batch."""
        cfg = self.cfg
        pts = self.points(batch_id)
        sizes = self._sizes(pts)
        if f is not None:
            with shuffles_dropped(f.sparkSession):
                edges.write.mode("overwrite").parquet(self._p(f"edges/v={batch_id}"))
                f.select(VARIANT, "id", "class", "p").write.mode("overwrite").parquet(self._p(f"f/v={batch_id}"))
            now, seconds = self.estimates(batch_id), time.time() - tic
            series = [(v, m, float(x)) for v, (g, _) in cfg.thetas.items() if g in sizes
                      for m, x in zip(STEP_METRICS, (*sizes[g], hops.get(v, 0), applied.get(v, 0), seconds), strict=True)]
            if self.truth is not None:
                series += [(r[VARIANT], m, r[m]) for r in M.evaluate(now, self.truth, len(cfg.classes), group_col=VARIANT).collect() for m in r.asDict() if m != VARIANT]
            rows = [(cfg.run, int(v), batch_id, m, None if x is None else float(x)) for v, m, x in series]
            self.spark.createDataFrame(rows, "run string, v long, batch_id long, metric string, score double").write.mode("overwrite").parquet(self._p(f"metrics/b={batch_id}"))
        l, u = (sum(x) for x in zip(*sizes.values(), strict=True))
        self._write_version(batch_id, dict(n_labeled=l, n_unlabeled=u, phase="burn_in" if f is None else "online", hops=max(hops.values(), default=0), seconds=time.time() - tic))
        self._forget(batch_id, prev)

    def series(self) -> DataFrame:
        """``(run, v, batch_id, metric, score)`` of all committed batches."""
        return self._read("metrics", "run string, v long, batch_id long, metric string, score double, b int").drop("b")

    def finish(self) -> DataFrame:
        """T4, M9: ``(v, error_knn, error_combined)`` of the newest version on the test set.

        The test rows are searched once per graph; variants share the neighbours.
        """
        cfg, v = self.cfg, self.last_version()
        pts, f = self.points(v), self.estimates(v)
        graphs = F.explode(F.array(*[F.lit(g).cast("long") for g in sorted({g for g, _ in cfg.thetas.values()})])).alias(GRAPH)
        query = self.test.select(graphs, "id", "x")
        nn = materialize(knn_join(query, G._kinded(pts, GRAPH), {G.KIND_LABELED: cfg.k_labeled, G.KIND_UNLABELED: cfg.k_unlabeled}, kind_col="kind", group_col=GRAPH), "neighbors")
        # an id has one label, whichever graphs observe it
        y_l = S.one_hot(pts.where("observed").select("id", "label").distinct(), "id", "label", list(cfg.classes))
        p_knn, p_lp = from_neighbors(self._variants(nn), self._variants(query.select(GRAPH, "id")), f, y_l, list(cfg.classes), group_col=VARIANT)
        both = p_knn.withColumnRenamed("p", "pk").join(p_lp, [VARIANT, "id", "class"])
        best = lambda p: F.min_by(F.col("class"), F.struct(-p, F.col("class")))
        pred = both.groupBy(VARIANT, "id").agg(best(F.col("pk")).alias("knn"), best(F.col("pk") + F.col("p")).alias("combined"))
        miss = lambda c: F.avg((F.col(c) != F.col("label")).cast("double"))
        out = pred.join(self.test.select("id", "label"), "id").groupBy(VARIANT).agg(miss("knn").alias("error_knn"), miss("combined").alias("error_combined"))
        out.write.mode("overwrite").parquet(self._p("final"))
        return self.spark.read.parquet(self._p("final"))


def write_steps(points: DataFrame, folder: str, bounds: list[int], files_per_step: int = 1) -> None:
    """A replayable file stream of ``points (g, seq, ...)``: ``files_per_step`` files per step, cut at the places ``bounds`` of ``seq``."""
    spark = points.sparkSession
    ordered = scratch_dir(spark, "stream-order")
    points.select(*[f.name for f in POINT_SCHEMA.fields]).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(ordered)
    rows = spark.read.parquet(ordered)
    for a, b in zip(bounds, bounds[1:], strict=False):
        rows.where((F.col("seq") >= a) & (F.col("seq") < b)).repartition(files_per_step).write.mode("append").parquet(folder)
        time.sleep(0.01)
    remove_path(spark, ordered)


def read_steps(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
