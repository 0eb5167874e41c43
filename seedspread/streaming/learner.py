"""Streaming learner (T1-T6, L11, L12, D11): ``readStream`` -> ``foreachBatch``.

State lives in Parquet tables under one folder of the shared checkpoint storage:

* ``points/batch=<b>``  rows that arrived in batch ``b`` (append-only, vectors are
  never rewritten);
* ``edges/v=<b>``, ``f/v=<b>``  the graph and the estimates after batch ``b``;
* ``meta/v=<b>``  one row per committed batch (written last: the commit mark).

A batch reads the newest committed version below its own id, so a batch that is
replayed after a failure recomputes from the same input and overwrites its own
version: replays are idempotent, and restarting the query from its checkpoint
gives the same state.  Ids already stored are dropped on arrival, and of an id that
comes twice in a batch the first by ``seq`` is taken (D11).  Labels that aren't observed
are not stored (D6).  Versions that no replay needs are removed after each commit.  A
folder with another run's state, or with newer versions than the stream, is refused.

Per batch: burn-in rows are appended until ``n_burn_in`` rows are stored, then the
graph is built and propagated offline (L12); later rows are inserted into the
graph (K14/K15) and propagated locally (L5-L10), then ``F`` is normalised (L4) and
metrics rows are appended (T3, T4) and a row for each new unlabelled point (T5,
``arrivals``); ``finish`` evaluates once more at the end of a stream.  One arrival per batch is exactly the
sequential algorithm; larger batches insert their rows together (the graph stays
exact, ``F`` is the batch approximation described in the README).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.operators import graph as G
from seedspread.operators import metrics as M
from seedspread.operators import sampling as S
from seedspread.operators.predict import predict
from seedspread.operators.propagate import hop_cap, normalize_l1, offline_propagate, propagate_local
from seedspread.session import path_exists, remove_path, scratch_dir, shuffles_dropped

STREAM_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("x", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("observed", T.BooleanType()),
])

METRIC_SCHEMA = "run string, batch_id long, t long, metric string, score double"
META_SCHEMA = "n_labeled long, n_unlabeled long, phase string, hops int, seconds double"


@dataclass
class LearnerConfig:
    classes: Sequence[int]
    k_labeled: int = 3
    k_unlabeled: int = 3
    theta: float = 0.1
    max_iter: int = 30
    tol: float = 1e-3
    n_burn_in: int = 100
    eval_every: int = 1000
    run: str = "run0"


class StreamLearner:
    """``foreachBatch`` target holding no data on the driver, only paths and scalars."""

    def __init__(self, spark: SparkSession, state_dir: str, config: LearnerConfig,
                 truth: DataFrame | None = None, test: DataFrame | None = None):
        self.spark = spark
        self.dir = state_dir.rstrip("/")
        self.cfg = config
        self.truth = truth      # (id, label) of the run, for T3
        self.test = test        # (id, x, label) test set, for T4

    # ------------------------------------------------------------ state io
    def _p(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def _read(self, name: str, schema: str | T.StructType) -> DataFrame | None:
        """A state table, or None if none of it is written yet; any other failure is raised."""
        if not path_exists(self.spark, self._p(name)):
            return None
        return self.spark.read.schema(schema).parquet(self._p(name))

    def last_version(self, below: int | None = None) -> int | None:
        meta = self.meta()
        if meta is None:
            return None
        if below is not None:
            meta = meta.where(F.col("v") < below)
        v = meta.agg(F.max("v").alias("v")).first()["v"]
        return None if v is None else int(v)

    def meta(self) -> DataFrame | None:
        return self._read("meta", f"{META_SCHEMA}, v int")

    def points(self, version: int | None) -> DataFrame:
        pts = self._read("points", T.StructType([*STREAM_SCHEMA.fields, T.StructField("batch", T.IntegerType())]))
        if pts is None or version is None:
            return self.spark.createDataFrame([], STREAM_SCHEMA)
        return pts.where(F.col("batch") <= version).drop("batch")

    def edges(self, version: int) -> DataFrame | None:
        return self._version("edges", version)

    def estimates(self, version: int) -> DataFrame | None:
        return self._version("f", version)

    def _version(self, name: str, version: int) -> DataFrame | None:
        """One version's folder only: older ones are neither listed nor read."""
        path = self._p(f"{name}/v={version}")
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def _claim(self, batch_id: int) -> None:
        """Refuse a folder with another run's state, or one that this stream is behind of."""
        owner = self._read("owner", "run string")
        if owner is None:
            self.spark.createDataFrame([(self.cfg.run,)], "run string").write.mode("overwrite").parquet(self._p("owner"))
        elif (run := owner.first()["run"]) != self.cfg.run:
            raise ValueError(f"{self.dir} holds the state of run {run!r}, not of {self.cfg.run!r}")
        newest = self.last_version()
        if newest is not None and batch_id < newest:
            raise ValueError(f"{self.dir} holds version {newest}, the stream begins again at batch {batch_id}: take a fresh state folder")

    def _forget(self, batch_id: int, prev: int | None) -> None:
        """Remove work tables and the versions before the one that a replay of this batch would read."""
        for name in ("edges_burn", "edges_ins"):
            remove_path(self.spark, self._p(f"_work/{name}/b={batch_id}"))
        if prev is not None and (older := self.last_version(below=prev)) is not None:
            for name in ("edges", "f"):
                remove_path(self.spark, self._p(f"{name}/v={older}"))

    def _write_version(self, batch_id: int, meta_row: dict) -> None:
        self.spark.createDataFrame([meta_row], META_SCHEMA).write.mode("overwrite").parquet(self._p(f"meta/v={batch_id}"))

    def _metrics(self, batch_id: int, t: int, rows: list[tuple[str, float]]) -> None:
        if not rows:
            return
        data = [(self.cfg.run, batch_id, t, m, None if v is None else float(v)) for m, v in rows]
        self.spark.createDataFrame(data, METRIC_SCHEMA).write.mode("overwrite").parquet(self._p(f"metrics/b={batch_id}"))

    # ------------------------------------------------------------ one micro-batch
    def process(self, batch: DataFrame, batch_id: int) -> None:
        cfg = self.cfg
        tic = time.time()
        self._claim(batch_id)
        prev = self.last_version(below=batch_id)
        stored = self.points(prev)
        # An id counts once, also within a batch; D6: labels that aren't observed stay outside
        rows = S.first_of_each(batch.select(*[f.name for f in STREAM_SCHEMA.fields]).join(stored.select("id"), "id", "left_anti"), "id", "seq")
        rows = rows.withColumn("observed", F.coalesce("observed", F.lit(False)) & F.col("label").isNotNull())
        rows = S.hide_labels(rows).withColumn("label", F.col("label_seen")).drop("label_seen")
        # the partition value lives in the folder name (points/batch=<b>)
        rows.write.mode("overwrite").parquet(self._p(f"points/batch={batch_id}"))
        new = self.spark.read.parquet(self._p(f"points/batch={batch_id}"))
        n_new = new.count()
        if n_new == 0:
            return
        counts = stored.agg(F.count_if("observed").alias("l"), F.count_if(~F.col("observed")).alias("u")).first()
        n_stored = (counts["l"] or 0) + (counts["u"] or 0)
        span = new.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        t_first, t_last = span["a"], span["b"]
        phase_prev_online = prev is not None and self.meta().where(F.col("v") == prev).first()["phase"] == "online"
        classes = list(cfg.classes)
        cols = ["id", "x", "observed"]
        hops = 0
        metrics: list[tuple[str, float]] = []
        if not phase_prev_online:
            need = cfg.n_burn_in - n_stored
            if n_new < need:
                c = stored.unionByName(new).agg(F.count_if("observed").alias("l"), F.count_if(~F.col("observed")).alias("u")).first()
                self._write_version(batch_id, dict(n_labeled=c["l"], n_unlabeled=c["u"], phase="burn_in", hops=0, seconds=time.time() - tic))
                return
            # Complete the burn-in with the first rows of this batch, fit offline
            ranked = S.replay(new, "id", seq_col="seq")
            burn = ranked.where(F.col("pos") < need).drop("pos")
            online = ranked.where(F.col("pos") >= need).drop("pos")
            base = stored.unionByName(burn)
            edges = G.build_graph(base.select(*cols), cfg.k_labeled, cfg.k_unlabeled)
            edges = self._materialise(edges, "edges_burn", batch_id)
            y_l = S.one_hot(base.where("observed"), "id", "label", classes)
            res = offline_propagate(G.transitions(edges), y_l, base.where(~F.col("observed")).select("id"), classes,
                                    max_iter=cfg.max_iter, tol=cfg.tol)
            f = normalize_l1(res.f)
            metrics.append(("offline_iterations", res.n_iter))
            stored_now = base
            if online.count() == 0:
                self._commit(batch_id, prev, edges, f, stored_now, None, "online", hops, tic, (t_first, t_last), metrics)
                return
            new = online
        else:
            edges = self.edges(prev)
            f = self.estimates(prev)
            stored_now = stored
        # online insertion of `new` (K14/K15), then local propagation
        edges2 = G.insert_nodes(edges, stored_now.select(*cols), new.select(*cols), cfg.k_labeled, cfg.k_unlabeled)
        edges2 = self._materialise(edges2, "edges_ins", batch_id)
        all_pts = stored_now.unionByName(new)
        y_l = S.one_hot(all_pts.where("observed"), "id", "label", classes)
        n_unl = all_pts.where(~F.col("observed")).count()
        res = propagate_local(G.transitions(edges2), y_l, f, new.select("id", "observed"), classes, theta=cfg.theta,
                              max_hops=hop_cap(n_unl, cfg.k_unlabeled, cfg.max_iter))
        hops = res.hops
        metrics += [("iter_online_count", hops), ("n_updates", float(sum(res.applied_per_hop)))]
        self._commit(batch_id, prev, edges2, res.f, all_pts, new, "online", hops, tic, (t_first, t_last), metrics)

    def _materialise(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = self._p(f"_work/{name}/b={batch_id}")
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _commit(self, batch_id, prev, edges, f, pts, arrived, phase, hops, tic, span, metrics) -> None:
        cfg = self.cfg
        t_first, t_last = span
        c = pts.agg(F.count_if("observed").alias("l"), F.count_if(~F.col("observed")).alias("u")).first()
        edges.write.mode("overwrite").parquet(self._p(f"edges/v={batch_id}"))
        with shuffles_dropped(f.sparkSession):
            f.write.mode("overwrite").parquet(self._p(f"f/v={batch_id}"))
        seconds = time.time() - tic  # the insertion is done: evaluations don't count
        f_now = self.estimates(batch_id)
        if arrived is not None:
            # T5: entropy, confidence and class of each new unlabelled row
            stats = M.point_stats(f_now.join(arrived.where(~F.col("observed")).select("id"), "id", "left_semi"), len(cfg.classes))
            rows = arrived.select("seq", "id").join(stats, "id")
            rows.select("seq", "id", "entropy", "confidence", "pred").write.mode("overwrite").parquet(self._p(f"arrivals/b={batch_id}"))
            ps = self.spark.read.parquet(self._p(f"arrivals/b={batch_id}")).agg(F.avg("entropy").alias("e"), F.avg("confidence").alias("c")).first()
            if ps["e"] is not None:
                metrics += [("entropy_point_after", ps["e"]), ("conf_point_after", ps["c"])]
        if self.truth is not None and t_last is not None and t_last >= cfg.n_burn_in:
            metrics += self._evaluated(f_now, pts)
        if self.test is not None and t_last is not None and t_last // cfg.eval_every > (t_first - 1) // cfg.eval_every:
            # T4: test evaluation when this batch crosses a multiple of eval_every
            metrics += self._tested(f_now, pts)
        metrics.append(("iter_online_duration", seconds))
        self._metrics(batch_id, t_last or 0, metrics)
        self._write_version(batch_id, dict(n_labeled=c["l"], n_unlabeled=c["u"], phase=phase, hops=int(hops), seconds=seconds))
        self._forget(batch_id, prev)

    def _evaluated(self, f: DataFrame, pts: DataFrame) -> list[tuple[str, float]]:
        """The committed estimates of the stored unlabelled rows against the truth."""
        truth = self.truth.join(pts.where(~F.col("observed")).select("id"), "id", "left_semi")
        ev = M.evaluate(f, truth, len(self.cfg.classes)).first().asDict()
        return [(k, v) for k, v in ev.items() if k not in ("n",)]

    def _tested(self, f: DataFrame, pts: DataFrame) -> list[tuple[str, float]]:
        cfg = self.cfg
        y_l = S.one_hot(pts.where("observed"), "id", "label", cfg.classes)
        pair = predict(self.test.select("id", "x"), pts.select("id", "x", "observed"), f, y_l, cfg.classes, cfg.k_labeled, cfg.k_unlabeled, mode="pair")
        te = M.test_error(pair, self.test.select("id", "label")).first()
        return [("test_error_knn", te["error_knn"]), ("test_error_combined", te["error_combined"])]

    def finish(self) -> DataFrame:
        """T3 and T4 at the end of the stream, on the newest version: ``(metric, score)``, also kept as ``final``."""
        v = self.last_version()
        pts, f = self.points(v), None if v is None else self.estimates(v)
        rows: list[tuple[str, float]] = []
        if f is not None and self.truth is not None:
            rows += self._evaluated(f, pts)
        if f is not None and self.test is not None:
            rows += self._tested(f, pts)
        out = self.spark.createDataFrame([(m, None if x is None else float(x)) for m, x in rows], "metric string, score double")
        out.write.mode("overwrite").parquet(self._p("final"))
        return self.spark.read.parquet(self._p("final"))


def start_learner(stream: DataFrame, learner: StreamLearner, checkpoint_location: str, available_now: bool = True,
                  processing_time: str | None = None):
    """Run the learner on a streaming DataFrame with the stream schema (``seq, id, x, label, observed``)."""
    w = stream.writeStream.foreachBatch(learner.process).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def write_stream_files(points: DataFrame, folder: str, n_steps: int, files_per_step: int = 1) -> None:
    """Derive a replayable file stream from a table: ``n_steps`` steps in arrival (``seq``) order.

    The file source takes files by their time, so each step is a job of its own, of
    ``files_per_step`` tasks and files (read them with as many files per trigger).  The
    steps read a copy sorted by ``seq``, of which a step's filter leaves a few row groups.
    """
    spark = points.sparkSession
    ordered = scratch_dir(spark, "stream-order")
    points.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(ordered)
    rows = spark.read.parquet(ordered)
    size = max(1, -(-rows.count() // n_steps))
    for i in range(n_steps):
        part = rows.where((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size))
        part.repartition(files_per_step).write.mode("append").parquet(folder)
        time.sleep(0.01)
    remove_path(spark, ordered)


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
