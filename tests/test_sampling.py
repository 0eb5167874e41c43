"""Sampling counts (FIXTURES.md §2) and the exact bucketed rank under skew."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_CHECK
from seedspread.functions.hashing import hash_bucket, order_key
from seedspread.operators import sampling as S
from seedspread.operators.ranking import bucketed_rank, drawn
from seedspread.plans.fixtures import embeddings_points
from seedspread.sources.datasets import load_points


def test_standard_mask_counts(spark):
    pts = embeddings_points(spark, SF_CHECK)
    c = pts.groupBy("observed").count().collect()
    assert {r["observed"]: r["count"] for r in c} == {True: 95, False: 405}


def test_burn_in_and_rest_counts(spark):
    pts = load_points(spark, SF_CHECK, "embeddings")
    b = S.burn_in_split(pts, "id", "label", 2, 0.5, 42)
    per = {r["label"]: (r["n"], r["o"]) for r in b.where("burn_in").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("observed").alias("o")).collect()}
    assert all(v == (4, 2) for v in per.values()) and len(per) == 10
    rest = S.mask_labels(b.where(~F.col("burn_in")).drop("observed"), "id", "label", 0.1, 42)
    obs = {r["label"]: r["o"] for r in rest.groupBy("label").agg(F.count_if("observed").alias("o")).collect()}
    assert [obs[c] for c in range(10)] == [4, 4, 4, 5, 4, 4, 4, 4, 4, 5]


def test_bucketed_rank_equals_window_under_skew(spark):
    # one class holds a third of all rows
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7 + 1).alias("label"))
    df = df.withColumn("k", order_key("id", 5))
    a = bucketed_rank(df, ["label"], [F.col("k"), F.col("id")], hash_bucket("k", 8), "r", size_col="n")
    w = Window.partitionBy("label").orderBy("k", "id")
    b = df.withColumn("r2", F.row_number().over(w)).withColumn("n2", F.count(F.lit(1)).over(Window.partitionBy("label")))
    j = a.join(b.select("id", "r2", "n2"), "id")
    assert j.where((F.col("r") != F.col("r2")) | (F.col("n") != F.col("n2"))).count() == 0
    assert j.count() == 3000


def test_drawn_equals_rank_and_sorts_one_bucket(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 7 + 1).cast("int").alias("label"))
    df = df.withColumn("k", F.when(F.col("id") % 13 != 0, order_key("id", 5)))  # some rows have no key
    order = [F.col("k"), F.col("id")]
    w = Window.partitionBy("label")
    for bits in (4, 16):
        for quota in (lambda n: F.floor(n * 0.37), lambda n: F.lit(0), lambda n: n, lambda n: n + 5, lambda n: F.lit(1), lambda n: n - 300):
            got = drawn(df, ["label"], ["k", "id"], hash_bucket("k", bits), quota, "in")
            want = df.select("id", (F.row_number().over(w.orderBy(*order)) <= quota(F.count(F.lit(1)).over(w))).alias("w"))
            j = got.join(want, "id")
            assert got.columns == [*df.columns, "in"] and j.count() == 4000 and j.where(F.col("in") != F.col("w")).count() == 0
    everything = drawn(df, [], ["k", "id"], hash_bucket("k", 8), lambda n: F.floor(n * 0.5), "in")
    want = {r.id for r in df.orderBy(*order).limit(2000).collect()}
    assert {r.id for r in everything.where("`in`").collect()} == want
    assert drawn(df.limit(0), [], ["k", "id"], hash_bucket("k", 8), lambda n: n, "in").count() == 0
    # sorted are the count table and the rows of the bucket in which a quota ends, nothing else
    plan = drawn(df, ["label"], ["k", "id"], hash_bucket("k"), lambda n: F.floor(n * 0.37), "in")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    ranked = [i for i, line in enumerate(plan) if "row_number()" in line and "Window" in line]
    assert len(ranked) == 1 and any("_dr_bucket" in line and "= _dr_cut" in line.replace("_dr_cut#", "_dr_cut ") for line in plan[ranked[0] + 1 : ranked[0] + 6])


def test_uniform_mask_and_tail_split(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    m = S.uniform_mask(df, "k", 0.29, 1)
    assert m.where("observed").count() == int(1000 * 0.29)
    t = S.tail_split(df, "k", "k", 100)
    assert sorted(r["k"] for r in t.where("is_test").collect()) == list(range(900, 1000))


def test_ingest_is_idempotent(spark):
    a = spark.createDataFrame([(1, True), (2, False)], "id long, observed boolean")
    b = spark.createDataFrame([(2, False), (3, True)], "id long, observed boolean")
    once = S.ingest(a, b)
    twice = S.ingest(once, b)
    assert sorted(r["id"] for r in twice.collect()) == [1, 2, 3]
    counts = S.store_counts(twice).first()
    assert (counts["n_nodes"], counts["n_labeled"], counts["n_unlabeled"]) == (3, 2, 1)


def test_one_hot_and_decode(spark):
    df = spark.createDataFrame([(1, 2), (2, 9)], "id long, label int")
    oh = S.one_hot(df, "id", "label", [0, 1, 2])
    rows = {(r["id"], r["class"]): r["p"] for r in oh.collect()}
    assert rows[(1, 2)] == 1.0 and rows[(2, 0)] == 0.0 and sum(v for (i, _), v in rows.items() if i == 2) == 0.0
    f = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.4), (1, 2, 0.2)], "id long, class int, p double")
    assert S.decode(f).first()["pred"] == 0


def test_rows_without_class_or_key_are_kept_and_never_drawn(spark):
    rows = [(i, None if i % 4 == 0 else i % 3, None if i % 5 == 0 else float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, seq double")
    for out, flag in (
        (S.mask_labels(df, "id", "label", 0.5, 1), "observed"),
        (S.stratified_split(df, "id", "label", 0.5, 1), "is_test"),
        (S.burn_in_split(df, "id", "label", 3, 0.5, 1), "burn_in"),
        (S.burn_in_split(df, "id", "label", 3, 0.5, 1, shuffle=False, seq_col="seq"), "observed"),
    ):
        got = out.collect()
        assert len(got) == 100 and any(r[flag] for r in got) and not any(r[flag] for r in got if r["label"] is None)
    pos = {r["id"]: r["pos"] for r in S.replay(df, "id", seq_col="seq").collect()}
    want = sorted(range(100), key=lambda i: (rows[i][2] is not None, rows[i][2] or 0.0, i))
    assert [pos[i] for i in want] == list(range(100))
    last = sorted(range(100), key=lambda i: (rows[i][2] is not None, rows[i][2] or 0.0, i))[-90:]
    assert {r["id"] for r in S.tail_split(df, "id", "seq", 90).where("is_test").collect()} == set(last)
