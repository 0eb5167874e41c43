"""Nearest neighbours, URL lists, the pipeline and the registration."""

import datetime as dt

import numpy as np
import pytest

pytest.importorskip("seedspread.llm")

from pyspark.sql import functions as F  # noqa: E402

from seedspread.llm import neighbors, urlfilter  # noqa: E402

CHECK = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], float)
    for q, v in queries:
        d = np.sqrt(((data - np.array(v, float)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet(f"{CHECK}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    got = {}
    for r in neighbors.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = {i: np.array(v, float) for i, v in rows}
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(s == pytest.approx(np.linalg.norm(vectors[q] - vectors[i]), rel=1e-12) for i, s in found)


@pytest.mark.parametrize("block", [7, 8192])
def test_neighbours_cases(spark, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=4).tolist()) for k in range(60)]
    good += [(200 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(40)]  # one vector many times
    bad = [(300, None), (400, [0.0] * 4), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [float("inf"), 0.0, 0.0, 1.0]), (700, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(*r, "own") for r in [*good, *bad, (800, [1.0, 1.0])]], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbors.nearest(table, (F.col("vec_id") % 20 == 0), k=10, probes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    queries = [r for r in good if r[0] % 20 == 0]
    want = brute(good, queries, 10)
    assert set(got) == {q for q, _ in queries}
    assert got[200] == want[200] == [(201 + k, 0.0) for k in range(10)]
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    few = neighbors.nearest(table.where("vec_id < 5 or vec_id > 290"), F.col("vec_id") == 0, probes=1).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]  # fewer than k: all candidates
    assert neighbors.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    same = [(1, [1.0, 2.0, 3.0])] * 11 + [(k, [1.0, 2.0, 3.0]) for k in range(2, 51)]  # one id many times beside others with its vector
    far = [(100 + k, (rng.normal(size=3) + 50).tolist()) for k in range(30)]
    for rows in (same + far, 2 * (same[10:] + far)):  # and each row there twice
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in neighbors.nearest(table, F.col("vec_id").isin(1, 7, 50), k=10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {q: [(k, 0.0) for k in range(1, 51) if k != q][:10] for q in (1, 7, 50)}


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


ENTRIES = [
    ("spam", "Bad.Example.org", "add", at(2)),
    ("spam", "bad.example.org", "remove", at(5)),
    ("spam", "bad.example.org", "add", at(8)),
    ("paths", "ok.example.net/a", "add", at(1)),
    ("paths", "ok.example.net/a", "add", at(3)),
    ("both", "x.example.org", "add", at(1)),
    ("both", "x.example.org", "remove", at(1)),
    ("trusted", "good.bad.example.org", "add", at(1)),
    (None, "example.net", "add", at(1)),
    ("spam", None, "add", at(1)),
    ("spam", "example.net", "add", None),
    ("spam", "10.0.0.1", "add", at(1)),
]


def test_url_lists_as_of(spark):
    spells = urlfilter.intervals(spark.createDataFrame(ENTRIES, "list string, pattern string, action string, at timestamp"))
    cases = [
        ("http://bad.example.org/", at(1), [], False),
        ("http://bad.example.org/", at(2), ["spam"], True),
        ("https://WWW.bad.example.org:8080/q?x=1#f", at(4, 23), ["spam"], True),
        ("http://bad.example.org", at(5), [], False),
        ("http://user@bad.example.org/", at(9), ["spam"], True),
        ("http://notbad.example.org/", at(9), [], False),
        ("http://good.bad.example.org/", at(9), ["spam", "trusted"], False),
        ("http://ok.example.net/a/b/c", at(4), ["paths"], True),
        ("http://ok.example.net/ab", at(4), [], False),
        ("http://www.ok.example.net/a", at(4), [], False),
        ("http://x.example.org/", at(4), [], False),
        ("http://10.0.0.1/z", at(4), ["spam"], True),
        ("http://9.10.0.0.1/z", at(4), [], False),
        ("", at(4), [], False),
        (None, at(4), [], False),
        ("http://bad.example.org/", None, [], False),
        ("http://bad.example.org/", at(2), ["spam"], True),
        ("http://ok.example.net/" + "a/" * 5000, at(4), ["paths"], True),
        ("http://" + "w." * 100_000 + "bad.example.org/", at(4), ["spam"], True),
        ("http://" + "w." * 50_000 + "example.com/a", at(4), [], False),
    ]
    captures = spark.createDataFrame([(k, u, t, "own") for k, (u, t, *_) in enumerate(cases)], "page_id long, url string, fetched timestamp, blocked string")
    got = {r.page_id: r for r in urlfilter.verdicts(captures, spells, allow=["trusted"], keep=["page_id", "blocked"]).collect()}
    for k, (_, _, lists, blocked) in enumerate(cases):
        assert (got[k].lists, got[k].blocked) == (lists, blocked), cases[k]
        assert got[k].n_matches == len(lists)
    kept = urlfilter.passing(captures, spells, allow=["trusted"])
    assert kept.columns == captures.columns and {r.page_id for r in kept.collect()} == {k for k, c in enumerate(cases) if not c[3]}
    assert urlfilter.verdicts(captures.limit(0), spells).count() == 0
    assert urlfilter.verdicts(captures, spells.limit(0)).where("blocked or n_matches > 0").count() == 0
    # a host has no more keys than the longest pattern has labels
    long_host = spark.range(1).select(F.concat(F.repeat(F.lit("w."), 100_000), F.lit("example.org/a/b/c")).alias("url"))
    few = long_host.select(F.explode(urlfilter.keys(F.col("url"), 0, 4)).alias("key")).agg(F.count("*"), F.max(F.length("key"))).first()
    assert tuple(few) == (3, len("w.w.example.org"))


def test_native_operators_use_no_python(spark, capsys):
    import __spark_entry__ as entry

    for name in ("op3_line_dedup", "op5_url_filter", "op6_quality"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").explain()
        assert not [x for x in ("Python", "Pandas", "Arrow") if x in capsys.readouterr().out.replace("ArrowEval", "Arrow")]


def test_ten_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from seedspread.llm import bpe, mixing
    from seedspread.llm.common import written
    from test_llm_text import brute_components, brute_fingerprint

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)]
    model = corpus_pipeline.toxicity_model(spark, docs, sf_dir)
    clean = {r.doc_id for r in docs.collect() if model.score(r.text) < 0.7}
    assert {r.doc_id for r in want[0].collect()} == clean and want[0].columns == docs.columns
    lines = written(corpus_pipeline.STAGES[1][1](spark, want[0], sf_dir), "test-stage")
    assert lines.columns == docs.columns and lines.count() == len(clean)
    rows = sorted(lines.collect(), key=lambda r: r.doc_id)
    groups = brute_components([brute_fingerprint(r.text) for r in rows], 4)
    single = written(corpus_pipeline.STAGES[2][1](spark, lines, sf_dir), "test-stage")
    assert sorted(r.doc_id for r in single.collect()) == sorted({g: rows[g].doc_id for g in groups}.values())
    mixed = written(corpus_pipeline.STAGES[3][1](spark, single, sf_dir), "test-stage")
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {k: n for k, n in copies.items() if n}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = {r.doc_id: len(own.encode_ordinary(r.text)) for r in single.collect()}
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in final) == sorted((d, tokens[d]) for d, n in copies.items() for _ in range(n))
