"""Recompression, vector codes and the filter audit against brute force, with the odd inputs of each."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("seedspread.llm")

from pyspark.sql import functions as F  # noqa: E402

from seedspread.llm import filteraudit, recompression, vectorcodes  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# recompression -----------------------------------------------------------------


def passages_left(rows, window):
    """``(id, words, removed, kept)`` of each row by looking at every window."""
    order = lambda i: (1, 0) if i is None else (0, i)
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def cut_rows(spark, rows, window, rounds=recompression.ROUNDS):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, name string").repartition(5)
    got = recompression.without_repeats(docs, window, rounds).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got), key=str)


def test_recompression_cases(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    run, beat = "la " * 4000, "tick tock " * 3000
    longest = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
    rows = [
        (1, f"start {passage} end"), (2, None), (3, ""), (None, " \t\n "), (4, f"other {passage}\tstop here"), (4, f"same id {passage}"),
        (5, f"x {passage}"), (5, f"x {passage}"), (None, f"{passage} null"), (None, f"{passage} null too"), (6, passage.rsplit(" ", 2)[0]), (7, passage.rsplit(" ", 1)[0]),
        (8, run), (9, run + "end"), (10, "so " + run[:300]), (11, beat), (12, "tock " + beat), (13, longest), (14, "é " + longest[5000:60_000] + " ü"), (15, longest),
    ]
    assert cut_rows(spark, rows, 13) == sorted(passages_left(rows, 13), key=str)
    assert recompression.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed,vocabulary,window", [(1, 3, 13), (2, 40, 13), (3, 2, 4), (4, 8, 7)])
def test_recompression_of_random_texts(spark, seed, vocabulary, window):
    draw = random.Random(seed)
    stock = [" ".join(f"v{draw.randrange(vocabulary)}" for _ in range(draw.randrange(1, 60))) for _ in range(12)]
    rows = [(draw.randrange(40), " ".join(draw.choice(stock) if draw.random() < 0.7 else f"u{draw.randrange(999)}" for _ in range(draw.randrange(0, 9)))) for _ in range(60)]
    assert cut_rows(spark, rows, window, rounds=4) == sorted(passages_left(rows, window), key=str)


def test_equal_windows_choose_alike():
    draw = np.random.default_rng(7)
    names = recompression.mixed(draw.integers(0, 5, 3000))
    text = np.repeat(np.arange(30), 100)
    name, first, n = recompression.chosen(names, text)
    of = {}
    covered = 0
    for x, a, m in zip(name.tolist(), first.tolist(), n.tolist(), strict=True):
        for p in range(a, a + m):
            covered += 1
            assert of.setdefault(tuple(names[p : p + 13].tolist()), x) == x
    assert covered == 30 * 88


def test_equal_substrings_share_interior_symbols():
    draw = np.random.default_rng(8)
    core = draw.integers(0, 1 << 60, 400)
    a, b = (recompression.mixed(np.concatenate([draw.integers(0, 9, k), core, draw.integers(0, 9, k)])) for k in (37, 90))
    inside = []
    for seq, k in ((a, 37), (b, 90)):
        sym, at = recompression.compressed(seq, np.zeros(len(seq), np.int64), 6)
        inside.append({(s, p - k) for s, p in zip(sym.tolist(), at.tolist(), strict=True) if k + 60 <= p < k + 340})
    assert inside[0] == inside[1] and len(inside[0]) < 280 / 3


# vector codes ------------------------------------------------------------------


def coded(rows, parts, entries, rounds, scale=256):
    """Codes, errors and codebooks by comparing every part with every entry."""
    kept = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept], object).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d2 = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = np.array([[min(range(d2.shape[2]), key=lambda e: (d2[r, p, e], e)) for p in range(parts)] for r in range(len(kept))])
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    error = [int(sum(d2[r, p, code[r, p]] for p in range(parts))) for r in range(len(kept))]
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[1]] = total.get(r[1], 0) + e
    return sorted(((r[0], r[1], bytes(c.tolist()), e, total[r[1]]) for r, c, e in zip(kept, code, error, strict=True)), key=str), ",".join(str(v) for v in books.ravel())


@pytest.mark.parametrize("seed,entries,rounds,spread", [(1, 64, 2, 40), (2, 20, 6, 3), (3, 64, 3, 1)])
def test_codes_equal_brute_force(spark, seed, entries, rounds, spread):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(400, 8)) / spread + draw.integers(0, 4, (400, 1)) / 8
    vectors[:60] = np.round(vectors[:60] * 8) / 8  # ties
    rows = [(k // 2 if k < 20 else k, None if k % 5 == 0 else k % 3, v) for k, v in enumerate(vectors.tolist())]
    rows += [rows[7], rows[7], (None, 1, [0.0] * 8), (900, 2, None), (901, 2, [1.0, None] * 4), (902, 2, [float("nan")] * 8), (903, 2, [float("inf")] * 8), (904, 2, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(4)
    got, books = vectorcodes.compressed(table, parts=4, entries=entries, rounds=rounds)
    want, digits = coded(rows, 4, entries, rounds)
    assert sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in got.collect()), key=str) == want
    assert vectorcodes.digest(books) == hashlib.sha256(digits.encode()).hexdigest()


def test_code_cases(spark):
    few = spark.createDataFrame([(1, None, [0.5] * 16), (2, None, [0.25] * 16)], "vec_id long, label int, embedding array<float>")
    got, books = vectorcodes.compressed(few)
    assert books.shape == (16, 2, 1) and {r.vec_id: (bytes(r.code), r.error) for r in got.collect()} == {1: (b"\0" * 16, 0), 2: (b"\1" * 16, 0)}
    got, _ = vectorcodes.compressed(few.where("vec_id > 9"))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError):
        vectorcodes.compressed(few.withColumn("embedding", F.slice("embedding", 1, 7)))


def test_bounds_spare_distances():
    draw = np.random.default_rng(5)
    book = draw.integers(-400, 400, (64, 4))
    x = book[draw.integers(0, 64, 3000)] + draw.integers(-9, 9, (3000, 4))
    state = vectorcodes.PartState.full(x, book, 8)
    new = book + draw.integers(-2, 3, book.shape)
    state.move(np.sqrt(((new - book) ** 2).sum(axis=1)))
    depth = state.decide(x, new)
    assert (state.code == vectorcodes._distances(x, new).argmin(axis=1)).all()
    assert (depth == 0).mean() > 0.5 and (depth == 9).mean() < 0.1


# filter audit ------------------------------------------------------------------


def audited(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    place = lambda i: (i is None, i or 0)
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", place(i)), place(i))
    rows = []
    for i, text, part in docs:
        w, t = WORD.findall(text or ""), text or ""
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] < place(i)}
        rows.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removals, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in own if f in r[1] and not r[1] & before]
                removals[f] += len(here)
                lines.append([part, "".join(order), k + 1, sum(not r[1] & (before | {f}) for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f])
        out += [tuple([*x[:-1], removals[x[-1]]]) for x in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["word", f"w{draw.randrange(400)}", "LOUD", "a#b"][: draw.randrange(1, 5)]) for _ in range(draw.randrange(0, 420))) for _ in range(40)] + [None, "", "#"]
    docs = [(draw.choice([None, *range(70)]), draw.choice(texts), draw.choice(["s", "t", None, ""])) for _ in range(150)]
    docs += [docs[3], docs[3]]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, source string, kept string, prefix string").repartition(3)
    got = filteraudit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_nothing_and_of_clean_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(empty, labels).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300)), "s")], "doc_id long, text string, source string")
    rows = filteraudit.audit(clean, labels).collect()
    assert len(rows) == 600 and {(r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {(1, 0, 0, 0)}
