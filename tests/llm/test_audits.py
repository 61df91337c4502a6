from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import divergence, filter_audit, nearest
from keelson.llm._shared import Scratch

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(q, x):
    out = 0.0
    for a, b in zip(q, x, strict=True):
        out += a * b
    return out


def nearest_by_force(rows, queries, k):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    every = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}
    out = []
    for q, v in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        near = sorted((-fold(v, x), i) for i, x in every if i != q and len(x) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def vectors(rng):
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(70)]  # copies: more than are kept of a class
    rows += [(2000 + i, [float(i % 6 == k) for k in range(6)]) for i in range(40)]  # ties of different vectors
    rows += [(3000 + i, [x * (1 + 1e-9 * i) for x in rows[5][1]]) for i in range(30)]  # nearer to each other than codes can tell
    rows += [(4000, None), (4001, []), (4002, [0.0] * 6), (4003, [1.0, None, 0, 0, 0, 0]), (4004, [math.nan] + [1.0] * 5), (4005, [math.inf] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(4020, [1.0, 2.0]), (4021, [2.0, 1.0]), (4040, [3.0] * 3), rows[0], rows[20], (40, [0.5] * 6), (41, [0.5] * 6), (41, [0.25] * 6)]
    rows += [(5000, [1e-310] * 6), (5020, [1e150, -1e150, 0, 0, 0, 1.0]), (-20, [-1.0] * 6)]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return rows


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "STRIP", 32)
    rows = vectors(np.random.default_rng(5))
    table = spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    for k in (1, 20):
        got = nearest.nearest(table, table.where("vec_id % 20 = 0"), k)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        # ids with two vectors have two lists: ranks repeat
        assert sorted(map(tuple, got.collect())) == nearest_by_force(rows, [(i, v) for i, v in rows if i is not None and i % 20 == 0], k)


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BYTES", 64 * 8 * 6)  # blocks of 64 rows
    rows = vectors(np.random.default_rng(6))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(table, table.where("vec_id % 20 = 0"), 7)
    assert sorted(map(tuple, got.collect())) == nearest_by_force(rows, [(i, v) for i, v in rows if i is not None and i % 20 == 0], 7)
    assert nearest.nearest(table.limit(0), table.limit(0)).isEmpty() and nearest.nearest(table, table.limit(0)).isEmpty()
    one = table.where("vec_id = 4040")
    assert nearest.nearest(one, one).isEmpty()


def test_products_of_codes_and_their_bounds():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(-127, 128, (20, 3000)).astype(np.int8) for _ in range(2))
    a[0] = b[0] = 127
    assert (nearest.int8_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    for size in (1e-3, 1.0, 1e5):
        q, x = rng.normal(size=(50, 33)) * size, rng.standard_cauchy(size=(60, 33))
        (qc, qs, _, qm, qe), (xc, xs, xn, _, xe) = nearest.quantised(q), nearest.quantised(x)
        assert (np.abs(q @ x.T - nearest.int8_products(qc, xc) * qs[:, None] * xs[None]) <= (qe[:, None] * xn[None] + qm[:, None] * xe[None]) * (1 + 1e-9)).all()


def prose(rng, n, words):
    return " ".join(words[int(i)] for i in np.minimum(rng.geometric(0.06, n) - 1, len(words) - 1))


def documents(seed=3):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "Élan", "école", "I'm", "a-b", "x9y", "straße", "日本語", "ZZ", *("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))]
    rows = []
    for i in range(260):
        lang, source = ("en", "de", None, "")[i % 4 if i % 3 else 0], ("s0", "s1", "s2", None, "")[int(rng.integers(0, 5))]
        rows.append((i, prose(rng, int(rng.integers(1, 160)), words), lang, source))
    rows += [(300, None, "en", "s9"), (301, "", "en", None), (302, " 12 ! ", "fr", "only"), (303, "alone", "it", "one"), (304, None, "it", "two"), (305, "Big " * 40_000, "de", "s1")]
    rows += [rows[0]] * 3 + [(1000 + i, rows[1][1], "en", "s0") for i in range(30)] + [(None, rows[1][1], "en", "s0"), (None, None, None, None)]
    rows += [(2000, "SHOUT ING ALL DAY #1", "en", "s1"), (7, rows[8][1], "de", "s1"), (-5, rows[9][1], "en", "s1")]
    return rows


def gap(p, q):
    return (p - q) ** 2 // (p + q)


def divergence_by_force(rows, min_docs, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    of = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UP))) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(c, s) for c, (_, x, s) in zip(of, rows, strict=True) if x == lang]
        docs, total, by = Counter(), Counter(), {}
        for c, s in own:
            docs.update(c.keys())
            total.update(c)
            by.setdefault(s, Counter()).update(c)
        kept = [t for t, n in docs.items() if n >= min_docs]
        v = len(kept)
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        p, q = {s: share(c) for s, c in by.items()}, share(total)
        for s in by:
            found = {"pair": [(-sum(gap(p[s][t], p[h][t]) for t in kept), h) for h in by if h != s], "term": [(-gap(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -x, n + 1) for n, (x, i) in enumerate(items) if part == "pair" or n < top]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top", [(10, 10), (2, 3)])
def test_divergence_equals_brute_force(spark, min_docs, top):
    rows = documents()
    table = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, term string, value int")
    got = divergence.source_divergence(table, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_force(rows, min_docs, top)
    assert divergence.source_divergence(table.limit(0)).isEmpty()


def test_radix_select_equals_sorting(spark):
    rng = np.random.default_rng(9)
    rows = {("a", "i" * 300 + w + x): int(v) for v, (w, x) in zip(rng.integers(0, 3, 900) * (1 << 19), ((f"{i:x}", "é" * (i % 3)) for i in range(900)), strict=True)}
    rows |= {("b", f"t{i}"): int(v) for i, v in enumerate(rng.integers(0, 1 << 30, 500))} | {("c", "x"): 5, ("c", ""): 5, ("d", "日本"): 0, ("d", "日"): 0, ("d", "z"): 0}
    table = spark.createDataFrame([(g, i, v) for (g, i), v in rows.items()], "g string, item string, value long")
    for k in (1, 2, 40):
        got = divergence.radix_top(table, ["g"], k, Scratch(spark))
        want = [(g, i, v) for x in "abcd" for g, i, v in sorted(((g, i, v) for (g, i), v in rows.items() if g == x), key=lambda r: (-r[2], r[1].encode()))[:k]]
        assert sorted(map(tuple, got.select("g", "item", "value").collect())) == sorted(want)


def test_shares_are_exact_beyond_longs(spark):
    big = 9_000_000_000_000_000
    rows = [(0, 10), (3, 7), (8_999_999_999, 9_000_000_001), (9_000_000_000, 9_000_000_007), (big, big + 12_345_678), (0, 0)]
    got = spark.createDataFrame(rows, "c long, n long").select("c", "n", divergence.share("c", "n").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // max(r["n"], 1) for r in got)


def audit_by_force(rows, labels):
    rows = [(i, t or "", lang or "") for i, t, lang, _ in rows]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    marked = {}
    for i, t, lang in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            k for k, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if bad
        )
        marked.setdefault(lang, []).append((fails, i in good, i in toxic))
    out = []
    for part, own in marked.items():
        lines, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = [bool(set(x) & set(order[: step - 1])) for x, _, _ in own]
                hit = [f in x and not g for (x, _, _), g in zip(own, gone, strict=True)]
                pick = lambda mask: sum(mask)
                shapley[f] += pick(hit)
                kept = sum(not g and f not in x for (x, _, _), g in zip(own, gone, strict=True))
                lines.append((f, (part, order, step, kept, pick(hit), sum(g and f in x for (x, _, _), g in zip(own, gone, strict=True)), sum(x == f for x, _, _ in own), sum(h and y for h, (_, y, _) in zip(hit, own, strict=True)), sum(h and y for h, (_, _, y) in zip(hit, own, strict=True)))))
        out += [(*line, shapley[f]) for f, line in lines]
    return sorted(out)


@pytest.mark.parametrize("block", [8_192, 7])
def test_filter_audit_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 20)  # so that copies are a hot key and others aren't
    rows = documents()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 3)] + [(0, 0, 1), (0, 1, 0), (3, None, None), (None, 1, 1), (99_999, 1, 1)]
    table = spark.createDataFrame([(i, t, lang, s, "p", True) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, part string, E boolean")
    marks = spark.createDataFrame([(i, q, None if x is None else int(x), "p") for i, q, x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(table, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit_by_force(rows, labels)
    assert filter_audit.filter_audit(table.limit(0), marks).isEmpty()
    assert filter_audit.filter_audit(table, marks.limit(0)).where("good_lost + toxic_lost > 0").isEmpty()


def test_bitmaps_of_many_parts(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("part"), (F.col("id") % 2 == 0).alias("x"), (F.col("id") % 3 == 0).alias("y"), F.lit(True).alias("l"))
    got = filter_audit.survivors(filter_audit.bitmap_index(rows, "part", ["x", "y"], ["l"]), ["x", "y"], ["l"])
    total = {r["gone"]: (r["n"], r["l"]) for r in got.groupBy("gone").agg(F.sum("left_all").alias("n"), F.sum("left_l").alias("l")).collect()}
    assert total == {g: (n, n) for g in range(4) for n in [sum(not (g & 1 and i % 2 == 0) and not (g & 2 and i % 3 == 0) for i in range(20_000))]}
    assert got.count() == 80_000
