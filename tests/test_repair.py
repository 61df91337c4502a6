from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import text as tx
from keelson.operators import repair

POOL = "q long, i long, t long, coarse boolean, score double, target long, selected boolean, protected boolean, v double"


def pools(rng):
    rows = []
    for q in range(60):
        n = int(rng.integers(3, 25))
        times = sorted(map(int, rng.choice(200, n, replace=False)))
        ids = list(map(int, rng.permutation(n)))
        for k, (i, t) in enumerate(zip(ids, times, strict=True)):
            selected = bool(rng.random() < 0.35)
            target = None if rng.random() < 0.1 else k + int(rng.random() < 0.15)
            rows.append((q, i, t, bool(rng.random() < 0.85), round(float(rng.random()), 1), target, selected, selected and bool(rng.random() < 0.25), round(float(rng.random()), 1)))
    return rows


def by_force(rows):
    """Decisions by question and slot, and final selections."""
    decisions, final = {}, {}
    like = lambda a, b: min(max(1 - abs(a[8] - b[8]), 0), 1)
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1]))
        taken = [k for k, r in enumerate(own) if r[6]]
        best = []
        for slot, k in enumerate(taken):
            a, after = own[k], own[k + 1] if k + 1 < len(own) else None
            b = own[taken[slot + 1]] if slot + 1 < len(taken) else None
            gain = None
            if not a[3]:
                why = "no_score"
            elif b is None:
                why = "no_next_slot"
            elif (k and own[k - 1][6]) or after[6]:
                why = "neighbour_selected"
            elif b[7]:
                why = "next_protected"
            elif a[5] is None or after[5] is None:
                why = "no_target"
            elif after[5] - a[5] != 1:
                why = "not_next_target"
            else:
                gain = like(a, after) - like(a, b)
                why = "eligible" if gain > repair.TOLERANCE else "no_gain"
            decisions[q, slot] = (a[1], why)
            if why == "eligible":
                best.append((-a[4], -gain, a[2], after[2], a[1], after[1], b[1]))
        final[q] = {r[1] for r in own if r[6]}
        if best:
            win = min(best)
            final[q] = final[q] - {win[6]} | {win[5]}
    return decisions, final


def test_repairs_equal_brute_force(spark):
    rows = pools(np.random.default_rng(12))
    pool = spark.createDataFrame(rows, POOL)
    d = repair.repair_decisions(pool, ["q"], "i", "t", lambda a, b: 1 - F.abs(a["v"] - b["v"]), 1)
    decisions, final = by_force(rows)
    assert {(r["q"], r["slot"]): (r["i"], r["reason"]) for r in d.collect()} == decisions
    assert set(Counter(w for _, w in decisions.values())) == {"no_score", "no_next_slot", "neighbour_selected", "next_protected", "no_target", "not_next_target", "no_gain", "eligible"}
    got: dict = {}
    for r in repair.repaired(pool, ["q"], "i", "t", d).collect():
        got.setdefault(r["q"], set()).add(r["i"])
    assert got == {q: s for q, s in final.items() if s}
    assert repair.repair_decisions(pool.limit(0), ["q"], "i", "t", lambda a, b: F.lit(0.0), 1).isEmpty()


def test_fields_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    frames, fields = [], []
    for q in range(8):
        t = 0
        for i in range(30):
            t += int(rng.integers(1, 9))
            frames.append((q, i, t, round(float(rng.random()), 1)))
            fields += [(q, i, f, round(float(rng.random()), 1)) for f in "xyz" for _ in range(int(rng.integers(0, 3) if rng.random() < 0.6 else 0))]
    bounds = {q: (min(t for k, _, t, _ in frames if k == q), max(t for k, _, t, _ in frames if k == q)) for q in range(8)}
    df = spark.createDataFrame([(*r, *bounds[r[0]]) for r in frames], "q long, i long, t long, s double, low long, high long")
    got = repair.field_regions(spark.createDataFrame(fields, "q long, i long, field string, confidence double"), df, ["q"], "i", "t", "s", 4, "low", "high")
    at = {(q, i): (t, s) for q, i, t, s in frames}
    want, proposals = [], {}
    for q in range(8):
        for f in "xyz":
            sure: dict = {}
            for k, i, g, c in fields:
                if k == q and g == f:
                    sure[i] = max(c, sure.get(i, 0))
            runs: list = []
            for i in sorted(sure):
                runs[-1].append(i) if runs and runs[-1][-1] == i - 1 else runs.append([i])
            for run in runs:
                left, right = max(at[q, run[0]][0] - 4, bounds[q][0]), min(at[q, run[-1]][0] + 4, bounds[q][1])
                around = [i for k, i, t, _ in frames if k == q and left <= t <= right]
                rep = min(run, key=lambda i: (-sure[i], at[q, i][0]))
                anchor = min(around, key=lambda i: (-at[q, i][1], at[q, i][0]))
                want.append((q, f, run[0], run[-1], rep, sure[rep], left, right, len(around), anchor, at[q, anchor][1]))
                p = proposals.setdefault((q, rep), [[], 0.0, 0.0])
                p[0].append(f)
                p[1], p[2] = max(p[1], at[q, anchor][1]), max(p[2], sure[rep])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    ranked = {(r["q"], r["i"]): (r["fields"], r["rank"]) for r in repair.field_proposals(got, df, ["q"], "i", "t").collect()}
    for q in range(8):
        order = sorted((k for k in proposals if k[0] == q), key=lambda k: (-proposals[k][1], -proposals[k][2], at[k][0], k[1]))
        for n, k in enumerate(order, 1):
            assert ranked[k] == (sorted(proposals[k][0]), n)


def test_divergences(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    arr = lambda *v: F.array(*map(F.lit, v))
    p, q = (0.4, 0.3, 0.1, 0.0, 0.2), (0.1, 0.1, 0.1, 0.1, 0.6)
    mid = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    js = sum(0.5 * a * math.log(a / m) for x in (p, q) for a, m in zip(x, mid, strict=True) if a > 0) / math.log(2)
    r = get(tx.evidence_support(arr(*p), arr(*q)))
    assert (r["js"], r["mass"], r["value"]) == (pytest.approx(js), pytest.approx(0.8), pytest.approx(0.8 * js))
    assert get(tx.evidence_support(arr(*p), arr(*p)))["value"] == 0
    for bad in ((0.4, 0.3, 0.1, 0.1, 0.2), (1.1, -0.1, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (math.nan, 0.5, 0.5, 0.0, 0.0)):
        with pytest.raises(Exception, match="not two distributions"):
            get(tx.evidence_support(arr(*bad), arr(*q)))
    a, b = (1000.0, 1001.0, 999.5, 998.0), (0.0, 0.5, 0.25, -1.0)
    sa, sb = (np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum() for x in (a, b))
    assert get(tx.logit_divergence(arr(*a), arr(*b))) == pytest.approx(float((sa * np.log(sa / sb)).sum())) and get(tx.logit_divergence(arr(*a), arr(*a))) == pytest.approx(0)
    assert get(tx.softmax(arr(*a))) == pytest.approx(sa.tolist())
