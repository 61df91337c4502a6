from __future__ import annotations

import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import boxes, matching, temporal
from keelson.plans.geometry import similar_by
from keelson.sources.shared import saved


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(rng, n):
    base = [int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)] + [0, (1 << 64) - 1, 1 << 63]
    near = []
    for _ in range(4 * n):
        x = base[int(rng.integers(0, len(base)))]
        for b in rng.choice(64, int(rng.integers(0, 10)), replace=False):
            x ^= 1 << int(b)
        near.append(x)
    return base + near


@pytest.mark.parametrize("most,bands", [(6, None), (6, 4), (6, 3), (0, None), (9, 5)])
def test_hashes_within_bits_equal_brute_force(spark, most, bands):
    rng = np.random.default_rng(most)
    a, b = hashes(rng, 25), hashes(rng, 25)[:40]
    b += a[:60]
    df = lambda xs, c: spark.createDataFrame([(i % 2, signed(x)) for i, x in enumerate(xs)], f"k int, {c} long")
    got = [tuple(r) for r in matching.within_bits(df(a, "a"), df(b, "b"), ["k"], most, bands).collect()]
    want = {(i % 2, signed(x), signed(y), (x ^ y).bit_count()) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and (x ^ y).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_pairs_of_hashes_meet_only_in_a_common_band(spark):
    rng = np.random.default_rng(1)
    rows = [(i, signed(int(x))) for i, x in enumerate(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))]
    df = spark.createDataFrame(rows, "i long, h long")
    assert matching.hamming_pairs(df, [], "i", "h", 3).count() == 0
    copies = spark.createDataFrame([(i, signed(int(i % 3 == 0) << 63)) for i in range(30)], "i long, h long")
    assert matching.hamming_pairs(copies, [], "i", "h", 0).count() == 45 + 190 and matching.hamming_pairs(copies, [], "i", "h", 22).count() == 30 * 29 // 2


def lcs(a, b, most):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = max(d[i, j + 1], d[i + 1, j], d[i, j] + ((x ^ y).bit_count() <= most))
    return int(d[-1, -1])


def test_clips_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    frames = hashes(rng, 12)
    clips = {c: [frames[int(i)] for i in rng.integers(0, len(frames), 8)] for c in range(25)}
    for c in range(25, 45):  # shifted, reversed, or with some frames replaced
        old = clips[c - 25]
        clips[c] = [old[1:] + old[:1], old[::-1], [x ^ 5 for x in old], [*old[:5], *clips[(c + 3) % 25][5:]]][c % 4]
    clips[50], clips[51] = [], clips[0][:5]
    df = spark.createDataFrame([(c, [signed(x) for x in h]) for c, h in clips.items()], "clip long, h array<long>")
    got = sorted(map(tuple, matching.clip_matches(df.where("clip < 30"), df, "clip", "h").collect()))
    want = []
    for q in range(30):
        for m, h in clips.items():
            seen = sum(any((x ^ y).bit_count() <= 6 for y in h) for x in clips.get(q, []))
            if m != q and seen >= 6 and (n := lcs(clips[q], h, 6)) >= 6:
                want.append((q, m, n))
    assert got == sorted(want) and len(want) > 10


def regions(*rows):
    """frame, region, text, box, with a score of 0.9 and a picture of 1 x 1."""
    return [(f, r, t, 0.9, [[b[0], b[3]], [b[0], b[1]], [b[2], b[1]], [b[2], b[3]]], 1.0, 1.0) for f, r, t, b in rows]


SCHEMA = "frame long, region long, text string, score double, polygon array<array<double>>, width double, height double"
HALF, SHIFTED = (0.0, 0.0, 0.5, 0.5), (0.25, 0.0, 0.75, 0.5)


@pytest.mark.parametrize(
    "left,right,change",
    [
        ([], [("7", HALF)], 0), ([("7", HALF)], [("20", (0.6, 0.6, 1.0, 1.0))], 0), ([("5:59", HALF)], [("6:00", HALF)], 0.75), ([("7:30", HALF)], [("4:30", HALF)], 0.25),
        ([("10:00", HALF)], [("10:00", HALF)], 0), ([("7", HALF)], [("0", SHIFTED)], 1 / 3), ([("a", HALF)], [("b", (0.5, 0.0, 1.0, 0.5))], 0),
        ([("alpha", HALF), ("beta", SHIFTED)], [("beta", SHIFTED), ("alpha", HALF)], 0), ([("alpha", HALF), ("beta", SHIFTED)], [("alpha", HALF), ("betx", SHIFTED)], 0.25), ([("alpha", HALF), ("beta", HALF)], [("other", HALF)], 0),
    ],
)
def test_layout_change_of_the_fixtures(spark, left, right, change):
    rows = regions(*[(f, i, t, b) for f, side in ((1, left), (2, right)) for i, (t, b) in enumerate(side)])
    placed = boxes.boxes(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2)], "left long, right long")
    assert {(r["left"], r["right"]): r["change"] for r in boxes.layout_changes(pairs, placed).collect()} == {(1, 2): pytest.approx(change), (2, 1): pytest.approx(change)}


def test_boxes_of_read_regions(spark):
    square = [[10.0, 10.0], [60.0, 10.0], [60.0, 60.0], [10.0, 60.0]]
    rows = [(1, 0, "  STATE  A ", 0.9, square, 100.0, 100.0), (1, 1, "noise", 0.49, square, 100.0, 100.0), (2, 0, "It’s\tSTRASSE Straße", 0.5, square, 200.0, 200.0), (2, 1, " ", 1.0, square, 100.0, 100.0), (2, 2, None, 1.0, square, 100.0, 100.0), (3, 0, "éÉ", 0.7, square, 100.0, 100.0)]
    got = {(r["frame"], r["region"]): (r["text"], [round(r[c], 9) for c in boxes.SIDES]) for r in boxes.boxes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): ("state a", [0.1, 0.1, 0.6, 0.6]), (2, 0): ("it's strasse strasse", [0.05, 0.05, 0.3, 0.3]), (3, 0): (unicodedata.normalize("NFC", "éé"), [0.1, 0.1, 0.6, 0.6])}
    bad = [(1.1, square), (math.nan, square), (0.9, square[:3]), (0.9, [[10.0, 10.0], [160.0, 10.0], [60.0, 60.0], [10.0, 60.0]]), (0.9, [[10.0, 10.0]] * 4), (0.9, [[math.nan, 10.0], *square[1:]])]
    for score, polygon in bad:
        with pytest.raises(Exception, match="in frame 7"):
            boxes.boxes(spark.createDataFrame([(7, 0, "x", score, polygon, 100.0, 100.0)], SCHEMA)).collect()


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
    return row[-1] / max(1, len(a), len(b))


def change(a, b):
    best = 0.0
    m = [[iou(x, y) for _, y in b] for _, x in a]
    for i, (t, _) in enumerate(a):
        for j, (u, _) in enumerate(b):
            column = [row[j] for row in m]
            if m[i][j] > 0 and m[i].count(max(m[i])) == 1 and m[i][j] == max(m[i]) and column.count(max(column)) == 1 and m[i][j] == max(column):
                best = max(best, m[i][j] * edits(t, u))
    return best


@pytest.mark.parametrize("grid", [1, 8])
def test_layouts_and_prefixes_equal_brute_force(spark, grid):
    rng = np.random.default_rng(grid)
    frames = {}
    for f in range(24):
        out = []
        for _ in range(int(rng.integers(0, 7))):
            x, y = rng.integers(0, 12, 2) / 16
            out.append(("".join(rng.choice(list("ab1"), int(rng.integers(1, 5)))), (x, y, x + int(rng.integers(1, 5)) / 16, y + int(rng.integers(1, 5)) / 16)))
        frames[f] = out
    frames[0] = [("edge", (0.0, 0.0, 1.0, 1.0))]
    placed = boxes.boxes(spark.createDataFrame(regions(*[(f, i, t, tuple(map(float, b))) for f, o in frames.items() for i, (t, b) in enumerate(o)]), SCHEMA))
    pairs = spark.createDataFrame([(a, b) for a in frames for b in frames], "left long, right long")
    got = {(r["left"], r["right"]): r["change"] for r in boxes.layout_changes(pairs, placed, grid).collect()}
    assert got == {(a, b): pytest.approx(change(frames[a], frames[b]), abs=1e-12) for a in frames for b in frames}

    x = rng.normal(size=(24, 4)) + 0.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.clip(x @ x.T, 0, 1)
    support = rng.integers(0, 5, 24) / 4
    items = [(i // 8, i, (i * 5) % 8, float(support[i]), i % 8 == 3) for i in range(24)]
    similar = spark.createDataFrame([(i, j, float(cos[i, j])) for i in range(24) for j in range(24)], "left long, right long, c double")
    out = boxes.spatial_prefix(spark.createDataFrame(items, "region long, item long, time long, support double, anchor boolean"), lambda p: p.join(similar, ["left", "right"]), placed, lambda df, n: saved(df, "step"), 5, grid)
    want = []
    for r in range(3):
        own = [i for i in items if i[0] == r]
        chosen = [next(i[1] for i in own if i[4])]
        while len(chosen) < 5:
            near = {i[1]: max(cos[i[1], c] * (1 - change(frames[i[1]], frames[c])) for c in chosen) for i in own}
            chosen.append(min((i for i in own if i[1] not in chosen), key=lambda i: (-i[3] * math.sqrt(1 - near[i[1]]), i[2], i[1]))[1])
        want += [(r, c, n) for n, c in enumerate(chosen)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_nearest_of_disjoint_intervals_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(k, int(t), i) for k in range(4) for i, t in enumerate(rng.integers(0, 100, 60))]
    spans = []
    for k in range(3):
        edges = sorted(map(int, rng.choice(100, 2 * k * 4, replace=False)))
        spans += [(k, n, a, b) for n, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True))]
    got = temporal.nearest_interval(spark.createDataFrame(points, "k int, t long, i int"), spark.createDataFrame(spans, "k int, s int, left long, right long"), ["k"], "t", ["i"], "s")
    want = []
    for k, t, i in points:
        if own := [(max(a - t, 0, t - b), a, s) for kk, s, a, b in spans if kk == k]:
            d, _, s = min(own)
            want.append((k, i, s, d))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_side_of_a_layout_join_is_broadcast(spark):
    """Boxes are small in files and many by cell: a broadcast would take them all through the driver."""
    one = spark.range(2).selectExpr("id AS frame", "id AS region", "'a' AS text", "0.1D AS x1", "0.1D AS y1", "0.9D AS x2", "0.9D AS y2")
    items = spark.range(2).selectExpr("id DIV 2 AS region", "id AS item", "id AS time", "0.5D AS support", "id % 2 = 0 AS anchor", "array(1F, id) AS embedding")
    pairs = spark.createDataFrame([(0, 1)], "left long, right long")
    for df in (boxes.layout_changes(pairs, one), boxes.spatial_prefix(items, similar_by(items), one, lambda x, n: x, 2)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
