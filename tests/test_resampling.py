from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import resampling


def test_weights_are_poisson_and_the_same_again(spark):
    units = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("g"), F.lit(1.0).alias("one"), F.col("id").cast("double").alias("x"))
    draws = lambda df, n: {(r["g"], r["draw"]): (r["w"], r["one"], r["x"]) for r in resampling.poisson_sums(df, F.col("k"), ["g"], ["one", "x"], n, 7).collect()}
    got = draws(units, 100)
    assert len(got) == 200 and all(w == one for w, one, _ in got.values()) and got == draws(units.repartition(5), 100)
    w = np.array([w for w, *_ in got.values()])  # sums of 200 weights
    assert abs(w.mean() - 200) < 5 and abs(w.var() - 200) < 60
    # other draws, other seeds and other names are other weights
    assert len({x for _, _, x in got.values()}) > 190


def test_single_weights_follow_the_distribution(spark):
    one = resampling.poisson_sums(spark.range(1).select(F.lit("u").alias("k"), F.lit(1).alias("m")), F.col("k"), [], ["m"], 40_000, 1)
    share = {r["w"]: r["count"] / 40_000 for r in one.groupBy("w").count().collect()}
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert share[k] == pytest.approx(p, abs=0.008)


def test_many_clusters_equal_resampling(spark):
    rng = np.random.default_rng(3)
    size = rng.integers(1, 6, 900)
    rows = [(i, i % 2, float(x)) for i, n in enumerate(size) for x in rng.integers(0, 2, n)]
    df = spark.createDataFrame(rows, "c int, t int, y double")
    s = np.array([[sum(y for c, t, y in rows if c == i and t == k) for k in (0, 1)] for i in range(900)])
    n = np.array([[sum(1 for c, t, _ in rows if c == i and t == k) for k in (0, 1)] for i in range(900)])
    w = rng.multinomial(900, np.full(900, 1 / 900), 4000)
    macro = (w @ s / (w @ n)).mean(1)
    got = resampling.cluster_bootstrap(df, "c", "t", "y", 4000).first()
    low, high = np.percentile(macro, [2.5, 97.5])
    assert got["clusters"] == 900 and got["low"] == pytest.approx(low, abs=0.004) and got["high"] == pytest.approx(high, abs=0.004)
    micro = (w @ s.sum(1)) / (w @ n.sum(1))
    got = resampling.layered_cluster_bootstrap(df.withColumn("one", F.lit("x")), "one", "c", "y", 4000).first()
    assert [got["low"], got["high"]] == pytest.approx(np.percentile(micro, [2.5, 97.5]).tolist(), abs=0.004)


def test_resampling_of_little_and_nothing(spark):
    none = spark.createDataFrame([], "s string, c int, y double")
    for f in (lambda d: resampling.stratified_bootstrap(d, "s", "y", 50), lambda d: resampling.layered_cluster_bootstrap(d, "s", "c", "y", 50), lambda d: resampling.equal_cluster_bootstrap(d, "c", "y", 50), lambda d: resampling.cluster_bootstrap(d, "c", "s", "y", 50)):
        assert f(none).isEmpty()
    one = spark.createDataFrame([("a", 1, 2.0), (None, None, 2.0), ("a", 3, None)], none.schema)
    for f in (lambda d: resampling.stratified_bootstrap(d, "s", "y", 50), lambda d: resampling.layered_cluster_bootstrap(d, "s", "c", "y", 50), lambda d: resampling.equal_cluster_bootstrap(d, "c", "y", 50), lambda d: resampling.cluster_bootstrap(d, "c", "s", "y", 50)):
        r = f(one).first()
        assert (r["mean"], r["low"], r["high"]) == (2.0, 2.0, 2.0)
    assert resampling.sign_flips(none, ["s"], "c", "y").isEmpty()


def test_sign_flips_of_small_groups_are_enumerated(spark):
    groups = {"a": [1, 1, 1, 1, -1], "b": [3, 0, -3], "c": [2], "d": [0, 0], "e": [1] * 10}
    df = spark.createDataFrame([(g, i, d) for g, ds in groups.items() for i, d in enumerate(ds)], "g string, c int, d int")
    got = {r["g"]: r for r in resampling.sign_flips(df, ["g"], "c", "d").collect()}
    for g, ds in groups.items():
        totals = [abs(sum(s * d for s, d in zip(signs, ds, strict=True))) for signs in product((1, -1), repeat=len(ds))]
        at = sum(t >= abs(sum(ds)) for t in totals)
        assert (got[g]["clusters"], got[g]["draws"], got[g]["at_least"], got[g]["p"]) == (len(ds), len(totals), at, at / len(totals)), g


def test_sign_flips_by_hashes_agree_with_enumeration(spark):
    rng = np.random.default_rng(11)
    rows = [(g, c, int(d)) for g in range(4) for c in range(12) for d in rng.choice([-1, 0, 0, 1, 1], 5)]
    df = spark.createDataFrame(rows, "g int, c int, d int")
    whole = {r["g"]: r["p"] for r in resampling.sign_flips(df, ["g"], "c", "d").collect()}
    drawn = {r["g"]: r for r in resampling.sign_flips(df, ["g"], "c", "d", exact=3, reps=20_000).collect()}
    again = {r["g"]: r for r in resampling.sign_flips(df.repartition(7), ["g"], "c", "d", exact=3, reps=20_000).collect()}
    assert drawn == again
    for g, p in whole.items():
        assert drawn[g]["draws"] == 20_000 and drawn[g]["p"] == pytest.approx(p, abs=0.02)
