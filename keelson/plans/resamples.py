"""Queries of bootstraps and permutation tests, whose draws come from hashes, so that SQL makes the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resampling
from .registry import query
from .views import SQL_T, results

_STEPS = "[" + ", ".join(map(str, resampling.STEPS)) + "]"


def _draws(units: str, by: list[str], measures: list[str]) -> str:
    """CTEs up to d: sums by draw of units (which have a key)."""
    names = "".join(f"{b}, " for b in by)
    return f"""h AS (SELECT *, md5('2027/' || key || '/' || block) AS hash FROM (SELECT *, unnest(range(1250)) AS block FROM {units})),
w AS (SELECT *, block * 8 + i AS draw, len(list_filter({_STEPS}, lambda t: CAST('0x' || substr(hash, 4 * i + 1, 4) AS INTEGER) >= t)) AS weight FROM (SELECT *, unnest(range(8)) AS i FROM h)),
d AS (SELECT {names}draw, sum(weight) AS w, {", ".join(f"sum(weight * {m}) AS {m}" for m in measures)} FROM w GROUP BY {names}draw)"""


_ENDS = "round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(f"""WITH {SQL_T}, c AS (SELECT stratum, a::INT - b::INT AS d, count(*) AS n FROM t GROUP BY ALL), u AS (SELECT *, coalesce(stratum, '') || '/' || CAST(CAST(d AS DECIMAL(20, 6)) AS VARCHAR) || '/' || unit AS key FROM (SELECT stratum, d, unnest(range(1, n + 1)) AS unit FROM c)),
s AS (SELECT stratum, sum(n) AS n, sum(d * n) AS t FROM c GROUP BY stratum), {_draws("u", ["stratum"], ["d"])},
x AS (SELECT draw, sum(CASE WHEN w > 0 THEN d.d * s.n / w::DOUBLE ELSE s.t END) / sum(s.n) AS x FROM d JOIN s USING (stratum) GROUP BY draw)
SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS n, round((SELECT sum(d * n) / sum(n)::DOUBLE FROM c), 6) AS mean, {_ENDS} FROM x""")
def paired_bootstrap(spark, sf):
    t = results(spark, sf).withColumn("d", F.col("a").cast("int") - F.col("b").cast("int"))
    return _rounded(resampling.stratified_bootstrap(t, "stratum", "d"))


@query(f"""WITH {SQL_T}, u AS (SELECT stratum, cluster, coalesce(stratum, '') || '/' || coalesce(cluster, '') AS key, sum(a::INT) AS s, count(*) AS n FROM t GROUP BY stratum, cluster),
l AS (SELECT stratum, count(*) AS k, sum(s) AS ls, sum(n) AS ln FROM u GROUP BY stratum), {_draws("u", ["stratum"], ["s", "n"])},
x AS (SELECT draw, sum(CASE WHEN w > 0 THEN d.s * k / w::DOUBLE ELSE ls END) / sum(CASE WHEN w > 0 THEN d.n * k / w::DOUBLE ELSE ln END) AS x FROM d JOIN l USING (stratum) GROUP BY draw)
SELECT (SELECT count(*) FROM u) AS clusters, round((SELECT sum(s) / sum(n)::DOUBLE FROM u), 6) AS mean, {_ENDS} FROM x""")
def layered_cluster_bootstrap(spark, sf):
    return _rounded(resampling.layered_cluster_bootstrap(results(spark, sf).withColumn("y", F.col("a").cast("double")), "stratum", "cluster", "y"))


@query(f"""WITH {SQL_T}, u AS (SELECT coalesce(cluster, '') AS key, avg(a::INT) AS v FROM t GROUP BY cluster), {_draws("u", [], ["v"])}, x AS (SELECT v / w AS x FROM d WHERE w > 0)
SELECT (SELECT count(*) FROM u) AS clusters, round((SELECT avg(v) FROM u), 6) AS mean, {_ENDS} FROM x""")
def equal_cluster_bootstrap(spark, sf):
    return _rounded(resampling.equal_cluster_bootstrap(results(spark, sf).withColumn("y", F.col("a").cast("double")), "cluster", "y"))


@query(f"""WITH {SQL_T}, u AS (SELECT cluster, stratum, coalesce(cluster, '') AS key, sum(a::INT) AS s, count(*) AS n FROM t GROUP BY cluster, stratum), {_draws("u", ["stratum"], ["s", "n"])},
x AS (SELECT avg(s / n::DOUBLE) AS x FROM d WHERE n > 0 GROUP BY draw HAVING count(*) = (SELECT count(DISTINCT stratum) FROM u))
SELECT (SELECT count(DISTINCT cluster) FROM u) AS clusters, round((SELECT avg(m) FROM (SELECT sum(s) / sum(n)::DOUBLE AS m FROM u GROUP BY stratum)), 6) AS mean, {_ENDS} FROM x""")
def macro_bootstrap(spark, sf):
    return _rounded(resampling.cluster_bootstrap(results(spark, sf).withColumn("y", F.col("a").cast("double")), "cluster", "stratum", "y"))


_FLIPS = f"""WITH {SQL_T}, {{parts}}, u AS (SELECT kind, part, c, sum(d) AS s, row_number() OVER (PARTITION BY kind, part ORDER BY c) - 1 AS bit, count(*) OVER (PARTITION BY kind, part) AS clusters FROM p GROUP BY kind, part, c),
f AS (SELECT kind, part, count(*) AS clusters, sum(s) AS difference FROM u GROUP BY kind, part),
e AS (SELECT kind, part, draw, sum(CASE WHEN (draw >> bit) & 1 = 1 THEN -s ELSE s END) AS s FROM (SELECT *, unnest(range(1::BIGINT << clusters)) AS draw FROM u WHERE clusters <= 12) GROUP BY kind, part, draw),
h AS (SELECT *, md5('2027/' || kind || '/' || part || '/' || c || '/' || block) AS hash FROM (SELECT *, unnest(range(79)) AS block FROM u WHERE clusters > 12)),
g AS (SELECT kind, part, block * 128 + i AS draw, sum(CASE WHEN (CAST('0x' || substr(hash, 2 * (i // 8) + 1, 2) AS INTEGER) >> (i % 8)) & 1 = 1 THEN -s ELSE s END) AS s FROM (SELECT *, unnest(range(128)) AS i FROM h) WHERE block * 128 + i < 10000 GROUP BY kind, part, block, i),
n AS (SELECT kind, part, count(*) AS draws, count(CASE WHEN abs(x.s) >= abs(difference) THEN 1 END) AS at_least FROM (SELECT * FROM e UNION ALL SELECT * FROM g) x JOIN f USING (kind, part) GROUP BY kind, part)
SELECT kind, part, clusters, CAST(difference AS DOUBLE) AS difference, draws, at_least, round(CASE WHEN clusters <= 12 THEN at_least / draws::DOUBLE ELSE (at_least + 1) / (draws + 1)::DOUBLE END, 9) AS p FROM f JOIN n USING (kind, part)"""


@query(_FLIPS.format(parts="p AS (SELECT 'stratum' AS kind, stratum AS part, cluster AS c, a::INT - b::INT AS d FROM t UNION ALL SELECT 'cluster', cluster, stratum, a::INT - b::INT FROM t UNION ALL SELECT 'all', '', cluster, a::INT - b::INT FROM t)"))
def method_differences(spark, sf):
    """Whether two methods differ by more than chance: by stratum and over all (sources flip their signs, by hashes), and by source (languages do, all patterns)."""
    t = results(spark, sf).withColumn("d", F.col("a").cast("int") - F.col("b").cast("int"))
    of = lambda kind, part, c: t.select(F.lit(kind).alias("kind"), part.alias("part"), F.col(c).alias("c"), "d")
    rows = of("stratum", F.col("stratum"), "cluster").unionByName(of("cluster", F.col("cluster"), "stratum")).unionByName(of("all", F.lit(""), "cluster"))
    return resampling.sign_flips(rows, ["kind", "part"], "c", "d").withColumn("p", F.round("p", 9))
