"""Queries of clips that repeat, boxes of texts and what they discount, over clips and boxes derived from the given vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import clipped, cosine
from ..operators import boxes, matching
from ..sources.shared import saved, shuffled
from .registry import query
from .selector_sql import BY_REGION, greedy
from .views import SQL_V, table, vectors


@query("""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS h FROM embeddings),
w AS (SELECT vec_id, unnest(range(greatest((vec_id - 6) // 2, 0), vec_id // 2 + 1)) AS clip FROM v),
c AS (SELECT clip, vec_id - 2 * clip AS at, vec_id FROM w WHERE clip IN (SELECT clip FROM w GROUP BY clip HAVING count(*) = 8)),
d AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(list_filter(list_zip(a.h, b.h), lambda z: z[1] <> z[2])) <= 6),
m AS (SELECT q.clip AS query, x.clip AS match, q.at AS i, x.at AS j FROM c q JOIN d ON q.vec_id = d.a JOIN c x ON x.vec_id = d.b WHERE q.clip % 5 = 0 AND q.clip <> x.clip),
p AS (SELECT query, match FROM m GROUP BY query, match HAVING count(DISTINCT i) >= 6),
r AS (SELECT query, match, i, j, 1 AS n FROM m JOIN p USING (query, match) UNION SELECT r.query, r.match, m.i, m.j, r.n + 1 FROM r JOIN m ON r.query = m.query AND r.match = m.match AND m.i > r.i AND m.j > r.j)
SELECT query, match, CAST(max(n) AS INTEGER) AS common FROM r GROUP BY query, match HAVING max(n) >= 6
""")
def clip_near_duplicates(spark, sf):
    """Clips of eight vectors, each begun two after the one before; of every fifth, the clips that share six in order."""
    v = table(spark, sf, "embeddings").select("vec_id", matching.sign_hash(F.col("embedding")).alias("h"))
    clips = v.withColumn("clip", F.explode(F.sequence(F.greatest(F.ceil((F.col("vec_id") - 7) / 2), F.lit(0)), F.floor(F.col("vec_id") / 2))))
    clips = clips.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).alias("f")).where(F.size("f") == 8).select("clip", F.transform("f", lambda x: x["h"]).alias("hashes"))
    clips = saved(clips, "clips")
    return matching.clip_matches(clips.where("clip % 5 = 0"), clips, "clip", "hashes", 6, 6, 4)


def _regions(spark, sf):
    """Three read texts of each vector, at places of a picture of 100 x 80."""
    i, k = F.col("vec_id"), F.col("k")
    x, y = (i * 7 + k * 31) % 50, (i * 13 + k * 17) % 40
    right, low = x + 20 + (i * 3 + k * 11) % 30, y + 15 + (i * 5 + k) % 25
    corner = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    text = F.concat(F.lit("  No "), (i % 7).cast("string"), F.lit("  É"), F.when(k == 1, "").otherwise("a"), k.cast("string"))
    v = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*(F.lit(n).cast("long") for n in range(3)))).alias("k"))
    return v.select(F.col("vec_id").alias("frame"), F.col("k").alias("region"), text.alias("text"), (((i + k) % 10) / 10.0).alias("score"), F.array(corner(x, low), corner(x, y), corner(right, y), corner(right, low)).alias("polygon"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))


_BOXES = """bx AS (SELECT vec_id AS frame, k AS region, 'no ' || (vec_id % 7) || ' é' || CASE WHEN k = 1 THEN '' ELSE 'a' END || k AS text, x / 100.0::DOUBLE AS x1, y / 80.0::DOUBLE AS y1, (x + 20 + (vec_id * 3 + k * 11) % 30) / 100.0::DOUBLE AS x2, (y + 15 + (vec_id * 5 + k) % 25) / 80.0::DOUBLE AS y2
  FROM (SELECT vec_id, k, (vec_id * 7 + k * 31) % 50 AS x, (vec_id * 13 + k * 17) % 40 AS y FROM embeddings, (SELECT unnest([0, 1, 2]) AS k)) WHERE (vec_id + k) % 10 / 10.0::DOUBLE >= 0.5),
ov AS (SELECT *, w * h / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h) AS iou FROM (SELECT p.l, p.r, a.region AS ra, b.region AS rb, a.text AS ta, b.text AS tb, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2,
  greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS w, greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS h FROM prs p JOIN bx a ON a.frame = p.l JOIN bx b ON b.frame = p.r)),
po AS (SELECT *, max(iou) OVER (PARTITION BY l, r, ra) AS ma, max(iou) OVER (PARTITION BY l, r, rb) AS mb FROM ov WHERE iou > 0),
un AS (SELECT *, sum(CASE WHEN iou = ma THEN 1 ELSE 0 END) OVER (PARTITION BY l, r, ra) AS na, sum(CASE WHEN iou = mb THEN 1 ELSE 0 END) OVER (PARTITION BY l, r, rb) AS nb FROM po),
lc AS (SELECT p.l, p.r, coalesce(c, 0.0) AS change FROM prs p LEFT JOIN (SELECT l, r, max(iou * levenshtein(ta, tb) / greatest(length(ta), length(tb))) AS c FROM un WHERE iou = ma AND iou = mb AND na = 1 AND nb = 1 GROUP BY l, r) x ON p.l = x.l AND p.r = x.r)"""


# levenshtein counts bytes in SQL: é there is one letter that all texts share, so distances agree, and lengths are of letters
@query(f"WITH prs AS (SELECT a.vec_id AS l, b.vec_id AS r FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id IN (1, 7)), {_BOXES} SELECT l AS \"left\", r AS \"right\", round(change, 9) AS change FROM lc")
def layout_changes(spark, sf):
    """How much the texts at the same places change from a vector's picture to the next one and the seventh after."""
    r = _regions(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("left"))
    pairs = v.withColumn("right", F.explode(F.array(F.col("left") + 1, F.col("left") + 7))).join(v.select(F.col("left").alias("right")), "right")
    return boxes.layout_changes(pairs, boxes.boxes(r)).select("left", "right", F.round("change", 9).alias("change"))


_LAYOUT = greedy("list_position(score, list_max(score))", "score[k] * sqrt(1 - near[k])", "greatest({old}, c[i][k] * (1 - ch[i][k]), 0.0)", "least(5, m)")
_LAYOUT = _LAYOUT.replace(
    BY_REGION,
    BY_REGION.replace(
        "\nq AS (SELECT region, list(vec_id", f"\nprs AS (SELECT a.vec_id AS l, b.vec_id AS r FROM mb a JOIN mb b USING (region)), {_BOXES}, chm AS (SELECT b.region, b.i, list(change ORDER BY a.i) AS ch FROM lc JOIN mb a ON a.vec_id = lc.l JOIN mb b ON b.vec_id = lc.r GROUP BY b.region, b.i),\nq AS (SELECT region, list(ch ORDER BY i) AS ch, list(vec_id", 1
    ).replace("FROM mb JOIN sm USING (region, i) GROUP BY region)", "FROM mb JOIN sm USING (region, i) JOIN chm USING (region, i) GROUP BY region)"),
)


def items_of(spark, sf):
    """Vectors as items of their regions: time by id, support by score, the best (earliest of equals) as anchor."""
    v = vectors(spark, sf)
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "vec_id")) == 1
    return v.select("region", F.col("vec_id").alias("item"), F.col("vec_id").alias("time"), F.col("score").alias("support"), best.alias("anchor"), "embedding")


def similar_by(items):
    """Clipped cosine of pairs of items."""
    a, b = (items.select(F.col("item").alias(s), F.col("embedding").alias(f"_{s}")) for s in ("left", "right"))
    return lambda pairs: pairs.join(shuffled(a), "left").join(shuffled(b), "right").select("left", "right", clipped(cosine(F.col("_left"), F.col("_right"))).alias("c"))


@query(_LAYOUT.replace("CAST(step AS INTEGER) AS step, ids[i] AS vec_id", "ids[i] AS item, CAST(step - 1 AS INTEGER) AS step"))
def spatial_prefix(spark, sf):
    """A region's first five by support, likeness to what is chosen, and how the texts of both differ."""
    items = saved(items_of(spark, sf), "items")
    placed = saved(boxes.boxes(_regions(spark, sf)), "boxes")
    return boxes.spatial_prefix(items, similar_by(items), placed, lambda df, n: saved(df, f"step{n}"), 5)
