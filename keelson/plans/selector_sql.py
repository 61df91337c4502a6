"""SQL of the selectors: greedy steps as recursion over lists, so that the engine's kernels have an oracle that shares nothing with them.

Members of a question's regions stand in lists in the order of vec_id: ids, g (number of the region), gain, score, and s, of each member its
similarities to all (0 to other regions). A recursion holds the places taken and, of each place, its nearness to what its region took.
"""

from __future__ import annotations

from .views import SQL_V

BUDGET, SEEDS = 32, 16
COS = "CASE WHEN a.n > 0 AND b.n > 0 THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0.0 END"
CLIPPED = f"greatest(0.0, least(1.0, {COS}))"
#: to the nearest 2^-30, so that sums are exact in any order and equals are equal
STEP = "floor({} * 1073741824 + 0.5) / 1073741824"
STEPPED = STEP.format(CLIPPED)

_LISTS = f"""sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rk FROM v) WHERE rk <= {SEEDS}),
rg AS (SELECT question, region, arg_min(vec_id, rk) AS anchor, max(score) AS top, min(density) AS weight FROM sd GROUP BY question, region),
mb AS (SELECT v.*, anchor, weight, top, row_number() OVER (PARTITION BY question ORDER BY vec_id) AS i, dense_rank() OVER (PARTITION BY question ORDER BY region) AS g FROM v JOIN rg USING (question, region)),
sm AS (SELECT a.question, a.i, list(CASE WHEN a.g = b.g THEN {STEPPED} ELSE 0.0 END ORDER BY b.i) AS s FROM mb a JOIN mb b USING (question) GROUP BY a.question, a.i),
gn AS (SELECT a.question, a.i, max({STEPPED} * CASE WHEN a.top > 0 THEN b.score / a.top ELSE 1.0 END) AS gain FROM mb a JOIN sd b USING (question, region) GROUP BY a.question, a.i),
q AS (SELECT question, list(vec_id ORDER BY i) AS ids, list(g ORDER BY i) AS g, list(gain ORDER BY i) AS gain, list(score ORDER BY i) AS score, list(s ORDER BY i) AS s, list(weight ORDER BY i) AS weight,
      list(i ORDER BY g) FILTER (WHERE vec_id = anchor) AS anchors, count(*) AS m, max(g) AS r FROM mb JOIN sm USING (question, i) JOIN gn USING (question, i) GROUP BY question)"""

DECAY = ("{x} * (1 - {d})", "(1 + ({w} - 1) / {n}) * {x} * (1 - {d})")
LISTS = f"""{SQL_V.replace('v AS (SELECT', 'v AS (SELECT 1.0::DOUBLE + ((vec_id // 500) * 100 + label) % 3 AS density,', 1)}, {_LISTS}"""
_OUT = "SELECT question, vec_id, region, CAST(row_number() OVER (PARTITION BY question ORDER BY vec_id) AS INTEGER) AS step FROM (SELECT t.question, unnest(t.taken) AS i FROM {} t) JOIN mb USING (question, i)"


def competition(local: str, priority: str, name: str = "cp") -> str:
    """Rounds of offers: local value over x (gain) and d (nearness), priority over w, x, d and n (places the region holds), all in braces."""
    value, offer = local.format(x="gain[k]", d="near[k]"), priority.format(x="gain[b]", d="near[b]", w="weight[b]", n="held[g[b]]")
    return f"""{name} AS (
  SELECT question, anchors AS taken, list_transform(range(1, m + 1), lambda k: s[anchors[g[k]]][k]) AS near, list_transform(anchors, lambda a: 1) AS held FROM q
  UNION ALL
  SELECT question, list_append(taken, i), list_transform(range(1, m + 1), lambda k: CASE WHEN g[k] = g[i] THEN greatest(near[k], s[i][k]) ELSE near[k] END), list_transform(held, lambda h, z: CASE WHEN z = g[i] THEN h + 1 ELSE h END)
  FROM (SELECT *, list_min(list_transform(list_filter(best, lambda b: lv[b] >= 0), lambda b: struct_pack(p := -({offer}), i := b))).i AS i
    FROM (SELECT *, list_transform(range(1, r + 1), lambda z: list_position(list_transform(lv, lambda x, k: CASE WHEN g[k] = z THEN x ELSE -2.0 END), list_max(list_transform(lv, lambda x, k: CASE WHEN g[k] = z THEN x ELSE -2.0 END)))) AS best
      FROM (SELECT {name}.*, q.* EXCLUDE (question), list_transform(range(1, m + 1), lambda k: CASE WHEN list_contains(taken, k) THEN -1.0 ELSE {value} END) AS lv
        FROM {name} JOIN q USING (question) WHERE len(taken) < least({BUDGET}, m))))
  WHERE i IS NOT NULL)"""


def prefixes(value: str = "gain[k] * sqrt(greatest(0.0, 1 - near[k]))", weighted: bool = False, started: bool = False) -> str:
    """Of each region its members in greedy order from the anchor (started: from the places that table st lists), and the coverage of its members by the first n, from 0."""
    pick, st = "list_position(lv, list_max(lv))", ""
    if started:
        pick, st = f"CASE WHEN len(taken) < len(starts[z]) THEN starts[z][len(taken) + 1] ELSE {pick} END", " JOIN st USING (question)"
    mean = "list_avg(list_filter(new, lambda y, k: g[k] = z))"
    own = "list_filter(score, lambda y, k: g[k] = z)"
    if weighted:
        share = f"list_sum(list_transform(new, lambda y, k: CASE WHEN g[k] = z THEN y * (score[k] / list_sum({own})) ELSE 0.0 END))"
        mean = f"CASE WHEN list_sum({own}) > 0 AND list_max({own}) > list_min({own}) THEN least(1.0, greatest(curve[-1], {share})) ELSE {mean} END"
    return f"""pf AS (
  SELECT question, z, taken, new AS near, list_append(curve, {mean}) AS curve
  FROM (SELECT *, z AS region_, [anchors[z]] AS taken, s[anchors[z]] AS new, [0.0::DOUBLE] AS curve FROM (SELECT *, unnest(range(1, r + 1)) AS z FROM q))
  UNION ALL
  SELECT question, z, taken, new, list_append(curve, {mean})
  FROM (SELECT * REPLACE (list_append(taken, i) AS taken), list_transform(near, lambda y, k: greatest(y, s[i][k])) AS new
    FROM (SELECT *, {pick} AS i
      FROM (SELECT pf.*, q.* EXCLUDE (question){', starts' if started else ''}, list_transform(range(1, m + 1), lambda k: CASE WHEN g[k] <> z OR list_contains(taken, k) THEN -1.0 ELSE {value} END) AS lv
        FROM pf JOIN q USING (question){st} WHERE len(taken) < least({BUDGET}, m, len(list_filter(g, lambda y: y = z)))))))"""


FACILITY = "list_sum(list_transform(near, lambda y, j: CASE WHEN g[j] = z THEN greatest(0.0, s[k][j] - y) ELSE 0.0 END)) / len(list_filter(g, lambda u: u = z))"


def selected_by_competition(local: str, priority: str) -> str:
    return f"WITH RECURSIVE {LISTS}, {competition(local, priority)}, e AS (SELECT question, arg_max(taken, len(taken)) AS taken FROM cp GROUP BY question) {_OUT.format('e')}"


def selected_in_two_passes() -> str:
    return f"""WITH RECURSIVE {LISTS}, {competition(*DECAY)}, {prefixes()},
h AS (SELECT question, arg_max(held, len(taken)) AS held FROM cp GROUP BY question),
o AS (SELECT question, z, arg_max(taken, len(taken)) AS taken FROM pf GROUP BY question, z),
e AS (SELECT question, flatten(list(taken[1:held[z]])) AS taken FROM o JOIN h USING (question) GROUP BY question) {_OUT.format('e')}"""


def selected_by_coverage(weighted: bool = False, least: int = 1, equal: bool = False, facility: bool = False, lists: str = LISTS, starts: str = "") -> str:
    """Exact allocation over the curves: of each number of places used so far the best value, of equals the lexicographically largest numbers."""
    prefix = prefixes(FACILITY, weighted) if facility else prefixes(weighted=weighted, started=bool(starts))
    low, st = ("len(starts[dp.z + 1])", " JOIN st ON st.question = dp.question") if starts else (least, "")
    weight = "1.0" if equal else "min(weight)"
    return f"""WITH RECURSIVE {lists}, {starts}{prefix},
o AS (SELECT question, z, arg_max(taken, len(taken)) AS taken, arg_max(curve, len(taken)) AS curve FROM pf GROUP BY question, z),
w AS (SELECT question, g AS z, {weight} AS w FROM mb GROUP BY question, g),
dp AS (
  SELECT question, 0 AS z, list_transform(range(0, {BUDGET} + 1), lambda u: CASE WHEN u = 0 THEN struct_pack(v := 0.0::DOUBLE, a := []::BIGINT[]) END) AS st FROM q
  UNION ALL
  SELECT dp.question, dp.z + 1, list_transform(range(0, {BUDGET} + 1), lambda u: list_max(list_transform(list_filter(range({low}, least(len(curve) - 1, u) + 1), lambda n: st[u - n + 1] IS NOT NULL), lambda n: struct_pack(v := st[u - n + 1].v + w * curve[n + 1], a := list_append(st[u - n + 1].a, n)))))
  FROM dp JOIN o ON o.question = dp.question AND o.z = dp.z + 1 JOIN w ON w.question = o.question AND w.z = o.z{st}),
b AS (SELECT question, st[least({BUDGET}, m) + 1].a AS a FROM dp JOIN q USING (question) WHERE z = r),
e AS (SELECT question, flatten(list(taken[1:a[z]])) AS taken FROM o JOIN b USING (question) GROUP BY question) {_OUT.format('e')}"""


#: groups of cores instead of regions: seeds no more than 8 apart are a core, windows reach 6 farther, those of two seeds or more merge where they touch, and each row belongs to the nearest core
MERGED = f"""{SQL_V.replace('v AS', 'v0 AS', 1)},
s0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rk FROM v0) WHERE rk <= {SEEDS}),
k0 AS (SELECT *, sum(o) OVER (PARTITION BY question ORDER BY vec_id) AS core FROM (SELECT *, CASE WHEN vec_id - lag(vec_id) OVER (PARTITION BY question ORDER BY vec_id) > 8 THEN 1 ELSE 0 END AS o FROM s0)),
c0 AS (SELECT question, core, min(vec_id) AS a, max(vec_id) AS b, count(*) AS seeds FROM k0 GROUP BY question, core),
h0 AS (SELECT *, max(b + 6) OVER (PARTITION BY question ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c0 WHERE seeds >= 2),
i0 AS (SELECT *, sum(CASE WHEN a - 6 > p THEN 1 ELSE 0 END) OVER (PARTITION BY question ORDER BY a, b) AS isle FROM h0),
g0 AS (SELECT question, core, seeds, min(core) OVER (PARTITION BY question, isle) AS grp FROM i0 UNION ALL SELECT question, core, seeds, core FROM c0 WHERE seeds < 2),
d0 AS (SELECT question, core, CAST(question * 1000 + grp AS BIGINT) AS region, 1.0::DOUBLE + sum(seeds - 1) OVER (PARTITION BY question, grp) AS density FROM g0),
n0 AS (SELECT question, vec_id, core FROM v0 JOIN c0 USING (question) QUALIFY row_number() OVER (PARTITION BY question, vec_id ORDER BY greatest(a - vec_id, vec_id - b, 0), a, core) = 1),
v AS (SELECT v0.* EXCLUDE (region), d0.region, d0.density FROM v0 JOIN n0 USING (question, vec_id) JOIN d0 ON d0.question = n0.question AND d0.core = n0.core), {_LISTS}"""

#: by name of select_by_regions' variant
SELECT = {
    "joint": selected_by_competition("1 - {d}", "{w} * (1 - {d})"),
    "soft_support": selected_by_competition("{x} * (1 - {d})", "{w} * {x} * (1 - {d})"),
    "decoupled": selected_by_competition("{x} * (1 - {d})", "{w} * (1 - {d})"),
    "density_decay": selected_by_competition(*DECAY),
    "two_pass": selected_in_two_passes(),
    "coverage": selected_by_coverage(),
    "relevance_coverage": selected_by_coverage(weighted=True),
    "equal_coverage": selected_by_coverage(equal=True),
    "optional_coverage": selected_by_coverage(least=0),
    "facility": selected_by_coverage(facility=True),
}

#: lists of each region's rows in the order of vec_id: s of cosines as they are, c of clipped ones, tok of groups that a row shows
BY_REGION = f"""{SQL_V}, mb AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY vec_id) AS i, vec_id % 4 AS seg, max(score) OVER (PARTITION BY region, vec_id % 4) AS best FROM v),
sm AS (SELECT a.region, a.i, list({COS} ORDER BY b.i) AS s, list({CLIPPED} ORDER BY b.i) AS c FROM mb a JOIN mb b USING (region) GROUP BY a.region, a.i),
q AS (SELECT region, list(vec_id ORDER BY i) AS ids, list(score ORDER BY i) AS score, list(s ORDER BY i) AS s, list(c ORDER BY i) AS c, list(seg ORDER BY i) AS seg, list(best ORDER BY i) AS best, list(vec_id::DOUBLE ORDER BY i) AS t, list(CASE WHEN vec_id % 7 = 0 THEN []::BIGINT[] ELSE [vec_id % 3, 10 + vec_id % 5] END ORDER BY i) AS tok, count(*) AS m FROM mb JOIN sm USING (region, i) GROUP BY region)"""


def greedy(first: str, value: str, near: str, steps: str) -> str:
    """step and vec_id by region: the open row of the largest value, over k (a row), near and taken; first: the first row, or null."""
    return f"""WITH RECURSIVE {BY_REGION}, t AS (
  SELECT region, CASE WHEN i IS NULL THEN []::BIGINT[] ELSE [i] END AS taken, list_transform(range(1, m + 1), lambda k: CASE WHEN i IS NULL THEN 0.0::DOUBLE ELSE {near.format(old='-1.0')} END) AS near FROM (SELECT *, {first} AS i FROM q)
  UNION ALL
  SELECT region, list_append(taken, i), list_transform(range(1, m + 1), lambda k: {near.format(old='near[k]')})
  FROM (SELECT *, list_position(lv, list_max(lv)) AS i
    FROM (SELECT t.*, q.* EXCLUDE (region), list_transform(range(1, m + 1), lambda k: CASE WHEN list_contains(taken, k) THEN -1e9 ELSE {value} END) AS lv FROM t JOIN q USING (region) WHERE len(taken) < {steps})))
SELECT region, CAST(step AS INTEGER) AS step, ids[i] AS vec_id FROM (SELECT region, unnest(taken) AS i, generate_subscripts(taken, 1) AS step FROM (SELECT region, arg_max(taken, len(taken)) AS taken FROM t GROUP BY region)) JOIN q USING (region)"""


MMR = greedy("list_position(score, list_max(score))", "0.5 * (2 * score[k] - 1) - 0.5 * near[k]", "greatest({old}, s[i][k])", "least(8, m)")
SB = greedy("NULL", "(0.5 * score[k] + 0.5 * best[k] / (1 + len(list_filter(taken, lambda j: seg[j] = seg[k])))) - 0.2 * near[k]", "CASE WHEN seg[i] = seg[k] THEN greatest({old}, c[i][k]) ELSE {old} END", "least(8, m)")

_FIRST = "list_position(score, list_max(score))"
_VISUAL = "score[k] * sqrt(greatest(0.0, 1 - near[k]))"
_JACCARD = "CASE WHEN len(tok[k]) = 0 THEN 1.0 ELSE len(list_intersect(tok[k], tok[i])) / len(list_distinct(list_concat(tok[k], tok[i])))::DOUBLE END"
_SPAN = "(" + STEP.format("(CASE WHEN list_max(t) = list_min(t) THEN 1.0 ELSE 1 - power((t[{a}] - t[{b}]) / (list_max(t) - list_min(t)), 2) END)") + ")"
_UNSEEN = "len(list_filter(tok[k], lambda x: len(list_filter(taken, lambda j: list_contains(tok[j], x))) = 0))"
VISUAL_TEMPORAL = greedy(_FIRST, _VISUAL, "greatest({old}, c[i][k] * exp(-abs(t[i] - t[k]) / 40))", "least(8, m)")
TEXT_STATE = greedy(_FIRST, _VISUAL, f"greatest({{old}}, c[i][k] * ({_JACCARD}))", "least(8, m)")
TEMPORAL_COVERAGE = greedy(_FIRST, f"list_sum(list_transform(near, lambda y, j: greatest(0.0, {_SPAN.format(a='j', b='k')} - y))) / m", "greatest({old}, " + _SPAN.format(a="i", b="k").replace("{", "{{").replace("}", "}}") + ")", "least(8, m)")
LITERAL = greedy(_FIRST, f"score[k] * sqrt(greatest(0.0, 1 - CASE WHEN len(tok[k]) = 0 THEN near[k] ELSE near[k] * (1 - {_UNSEEN} / len(tok[k])::DOUBLE) END))", "greatest({old}, c[i][k])", "least(8, m)")

RUNS = f"""WITH RECURSIVE {BY_REGION}, r AS (
  SELECT region, 1::BIGINT AS i, [1::BIGINT] AS held, 0::BIGINT AS run FROM q
  UNION ALL
  SELECT region, i + 1, CASE WHEN ok THEN list_append(held, i + 1) ELSE [i + 1] END, run + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT r.*, t[i + 1] - t[i] <= 30 AND len(list_filter(held, lambda j: s[i + 1][j] < 0.2)) = 0 AS ok FROM r JOIN q USING (region) WHERE i < m))
SELECT region, ids[i] AS vec_id, run FROM r JOIN q USING (region)"""

PAIRS = f"""WITH RECURSIVE {BY_REGION}, r AS (
  SELECT region, 1::BIGINT AS i, 0.0::DOUBLE AS v0, []::BIGINT[] AS p0, 0.0::DOUBLE AS v1, []::BIGINT[] AS p1 FROM q
  UNION ALL
  SELECT region, i + 1, v1, p1, CASE WHEN w > v1 THEN w ELSE v1 END, CASE WHEN w > v1 THEN list_append(p0, i) ELSE p1 END
  FROM (SELECT r.*, CASE WHEN ids[i] // 100 = ids[i + 1] // 100 AND (ids[i] % 3 = 0) <> (ids[i + 1] % 3 = 0) THEN v0 + s[i][i + 1] ELSE -1.0 END AS w FROM r JOIN q USING (region) WHERE i < m))
SELECT region, ids[j] AS a, ids[j + 1] AS b FROM (SELECT region, unnest(p1) AS j FROM r JOIN q USING (region) WHERE i = m) JOIN q USING (region)"""

_TOP = "list_slice(list_transform(list_sort(list_transform(range(1, m + 1), lambda k: struct_pack(a := -score[k], k := k))), lambda x: x.k), 1, {n})"
EXCHANGE = f"""WITH {BY_REGION.replace(CLIPPED, STEPPED)}, o AS (SELECT *, {_TOP.format(n=4)} AS held FROM q),
x AS (SELECT *, list_avg(list_transform(range(1, m + 1), lambda k: list_max(list_transform(held, lambda j: c[j][k])))) AS now, unnest(held) AS gone FROM o),
y AS (SELECT *, unnest(list_filter(range(1, m + 1), lambda k: NOT list_contains(held, k))) AS come FROM x),
z AS (SELECT region, ids[gone] AS removed, ids[come] AS added, list_avg(list_transform(range(1, m + 1), lambda k: greatest(c[come][k], list_max(list_transform(list_filter(held, lambda j: j <> gone), lambda j: c[j][k]))))) - now AS gain FROM y)
SELECT region, removed, added, round(gain, 9) AS gain FROM z WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY region ORDER BY gain DESC, added, removed) = 1"""

LOW_LOSS = f"""WITH {BY_REGION}, o AS (SELECT *, {_TOP.format(n=5)} AS held FROM q),
n AS (SELECT *, list_transform(range(1, m + 1), lambda k: list_sort(list_transform(held, lambda j, p: struct_pack(a := -c[j][k], p := p)))) AS by_ref FROM o),
l AS (SELECT *, list_transform(held, lambda j, p: coalesce(list_sum(list_transform(list_filter(by_ref, lambda x: x[1].p = p), lambda x: x[2].a - x[1].a)), 0.0)) AS loss FROM n),
g AS (SELECT *, list_min(list_transform([2, 3, 4], lambda p: struct_pack(x := loss[p], j := held[p]))).j AS gone FROM l)
SELECT region, ids[unnest(list_filter(held, lambda j: j <> gone))] AS vec_id FROM g"""

LAST_SLOT = f"""WITH {SQL_V}, o AS (SELECT question, region, vec_id, row_number() OVER (PARTITION BY region ORDER BY score DESC, vec_id) AS n, ((vec_id * 53) % 97) / 97.0::DOUBLE AS value FROM v),
d AS (SELECT a.question, a.region, b.value - a.value AS rise FROM o a JOIN o b ON a.region = b.region AND a.n = 3 AND b.n = 4 WHERE b.value > a.value),
w AS (SELECT question, region FROM d QUALIFY row_number() OVER (PARTITION BY question ORDER BY rise DESC, region) = 1)
SELECT o.question, o.region, o.vec_id FROM o LEFT JOIN w ON w.region = o.region WHERE o.n <= 2 OR (o.n = 3 AND w.region IS NULL) OR (o.n = 4 AND w.region IS NOT NULL)"""

#: the best seed of each core (here, of each hundred rows) in a region, best first
CORE_ANCHOR = selected_by_coverage(weighted=True, starts="""st AS (SELECT question, list(l ORDER BY g) AS starts FROM (SELECT question, g, list(i ORDER BY rk) AS l FROM (SELECT mb.question, mb.g, mb.i, sd.rk FROM mb JOIN sd USING (question, vec_id) QUALIFY row_number() OVER (PARTITION BY mb.question, mb.g, vec_id // 100 ORDER BY sd.rk) = 1) GROUP BY question, g) GROUP BY question), """)
CONDITIONAL = selected_by_coverage(lists=MERGED)
