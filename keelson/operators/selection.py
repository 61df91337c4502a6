"""Set selection under a budget: numpy kernels for one small group, and their grouped application.

A group is a question's candidates: some hundred to ten thousand rows, so it fits a task by contract. Kernels take arrays in key order
(time, index) and break ties by that order. What is relational around them (plans, supports, joins) stays with DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Similarity = Callable[[int, np.ndarray], np.ndarray]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def clipped_cosines(x: np.ndarray) -> np.ndarray:
    return np.clip(x @ x.T, 0.0, 1.0)


def stepped(sim: np.ndarray) -> np.ndarray:
    """Similarities to the nearest 2^-30: their sums are exact in any order, so rows that are equally good are equal, and the tie goes by key order."""
    return np.floor(sim * 2.0**30 + 0.5) / 2.0**30


def first_best(score: np.ndarray, open_: np.ndarray) -> int:
    """The open row of the largest score, the first of equals; -1 if none is open."""
    at = np.flatnonzero(open_)
    return int(at[np.argmax(score[at])]) if len(at) else -1


def support(scores: np.ndarray, seeds: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Of each row, the largest weighted similarity to a seed; seeds weigh by score, alike if none scores."""
    top = scores[seeds].max(initial=0.0)
    w = scores[seeds] / top if top > 0 else np.ones(len(seeds))
    return (sim[:, seeds] * w).max(1, initial=0.0)


@dataclass
class Region:
    """Members and references (rows of the group), the anchor and the density weight of a region."""

    members: np.ndarray
    references: np.ndarray
    anchor: int
    weight: float = 1.0


def prefix(region: Region, gain: np.ndarray, sim: np.ndarray, k: int, local: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, start: Sequence[int] | None = None) -> list[int]:
    """Members in greedy order from the anchor (or start) by gain * sqrt(1 - similarity to what is taken)."""
    local = local or (lambda g, d: g * np.sqrt(np.maximum(0.0, 1 - d)))
    m = region.members
    taken = list(start) if start is not None else [region.anchor]
    near = sim[np.ix_(m, taken)].max(1)
    open_ = ~np.isin(m, taken)
    while len(taken) < min(k, len(m)):
        i = first_best(local(gain[m], near), open_)
        if i < 0:
            break
        taken.append(int(m[i]))
        open_[i] = False
        near = np.maximum(near, sim[m, m[i]])
    return taken


def facility_prefix(region: Region, sim: np.ndarray, k: int, weights: np.ndarray | None = None) -> list[int]:
    """Members in greedy order by weighted gain of coverage of the references (its mean without weights)."""
    m, r = region.members, region.references
    taken, covered, open_ = [region.anchor], sim[r, region.anchor].copy(), m != region.anchor
    while len(taken) < min(k, len(m)):
        rise = np.maximum(0.0, sim[np.ix_(r, m)] - covered[:, None])
        i = first_best(rise.sum(0) / max(1, len(r)) if weights is None else (weights[:, None] * rise).sum(0), open_)
        if i < 0:
            break
        taken.append(int(m[i]))
        open_[i] = False
        covered = np.maximum(covered, sim[r, m[i]])
    return taken


def coverage_curve(region: Region, order: Sequence[int], sim: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
    """Coverage of the references by the first n of order, n from 0; weighted by scores unless these are all equal or sum to 0."""
    r = region.references
    covered, out = np.zeros(len(r)), [0.0]
    w = None
    if scores is not None and len(r) and scores[r].sum() > 0 and np.ptp(scores[r]) > 0:
        w = scores[r] / np.cumsum(scores[r])[-1]
    for i in order:
        covered = np.maximum(covered, sim[r, i])
        value = float(covered.mean() if w is None else np.cumsum(w * covered)[-1]) if len(r) else 0.0  # weighted: summed in key order
        out.append(value if w is None else min(1.0, max(out[-1], value)))
    return np.array(out)


def allocate(curves: Sequence[np.ndarray], weights: Sequence[float], budget: int, least: Sequence[int] | int = 1) -> tuple[float, tuple[int, ...]]:
    """Numbers by region that maximise the sum of weight * curve at a total of budget; of equals the lexicographically largest."""
    least = [least] * len(curves) if isinstance(least, int) else list(least)
    for c, w in zip(curves, weights, strict=True):
        if not (np.isfinite(c).all() and np.isfinite(w)) or w <= 0 or (np.diff(c) < 0).any() or (c < 0).any() or (c > 1 + 1e-12).any():
            raise ValueError("curves must rise within 0 and 1 and weights be positive")
    if sum(least) > budget or sum(len(c) - 1 for c in curves) < budget:
        raise ValueError("the budget is out of reach")
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for c, w, low in zip(curves, weights, least, strict=True):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (value, alloc) in best.items():
            for n in range(low, min(len(c) - 1, budget - used) + 1):
                new = (value + w * float(c[n]), (*alloc, n))
                if used + n not in step or new > step[used + n]:
                    step[used + n] = new
        best = step
    if budget not in best:
        raise ValueError("the budget is out of reach")
    return best[budget]


def compete(regions: Sequence[Region], gain: np.ndarray, sim: np.ndarray, budget: int, local: Callable, priority: Callable) -> list[list[int]]:
    """Every region starts with its anchor; each round each proposes its best member, the proposal of the highest priority wins."""
    taken = [[r.anchor] for r in regions]
    near = [sim[r.members, r.anchor].copy() for r in regions]
    open_ = [r.members != r.anchor for r in regions]
    while sum(map(len, taken)) < budget:
        offers = []
        for k, r in enumerate(regions):
            i = first_best(local(gain[r.members], near[k]), open_[k])
            if i >= 0:
                offers.append((-float(priority(r.weight, gain[r.members[i]], near[k][i], len(taken[k]))), int(r.members[i]), k, i))
        if not offers:
            break
        _, row, k, i = min(offers)
        taken[k].append(row)
        open_[k][i] = False
        near[k] = np.maximum(near[k], sim[regions[k].members, row])
    return taken


#: local utility and cross-region priority (weight, gain, nearness, number held) of the competition variants
COMPETITIONS: dict[str, tuple[Callable, Callable]] = {
    "joint": (lambda g, d: 1 - d, lambda w, g, d, n: w * (1 - d)),
    "soft_support": (lambda g, d: g * (1 - d), lambda w, g, d, n: w * g * (1 - d)),
    "decoupled": (lambda g, d: g * (1 - d), lambda w, g, d, n: w * (1 - d)),
    "density_decay": (lambda g, d: g * (1 - d), lambda w, g, d, n: (1 + (w - 1) / n) * g * (1 - d)),
}


def two_pass(regions: Sequence[Region], gain: np.ndarray, sim: np.ndarray, budget: int, second: np.ndarray | None = None) -> list[int]:
    """Quotas by the density-decay competition, then rows by gain * sqrt(1 - d) within the quotas."""
    quotas = [len(t) for t in compete(regions, gain, sim, budget, *COMPETITIONS["density_decay"])]
    out = [i for r, q in zip(regions, quotas, strict=True) for i in prefix(r, gain if second is None else second, sim, q)]
    return sorted(out)


def coverage_select(regions: Sequence[Region], gain: np.ndarray, sim: np.ndarray, budget: int, scores: np.ndarray | None = None, least: int | Sequence[int] = 1, equal: bool = False, facility: bool = False) -> tuple[list[int], tuple[int, ...], float]:
    """Greedy prefixes and coverage curves by region, exact allocation over regions: rows in key order, numbers by region, value.

    scores: references weigh by them (else alike); least: 0 lets regions go empty; equal: regions weigh alike; facility: prefixes by coverage gain.
    """
    budget = min(budget, sum(len(r.members) for r in regions))
    orders = [facility_prefix(r, sim, budget) if facility else prefix(r, gain, sim, budget) for r in regions]
    curves = [coverage_curve(r, o, sim, scores) for r, o in zip(regions, orders, strict=True)]
    value, alloc = allocate(curves, [1.0 if equal else r.weight for r in regions], budget, least)
    return sorted(i for o, n in zip(orders, alloc, strict=True) for i in o[:n]), alloc, value


def _by_core(order: Sequence[int], core: np.ndarray) -> dict:
    out: dict = {}
    for i in order:
        out.setdefault(core[i], []).append(i)
    return out


def core_anchor_select(regions: Sequence[Region], starts: Sequence[Sequence[int]], gain: np.ndarray, sim: np.ndarray, budget: int, scores: np.ndarray) -> list[int]:
    """Prefixes that begin with several anchors a region, none of which allocation may leave out, and weighted coverage curves: rows in key order."""
    orders = [prefix(r, gain, sim, budget, start=s) for r, s in zip(regions, starts, strict=True)]
    curves = [coverage_curve(r, o, sim, scores) for r, o in zip(regions, orders, strict=True)]
    _, alloc = allocate(curves, [r.weight for r in regions], budget, [len(s) for s in starts])
    return sorted(i for o, n in zip(orders, alloc, strict=True) for i in o[:n])


def segment_competition(segment: np.ndarray, scores: np.ndarray, sim: np.ndarray, k: int, lam: float = 0.5, rho: float = 0.2) -> list[int]:
    """k rounds: each segment's best (1 - lam) * r + lam * best of segment / (1 + held) - rho * nearness to its own picks; negative gains count."""
    if len(scores) < k:
        raise ValueError("fewer rows than rounds")
    n_seg = int(segment.max()) + 1
    rep = np.array([scores[segment == s].max(initial=0.0) for s in range(n_seg)])
    held, near, open_, taken = np.zeros(n_seg), np.zeros(len(scores)), np.ones(len(scores), bool), []
    for _ in range(k):
        i = first_best((1 - lam) * scores + lam * rep[segment] / (1 + held[segment]) - rho * near, open_)
        taken.append(i)
        open_[i] = False
        held[segment[i]] += 1
        same = segment == segment[i]
        near[same] = np.maximum(near[same], sim[same, i])
    return taken


def marginal_relevance(scores: np.ndarray, cos: np.ndarray, k: int, lam: float = 0.5, first: int | None = None) -> list[int]:
    """Maximal marginal relevance with 2 r - 1 as relevance and cosines as they are."""
    rel = 2 * scores - 1
    taken, open_ = [int(np.argmax(rel)) if first is None else first], np.ones(len(scores), bool)
    open_[taken[0]] = False
    near = cos[:, taken[0]].copy()
    while len(taken) < min(k, len(scores)):
        i = first_best(lam * rel - (1 - lam) * near, open_)
        taken.append(i)
        open_[i] = False
        near = np.maximum(near, cos[:, i])
    return taken


def removal_losses(refs: np.ndarray, taken: Sequence[int], sim: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Mean coverage that each taken row alone holds up: best minus second best where it is best."""
    s = sim[np.ix_(refs, list(taken))]
    order = np.argsort(-s, 1, kind="stable")
    best = s[np.arange(len(refs)), order[:, 0]]
    second = s[np.arange(len(refs)), order[:, 1]] if len(taken) > 1 else np.zeros(len(refs))
    return weight * np.bincount(order[:, 0], best - second, len(taken)) / max(1, len(refs))


def best_exchange(refs: np.ndarray, taken: Sequence[int], others: Sequence[int], sim: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, removed, added) of the single swap that raises mean coverage most; ties to the smaller added, then removed row."""
    now = sim[np.ix_(refs, list(taken))].max(1).mean()
    found = None
    for r in taken:
        rest = [t for t in taken if t != r]
        base = sim[np.ix_(refs, rest)].max(1) if rest else np.zeros(len(refs))
        for a in others:
            gain = float(np.maximum(base, sim[refs, a]).mean() - now)
            if gain > 0 and (found is None or (gain, -a, -r) > (found[0], -found[2], -found[1])):
                found = (gain, r, a)
    return found


def bounded_supplement(regions: Sequence[Region], taken: Sequence[int], gain: np.ndarray, sim: np.ndarray, protected: set[int], most: int = 4) -> list[int]:
    """Up to most swaps: in comes the row of the largest gain * sqrt(1 - d) in its region, out the original row of the least coverage loss."""
    owner = {int(i): k for k, r in enumerate(regions) for i in r.members}
    now, original = list(taken), set(taken)
    for _ in range(most):
        value = {}
        for i, k in owner.items():
            if i not in now and gain[i] > 0:
                own = [j for j in now if owner.get(j) == k]
                value[i] = gain[i] * np.sqrt(max(0.0, 1 - (sim[i, own].max() if own else 0.0)))
        if not value or max(value.values()) <= 0:
            break
        add = min(value, key=lambda i: (-value[i], i))
        loss = {}
        for k, r in enumerate(regions):
            own = [j for j in now if owner.get(j) == k]
            if own:
                loss |= {j: x for j, x in zip(own, removal_losses(r.references, own, sim, r.weight), strict=True) if j in original and j not in protected}
        if not loss:
            break
        now.remove(min(loss, key=lambda j: (loss[j], -j)))
        now.append(add)
    return sorted(now)


def seed_bundles(anchors: Sequence[int], seeds: Sequence[int], scores: np.ndarray, sim: np.ndarray, times: np.ndarray, refs: np.ndarray, budget: int, reach: float) -> list[int]:
    """Singles, pairs and triples around seeds by gain of coverage and of pair completion for each new row."""
    edges: dict[tuple[int, int], float] = {}
    top = max((scores[s] for s in seeds), default=0.0) or 1.0
    partners: dict[int, list[int]] = {}
    for s in seeds:
        for side in (-1, 1):
            at = np.flatnonzero((np.sign(times - times[s]) == side) & (np.abs(times - times[s]) <= reach))
            if len(at):
                q = sim[s, at] * np.sqrt(1 - sim[s, at])
                p = int(at[np.argmax(q)])
                key = (min(s, p), max(s, p))
                edges[key] = edges.get(key, 0.0) + scores[s] / top * float(q.max())
                partners.setdefault(s, []).append(p)
    total = sum(edges.values()) or 1.0
    taken = list(dict.fromkeys(anchors))
    while len(taken) < min(budget, len(scores)):
        covered = sim[np.ix_(refs, taken)].max(1) if taken else np.zeros(len(refs))
        open_pairs = {e: w / total for e, w in edges.items() if not (e[0] in taken and e[1] in taken)}
        left_c, left_p = float((1 - covered).mean()) or 1.0, sum(open_pairs.values()) or 1.0
        groups = [(i,) for i in range(len(scores))] + [tuple(sorted({s, *c})) for s, ps in partners.items() for c in ([p] for p in ps)] + [tuple(sorted({s, *ps})) for s, ps in partners.items() if len(ps) > 1]
        best = None
        for g in dict.fromkeys(groups):
            new = [i for i in g if i not in taken]
            if not new or len(taken) + len(new) > budget:
                continue
            gain = float((np.maximum(covered, sim[np.ix_(refs, new)].max(1)) - covered).mean()) / left_c
            now = {*taken, *new}
            gain += sum(w for e, w in open_pairs.items() if e[0] in now and e[1] in now) / left_p
            key = (-gain / len(new), len(new), new)
            if best is None or key < best:
                best = key
        if best is None:
            break
        taken += best[2]
    return sorted(taken)


def mixture(first: Sequence[tuple[int, int]], second: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """k rows of the union of two ordered sets of (time, index), each of mass 1, whose mass centres lie nearest to (j + 1/2) / k in all."""
    k = min(k, len({*first, *second}))
    rows = sorted({*first, *second})
    unit = 2 * max(1, len(first)) * max(1, len(second))  # masses as whole numbers over 2 * unit
    mass = [(unit // len(first) if r in set(first) else 0) + (unit // len(second) if r in set(second) else 0) for r in rows]
    total, seen, centre = sum(mass), 0, []
    for m in mass:
        centre.append(2 * seen + m)  # over 2 * total
        seen += m
    cost = lambda i, j: abs(centre[i] * k - (2 * j + 1) * total)
    best: list[dict[int, tuple[int, tuple[int, ...]]]] = [{-1: (0, ())}]
    for j in range(k):
        step, low = {}, None
        for i in range(len(rows)):
            if i - 1 in best[-1] and (low is None or best[-1][i - 1] < low):
                low = best[-1][i - 1]
            if low is not None:
                step[i] = (low[0] + cost(i, j), (*low[1], i))
        best.append(step)
    return [rows[i] for i in min(best[-1].values())[1]] if k else []


def ordered_pairs(order: Sequence[int], owner: dict[int, int], reps: set[int], sim: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint pairs of a representative with the row before or after it (same owner, no representative), of the largest total similarity."""
    best: list[tuple[float, list[tuple[int, int]]]] = [(0.0, []), (0.0, [])]
    for a, b in zip(order[:-1], order[1:], strict=True):
        fits = owner.get(a) == owner.get(b) and (a in reps) != (b in reps)
        with_it = (best[-2][0] + float(sim[a, b]), [*best[-2][1], (a, b)]) if fits else (-1.0, [])
        best.append(max(best[-1], with_it, key=lambda x: x[0]))
    return best[-1][1]


def similarity_runs(times: np.ndarray, cos: np.ndarray, gap: float = 1.0, least: float = 0.95) -> np.ndarray:
    """Run of each row: it joins the run before if near in time and similar to all of its rows."""
    out, members = np.zeros(len(times), np.int64), []
    for i in range(len(times)):
        if members and times[i] - times[i - 1] <= gap and (cos[i, members] >= least).all():
            members.append(i)
        else:
            members = [i]
        out[i] = out[i - 1] + (members == [i]) if i else 0
    return out


DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def coarsest_detail(x: np.ndarray, levels: int) -> np.ndarray:
    """The signal that the coarsest detail band of a wavelet transform (eight taps, symmetric ends) makes, at the length of x."""
    low, high = DB4, DB4[::-1] * np.array([-1, 1] * 4)
    n, sizes, a, d = len(DB4), [], np.asarray(x, float), None
    for _ in range(levels):
        sizes.append(len(a))
        p = np.pad(a, n - 1, mode="symmetric")
        d, a = (np.convolve(p, f, "valid")[1::2] for f in (high, low))
    for k, size in enumerate(reversed(sizes)):
        f = (high if k == 0 else low)[::-1]
        up = np.zeros(2 * len(d))
        up[::2] = d
        d = np.convolve(up, f)[n - 2 : n - 2 + size]
    return d


def local_peaks(x: np.ndarray, height: float, distance: int, prominence: float) -> list[int]:
    """Peaks (middles of plateaus) of this height, then the higher of any two nearer than distance, then those that stand out by prominence from the higher of the lowest points towards higher ground."""
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    tops = [(int(a + b - 1) // 2) for a, b in zip(edge[:-1], edge[1:], strict=True) if 0 < a and b < len(x) and x[a - 1] < x[a] > x[b]]
    kept: list[int] = []
    for i in sorted((i for i in tops if x[i] >= height), key=lambda i: (-x[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)

    def stands_out(i: int) -> bool:
        above = np.flatnonzero(x > x[i])
        left, right = above[above < i], above[above > i]
        low = x[(left[-1] + 1 if len(left) else 0) : i + 1].min(), x[i : right[0] if len(right) else len(x)].min()
        return x[i] - max(low) >= prominence

    return sorted(i for i in kept if stands_out(i))


def wavelet_segments(scores: np.ndarray, drift: float = 3, height: float = 0.5, prominence: float = 0.05, share: float = 0.02, least: int = 5) -> list[int]:
    """Inner boundaries of segments: peaks of the absolute coarsest detail, of mean + height * standard deviation or more, prominence of its range, apart by least rows or this share of all.

    The level is log2 of the rows less drift, within 1 and what the filter's length allows.
    """
    n = len(scores)
    most = int(np.log2(n / (len(DB4) - 1))) if n >= len(DB4) - 1 else 0
    level = 1 if most <= 1 else int(np.clip(np.floor(np.log2(n) - drift), 1, most))
    x = np.abs(coarsest_detail(scores, level))
    return [i for i in local_peaks(x, x.mean() + height * x.std(), max(least, int(n * share)), prominence * np.ptp(x)) if 0 < i < n]


def grouped(df: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str]) -> DataFrame:
    """kernel over each group in key order; one shuffle, by the group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(rows.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def select_by_regions(df: DataFrame, question: str, budget: int, variant: str = "coverage", region: str = "region", score: str = "score", vec: str = "vec", item: str = "item", seeds: int = 16, core: str | None = None) -> DataFrame:
    """Chosen items of each question in key order with their region and step.

    df: question, item, region, score, vec, weight (of the region). variant: a name of COMPETITIONS, two_pass, coverage,
    relevance_coverage, equal_coverage, optional_coverage, facility or core_anchor: relevance_coverage where the best seed of each core (a column) of a region is kept.
    """
    kind = df.schema[question].dataType.simpleString()

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x, r = unit_rows(np.stack(rows[vec].to_list())), rows[score].to_numpy(float)
        sim, of = stepped(clipped_cosines(x)), rows[region].to_numpy()
        top = np.argsort(-r, kind="stable")[:seeds]
        regions = []
        for k in sorted(set(of[top])):
            m = np.flatnonzero(of == k)
            own = [i for i in top if of[i] == k]
            regions.append(Region(m, m, int(own[0]), float(rows["weight"].to_numpy()[m[0]])))
        n = min(budget, sum(len(g.members) for g in regions))
        if len(regions) > n:
            raise ValueError("more regions than the budget")
        gain = np.zeros(len(r))
        for g in regions:
            own = np.array([i for i in top if of[i] == of[g.anchor]])
            gain[g.members] = support(r, own, sim)[g.members]
        if variant in COMPETITIONS:
            taken = sorted(i for t in compete(regions, gain, sim, n, *COMPETITIONS[variant]) for i in t)
        elif variant == "core_anchor":
            of_core = rows[core].to_numpy()
            starts = [[g_[0] for g_ in by.values()] for g in regions for by in [_by_core([int(i) for i in top if of[i] == of[g.anchor]], of_core)]]
            taken = core_anchor_select(regions, starts, gain, sim, n, r)
        elif variant == "two_pass":
            taken = two_pass(regions, gain, sim, n)
        else:
            taken, _, _ = coverage_select(regions, gain, sim, n, r if variant == "relevance_coverage" else None, 0 if variant == "optional_coverage" else 1, variant == "equal_coverage", variant == "facility")
        return pd.DataFrame({question: [rows[question].iloc[0]] * len(taken), item: rows[item].to_numpy()[taken], region: of[taken], "step": np.arange(1, len(taken) + 1)})

    return grouped(df, [question], kernel, f"{question} {kind}, {item} long, {region} {df.schema[region].dataType.simpleString()}, step int", [item])


def temporal_similarity(t: np.ndarray, span: float | None = None) -> np.ndarray:
    """1 - (dt / span) ^ 2, all ones where there is no span."""
    span = float(np.ptp(t)) if span is None else span
    return np.ones((len(t), len(t))) if span == 0 else 1 - ((t[:, None] - t[None, :]) / span) ** 2


def visual_temporal(sim: np.ndarray, t: np.ndarray, scale: float = 4.0) -> np.ndarray:
    """Similarity that fades with distance in time."""
    return sim * np.exp(-np.abs(t[:, None] - t[None, :]) / scale)


def text_state(sim: np.ndarray, tokens: Sequence[frozenset[str]]) -> np.ndarray:
    """sim[i, j] times the Jaccard similarity of the token sets of i and j; as it is where i has no tokens."""
    out = sim.copy()
    for i, a in enumerate(tokens):
        if a:
            out[i] *= [len(a & b) / len(a | b) for b in tokens]
    return out


def literal_redundancy(nearness: np.ndarray, groups: Sequence[frozenset[str]], taken: Sequence[int]) -> np.ndarray:
    """Nearness less the share of a row's groups that no taken row has shown."""
    seen = frozenset().union(*(groups[i] for i in taken)) if taken else frozenset()
    return np.array([d * (1 - len(g - seen) / len(g)) if g else d for d, g in zip(nearness, groups, strict=True)])


def literal_prefix(region: Region, gain: np.ndarray, sim: np.ndarray, groups: Sequence[frozenset], k: int) -> list[int]:
    """Members in greedy order from the anchor by gain * sqrt(1 - nearness), which fades with what a row's groups show anew."""
    m, taken = region.members, [region.anchor]
    near, open_ = sim[m, region.anchor].copy(), m != region.anchor
    while len(taken) < min(k, len(m)):
        d = literal_redundancy(near, [groups[i] for i in m], [int(np.flatnonzero(m == i)[0]) for i in taken])
        i = first_best(gain[m] * np.sqrt(np.maximum(0.0, 1 - d)), open_)
        if i < 0:
            break
        taken.append(int(m[i]))
        open_[i] = False
        near = np.maximum(near, sim[m, m[i]])
    return taken


def local_query_coverage(region: Region, views: np.ndarray, gain: np.ndarray, sim: np.ndarray, k: int, steps: int = 4) -> list[int]:
    """At most steps members that raise the sum of best strict ranks over query views (rows) most, then the visual rule.

    Ranks are of the region's members: how many score strictly lower in a view.
    """
    m = region.members
    ranks = np.array([[(v[m] < x).sum() for x in v[m]] for v in views])
    at = {int(i): j for j, i in enumerate(m)}
    taken, best = [region.anchor], ranks[:, at[region.anchor]].copy()
    while len(taken) < min(k, len(m)) and len(taken) <= steps:
        rise = np.maximum(0, ranks - best[:, None]).sum(0).astype(float)
        open_ = ~np.isin(m, taken)
        if not open_.any() or rise[open_].max() <= 0:
            break
        j = min(np.flatnonzero(open_), key=lambda j: (-rise[j], -gain[m[j]], j))
        taken.append(int(m[j]))
        best = np.maximum(best, ranks[:, j])
    return prefix(region, gain, sim, k, start=taken)


def boundary_exchange(times: np.ndarray, scores: np.ndarray, k: int = 16, most: int = 4, gap: float = 1.0) -> list[int]:
    """The k best rows in runs of times no more than gap apart; up to most of the lowest inner rows give way to the nearest rows just outside runs.

    The first, last and best row of a run are protected; runs take turns by their best score.
    """
    top = sorted(np.argsort(-scores, kind="stable")[:k].tolist())
    runs: list[list[int]] = []
    for i in top:
        if runs and times[i] - times[runs[-1][-1]] <= gap:
            runs[-1].append(i)
        else:
            runs.append([i])
    keep = {x for r in runs for x in (r[0], r[-1], max(r, key=lambda i: (scores[i], -i)))}
    inner = sorted((i for i in top if i not in keep), key=lambda i: (scores[i], i))[:most]
    now = set(top)
    for r in sorted(runs, key=lambda r: (-max(scores[i] for i in r), r[0])):
        for edge, side in ((r[0], -1), (r[-1], 1)):
            near = [i for i in range(len(times)) if i not in now and np.sign(i - edge) == side and 0 < abs(times[i] - times[edge]) <= gap]
            if near and inner:
                now.remove(inner.pop(0))
                now.add(min(near, key=lambda i: (abs(times[i] - times[edge]), i)))
    return sorted(now)


def low_loss_swap(refs: np.ndarray, taken: Sequence[int], add: int | None, sim: np.ndarray, protected: set[int], prefer: int | None = None, band: float = 1e-6) -> list[int]:
    """add (if any) comes in, the unprotected row of the least coverage loss goes; within the band the preferred one."""
    now = list(taken) if add is None else [*taken, add]
    loss = dict(zip(now, removal_losses(refs, now, sim), strict=True))
    free = {i: x for i, x in loss.items() if i not in protected and i != add}
    if not free:
        return sorted(taken)
    low = min(free.values())
    out = prefer if prefer in free and free[prefer] <= low + band else min(free, key=lambda i: (free[i], i))
    now.remove(out)
    return sorted(now)


def longest_common(a: Sequence[int], b: Sequence[int], most: int = 6) -> int:
    """Length of the longest common subsequence of two lists of 64-bit hashes that match within most bits."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            up = best[j]
            best[j] = before + 1 if bin((x ^ y) & (2**64 - 1)).count("1") <= most else max(up, best[j - 1])
            before = up
    return best[-1]


def without(regions: Sequence[Region], banned: set[int], scores: np.ndarray) -> list[Region]:
    """Regions that may not choose banned rows, which stay references; a banned anchor gives way to the best row left."""
    out = []
    for r in regions:
        m = np.array([i for i in r.members if i not in banned], np.int64)
        if len(m):
            out.append(Region(m, r.references, r.anchor if r.anchor not in banned else int(m[np.argmax(scores[m])]), r.weight))
    return out


def hotspots(segment: np.ndarray, taken: Sequence[int], scores: np.ndarray, times: np.ndarray, sim: np.ndarray, duration: float, reach: float = 2.0, percentile: float = 75.0, most: int = 2) -> list[tuple[int, float, float, str]]:
    """Of each segment with picks: its best pick, the window round it, and why the window is refined or not.

    A window's priority is the pick's score times what its rows score and no pick inside covers; windows that touch an accepted one are refused.
    """
    bar, found, out = np.percentile(scores, percentile), [], []
    for s in sorted({int(segment[i]) for i in taken}):
        own = [i for i in taken if segment[i] == s]
        h = max(own, key=lambda i: (scores[i], -i))
        left, right = max(0.0, times[h] - reach), min(duration, times[h] + reach)
        if scores[h] < bar:
            out.append((h, left, right, "below_percentile"))
            continue
        inside = np.flatnonzero((times >= left) & (times <= right))
        picks = [i for i in taken if left <= times[i] <= right]
        rest = float((scores[inside] * (1 - sim[np.ix_(inside, picks)].max(1))).mean())
        if rest <= 0:
            out.append((h, left, right, "already_covered"))
        else:
            found.append((-scores[h] * rest, h, left, right))
    kept: list[tuple[float, float]] = []
    for _, h, left, right in sorted(found):
        if any(left <= b and a <= right for a, b in kept):
            out.append((h, left, right, "overlap"))
        elif len(kept) == most:
            out.append((h, left, right, "hotspot_limit"))
        else:
            kept.append((left, right))
            out.append((h, left, right, "selected"))
    return out


def reselect(segment: np.ndarray, taken: Sequence[int], gain: np.ndarray, sim: np.ndarray, changed: set[int], fixed: set[int] = frozenset()) -> list[int]:
    """Segments that got new rows are chosen anew at their numbers, by gain * sqrt(1 - d); fixed rows stay and count as taken."""
    out = [i for i in taken if int(segment[i]) not in changed or i in fixed]
    for s in sorted(changed):
        n = sum(int(segment[i]) == s for i in taken)
        now, rows = [i for i in out if segment[i] == s], np.flatnonzero(segment == s)
        while len(now) < n:
            near = sim[np.ix_(rows, now)].max(1) if now else np.zeros(len(rows))
            i = first_best(gain[rows] * np.sqrt(np.maximum(0.0, 1 - near)), ~np.isin(rows, now))
            if i < 0:
                break
            now.append(int(rows[i]))
        out = [i for i in out if segment[i] != s] + now
    return sorted(out)


def relevance_in_regions(regions: Sequence[Region], quotas: Sequence[int], scores: np.ndarray, cos: np.ndarray, lam: float = 0.5) -> list[int]:
    """Maximal marginal relevance within each region to its quota, from its anchor."""
    out = []
    for r, q in zip(regions, quotas, strict=True):
        m = r.members
        first = int(np.flatnonzero(m == r.anchor)[0])
        out += [int(m[i]) for i in marginal_relevance(scores[m], cos[np.ix_(m, m)], q, lam, first)]
    return sorted(out)


def both_sides(regions: Sequence[Region], taken: Sequence[int], gain: np.ndarray, sim: np.ndarray, least: int = 3, most: int = 2) -> list[int]:
    """In regions with least picks or more, all on one side of the anchor, the pick of the least coverage loss gives way to the best row on the other side."""
    now, swaps = list(taken), 0
    for r in regions:
        own = [i for i in now if i in set(r.members.tolist())]
        if len(own) < least or swaps == most:
            continue
        before, after = [i for i in own if i < r.anchor], [i for i in own if i > r.anchor]
        missing = [i for i in r.members if (i < r.anchor if not before else i > r.anchor) and i not in now] if not before or not after else []
        if not missing:
            continue
        loss = dict(zip(own, removal_losses(r.references, own, sim), strict=True))
        out = min((i for i in own if i != r.anchor), key=lambda i: (loss[i], -i))
        rest = [i for i in own if i != out]
        add = max(missing, key=lambda i: (gain[i] * np.sqrt(max(0.0, 1 - sim[i, rest].max())), -i))
        now[now.index(out)] = int(add)
        swaps += 1
    return sorted(now)


def last_slot_swap(orders: Sequence[Sequence[int]], quotas: Sequence[int], value: np.ndarray) -> list[int]:
    """The selection by quotas, with the one change of a region's last pick for its next row that raises value most, if any does."""
    best: tuple[float, int] | None = None
    for k, (o, q) in enumerate(zip(orders, quotas, strict=True)):
        if 1 < q < len(o) and (rise := float(value[o[q]] - value[o[q - 1]])) > 0 and (best is None or rise > best[0]):
            best = (rise, k)
    out = []
    for k, (o, q) in enumerate(zip(orders, quotas, strict=True)):
        out += [*o[: q - 1], o[q]] if best and k == best[1] else list(o[:q])
    return sorted(out)


def layout_change(a: Sequence[tuple[tuple[float, float, float, float], str]], b: Sequence[tuple[tuple[float, float, float, float], str]]) -> float:
    """Over boxes that are each other's only best overlap, the largest overlap times normalised edit distance; 0 if a side is empty."""

    def overlap(x, y):
        w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
        inter = max(0.0, w) * max(0.0, h)
        area = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - inter
        return inter / area if area > 0 else 0.0

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1] / max(len(x), len(y), 1)

    if not a or not b:
        return 0.0
    m = np.array([[overlap(x, y) for y, _ in b] for x, _ in a])
    best = 0.0
    for i in range(len(a)):
        j = int(m[i].argmax())
        v = m[i, j]
        if v > 0 and (m[i] == v).sum() == 1 and m[:, j].max() == v and (m[:, j] == v).sum() == 1:
            best = max(best, v * edits(a[i][1], b[j][1]))
    return best
