from __future__ import annotations

import itertools

import numpy as np
import pytest

from keelson.operators import selection as S


def brute(curves, weights, budget, least=1):
    best = None
    for alloc in itertools.product(*(range(least, len(c)) for c in curves)):
        if sum(alloc) == budget:
            value = 0.0
            for c, w, n in zip(curves, weights, alloc, strict=True):
                value += w * c[n]
            best = max(best, (value, alloc)) if best else (value, alloc)
    return best


def test_allocation_equals_enumeration_and_ties_go_to_earlier_regions():
    curves = [np.array([0, 0.5, 0.51, 0.95]), np.array([0, 0.4, 0.6, 0.7]), np.array([0, 0.6, 0.7, 0.71])]
    value, alloc = S.allocate(curves, [3, 2, 1], 6)
    assert alloc == (3, 2, 1) and value == pytest.approx(4.65)
    assert S.allocate([np.array([0, 1, 1, 1])] * 2, [1, 1], 4)[1] == (3, 1)
    rng = np.random.default_rng(3)
    for _ in range(30):
        curves = [np.append(0, np.sort(rng.random(4))) for _ in range(3)]
        weights, least = rng.random(3) + 0.1, int(rng.integers(0, 2))
        assert S.allocate(curves, weights, 7, least) == brute(curves, weights, 7, least)


@pytest.mark.parametrize("curves,weights,budget", [([np.array([0, 0.5, 0.4])], [1], 1), ([np.array([0, 0.5])], [0], 1), ([np.array([0, 0.5])] * 2, [1, 1], 1), ([np.array([0, np.nan])], [1], 1)])
def test_bad_curves_are_rejected(curves, weights, budget):
    with pytest.raises(ValueError):
        S.allocate(curves, weights, budget)


def group(seed, n=31, regions=3):
    rng = np.random.default_rng(seed)
    sim = S.clipped_cosines(S.unit_rows(rng.normal(size=(n, 8))))
    of, r = np.sort(rng.integers(0, regions, n)), rng.random(n)
    rs = [S.Region(m, m, int(m[np.argmax(r[m])]), 1.0 + k) for k in range(regions) if len(m := np.flatnonzero(of == k))]
    return rs, r, sim


def test_prefix_is_greedy_by_full_recomputation():
    for seed in range(5):
        rs, r, sim = group(seed)
        for reg in rs:
            got, want = S.prefix(reg, r, sim, 8), [reg.anchor]
            while len(want) < min(8, len(reg.members)):
                rest = [i for i in reg.members if i not in want]
                want.append(int(max(rest, key=lambda i: (r[i] * np.sqrt(max(0.0, 1 - sim[i, want].max())), -i))))
            assert got == want


def test_selections_hold_anchors_and_fill_the_budget():
    for seed in range(5):
        rs, r, sim = group(seed)
        for scores in (None, r):
            taken, alloc, _ = S.coverage_select(rs, r, sim, 9, scores)
            assert len(taken) == sum(alloc) == 9 and {g.anchor for g in rs} <= set(taken) and taken == sorted(taken)
        for local, priority in S.COMPETITIONS.values():
            assert sum(map(len, S.compete(rs, r, sim, 9, local, priority))) == 9
        assert len(S.two_pass(rs, r, sim, 9)) == 9


def test_equal_vectors_fill_with_the_earliest_rows():
    sim = np.ones((6, 6))
    assert S.prefix(S.Region(np.arange(6), np.arange(6), 2), np.ones(6), sim, 4) == [2, 0, 1, 3]


def test_mixture_costs_as_little_as_any_choice_and_does_not_depend_on_order():
    a, b, k = [(0, 0), (4, 1), (8, 2)], [(2, 3), (5, 4), (7, 5)], 3
    got = S.mixture(a, b, k)
    rows = sorted({*a, *b})
    centre, seen = {}, 0.0
    for row in rows:
        mass = 0.5 / 3 * ((row in a) + (row in b))
        centre[row], seen = seen + mass / 2, seen + mass
    cost = lambda rows: sum(abs(centre[x] - (j + 0.5) / k) for j, x in enumerate(rows))
    assert cost(got) == pytest.approx(min(cost(c) for c in itertools.combinations(rows, k)))
    assert got == S.mixture(b, a, k)
    assert S.mixture(a, a, 5) == a


def test_exchange_and_losses_equal_enumeration():
    rs, r, sim = group(7)
    refs, taken = np.arange(31), [0, 5, 9, 20]
    losses = S.removal_losses(refs, taken, sim)
    for k, t in enumerate(taken):
        rest = [x for x in taken if x != t]
        assert losses[k] == pytest.approx(sim[np.ix_(refs, taken)].max(1).mean() - sim[np.ix_(refs, rest)].max(1).mean())
    gain, removed, added = S.best_exchange(refs, taken, [1, 2, 3], sim)
    options = [sim[np.ix_(refs, [x for x in taken if x != o] + [a])].max(1).mean() for o in taken for a in (1, 2, 3)]
    assert gain == pytest.approx(max(options) - sim[np.ix_(refs, taken)].max(1).mean())


def test_supplement_and_bundles_keep_the_budget():
    rs, r, sim = group(11)
    start, _, _ = S.coverage_select(rs, r, sim, 9)
    out = S.bounded_supplement(rs, start, r, sim, {g.anchor for g in rs})
    assert len(out) == 9 and {g.anchor for g in rs} <= set(out)
    b = S.seed_bundles([g.anchor for g in rs], [3, 8, 15], r, sim, np.arange(31.0), np.arange(31), 9, 4.0)
    assert len(b) <= 9 and len(set(b)) == len(b)


def test_segment_competition_rejects_short_pools_and_runs_join_alike_rows():
    with pytest.raises(ValueError):
        S.segment_competition(np.zeros(2, int), np.ones(2), np.ones((2, 2)), 3)
    assert S.similarity_runs(np.array([0, 1, 2, 5]), np.ones((4, 4))).tolist() == [0, 0, 0, 1]
    assert len(S.coarsest_detail(np.arange(37.0), 2)) == 37
    assert S.ordered_pairs([0, 1, 2, 3], dict.fromkeys(range(4), 0), {1, 2}, np.ones((4, 4))) == [(0, 1), (2, 3)]


def test_more_kernels():
    rs, r, sim = group(13)
    reg = rs[0]
    views = np.stack([r, r[::-1]])
    got = S.local_query_coverage(reg, views, r, sim, 6)
    assert got[0] == reg.anchor and len(set(got)) == len(got) == min(6, len(reg.members))
    ranks = np.array([[(v[reg.members] < x).sum() for x in v[reg.members]] for v in views])
    start = ranks[:, list(reg.members).index(reg.anchor)]
    rise = np.maximum(0, ranks - start[:, None]).sum(0)
    if rise.max() > 0:
        assert rise[list(reg.members).index(got[1])] == rise.max()
    out = S.low_loss_swap(np.arange(31), [0, 4, 9], 12, sim, {0})
    assert len(out) == 3 and {0, 12} <= set(out)
    times, scores = np.arange(30.0), np.linspace(0, 1, 30)
    b = S.boundary_exchange(times, scores)
    assert len(b) == 16 and 29 in b and 13 in b
    assert S.longest_common([1, 2, 3], [1, 9, 3], 0) == 2
    assert S.temporal_similarity(np.zeros(3)).min() == 1 and S.temporal_similarity(np.array([0.0, 4.0]))[0, 1] == 0
    t = S.text_state(np.ones((2, 2)), [frozenset("ab"), frozenset("b")])
    assert t[0, 1] == 0.5 and S.text_state(np.ones((2, 2)), [frozenset(), frozenset("b")])[0, 1] == 1
    assert S.literal_redundancy(np.ones(2), [frozenset("ab"), frozenset()], [0])[0] == 1
    assert np.allclose(np.diag(S.visual_temporal(sim, times[: len(sim)] if len(times) >= len(sim) else np.arange(float(len(sim))))), np.diag(sim))


def test_refinement_kernels():
    rs, r, sim = group(19)
    segment = np.zeros(31, int)
    for k, g in enumerate(rs):
        segment[g.members] = k
    taken = S.segment_competition(segment, r, sim, 9)
    h = S.hotspots(segment, taken, r, np.arange(31.0), sim, 31.0)
    assert {x[3] for x in h} <= {"below_percentile", "already_covered", "overlap", "hotspot_limit", "selected"} and sum(x[3] == "selected" for x in h) <= 2
    again = S.reselect(segment, taken, r, sim, {0})
    assert len(again) == 9 and {i for i in again if segment[i]} == {i for i in taken if segment[i]}
    picks = S.relevance_in_regions(rs, [3] * len(rs), r, sim)
    assert {g.anchor for g in rs} <= set(picks) and len(picks) == sum(min(3, len(g.members)) for g in rs)
    m = rs[0].members
    one = S.Region(m, m, int(m[len(m) // 2]))
    side = S.both_sides([one], [int(i) for i in m[len(m) // 2 : len(m) // 2 + 3]], r, sim)
    assert min(side) < one.anchor and max(side) > one.anchor and len(side) == 3
    assert S.last_slot_swap([[0, 1, 2], [5, 6]], [2, 2], np.array([0, 0.1, 0.9, 0, 0, 0, 0])) == [0, 2, 5, 6]
    cut = S.without(rs, {rs[0].anchor}, r)
    assert rs[0].anchor not in cut[0].members and rs[0].anchor in cut[0].references and cut[0].anchor in cut[0].members
    assert S.layout_change([((0, 0, 2, 2), "abcd")], [((0, 0, 2, 2), "abcx"), ((9, 9, 10, 10), "q")]) == 0.25
    assert S.layout_change([((0, 0, 2, 2), "a")], [((0, 0, 2, 2), "b"), ((0, 0, 2, 2), "c")]) == 0 == S.layout_change([], [((0, 0, 1, 1), "a")])


def test_peaks_by_their_definition():
    rng = np.random.default_rng(9)
    for _ in range(200):
        x = rng.integers(0, 8, int(rng.integers(3, 40))).astype(float)
        height, distance, prominence = float(rng.integers(0, 5)), int(rng.integers(1, 5)), float(rng.integers(0, 4))
        tops = []
        for i in range(1, len(x) - 1):
            a, b = i, i
            while a > 0 and x[a - 1] == x[i]:
                a -= 1
            while b < len(x) - 1 and x[b + 1] == x[i]:
                b += 1
            if a > 0 and b < len(x) - 1 and x[a - 1] < x[i] > x[b + 1] and i == (a + b) // 2 and x[i] >= height:
                tops.append(i)
        kept = []
        for i in sorted(tops, key=lambda i: (x[i], i), reverse=True):
            if all(abs(i - j) >= distance for j in kept):
                kept.append(i)
        want = []
        for i in sorted(kept):
            bases = []
            for side in (range(i, -1, -1), range(i, len(x))):
                low = x[i]
                for j in side:
                    if x[j] > x[i]:
                        break
                    low = min(low, x[j])
                bases.append(low)
            if x[i] - max(bases) >= prominence:
                want.append(i)
        assert S.local_peaks(x, height, distance, prominence) == want


def test_segments_of_a_step_open_at_it():
    step = np.concatenate([np.full(64, 0.2), np.full(64, 0.9)])
    cuts = S.wavelet_segments(step)
    assert cuts and min(abs(c - 64) for c in cuts) <= 8 and all(b - a >= 5 for a, b in zip(cuts, cuts[1:]))
    assert S.wavelet_segments(np.zeros(40)) == [] and S.wavelet_segments(np.array([0.1])) == []


def test_detail_and_approximation_make_the_signal():
    x = np.random.default_rng(10).random(37)
    low, n = S.DB4, len(S.DB4)
    a = np.convolve(np.pad(x, n - 1, mode="symmetric"), low, "valid")[1::2]
    up = np.zeros(2 * len(a))
    up[::2] = a
    assert np.allclose(np.convolve(up, low[::-1])[n - 2 : n - 2 + len(x)] + S.coarsest_detail(x, 1), x)
