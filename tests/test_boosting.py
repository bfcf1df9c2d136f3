"""Histogram boosting: splits against all splits, shared passes against separate fits, stopping, rules, quantiles."""

import math
import pickle

import numpy as np
import pytest

from tabscout.operators import boosting as B

PARAMS = B.Params(max_depth=3, learning_rate=0.3, n_estimators=6, max_bins=16)


def sample(n=1200, seed=1):
    """x0 number with gaps that mean something, x1 number, x2 category of 6, x3 category of 2."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 6, n), rng.integers(0, 2, n)]).astype(float)
    y = np.where(x[:, 0] > 6, 4.0, 0) + np.where(np.isin(x[:, 2], [1, 4]), 3.0, 0) + 0.3 * x[:, 1] + rng.standard_normal(n) * 0.5
    gap = rng.random(n) < 0.15
    y[gap] += 6
    x[gap, 0] = np.nan
    x[rng.random(n) < 0.05, 2] = np.nan
    return x, y


BINS = B.Bins((np.arange(11.0), np.arange(8.0), None, None), (0, 0, 6, 2))


def blocks(spark, x, y, roles=None, parts=3):
    sc = spark.sparkContext
    size = len(y)
    roles = np.ones(size, dtype=np.int64) if roles is None else roles
    held = [B.Block(BINS.codes(x[i]), y[i], np.ones(len(i)), roles[i], i.astype(np.int64)) for i in np.array_split(np.arange(size), parts)]
    return sc.parallelize(held, parts)


def margins(fit, x):
    return fit.forest(BINS).predict(x)


def same(a, b):
    return len(a.rounds) == len(b.rounds) and all(
        s.slot == t.slot and np.allclose(s.value, t.value) for p, q in zip(a.rounds, b.rounds) for s, t in zip(p, q))


def squared_plan(**more):
    return B.Plan(more.pop("params", PARAMS), "squared", more.pop("rows", 0), start=(3.0,), **more)


def brute_split(x, g, h, params):
    """The best gain over every threshold, every set of categories and both sides for missing values."""
    score = lambda a, b: max(abs(a) - params.reg_alpha, 0) ** 2 / (b + params.reg_lambda)
    best = 0.0
    for slot in range(x.shape[1]):
        v = x[:, slot]
        known = sorted(set(v[~np.isnan(v)]))
        sets = [set(known[: k + 1]) for k in range(len(known))] if slot < 2 else [{c for i, c in enumerate(known) if bits >> i & 1} for bits in range(1, 2 ** len(known))]
        for inside in sets:
            for missing in (False, True):
                left = np.isin(v, list(inside)) | (np.isnan(v) & missing)
                if left.any() and not left.all() and h[left].sum() >= params.min_child and h[~left].sum() >= params.min_child:
                    best = max(best, score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum()))
    return best


@pytest.mark.parametrize("params", [PARAMS, B.Params(reg_alpha=3.0, reg_lambda=5.0, min_child=40)])
def test_first_split_is_the_best_of_all(params):
    x, y = sample(300)
    g, h = 3.0 - y, np.ones(len(y))
    codes = BINS.codes(x)
    sums = np.stack([[np.bincount(c, w, BINS.width) for c in codes] for w in (g, h)])
    ((weight, cover, split),) = B.Search(params, BINS, (0, 1, 2, 3), {}).best(sums[None], np.array([[-math.inf, math.inf]]))
    assert cover == 300 and math.isclose(split.gain, brute_split(x, g, h, params), rel_tol=1e-9)
    pulled = math.copysign(max(abs(g.sum()) - params.reg_alpha, 0), g.sum())
    assert math.isclose(weight, -pulled / (300 + params.reg_lambda))


def test_codes_and_values_lead_to_the_same_ends(spark):
    x, y = sample()
    (fit,) = B.boost(blocks(spark, x, y), [squared_plan()], BINS)
    by_codes = 3.0 + sum(t.paths.margin(BINS.codes(x)) for (t,) in fit.rounds)
    assert np.allclose(margins(fit, x)[:, 0], by_codes)
    tree = fit.forest(BINS).trees[0]
    assert tree.categories and len(fit.rounds) == 6 and np.mean((margins(fit, x)[:, 0] - y) ** 2) < 0.35 * y.var()


def test_added_up_in_the_driver_or_in_reducers(spark, monkeypatch):
    x, y = sample()
    a = B.boost(blocks(spark, x, y), [squared_plan(), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(5.0,))], BINS)
    monkeypatch.setattr(B, "COLLECTED", 0)
    monkeypatch.setattr(B, "SEARCHED", 1)
    b = B.boost(blocks(spark, x, y), [squared_plan(), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(5.0,))], BINS)
    assert all(same(p, q) for p, q in zip(a, b))


def test_resumed_equals_uninterrupted_and_margins_are_rebuilt(spark, monkeypatch):
    x, y = sample()
    whole = B.boost(blocks(spark, x, y), [squared_plan()], BINS)[0]
    half = B.boost(blocks(spark, x, y), [squared_plan(params=B.Params(max_depth=3, learning_rate=0.3, n_estimators=2))], BINS)
    assert same(whole, B.boost(blocks(spark, x, y), [squared_plan()], BINS, half)[0])
    monkeypatch.setattr(B, "REBUILD", 1)
    assert same(whole, B.boost(blocks(spark, x, y), [squared_plan()], BINS)[0])


def test_folds_in_one_pass_equal_separate_fits(spark):
    x, y = sample()
    roles = sum((np.arange(len(y)) % 4 != k).astype(np.int64) << k for k in range(4))
    plans = [squared_plan(rows=k, params=B.Params(max_depth=2 + k, learning_rate=0.3, n_estimators=3 + k)) for k in range(4)]
    data = blocks(spark, x, y, roles)
    together = B.boost(data, plans, BINS)
    for plan, fit in zip(plans, together):
        assert same(fit, B.boost(data, [plan], BINS)[0]) and len(fit.rounds) == plan.params.n_estimators


def test_patience_keeps_the_least_loss_and_followers_its_rounds(spark):
    rng = np.random.default_rng(3)
    x, y = sample(600)
    y = y + rng.standard_normal(len(y)) * 4
    roles = np.where(np.arange(len(y)) % 3 == 0, 2, 1) + 4
    params = B.Params(max_depth=4, learning_rate=0.5, n_estimators=200)
    leader, follower, capped = B.boost(blocks(spark, x, y, roles), [
        squared_plan(params=params, watched=1), squared_plan(params=params, rows=2, leader=0),
        squared_plan(params=B.Params(max_depth=4, learning_rate=0.5, n_estimators=2), rows=2, leader=0)], BINS, patience=5)
    assert len(leader.losses) == len(leader.rounds) + 5 and leader.losses[len(leader.rounds) - 1] == min(leader.losses)
    assert len(follower.rounds) == len(leader.rounds) and len(capped.rounds) == min(2, len(leader.rounds))
    seen = roles & 2 > 0
    assert math.isclose(math.sqrt(np.mean((margins(leader, x[seen])[:, 0] - y[seen]) ** 2)), min(leader.losses), rel_tol=1e-9)


@pytest.mark.parametrize("rule", [{0: 1, 1: -1}, {0: -1}])
def test_rules_hold_while_growing(spark, rule):
    x, y = sample()
    (fit,) = B.boost(blocks(spark, x, y), [squared_plan(rules=rule, params=B.Params(max_depth=5, learning_rate=0.3, n_estimators=10))], BINS)
    forest = fit.forest(BINS)
    for slot, direction in rule.items():
        grid = np.repeat(x[:80], 12, axis=0)
        grid[:, slot] = np.tile(np.arange(12.0), 80)
        out = forest.predict(grid)[:, 0].reshape(80, 12)
        assert (np.diff(out, axis=1) * direction >= -1e-12).all()
    assert any((t.feature == 0).any() for t in forest.trees) or rule[0] < 0


def test_rules_cost_little_where_they_are_true(spark):
    x, y = sample()
    free, ruled = B.boost(blocks(spark, x, y), [squared_plan(), squared_plan(rules={1: 1})], BINS)
    loss = [np.mean((margins(f, x)[:, 0] - y) ** 2) for f in (free, ruled)]
    assert loss[1] < 1.1 * loss[0]


def test_two_and_more_classes(spark):
    x, y = sample()
    params = B.Params(max_depth=3, learning_rate=0.3, n_estimators=15)
    two = (y > 5).astype(float)
    (fit,) = B.boost(blocks(spark, x, two), [B.Plan(params, "logistic", 0)], BINS)
    assert ((margins(fit, x)[:, 0] > 0) == two).mean() > 0.93
    three = np.digitize(y, [3, 6]).astype(float)
    (fit,) = B.boost(blocks(spark, x, three), [B.Plan(params, "softmax", 0, classes=3, start=(0.0,) * 3)], BINS)
    forest = fit.forest(BINS)
    assert len(forest.trees) == 45 and (forest.predict(x).argmax(axis=1) == three).mean() > 0.9
    for k in range(3):
        assert np.allclose(forest.shap(x[:50], k).sum(axis=1) + forest.bias()[k], forest.predict(x[:50])[:, k])


def test_quantiles_cover_their_share(spark):
    x, y = sample(4000, 5)
    params = B.Params(max_depth=3, learning_rate=0.3, n_estimators=25)
    marks = {s: float(np.quantile(y, s)) for s in (0.1, 0.9)}
    low, high = B.boost(blocks(spark, x, y), [B.Plan(params, "quantile", 0, share=s, start=(m,)) for s, m in marks.items()], BINS)
    fresh, real = sample(4000, 6)
    lower, upper = margins(low, fresh)[:, 0], margins(high, fresh)[:, 0]
    assert 0.76 < ((real >= lower) & (real <= upper)).mean() < 0.84
    gap = np.isnan(fresh[:, 0])
    assert 0.7 < ((real >= lower) & (real <= upper))[gap].mean() < 0.9


def test_samples_of_rows_and_columns():
    key = np.arange(100_000, dtype=np.int64)
    a, b = B.drawn(key, 0.7, 1), B.drawn(key, 0.7, 2)
    assert abs(a.mean() - 0.7) < 0.01 and abs((a & b).mean() - 0.49) < 0.01 and B.drawn(key, 1.0, 1).all()
    plan = squared_plan(params=B.Params(colsample=0.5))
    assert all(len(B._columns(plan, k, 10)) == 5 for k in range(5)) and len({B._columns(plan, k, 10) for k in range(9)}) > 3


def test_summaries_merge():
    rng = np.random.default_rng(2)
    parts = [rng.standard_normal(n) for n in (5000, 20, 3000, 1)]
    held = B.summary(parts[0], np.ones(5000))
    for p in parts[1:]:
        held = B.merged_summary(held, B.summary(p, np.ones(len(p))))
    whole = np.concatenate(parts)
    for share in (0.1, 0.5, 0.9):
        assert abs((whole <= B.quantile_of(held, share)).mean() - share) < 0.01


def test_flat_and_tiny_tables(spark):
    x, y = sample(60)
    (fit,) = B.boost(blocks(spark, x, np.full(60, 2.0)), [squared_plan()], BINS)
    assert np.allclose(margins(fit, x)[:, 0], 3 - (1 - (1 - 0.3 * 60 / 61) ** 6))
    (one,) = B.boost(blocks(spark, x[:1], y[:1], parts=1), [squared_plan()], BINS)
    assert all(len(t.slot) == 1 for (t,) in one.rounds)


def test_growing_blocks_hold_only_what_their_plans_read():
    rng = np.random.default_rng(3)
    bits = np.array([0, 1, 5, 255] * 50)
    block = B.Block(rng.integers(0, 9, (3, 200)).astype(np.uint8), rng.random(200), rng.random(200), bits, np.arange(200))
    plain, weighted, sampled = (B.Plan(B.Params(subsample=share), "squared", 0, weighted=w) for share, w in ((1.0, False), (1.0, True), (0.7, False)))
    held = B.started([plain], [B.Fit(plain)])(block)
    assert held.weight is None and held.key is None and held.roles.dtype == np.uint8 and (held.roles == bits).all()
    held = B.started([plain, weighted, sampled], [B.Fit(p) for p in (plain, weighted, sampled)])(block)
    assert (held.weight == block.weight).all() and (held.key == block.key).all()
    top = B.started([plain], [B.Fit(plain)])(B.Block(block.codes, block.label, block.weight, bits << 20, block.key))
    assert (top.roles == bits << 20).all()


def test_rows_find_the_nodes_of_a_walk():
    """Trees with ends at all depths, one that is its root and one split once, on rows laid out either way."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    left, right = np.array([1, 3, -1, -1, 5, -1, -1]), np.array([2, 4, -1, -1, 6, -1, -1])
    slot, table = np.array([2, 0, 0, 0, 1, 0, 0]), rng.random((7, 9)) < 0.5
    for count, depth in ((1, 0), (3, 1), (7, 3)):
        ends = np.where(left < count, left, -1)[:count], np.where(right < count, right, -1)[:count]
        tree = B.Paths(slot[:count], *ends, table[:count], np.zeros(count), (), depth)
        for rows in (codes, np.asfortranarray(codes), codes[:, :0]):
            found = []
            for row in rows.T:
                at = 0
                while ends[0][at] >= 0:
                    at = ends[0][at] if table[at, row[slot[at]]] else ends[1][at]
                found.append(at)
            assert tree.place(rows).tolist() == found


@pytest.mark.parametrize("kind", ["squared", "logistic", "softmax"])
def test_sums_by_cell_are_those_of_its_rows(kind):
    """Plans that read rows merged or singly, with weights and samples; rows of nobody are left out."""
    x, y = sample(3000)
    y = {"squared": y, "logistic": (y > 5).astype(float), "softmax": np.digitize(y, [3, 6]).astype(float)}[kind]
    rng = np.random.default_rng(8)
    codes, roles, weight, key = BINS.codes(x), np.arange(3000) % 4, rng.random(3000) + 0.5, np.arange(3000)
    start = (0.2, 0.5, 0.4) if kind == "softmax" else (0.7,)
    plans = [B.Plan(B.Params(subsample=share), kind, 0, 1, len(start), weighted=w, start=start) for share, w in ((1.0, False), (0.7, False), (1.0, True))]
    plans.append(B.Plan(PARAMS, "quantile", 0, 1, share=0.9, start=(4.0,)))
    held = [B.Block(codes[:, i], y[i], weight[i], roles[i], key[i]) for i in np.array_split(np.arange(3000), 4)]
    (cells,) = B.folded(plans, BINS.width)(map(B.started(plans, [B.Fit(p) for p in plans]), held))
    own = roles > 0
    known, cell = np.unique(codes[:, own], axis=1, return_inverse=True)
    assert (cells.codes == known).all() and known.shape[1] < own.sum()
    out = B.summed(plans, [0, 1, 2, 3], 5, True)(cells)
    assert out.rows is None
    for m, plan in enumerate(plans):
        margin = np.repeat(np.array(plan.start)[:, None], own.sum(), axis=1)
        used = (roles[own] & 1 > 0) & B.drawn(key[own], plan.params.subsample, 42 * 1_000_003 + 5)
        times = used * (weight[own] if plan.weighted else 1.0)
        for k, (g, h) in enumerate(zip(*plan.gradients(margin, y[own]))):
            for found, values in zip(out.sums[m, k], (g, h)):
                assert np.allclose(found, np.bincount(cell, values * times))
        seen = roles[own] & 2 > 0
        assert np.allclose(out.losses[m], [plan.losses(margin[:, seen], y[own][seen]).sum(), seen.sum()])


def test_what_levels_read_does_not_grow_with_rows_of_equal_codes():
    x, y = sample(400)
    plans = [squared_plan(watched=1), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(4.0,))]
    sizes = []
    for copies in (1, 40):
        rng = np.random.default_rng(copies)
        codes, label = np.tile(BINS.codes(x), copies), np.tile(y, copies) + rng.random(400 * copies)
        block = B.Block(codes, label, np.ones(len(label)), np.tile(1 + np.arange(400) % 2, copies), np.arange(len(label)))
        for own in (plans, plans[:1]):
            (cells,) = B.folded(own, BINS.width)(map(B.started(own, [B.Fit(p) for p in own]), [block]))
            sizes.append(len(pickle.dumps(B.summed(own, list(range(len(own))), 0, False)(cells))))
    assert sizes[0] == sizes[2] and sizes[1] == sizes[3]


def test_distinct_columns_of_many_slots():
    codes = np.random.default_rng(2).integers(0, 2, (40, 500)).astype(np.uint8) * 63
    codes = np.concatenate([codes, codes[:, ::-1]], axis=1)
    first, cell = B.distinct(codes, 64)
    assert (codes[:, first][:, cell] == codes).all() and len(first) == np.unique(codes, axis=1).shape[1]


def test_cells_of_one_row_grow_the_same_trees(spark, monkeypatch):
    x, y = sample()
    plans = [squared_plan(watched=0), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(5.0,))]
    a = B.boost(blocks(spark, x, y), plans, BINS)
    monkeypatch.setattr(B, "RARE", 0)
    b = B.boost(blocks(spark, x, y), plans, BINS)
    assert all(same(p, q) for p, q in zip(a, b)) and np.allclose(a[0].losses, b[0].losses)


def test_levels_read_off_the_sums_of_all_partitions_cells(spark, monkeypatch):
    x, y = sample(12_000)
    plans = [squared_plan(params=B.Params(max_depth=5, n_estimators=4), watched=0), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(5.0,))]
    two = [B.Plan(PARAMS, "logistic", 0, weighted=True)]
    sc = spark.sparkContext

    def grow(plans, y):
        sc.setJobGroup("grow", "")
        before = len(sc.statusTracker().getJobIdsForGroup("grow"))
        fits = B.boost(blocks(spark, x, y, parts=8), plans, BINS)
        return fits, len(sc.statusTracker().getJobIdsForGroup("grow")) - before

    few, jobs = grow(plans, y)
    classes, _ = grow(two, (y > 4).astype(float))
    monkeypatch.setattr(B, "COLLECTED", 16 * 4 * 2 * 2000)  # room for the cells, but not for those of eight partitions
    reduced, _ = grow(plans, y)
    monkeypatch.setattr(B, "CELL_ROWS", 1 << 40)
    levels, more = grow(plans, y)
    assert all(same(p, q) and same(p, r) for p, q, r in zip(few, reduced, levels)) and np.allclose(few[0].losses, levels[0].losses)
    assert same(classes[0], grow(two, (y > 4).astype(float))[0][0])
    assert jobs <= 2 * 4 + 5 < more  # a job a round, one for its quantiles


def test_rounds_of_merged_rows_are_no_job(spark, monkeypatch):
    """Where the driver has the merged rows of all partitions, jobs don't grow with rounds; trees, losses and resumed runs are those of
    the levels, also beside plans that read rows one by one."""
    x, y = sample(12_000)
    roles = 1 + np.arange(12_000) % 3
    three = np.digitize(y, [3, 6]).astype(float)
    plans = {"squared": [squared_plan(watched=1), squared_plan(rows=1, rules={1: 1})],
             "softmax": [B.Plan(PARAMS, "softmax", 0, 1, classes=3, start=(0.0,) * 3), B.Plan(PARAMS, "softmax", 1, None, 3, weighted=True, start=(0.0,) * 3)],
             "beside": [squared_plan(watched=1), B.Plan(PARAMS, "quantile", 0, share=0.9, start=(5.0,)), squared_plan(params=B.Params(subsample=0.7, n_estimators=6, max_depth=3))]}
    sc = spark.sparkContext

    def grow(kind, rounds=None, fits=None):
        sc.setJobGroup(kind, "")
        before = len(sc.statusTracker().getJobIdsForGroup(kind))
        own = plans[kind] if rounds is None else [B.replace(p, params=B.replace(p.params, n_estimators=rounds)) for p in plans[kind]]
        out = B.boost(blocks(spark, x, three if kind == "softmax" else y, roles, 8), own, BINS, fits)
        return out, len(sc.statusTracker().getJobIdsForGroup(kind)) - before

    for kind in plans:
        held, jobs = grow(kind)
        resumed, _ = grow(kind, fits=grow(kind, 2)[0])
        with monkeypatch.context() as m:
            m.setattr(B, "CELL_ROWS", 1 << 40)
            levels, _ = grow(kind)
        assert all(same(a, b) and np.allclose(a.losses, b.losses) for a, b in zip(held, levels))
        assert all(same(a, b) for a, b in zip(held, resumed))
        assert jobs == 1 if kind != "beside" else jobs <= 2 * 6 + 1
        with monkeypatch.context() as m:
            m.setattr(B, "MERGED_BYTES", B.COLLECTED)  # no room for merged rows
            assert all(same(a, b) for a, b in zip(held, grow(kind)[0]))
