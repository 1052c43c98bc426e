"""Tree sequences by interval against a plain walk of every tree; scans, quantiles and as-of joins against sorted lists; exact tests against counting."""

import bisect
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import ordered
from strandlake.operators import nearest, testing
from strandlake.operators.forest import Forest

TREES, SAMPLES, LENGTH = 5000, 6, 100_000


def sequence(seed: int = 3):
    """Edges and ages of TREES trees, each made from the last by moving one branch, as edges that last while nothing changes."""
    rng = random.Random(seed)
    time = {k: 0.0 for k in range(SAMPLES)}
    parent, clock, fresh = {}, 1.0, SAMPLES
    alive = list(range(SAMPLES))
    while len(alive) > 1:
        a, b = rng.sample(alive, 2)
        time[fresh], parent[a], parent[b] = clock, fresh, fresh
        alive = [x for x in alive if x not in (a, b)] + [fresh]
        fresh, clock = fresh + 1, clock + rng.random()
    places = sorted(rng.sample(range(1, LENGTH), TREES - 1))
    trees, edges, begun = [], [], {c: (p, 0) for c, p in parent.items()}

    def record(at):
        for c, (p, since) in list(begun.items()):
            if parent.get(c) != p:
                edges.append((since, at, p, c))
                del begun[c]
        for c, p in parent.items():
            begun.setdefault(c, (p, at))

    left = 0
    for at in [*places, LENGTH]:
        trees.append((left, at, dict(parent)))
        if at < LENGTH:
            # Cut a sample's branch and set it on another branch, by a node of its own; its old parent is passed over.
            child = rng.randrange(SAMPLES)
            old = parent.pop(child)
            sister = next((c for c, p in parent.items() if p == old), None)
            above = parent.pop(old, None)
            if sister is not None:
                del parent[sister]
                if above is not None:
                    parent[sister] = above
            base = rng.choice([n for n in set(parent) | set(parent.values()) if n != child])
            over = parent.get(base)
            low, high = max(time[base], time[child]), time[over] if over is not None else max(time[base], 0) + 2.0
            time[fresh] = low + (high - low) * rng.uniform(0.2, 0.8)
            parent[base] = parent[child] = fresh
            if over is not None:
                parent[fresh] = over
            fresh += 1
            record(at)
        left = at
    parent.clear()
    record(LENGTH)
    return edges, time, trees


def walk(tree: dict[int, int], time: dict[int, float]):
    """Samples below each node of a tree, its total length, pi, Colless sum, MRCA of all and of each pair."""
    below: dict[int, set[int]] = {}
    for s in range(SAMPLES):
        node = s
        below.setdefault(node, set()).add(s)
        while node in tree:
            node = tree[node]
            below.setdefault(node, set()).add(s)
    n = SAMPLES
    total = sum(time[p] - time[c] for c, p in tree.items() if c in below)
    pi = sum((time[p] - time[c]) * 2 * len(below[c]) * (n - len(below[c])) / (n * (n - 1)) for c, p in tree.items() if c in below)
    children: dict[int, list[int]] = {}
    for c, p in tree.items():
        if c in below:
            children.setdefault(p, []).append(c)
    colless = sum(abs(len(below[a]) - len(below[b])) for kids in children.values() for a, b in itertools.combinations(kids, 2))
    mrca = {pair: min((x for x in below if {*pair} <= below[x]), key=lambda x: time[x]) for pair in itertools.combinations(range(n), 2)}
    root = min((time[x] for x in below if len(below[x]) == n), default=None)
    return total, pi, colless, root, mrca, children


@pytest.fixture(scope="module")
def made(spark):
    edges, time, trees = sequence()
    e = spark.createDataFrame(edges, "l long, r long, parent long, child long")
    n = spark.createDataFrame([(k, t, int(k < SAMPLES)) for k, t in time.items()], "node long, time double, is_sample int")
    return Forest(n, e, None, a=F.col("sample") < 3, b=F.col("sample") >= 3), trees, time


def test_no_tree_is_copied(made):
    forest, trees, _ = made
    assert len(trees) == TREES
    # Samples and the nodes above them, counted in each tree.
    copied = 0
    for _, _, tree in trees:
        for node in range(SAMPLES):
            copied += 1
            while node in tree:
                node, copied = tree[node], copied + 1
    assert forest.closure.count() < copied / 2
    assert "NestedLoop" not in forest.branches._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_statistics_of_every_tree(made):
    forest, trees, time = made
    seen = {left: walk(tree, time) for left, _, tree in trees}
    assert {r.tree: r.total for r in forest.total_branch().collect()} == pytest.approx({k: v[0] for k, v in seen.items()}, abs=2e-6)
    assert {r.tree: r.pi for r in forest.diversity().collect()} == pytest.approx({k: v[1] for k, v in seen.items()}, abs=2e-6)
    assert {r.tree: r.colless for r in forest.colless().collect()} == {k: v[2] for k, v in seen.items()}
    assert {r.tree: r.tmrca for r in forest.tmrca().collect()} == {k: v[3] for k, v in seen.items() if v[3] is not None}


def test_pairs_meet_where_a_walk_says(spark, made):
    forest, trees, _ = made
    pairs = [(0, 1), (0, 5), (2, 4)]
    got = [tuple(r) for r in forest.mrca(spark.createDataFrame(pairs, "a long, b long")).select("a", "b", "node", "l", "r").collect()]
    for a, b in pairs:
        runs = sorted((left, right, node) for x, y, node, left, right in got if (x, y) == (a, b))
        assert runs[0][0] == 0 and runs[-1][1] == LENGTH and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(runs, runs[1:]))
        starts = [x[0] for x in runs]
        for left, _, tree in trees[::37]:
            assert runs[bisect.bisect_right(starts, left) - 1][2] == walk(tree, made[2])[4][a, b]


def test_simplified_trees_have_the_same_meetings(made):
    forest, trees, time = made
    edges = [tuple(r) for r in forest.simplified().select("l", "r", "parent", "child").collect()]
    assert len({(c, left) for left, _, _, c in edges}) == len(edges)
    for left, _, tree in trees[::101]:
        children = walk(tree, time)[5]
        kept = {p for p, kids in children.items() if len(kids) > 1} | {*range(SAMPLES)}

        def up(node):
            while node in tree:
                node = tree[node]
                if node in kept:
                    return node

        want = {(c, up(c)) for c in kept if up(c) is not None and (c in children or c < SAMPLES)}
        assert {(c, p) for a, b, p, c in edges if a <= left < b} == want


def test_carriers_of_mutations(spark, made):
    forest, trees, _ = made
    places = [(k, left, node) for k, (left, _, tree) in enumerate(trees[::250]) for node in sorted({*tree.values()})[:3]]
    rows = [(site * 10 + i, at, node) for i, (site, at, node) in enumerate(places)]
    got = {(r.site, r.sample) for r in forest.genotypes(spark.createDataFrame(rows, "site long, position long, node long")).collect()}
    by_left = {left: tree for left, _, tree in trees}
    want = set()
    for site, at, node in rows:
        for s in range(SAMPLES):
            x = s
            while x != node and x in by_left[at]:
                x = by_left[at][x]
            if x == node:
                want.add((site, s))
    assert got == want


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_scans_carry_over_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", "c"]), i, rng.choice([None, None, 1.5, 2.0, 7.25]), rng.randint(0, 9)) for i in range(700)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, t int, x double, y int")
    got = {(r.k, r.t): (r.upto_y, r.last_x, r.next_x) for r in ordered.scanned(frame, ["k"], ["t"], sums=["y"], last=["x"], next=["x"]).collect()}
    for k in (None, "a", "b", "c"):
        part = [r for r in rows if r[0] == k]
        for i, r in enumerate(part):
            last = [q[2] for q in part[:i] if q[2] is not None][-1:]
            after = [q[2] for q in part[i + 1 :] if q[2] is not None][:1]
            assert got[k, r[1]] == (sum(q[3] for q in part[: i + 1]), *(last or [None]), *(after or [None]))
    whole = {r.t: r.upto_y for r in ordered.scanned(frame, [], ["t"], sums=["y"]).collect()}
    assert whole[699] == sum(r[3] for r in rows)
    assert ordered.scanned(frame.limit(0), ["k"], ["t"], sums=["y"], last=["x"]).count() == 0
    shares = [0, 0.1, 0.5, 0.975, 1]
    for r in ordered.quantiles(frame, ["x", "y"], shares, ["k"]).collect():
        values = [v for k, _, x, y in rows if k == r.k for v in [x if r.value == "x" else y] if v is not None]
        assert r.q == pytest.approx(list(np.quantile(values, shares)))


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_as_of_and_interpolation(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = random.Random(2)
    right = [(rng.choice([1, 2, 2, 2, None]), rng.choice([*range(60), None]), rng.randint(0, 5)) for _ in range(150)]
    left = [(i, rng.choice([1, 2, 2, 3, None]), rng.choice([*range(-3, 66), None])) for i in range(300)]
    joined = nearest.asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, at int, v int"), {"k": "k"}, ("t", "at"), ["v"])
    got = {r.id: r for r in joined.withColumn("between", nearest.interpolated(F.col("t"), "v")).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        own = [(a, v) for q, a, v in right if q == k and a is not None] if k is not None and t is not None else []
        before = max((x for x in own if x[0] <= t), default=None)
        after = min((x for x in own if x[0] > t), default=None)
        assert (got[i].before and tuple(got[i].before), got[i].after and tuple(got[i].after)) == (before, after)
        want = None if not before else float(before[1]) if not after else before[1] + (after[1] - before[1]) * (t - before[0]) / (after[0] - before[0])
        assert got[i].between == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("n, m", [(1, 1), (5, 5), (6, 4), (7, 3), (5, 7), (2, 8)])
def test_exact_ks_against_all_orders(n, m):
    reached = []
    for ones in itertools.combinations(range(n + m), n):
        i = worst = 0
        for k in range(n + m):
            i += k in ones
            worst = max(worst, abs(i * m - (k + 1 - i) * n))
        reached.append(worst)
    for h in {*reached, 0}:
        assert testing.ks_exact(h / (n * m), n, m) == pytest.approx(sum(x >= h for x in reached) / len(reached))


def test_exact_and_asymptotic_ks_meet(spark):
    d, n = 0.031, 5000
    row = spark.range(1).select(testing.ks_asymptotic(F.lit(d), F.lit(float(n)), F.lit(float(n))).alias("p")).first()
    assert testing.ks_exact(d, n, n) == pytest.approx(row.p, abs=2e-3)
    assert math.isnan(testing.ks_exact(0.5, 0, 3)) and testing.ks_exact(0.9, 10_000, 9_999) == 0


def test_incomplete_beta(spark):
    # I_x(a, b) for whole a and b is a binomial tail.
    cases = [(x, a, b) for x in (0.0, 0.02, 0.3, 0.5, 0.77, 0.999, 1.0) for a in (1, 2, 7, 40) for b in (1, 3, 30)]
    rows = spark.createDataFrame([(x, float(a), float(b)) for x, a, b in cases], "x double, a double, b double").select(testing.beta_share(F.col("x"), F.col("a"), F.col("b")).alias("v")).collect()
    for (x, a, b), r in zip(cases, rows):
        n = a + b - 1
        assert r.v == pytest.approx(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)), abs=1e-9)


def test_missing_calls_shrink_what_is_compared(spark):
    # Haplotypes 0 and 1 share sites 0 and 1, where they differ once; site 2 is missing in 1.
    rows = [(1, 1, 0, 0, 30.0), (2, 1, 1, 0, 10.0), (3, 1, 2, 0, 30.0), (4, 1, 0, 1, 10.0), (5, 1, 1, 1, 10.0), (6, 1, 0, 0, 1.0)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    assert [tuple(r) for r in testing.pairwise_missing(frame).collect()] == [(0, 2, 1, 0.5)]
