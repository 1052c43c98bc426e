"""Replicates against closed forms, and tree operators on them against plain Python."""

import collections
import math

import numpy as np
import pytest

from strandlake.operators import simulate
from strandlake.operators.forest import Forest
from strandlake.simulation import demography, kernel, runs, tags, trajectory
from strandlake.simulation.spec import Inversion, Spec, Sweep


def grown(a: float = 1e-3, n: float = 1000.0) -> float:
    t = np.linspace(0, 20000, 200001)
    return float(np.trapezoid(np.exp(-np.cumsum(np.exp(a * t) / (2 * n)) * 0.1), t))


def narrowed() -> float:
    # Pair time with 1000 for 500 generations, 100 for 100, and 1000 before.
    a, b = math.exp(-500 / 2000), math.exp(-100 / 200)
    return 2000 * (1 - a) + a * (200 * (1 - b)) + a * b * 2000


# Flux at rate g in all and p = 1/2: between 2N + 1/g (Strobeck). Two demes: between 4N + 1/2m.
WANT = {"sim_panmictic": 4000 * 0.9, "sim_barrier": 3000 + 2000, "sim_flux": 2000 + 1000, "sim_two_pop_split": 2500 + 2000, "sim_migration": 4000 + 500, "sim_bottleneck": narrowed(), "sim_growth": grown(), "sim_recombination": 4000 * 0.9}


@pytest.mark.parametrize("name", WANT)
def test_mean_age(spark, name):
    row = simulate.queries()[name](spark, None).first()
    assert row.reps == simulate.MODELS[name][1] and abs(row.mean_tmrca - WANT[name]) < 4 * row.error


def test_number_of_trees():
    # The expected number of breakpoints in ancestral material is rho (1 + 1/2 + ... + 1/(n - 1)).
    spec = Spec(((0, "", 6),), recombination=20 / 4000)
    counts = [len({x for e in kernel.simulate(spec, 3, r).edges for x in e[:2]}) - 2 for r in range(150)]
    want = 20 * sum(1 / i for i in range(1, 6))
    assert abs(np.mean(counts) - want) < 4 * np.std(counts) / len(counts) ** 0.5


def test_crossovers_are_suppressed():
    # While the arrangement is at frequency p, lineages that carry it recombine at r p.
    spec = Spec(((0, "I", 2),), recombination=5e-3, inversions=(Inversion(0, 1, 1e9, 0.05),))
    free = Spec(((0, "", 2),), sizes=(50.0,), recombination=5e-3 * 0.05)
    a, b = ([len({x for e in kernel.simulate(s, 5, r).edges for x in e[:2]}) - 2 for r in range(400)] for s in (spec, free))
    assert abs(np.mean(a) - np.mean(b)) < 4 * math.hypot(np.std(a), np.std(b)) / 20


def test_sweep_lowers_age_at_the_site_only():
    spec = Spec(((0, "", 6),), length=1e6, recombination=1e-7, sweep=Sweep(5e5, 0, trajectory.sweep(10.0, 0.2, 1000.0)))
    near, far = [], []
    for rep in range(12):
        found = kernel.simulate(spec, 2, rep)
        for x, out in ((5e5, near), (1e4, far)):
            out.append(max(found.nodes[p][0] for left, right, p, _ in found.edges if left <= x < right))
    assert max(near) < 200 < np.median(far)


def test_seeded_whatever_the_partitions(spark):
    spec = Spec(((0, "S", 2), (0, "I", 2)), length=1e4, recombination=1e-7, inversions=(Inversion(2000, 8000, 3000.0, 0.4, flux=1e-6),), mutation=1e-8)
    cut = lambda frame: sorted(map(str, frame.filter("kind <> 'status'").collect()))
    some = runs.numbers(spark, 6)
    assert cut(runs.replicates(some, spec, 7)) == cut(runs.replicates(some.coalesce(1), spec, 7))


def test_resume_runs_only_what_is_missing(spark, tmp_path):
    spec, folder = Spec(((0, "", 3),)), str(tmp_path / "reps")
    first = runs.resumed(spark, spec, 4, folder, batch=2).collect()
    again = runs.resumed(spark, spec, 7, folder, batch=3).collect()
    walls = lambda rows: {r.rep: r.time for r in rows if r.kind == "status"}
    assert len(walls(again)) == 7 and walls(first).items() <= walls(again).items()


def test_lineages_that_never_meet_are_a_status(spark):
    assert {(r.status, r.n) for r in simulate.queries()["sim_status"](spark, None).collect()} == {("ok", 5), ("failed", 5)}
    apart = Spec(((0, "", 1), (1, "", 1)), sizes=(1000.0, 1000.0))
    assert not demography.connected(apart)
    assert demography.connected(Spec(apart.samples, sizes=apart.sizes, events=(("em", 10.0, 1, 0, 0.1),)))
    assert demography.size_at(Spec(((0, "", 1),), growth=(1e-3,), events=(("eg", 100.0, 0, 0.0), ("en", 200.0, 0, 50.0))), 0, 150.0) == pytest.approx(1000 * math.exp(-0.1))
    with pytest.raises(ValueError):
        Spec(((0, "", 1),), events=(("ej", 1.0, 0),))


def test_class_migration_is_logged():
    spec, _ = simulate.MODELS["sim_class_migration"]
    moved = collections.Counter(int(e[5]) for r in range(300) for e in kernel.simulate(spec, 4, r).log if e[1] == "cmig")
    assert set(moved) <= {0, 1, 2} and abs(moved[1] - moved[0] - moved[2]) < 120


def test_tags():
    both = tags.tag(0, "S") | tags.tag(0, "I")
    assert tags.conflict(both) and not tags.conflict(tags.tag(0, "S") | tags.tag(1, "I"))
    assert tags.flipped(tags.tag(1, "S") | tags.tag(0, "I"), 1) == tags.tag(1, "I") | tags.tag(0, "I")
    # Frequencies of S and I multiply over inversions; an untagged one counts 1.
    f = [0.6, 0.3]
    assert [tags.share(m, f) for m in (tags.tag(0, "I"), tags.tag(0, "I") | tags.tag(1, "S"), 0)] == pytest.approx([0.6, 0.42, 1])


def test_paths():
    assert trajectory.bridge(0.2, 0.7, 1000, 300, 1)[-1] == (300.0, 0.7)
    assert all(0 < f < 1 for path in (trajectory.diffusion(0.5, 100, 500, 2), trajectory.wright_fisher(0.1, 200, 50, 0.05, 3), trajectory.dormant(0.5, 100, 0.01, 50, 1000), *trajectory.bifurcate(0.5, 0.9, 0.1, 200, 0.01), trajectory.decline(0.6, 0.1, 100, 300), trajectory.logistic(0.8, 0.01, 500)) for _, f in path)
    with pytest.raises(ValueError):
        trajectory.precomputed([0, 2, 1], [0.1, 0.2, 0.3])


def test_forest_on_replicates(spark):
    """Branch statistics, simplification and genotypes over real breakpoints, against trees walked in Python."""
    spec = Spec(((0, "SS", 3), (0, "II", 3)), length=1e4, recombination=2e-7, inversions=(Inversion(0, 1e4, 4000.0, 0.4), Inversion(3000, 7000, 2000.0, 0.5, flux=1e-6)), mutation=1e-7)
    tables = runs.run(spark, spec, 2, seed=9)
    trees = simulate.forest(tables)
    pi = {(r.rep, r.tree): r.pi for r in trees.diversity().collect()}
    colless = {(r.rep, r.tree): r.colless for r in trees.colless().collect()}
    top = {(r.rep, r.tree): r.tmrca for r in trees.tmrca().collect()}
    kept = collections.defaultdict(set)
    for r in trees.simplified().collect():
        kept[r.rep].add((r.l, r.r, r.parent, r.child))
    carriers = collections.defaultdict(set)
    for r in trees.genotypes(tables.mutations).collect():
        carriers[r.rep, r.site].add(r.sample)
    for rep in range(2):
        found = kernel.simulate(spec, 9, rep)
        times = [t for t, *_ in found.nodes]
        marks = sorted({x for e in found.edges for x in e[:2]})
        muts = found.mutations(spec.mutation)
        assert {(rep, x) for x in marks[:-1]} == {k for k in pi if k[0] == rep}
        for x in marks[:-1]:
            up = {c: p for left, right, p, c in found.edges if left <= x < right}
            under = collections.defaultdict(set)
            for s in range(6):
                node = s
                while node is not None:
                    under[node].add(s)
                    node = up.get(node)
            assert pi[rep, x] == pytest.approx(sum((times[p] - times[c]) * 2 * len(under[c]) * (6 - len(under[c])) / 30 for c, p in up.items()), rel=1e-6)
            assert top[rep, x] == pytest.approx(min(times[n] for n, s in under.items() if len(s) == 6))
            arms = collections.defaultdict(list)
            for c, p in up.items():
                arms[p].append(len(under[c]))
            assert colless[rep, x] == sum(abs(a - b) for sizes in arms.values() for i, a in enumerate(sizes) for b in sizes[:i])
            solid = {n for n in under if n < 6 or len(arms[n]) > 1}
            for n in solid:
                p = up.get(n)
                while p is not None and p not in solid:
                    p = up.get(p)
                held = {(parent, child) for left, right, parent, child in kept[rep] if left <= x < right and child == n}
                assert held == ({(p, n)} if p is not None else set())
            for k, (at, node, _) in enumerate(muts):
                if x <= at < marks[marks.index(x) + 1]:
                    assert carriers[rep, k] == under[node]


def test_branch_stats_of_every_replicate(spark):
    """The query read an attribute that trees no longer have; its sums against trees walked in Python."""
    got = {r.rep: r for r in simulate.queries()["sim_branch_stats"](spark, "").collect()}
    spec, _ = simulate.MODELS["sim_recombination"]
    assert got.keys() == {*range(20)}
    for rep in range(20):
        found = kernel.simulate(spec, 1, rep)
        times = [t for t, *_ in found.nodes]
        marks = sorted({x for e in found.edges for x in e[:2]})
        pi = dxy = 0.0
        for x, y in zip(marks, marks[1:]):
            up = {c: p for left, right, p, c in found.edges if left <= x < right}
            under = collections.defaultdict(set)
            for s in range(10):
                node = s
                while node is not None:
                    under[node].add(s)
                    node = up.get(node)
            for c, p in up.items():
                k, odd = len(under[c]), sum(s % 2 for s in under[c])
                pi += (y - x) * (times[p] - times[c]) * 2 * k * (10 - k) / 90
                dxy += (y - x) * (times[p] - times[c]) * ((k - odd) * (5 - odd) + odd * (5 - k + odd)) / 25
        assert got[rep].trees == len(marks) - 1
        assert (got[rep].pi, got[rep].dxy) == pytest.approx((pi / spec.length, dxy / spec.length), abs=1e-3)
