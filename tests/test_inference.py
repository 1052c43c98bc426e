"""Adjustment, bootstrap and roots against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import inference


def test_local_linear_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 300
    s = rng.normal(size=(n, 2))
    theta = np.exp(1 + 0.5 * s[:, 0] - 0.2 * s[:, 1] + 0.1 * rng.normal(size=n))
    t = rng.uniform(0, 10, n)
    dist = np.hypot(s[:, 0], s[:, 1])
    frame = spark.createDataFrame(pd.DataFrame({"sim": range(n), "a": s[:, 0], "b": s[:, 1], "theta": theta, "t": t, "dist": dist}))
    got = inference.local_linear(frame, {"theta": (0.5, 9.0, True), "t": (1.0, 9.0, False)}, {"a": 0.1, "b": -0.2}).toPandas().sort_values("sim")
    w = 1 - (dist / dist.max()) ** 2
    x = np.column_stack([np.ones(n), s[:, 0] - 0.1, s[:, 1] + 0.2])
    for name, y, low, high, back in (("theta", np.log(theta), 0.5, 9, np.exp), ("t", t, 1, 9, lambda v: v)):
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * y))
        assert got[f"adjusted_{name}"].to_numpy() == pytest.approx(np.clip(back(y - x[:, 1:] @ beta[1:]), low, high))
    assert got["weight"].to_numpy() == pytest.approx(w)
    row = inference.summary(spark.createDataFrame([(0.0,), (0.0,), (1.0,), (3.0,)], "s double"), "s", 0.0).first()
    assert (row.mid, row.atom) == (0.5, 0.5)


def test_bootstrap_covers_the_true_cell(spark):
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(c, r, c + rng.normal(0, 0.3), 2 * c + rng.normal(0, 0.3)) for c in range(5) for r in range(40)], columns=["cell", "rep", "a", "b"])
    run = lambda frame: inference.bootstrap(frame, (2.0, 4.0), (0.04, 0.01, 0.04), 100).toPandas().sort_values("boot")
    found, again = run(spark.createDataFrame(cells)), run(spark.createDataFrame(cells.sample(frac=1, random_state=2)).repartition(3))
    assert (found["cell"] == 2).mean() > 0.9 and (found["delta"] >= 0).all() and len(found) == 100
    assert found["cell"].tolist() == again["cell"].tolist() and found["delta"].to_numpy() == pytest.approx(again["delta"].to_numpy(), abs=1e-9)
    # Noise is that of the covariance: misses of the true cell are about chi-squared with two degrees, and the means' own spread.
    assert 1.2 < (found["chi2"] + found["delta"]).mean() < 3.5


def test_surfaces_meet(spark):
    first, second = np.add.outer(np.arange(6.0), np.arange(6.0)), np.subtract.outer(2 * np.arange(6.0), np.arange(6.0))
    row = spark.createDataFrame([(first.ravel().tolist(), second.ravel().tolist(), 3.65, 3.1), (first.ravel().tolist(), second.ravel().tolist(), 99.0, 0.0)], "a array<double>, b array<double>, s double, t double")
    at = inference.bilinear(row["a"], 6, F.lit(3.5), F.lit(1.25)), inference.bilinear(row["a"], 6, F.lit(99.0), F.lit(-4.0))
    assert tuple(row.select(*at).first()) == pytest.approx((4.75, 5.0))
    found = row.select(inference.meet(row["a"], row["b"], 6, (row["s"], row["t"])).alias("m")).collect()
    assert (found[0].m.x, found[0].m.y) == pytest.approx((2.25, 1.4), abs=1e-4) and found[0].m.miss < 1e-9
    assert all(0 <= v <= 5 for v in (found[1].m.x, found[1].m.y))


def test_draws_stay_in_the_prior(spark):
    from strandlake.plans import catalogue

    rows = catalogue.queries()["prior_draws"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and rows["t_inv"].between(1000, 10000).all() and rows["p_start"].between(0.001, 0.5).all()
    atom = rows["s"] == 0
    assert abs(atom.mean() - 0.2) < 0.04 and (rows.loc[atom, "h"] == 0.5).all() and rows.loc[~atom, "s"].between(1e-4, 0.1).all()
    assert abs(rows["t_inv"].mean() - 5500) < 4 * 2598 / len(rows)**0.5
