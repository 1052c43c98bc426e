"""Priors, regression adjustment, bootstrap and root finding for approximate Bayesian fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions.ordered import checkpointed, quantiles, scanned

#: Draws are 13 hexadecimal digits of a hash of seed, number and parameter, so they are the same in every engine.
QUERIES = {
    # Uniform, loguniform, an atom at 0 mixed with loguniform, and a dominance that is one half where selection is 0.
    "prior_draws": "SELECT sim, round(1000 + 9000 * a, 4) AS t_inv, round(exp(ln(0.001e0) + (ln(0.5e0) - ln(0.001e0)) * b), 8) AS p_start, round(CASE WHEN c < 0.2e0 THEN 0.0e0 ELSE exp(ln(0.0001e0) + (ln(0.1e0) - ln(0.0001e0)) * (c - 0.2e0) / 0.8e0) END, 8) AS s, round(CASE WHEN c < 0.2e0 THEN 0.5e0 ELSE d END, 6) AS h FROM ("
    + "SELECT sim, HEX(h1) / 4503599627370496.0e0 AS a, HEX(h2) / 4503599627370496.0e0 AS b, HEX(h3) / 4503599627370496.0e0 AS c, HEX(h4) / 4503599627370496.0e0 AS d FROM (SELECT sim, substr(g1, 1, 13) AS h1, substr(g2, 1, 13) AS h2, substr(g3, 1, 13) AS h3, substr(g4, 1, 13) AS h4 FROM ("
    + "SELECT sim, SHA(k1) AS g1, SHA(k2) AS g2, SHA(k3) AS g3, SHA(k4) AS g4 FROM (SELECT sim, k || 't' AS k1, k || 'p' AS k2, k || 's' AS k3, k || 'h' AS k4 FROM (SELECT o_orderkey AS sim, '7-' || CAST(o_orderkey AS VARCHAR(20)) AS k FROM orders)))))",
}


def local_linear(kept: DataFrame, parameters: dict[str, tuple[float, float, bool]], stats: dict[str, float], dist: str = "dist") -> DataFrame:
    """Parameters of the kept simulations moved to the observed statistics by weighted regression.

    ``parameters``: name -> lowest, highest, whether in logs; ``stats``: name -> observed.
    Weights are Epanechnikov's, 1 - (d / largest d) ** 2.  Spark sums X'WX and X'WY, at
    most a few dozen numbers; the driver solves.  What leaves the prior is clipped
    to it.  Rows that lack a statistic or parameter are left out.  Adds ``adjusted_``
    columns and ``weight``.
    """
    rows = checkpointed(kept.na.drop(subset=[*parameters, *stats, dist]))
    top = rows.agg(F.max(dist)).first()[0]
    weight = F.lit(1.0) if not top else 1 - F.pow(F.col(dist) / top, 2)
    x = [F.lit(1.0), *[F.col(s) - observed for s, observed in stats.items()]]
    y = {p: F.ln(F.col(p)) if log else F.col(p) for p, (_, _, log) in parameters.items()}
    sums = [F.sum(weight * a * b) for a in x for b in [*x, *y.values()]]
    k = len(x)
    found = np.array([float(v or 0) for v in rows.agg(*sums).first()]).reshape(k, k + len(y))
    beta = np.linalg.pinv(found[:, :k]) @ found[:, k:]
    new = [weight.alias("weight")]
    for j, (p, (low, high, log)) in enumerate(parameters.items()):
        moved: Column = y[p]
        for i in range(1, k):
            moved = moved - x[i] * float(beta[i, j])
        new.append(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.exp(moved) if log else moved)).alias(f"adjusted_{p}"))
    return rows.select("*", *new)


def summary(posterior: DataFrame, parameter: str, atom: float | None = None) -> DataFrame:
    """Median, 95 % interval and, if there is one, the mass of an atom."""
    quantiles = F.percentile(parameter, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    mass = F.avg(F.when(F.col(parameter) == atom, 1.0).otherwise(0.0)) if atom is not None else F.lit(None).cast("double")
    found = posterior.agg(quantiles.alias("q"), mass.alias("atom"))
    return found.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("lo", "mid", "hi"))], "atom")


def _number(digits: int, *parts: Column | int | str, at: int = 1) -> Column:
    """A whole number of so many hexadecimal digits of a digest of the parts, the same in every engine."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, digits), 16, 10).cast("long")


def bootstrap(reps: DataFrame, observed: tuple[float, float], covariance: tuple[float, float, float], rounds: int, seed: int = 1) -> DataFrame:
    """Parametric bootstrap of a grid fit: ``boot``, ``cell``, ``chi2``, ``delta``.

    ``reps`` have (cell, rep, a, b): the replicates of each cell of a grid and their two
    statistics.  A round weighs the replicates of every cell anew, as many draws as
    it has replicates, and adds noise of the given covariance (var a, cov, var b) to
    what was observed, by its Cholesky factor.  ``cell`` is the round's best, ``chi2``
    its miss; ``delta`` is how much worse the cell that fits the true data best does,
    whose 95 % quantile bounds a profile.  All draws are digests of seed, round, cell
    and number.  Rows are (round, cell, draw); sums are taken before they meet.
    """
    va, cov, vb = covariance
    det = va * vb - cov * cov
    counted = scanned(reps.select("cell", "rep", "a", "b", F.lit(1).alias("_one")), ["cell"], ["rep"], sums=["_one"])
    placed = checkpointed(counted.withColumnRenamed("upto__one", "idx"))
    size = placed.groupBy("cell").agg(F.max("idx").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))

    def miss(a: Column, b: Column, ta: Column | float, tb: Column | float) -> Column:
        x, y = a - ta, b - tb
        return (x * x * vb - 2 * x * y * cov + y * y * va) / det

    true = size.orderBy(F.round(miss(F.col("ma"), F.col("mb"), *observed), 9), "cell").select("cell").first()
    session = reps.sparkSession
    # Each row draws once a round, for its place among the draws of its cell.
    draws = placed.select("cell", "idx").join(size.select("cell", "n"), "cell").crossJoin(F.broadcast(session.range(rounds).select(F.col("id").alias("boot"))))
    weights = draws.select("boot", "cell", (_number(12, seed, F.col("boot"), F.col("cell"), F.col("idx")) % F.col("n") + 1).alias("idx")).groupBy("boot", "cell", "idx").agg(F.count("*").alias("w"))
    means = weights.join(placed.select("cell", "idx", "a", "b"), ["cell", "idx"]).groupBy("boot", "cell").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("a"), (F.sum(F.col("w") * F.col("b")) / F.sum("w")).alias("b"))
    share = lambda at: (_number(12, seed, F.col("boot"), "noise", at=at) + 0.5) / float(1 << 48)
    radius, angle = F.sqrt(-2 * F.ln(share(1))), 2 * math.pi * share(13)
    z1, z2 = radius * F.cos(angle), radius * F.sin(angle)
    low = cov / math.sqrt(va)
    ta, tb = observed[0] + math.sqrt(va) * z1, observed[1] + low * z1 + math.sqrt(vb - low * low) * z2
    each = means.withColumn("chi2", miss(F.col("a"), F.col("b"), ta, tb))
    best = each.groupBy("boot").agg(F.min(F.struct("chi2", "cell")).alias("one"), F.max(F.when(F.col("cell") == true["cell"], F.col("chi2"))).alias("own"))
    return best.select("boot", F.col("one.cell").alias("cell"), F.col("one.chi2").alias("chi2"), (F.col("own") - F.col("one.chi2")).alias("delta"))


def bilinear(grid: Column, size: int, x: Column, y: Column) -> Column:
    """A surface at (x, y), from its values at whole places as one array, row by row; outside it the edge holds."""
    x, y = (F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), v)) for v in (x, y))
    i, j = (F.least(F.floor(v), F.lit(size - 2)).cast("int") for v in (x, y))
    u, v, at = x - i, y - j, i * size + j
    return (1 - u) * ((1 - v) * grid[at] + v * grid[at + 1]) + u * ((1 - v) * grid[at + size] + v * grid[at + size + 1])


def meet(first: Column, second: Column, size: int, targets: tuple[Column, Column], rounds: int = 80) -> Column:
    """Struct (miss, x, y): where two surfaces come nearest to their targets, in relative squared miss.

    The best of a lattice of quarter steps begins; then the best of 25 places around
    the best so far, in steps that halve when none of these is better.  All of it is
    one fold over arrays, so any number of targets is sought at once.
    """
    scale = [F.when(t == 0, F.lit(1.0)).otherwise(F.abs(t)) for t in targets]

    def at(x: Column, y: Column) -> Column:
        x, y = (F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), v)) for v in (x, y))
        parts = [(bilinear(g, size, x, y) - t) / s for g, t, s in zip((first, second), targets, scale)]
        return F.struct((parts[0] * parts[0] + parts[1] * parts[1]).alias("miss"), x.alias("x"), y.alias("y"))

    steps = 4 * (size - 1)
    lattice = F.transform(F.sequence(F.lit(0), F.lit((steps + 1) ** 2 - 1)), lambda k: at(F.floor(k / (steps + 1)) / 4.0, (k % (steps + 1)) / 4.0))

    def closer(state: Column, _: Column) -> Column:
        best, step = state["best"], state["step"]
        around = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: at(best["x"] + (F.floor(k / 5) - 2) * step, best["y"] + (k % 5 - 2) * step)))
        return F.struct(F.least(best, around).alias("best"), F.when(around["miss"] < best["miss"], step).otherwise(step / 2).alias("step"))

    begin = F.struct(F.array_min(lattice).alias("best"), F.lit(0.125).alias("step"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, closer, lambda s: s["best"])


def abc_adjusted(sims: DataFrame) -> DataFrame:
    """The kept simulations of the fixture with theta adjusted in logs to where the scaled statistics are 0."""
    from strandlake.operators.selection import distances, kept

    moved = local_linear(kept(distances(sims)), {"theta": (1000.0, 600000.0, True)}, {"z1": 0.0, "z2": 0.0, "z3": 0.0})
    return moved.select("sim", F.round("weight", 6).alias("weight"), F.round("adjusted_theta", 2).alias("theta"))


def _fit(part: DataFrame, orders: DataFrame) -> DataFrame:
    """Cells are sizes, replicates parts, statistics their price and their key modulo 97; observed are the parts that orders of one kind name."""
    reps = part.select(F.col("p_size").cast("long").alias("cell"), F.col("p_partkey").alias("rep"), F.col("p_retailprice").cast("double").alias("a"), (F.col("p_partkey") % 97).cast("double").alias("b"))
    seen = reps.join(orders.filter("o_orderstatus = 'F'").select((F.col("o_orderkey")).alias("rep")), "rep", "left_semi").agg(F.avg("a"), F.avg("b")).first()
    spread = reps.agg(F.var_samp("a"), F.covar_samp("a", "b"), F.var_samp("b")).first()
    return bootstrap(reps, (seen[0], seen[1]), tuple(float(v) / 100 for v in spread), 100)


def bootstrap_fit(part: DataFrame, orders: DataFrame) -> DataFrame:
    return _fit(part, orders).select("boot", "cell", F.round("chi2", 5).alias("chi2"), F.round("delta", 5).alias("delta"))


def bootstrap_bound(part: DataFrame, orders: DataFrame) -> DataFrame:
    """The 95 % point of a profile's rise, and the share of rounds that its true best cell wins."""
    found = checkpointed(_fit(part, orders))
    bound = quantiles(found, ["delta"], [0.95]).select(F.round(F.col("q")[0], 5).alias("bound"))
    return bound.crossJoin(F.broadcast(found.agg(F.round(F.avg(F.when(F.col("delta") == 0, 1.0).otherwise(0.0)), 6).alias("won"))))


def surface_root(part: DataFrame) -> DataFrame:
    """For each brand, where on the grid of size class and key modulo 5 the mean price and the mean key modulo 97 are its own; empty cells have the mean of all."""
    cells = part.groupBy(F.floor((F.col("p_size") - 1) / 10).alias("i"), (F.col("p_partkey") % 5).alias("j")).agg(F.avg("p_retailprice").alias("a"), F.avg(F.col("p_partkey") % 97).alias("b"))
    whole = part.agg(F.avg("p_retailprice").alias("_a"), F.avg(F.col("p_partkey") % 97).alias("_b"))
    # 25 cells: one row of two arrays.
    grid = part.sparkSession.range(25).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j"), "id").join(cells, ["i", "j"], "left").crossJoin(F.broadcast(whole))
    arrays = grid.groupBy().agg(*[F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce(c, f"_{c}").alias("v")))), lambda s: s["v"]).alias(f"grid_{c}") for c in ("a", "b")])
    targets = part.groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("ta"), F.avg(F.col("p_partkey") % 97).alias("tb"))
    found = targets.crossJoin(F.broadcast(arrays)).withColumn("at", meet(F.col("grid_a"), F.col("grid_b"), 5, (F.col("ta"), F.col("tb"))))
    return found.select("brand", F.round("at.x", 3).alias("x"), F.round("at.y", 3).alias("y"), F.round("at.miss", 6).alias("miss"))


FRAMES = {"abc_adjusted": (abc_adjusted, ["v_sim"]), "bootstrap_fit": (bootstrap_fit, ["part", "orders"]), "bootstrap_bound": (bootstrap_bound, ["part", "orders"]), "surface_root": (surface_root, ["part"])}
