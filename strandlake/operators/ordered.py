"""Statistics over a total order of the rows: ranks, running sums and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandlake.functions.ordered import running


def bh_fdr(grid: DataFrame) -> DataFrame:
    """Benjamini-Hochberg: p n / rank, its running minimum from the largest p down, at most 1."""
    n = grid.count()
    ranked = running(grid.select(F.col("cell").alias("id"), (F.col("score") / 100000).alias("p")), [F.col("p"), F.col("id")])
    raw = ranked.withColumn("raw", F.col("p") * n / F.col("rank")).withColumn("part", F.floor(F.col("rank") / 65536))
    later = raw.groupBy("part").agg(F.min("raw").alias("least"))
    # A row for each 65,536 of the table.
    beyond = later.select("part", F.min("least").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("beyond"))
    own = F.min("raw").over(Window.partitionBy("part").orderBy(F.desc("rank")))
    return raw.join(F.broadcast(beyond), "part").select("id", F.round(F.least(F.lit(1.0), own, F.coalesce("beyond", F.lit(1.0))), 6).alias("q"))


def corr_spearman(sims: DataFrame) -> DataFrame:
    """Correlation of average-tie ranks: a value's rank is the rows below it and half its own."""

    def ranks(column: str) -> DataFrame:
        ties = sims.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("ties"))
        placed = running(ties, [F.col(column)], upto=F.col("ties"))
        return placed.select(column, (F.col("upto") - (F.col("ties") - 1) / 2.0).alias(f"r_{column}"))

    both = sims.select("s1", "s3").join(ranks("s1"), "s1").join(ranks("s3"), "s3")
    return both.agg(F.round(F.corr("r_s1", "r_s3"), 6).alias("rho"))


def roulette_pick(grid: DataFrame) -> DataFrame:
    """The first cell whose running share of the score reaches each u; a u that none reaches has no row.

    Scores that decimals hold are added as whole numbers of 1e-9, so a share that
    is just u is not missed by rounding, in whatever parts the rows are added.
    """
    score, exact = F.col("score"), F.col("score").try_cast("decimal(27,9)")
    units = (exact * 10**9).cast("decimal(28,0)")
    held = F.bool_and(score.isNull() | F.coalesce(exact.cast("double") == score, F.lit(False)))
    total, whole, held = grid.agg(F.sum(score), F.sum(units), held).first()
    if held and whole is not None and whole >= 0:
        placed = running(grid.select("cell", units.alias("score")), [F.col("cell")], upto=F.col("score"))
        reached = lambda i: F.col("upto") * 10 >= F.lit(whole) * i
    else:
        placed = running(grid.select("cell", "score"), [F.col("cell")], upto=F.col("score"))
        reached = lambda i: F.col("upto") / F.lit(total) >= i / 10.0
    wide = placed.agg(*[F.min(F.when(reached(i), F.col("cell"))).alias(str(i)) for i in range(1, 10)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i / 10.0).alias("u"), F.col(str(i)).alias("pick")) for i in range(1, 10)]))).filter("pick is not null")


def coverage_at(flux: DataFrame) -> DataFrame:
    """How many tracts, closed at both ends, cover each place where the number changes."""
    steps = flux.select(F.inline(F.array(F.struct(F.col("tl").alias("x"), F.lit(1).alias("d")), F.struct((F.col("tr") + 1).alias("x"), F.lit(-1).alias("d")))))
    return running(steps.groupBy("x").agg(F.sum("d").alias("d")), [F.col("x")], depth=F.col("d")).select("x", "depth")


def dedup_times(flux: DataFrame) -> DataFrame:
    """Of rows at one time the first stays; times are whole here, so no two differ by less than the tolerance."""
    return flux.groupBy(F.col("tl").alias("t")).agg(F.min("event_id").alias("event_id")).select("event_id", "t")


def node_remap(flux: DataFrame) -> DataFrame:
    """Lineages numbered anew from 0 in their order."""
    numbers = running(flux.select("lineage").distinct(), [F.col("lineage")])
    return flux.join(numbers.select("lineage", (F.col("rank") - 1).alias("new_id")), "lineage").select("event_id", "new_id")


def survival_curve(flux: DataFrame) -> DataFrame:
    """Share of tracts at least as long as each length."""
    total = flux.count()
    lengths = flux.groupBy((F.col("tr") - F.col("tl")).alias("d")).agg(F.count("*").alias("n"))
    return running(lengths, [F.desc("d")], above=F.col("n")).select("d", F.round(F.col("above") / float(total), 6).alias("s"))


def ols_hc3(grid: DataFrame) -> DataFrame:
    """Slope on log10 and its HC3 error, from two passes of sums."""
    points = grid.select(F.log10(F.lit(1.0) + F.col("t_inv")).alias("x"), (F.col("score") / 100).alias("y"))
    n, mx, my, sxx, sxy = points.agg(F.count("*"), F.avg("x"), F.avg("y"), F.var_pop("x") * F.count("*"), F.covar_pop("x", "y") * F.count("*")).first()
    slope, dx = sxy / sxx, F.col("x") - F.lit(mx)
    left = (F.col("y") - my - slope * dx) / (1 - 1.0 / n - dx * dx / sxx)
    return points.agg(F.round(F.sqrt(F.sum(F.pow(dx * left, 2))) / sxx, 6).alias("se")).select(F.round(F.lit(slope), 6).alias("slope"), "se")


def edge_canonical_sort(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges numbered by the parent's time, parent, child and left end."""
    timed = edges.join(nodes.select(F.col("node").alias("parent"), "time"), "parent")
    ranked = running(timed, [F.col("time"), F.col("parent"), F.col("child"), F.col("l")])
    return ranked.select(F.col("rank").alias("rn"), "parent", "child", "l", "r")


#: Query -> (function, views that it reads).
FRAMES = {
    "bh_fdr": (bh_fdr, ["v_grid"]),
    "corr_spearman": (corr_spearman, ["v_sim"]),
    "roulette_pick": (roulette_pick, ["v_grid"]),
    "coverage_at": (coverage_at, ["v_flux"]),
    "dedup_times": (dedup_times, ["v_flux"]),
    "node_remap": (node_remap, ["v_flux"]),
    "survival_curve": (survival_curve, ["v_flux"]),
    "ols_hc3": (ols_hc3, ["v_grid"]),
    "edge_canonical_sort": (edge_canonical_sort, ["v_edge", "v_node"]),
}
