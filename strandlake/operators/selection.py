"""Exact quantiles, medians and scales of groups of any size, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandlake.functions.ordered import checkpointed, quantiles, running

STATS = ["s1", "s2", "s3"]


def _wide(found: DataFrame, by: list[str], names: dict[str, tuple[str, int]]) -> DataFrame:
    """Quantiles (by..., value, q) as named columns, one row for each group."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("value") == v, F.col("q")[i])).alias(n) for n, (v, i) in names.items()])


def robust(sims: DataFrame, stats: list[str]) -> dict[str, tuple[float, float]]:
    """Median and 1.4826 MAD of each statistic; two ordered passes serve all of them."""
    mid = {r["value"]: r["q"][0] for r in quantiles(sims, stats, [0.5]).collect()}
    off = sims.select(*[F.abs(F.col(s) - F.lit(mid.get(s))).alias(s) for s in stats])
    mad = {r["value"]: 1.4826 * r["q"][0] for r in quantiles(off, stats, [0.5]).collect()}
    return {s: (mid.get(s), mad.get(s)) for s in stats}


def scaled(sims: DataFrame, stats: list[str] = STATS) -> DataFrame:
    """Adds z1, z2...: the statistics less their medians, over their MADs (null where that is 0)."""
    sims = checkpointed(sims)
    scale = robust(sims, stats)
    return sims.select("*", *[((F.col(s) - F.lit(m)) / F.lit(d or None).cast("double")).alias(f"z{i + 1}") for i, (s, (m, d)) in enumerate(scale.items())])


def distances(sims: DataFrame) -> DataFrame:
    """Adds ``dist``, from where all scaled statistics are 0; one without a value adds nothing."""
    squares = [F.coalesce(F.col(f"z{i + 1}") * F.col(f"z{i + 1}"), F.lit(0.0)) for i in range(len(STATS))]
    return scaled(sims).withColumn("dist", F.sqrt(squares[0] + squares[1] + squares[2]))


def kept(dist: DataFrame, share: float = 0.01, least: int = 20) -> DataFrame:
    """The nearest simulations: max(least, round(share n)), with their rank; ties go to the smaller number."""
    dist = checkpointed(dist)
    n, order = dist.count(), [F.round("dist", 9), F.col("sim")]
    return running(dist.orderBy(*order).limit(max(least, int(share * n + 0.5))), order).withColumnRenamed("rank", "rn")


def robust_scale(sims: DataFrame) -> DataFrame:
    sims = checkpointed(sims)
    (m1, d1), (m2, d2), (_, d3) = robust(sims, STATS).values()
    spread = F.stddev_samp("s1")
    return sims.agg(*[F.round(F.lit(x), 6).alias(n) for n, x in (("med1", m1), ("mad1", d1), ("med2", m2), ("mad2", d2), ("mad3", d3))], F.round(spread, 6).alias("sd1"), F.round(spread / F.sqrt(F.count("s1")), 6).alias("sem1"))


def abc_distance(sims: DataFrame) -> DataFrame:
    return distances(sims).select("sim", F.round("dist", 6).alias("dist"))


def abc_reject(sims: DataFrame) -> DataFrame:
    return kept(distances(sims)).select("sim", "rn", F.round("dist", 6).alias("dist"))


def bayes_factor(sims: DataFrame) -> DataFrame:
    """Posterior odds of a large theta over its prior odds."""
    dist, over = checkpointed(distances(sims)), F.avg(F.when(F.col("theta") > 150000, 1.0).otherwise(0.0))
    post, prior = kept(dist).agg(over).first()[0], dist.agg(over.alias("b"))
    odds = None if post == 1 else post / (1 - post)
    return prior.select(F.round(F.lit(odds) / F.expr("nullif(b / nullif(1 - b, 0), 0)"), 6).alias("bf"))


def posterior_quantiles(sims: DataFrame) -> DataFrame:
    found = quantiles(kept(distances(sims)), ["theta"], [0.025, 0.5, 0.975])
    return found.select(*[F.round(F.col("q")[i], 2).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


def quantiles_exact(pairs: DataFrame) -> DataFrame:
    found = quantiles(pairs, ["dp"], [0.1, 0.5, 0.9, 0.999], ["body"])
    return found.select("body", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q10", "q50", "q90", "q999"))])


def transcript_dxy(annot: DataFrame) -> DataFrame:
    annot = checkpointed(annot.select("tx", "den"))
    mid = _wide(quantiles(annot, ["den"], [0.5], ["tx"]), ["tx"], {"mid": ("den", 0)})
    means = annot.groupBy("tx").agg(F.count("*").alias("n"), F.round(F.avg("den"), 6).alias("dxy"))
    return means.join(mid, "tx", "left").select("tx", "n", "dxy", F.round("mid", 6).alias("mid"))


def transcript_ratio(annot: DataFrame, hudson: DataFrame) -> DataFrame:
    """Mean divergence of a transcript over that of the window that holds its median site."""
    annot = checkpointed(annot.select("chrom", "tx", "pos", "den"))
    mid = _wide(quantiles(annot, ["pos"], [0.5], ["chrom", "tx"]), ["chrom", "tx"], {"mid": ("pos", 0)})
    own = annot.groupBy("chrom", "tx").agg(F.avg("den").alias("own")).join(mid, ["chrom", "tx"]).withColumn("win", F.floor(F.col("mid") / 100000))
    around = hudson.groupBy("chrom", F.floor(F.col("pos") / 100000).alias("win")).agg(F.avg("den").alias("around"))
    return own.join(around, ["chrom", "win"], "left").select("chrom", "tx", F.round(F.col("own") / F.expr("nullif(around, 0)"), 6).alias("ratio"))


def density_match(windows: DataFrame) -> DataFrame:
    """Windows outside the body whose density lies between the body's 10 % and 90 % quantiles."""
    windows = checkpointed(windows)
    found = _wide(quantiles(windows.filter("body = 1"), ["density"], [0.1, 0.9]), [], {"lo": ("density", 0), "hi": ("density", 1)})
    # One row.
    return windows.filter("body = 0").crossJoin(F.broadcast(found)).filter("density between lo and hi").select("chrom", "win", F.round("density", 9).alias("density"))


def class_outliers(windows: DataFrame) -> DataFrame:
    """Windows of the body far below the others' median in one class and not in the other, in standard deviations."""
    windows = checkpointed(windows.withColumn("r", F.expr("h_a / nullif(h_b, 0)")))
    outer, inner = windows.filter("body = 0"), windows.filter("body = 1")
    mid = _wide(quantiles(windows, ["h_a", "h_b", "r"], [0.5], ["body"]), ["body"], {"ma": ("h_a", 0), "mb": ("h_b", 0), "mr": ("r", 0)})
    a = outer.agg(F.stddev_samp("h_a").alias("sa"), F.stddev_samp("h_b").alias("sb")).crossJoin(mid.filter("body = 0").select("ma", "mb"))
    b = inner.agg(F.stddev_samp("r").alias("sr")).crossJoin(mid.filter("body = 1").select("mr"))
    far = inner.crossJoin(F.broadcast(a.crossJoin(b)))
    z = lambda x, m, s: F.expr(f"({x} - {m}) / nullif({s}, 0)")
    far = far.withColumns({"z_a": z("h_a", "ma", "sa"), "z_b": z("h_b", "mb", "sb"), "z_block": z("r", "mr", "sr")})
    only = lambda x, y: F.when((F.col(x) < -2) & (F.col(x) < F.col(y) - 1), 1).otherwise(0)
    return far.select("chrom", "win", F.round("z_a", 6).alias("z_a"), F.round("z_b", 6).alias("z_b"), only("z_a", "z_b").alias("only_a"), only("z_b", "z_a").alias("only_b"), F.round("z_block", 6).alias("z_block"))


#: Query -> (function, views that it reads).
FRAMES = {
    "robust_scale": (robust_scale, ["v_sim"]),
    "abc_distance": (abc_distance, ["v_sim"]),
    "abc_reject": (abc_reject, ["v_sim"]),
    "bayes_factor": (bayes_factor, ["v_sim"]),
    "posterior_quantiles": (posterior_quantiles, ["v_sim"]),
    "quantiles_exact": (quantiles_exact, ["v_pair"]),
    "transcript_dxy": (transcript_dxy, ["v_annot"]),
    "transcript_ratio": (transcript_ratio, ["v_annot", "v_hudson"]),
    "density_match": (density_match, ["v_density"]),
    "class_outliers": (class_outliers, ["v_classwin"]),
}
