"""Simulated genealogies as queries: ages, diversity, trees, events and genotypes of seeded replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.operators.forest import Forest, breakpoints
from strandlake.simulation import trajectory
from strandlake.simulation.runs import Tables, numbers, replicates, run, status
from strandlake.simulation.spec import Inversion, Spec, Sweep

_CENTRE = 5000.0
MODELS = {
    "sim_panmictic": (Spec(((0, "", 10),)), 2000),
    "sim_barrier": (Spec(((0, "S", 1), (0, "I", 1)), inversions=(Inversion(0, 1, 3000.0, 0.3),)), 2000),
    # One base in the centre of 10,000, which a tract of fixed length 500 covers with probability 500 / 9500.
    "sim_flux": (Spec(((0, "S", 1), (0, "I", 1)), inversions=(Inversion(-5000, 5000, frequency=0.5, flux=0.019 / 500, tract=500.0, fixed=True),)), 1000),
    "sim_two_pop_split": (Spec(((0, "", 1), (1, "", 1)), sizes=(1000.0, 1000.0), events=(("ej", 2500.0, 1, 0),)), 2000),
    "sim_migration": (Spec(((0, "", 1), (1, "", 1)), sizes=(1000.0, 1000.0), migration=((0, 1e-3), (1e-3, 0))), 2000),
    "sim_bottleneck": (Spec(((0, "", 2),), events=(("en", 500.0, 0, 100.0), ("en", 600.0, 0, 1000.0))), 2000),
    "sim_growth": (Spec(((0, "", 2),), growth=(1e-3,)), 2000),
    "sim_class_migration": (Spec(((0, "I", 2), (1, "S", 1)), sizes=(1000.0, 1000.0), inversions=(Inversion(0, 1, 4000.0, 0.4),), events=(("cmig", 200.0, 0, 1, "I", 0, 0.5), ("ej", 3000.0, 1, 0))), 1000),
    "sim_recombination": (Spec(((0, "", 10),), length=1e5, recombination=5e-8), 100),
    "sim_nested": (Spec(((0, "SS", 5), (0, "II", 5)), length=1e4, recombination=1e-7, inversions=(Inversion(0, 1e4, 4000.0, 0.4), Inversion(3000, 7000, 2000.0, 0.5, flux=1e-6))), 200),
    "sim_trajectory": (Spec(((0, "I", 5), (0, "S", 5)), inversions=(Inversion(0, 1, 3000.0, path=trajectory.balancing(0.6, 0.001, 0.005, 3000.0, 60)),)), 500),
    "sim_sweep": (Spec(((0, "", 8),), length=1e4, recombination=1e-7, sweep=Sweep(_CENTRE, 0, trajectory.sweep(50.0, 0.1, 1000.0))), 100),
}


def ages(tables: Tables, place: float = 0.0) -> DataFrame:
    """Replicates, mean and error of the age of the common ancestor at a place, and mean number of trees."""
    at = tables.edges.filter((F.col("l") <= place) & (F.col("r") > place))
    top = at.join(tables.nodes.select("rep", F.col("node").alias("parent"), "time"), ["rep", "parent"]).groupBy("rep").agg(F.max("time").alias("tmrca"))
    trees = tables.edges.groupBy("rep").agg((F.count_distinct("l")).alias("trees"))
    columns = [F.count("*").alias("reps"), F.round(F.avg("tmrca"), 6).alias("mean_tmrca"), F.round(F.stddev("tmrca") / F.sqrt(F.count("*")), 6).alias("error"), F.round(F.avg("trees"), 6).alias("mean_trees")]
    return top.join(trees, "rep").agg(*columns)


def forest(tables: Tables) -> Forest:
    """Marginal trees of all replicates; samples of even numbers are group a, the others b."""
    return Forest(tables.nodes, tables.edges, ["rep"], a=F.col("sample") % 2 == 0, b=F.col("sample") % 2 == 1)


def branch_stats(spark: SparkSession) -> DataFrame:
    """Span-weighted branch diversity and divergence of replicates with recombination."""
    spec, _ = MODELS["sim_recombination"]
    trees = forest(run(spark, spec, 20))
    spans = breakpoints(trees.edges, ["rep"]).select("rep", F.col("l").alias("tree"), (F.col("r") - F.col("l")).alias("span"))
    both = trees.diversity().join(trees.divergence(), ["rep", "tree"]).join(spans, ["rep", "tree"])
    return both.groupBy("rep").agg(F.count("*").alias("trees"), F.round(F.sum(F.col("pi") * F.col("span")) / spec.length, 4).alias("pi"), F.round(F.sum(F.col("dxy") * F.col("span")) / spec.length, 4).alias("dxy"))


def genotype_spectrum(spark: SparkSession) -> DataFrame:
    """Unfolded spectrum of the mutations of replicates, from their genotype matrices."""
    spec = Spec(((0, "", 10),), length=1e4, recombination=1e-8, mutation=1e-7)
    tables = run(spark, spec, 50)
    carriers = forest(tables).genotypes(tables.mutations).groupBy("rep", "site").agg(F.count("*").alias("k"))
    return carriers.groupBy("k").agg(F.count("*").alias("n"))


def simplified_size(spark: SparkSession) -> DataFrame:
    """Edges before and after simplification, by replicate."""
    tables = run(spark, MODELS["sim_nested"][0], 10)
    before = tables.edges.groupBy("rep").agg(F.count("*").alias("edges"))
    return before.join(forest(tables).simplified().groupBy("rep").agg(F.count("*").alias("kept")), "rep")


def event_log(spark: SparkSession) -> DataFrame:
    spec = Spec(((0, "S", 5), (0, "I", 5)), length=1e4, recombination=1e-8, inversions=(Inversion(0, 1e4, 8000.0, 0.4, flux=1e-6),))
    return run(spark, spec, 200).events.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("time"), 6).alias("mean_time"), F.round(F.avg(F.col("r") - F.col("l")), 6).alias("mean_tract"))


def outcomes(spark: SparkSession) -> DataFrame:
    """Outcome and number of replicates, of which two demes without a way between them have none that ends."""
    apart = Spec(((0, "", 1), (1, "", 1)), sizes=(1000.0, 1000.0))
    rows = replicates(numbers(spark, 5), apart).unionByName(replicates(numbers(spark, 5), MODELS["sim_panmictic"][0]))
    return status(rows).select("status", "n")


def queries() -> dict:
    found = {name: lambda spark, sf_dir, spec=spec, reps=reps: ages(run(spark, spec, reps), _CENTRE if spec.length >= 1e4 else 0.0) for name, (spec, reps) in MODELS.items()}
    more = {"sim_branch_stats": branch_stats, "sim_genotypes": genotype_spectrum, "sim_simplify": simplified_size, "sim_event_log": event_log, "sim_status": outcomes}
    return found | {name: lambda spark, sf_dir, f=f: f(spark) for name, f in more.items()}
