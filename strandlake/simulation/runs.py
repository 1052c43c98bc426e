"""Replicates as Spark rows: fan-out, status, resume, and the tables of what was simulated."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.functions.ordered import checkpointed
from strandlake.simulation.kernel import simulate
from strandlake.simulation.spec import Spec

#: One row of any kind: node (id a, b: is a sample), edge (parent a, child b), event, mutation (node a) or status.
ROWS = "rep long, kind string, time double, pop int, a long, b long, l double, r double, name string"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Rows that a task hands over at once.
BATCH = 20_000


def made(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"rep": "int64", "pop": "Int32", "a": "Int64", "b": "Int64", "time": float, "l": float, "r": float})


def rows_of(spec: Spec, seed: int, rep: int) -> list[tuple]:
    """All rows of a replicate; one that fails is a status row alone."""
    began = time.time()
    try:
        found = simulate(spec, seed, rep)
        out = [(rep, "node", t, pop, k, int(sample), None, None, None) for k, (t, pop, sample) in enumerate(found.nodes)]
        out += [(rep, "edge", None, None, parent, child, left, right, None) for left, right, parent, child in found.edges]
        out += [(rep, "event", t, pop, node, None, left, right, name) for t, name, pop, node, left, right in found.log]
        if spec.mutation:
            out += [(rep, "mutation", t, None, node, k, x, x, None) for k, (x, node, t) in enumerate(found.mutations(spec.mutation))]
        state = "ok"
    except (ValueError, RuntimeError) as problem:
        out, state = [], f"failed: {problem}"
    return [*out, (rep, "status", time.time() - began, None, None, None, None, None, state)]


def replicates(reps: DataFrame, spec: Spec, seed: int = 1) -> DataFrame:
    """Rows of the replicates whose numbers are in ``rep``; each has a random stream of its own, whatever the partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            for rep in frame["rep"]:
                rows += rows_of(spec, seed, int(rep))
                if len(rows) > BATCH:
                    yield made(rows)
                    rows = []
        yield made(rows)

    return reps.select("rep").mapInPandas(run, ROWS)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """Replicate numbers, spread so that a task has few."""
    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "rep")


def resumed(spark: SparkSession, spec: Spec, n: int, folder: str, seed: int = 1, batch: int = 1000) -> DataFrame:
    """All rows of n replicates kept as Parquet in ``folder``; only those that are not there are run, in batches.

    A batch is appended as a whole, so a job that is lost costs one batch.  Failed
    replicates are status rows and are not run again.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    for begin in range(0, n, batch):
        wanted = numbers(spark, n).filter((F.col("rep") >= begin) & (F.col("rep") < begin + batch))
        if there:
            done = spark.read.schema(ROWS).parquet(folder).filter("kind = 'status'").select("rep")
            wanted = wanted.join(done, "rep", "left_anti")
        if wanted.limit(1).count():
            replicates(wanted, spec, seed).write.mode("append").parquet(folder)
            there = True
    return spark.read.schema(ROWS).parquet(folder).filter(F.col("rep") < n)


def status(rows: DataFrame) -> DataFrame:
    """Replicates and seconds by outcome."""
    outcome = F.when(F.col("name") == "ok", "ok").otherwise("failed").alias("status")
    return rows.filter("kind = 'status'").groupBy(outcome).agg(F.count("*").alias("n"), F.round(F.avg("time"), 4).alias("mean_wall"), F.round(F.max("time"), 4).alias("max_wall"))


class Tables:
    """Nodes, edges, events and mutations of replicates, simulated once."""

    def __init__(self, rows: DataFrame):
        rows = checkpointed(rows)
        self.status = status(rows)
        self.nodes = rows.filter("kind = 'node'").select("rep", F.col("a").alias("node"), "time", "pop", F.col("b").alias("is_sample"))
        self.edges = rows.filter("kind = 'edge'").select("rep", "l", "r", F.col("a").alias("parent"), F.col("b").alias("child"))
        self.events = rows.filter("kind = 'event'").select("rep", "time", F.col("name").alias("kind"), "pop", F.col("a").alias("node"), "l", "r")
        self.mutations = rows.filter("kind = 'mutation'").select("rep", F.col("b").alias("site"), F.col("l").alias("position"), F.col("a").alias("node"), "time")


def run(spark: SparkSession, spec: Spec, n: int, seed: int = 1) -> Tables:
    return Tables(replicates(numbers(spark, n), spec, seed))
