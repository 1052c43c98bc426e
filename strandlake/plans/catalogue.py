"""All queries of the engine, as SQL texts or functions of DataFrames, and their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strandlake.functions.dialect import render
from strandlake.functions.fixtures import VIEWS
from strandlake.operators import fitting, forest, inference, intervals, nearest, ordered, resample, selection, simulate, sites, spectra, testing, theory, trees
from strandlake.plans.oracles import ORACLES
from strandlake.sources import roundtrip

#: Query -> (function, tables or views that it takes).
FRAMES = ordered.FRAMES | selection.FRAMES | nearest.FRAMES | testing.FRAMES | roundtrip.FRAMES | forest.FRAMES | theory.FRAMES | inference.FRAMES
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES = {k: v for module in (sites, spectra, intervals, resample, trees, theory, fitting, inference) for k, v in module.QUERIES.items()}


def _names(sql: str, among) -> list[str]:
    return [n for n in among if re.search(rf"\b{n}\b", sql)]


def complete(sql: str) -> str:
    """The query with the views that it needs, each after those it uses."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text, VIEWS):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not views:
        return sql
    own = re.match(r"WITH (RECURSIVE )?", sql)
    return f"WITH {own[1] or ''}{views}, {sql[own.end() :]}" if own else f"WITH {views} {sql}"


def _query(sql: str):
    text = render(complete(sql), 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in _names(text, TABLES):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(text)

    return run


def _framed(function, inputs: list[str]):
    views = [_query(f"SELECT * FROM {name}") for name in inputs]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(*[view(spark, sf_dir) for view in views]) if views else function(spark)

    return run


def queries() -> dict:
    found = {name: _query(sql) for name, sql in QUERIES.items() if name not in FRAMES}
    return found | {name: _framed(*frame) for name, frame in FRAMES.items()} | simulate.queries()


def oracle_sql() -> dict[str, str]:
    return {name: render(complete(sql), 1) for name, sql in (QUERIES | ORACLES).items()}
