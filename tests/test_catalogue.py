"""A query of each family against its DuckDB twin."""

import duckdb
import pandas as pd
import pytest

from strandlake.plans import catalogue
from strandlake.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
NAMES = "window_ratio_fst dp_ladder tag_algebra cube_regions neighbour_support pi_windows fst_windows sfs_project sfs2d_summary h_stats interval_join mask_intersect_bp nearest_gene interp_linear tandem_collapse block_jackknife bh_fdr ks_stat seed_for corr_spearman branch_diversity tmrca colless phi_profile traj_decline abc_reject profile_min".split()

#: And all whose twin is written apart, or that are functions of frames.
NAMES += sorted({*ORACLES, *catalogue.FRAMES} & {*catalogue.oracle_sql()} - {*NAMES})


def rows(frame):
    def plain(v):
        return "" if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) + 0.0

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in catalogue.TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_stands_alone(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_coverage_of_three_tracts(spark, tmp_path):
    # Closed tracts [100, 200], [150, 250], [300, 400].
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    at = datetime.datetime(2020, 1, 1)
    pq.write_table(pa.table({"event_id": pa.array([80, 380, 680], pa.int64()), "ts": [at] * 3, "user_id": pa.array([1, 2, 3], pa.int64()), "event_type": ["click"] * 3, "value": [10.0, 15.0, 30.0], "props": ["{}"] * 3}), tmp_path / "events.parquet")
    steps = sorted((r.x, r.depth) for r in catalogue.queries()["coverage_at"](spark, str(tmp_path)).collect())
    depth = lambda x: ([d for p, d in steps if p <= x] or [0])[-1]
    assert [depth(x) for x in (175, 100, 350, 50, 200, 201, 401)] == [2, 1, 1, 0, 2, 1, 0]
    total = {r.inv: (r.n, r.total) for r in catalogue.queries()["tract_len"](spark, str(tmp_path)).collect()}
    assert total == {1: (2, 200), 0: (1, 100)}


def test_no_twin_without_a_query():
    import __spark_entry__

    queries, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert twins.keys() <= queries.keys()
    assert all(n.startswith(("sim_", "op", "abc_adjusted", "pipeline")) for n in queries.keys() - twins.keys())


def test_ranks_without_gathering(spark):
    from pyspark.sql import functions as F

    from strandlake.functions.ordered import running

    frame = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("x"))
    got = sorted((r.x, r["rank"], r.total) for r in running(frame, [F.col("x")], total=F.col("x")).collect())
    total = 0
    for k, x in enumerate(sorted(i * 7919 % 5003 for i in range(5000))):
        total += x
        assert got[k] == (x, k + 1, total)
    assert running(frame.limit(0), [F.col("x")], total=F.col("x")).count() == 0
