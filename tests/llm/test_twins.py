"""Queries against their DuckDB twins, over whole tables."""

import duckdb
import pytest

from strandlake.llm import queries


@pytest.mark.parametrize("name, sf", [("op1_suffix_dedup", "sf0.001"), ("op8_passage_dedup", "sf0.001"), ("op9_near_dedup", "sf0.001"), ("op4_quality_rules", "sf0.001"), ("op4_quality_rules", "sf0.1"), ("op12_collocations", "sf0.001"), ("op13_hard_negatives", "sf0.001")])
def test_same_rows(spark, name, sf):
    folder, con = f"/root/testdata/{sf}", duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_cutoffs_act_at_size(spark):
    """Enough clean labels certify cutoffs that catch the labelled junk and spare clean texts."""
    folder = "/root/testdata/sf0.1"
    done = queries.queries()["op4_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "q")
    rows = {(r.q, r.kept): r["count"] for r in done.filter("not base_failed").join(labels, "doc_id").groupBy("q", "kept").count().collect()}
    assert not rows.get((0, True)) and rows[0, False] > 100 and rows.get((1, False), 0) <= 0.005 * rows[1, True]
