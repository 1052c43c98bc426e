"""Ranks, running totals and neighbours over a whole table, without gathering it in one task.

Rows are range-partitioned by the order and sorted in their partitions; a table of
one row per partition carries totals and values over its borders.  The sorted rows
are checkpointed, as the bounds of the ranges are sampled and a task that runs
again must find them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows up to which one task may order a table.
FEW = 1 << 14


def shared_folder(df: DataFrame) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one in local mode where none is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the folder that the cluster shares."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], **totals: Column) -> DataFrame:
    """Adds ``rank`` (from 1) and, for each named column, its running sum in the order.

    ``order`` should be unique; ties are broken as Spark sorts them.  Nulls come first
    and count as 0 in a sum.
    """
    named = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_{n}") for n, c in totals.items()])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    sums = ordered.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_{t}").alias(f"_{t}") for t in totals])
    carried = sums.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *[F.coalesce(F.sum(f"_{t}").over(before), F.lit(0)).alias(f"_b_{t}") for t in totals])
    ranked = ordered.join(F.broadcast(carried), "_part")
    new = [(F.count("*").over(inside) + F.col("_b")).alias("rank"), *[(F.sum(f"_{t}").over(inside) + F.col(f"_b_{t}")).alias(t) for t in totals]]
    return ranked.select(*df.columns, *new)


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), last: Sequence[str] = (), next: Sequence[str] = ()) -> DataFrame:
    """Adds running sums and neighbours' values, key by key, in ascending order of ``order``.

    ``upto_x``: the sum of column x from the key's first row to this one (null: 0);
    ``last_x`` and ``next_x``: the nearest value of x that is not null among the rows of
    the key strictly before and after this one.  ``order`` should be unique within a
    key; nulls come first.  A key may hold any share of the rows: it is cut by ranges
    of the order like all others, and what a range begins with is carried over from
    those before it.  Tables of at most FEW rows are ordered by a plain window.
    """
    rows = checkpointed(df)
    if rows.count() <= FEW:
        plain = Window.partitionBy(*keys).orderBy(*order)
        before, after = plain.rowsBetween(Window.unboundedPreceding, -1), plain.rowsBetween(1, Window.unboundedFollowing)
        new = [F.coalesce(F.sum(c).over(plain.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(f"upto_{c}") for c in sums]
        new += [F.last(c, ignorenulls=True).over(before).alias(f"last_{c}") for c in last] + [F.first(c, ignorenulls=True).over(after).alias(f"next_{c}") for c in next]
        return rows.select("*", *new)
    n, by = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, *order]
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = checkpointed(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_none"))
    ends = rows.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_final"))
    # What each range hands on: of its final key forwards, of its first key backwards.  One row for each range.
    tied = rows.join(F.broadcast(ends), "_part")
    row = lambda c, end: F.when((key == F.col(end)) & F.col(c).isNotNull(), F.col("_row"))
    hands = [F.sum(F.when(key == F.col("_final"), F.col(c))).alias(f"_sum_{c}") for c in sums]
    hands += [F.max_by(c, row(c, "_final")).alias(f"_last_{c}") for c in last]
    hands += [F.min_by(c, row(c, "_first")).alias(f"_next_{c}") for c in next]
    borders = tied.groupBy("_part", "_first", "_final").agg(*hands)

    def handed(gives: str, takes: str, values: list[str], forwards: bool, how) -> DataFrame:
        """For each range, what ranges before it (or after it) hand on to the key that it begins (or ends) with."""
        asks = borders.select("_part", F.col(takes).alias("_key"), F.lit(0).alias("_gives"), *[F.lit(None).cast(borders.schema[v].dataType).alias(v) for v in values])
        given = borders.select("_part", F.col(gives).alias("_key"), F.lit(1).alias("_gives"), *values)
        along = Window.partitionBy("_key").orderBy(F.col("_part") if forwards else F.desc("_part"), "_gives").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return asks.union(given).select("_part", "_gives", *[how(v).over(along).alias(v.replace("_", "_over_", 1)) for v in values]).filter("_gives = 0").drop("_gives")

    out = tied
    if sums:
        out = out.join(F.broadcast(handed("_final", "_first", [f"_sum_{c}" for c in sums], True, F.sum)), "_part")
    if last:
        out = out.join(F.broadcast(handed("_final", "_first", [f"_last_{c}" for c in last], True, lambda v: F.last(v, ignorenulls=True))), "_part")
    if next:
        out = out.join(F.broadcast(handed("_first", "_final", [f"_next_{c}" for c in next], False, lambda v: F.last(v, ignorenulls=True))), "_part")
    inside = Window.partitionBy("_part", *keys).orderBy("_row")
    first, final = key == F.col("_first"), key == F.col("_final")
    new = [(F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.when(first, F.coalesce(F.col(f"_over_sum_{c}"), F.lit(0))).otherwise(0)).alias(f"upto_{c}") for c in sums]
    new += [F.coalesce(F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.when(first, F.col(f"_over_last_{c}"))).alias(f"last_{c}") for c in last]
    new += [F.coalesce(F.first(c, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)), F.when(final, F.col(f"_over_next_{c}"))).alias(f"next_{c}") for c in next]
    return out.select(*df.columns, *new)


def quantiles(df: DataFrame, values: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., ``value``, ``q``): for each named column an array of its exact quantiles, with linear interpolation between neighbours.

    One pass over the rows serves all columns and groups.  Equal values are counted
    before they are ordered, the order is cut into ranges and counts are carried over
    their borders, so neither a group nor a value gathers in one task.  Nulls and NaN
    are left out; a group or column without values has no row.
    """
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("_x")) for v in values])))
    counted = long.filter("_x is not null and not isnan(_x)").groupBy(*by, "value", "_x").agg(F.count("*").alias("_c"))
    keys = [*by, "value"]
    # Keys compare as null-safe here.
    placed = scanned(counted, keys, ["_x"], sums=["_c"], next=["_x"])
    total = placed.groupBy(*keys).agg(F.max("upto__c").alias("_n"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    sized = placed.alias("p").join(total.alias("t"), same).select("p.*", "t._n")
    parts = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("_n") - 1)
        low = F.floor(place)
        # This value holds the order statistic below the place; the one above is it too, or the next value.
        here = (F.col("upto__c") > low) & (F.col("upto__c") - F.col("_c") <= low)
        above = F.when(F.col("upto__c") > low + 1, F.col("_x")).otherwise(F.coalesce("next__x", "_x"))
        parts.append(F.max(F.when(here, F.col("_x") + (above - F.col("_x")) * (place - low))).alias(f"_q{i}"))
    return sized.groupBy(*keys).agg(*parts).select(*keys, F.array(*[f"_q{i}" for i in range(len(shares))]).alias("q"))
