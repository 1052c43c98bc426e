"""As-of and interpolation joins of two tables of any size, and moving averages over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions.ordered import scanned


def asof_join(left: DataFrame, right: DataFrame, keys: dict[str, str], at: tuple[str, str], values: list[str]) -> DataFrame:
    """The rows of ``left`` with ``before`` and ``after``: structs of the nearest rows of ``right`` of the same keys.

    ``keys``: left name -> right name; ``at``: the ordered columns of both.  ``before``
    is the last row at or before the left row's place, ``after`` the first one beyond
    it; each has ``at`` (the right row's place) and ``values``, and is null if there is
    none.  Of right rows at one place the one with the greatest values counts as the
    last.  Null keys and places match nothing.  The union of both is cut into ranges
    of key and place, and rows are carried over their borders, so a key may hold any
    share of either table.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    struct = F.struct(F.col(at[1]).alias("at"), *[F.col(v) for v in values])
    known = right.na.drop(subset=[*keys.values(), at[1]])
    rows = known.select(*[F.col(k).alias(n) for k, n in zip(keys.values(), names)], F.col(at[1]).alias("_at"), F.lit(0).alias("_asks"), struct.alias("_right"))
    asks = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(at[0]).alias("_at"), F.lit(1).alias("_asks"), F.struct("*").alias("_left"))
    both = rows.unionByName(asks, allowMissingColumns=True)
    placed = scanned(both, names, ["_at", "_asks", "_right"], last=["_right"], next=["_right"]).filter("_asks = 1")
    sound = F.lit(True)
    for n in [*names, "_at"]:
        sound = sound & F.col(n).isNotNull()
    return placed.select("_left.*", F.when(sound, F.col("last__right")).alias("before"), F.when(sound, F.col("next__right")).alias("after"))


def interpolated(place: Column, value: str) -> Column:
    """A value between ``before`` and ``after``, linear in the place; beyond the last row it holds, before the first it is null."""
    b, a = F.col("before"), F.col("after")
    number = lambda c: c.cast("double")
    slope = (a[value] - b[value]) / (number(a["at"]) - number(b["at"]))
    return F.when(a.isNull(), b[value]).otherwise(b[value] + slope * (number(place) - number(b["at"])))


def _events(events: DataFrame) -> DataFrame:
    """Events stand in a month after the last order, so each is moved back to where orders are, by (event_id mod 80) months of 30 days and 900 days."""
    return events.select("event_id", F.col("user_id").cast("long").alias("user_id"), F.expr("cast(ts - make_dt_interval(cast(900 + event_id % 80 * 30 as int)) as timestamp)").alias("at"))


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_totalprice").cast("double").alias("o_totalprice"))


def asof_step(events: DataFrame, orders: DataFrame) -> DataFrame:
    """The last order of the user at or before each event, as a step function of time."""
    found = asof_join(_events(events), _orders(orders), {"user_id": "o_custkey"}, ("at", "day"), ["o_orderkey", "o_totalprice"])
    return found.select("event_id", F.col("before.o_orderkey").alias("o_orderkey"), F.round("before.o_totalprice", 2).alias("price")).filter("o_orderkey is not null")


def interp_linear(events: DataFrame, orders: DataFrame) -> DataFrame:
    """The price between the user's last and next order, linear in time; one price for each day, the greatest."""
    daily = _orders(orders).groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("price"))
    found = asof_join(_events(events), daily, {"user_id": "o_custkey"}, ("at", "day"), ["price"])
    return found.filter("before is not null").select("event_id", F.round(interpolated(F.col("at"), "price"), 4).alias("price"))


def smooth3(windows: DataFrame) -> DataFrame:
    """Sum of a window and its neighbours over 3; beyond the ends stand zeros."""
    near = scanned(windows.select("win", "dxy"), [], ["win"], last=["dxy"], next=["dxy"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return near.select("win", F.round((zero("last_dxy") + zero("dxy") + zero("next_dxy")) / 3, 6).alias("smooth"))


def block_jackknife(blocks: DataFrame) -> DataFrame:
    """Ratio of sums with its leave-one-block-out estimate and error: totals once, as one row that meets the blocks."""
    total = blocks.agg(F.sum("num").alias("_n"), F.sum("den").alias("_d"))
    each = blocks.crossJoin(F.broadcast(total)).select((F.col("_n") / F.col("_d")).alias("t"), ((F.col("_n") - F.col("num")) / (F.col("_d") - F.col("den"))).alias("loo"))
    found = each.agg(F.max("t").alias("theta"), F.count("*").alias("b"), F.avg("loo").alias("m"), F.var_pop("loo").alias("v"))
    return found.select(F.round("theta", 6).alias("theta"), F.round(F.col("b") * F.col("theta") - (F.col("b") - 1) * F.col("m"), 6).alias("est"), F.round(F.sqrt((F.col("b") - 1) * F.col("v")), 6).alias("se"))


FRAMES = {
    "asof_step": (asof_step, ["events", "orders"]),
    "interp_linear": (interp_linear, ["events", "orders"]),
    "smooth3": (smooth3, ["v_win"]),
    "block_jackknife": (block_jackknife, ["v_block"]),
}
