"""Closed forms and deterministic paths as expressions over the sizes of parts and the times of events."""

from pyspark.sql import Column, DataFrame, functions as F

#: Frequencies from the sizes of parts, which are 1 to 50, and times from the values of events.
_X = "(SELECT p_partkey AS id, p_size / 51.0e0 AS x FROM part)"


def _t(last: int) -> str:
    return f"(SELECT event_id AS id, CAST(floor(value * 10) AS BIGINT) % {last + 1} AS i FROM events)"


QUERIES = {
    "phi_profile": f"SELECT id, x, round(least(1.0e0, greatest(0.0e0, least(least(x, 1 - x), 0.1e0) / 0.9e0)), 6) AS phi FROM {_X}",
    "phi_integral": f"SELECT id, x, round(CASE WHEN x <= 0.1e0 THEN x * x / 2 / 0.9e0 WHEN x <= 0.9e0 THEN (0.005e0 + 0.1e0 * (x - 0.1e0)) / 0.9e0 ELSE (0.005e0 + 0.08e0 + 0.005e0 - (1 - x) * (1 - x) / 2) / 0.9e0 END, 6) AS area FROM {_X}",
    "site_cover_rate": f"SELECT id, x, round(1.0e-5 * 300 * least(least(x, 1 - x), 0.1e0) / 0.9e0 + 1.0e-7 * 5000 * least(least(x, 1 - x), 0.3e0) / 0.7e0, 9) AS rate FROM {_X}",
    "logistic_path": f"SELECT id, i AS t, round(0.01e0 * exp(0.02e0 * i) / (1 - 0.01e0 + 0.01e0 * exp(0.02e0 * i)), 6) AS p FROM {_t(500)}",
    "time_to_reach": """SELECT id, x, round((f - f0) / c, 4) AS t FROM (SELECT id, x, ln(x) / 0.626e0 + ln(1 - x) / 0.374e0 - ln(abs(0.626e0 - x)) / (0.626e0 * 0.374e0) AS f, ln(0.01e0) / 0.626e0 + ln(0.99e0) / 0.374e0 - ln(0.616e0) / (0.626e0 * 0.374e0) AS f0, 0.02e0 / 0.626e0 AS c FROM (SELECT p_partkey AS id, p_size / 82.0e0 AS x FROM part))""",
    "size_at": f"""SELECT id, t, round(n0 * exp(0 - alpha * (t - t0)), 6) AS n FROM (SELECT id, i * 1.0e0 AS t, CASE WHEN i >= 1000 THEN 1000.0e0 WHEN i >= 600 THEN 600.0e0 ELSE 0.0e0 END AS begin_ FROM {_t(1500)}) JOIN v_size ON t0 = begin_""",
    "theory_closed_form": f"SELECT id, x, round(2 * 1000 * x + 4000 * (1 - x), 6) AS within_s, round(4000 + 2 * 1000, 6) AS between_, round((4000 + 2 * 1000.0e0) / (2 * 1000 * x + 4000 * (1 - x)), 6) AS ratio FROM {_X}",
    # A hazard that falls with time, as often as events stand there; at most 401 bins.
    "theory_expected_times": "SELECT i AS t, round(exp(-sum(c * 0.01e0 / (1 + i * 0.001e0)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM (SELECT CAST(floor(value) AS BIGINT) % 401 AS i, count(*) / 100.0e0 AS c FROM events GROUP BY CAST(floor(value) AS BIGINT) % 401)",
    "hitting_time": f"SELECT id, x, round(4 * 1000 / x * (x + (1 - x) * ln(1 - x)), 6) AS t, round(1 / (2 * 1000 * x), 9) AS reach FROM {_X}",
    "drift_sd": f"""SELECT id, x, round(sqrt(x * (1 - x) * v), 6) AS sd, round(sqrt(x / (4 * 1000 * 0.01e0)), 6) AS stationary FROM {_X} CROSS JOIN (SELECT sum((y + z) / 2) AS v FROM (SELECT 1 / (2 * 1000 * exp(0 - 0.001e0 * i)) AS y, 1 / (2 * 1000 * exp(0 - 0.001e0 * (i + 1))) AS z FROM (SEQ(0;199))))""",
    "kim_stephan": f"SELECT id, x, round(2 / x * ln(2 * 1000), 6) AS t, round(2 * x / (1 + x), 6) AS fix, round(1 - exp(-1.0e-3 * x * 2 / x * ln(2 * 1000)), 6) AS escape FROM {_X}",
    "andolfatto": f"SELECT id, i AS t, round(1 - exp(-0.001e0 * i), 6) AS e, round(exp(-0.001e0 * i) / (1 + exp(-0.001e0 * i)), 6) AS share FROM {_t(500)}",
    "jukes_cantor": "SELECT id, i AS k, round(0.0e0 - 0.75e0 * ln(1 - 4 * (i / 100.0e0) / 3), 6) AS d FROM (SELECT p_partkey AS id, p_size + 20 AS i FROM part)",
    "traj_balancing": f"SELECT id, i AS t, round(0.4e0 / (1 + (0.4e0 / 0.001e0 - 1) * exp(-0.02e0 * i)), 6) AS p FROM {_t(600)}",
    "traj_decline": f"SELECT id, i AS t, round(CASE WHEN i < 100 THEN 0.6e0 WHEN i < 300 THEN 0.6e0 - 0.5e0 * (i - 100) / 200 ELSE 0.1e0 END, 6) AS p FROM {_t(400)}",
    "traj_bifurcate": f"SELECT id, pop, i AS t, round(CASE WHEN i < 200 THEN 0.5e0 WHEN pop = 0 THEN 0.5e0 + 0.4e0 * (1 - exp(-0.01e0 * (i - 200))) ELSE 0.5e0 - 0.4e0 * (1 - exp(-0.01e0 * (i - 200))) END, 6) AS p FROM {_t(500)} CROSS JOIN (SELECT 0 AS pop UNION ALL SELECT 1)",
    # Two-sided normal quantiles at 0.05 / m; each brand takes the least m that covers its number of types.
    "bonferroni_z": """SELECT tx, tests, min(m) AS m, min(z) AS z FROM (SELECT p_brand AS tx, count(DISTINCT p_type) AS tests FROM part GROUP BY p_brand) JOIN (SELECT 1 AS m, 1.959964e0 AS z UNION ALL SELECT 5, 2.575829e0 UNION ALL SELECT 10, 2.807034e0 UNION ALL SELECT 50, 3.290527e0 UNION ALL SELECT 100, 3.480756e0 UNION ALL SELECT 1000, 4.055627e0) ON m >= tests GROUP BY tx, tests""",
}


def reach_time(p: Column, start: float, rate: float, top: float) -> Column:
    """Generations from ``start`` to ``p`` under overdominance with equilibrium ``top``, by partial fractions."""

    def inner(x: Column) -> Column:
        return F.ln(x) / top + F.ln(1 - x) / (1 - top) - F.ln(F.abs(top - x)) / (top * (1 - top))

    return (inner(p) - inner(F.lit(start))) / (rate / top)


def bisected(target: Column, below, low: Column, high: Column, rounds: int = 60) -> Column:
    """Where a rising function ``below(x)`` reaches ``target``: halves [low, high] so many times."""

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        less = below(middle) < target
        return F.struct(F.when(less, middle).otherwise(state["lo"]).alias("lo"), F.when(less, state["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(low.alias("lo"), high.alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)


def bisect_root(part: DataFrame) -> DataFrame:
    """The frequency that overdominance reaches in eight generations for each unit of a part's size."""
    times = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 8.0).alias("t"))
    p = bisected(F.col("t"), lambda x: reach_time(x, 0.01, 0.02, 0.626), F.lit(0.01), F.lit(0.626 * (1 - 1e-12)))
    return times.select("id", "t", F.round(p, 6).alias("p"))


FRAMES = {"bisect_root": (bisect_root, ["part"])}
