"""Exact and asymptotic test statistics, linkage over all distances, and pairwise differences with missing calls."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandlake.functions.ordered import running, scanned

#: Rows of the larger sample up to which the two-sample KS p-value is exact; beyond it the asymptotic series holds to more digits than are shown.
EXACT = 10_000
#: Pairs drawn for each distance bin of ``ld_sampled``, and the seed of the draw.
PAIRS, SEED = 2000, 7
#: Sites of a word in ``pairwise_missing``.
WORD = 50


def ks_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples of n and m without ties: one less the share of lattice paths that stay closer to the diagonal.

    A path of n steps up and m to the right is inside while |i / n - j / m| < d.  The
    share of paths to (i, j) that never left is i / (i + j) of that to (i - 1, j) and
    j / (i + j) of that to (i, j - 1), so each diagonal i + j follows from the last.
    """
    if not (n and m) or np.isnan(d):
        return float("nan")
    # In whole numbers: |i up - j right| < h, where up and right are m and n without their common divisor.
    common = gcd(n, m)
    up, right = m // common, n // common
    h = round(d * n * up)
    share, low, high = np.zeros(n + 2), 0, 0
    share[0] = h > 0
    i = np.arange(n + 1)
    for s in range(1, n + m + 1):
        a = max(0, s - m, (s * right - h) // (up + right) + 1)
        b = min(n, s, -((-s * right - h) // (up + right)) - 1)
        if a > b:
            return 1.0
        # share[-1] is a place that stays 0.
        before = share[a - 1 : b] if a else np.concatenate([[0.0], share[:b]])
        share[a : b + 1] = (i[a : b + 1] * before + (s - i[a : b + 1]) * share[a : b + 1]) / s
        share[low:a] = 0
        share[b + 1 : high + 1] = 0
        low, high = a, b
    return float(min(1.0, max(0.0, 1 - share[n])))


@F.pandas_udf(T.DoubleType())
def _ks_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_exact(x, int(a), int(b)) for x, a, b in zip(d, n, m)], dtype=float)


def ks_asymptotic(d: Column, n: Column, m: Column) -> Column:
    terms = [(1 if i % 2 else -1) * F.exp(F.lit(-2.0 * i * i) * n * m / (n + m) * d * d) for i in range(1, 102)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total))


def ks_table(reps: DataFrame) -> DataFrame:
    """(stat, n0, n1, ks, p): the two-sample KS statistic of the engines' values; values are counted before they are ordered."""
    counts = reps.filter("value is not null").groupBy("stat", "value").agg(F.sum(1 - F.col("engine")).alias("a"), F.sum("engine").alias("b"))
    placed = scanned(counts, ["stat"], ["value"], sums=["a", "b"])
    total = placed.groupBy("stat").agg(F.max("upto_a").alias("n0"), F.max("upto_b").alias("n1"))
    gap = F.abs(F.col("upto_a") / F.expr("nullif(n0, 0)") - F.col("upto_b") / F.expr("nullif(n1, 0)"))
    found = placed.join(total, "stat").groupBy("stat", "n0", "n1").agg(F.max(gap).alias("ks"))
    exact = (F.greatest("n0", "n1") <= EXACT) & F.col("ks").isNotNull()
    small = found.filter(exact).withColumn("p", _ks_exact("ks", "n0", "n1"))
    return small.unionByName(found.filter(~exact).withColumn("p", ks_asymptotic(F.col("ks"), F.col("n0"), F.col("n1"))))


def _verdicts(reps: DataFrame) -> DataFrame:
    """KS and Cohen's d by statistic, and what they say of the engines."""
    value = lambda e: F.when(F.col("engine") == e, F.col("value"))
    known = reps.filter("value is not null").groupBy("stat").agg(*[f(value(e)).alias(f"{n}{e}") for e in (0, 1) for n, f in (("k", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("k0") - 1) * F.col("v0") + (F.col("k1") - 1) * F.col("v1")) / F.expr("nullif(k0 + k1 - 2, 0)"))
    effect = F.when((F.col("k0") < 2) | (F.col("k1") < 2), None).when(pooled > 0, (F.col("m0") - F.col("m1")) / pooled).when(F.col("m0") == F.col("m1"), 0.0).otherwise(1e300)
    both = ks_table(reps).join(known.select("stat", "m0", "m1", effect.alias("d")), "stat")
    p, d = F.col("p"), F.abs(F.col("d"))
    said = F.when(p.isNull() | F.isnan(p) | d.isNull(), "investigate").when((p > 0.01) & (d < 0.2), "equivalent").when((p < 0.01) & (d > 0.2), "not_equivalent").otherwise("investigate")
    return both.withColumn("verdict", said)


def ks_stat(reps: DataFrame) -> DataFrame:
    return ks_table(reps).select("stat", F.round("ks", 6).alias("ks"), F.round("p", 6).alias("p"))


def verdict(reps: DataFrame) -> DataFrame:
    return _verdicts(reps).select("stat", *[F.round(c, 6).alias(c) for c in ("ks", "p", "d")], "verdict")


def equivalence_table(reps: DataFrame) -> DataFrame:
    """Replicates and means of both engines with the verdict; 'purchase' differs by convention."""
    each = lambda e: F.when(F.col("engine") == e, F.col("rep"))
    value = lambda e: F.when(F.col("engine") == e, F.col("value"))
    means = reps.groupBy("stat").agg(F.countDistinct(each(0)).alias("n_a"), F.countDistinct(each(1)).alias("n_b"), F.avg(value(0)).alias("mean_a"), F.avg(value(1)).alias("mean_b"))
    state = F.when(F.col("stat") == "purchase", "convention_diff").when((F.col("n_a") == 0) | (F.col("n_b") == 0), "skipped").otherwise(F.col("verdict"))
    return means.join(_verdicts(reps).select("stat", "verdict"), "stat").select("stat", "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), state.alias("state"))


def _ln_factorial(n: Column) -> Column:
    """ln n! for real n > -1: Stirling's series at n + 8, less ln((n + 1) ... (n + 8))."""
    z = n + 9.0
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    product = n + 1.0
    for i in range(2, 9):
        product = product * (n + float(i))
    return series - F.ln(product)


def beta_share(x: Column, a: Column, b: Column, rounds: int = 200) -> Column:
    """The regularised incomplete beta function, by its continued fraction as a fold (Lentz's method), for x in [0, 1]."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    least = 1e-300
    safe = lambda v: F.when(F.abs(v) < least, F.lit(least)).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        even = m * (state["q"] - m) * state["y"] / ((state["p"] + 2 * m - 1) * (state["p"] + 2 * m))
        d1, c1 = 1 / safe(1 + even * state["d"]), safe(1 + even / state["c"])
        odd = -(state["p"] + m) * (state["p"] + state["q"] + m) * state["y"] / ((state["p"] + 2 * m) * (state["p"] + 2 * m + 1))
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct(state["p"].alias("p"), state["q"].alias("q"), state["y"].alias("y"), c2.alias("c"), d2.alias("d"), (state["h"] * d1 * c1 * d2 * c2).alias("h"))

    d0 = 1 / safe(1 - (p + q) * y / (p + 1))
    begin = F.struct(p.alias("p"), q.alias("q"), y.alias("y"), F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    fraction = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda i: i.cast("double")), begin, step, lambda s: s["h"])
    front = F.exp(_ln_factorial(a + b - 1) - _ln_factorial(a - 1) - _ln_factorial(b - 1) + p * F.ln(y) + q * F.ln(1 - y)) / p
    value = F.when(y <= 0, 0.0).otherwise(front * fraction)
    return F.when(turned, 1 - value).otherwise(value)


def welch_t(reps: DataFrame) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p of the engines' values, for each statistic."""
    value = lambda e: F.when(F.col("engine") == e, F.col("value"))
    sums = reps.groupBy("stat").agg(*[f(value(e)).alias(f"{n}{e}") for e in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    parts = sums.filter("n0 > 1 and n1 > 1 and v0 + v1 > 0").withColumns({"e0": F.col("v0") / F.col("n0"), "e1": F.col("v1") / F.col("n1")})
    t = (F.col("m0") - F.col("m1")) / F.sqrt(F.col("e0") + F.col("e1"))
    df = F.pow(F.col("e0") + F.col("e1"), F.lit(2.0)) / (F.pow("e0", F.lit(2.0)) / (F.col("n0") - 1) + F.pow("e1", F.lit(2.0)) / (F.col("n1") - 1))
    found = parts.select("stat", t.alias("t"), df.alias("df"))
    p = beta_share(F.col("df") / (F.col("df") + F.col("t") * F.col("t")), F.col("df") / 2, F.lit(0.5))
    return found.select("stat", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round(p, 6).alias("p"))


def ld_sampled(bits: DataFrame) -> DataFrame:
    """Mean r2 by distance, over pairs of sites drawn by a hash: PAIRS draws for each power of two up to the whole range.

    Sites are numbered in order; draw i of bin b takes a site and a distance in
    [2^b, 2^(b+1)) from a digest of the seed, b and i, and counts if the other site
    exists and no earlier draw took the same pair.  No pairs are formed but those,
    and genotypes are words of one bit for each haplotype.
    """
    sites = running(bits.select("site", "m", "k", "n"), [F.col("site")]).withColumn("rank", F.col("rank") - 1)
    n = sites.count()
    bins = max(1, int(n - 1).bit_length())
    draws = bits.sparkSession.range(bins * PAIRS).select(F.floor(F.col("id") / PAIRS).cast("int").alias("bin"), (F.col("id") % PAIRS).alias("draw"))
    digest = F.sha2(F.concat_ws("-", F.lit(str(SEED)), F.col("bin").cast("string"), F.col("draw").cast("string")).cast("binary"), 256)
    number = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    width = F.pow(F.lit(2.0), F.col("bin")).cast("long")
    drawn = draws.select("bin", (number(1) % max(n, 1)).alias("rank"), (width + number(13) % width).alias("away")).withColumn("other", F.col("rank") + F.col("away")).filter(F.col("other") < n)
    pairs = drawn.select("bin", "rank", "other").distinct()
    # At most PAIRS rows for each power of two.
    near = sites.select("rank", "m", "k", "n").join(F.broadcast(pairs), "rank")
    far = sites.select(F.col("rank").alias("other"), F.col("m").alias("m2"), F.col("k").alias("k2"))
    both = near.join(far, "other").withColumns({"p": F.col("k") / F.col("n"), "q": F.col("k2") / F.col("n")})
    cover = F.bit_count(F.col("m").bitwiseAND(F.col("m2"))) / F.col("n") - F.col("p") * F.col("q")
    spread = F.col("p") * (1 - F.col("p")) * F.col("q") * (1 - F.col("q"))
    return both.filter(spread > 1e-12).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg(cover * cover / spread), 6).alias("r2"))


def pairwise_missing(lineitem: DataFrame) -> DataFrame:
    """Differences of pairs of haplotypes over the sites that both have, by window of WORD sites.

    A call is a part's first line from a supplier modulo 25; others are missing.  Each
    haplotype has two words in a window: its alleles and its presence.  Two of
    them differ in the bits of (a xor b) where both are present, so the words of 25
    haplotypes meet and no sites do.
    """
    call = lineitem.groupBy(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % 25).alias("hap")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("one"))
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast(site % {WORD} as int))")
    words = call.groupBy(F.floor(F.col("site") / WORD).alias("win"), "hap").agg(F.sum(F.when(F.col("one.l_quantity") > 25, bit).otherwise(0)).alias("a"), F.sum(bit).alias("has"))
    x, y = words.alias("x"), words.alias("y")
    both = x.join(y, (F.col("x.win") == F.col("y.win")) & (F.col("x.hap") < F.col("y.hap")))
    shared = F.col("x.has").bitwiseAND(F.col("y.has"))
    each = both.select(F.col("x.win").alias("win"), F.bit_count(shared).alias("n"), F.bit_count(F.col("x.a").bitwiseXOR(F.col("y.a")).bitwiseAND(shared)).alias("d"))
    return each.groupBy("win").agg(F.sum("n").alias("compared"), F.sum("d").alias("differ"), F.round(F.avg(F.when(F.col("n") > 0, F.col("d") / F.col("n"))), 6).alias("pi"))


FRAMES = {
    "ks_stat": (ks_stat, ["v_rep"]),
    "verdict": (verdict, ["v_rep"]),
    "equivalence_table": (equivalence_table, ["v_rep"]),
    "welch_t": (welch_t, ["v_rep"]),
    "ld_sampled": (ld_sampled, ["v_words"]),
    "pairwise_missing": (pairwise_missing, ["lineitem"]),
}
