"""Resampling, rank and test statistics."""

QUERIES = {
    "block_jackknife": """SELECT round(theta, 6) AS theta, round(b * theta - (b - 1) * m, 6) AS est, round(sqrt((b - 1) * v), 6) AS se FROM (SELECT max(t) AS theta, count(*) AS b, avg(loo) AS m, var_pop(loo) AS v FROM (SELECT sum(num) OVER () / sum(den) OVER () AS t, (sum(num) OVER () - num) / (sum(den) OVER () - den) AS loo FROM v_block))""",
    "block_jackknife_multi": """SELECT body, round(max(t), 6) AS theta, round(sqrt((count(*) - 1) * var_pop(loo)), 6) AS se FROM (SELECT body, sum(num) OVER (PARTITION BY body) / sum(den) OVER (PARTITION BY body) AS t, (sum(num) OVER (PARTITION BY body) - num) / (sum(den) OVER (PARTITION BY body) - den) AS loo FROM (
  SELECT body, CAST(floor(idx / 10) AS BIGINT) AS b, sum(num) AS num, sum(den) AS den FROM v_hudson GROUP BY body, CAST(floor(idx / 10) AS BIGINT))) GROUP BY body""",
    "bh_fdr": "SELECT id, round(least(1.0e0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (SELECT cell AS id, score / 100000 AS p, row_number() OVER (ORDER BY score, cell) AS r, count(*) OVER () AS n FROM v_grid)",
    "smooth3": "SELECT win, round(sum(dxy) OVER (ORDER BY win ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM v_win",
    "roulette_pick": "SELECT u, min(cell) AS pick FROM (SELECT cell, sum(score) OVER (ORDER BY cell ROWS UNBOUNDED PRECEDING) / sum(score) OVER () AS c FROM v_grid) JOIN (SELECT i / 10.0e0 AS u FROM (SEQ(1;9))) ON c >= u GROUP BY u",
    "dedup_times": "SELECT event_id, t FROM (SELECT event_id, tl AS t, lag(tl) OVER (ORDER BY tl, event_id) AS p FROM v_flux) WHERE p IS NULL OR t - p > 0",
    "cohens_d": "SELECT stat, round((m0 - m1) / NULLIF(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 0), 6) AS d FROM (SELECT stat, avg(CASE WHEN engine = 0 THEN value END) AS m0, avg(CASE WHEN engine = 1 THEN value END) AS m1, var_samp(CASE WHEN engine = 0 THEN value END) AS v0, var_samp(CASE WHEN engine = 1 THEN value END) AS v1, sum(1 - engine) AS n0, sum(engine) AS n1 FROM v_rep GROUP BY stat)",
    "moment_test": """SELECT stat, round(z, 6) AS z, CASE WHEN abs(z) <= 3 THEN 1 ELSE 0 END AS ok, CASE WHEN abs(z) <= 2.5758293035489004e0 THEN 1 ELSE 0 END AS ok_family FROM (SELECT stat, (avg(CASE WHEN engine = 0 THEN value END) - avg(CASE WHEN engine = 1 THEN value END)) / sqrt(var_samp(CASE WHEN engine = 0 THEN value END) / sum(1 - engine) + var_samp(CASE WHEN engine = 1 THEN value END) / sum(engine)) AS z FROM v_rep GROUP BY stat)""",
    "ols_hc3": "SELECT round(max(b), 6) AS slope, round(sqrt(sum(power(x - mx, 2) * power((y - my - b * (x - mx)) / (1 - 1.0e0 / n - power(x - mx, 2) / sxx), 2))) / max(sxx), 6) AS se FROM (SELECT x, y, mx, my, n, sxx, sxy / sxx AS b FROM (SELECT x, y, n, mx, my, sum((x - mx) * (x - mx)) OVER () AS sxx, sum((x - mx) * (y - my)) OVER () AS sxy FROM (SELECT log10(1.0e0 + t_inv) AS x, score / 100 AS y, avg(log10(1.0e0 + t_inv)) OVER () AS mx, avg(score / 100) OVER () AS my, count(*) OVER () AS n FROM v_grid)))",
    "wls_slope": "SELECT round((sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / power(sum(w), 2)) / (sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2)), 6) AS slope FROM (SELECT t_inv AS x, avg(score) AS y, count(*) * 1.0e0 AS w FROM v_grid GROUP BY t_inv)",
    "fisher_exact": """SELECT tx, a, b, c, d, round(p, 6) AS p, CASE WHEN b * c > 0 THEN round(1.0e0 * a * d / (b * c), 6) WHEN a * d > 0 THEN CAST('Infinity' AS DOUBLE) END AS odds FROM (SELECT tx, a, b, c, d, sum(CASE WHEN lp <= lp0 + 1.0e-7 THEN exp(lp) ELSE 0 END) AS p FROM (SELECT tx, a, b, c, d, m - LNFACT(i) - LNFACT(a + b - i) - LNFACT(a + c - i) - LNFACT(d - a + i) AS lp, m - LNFACT(a) - LNFACT(b) - LNFACT(c) - LNFACT(d) AS lp0 FROM (
  SEQ(greatest(0, a - d);least(a + b, a + c)), tx, a, b, c, d, m FROM (SELECT tx, a, b, c, d, LNFACT(a + b) + LNFACT(c + d) + LNFACT(a + c) + LNFACT(b + d) - LNFACT(a + b + c + d) AS m FROM (
  SELECT p_brand AS tx, count(CASE WHEN p_size < 25 AND p_type < 'M' THEN 1 END) AS a, count(CASE WHEN p_size < 25 AND p_type >= 'M' THEN 1 END) AS b, count(CASE WHEN p_size >= 25 AND p_type < 'M' THEN 1 END) AS c, count(CASE WHEN p_size >= 25 AND p_type >= 'M' THEN 1 END) AS d FROM part GROUP BY p_brand)))) GROUP BY tx, a, b, c, d)""",
    "window_null": """SELECT t.term, t.k, round(coalesce(count(c.c), 0) * 1.0e0 / max(w.n), 6) AS p FROM (SELECT term, count(*) AS k FROM v_gene WHERE chrom = 0 AND s BETWEEN 80000 AND 139000 GROUP BY term) t
  CROSS JOIN (SELECT sum(last + 1) AS n FROM (SELECT chrom, max(CAST(floor(s / 60000) AS BIGINT)) AS last FROM v_gene WHERE chrom <> 0 GROUP BY chrom)) w
  LEFT JOIN (SELECT term, chrom, CAST(floor(s / 60000) AS BIGINT) AS win, count(*) AS c FROM v_gene WHERE chrom <> 0 GROUP BY term, chrom, CAST(floor(s / 60000) AS BIGINT)) c ON c.term = t.term AND c.c >= t.k WHERE w.n > 0 GROUP BY t.term, t.k""",
    "robust_scale": """SELECT round(max(m1), 6) AS med1, round(max(d1), 6) AS mad1, round(max(m2), 6) AS med2, round(max(d2), 6) AS mad2, round(max(d3), 6) AS mad3, round(max(sd1), 6) AS sd1, round(max(sem1), 6) AS sem1 FROM v_mad CROSS JOIN (SELECT stddev_samp(s1) AS sd1, stddev_samp(s1) / sqrt(count(s1)) AS sem1 FROM v_sim)""",
    "corr_pearson": "SELECT round(corr(s1, theta), 6) AS r FROM v_sim",
    "corr_spearman": "SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY s3) + (count(*) OVER (PARTITION BY s3) - 1) / 2.0e0 AS ry FROM v_sim)",
    "seed_for": "SELECT doc_id, HEX(h) % 2147483647 + 1 AS seed FROM (SELECT doc_id, substr(SHA(k), 1, 8) AS h FROM (SELECT doc_id, CAST(doc_id AS VARCHAR(20)) AS k FROM documents))",
}
