"""Site-frequency spectra, linkage and haplotype statistics."""

QUERIES = {
    "sfs_unfolded": "SELECT i AS k, coalesce(c, 0) AS n FROM (SEQ(0;25)) LEFT JOIN (SELECT k, count(*) AS c FROM v_hsite GROUP BY k) s ON s.k = i",
    "sfs_folded": "SELECT i AS k, coalesce(c, 0) AS n FROM (SEQ(0;12)) LEFT JOIN (SELECT least(k, n - k) AS m, count(*) AS c FROM v_hsite GROUP BY least(k, n - k)) s ON s.m = i",
    "sfs_bincount": "SELECT grp, ac, count(*) AS n FROM v_site WHERE an >= 2 GROUP BY grp, ac",
    "hist_weighted": """SELECT b.i AS bin, coalesce(n, 0) AS n, coalesce(w, 0.0e0) AS w FROM (SEQ(0;11)) b LEFT JOIN (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n, round(sum(l_discount), 4) AS w FROM lineitem GROUP BY CAST(floor(l_quantity / 5) AS BIGINT)) h ON h.bin = b.i""",
    "sfs_project": """SELECT m.i AS k, round(sum(s.c * exp(LNFACT(s.k) - LNFACT(m.i) - LNFACT(s.k - m.i) + LNFACT(s.n - s.k) - LNFACT(10 - m.i) - LNFACT(s.n - s.k - 10 + m.i) - LNFACT(s.n) + LNFACT(10) + LNFACT(s.n - 10))), 6) AS n
  FROM (SELECT k, n, count(*) AS c FROM v_hsite WHERE n >= 10 GROUP BY k, n) s JOIN (SEQ(0;10)) m ON m.i <= s.k AND 10 - m.i <= s.n - s.k GROUP BY m.i""",
    "sfs_l1": "SELECT round(sum(abs(a - b)), 6) AS l1 FROM (SELECT k, sum(CASE WHEN g = 0 THEN c ELSE 0 END) * 1.0e0 / sum(sum(CASE WHEN g = 0 THEN c ELSE 0 END)) OVER () AS a, sum(CASE WHEN g = 1 THEN c ELSE 0 END) * 1.0e0 / sum(sum(CASE WHEN g = 1 THEN c ELSE 0 END)) OVER () AS b FROM (SELECT k_a AS k, 0 AS g, count(*) AS c FROM v_hsite GROUP BY k_a UNION ALL SELECT k_b, 1, count(*) FROM v_hsite GROUP BY k_b) GROUP BY k)",
    "f1_ratio": """SELECT round(max(ra), 6) AS f1_a, round(max(rb), 6) AS f1_b, round(max(ra / NULLIF(rb, 0)), 6) AS ratio, count(*) AS blocks, round(sqrt((count(*) - 1) * var_pop(la)), 6) AS se_a, round(sqrt((count(*) - 1) * var_pop(lb)), 6) AS se_b,
  round(max(ra / NULLIF(rb, 0)) * sqrt((count(*) - 1) * var_pop(la) / NULLIF(power(max(ra), 2), 0) + (count(*) - 1) * var_pop(lb) / NULLIF(power(max(rb), 2), 0)), 6) AS se_ratio FROM (SELECT sa / NULLIF(na, 0) AS ra, sb / NULLIF(nb, 0) AS rb, (sa - s_a) / NULLIF(na - n_a, 0) AS la, (sb - s_b) / NULLIF(nb - n_b, 0) AS lb FROM v_f1 CROSS JOIN (SELECT sum(s_a) AS sa, sum(n_a) AS na, sum(s_b) AS sb, sum(n_b) AS nb FROM v_f1))""",
    "multinomial_ll": """SELECT round(sum(c * ln(q)), 4) AS ll, round(2 * 1 - 2 * sum(c * ln(q)), 4) AS aic, round(sum(c * ln(q2)), 4) AS ll2, round(2 * 2 - 2 * sum(c * ln(q2)), 4) AS aic2, round(2 * (sum(c * ln(q2)) - sum(c * ln(q))), 4) AS lrt FROM (SELECT k, count(*) AS c FROM v_hsite WHERE k > 0 AND k < n GROUP BY k)
  JOIN (SELECT i, (1.0e0 / i) / sum(1.0e0 / i) OVER () AS q, power(i, -0.5e0) / sum(power(i, -0.5e0)) OVER () AS q2 FROM (SEQ(1;24))) ON k = i""",
    "sfs2d_summary": """SELECT sum(v) AS total, sum(CASE WHEN i BETWEEN 1 AND 12 AND j BETWEEN 1 AND 11 THEN v ELSE 0 END) AS shared, sum(CASE WHEN i > 0 AND j = 0 THEN v ELSE 0 END) AS private_a, sum(CASE WHEN i = 0 AND j > 0 THEN v ELSE 0 END) AS private_b,
  sum(CASE WHEN (i = 0 AND j = 12) OR (i = 13 AND j = 0) THEN v ELSE 0 END) AS fixed_sites, sum(CASE WHEN (i <= 2 AND j >= 10) OR (i >= 11 AND j <= 2) THEN v ELSE 0 END) AS near_fixed, 14 * 13 - count(*) AS zero_cells, round((sum(abs(v - coalesce(w, 0))) + sum(CASE WHEN w IS NULL THEN v ELSE 0 END)) * 1.0e0 / sum(v), 6) AS asym
  FROM (SELECT k_a AS i, k_b AS j, count(*) AS v FROM v_hsite GROUP BY k_a, k_b) a LEFT JOIN (SELECT k_a AS i2, k_b AS j2, count(*) AS w FROM v_hsite GROUP BY k_a, k_b) b ON i2 = 13 - i AND j2 = 12 - j""",
    "spectrum_mean": "SELECT k, round(avg(f), 6) AS f FROM (SELECT r, k, c * 1.0e0 / sum(c) OVER (PARTITION BY r) AS f FROM (SELECT site % 4 AS r, k, count(*) AS c FROM v_hsite GROUP BY site % 4, k)) GROUP BY k",
    "ld_decay": """SELECT bin, count(*) AS pairs, round(avg(d * d / den), 6) AS r2 FROM (SELECT CAST(floor(x.o / 2.0e0) AS BIGINT) AS bin, BITS(x.m & y.m) / 25.0e0 - (x.k / 25.0e0) * (y.k / 25.0e0) AS d,
  (x.k / 25.0e0) * (1 - x.k / 25.0e0) * (y.k / 25.0e0) * (1 - y.k / 25.0e0) AS den FROM (SELECT i AS o, site + i AS other, m, k FROM (SEQ(1;9), site, m, k FROM (SELECT site, m, k FROM v_bits))) x JOIN v_bits y ON y.site = x.other) WHERE den > 1.0e-12 GROUP BY bin""",
    "h_stats": """SELECT win, round(sum(f * f), 6) AS h1, round(sum(f * f) + 2 * sum(CASE WHEN rn = 1 THEN f ELSE 0 END) * sum(CASE WHEN rn = 2 THEN f ELSE 0 END), 6) AS h12, round(sum(CASE WHEN rn > 1 THEN f * f ELSE 0 END), 6) AS h2, round(sum(CASE WHEN rn > 1 THEN f * f ELSE 0 END) / sum(f * f), 6) AS h2_h1 FROM (
  SELECT win, c / 25.0e0 AS f, row_number() OVER (PARTITION BY win ORDER BY c DESC, h) AS rn FROM (SELECT win, h, count(*) AS c FROM (SELECT CAST(floor(site / 5) AS BIGINT) AS win, hap, JOINED(a;site) AS h FROM (SELECT site, hap, CAST(allele AS VARCHAR(1)) AS a FROM v_hap) GROUP BY CAST(floor(site / 5) AS BIGINT), hap) GROUP BY win, h)) GROUP BY win""",
}
