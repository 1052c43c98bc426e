"""Interval, nearest, as-of and interpolation joins; masks and coverage."""

QUERIES = {
    "interval_join": """SELECT v.chrom, v.pos, g.gene FROM (SELECT chrom, pos, CAST(floor(pos / 4000) AS BIGINT) AS bin FROM v_pair) v JOIN v_gene_bin g ON v.chrom = g.chrom AND v.bin = g.bin AND v.pos > g.s AND v.pos <= g.e""",
    "mask_intersect_bp": """SELECT w, sum(CASE WHEN a > 0 AND b > 0 THEN y - x ELSE 0 END) AS both_bp, sum(CASE WHEN a > 0 OR b > 0 THEN y - x ELSE 0 END) AS either_bp, sum(CASE WHEN a > 0 AND b = 0 THEN y - x ELSE 0 END) AS only_bp FROM v_cover WHERE y IS NOT NULL GROUP BY w""",
    "interval_subtract": """SELECT gene, 'minus' AS kind, l, r FROM (SELECT gene, s AS l, least(e, 70000) AS r FROM v_gene UNION ALL SELECT gene, greatest(s, 130000), e FROM v_gene) WHERE l < r
  UNION ALL SELECT gene, 'shared', greatest(s, 70000), least(e, 130000) FROM v_gene WHERE greatest(s, 70000) < least(e, 130000)""",
    "segment_overlap": """SELECT a.gene AS a, b.gene AS b, least(a.e, b.e) - greatest(a.s, b.s) AS bp FROM v_gene_bin a JOIN v_gene_bin b ON a.chrom = b.chrom AND a.bin = b.bin AND a.gene < b.gene AND b.s < a.e AND a.s < b.e AND a.bin = floor(greatest(a.s, b.s) / 4000)""",
    "nearest_gene": """SELECT chrom, pos, CASE WHEN l IS NULL THEN r - pos WHEN r IS NULL THEN pos - l ELSE least(pos - l, r - pos) END AS dist FROM (SELECT p.chrom, p.pos, p.probe, coalesce(max(p.edge) OVER (PARTITION BY p.chrom, p.bin ORDER BY p.pos, p.probe ROWS UNBOUNDED PRECEDING), c.before) AS l,
  coalesce(min(p.edge) OVER (PARTITION BY p.chrom, p.bin ORDER BY p.pos DESC, p.probe ROWS UNBOUNDED PRECEDING), c.after) AS r FROM v_edge_point p JOIN (SELECT chrom, bin, max(hi) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(lo) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (
  SELECT chrom, bin, max(edge) AS hi, min(edge) AS lo FROM v_edge_point GROUP BY chrom, bin)) c ON c.chrom = p.chrom AND c.bin = p.bin) WHERE probe = 1""",
    "interp_bilinear": """SELECT x, y, round((1 - u) * ((1 - v) * m00 + v * m01) + u * ((1 - v) * m10 + v * m11), 2) AS z FROM (SELECT x, y, t - i0 AS u, q - j0 AS v, sum(CASE WHEN ti = i0 AND pi = j0 THEN m END) AS m00, sum(CASE WHEN ti = i0 AND pi = j0 + 1 THEN m END) AS m01, sum(CASE WHEN ti = i0 + 1 AND pi = j0 THEN m END) AS m10, sum(CASE WHEN ti = i0 + 1 AND pi = j0 + 1 THEN m END) AS m11 FROM (
  SELECT x, y, t, q, least(CAST(floor(t) AS BIGINT), 3) AS i0, least(CAST(floor(q) AS BIGINT), 3) AS j0 FROM (SELECT a.i AS x, b.i AS y, least(4.0e0, greatest(0.0e0, a.i / 5.0e0 - 0.4e0)) AS t, least(4.0e0, b.i / 6.0e0) AS q FROM (SEQ(0;26)) a CROSS JOIN (SEQ(0;26)) b)) g JOIN v_surface s ON s.ti BETWEEN i0 AND i0 + 1 AND s.pi BETWEEN j0 AND j0 + 1 GROUP BY x, y, t - i0, q - j0)""",
    "param_grid": "SELECT a.i AS d, b.i AS f, c.i AS t FROM (SELECT DISTINCT p_size % 10 + 1 AS i FROM part) a CROSS JOIN (SELECT DISTINCT c_nationkey % 10 + 1 AS i FROM customer) b CROSS JOIN (SELECT DISTINCT o_custkey % 10 + 1 AS i FROM orders) c WHERE a.i + b.i <= c.i",
    "weighted_rate": "SELECT CAST(floor(s / 20000) AS BIGINT) AS win, round(sum((e - s) * 1.0e0 * ((e - s) % 7)) / sum(e - s), 6) AS rate FROM v_mask GROUP BY CAST(floor(s / 20000) AS BIGINT)",
    "tandem_collapse": "SELECT family, count(*) AS genes, sum(new) AS clusters FROM (SELECT family, CASE WHEN s - lag(s) OVER (PARTITION BY family, chrom ORDER BY s, gene) <= 20000 THEN 0 ELSE 1 END AS new FROM v_gene) GROUP BY family",
    "flux_filter": "SELECT event_id, lineage, tl, tr FROM v_flux WHERE kind = 'click' AND inv = 0",
    "tract_len": "SELECT inv, count(*) AS n, sum(tr - tl) AS total, max(tr - tl) AS longest FROM v_flux GROUP BY inv",
    "coverage_at": "SELECT x, sum(d) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT x, sum(d) AS d FROM (SELECT tl AS x, 1 AS d FROM v_flux UNION ALL SELECT tr + 1, -1 FROM v_flux) GROUP BY x)",
    "node_remap": "SELECT f.event_id, m.new_id FROM v_flux f JOIN (SELECT lineage, dense_rank() OVER (ORDER BY lineage) - 1 AS new_id FROM (SELECT DISTINCT lineage FROM v_flux)) m ON f.lineage = m.lineage",
    "survival_curve": "SELECT d, round(above * 1.0e0 / total, 6) AS s FROM (SELECT tr - tl AS d, sum(count(*)) OVER (ORDER BY tr - tl DESC ROWS UNBOUNDED PRECEDING) AS above, sum(count(*)) OVER () AS total FROM v_flux GROUP BY tr - tl)",
    "interval_coverage": """SELECT chrom, sum(e - s) AS total, sum(greatest(0, least(e, 130000) - greatest(s, 70000))) AS shared, sum(e - s - greatest(0, least(e, 130000) - greatest(s, 70000))) AS remaining FROM v_gene GROUP BY chrom""",
    "sites_outside_genes": """SELECT v.chrom, v.pos, t.term FROM v_pair v CROSS JOIN (SELECT DISTINCT term FROM v_gene) t WHERE NOT EXISTS (SELECT 1 FROM v_gene_bin g WHERE g.term = t.term AND g.chrom = v.chrom AND g.bin = CAST(floor(v.pos / 4000) AS BIGINT) AND v.pos > g.s AND v.pos <= g.e)""",
    "escape_exposure": """SELECT event_id, round(sum(greatest(0, least(b, hi) - greatest(a, lo)) * 500.0e0 * CASE WHEN lo >= 1000 AND hi <= 3000 THEN CASE WHEN k0 = 0 THEN 0.7e0 ELSE 0.3e0 END ELSE 1 END * CASE WHEN lo >= 2000 AND hi <= 4200 THEN CASE WHEN k1 = 0 THEN 0.6e0 ELSE 0.4e0 END ELSE 1 END), 4) AS exposure
  FROM (SELECT event_id, lineage % 2 AS k0, CAST(floor(lineage / 2) AS BIGINT) % 2 AS k1, CASE WHEN tl <= 2500 AND tr > 2500 THEN 0 WHEN tr <= 2500 THEN tr ELSE 2500 END AS a, CASE WHEN tl <= 2500 AND tr > 2500 THEN 0 WHEN tr <= 2500 THEN 2500 ELSE tl END AS b FROM v_flux)
  CROSS JOIN (SELECT 0 AS lo, 1000 AS hi UNION ALL SELECT 1000, 2000 UNION ALL SELECT 2000, 3000 UNION ALL SELECT 3000, 4200 UNION ALL SELECT 4200, 1000000) c GROUP BY event_id""",
    "hitchhike_prob": """SELECT event_id, dist, round(exp(-1.0e-3 * dist * 2), 6) AS p FROM (SELECT event_id, CASE WHEN tl <= 2500 AND tr > 2500 THEN 0 WHEN tr <= 2500 THEN 2500 - tr ELSE tl - 2500 END AS dist FROM v_flux)""",
}
