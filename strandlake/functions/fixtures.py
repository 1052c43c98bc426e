"""Genomic views over the supplied tables, in SQL that both engines read."""

VIEWS = {
    "v_call": """SELECT CAST(floor(l_partkey / 200) AS BIGINT) AS chrom, l_partkey % 200 AS idx, (l_partkey % 200) * 1000 + 1 AS pos, l_suppkey AS hap,
  CASE WHEN l_suppkey % 2 = 0 THEN 'AA' ELSE 'BB' END AS grp, CASE WHEN l_partkey % 200 BETWEEN 80 AND 139 THEN 1 ELSE 0 END AS body,
  CASE WHEN l_quantity > (CASE WHEN l_partkey % 200 BETWEEN 80 AND 139 THEN (CASE WHEN l_suppkey % 2 = 0 THEN 35 ELSE 15 END) ELSE 25 END) THEN 1 ELSE 0 END AS allele
  FROM lineitem""",
    "v_site": "SELECT chrom, idx, pos, body, grp, sum(allele) AS ac, count(*) AS an FROM v_call GROUP BY chrom, idx, pos, body, grp",
    "v_pair": """SELECT chrom, idx, pos, body, ac_a, an_a, ac_b, an_b, ac_a * 1.0e0 / an_a AS p_a, ac_b * 1.0e0 / an_b AS p_b, abs(ac_a * 1.0e0 / an_a - ac_b * 1.0e0 / an_b) AS dp FROM (
  SELECT chrom, idx, pos, body, sum(CASE WHEN grp = 'AA' THEN allele ELSE 0 END) AS ac_a, sum(CASE WHEN grp = 'AA' THEN 1 ELSE 0 END) AS an_a, sum(CASE WHEN grp = 'BB' THEN allele ELSE 0 END) AS ac_b, sum(CASE WHEN grp = 'BB' THEN 1 ELSE 0 END) AS an_b
  FROM v_call GROUP BY chrom, idx, pos, body) WHERE an_a > 0 AND an_b > 0""",
    "v_hudson": """SELECT *, (p_a - p_b) * (p_a - p_b) - p_a * (1 - p_a) / NULLIF(an_a - 1, 0) - p_b * (1 - p_b) / NULLIF(an_b - 1, 0) AS num,
  p_a * (1 - p_b) + p_b * (1 - p_a) AS den FROM v_pair WHERE an_a >= 2 AND an_b >= 2""",
    "v_hap": """SELECT p_partkey AS site, n_nationkey AS hap, n_nationkey % 2 AS grp, n_regionkey AS pop,
  CASE WHEN (p_partkey * 7 + n_nationkey * (p_size + 3)) % 11 < 4 THEN 1 ELSE 0 END AS allele FROM part CROSS JOIN nation""",
    "v_bits": "SELECT site, CAST(sum(allele * power(2, hap)) AS BIGINT) AS m, sum(allele) AS k FROM v_hap GROUP BY site",
    "v_words": "SELECT site, CAST(sum(allele * power(2, hap)) AS BIGINT) AS m, sum(allele) AS k, count(*) AS n FROM v_hap GROUP BY site",
    "v_hsite": """SELECT site, sum(allele) AS k, count(*) AS n, sum(CASE WHEN grp = 0 THEN allele ELSE 0 END) AS k_a, sum(CASE WHEN grp = 0 THEN 1 ELSE 0 END) AS n_a,
  sum(CASE WHEN grp = 1 THEN allele ELSE 0 END) AS k_b, sum(CASE WHEN grp = 1 THEN 1 ELSE 0 END) AS n_b FROM v_hap GROUP BY site""",
    "v_div": """SELECT site, CAST(floor(site / 20) AS BIGINT) AS win, k, n, k_a, n_a, k_b, n_b, 2.0e0 * k * (n - k) / (n * (n - 1)) AS pi,
  2.0e0 * k_a * (n_a - k_a) / (n_a * (n_a - 1)) AS pi_a, 2.0e0 * k_b * (n_b - k_b) / (n_b * (n_b - 1)) AS pi_b,
  1.0e0 * (k_a * (n_b - k_b) + k_b * (n_a - k_a)) / (n_a * n_b) AS dxy FROM v_hsite""",
    "v_win": "SELECT win, sum(pi_a) / 20 AS pi_a, sum(pi_b) / 20 AS pi_b, sum(dxy) / 20 AS dxy, count(*) AS n_sites FROM v_div GROUP BY win",
    "v_gene": """SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS chrom, (p_partkey % 200) * 1000 AS s, (p_partkey % 200) * 1000 + p_size * 60 AS e, p_partkey AS gene,
  p_type AS term, p_brand AS family, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""",
    "v_annot": """SELECT v.chrom, v.pos, v.dp, v.num, v.den, v.body, p.p_brand AS tx, CASE p.p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE p.p_size % 4 END AS degen
  FROM v_hudson v CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) o JOIN part p ON p.p_partkey = v.chrom * 200 + (v.idx + o.d) % 200""",
    "v_mask": "SELECT o_orderkey * 37 % 200000 AS s, o_orderkey * 37 % 200000 + 50 + o_custkey % 400 AS e FROM orders",
    "v_gene_bin": "SELECT chrom, s, e, gene, term, family, i AS bin FROM (SEQ(lo;hi), chrom, s, e, gene, term, family FROM (SELECT g.*, CAST(floor(s / 4000) AS BIGINT) AS lo, CAST(floor(e / 4000) AS BIGINT) AS hi FROM v_gene g))",
    "v_flux_bin": "SELECT event_id, lineage, inv, tl, tr, i AS bin FROM (SEQ(lo;hi), event_id, lineage, inv, tl, tr FROM (SELECT f.*, CAST(floor(tl / 400) AS BIGINT) AS lo, CAST(floor(tr / 400) AS BIGINT) AS hi FROM v_flux f))",
    "v_edge_point": """SELECT chrom, pos, edge, probe, CAST(floor(pos / 20000) AS BIGINT) AS bin FROM (SELECT chrom, s AS pos, s AS edge, 0 AS probe FROM v_gene UNION ALL SELECT chrom, e, e, 0 FROM v_gene UNION ALL SELECT chrom, pos, NULL, 1 FROM v_pair)""",
    "v_f1": "SELECT CAST(floor(site / 50) AS BIGINT) AS b, sum(CASE WHEN k_a = 1 THEN 1.0e0 ELSE 0 END) AS s_a, sum(CASE WHEN k_a > 0 AND k_a < n_a THEN 1 ELSE 0 END) AS n_a, sum(CASE WHEN k_b = 1 THEN 1.0e0 ELSE 0 END) AS s_b, sum(CASE WHEN k_b > 0 AND k_b < n_b THEN 1 ELSE 0 END) AS n_b FROM v_hsite GROUP BY CAST(floor(site / 50) AS BIGINT)",
    "v_density": "SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, body, sum(CASE WHEN ac_a + ac_b > 0 AND ac_a + ac_b < an_a + an_b THEN 1 ELSE 0 END) / 20000.0e0 AS density FROM v_pair GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT), body",
    "v_classwin": "SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, body, avg(2 * p_a * (1 - p_a)) AS h_a, avg(2 * p_b * (1 - p_b)) AS h_b FROM v_pair GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT), body",
    "v_comp": "SELECT body, degen, count(*) AS n, 10000.0e0 * sum(CASE WHEN dp >= 0.3e0 THEN 1 ELSE 0 END) / count(*) AS per_10k, avg(dp) AS dp FROM v_annot GROUP BY body, degen",
    "v_asym": "SELECT p.chrom, p.idx, p.dp, (p.p_a - p.p_b) * (1 - 2 * o.q) AS diff, least((ac_a + ac_b) * 1.0e0 / (an_a + an_b), 1 - (ac_a + ac_b) * 1.0e0 / (an_a + an_b)) AS maf FROM v_pair p JOIN v_out o ON o.chrom = p.chrom AND o.idx = p.idx",
    "v_ks": """SELECT stat, max(abs(a / NULLIF(n0, 0) - b / NULLIF(n1, 0))) AS ks FROM (SELECT stat, value, sum(sum(1.0e0 - engine)) OVER (PARTITION BY stat ORDER BY value) AS a, sum(sum(engine * 1.0e0)) OVER (PARTITION BY stat ORDER BY value) AS b, sum(sum(1.0e0 - engine)) OVER (PARTITION BY stat) AS n0, sum(sum(engine * 1.0e0)) OVER (PARTITION BY stat) AS n1 FROM v_rep WHERE value IS NOT NULL GROUP BY stat, value) GROUP BY stat""",
    "v_pool": """SELECT stat, n0, n1, CASE WHEN n0 < 2 OR n1 < 2 THEN NULL WHEN s > 0 THEN (m0 - m1) / s WHEN m0 = m1 THEN 0 ELSE 1.0e300 END AS d FROM (SELECT stat, n0, n1, m0, m1, sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / NULLIF(n0 + n1 - 2, 0)) AS s FROM (
  SELECT stat, sum(1 - engine) AS n0, sum(engine) AS n1, avg(CASE WHEN engine = 0 THEN value END) AS m0, avg(CASE WHEN engine = 1 THEN value END) AS m1, var_samp(CASE WHEN engine = 0 THEN value END) AS v0, var_samp(CASE WHEN engine = 1 THEN value END) AS v1 FROM v_rep WHERE value IS NOT NULL GROUP BY stat))""",
    "v_verdict": """SELECT k.stat, max(k.ks) AS ks, max(p.d) AS d, least(1.0e0, greatest(0.0e0, 2 * sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0e0 * i * i * n0 * n1 / (n0 + n1) * ks * ks)))) AS p FROM v_ks k JOIN v_pool p ON p.stat = k.stat CROSS JOIN (SEQ(1;101)) GROUP BY k.stat""",
    "v_mask2": "SELECT p_partkey * 97 % 200000 AS s, p_partkey * 97 % 200000 + 100 + p_size * 5 AS e FROM part",
    "v_edges": """SELECT w, x, sum(a) AS a, sum(b) AS b FROM (SELECT w, greatest(s, w * 5000) AS x, 1 - m AS a, m AS b FROM v_cut UNION ALL SELECT w, least(e, (w + 1) * 5000), m - 1, 0 - m FROM v_cut) GROUP BY w, x""",
    "v_cut": """SELECT i AS w, s, e, m FROM (SEQ(lo;hi), s, e, m FROM (SELECT s, e, m, CAST(floor(s / 5000) AS BIGINT) AS lo, CAST(floor((e - 1) / 5000) AS BIGINT) AS hi FROM (SELECT s, e, 0 AS m FROM v_mask UNION ALL SELECT s, e, 1 FROM v_mask2)))""",
    "v_cover": """SELECT w, x, lead(x) OVER (PARTITION BY w ORDER BY x) AS y, sum(a) OVER (PARTITION BY w ORDER BY x ROWS UNBOUNDED PRECEDING) AS a, sum(b) OVER (PARTITION BY w ORDER BY x ROWS UNBOUNDED PRECEDING) AS b FROM v_edges""",
    "v_out": "SELECT chrom, idx, avg(1.0e0 * allele) AS q FROM v_call WHERE hap % 5 = 0 GROUP BY chrom, idx",
    "v_size": "SELECT 0.0e0 AS t0, 10000.0e0 AS n0, 0.001e0 AS alpha UNION ALL SELECT 600.0e0, 4000.0e0, 0.0e0 UNION ALL SELECT 1000.0e0, 20000.0e0, 0.0005e0",
    "v_surface": "SELECT CAST(floor((p_size - 1) / 10) AS BIGINT) AS ti, p_partkey % 5 AS pi, avg(p_retailprice) AS m FROM part GROUP BY CAST(floor((p_size - 1) / 10) AS BIGINT), p_partkey % 5",
    "v_popedge": "SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 4 <> 3",
    "v_node": """SELECT c_custkey AS node, 0.0e0 AS time, 1 AS is_sample FROM customer
  UNION ALL SELECT -1000000 + n_nationkey, 1.0e0 + n_nationkey, 0 FROM nation UNION ALL SELECT -2000000 + r_regionkey, 100.0e0 + 10 * r_regionkey, 0 FROM region UNION ALL SELECT -3000000, 1000.0e0, 0""",
    "v_edge": """SELECT 0 AS l, 500000 AS r, -1000000 + CAST(c_nationkey AS BIGINT) AS parent, c_custkey AS child FROM customer
  UNION ALL SELECT 500000, 1000000, -1000000 + (CAST(c_nationkey AS BIGINT) + 7) % 25, c_custkey FROM customer
  UNION ALL SELECT 0, 1000000, -2000000 + CAST(n_regionkey AS BIGINT), -1000000 + CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 0, 1000000, CAST(-3000000 AS BIGINT), -2000000 + CAST(r_regionkey AS BIGINT) FROM region""",
    "v_tree": "SELECT l AS tree, parent, child FROM v_edge WHERE r = l + 500000 UNION ALL SELECT t.tree, e.parent, e.child FROM v_edge e CROSS JOIN (SELECT 0 AS tree UNION ALL SELECT 500000) t WHERE e.r = e.l + 1000000",
    "v_up": """SELECT a.tree, a.child AS sample, a.parent AS n1, b.parent AS n2, c.parent AS n3 FROM v_tree a JOIN v_tree b ON a.tree = b.tree AND a.parent = b.child JOIN v_tree c ON b.tree = c.tree AND b.parent = c.child
  WHERE a.child >= 0""",
    "v_anc": "SELECT tree, sample, sample AS node FROM v_up UNION ALL SELECT tree, sample, n1 FROM v_up UNION ALL SELECT tree, sample, n2 FROM v_up UNION ALL SELECT tree, sample, n3 FROM v_up",
    "v_below": "SELECT tree, node, count(*) AS k, sum(CASE WHEN sample % 2 = 0 THEN 1 ELSE 0 END) AS k_a, sum(CASE WHEN sample % 2 = 1 THEN 1 ELSE 0 END) AS k_b FROM v_anc GROUP BY tree, node",
    "v_branch": "SELECT t.tree, t.child AS node, p.time - c.time AS blen, b.k, b.k_a, b.k_b FROM v_tree t JOIN v_node p ON p.node = t.parent JOIN v_node c ON c.node = t.child JOIN v_below b ON b.tree = t.tree AND b.node = t.child",
    "v_totals": "SELECT count(*) AS n, sum(CASE WHEN node % 2 = 0 THEN 1 ELSE 0 END) AS n_a, sum(CASE WHEN node % 2 = 1 THEN 1 ELSE 0 END) AS n_b FROM v_node WHERE is_sample = 1",
    "v_flux": """SELECT event_id, event_type AS kind, user_id AS lineage, CAST(event_id AS DOUBLE) AS t, CAST(floor(value * 10) AS BIGINT) AS tl, CAST(floor(value * 10) AS BIGINT) + 20 + event_id % 300 AS tr, user_id % 2 AS inv FROM events""",
    "v_rep": "SELECT event_id, event_id % 2 AS engine, event_type AS stat, user_id AS rep, value FROM events",
    "v_sim": """SELECT o_orderkey AS sim, o_orderstatus AS status, o_totalprice AS theta, 1.0e0 * o_custkey AS psi, q AS s1, d AS s2, 1.0e0 * c AS s3
  FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS c FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "v_scaled": "SELECT v.*, (s1 - m1) / NULLIF(d1, 0) AS z1, (s2 - m2) / NULLIF(d2, 0) AS z2, (s3 - m3) / NULLIF(d3, 0) AS z3 FROM v_sim v CROSS JOIN v_mad",
    "v_med": "SELECT median(s1) AS m1, median(s2) AS m2, median(s3) AS m3 FROM v_sim",
    "v_mad": "SELECT max(m1) AS m1, max(m2) AS m2, max(m3) AS m3, 1.4826e0 * median(abs(s1 - m1)) AS d1, 1.4826e0 * median(abs(s2 - m2)) AS d2, 1.4826e0 * median(abs(s3 - m3)) AS d3 FROM v_sim CROSS JOIN v_med",
    "v_dist": "SELECT sim, theta, psi, s1, sqrt(coalesce(z1 * z1, 0) + coalesce(z2 * z2, 0) + coalesce(z3 * z3, 0)) AS dist FROM v_scaled",
    "v_kept": "SELECT * FROM (SELECT v.*, row_number() OVER (ORDER BY round(dist, 9), sim) AS rn, count(*) OVER () AS n FROM v_dist v) WHERE rn <= greatest(20, round(0.01e0 * n, 0))",
    "v_grid": "SELECT p_partkey AS cell, p_size AS t_inv, p_brand AS model, p_retailprice AS score FROM part",
    "v_block": "SELECT CAST(chrom * 10 + floor(idx / 20) AS BIGINT) AS block, sum(num) AS num, sum(den) AS den FROM v_hudson GROUP BY CAST(chrom * 10 + floor(idx / 20) AS BIGINT)",
    "v_step": "SELECT i * 50.0e0 AS t, 1.0e0 / (2 + i) AS p FROM (SEQ(0;40))",
    "v_probe": "SELECT i AS probe, i * 17.0e0 AS t FROM (SEQ(0;100))",
}
