"""Counts, joins, frequencies, diversity and divergence at sites and in windows."""

QUERIES = {
    "window_ratio_fst": "SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, count(*) AS n_sites, round(sum(num) / sum(den), 6) AS fst FROM v_hudson GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT) HAVING count(*) >= 10 AND sum(den) > 0",
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45",
    "allele_counts": "SELECT chrom, pos, grp, ac, an FROM v_site",
    "gff_parse": "SELECT p_partkey, regexp_extract('ID=' || p_name || ';brand=' || p_brand, 'ID=([^;]+)', 1) AS id FROM part WHERE p_size % 2 = 0",
    "agg_complete_stats": "SELECT stat, engine, n AS n_reps FROM (SELECT stat, engine, count(DISTINCT rep) AS n FROM v_rep GROUP BY stat, engine) JOIN (SELECT engine AS track, count(DISTINCT rep) AS reps FROM v_rep GROUP BY engine) ON track = engine AND n = reps",
    "status_breakdown": "SELECT status, count(*) AS n, round(avg(theta), 4) AS mean_wall, round(max(theta), 4) AS max_wall FROM v_sim GROUP BY status",
    "time_rescale": "SELECT node, time * 2 * 1000 AS time FROM v_node",
    "site_freqs": "SELECT chrom, pos, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(dp, 6) AS dp FROM v_pair",
    "coverage_floor": "SELECT chrom, pos, grp, ac, an FROM (SELECT v.*, max(an) OVER (PARTITION BY chrom) AS top FROM v_site v) WHERE an >= 0.5e0 * top AND an >= 2",
    "allele_match_rate": "SELECT chrom, count(*) AS n, round(avg(CASE WHEN (p_a > 0.5e0) = (p_b > 0.5e0) THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate FROM v_pair GROUP BY chrom",
    "dp_ladder": "SELECT t.cut, count(*) AS n, sum(CASE WHEN dp >= cut THEN 1 ELSE 0 END) AS hits, round(avg(CASE WHEN dp >= cut THEN 1.0e0 ELSE 0.0e0 END), 6) AS rate FROM v_pair CROSS JOIN (SELECT 0.2e0 AS cut UNION ALL SELECT 0.5e0 UNION ALL SELECT 0.8e0 UNION ALL SELECT 0.9e0 UNION ALL SELECT 0.95e0) t GROUP BY t.cut",
    "region_label": "SELECT region, count(*) AS n FROM (SELECT CASE WHEN body = 1 THEN 'body' WHEN idx BETWEEN 60 AND 159 THEN 'excluded' WHEN idx < 60 THEN 'control' ELSE 'rest' END AS region FROM v_pair) GROUP BY region",
    "id_normalise": "SELECT p_partkey, split_part(p_brand, '#', 1) AS head, regexp_replace(p_name, '[0-9]+$', '') AS base FROM part",
    "major_allele": "SELECT chrom, pos, CASE WHEN p_a > 0.5e0 THEN 'alt' WHEN p_a < 0.5e0 THEN 'ref' END AS major_a, coalesce(CASE WHEN p_b > 0.5e0 THEN 'alt' WHEN p_b < 0.5e0 THEN 'ref' END, 'none') AS major_b FROM v_pair",
    "tag_algebra": "SELECT a, b, a | b AS joined, a & b AS shared, CASE WHEN ((a | b) & SHIFT((a | b);1)) & 85 <> 0 THEN 1 ELSE 0 END AS conflict, (a & 170) / 2 + (a & 85) * 2 AS flipped FROM (SELECT p_partkey % 256 AS a, p_size % 256 AS b FROM part)",
    "join_groups": "SELECT a.chrom, a.pos, a.ac AS ac_a, a.an AS an_a, b.ac AS ac_b, b.an AS an_b FROM v_site a JOIN v_site b ON a.chrom = b.chrom AND a.pos = b.pos AND a.grp = 'AA' AND b.grp = 'BB'",
    "join_composite": "SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey % 10 = o_custkey % 10",
    "join_windows": "SELECT a.chrom, a.win, a.ac AS ac_AA, b.ac AS ac_BB FROM (SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, sum(ac) AS ac FROM v_site WHERE grp = 'AA' GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT)) a JOIN (SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, sum(ac) AS ac FROM v_site WHERE grp = 'BB' GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT)) b ON a.chrom = b.chrom AND a.win = b.win",
    "left_annot": """SELECT v.chrom, v.pos, g.gene, coalesce(g.term, 'none') AS term FROM v_pair v LEFT JOIN v_gene g ON g.chrom = v.chrom AND g.s + 1 = v.pos""",
    "semi_genes": "SELECT gene, term FROM v_gene g WHERE EXISTS (SELECT 1 FROM v_pair v WHERE v.chrom = g.chrom AND v.pos = g.s + 1 AND v.dp >= 0.5e0)",
    "anti_genes": "SELECT gene, term FROM v_gene g WHERE NOT EXISTS (SELECT 1 FROM v_pair v WHERE v.chrom = g.chrom AND v.pos = g.s + 1 AND v.dp >= 0.5e0)",
    "site_annotation": "SELECT chrom, pos, tx, degen, round(dp, 6) AS dp FROM v_annot",
    "transcript_dxy": "SELECT tx, count(*) AS n, round(avg(den), 6) AS dxy, round(median(den), 6) AS mid FROM v_annot GROUP BY tx",
    "codon_counts": "SELECT tx, sum(CASE WHEN degen = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN degen = 4 THEN 1 ELSE 0 END) AS n4, round(sum(CASE WHEN degen = 0 THEN num ELSE 0 END) / NULLIF(sum(CASE WHEN degen = 0 THEN den ELSE 0 END), 0), 6) AS fst0 FROM v_annot GROUP BY tx",
    "gene_go_sets": "SELECT family, count(*) AS n_terms, JOINED(term;term) AS terms FROM (SELECT DISTINCT family, term FROM v_gene) GROUP BY family",
    "distinct_counts": "SELECT count(DISTINCT tx) AS n_tx, count(DISTINCT chrom) AS n_chrom, count(DISTINCT pos) AS n_pos FROM v_annot",
    "topk_transcripts": "SELECT tx, count(*) AS hits FROM v_annot WHERE dp >= 0.3e0 GROUP BY tx ORDER BY hits DESC, tx LIMIT 10",
    "quantiles_exact": "SELECT body, round(PCT(dp;0.1), 6) AS q10, round(PCT(dp;0.5), 6) AS q50, round(PCT(dp;0.9), 6) AS q90, round(PCT(dp;0.999), 6) AS q999 FROM v_pair GROUP BY body",
    "topk_outliers": "SELECT chrom, pos, round(dp, 6) AS dp FROM v_pair ORDER BY round(dp, 6) DESC, chrom, pos LIMIT 25",
    "distinct_sites": "SELECT DISTINCT chrom, pos FROM v_call",
    "union_regions": "SELECT 'body' AS region, chrom, pos FROM v_pair WHERE body = 1 UNION ALL SELECT 'control', chrom, pos FROM v_pair WHERE idx < 60",
    "intersect_stats": "SELECT DISTINCT stat, rep FROM v_rep WHERE engine = 0 INTERSECT SELECT DISTINCT stat, rep FROM v_rep WHERE engine = 1",
    "except_sites": "SELECT chrom, pos FROM v_pair WHERE idx BETWEEN 60 AND 159 EXCEPT SELECT chrom, pos FROM v_pair WHERE body = 1",
    "cube_regions": "SELECT CASE WHEN grouping(chrom) = 1 THEN -1 ELSE chrom END AS chrom, CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp END AS grp, sum(ac) AS ac, sum(an) AS an FROM v_site GROUP BY CUBE(chrom, grp)",
    "neighbour_support": "SELECT chrom, idx, flag, sum(flag) OVER (PARTITION BY chrom ORDER BY idx RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) - flag AS support FROM (SELECT chrom, idx, CASE WHEN dp > 0.3e0 THEN 1 ELSE 0 END AS flag FROM v_pair)",
    "pi_windows": "SELECT win, round(sum(pi) / 20, 6) AS pi, round(sum(pi_a) / 20, 6) AS pi_a, round(sum(pi_b) / 20, 6) AS pi_b FROM v_div GROUP BY win",
    "dxy_windows": "SELECT win, round(dxy, 6) AS dxy FROM v_win",
    "fst_windows": "SELECT win, round(1 - (pi_a + pi_b) / 2 / NULLIF(dxy, 0), 6) AS fst FROM v_win",
    "fst_clipped": "SELECT win, round(CASE WHEN dxy <= 0 THEN 0.0e0 ELSE least(1.0e0, greatest(0.0e0, 1 - (pi_a + pi_b) / 2 / dxy)) END, 6) AS fst FROM v_win",
    "fst_floored": "SELECT win, round(1 - (pi_a + pi_b) / 2 / greatest(dxy, 1.0e-20), 6) AS fst FROM v_win",
    "fst_hudson_windows": "SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS win, round(greatest(0.0e0, sum(num) / sum(den)), 6) AS fst FROM v_hudson GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT) HAVING sum(den) > 0",
    "da_net": "SELECT win, round(dxy - (pi_a + pi_b) / 2, 6) AS da FROM v_win",
    "pairwise_diff": "SELECT a.win, round(a.pairs, 6) AS by_pairs, round(b.counts, 6) AS by_counts FROM (SELECT CAST(floor(x.site / 20) AS BIGINT) AS win, sum(CASE WHEN x.allele <> y.allele THEN 1.0e0 ELSE 0.0e0 END) / 300 AS pairs FROM v_hap x JOIN v_hap y ON x.site = y.site AND x.hap < y.hap GROUP BY CAST(floor(x.site / 20) AS BIGINT)) a JOIN (SELECT win, sum(pi) AS counts FROM v_div GROUP BY win) b ON a.win = b.win",
    "tajima_d_windows": """SELECT win, s, round(CASE WHEN s > 0 THEN (pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)) END, 6) AS d FROM (SELECT win, s, pi, a1, (b1 - 1 / a1) / a1 AS e1, (b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM (
  SELECT win, sum(CASE WHEN k > 0 AND k < n THEN 1 ELSE 0 END) AS s, sum(pi) AS pi FROM v_div GROUP BY win) CROSS JOIN (SELECT 25.0e0 AS n, sum(1.0e0 / i) AS a1, sum(1.0e0 / (i * i)) AS a2, 26.0e0 / 72 AS b1, 2 * 653.0e0 / 5400 AS b2 FROM (SEQ(1;24))))""",
    "arrangement_ratios": "SELECT sum(n_sites) AS n, round(avg(pi_b), 6) AS pi_i, round(avg(pi_a), 6) AS pi_s, round(avg(dxy), 6) AS dxy, round(avg(pi_b) / avg(pi_a), 6) AS pi_ratio, round(avg(dxy) / avg(pi_b), 6) AS dxy_ratio FROM v_win",
    "fst_identity": "SELECT win, round(1 - (pi_a / pi_b + 1) / (2 * dxy / pi_b), 6) AS by_ratios, round(1 - (pi_a + pi_b) / 2 / dxy, 6) AS by_pi FROM v_win WHERE pi_b > 0 AND dxy > 0",
    "polarization": """SELECT cut, n, round(aa * 1.0e0 / NULLIF(aa + bb, 0), 6) AS share_a, aa + bb AS votes FROM (SELECT t.cut, count(*) AS n, sum(CASE WHEN (p_a > 0.5e0) = (q > 0.5e0) AND q <> 0.5e0 THEN 1 ELSE 0 END) AS aa, sum(CASE WHEN (p_b > 0.5e0) = (q > 0.5e0) AND q <> 0.5e0 THEN 1 ELSE 0 END) AS bb
  FROM v_pair p JOIN v_out o ON o.chrom = p.chrom AND o.idx = p.idx JOIN (SELECT 0.0e0 AS cut UNION ALL SELECT 0.2e0 UNION ALL SELECT 0.4e0) t ON dp >= t.cut GROUP BY t.cut) WHERE n >= 20""",
    "density_match": """SELECT c.chrom, c.win, round(c.density, 9) AS density FROM v_density c CROSS JOIN (SELECT PCT(density;0.1) AS lo, PCT(density;0.9) AS hi FROM v_density WHERE body = 1) q WHERE c.body = 0 AND c.density BETWEEN lo AND hi""",
    "core_edge": "SELECT part, count(*) AS n, round(avg(dp), 6) AS dp FROM (SELECT dp, CASE WHEN abs(idx - 109.5e0) / 30 < 0.35e0 THEN 'core' WHEN abs(idx - 109.5e0) / 30 > 0.75e0 THEN 'edge' ELSE 'middle' END AS part FROM v_pair WHERE body = 1) GROUP BY part",
    "class_outliers": """SELECT chrom, win, round(z_a, 6) AS z_a, round(z_b, 6) AS z_b, CASE WHEN z_a < -2 AND z_a < z_b - 1 THEN 1 ELSE 0 END AS only_a, CASE WHEN z_b < -2 AND z_b < z_a - 1 THEN 1 ELSE 0 END AS only_b, round((r - mr) / NULLIF(sr, 0), 6) AS z_block FROM (SELECT w.*, h_a / NULLIF(h_b, 0) AS r, (h_a - ma) / NULLIF(sa, 0) AS z_a, (h_b - mb) / NULLIF(sb, 0) AS z_b FROM v_classwin w
  CROSS JOIN (SELECT median(h_a) AS ma, stddev_samp(h_a) AS sa, median(h_b) AS mb, stddev_samp(h_b) AS sb FROM v_classwin WHERE body = 0) c) x CROSS JOIN (SELECT median(h_a / NULLIF(h_b, 0)) AS mr, stddev_samp(h_a / NULLIF(h_b, 0)) AS sr FROM v_classwin WHERE body = 1) y WHERE body = 1""",
    "compartments": """SELECT c.body, c.degen, c.n, round(c.per_10k, 6) AS per_10k, round(c.dp, 6) AS dp, round(c.per_10k / NULLIF(i.per_10k, 0), 6) AS to_intergenic, round(c.per_10k / NULLIF(k.per_10k, 0), 6) AS to_control FROM v_comp c LEFT JOIN v_comp i ON i.body = c.body AND i.degen = 3 LEFT JOIN v_comp k ON k.body = 0 AND k.degen = c.degen WHERE c.n >= 500""",
    "transcript_ratio": """SELECT t.chrom, t.tx, round(t.den / NULLIF(w.den, 0), 6) AS ratio FROM (SELECT chrom, tx, avg(den) AS den, CAST(floor(median(pos) / 100000) AS BIGINT) AS win FROM v_annot GROUP BY chrom, tx) t
  LEFT JOIN (SELECT chrom, CAST(floor(pos / 100000) AS BIGINT) AS win, avg(den) AS den FROM v_hudson GROUP BY chrom, CAST(floor(pos / 100000) AS BIGINT)) w ON w.chrom = t.chrom AND w.win = t.win""",
    "asymmetry_mafbins": """SELECT bin, n, round(diff / NULLIF(wt, 0), 6) AS asym FROM (SELECT CASE WHEN maf < 0.02e0 THEN 0 WHEN maf < 0.05e0 THEN 1 WHEN maf < 0.1e0 THEN 2 ELSE 3 END AS bin, count(*) AS n, sum(diff) AS diff, sum(dp) AS wt FROM v_asym GROUP BY CASE WHEN maf < 0.02e0 THEN 0 WHEN maf < 0.05e0 THEN 1 WHEN maf < 0.1e0 THEN 2 ELSE 3 END) WHERE n > 20""",
    "asymmetry_jackknife": """SELECT count(*) AS blocks, round(count(*) * max(t) - (count(*) - 1) * avg(loo), 6) AS est, round(sqrt((count(*) - 1) * var_pop(loo)), 6) AS se FROM (SELECT d / w AS t, (d - diff) / (w - wt) AS loo FROM (SELECT chrom, CAST(floor(idx / 20) AS BIGINT) AS b, sum(diff) AS diff, sum(dp) AS wt FROM v_asym GROUP BY chrom, CAST(floor(idx / 20) AS BIGINT)) CROSS JOIN (SELECT sum(diff) AS d, sum(dp) AS w FROM v_asym))""",
    "shared_sites": """SELECT chrom, pos, an_a, an_b FROM v_pair JOIN (SELECT max(an_a) AS top_a, max(an_b) AS top_b FROM v_pair) t ON an_a >= 0.5e0 * top_a AND an_b >= 0.5e0 * top_b WHERE ac_a + ac_b > 0 AND ac_a + ac_b < an_a + an_b""",
}
