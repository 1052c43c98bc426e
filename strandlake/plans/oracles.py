"""DuckDB twins written apart from the queries: brute force or another formulation.

A query without one here has the twin that its own SQL text renders to.
"""

_P = "(SELECT p_partkey AS site, n_nationkey AS hap, CASE WHEN (p_partkey * 7 + n_nationkey * (p_size + 3)) % 11 < 4 THEN 1 ELSE 0 END AS g FROM part, nation)"
#: Samples and all nodes above them in the two trees of the fixture.
_UP = "up AS (SELECT DISTINCT tree, child AS sample, child AS node FROM v_tree WHERE child >= 0 UNION ALL SELECT u.tree, u.sample, t.parent FROM up u JOIN v_tree t ON t.tree = u.tree AND t.child = u.node)"
_T = "ln({0}) / 0.626e0 + ln(1 - {0}) / 0.374e0 - ln(abs(0.626e0 - {0})) / (0.626e0 * 0.374e0)"

#: Sites with Hudson's numerator and denominator, from the lines themselves.
_SITES = """SELECT chrom, idx, power(p - q, 2) - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1) AS num, p * (1 - q) + q * (1 - p) AS den FROM (SELECT l_partkey // 200 AS chrom, l_partkey % 200 AS idx, avg(g) FILTER (s = 0) AS p, avg(g) FILTER (s = 1) AS q, count(*) FILTER (s = 0) AS n, count(*) FILTER (s = 1) AS m FROM (
  SELECT l_partkey, l_suppkey % 2 AS s, CASE WHEN l_quantity > CASE WHEN l_partkey % 200 NOT BETWEEN 80 AND 139 THEN 25 WHEN l_suppkey % 2 = 0 THEN 35 ELSE 15 END THEN 1 ELSE 0 END AS g FROM lineitem) GROUP BY 1, 2) WHERE n >= 2 AND m >= 2"""
#: Bootstrap rounds of the grid fit: the draws of every round listed, weighed and compared.
_BOOT = """WITH p AS (SELECT p_size AS cell, p_partkey AS rep, p_retailprice AS a, CAST(p_partkey % 97 AS DOUBLE) AS b, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS idx, count(*) OVER (PARTITION BY p_size) AS n FROM part),
  v AS (SELECT var_samp(a) / 100 AS va, covar_samp(a, b) / 100 AS c, var_samp(b) / 100 AS vb FROM p), seen AS (SELECT avg(a) AS oa, avg(b) AS ob FROM p WHERE rep IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')),
  z AS (SELECT boot, oa + sqrt(va) * r * cos(w) AS ta, ob + c / sqrt(va) * r * cos(w) + sqrt(vb - c * c / va) * r * sin(w) AS tb FROM (SELECT boot, sqrt(-2 * ln((CAST('0x' || substr(s, 1, 12) AS BIGINT) + 0.5e0) / 281474976710656.0e0)) AS r, 2 * pi() * (CAST('0x' || substr(s, 13, 12) AS BIGINT) + 0.5e0) / 281474976710656.0e0 AS w FROM (SELECT boot, sha256('1-' || boot || '-noise') AS s FROM (SELECT unnest(range(100)) AS boot))), v, seen),
  m AS (SELECT d.boot, d.cell, avg(q.a) AS a, avg(q.b) AS b FROM (SELECT boot, cell, CAST('0x' || substr(sha256('1-' || boot || '-' || cell || '-' || idx), 1, 12) AS BIGINT) % n + 1 AS pick FROM p, (SELECT unnest(range(100)) AS boot)) d JOIN p q ON q.cell = d.cell AND q.idx = d.pick GROUP BY d.boot, d.cell),
  x AS (SELECT m.boot, cell, (power(a - ta, 2) * vb - 2 * (a - ta) * (b - tb) * c + power(b - tb, 2) * va) / (va * vb - c * c) AS chi2 FROM m JOIN z ON z.boot = m.boot, v),
  best AS (SELECT arg_min(cell, (round(chi2, 9), cell)) AS own FROM (SELECT cell, (power(avg(a) - oa, 2) * vb - 2 * (avg(a) - oa) * (avg(b) - ob) * c + power(avg(b) - ob, 2) * va) / (va * vb - c * c) AS chi2 FROM p, v, seen GROUP BY cell, oa, ob, va, vb, c))
  SELECT boot, arg_min(cell, (chi2, cell)) AS cell, min(chi2) AS chi2, max(chi2) FILTER (cell = own) - min(chi2) AS delta FROM x, best GROUP BY boot"""
#: KS by brute force, and its exact p by counting lattice paths along their steps.
_KS = """WITH RECURSIVE v AS MATERIALIZED (SELECT stat, engine, value FROM v_rep WHERE value IS NOT NULL), g AS MATERIALIZED (SELECT stat, max(abs(fa - fb)) AS ks, max(n) AS n, max(m) AS m FROM (SELECT stat, value, sum(a) OVER w * 1.0e0 / sum(a) OVER t AS fa, sum(b) OVER w * 1.0e0 / sum(b) OVER t AS fb, sum(a) OVER t AS n, sum(b) OVER t AS m FROM (SELECT stat, value, count(*) FILTER (engine = 0) AS a, count(*) FILTER (engine = 1) AS b FROM v GROUP BY stat, value) WINDOW w AS (PARTITION BY stat ORDER BY value), t AS (PARTITION BY stat)) GROUP BY stat),
  h AS MATERIALIZED (SELECT stat, n, m, round(ks * n * m) AS edge FROM g), path AS (SELECT stat, 0 AS step, CAST(0 AS BIGINT) AS i, 1.0e0 AS w FROM h WHERE edge > 0 UNION ALL SELECT stat, step, i, sum(w) FROM (SELECT p.stat, p.step + 1 AS step, p.i + o.d AS i, CASE WHEN o.d = 1 THEN p.i + 1 ELSE p.step - p.i + 1 END * p.w / (p.step + 1.0e0) AS w, n, m, edge FROM path p JOIN h ON h.stat = p.stat, (SELECT unnest([0, 1]) AS d) o WHERE p.step < n + m) WHERE i <= n AND step - i <= m AND abs(i * m - (step - i) * n) < edge GROUP BY stat, step, i)
  SELECT g.stat, ks, CASE WHEN edge <= 0 THEN 1.0e0 ELSE 1 - coalesce((SELECT max(w) FROM path WHERE path.stat = g.stat AND path.step = g.n + g.m), 0) END AS p FROM g JOIN h ON h.stat = g.stat"""
_D = "SELECT stat, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM (SELECT stat, count(value) FILTER (engine = 0) AS n0, count(value) FILTER (engine = 1) AS n1, avg(value) FILTER (engine = 0) AS m0, avg(value) FILTER (engine = 1) AS m1, var_samp(value) FILTER (engine = 0) AS v0, var_samp(value) FILTER (engine = 1) AS v1 FROM v_rep GROUP BY stat)"
_SAID = "CASE WHEN p > 0.01e0 AND abs(d) < 0.2e0 THEN 'equivalent' WHEN p < 0.01e0 AND abs(d) > 0.2e0 THEN 'not_equivalent' ELSE 'investigate' END"
_SIMPLIFY = """WITH arms AS (SELECT t.tree, t.parent AS node FROM v_tree t JOIN v_below b ON b.tree = t.tree AND b.node = t.child GROUP BY t.tree, t.parent HAVING count(*) > 1), chain AS (SELECT tree, sample, sample AS node, 0 AS d FROM v_up UNION ALL SELECT tree, sample, n1, 1 FROM v_up UNION ALL SELECT tree, sample, n2, 2 FROM v_up UNION ALL SELECT tree, sample, n3, 3 FROM v_up),
  held AS (SELECT c.* FROM chain c LEFT JOIN arms a ON a.tree = c.tree AND a.node = c.node WHERE c.d = 0 OR a.node IS NOT NULL), links AS (SELECT DISTINCT x.tree, x.node AS child, y.node AS parent FROM held x JOIN held y ON x.tree = y.tree AND x.sample = y.sample AND y.d = (SELECT min(d) FROM held z WHERE z.tree = x.tree AND z.sample = x.sample AND z.d > x.d))
  SELECT parent, child, 0 AS l, 1000000 AS r FROM (SELECT parent, child FROM links WHERE tree = 0 INTERSECT SELECT parent, child FROM links WHERE tree = 500000) UNION ALL SELECT parent, child, tree, tree + 500000 FROM links WHERE (parent, child) NOT IN (SELECT (parent, child) FROM links GROUP BY parent, child HAVING count(*) > 1)"""

ORACLES = {
    "mask_intersect_bp": """WITH a AS (SELECT DISTINCT unnest(range(o_orderkey * 37 % 200000, o_orderkey * 37 % 200000 + 50 + o_custkey % 400)) AS x FROM orders), b AS (SELECT DISTINCT unnest(range(p_partkey * 97 % 200000, p_partkey * 97 % 200000 + 100 + p_size * 5)) AS x FROM part)
  SELECT coalesce(a.x, b.x) // 5000 AS w, count(a.x + b.x) AS both_bp, count(*) AS either_bp, count(a.x) - count(a.x + b.x) AS only_bp FROM a FULL JOIN b ON a.x = b.x GROUP BY 1""",
    "interval_subtract": """SELECT gene, kind, min(x) AS l, max(x) + 1 AS r FROM (SELECT gene, CASE WHEN x BETWEEN 70000 AND 129999 THEN 'shared' ELSE 'minus' END AS kind, x, x >= 130000 AS side FROM (SELECT p_partkey AS gene, unnest(range((p_partkey % 200) * 1000, (p_partkey % 200) * 1000 + p_size * 60)) AS x FROM part)) GROUP BY gene, kind, side""",
    "interval_coverage": "SELECT p_partkey // 200 AS chrom, sum(p_size * 60) AS total, sum(len(list_filter(range((p_partkey % 200) * 1000, (p_partkey % 200) * 1000 + p_size * 60), lambda x: x >= 70000 AND x < 130000))) AS shared, sum(len(list_filter(range((p_partkey % 200) * 1000, (p_partkey % 200) * 1000 + p_size * 60), lambda x: x < 70000 OR x >= 130000))) AS remaining FROM part GROUP BY 1",
    "segment_overlap": "SELECT a.gene AS a, b.gene AS b, least(a.e, b.e) - greatest(a.s, b.s) AS bp FROM v_gene a JOIN v_gene b ON a.chrom = b.chrom AND a.gene < b.gene AND least(a.e, b.e) > greatest(a.s, b.s)",
    "interval_join": "SELECT v.chrom, v.pos, g.gene FROM v_pair v JOIN v_gene g ON v.chrom = g.chrom AND v.pos BETWEEN g.s + 1 AND g.e",
    "sites_outside_genes": "SELECT v.chrom, v.pos, t.term FROM v_pair v CROSS JOIN (SELECT DISTINCT p_type AS term FROM part) t LEFT JOIN v_gene g ON g.term = t.term AND v.chrom = g.chrom AND v.pos BETWEEN g.s + 1 AND g.e WHERE g.gene IS NULL",
    "nearest_gene": "SELECT v.chrom, v.pos, min(least(abs(g.s - v.pos), abs(g.e - v.pos))) AS dist FROM v_pair v LEFT JOIN v_gene g ON g.chrom = v.chrom GROUP BY v.chrom, v.pos",
    "asof_step": "SELECT event_id, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT event_id, user_id, ts - to_days(CAST(900 + event_id % 80 * 30 AS INTEGER)) AS at FROM events) e ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC, o_totalprice DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate",
    "interp_linear": """WITH o AS (SELECT o_custkey, o_orderdate AS day, max(o_totalprice) AS price FROM orders GROUP BY o_custkey, o_orderdate), e AS (SELECT event_id, user_id, ts - to_days(CAST(900 + event_id % 80 * 30 AS INTEGER)) AS at FROM events)
  SELECT b.event_id, round(CASE WHEN a.day IS NULL THEN b.price ELSE b.price + (a.price - b.price) * (epoch_us(b.at) - epoch_us(b.day)) / (epoch_us(a.day) - epoch_us(b.day)) END, 4) AS price FROM (SELECT e.event_id, e.user_id, e.at, o.day, o.price FROM e ASOF JOIN o ON e.user_id = o.o_custkey AND e.at >= o.day) b LEFT JOIN (SELECT e.event_id, o.day, o.price FROM e ASOF JOIN o ON e.user_id = o.o_custkey AND e.at < o.day) a ON a.event_id = b.event_id""",
    "interp_bilinear": """SELECT a.x, b.y, round((SELECT sum(m * greatest(0, 1 - abs(t - ti)) * greatest(0, 1 - abs(q - pi))) FROM v_surface), 2) AS z FROM (SELECT i AS x, least(4.0e0, greatest(0.0e0, i / 5.0e0 - 0.4e0)) AS t FROM (SEQ(0;26))) a, (SELECT i AS y, least(4.0e0, i / 6.0e0) AS q FROM (SEQ(0;26))) b""",
    "coverage_at": "SELECT x, (SELECT count(*) FROM v_flux f WHERE x BETWEEN f.tl AND f.tr) AS depth FROM (SELECT tl AS x FROM v_flux UNION SELECT tr + 1 FROM v_flux)",
    "survival_curve": "SELECT d, round((SELECT avg(CASE WHEN tr - tl >= d THEN 1.0e0 ELSE 0 END) FROM v_flux), 6) AS s FROM (SELECT DISTINCT tr - tl AS d FROM v_flux)",
    "escape_exposure": """SELECT event_id, round(sum(500.0e0 * (CASE WHEN x >= 1000 AND x < 3000 THEN CASE WHEN lineage % 2 = 0 THEN 0.7e0 ELSE 0.3e0 END ELSE 1 END) * (CASE WHEN x >= 2000 AND x < 4200 THEN CASE WHEN (lineage // 2) % 2 = 0 THEN 0.6e0 ELSE 0.4e0 END ELSE 1 END)), 4) AS exposure
  FROM (SELECT event_id, lineage, unnest(CASE WHEN tl <= 2500 AND tr > 2500 THEN [0] WHEN tr <= 2500 THEN range(tr, 2500) ELSE range(2500, tl) END) AS x, tl, tr FROM v_flux WHERE NOT (tl <= 2500 AND tr > 2500) AND tr <> 2500 AND tl <> 2500) GROUP BY event_id UNION ALL SELECT event_id, 0.0e0 FROM v_flux WHERE (tl <= 2500 AND tr > 2500) OR tr = 2500 OR tl = 2500""",
    "ld_decay": f"""WITH h AS {_P}, f AS (SELECT site, avg(g) AS p FROM h GROUP BY site) SELECT (b.site - a.site) // 2 AS bin, count(*) AS pairs, round(avg(power(c.pab - a.p * b.p, 2) / (a.p * (1 - a.p) * b.p * (1 - b.p))), 6) AS r2 FROM f a JOIN f b ON b.site - a.site BETWEEN 1 AND 9
  JOIN (SELECT x.site AS s, y.site AS t, avg(x.g * y.g) AS pab FROM h x JOIN h y ON x.hap = y.hap AND y.site - x.site BETWEEN 1 AND 9 GROUP BY x.site, y.site) c ON c.s = a.site AND c.t = b.site WHERE a.p * (1 - a.p) * b.p * (1 - b.p) > 1.0e-12 GROUP BY 1""",
    "pi_windows": f"""WITH h AS {_P}, d AS (SELECT x.site // 20 AS win, x.hap % 2 AS ga, y.hap % 2 AS gb, sum(CASE WHEN x.g <> y.g THEN 1.0e0 ELSE 0 END) AS diff FROM h x JOIN h y ON x.site = y.site AND x.hap < y.hap GROUP BY 1, 2, 3)
  SELECT win, round(sum(diff) / 300 / 20, 6) AS pi, round(sum(CASE WHEN ga = 0 AND gb = 0 THEN diff END) / 78 / 20, 6) AS pi_a, round(sum(CASE WHEN ga = 1 AND gb = 1 THEN diff END) / 66 / 20, 6) AS pi_b FROM d GROUP BY win""",
    "dxy_windows": f"WITH h AS {_P} SELECT x.site // 20 AS win, round(sum(CASE WHEN x.g <> y.g THEN 1.0e0 ELSE 0 END) / 156 / 20, 6) AS dxy FROM h x JOIN h y ON x.site = y.site AND x.hap % 2 = 0 AND y.hap % 2 = 1 GROUP BY 1",
    "sfs_project": f"""SELECT m.i AS k, round(sum(s.c * exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(26 - k) - lgamma(11 - i) - lgamma(16 - k + i) - lgamma(26) + lgamma(11) + lgamma(16))), 6) AS n FROM (SELECT k, count(*) AS c FROM (SELECT site, sum(g) AS k FROM {_P} GROUP BY site) GROUP BY k) s JOIN (SEQ(0;10)) m ON m.i <= s.k AND 10 - m.i <= 25 - s.k GROUP BY m.i""",
    "h_stats": f"""WITH h AS {_P}, w AS (SELECT win, s, count(*) / 25.0e0 AS f FROM (SELECT site // 5 AS win, hap, list(g ORDER BY site) AS s FROM h GROUP BY 1, 2) GROUP BY win, s), o AS (SELECT win, list(f ORDER BY f DESC) AS f FROM w GROUP BY win)
  SELECT win, round(list_sum(list_transform(f, lambda x: x * x)), 6) AS h1, round(power(f[1] + coalesce(f[2], 0), 2) + list_sum(list_transform(f, lambda x: x * x)) - f[1] * f[1] - coalesce(f[2] * f[2], 0), 6) AS h12, round(list_sum(list_transform(f, lambda x: x * x)) - f[1] * f[1], 6) AS h2, round(1 - f[1] * f[1] / list_sum(list_transform(f, lambda x: x * x)), 6) AS h2_h1 FROM o""",
    "window_null": """WITH w AS (SELECT chrom, unnest(range(0, last + 1)) AS win FROM (SELECT chrom, max(s // 60000) AS last FROM v_gene WHERE chrom <> 0 GROUP BY chrom)), t AS (SELECT term, count(*) AS k FROM v_gene WHERE chrom = 0 AND s BETWEEN 80000 AND 139000 GROUP BY term)
  SELECT t.term, t.k, round(avg(CASE WHEN (SELECT count(*) FROM v_gene g WHERE g.term = t.term AND g.chrom = w.chrom AND g.s // 60000 = w.win) >= t.k THEN 1.0e0 ELSE 0 END), 6) AS p FROM t, w GROUP BY t.term, t.k""",
    "bootstrap_fit": f"SELECT boot, cell, round(chi2, 5) AS chi2, round(delta, 5) AS delta FROM ({_BOOT})",
    "bootstrap_bound": f"SELECT round(quantile_cont(delta, 0.95), 5) AS bound, round(avg(CASE WHEN delta = 0 THEN 1.0e0 ELSE 0 END), 6) AS won FROM ({_BOOT})",
    "surface_root": """WITH RECURSIVE g AS (SELECT i, j, coalesce(avg(p_retailprice), (SELECT avg(p_retailprice) FROM part)) AS a, coalesce(avg(p_partkey % 97), (SELECT avg(p_partkey % 97) FROM part)) AS b FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j) LEFT JOIN part ON (p_size - 1) // 10 = i AND p_partkey % 5 = j GROUP BY i, j),
  t AS (SELECT p_brand AS brand, avg(p_retailprice) AS ta, avg(p_partkey % 97) AS tb FROM part GROUP BY p_brand), o AS (SELECT x - 2 AS dx, y - 2 AS dy FROM (SELECT unnest(range(5)) AS x), (SELECT unnest(range(5)) AS y)),
  s AS (SELECT brand, 0 AS r, 0.125e0 AS step, arg_min(x, (miss, x, y)) AS x, arg_min(y, (miss, x, y)) AS y, min(miss) AS miss FROM (SELECT brand, x, y, power((sum(a * greatest(0, 1 - abs(x - i)) * greatest(0, 1 - abs(y - j))) - ta) / abs(ta), 2) + power((sum(b * greatest(0, 1 - abs(x - i)) * greatest(0, 1 - abs(y - j))) - tb) / abs(tb), 2) AS miss FROM t, g, (SELECT unnest(range(17)) / 4.0e0 AS x), (SELECT unnest(range(17)) / 4.0e0 AS y) GROUP BY brand, ta, tb, x, y) GROUP BY brand
  UNION ALL SELECT brand, r + 1, CASE WHEN min(miss) < had THEN step ELSE step / 2 END, arg_min(x, (miss, x, y)), arg_min(y, (miss, x, y)), min(miss) FROM (SELECT brand, r, step, had, x, y, power((sum(a * greatest(0, 1 - abs(x - i)) * greatest(0, 1 - abs(y - j))) - ta) / abs(ta), 2) + power((sum(b * greatest(0, 1 - abs(x - i)) * greatest(0, 1 - abs(y - j))) - tb) / abs(tb), 2) AS miss
  FROM (SELECT DISTINCT s.brand, r, step, s.miss AS had, ta, tb, least(4.0e0, greatest(0.0e0, s.x + dx * step)) AS x, least(4.0e0, greatest(0.0e0, s.y + dy * step)) AS y FROM s JOIN t ON t.brand = s.brand, o WHERE r < 80) c, g GROUP BY brand, r, step, had, ta, tb, x, y) GROUP BY brand, r, step, had)
  SELECT brand, round(x, 3) AS x, round(y, 3) AS y, round(miss, 6) AS miss FROM s WHERE r = 80""",
    "roundtrip_tsv": "SELECT chrom, pos, grp, ac, an FROM v_site WHERE pos >= 40000 AND pos < 160000",
    "roundtrip_tsv_parts": "SELECT sim, CASE WHEN sim % 5 > 0 THEN status END AS status, round(theta, 2) AS theta FROM v_sim",
    "roundtrip_csv": "SELECT CAST(chrom AS VARCHAR) AS c, term, count(*) AS n, sum(e - s) AS bp FROM v_gene GROUP BY chrom, term",
    "roundtrip_json_lines": "SELECT engine, stat, count(DISTINCT rep) AS n_reps, round(avg(value), 6) AS mean FROM v_rep r GROUP BY engine, stat HAVING count(DISTINCT rep) = (SELECT count(DISTINCT rep) FROM v_rep o WHERE o.engine = r.engine)",
    "roundtrip_spectrum": "SELECT i AS k, CAST((SELECT count(*) FROM v_hsite h WHERE h.k = i) AS DOUBLE) AS n FROM (SEQ(0;25))",
    "roundtrip_vcf": "SELECT site AS pos, pop, sum(allele) AS ac, count(*) AS an FROM v_hap WHERE (site + hap) % 7 <> 0 GROUP BY site, pop",
    "window_ratio_fst": f"SELECT chrom, idx // 20 AS win, count(*) AS n_sites, round(sum(num) / sum(den), 6) AS fst FROM ({_SITES}) GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(den) > 0",
    "block_jackknife_multi": f"""WITH b AS (SELECT CASE WHEN idx BETWEEN 80 AND 139 THEN 1 ELSE 0 END AS body, idx // 10 AS b, sum(num) AS num, sum(den) AS den FROM ({_SITES}) GROUP BY 1, 2), o AS (SELECT x.body, x.b, sum(y.num) / sum(y.den) AS loo FROM b x JOIN b y ON y.body = x.body AND y.b <> x.b GROUP BY x.body, x.b)
  SELECT body, round(theta, 6) AS theta, round(sqrt((n - 1.0e0) / n * dev), 6) AS se FROM (SELECT body, sum(num) / sum(den) AS theta FROM b GROUP BY body) JOIN (SELECT body, count(*) AS n, sum(power(loo, 2)) - power(sum(loo), 2) / count(*) AS dev FROM o GROUP BY body) USING (body)""",
    "wls_slope": "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part",
    "moment_test": "SELECT stat, round(z, 6) AS z, CAST(abs(z) <= 3 AS INTEGER) AS ok, CAST(abs(z) <= 2.5758293035489004e0 AS INTEGER) AS ok_family FROM (SELECT a.event_type AS stat, (a.m - b.m) / sqrt(a.e + b.e) AS z FROM (SELECT event_type, avg(value) AS m, var_samp(value) / count(*) AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, avg(value) AS m, var_samp(value) / count(*) AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1) b USING (event_type))",
    "tajima_d_windows": f"""WITH h AS {_P}, c AS (SELECT list_sum(list_transform(range(1, 25), lambda i: 1.0e0 / i)) AS a1, list_sum(list_transform(range(1, 25), lambda i: 1.0e0 / (i * i))) AS a2), p AS (SELECT x.site // 20 AS win, sum(CASE WHEN x.g <> y.g THEN 1.0e0 ELSE 0 END) / (25 * 24 / 2) AS pi FROM h x JOIN h y ON x.site = y.site AND x.hap < y.hap GROUP BY 1), s AS (SELECT site // 20 AS win, count(*) FILTER (k BETWEEN 1 AND 24) AS s FROM (SELECT site, sum(g) AS k FROM h GROUP BY site) GROUP BY 1)
  SELECT win, s, round(CASE WHEN s > 0 THEN (pi - s / a1) / sqrt(s * (26.0e0 / 72 - 1 / a1) / a1 + s * (s - 1.0e0) * (2 * 653.0e0 / 5400 - 27 / (a1 * 25) + a2 / (a1 * a1)) / (a1 * a1 + a2)) END, 6) AS d FROM s JOIN p USING (win), c""",
    "ks_stat": f"SELECT stat, round(ks, 6) AS ks, round(p, 6) AS p FROM ({_KS})",
    "verdict": f"SELECT stat, round(ks, 6) AS ks, round(p, 6) AS p, round(d, 6) AS d, {_SAID} AS verdict FROM ({_KS}) JOIN ({_D}) USING (stat)",
    "equivalence_table": f"""SELECT stat, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, CASE WHEN stat = 'purchase' THEN 'convention_diff' ELSE {_SAID} END AS state FROM ({_KS}) JOIN ({_D}) USING (stat) JOIN (SELECT stat, count(DISTINCT rep) FILTER (engine = 0) AS n_a, count(DISTINCT rep) FILTER (engine = 1) AS n_b, avg(value) FILTER (engine = 0) AS mean_a, avg(value) FILTER (engine = 1) AS mean_b FROM v_rep GROUP BY stat) USING (stat)""",
    "welch_t": """WITH s AS (SELECT stat, engine, count(value) AS n, avg(value) AS m, var_samp(value) / count(value) AS e FROM v_rep GROUP BY stat, engine), w AS (SELECT a.stat, (a.m - b.m) / sqrt(a.e + b.e) AS t, power(a.e + b.e, 2) / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)) AS df FROM s a JOIN s b ON a.stat = b.stat AND a.engine = 0 AND b.engine = 1)
  SELECT stat, round(t, 6) AS t, round(df, 4) AS df, round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * list_sum(list_transform(range(0, 20001), lambda i: CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(abs(t) * i / 20000.0e0, 2) / df, -(df + 1) / 2))) * abs(t) / 60000, 6) AS p FROM w""",
    "ld_sampled": f"""WITH h AS {_P}, r AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS rank, p, gs FROM (SELECT site, avg(g) AS p, list(g ORDER BY hap) AS gs FROM h GROUP BY site)), t AS (SELECT count(*) AS n FROM r),
  d AS (SELECT b, sha256('7-' || b || '-' || i) AS s FROM (SELECT unnest(range(0, greatest(1, length(bin(n - 1))))) AS b FROM t), (SELECT unnest(range(0, 2000)) AS i)),
  w AS (SELECT DISTINCT b, rank, rank + (1 << b) + CAST('0x' || substr(s, 13, 12) AS BIGINT) % (1 << b) AS other FROM (SELECT b, s, CAST('0x' || substr(s, 1, 12) AS BIGINT) % n AS rank FROM d, t))
  SELECT b AS bin, count(*) AS pairs, round(avg(power(list_dot_product(x.gs::DOUBLE[], y.gs::DOUBLE[]) / len(x.gs) - x.p * y.p, 2) / (x.p * (1 - x.p) * y.p * (1 - y.p))), 6) AS r2 FROM w JOIN r x ON x.rank = w.rank JOIN r y ON y.rank = w.other WHERE x.p * (1 - x.p) * y.p * (1 - y.p) > 1.0e-12 GROUP BY b""",
    "pairwise_missing": """WITH c AS (SELECT l_partkey AS site, l_suppkey % 25 AS hap, arg_min(l_quantity, (l_orderkey, l_linenumber)) > 25 AS g FROM lineitem GROUP BY ALL), p AS (SELECT x.site // 50 AS win, x.hap, y.hap AS hap2, count(*) AS n, sum(CASE WHEN x.g <> y.g THEN 1 ELSE 0 END) AS d FROM c x JOIN c y ON x.site = y.site AND x.hap < y.hap GROUP BY 1, 2, 3)
  SELECT win, sum(n) AS compared, sum(d) AS differ, round(avg(d * 1.0e0 / n), 6) AS pi FROM p GROUP BY win""",
    "fisher_exact": """WITH t AS (SELECT p_brand AS tx, count(*) FILTER (p_size < 25 AND p_type < 'M') AS a, count(*) FILTER (p_size < 25 AND p_type >= 'M') AS b, count(*) FILTER (p_size >= 25 AND p_type < 'M') AS c, count(*) FILTER (p_size >= 25 AND p_type >= 'M') AS d FROM part GROUP BY p_brand),
  w AS (SELECT t.*, i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t) t)
  SELECT tx, a, b, c, d, round(least(1, sum(exp(lp)) FILTER (lp <= own + 1.0e-7)), 6) AS p, CASE WHEN b * c > 0 THEN round(1.0e0 * a * d / (b * c), 6) WHEN a * d > 0 THEN CAST('Infinity' AS DOUBLE) END AS odds FROM (SELECT *, max(lp) FILTER (i = a) OVER (PARTITION BY tx) AS own FROM w) GROUP BY tx, a, b, c, d""",
    "block_jackknife": """WITH t AS (SELECT b, (SELECT sum(num) / sum(den) FROM v_block o WHERE o.block <> i.block) AS loo, (SELECT sum(num) / sum(den) FROM v_block) AS theta FROM (SELECT block, count(*) OVER () AS b FROM v_block) i)
  SELECT round(max(theta), 6) AS theta, round(max(b) * max(theta) - (max(b) - 1) * avg(loo), 6) AS est, round(sqrt((max(b) - 1.0e0) / max(b) * sum(power(loo - m, 2))), 6) AS se FROM t, (SELECT avg(loo) AS m FROM t)""",
    "tandem_collapse": "SELECT family, count(*) AS genes, sum(CASE WHEN EXISTS (SELECT 1 FROM v_gene o WHERE o.family = g.family AND o.chrom = g.chrom AND (o.s, o.gene) < (g.s, g.gene) AND g.s - o.s <= 20000) THEN 0 ELSE 1 END) AS clusters FROM v_gene g GROUP BY family",
    "neighbour_support": "WITH f AS (SELECT chrom, idx, CASE WHEN dp > 0.3e0 THEN 1 ELSE 0 END AS flag FROM v_pair) SELECT a.chrom, a.idx, a.flag, (SELECT coalesce(sum(b.flag), 0) FROM f b WHERE b.chrom = a.chrom AND b.idx BETWEEN a.idx - 3 AND a.idx + 3 AND b.idx <> a.idx) AS support FROM f a",
    "pop_components": """WITH RECURSIVE e AS (SELECT a, b FROM v_popedge UNION SELECT b, a FROM v_popedge), r AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS pop, min(b) AS label FROM r GROUP BY a""",
    "branch_windows": """SELECT win, round(sum(pi * part) / 300000, 6) AS pi FROM (SELECT i AS win, b.tree, least(b.tree + 500000, (i + 1) * 300000) - greatest(b.tree, i * 300000) AS part, b.pi FROM (SEQ(0;3)) w JOIN (SELECT tree, sum(blen * 2 * k * (n - k) / (n * (n - 1.0e0))) AS pi FROM v_branch CROSS JOIN v_totals GROUP BY tree) b ON b.tree < (i + 1) * 300000 AND b.tree + 500000 > i * 300000) GROUP BY win""",
    "simplify": _SIMPLIFY,
    "simplify_map": f"SELECT node, row_number() OVER (ORDER BY is_sample DESC, time, node) - 1 AS new FROM v_node WHERE node IN (SELECT unnest([parent, child]) FROM ({_SIMPLIFY}))",
    "pair_mrca": f"""WITH RECURSIVE {_UP}, p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey // 10 = b.c_custkey // 10 AND a.c_custkey < b.c_custkey),
  m AS (SELECT p.a, p.b, x.tree, arg_min(x.node, n.time) AS node, min(n.time) AS time FROM p JOIN up x ON x.sample = p.a JOIN up y ON y.sample = p.b AND y.tree = x.tree AND y.node = x.node JOIN v_node n ON n.node = x.node GROUP BY p.a, p.b, x.tree)
  SELECT a, b, node, time, min(tree) AS l, max(tree) + 500000 AS r FROM m GROUP BY a, b, node, time""",
    "converted_fraction": f"""WITH RECURSIVE {_UP}, f AS (SELECT tl, tr, CASE WHEN event_id % 10 = 0 THEN lineage % 5 - 2000000 WHEN event_id % 10 < 5 THEN lineage % 25 - 1000000 ELSE lineage END AS node FROM v_flux)
  SELECT x, count(DISTINCT sample) AS converted, round(count(DISTINCT sample) * 1.0e0 / (SELECT count(*) FROM customer), 6) AS share FROM (SELECT i * 250 AS x, i * 50000 // 500000 * 500000 AS tree FROM (SEQ(0;19))) q JOIN f ON q.x BETWEEN f.tl AND f.tr JOIN up u ON u.node = f.node AND u.tree = q.tree GROUP BY x""",
    "genotype_counts": f"""WITH RECURSIVE {_UP}, m AS (SELECT o_orderkey AS site, o_orderkey * 37 % 1000000 // 500000 * 500000 AS tree, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 25 - 1000000 ELSE o_custkey END AS node FROM orders)
  SELECT site, count(*) AS k, sum(CASE WHEN sample % 2 = 0 THEN 1 ELSE 0 END) AS k_a FROM m JOIN up ON up.node = m.node AND up.tree = m.tree GROUP BY site""",
    "breakpoint_partition": "SELECT a.x AS l, min(b.x) AS r FROM (SELECT l AS x FROM v_edge UNION SELECT r FROM v_edge) a JOIN (SELECT l AS x FROM v_edge UNION SELECT r FROM v_edge) b ON b.x > a.x GROUP BY a.x",
    "bisect_root": f"""WITH RECURSIVE s AS (SELECT DISTINCT p_size * 8.0e0 AS t, 0.01e0 AS lo, 0.626e0 * (1 - 1.0e-12) AS hi, 0 AS n FROM part UNION ALL SELECT t, CASE WHEN ({_T.format('((lo + hi) / 2)')} - ({_T.format('0.01e0')})) / (0.02e0 / 0.626e0) < t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ({_T.format('((lo + hi) / 2)')} - ({_T.format('0.01e0')})) / (0.02e0 / 0.626e0) < t THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM s WHERE n < 60)
  SELECT p_partkey AS id, t, round((lo + hi) / 2, 6) AS p FROM s JOIN part ON p_size * 8.0e0 = t WHERE n = 60""",
}
