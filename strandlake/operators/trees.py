"""Tree sequences as node and edge relations."""

QUERIES = {
    "edge_canonical_sort": "SELECT row_number() OVER (ORDER BY p.time, e.parent, e.child, e.l) AS rn, e.parent, e.child, e.l, e.r FROM v_edge e JOIN v_node p ON p.node = e.parent",
    "branch_diversity": "SELECT tree, round(sum(blen * 2 * k * (n - k) / (n * (n - 1.0e0))), 6) AS pi FROM v_branch CROSS JOIN v_totals GROUP BY tree",
    "branch_divergence": "SELECT tree, round(sum(blen * (k_a * (n_b - k_b) + k_b * (n_a - k_a)) / (1.0e0 * n_a * n_b)), 6) AS dxy FROM v_branch CROSS JOIN v_totals GROUP BY tree",
    "afs_branch": "SELECT k, round(w / sum(w) OVER (), 6) AS f FROM (SELECT k, sum(blen) AS w FROM v_branch CROSS JOIN v_totals WHERE k < n GROUP BY k)",
    "tmrca": "SELECT b.tree, min(n.time) AS tmrca FROM v_below b JOIN v_node n ON n.node = b.node CROSS JOIN v_totals WHERE b.k = v_totals.n GROUP BY b.tree",
    "total_branch": "SELECT tree, sum(blen) AS total FROM v_branch GROUP BY tree",
    "colless": "SELECT a.tree, sum(abs(x.k - y.k)) AS colless FROM v_tree a JOIN v_tree b ON a.tree = b.tree AND a.parent = b.parent AND a.child < b.child JOIN v_below x ON x.tree = a.tree AND x.node = a.child JOIN v_below y ON y.tree = b.tree AND y.node = b.child WHERE a.parent < -1000000 GROUP BY a.tree",
    "karyotype_split": "SELECT tree, sum(CASE WHEN node = -1999999 THEN k ELSE 0 END) AS derived, max(k) - sum(CASE WHEN node = -1999999 THEN k ELSE 0 END) AS ancestral FROM v_below GROUP BY tree",
}
