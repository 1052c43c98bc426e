"""Rejection ABC, grid fits and profiles."""

QUERIES = {
    "abc_usable": "SELECT sim, status, round(theta, 2) AS theta FROM v_sim WHERE status IS NOT NULL AND status <> 'P' AND s1 IS NOT NULL AND s2 IS NOT NULL",
    "abc_distance": "SELECT sim, round(dist, 6) AS dist FROM v_dist",
    "abc_reject": "SELECT sim, rn, round(dist, 6) AS dist FROM v_kept",
    "bayes_factor": "SELECT round((a / NULLIF(1 - a, 0)) / NULLIF(b / NULLIF(1 - b, 0), 0), 6) AS bf FROM (SELECT avg(CASE WHEN theta > 150000 THEN 1.0e0 ELSE 0.0e0 END) AS a FROM v_kept) CROSS JOIN (SELECT avg(CASE WHEN theta > 150000 THEN 1.0e0 ELSE 0.0e0 END) AS b FROM v_sim)",
    "posterior_quantiles": "SELECT round(PCT(theta;0.025), 2) AS lo, round(PCT(theta;0.5), 2) AS mid, round(PCT(theta;0.975), 2) AS hi FROM v_kept",
    "grid_score": "SELECT t_inv, model, round(sum(power(score / 1000 - 1, 2)), 6) AS miss FROM v_grid GROUP BY t_inv, model",
    "profile_min": "SELECT t_inv, round(score, 4) AS best, cell FROM (SELECT v.*, row_number() OVER (PARTITION BY t_inv ORDER BY score, cell) AS rn FROM v_grid v) WHERE rn = 1",
    "chi2_profile": "SELECT t_inv, round(best - min(best) OVER (), 6) AS delta FROM (SELECT t_inv, min(power((score - 1200) / 150, 2)) AS best FROM v_grid GROUP BY t_inv)",
}
