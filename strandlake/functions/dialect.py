"""One SQL text for Spark and DuckDB; the few differences are macros written NAME(a;b)."""

from __future__ import annotations

import re

#: ln(n!) as ln((n + 8)!), by Stirling's series (off by 2e-12 at most, before rounding), less ln((n + 1) ... (n + 8)).
_LNFACT = (
    "(({0} + 8.5e0) * ln({0} + 9.0e0) - ({0} + 9.0e0) + 0.9189385332046727e0 + 1.0e0 / (12 * ({0} + 9.0e0)) - 1.0e0 / (360 * power({0} + 9.0e0, 3)) + 1.0e0 / (1260 * power({0} + 9.0e0, 5)) - 1.0e0 / (1680 * power({0} + 9.0e0, 7))"
    " - ln(({0} + 1.0e0) * ({0} + 2.0e0) * ({0} + 3.0e0) * ({0} + 4.0e0) * ({0} + 5.0e0) * ({0} + 6.0e0) * ({0} + 7.0e0) * ({0} + 8.0e0)))"
)
#: Macro -> (Spark form, DuckDB form).
MACROS = {
    "SEQ": ("SELECT explode(sequence({0}, {1})) AS i", "SELECT unnest(generate_series({0}, {1})) AS i"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "HEX": ("CAST(conv({0}, 16, 10) AS BIGINT)", "CAST(('0x' || {0}) AS BIGINT)"),
    "JOINED": ("listagg({0}, ',') WITHIN GROUP (ORDER BY {1})", "string_agg({0}, ',' ORDER BY {1})"),
    "LNFACT": (_LNFACT, _LNFACT),
    "BITS": ("bit_count({0})", "bit_count({0})"),
    "SHIFT": ("shiftright({0}, {1})", "({0} >> {1})"),
}


def render(sql: str, engine: int) -> str:
    """engine: 0 for Spark, 1 for DuckDB."""
    for name, forms in MACROS.items():
        sql = re.sub(rf"\b{name}\(([^;()]*(?:\([^()]*\)[^;()]*)*)(?:;([^()]*(?:\([^()]*\)[^()]*)*))?\)", lambda m: forms[engine].format(m[1], m[2]), sql)
    return sql
