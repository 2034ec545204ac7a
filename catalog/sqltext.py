"""SQL texts of the statistics, written on plain rows with window functions."""

from __future__ import annotations

from collections.abc import Sequence


def _simpson(n: int, f: str) -> str:
    """Simpson's sum of f over i = 0..n, to be multiplied by the step and divided by 3."""
    return f"list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f})))"


def p_normal(z: str, n: int = 2000) -> str:
    """Two-sided normal tail: the density between 0 and z by Simpson's rule."""
    z = f"least(abs({z}), 12::DOUBLE)"
    return f"round(1 - 2 * {z} / {3 * n} * {_simpson(n, f'exp(-pow(i * {z} / {n}, 2) / 2) / sqrt(2 * pi())')}, 6)"


def p_t(t: str, dof: str, n: int = 2000) -> str:
    """Two-sided tail of Student's t: cos(x)^(dof - 1) between 0 and atan(t / sqrt(dof)), scaled by gamma functions."""
    cut = f"atan(abs({t}) / sqrt({dof}))"
    scale = f"exp(lgamma((({dof}) + 1) / 2) - lgamma(({dof}) / 2)) / sqrt(pi())"
    return f"round(greatest(1 - 2 * {scale} * {cut} / {3 * n} * {_simpson(n, f'pow(cos(i * {cut} / {n}), ({dof}) - 1)')}, 0), 6)"


def p_chi2(x: str, dof: str, n: int = 2000) -> str:
    """Upper chi-square tail: the density of the root between 0 and sqrt(x), as far as it isn't negligible."""
    low = f"greatest(sqrt({dof}) - 9, 0::DOUBLE)"
    wide = f"(greatest(least(sqrt(greatest({x}, 0::DOUBLE)), sqrt({dof}) + 9), {low}) - {low})"
    at = f"greatest({low} + i * {wide} / {n}, 1e-300)"
    f = f"exp((({dof}) - 1) * ln({at}) - pow({at}, 2) / 2 - (({dof}) / 2 - 1) * ln(2::DOUBLE) - lgamma(({dof}) / 2))"
    return f"round(greatest(1 - {wide} / {3 * n} * {_simpson(n, f)}, 0), 6)"


def _keys(by: Sequence[str]) -> tuple[str, str, str]:
    lead = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    part = ", ".join(by) if by else "1"
    return lead, group, part


def _ranked(source: str, by: Sequence[str], x: str, name: str) -> str:
    _, _, part = _keys(by)
    return (
        f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE AS {name}"
    )


def auc_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., y, s."""
    lead, group, part = _keys(by)
    return (
        f"WITH src AS ({source}), r AS (SELECT *, {_ranked('src', by, 's', 'rk')} FROM src WHERE s IS NOT NULL AND y IS NOT NULL), "
        f"t AS (SELECT {lead}sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(rk * y) AS rp FROM r {group}) "
        f"SELECT {lead}round((rp - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, p::BIGINT AS n_pos, (n - p)::BIGINT AS n_neg FROM t"
    )


def auc_spread_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., y, s: area and DeLong's standard deviation, unrounded, with n_pos and n_neg."""
    lead, group, part = _keys(by)
    return (
        f"WITH src AS ({source}), r AS (SELECT *, sum(1 - y) OVER (PARTITION BY {part}) AS nn, sum(y) OVER (PARTITION BY {part}) AS np, "
        f"sum(1 - y) OVER (PARTITION BY {part} ORDER BY s) - sum(1 - y) OVER (PARTITION BY {part}, s) / 2.0::DOUBLE AS below, "
        f"sum(y) OVER (PARTITION BY {part}) - sum(y) OVER (PARTITION BY {part} ORDER BY s) + sum(y) OVER (PARTITION BY {part}, s) / 2.0::DOUBLE AS above "
        "FROM src WHERE s IS NOT NULL AND y IS NOT NULL), "
        "p AS (SELECT *, CASE WHEN y = 1 THEN below / nn END AS e, CASE WHEN y = 0 THEN above / np END AS o FROM r) "
        f"SELECT {lead}avg(e) AS auc, sqrt(var_samp(e) / count(e) + var_samp(o) / count(o)) AS sd, count(e) AS n_pos, count(o) AS n_neg FROM p {group}"
    )


def rank_sum_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., x, a (1 in the first sample, 0 in the second)."""
    lead, group, part = _keys(by)
    return (
        f"WITH src AS ({source}), r AS (SELECT *, {_ranked('src', by, 'x', 'rk')}, count(*) OVER (PARTITION BY {part}, x) AS ties "
        "FROM src WHERE x IS NOT NULL AND a IS NOT NULL), "
        f"t AS (SELECT {lead}sum(a)::DOUBLE AS na, count(*)::DOUBLE AS n, sum(rk * a) AS ra, sum(ties * ties - 1)::DOUBLE AS tt FROM r {group}), "
        f"u AS (SELECT {lead}na, n - na AS nb, ra - na * (na + 1) / 2 AS w, "
        "na * (n - na) / 12 * ((n + 1) - tt / (n * (n - 1))) AS v FROM t), "
        "zs AS (SELECT *, (w - na * nb / 2 - 0.5::DOUBLE * sign(w - na * nb / 2)) / sqrt(v) AS z FROM u) "
        f"SELECT {lead}na::BIGINT AS n_a, nb::BIGINT AS n_b, round(w, 6) AS w, round(z, 6) AS z, {p_normal('z')} AS p FROM zs"
    )


def kruskal_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., x, g."""
    lead, group, part = _keys(by)
    return (
        f"WITH src AS ({source}), r AS (SELECT *, {_ranked('src', by, 'x', 'rk')}, count(*) OVER (PARTITION BY {part}, x) AS ties, "
        f"count(*) OVER (PARTITION BY {part})::DOUBLE AS n FROM src WHERE x IS NOT NULL AND g IS NOT NULL), "
        f"c AS (SELECT {lead}g, sum(rk) AS rs, count(*)::DOUBLE AS m, max(n) AS n, sum(ties * ties - 1)::DOUBLE AS tt FROM r GROUP BY {lead}g), "
        f"t AS (SELECT {lead}sum(rs * rs / m) AS q, max(n) AS n, sum(tt) AS tt, count(*) AS k FROM c {group}), "
        "hs AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tt / (n * n * n - n)) AS h, (k - 1)::DOUBLE AS dof FROM t) "
        f"SELECT {lead}n::BIGINT AS n, k AS groups, round(h, 6) AS h, dof, {p_chi2('h', 'dof')} AS p FROM hs"
    )


def spearman_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., x, y."""
    lead, group, part = _keys(by)
    return (
        f"WITH src AS ({source}), r AS (SELECT *, {_ranked('src', by, 'x', 'rx')}, {_ranked('src', by, 'y', 'ry')} "
        "FROM src WHERE x IS NOT NULL AND y IS NOT NULL), "
        f"c AS (SELECT {lead}count(*) AS n, corr(rx, ry) AS rho FROM r {group}), "
        f"t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c) "
        f"SELECT {lead}n, round(rho, 6) AS rho, round(t, 6) AS t, {p_t('t', '(n - 2)::DOUBLE')} AS p FROM t"
    )


def pearson_sql(source: str, by: Sequence[str] = ()) -> str:
    lead, group, _ = _keys(by)
    return (
        f"WITH src AS ({source}), c AS (SELECT {lead}count(*) AS n, corr(x, y) AS r FROM src "
        f"WHERE x IS NOT NULL AND y IS NOT NULL {group}), "
        f"t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS dof FROM c) "
        f"SELECT {lead}n, round(r, 6) AS r, round(t, 6) AS t, dof, {p_t('t', 'dof')} AS p FROM t"
    )


def welch_sql(source: str, by: Sequence[str] = ()) -> str:
    """``source`` gives by.., xa, xb: the value where the row belongs to sample a or b, else NULL."""
    lead, group, _ = _keys(by)
    return (
        f"WITH src AS ({source}), m AS (SELECT {lead}count(xa) AS n_a, count(xb) AS n_b, avg(xa) AS ma, avg(xb) AS mb, "
        f"var_samp(xa) / count(xa) AS ea, var_samp(xb) / count(xb) AS eb FROM src {group}), "
        "ts AS (SELECT *, (ma - mb) / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)) AS dof FROM m) "
        f"SELECT {lead}n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(t, 6) AS t, round(dof, 6) AS dof, {p_t('t', 'dof')} AS p FROM ts"
    )


METRIC_ROWS = (
    ("Fraction of predicted positives", 0, "TRUE", "qb"),
    ("Accuracy", 1, "TRUE", "CASE WHEN qb = outcome THEN 1 ELSE 0 END"),
    ("False positive rate (FPR)", 2, "outcome = 0", "CASE WHEN qb <> outcome THEN 1 ELSE 0 END"),
    ("False negative rate (FNR)", 3, "outcome = 1", "CASE WHEN qb <> outcome THEN 1 ELSE 0 END"),
    ("Positive predicted value (PPV)", 4, "qb = 1", "outcome"),
)


def metric_rows_sql(source: str, columns: Sequence[str]) -> str:
    """One row per (row of source, metric that counts it): columns.., metric, ord, x."""
    lead = "".join(f"{c}, " for c in columns)
    return " UNION ALL ".join(
        f"SELECT {lead}'{m}' AS metric, {o} AS ord, ({x})::DOUBLE AS x FROM ({source}) s WHERE {test}"
        for m, o, test, x in METRIC_ROWS
    )


def bundle_sql(source: str, by: Sequence[str], base: bool = False) -> str:
    lead = "".join(f"{b}, " for b in by)
    tail = (
        f" UNION ALL SELECT {lead}'Base rate' AS metric, 6 AS ord, round(avg(outcome), 6), NULL, NULL, NULL, count(*) "
        f"FROM ({source}) s {'GROUP BY ' + ', '.join(by) if by else ''}"
        if base
        else ""
    )
    return (
        f"WITH mr AS ({metric_rows_sql(source, by)}), "
        f"ms AS (SELECT {lead}metric, ord, avg(x) AS v, stddev_samp(x) / sqrt(count(*)) AS e, count(*) AS n FROM mr GROUP BY {lead}metric, ord) "
        f"SELECT {lead}metric, ord, round(v, 6) AS value, round(e, 6) AS se, round(v - 1.96::DOUBLE * e, 6) AS lb, "
        f"round(v + 1.96::DOUBLE * e, 6) AS ub, n FROM ms{tail}"
    )


def metric_pairs_sql(source: str, group: str, pairs: Sequence[tuple[str, str]]) -> str:
    """Welch t per metric for each pair of groups."""
    rows = metric_rows_sql(source, [group])
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    src = (
        f"SELECT metric, ord, pa AS a, pb AS b, CASE WHEN {group} = pa THEN x END AS xa, CASE WHEN {group} = pb THEN x END AS xb "
        f"FROM ({rows}) mr, (VALUES {values}) p(pa, pb) WHERE {group} IN (pa, pb)"
    )
    return welch_sql(src, ["metric", "ord", "a", "b"])


def logit_ctes(name: str, source: str, steps: int = 25) -> str:
    """Newton's method for a logistic regression on (1, x1, x2); ``source`` gives x1, x2, n1, n.

    Ends in the table ``<name>_f`` (i, estimate, se, hc0).
    """
    mu = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
    x = ["1", "x1", "x2"]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    h = ", ".join(f"sum(n * m * (1 - m) * {x[i]} * {x[j]}) AS h{i}{j}" for i, j in pairs)
    meat = ", ".join(f"sum((n1 * (1 - m) * (1 - m) + (n - n1) * m * m) * {x[i]} * {x[j]}) AS m{i}{j}" for i, j in pairs)
    g = ", ".join(f"sum((n1 - n * m) * {x[i]}) AS g{i}" for i in range(3))
    det = "h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02)"
    inverse = {
        (0, 0): "(h11 * h22 - h12 * h12) / det",
        (0, 1): "(h02 * h12 - h01 * h22) / det",
        (0, 2): "(h01 * h12 - h02 * h11) / det",
        (1, 1): "(h00 * h22 - h02 * h02) / det",
        (1, 2): "(h01 * h02 - h00 * h12) / det",
        (2, 2): "(h00 * h11 - h01 * h01) / det",
    }

    def v(i: int, j: int) -> str:
        return inverse[min(i, j), max(i, j)]

    def pair(s: str, i: int, j: int) -> str:
        return f"{s}{min(i, j)}{max(i, j)}"

    step = ", ".join(f"b{i} + " + " + ".join(f"g{j} * {v(i, j)}" for j in range(3)) for i in range(3))
    vs = ", ".join(f"{inverse[k]} AS v{k[0]}{k[1]}" for k in inverse)
    sandwich = [
        " + ".join(f"{pair('v', i, j)} * {pair('m', j, k)} * {pair('v', k, i)}" for j in range(3) for k in range(3))
        for i in range(3)
    ]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS i, b{i} AS estimate, sqrt(v{i}{i}) AS se, sqrt({sandwich[i]}) AS hc0 FROM {name}_v" for i in range(3)
    )
    return (
        f"{name}_c AS MATERIALIZED (SELECT x1::DOUBLE AS x1, x2::DOUBLE AS x2, n1::DOUBLE AS n1, n::DOUBLE AS n FROM ({source}) s), "
        f"{name}_it AS (SELECT 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 UNION ALL SELECT k + 1, {step} FROM "
        f"(SELECT *, {det} AS det FROM (SELECT k, b0, b1, b2, {g}, {h} FROM (SELECT i.*, c.*, {mu} AS m FROM {name}_it i, {name}_c c WHERE k < {steps}) z "
        f"GROUP BY k, b0, b1, b2) y) w), "
        f"{name}_v AS (SELECT *, {vs} FROM (SELECT *, {det} AS det FROM (SELECT b0, b1, b2, {h}, {meat} FROM "
        f"(SELECT i.*, c.*, {mu} AS m FROM {name}_it i, {name}_c c WHERE k = {steps}) z GROUP BY b0, b1, b2) y) w), "
        f"{name}_f AS ({rows})"
    )


def logit_by_group_ctes(name: str, source: str, steps: int = 25) -> str:
    """The same on (1, x1) separately per g; ends in ``<name>_f`` (g, b0, b1, v00, v11)."""
    mu = "1 / (1 + exp(-(b0 + b1 * x1)))"
    h = "sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x1) AS h01, sum(n * m * (1 - m) * x1 * x1) AS h11"
    g = "sum(n1 - n * m) AS g0, sum((n1 - n * m) * x1) AS g1"
    det = "h00 * h11 - h01 * h01"
    return (
        f"{name}_c AS MATERIALIZED (SELECT g, x1::DOUBLE AS x1, n1::DOUBLE AS n1, n::DOUBLE AS n FROM ({source}) s), "
        f"{name}_it AS (SELECT DISTINCT g, 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM {name}_c UNION ALL "
        f"SELECT g, k + 1, b0 + (g0 * h11 - g1 * h01) / det, b1 + (g1 * h00 - g0 * h01) / det FROM (SELECT *, {det} AS det FROM "
        f"(SELECT z.g, k, b0, b1, {g}, {h} FROM (SELECT i.*, c.x1, c.n1, c.n, {mu} AS m FROM {name}_it i JOIN {name}_c c USING (g) WHERE k < {steps}) z GROUP BY z.g, k, b0, b1) y) w), "
        f"{name}_f AS (SELECT g, b0, b1, h11 / det AS v00, h00 / det AS v11 FROM (SELECT *, {det} AS det FROM (SELECT z.g, b0, b1, {h} FROM "
        f"(SELECT i.*, c.x1, c.n1, c.n, {mu} AS m FROM {name}_it i JOIN {name}_c c USING (g) WHERE k = {steps}) z GROUP BY z.g, b0, b1) y) w)"
    )
