"""SQL for least squares and its errors: a term is made orthogonal to the others one by one, so no system is solved.

A coefficient is then the slope on what is left of its column, and its error the weighted sum of lagged products of that column times the residual.
"""

from __future__ import annotations


def chain(name: str, source: str, y: str, xs: dict[str, str], last: str) -> str:
    """Tables up to ``name``(pos, rn, b, n, g, u): coefficient of the term ``last``, rows, its scaled scores and the residuals."""
    others = [c for c in ("one", *xs) if c != last]
    away = lambda c, upto: c + "".join(f" - sum({c} * e{j}) OVER () / sum(e{j} * e{j}) OVER () * e{j}" for j in range(upto))
    out = [f"{name}_0 AS (SELECT pos, row_number() OVER (ORDER BY pos) AS rn, ({y})::DOUBLE AS y, 1.0::DOUBLE AS one, {', '.join(f'({x})::DOUBLE AS {c}' for c, x in xs.items())} FROM {source})"]
    for i, c in enumerate(others):
        out.append(f"{name}_{i + 1} AS (SELECT *, {away(c, i)} AS e{i} FROM {name}_{i})")
    m = len(others)
    out.append(f"{name}_q AS (SELECT pos, rn, {away(last, m)} AS q, {away('y', m)} AS r FROM {name}_{m})")
    out.append(f"{name}_b AS (SELECT *, sum(r * q) OVER () / sum(q * q) OVER () AS b, sum(q * q) OVER () AS qq, count(*) OVER () AS n FROM {name}_q)")
    out.append(f"{name} AS MATERIALIZED (SELECT pos, rn, b, n, r - b * q AS u, q * (r - b * q) / qq AS g FROM {name}_b)")
    return ",\n".join(out)


def covariance(a: str, b: str, lags: int, by: str = "pos") -> str:
    """A scalar: covariance of the coefficients of two chains over the same rows."""
    weight = f"(1 - (x.{by} - y.{by}) / {lags + 1}.0::DOUBLE)"
    if a == b:
        return f"(SELECT sum(CASE WHEN x.{by} = y.{by} THEN x.g * y.g ELSE 2 * {weight} * x.g * y.g END) FROM {a} x JOIN {a} y ON x.{by} - y.{by} BETWEEN 0 AND {lags})"
    one = f"SELECT x.{by} - y.{by} AS d, sum(x.g * y.g) AS s FROM {{}} x JOIN {{}} y ON x.{by} - y.{by} BETWEEN {{}} AND {lags} GROUP BY 1"
    return f"(SELECT sum((1 - d / {lags + 1}.0::DOUBLE) * s) FROM ({one.format(a, b, 0)} UNION ALL {one.format(b, a, 1)}))"


def error(a: str, lags: int, by: str = "pos") -> str:
    return f"sqrt({covariance(a, a, lags, by)})"


def coefficient(a: str) -> str:
    return f"(SELECT any_value(b) FROM {a})"


def erfc(x: str) -> str:
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda k: pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))))"


def normal_p(z: str) -> str:
    """To six decimals: beyond 5.2 nothing is left of them, and the series would lose its digits."""
    return f"(CASE WHEN abs({z}) > 5.2 THEN 0.0::DOUBLE ELSE {erfc(f'(abs({z}) / sqrt(2.0::DOUBLE))')} END)"


def chi_square_3(w: str) -> str:
    return f"(CASE WHEN {w} > 27 THEN 0.0::DOUBLE ELSE 1 END * ({erfc(f'sqrt({w} / 2)')} + sqrt(2 * {w} / pi()) * exp(-{w} / 2)))"
