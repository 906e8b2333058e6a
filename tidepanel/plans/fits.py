"""Queries of the fits, on a panel of three stand-in scorers of orders, beside SQL that makes columns orthogonal one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import fits, inference, sessions
from tidepanel.plans import algebra as A
from tidepanel.plans import queries as Q
from tidepanel.plans.registry import query

SCORERS = ("a", "b", "c")
SCORED = """scored AS (SELECT o_orderdate::DATE AS day, (o_totalprice - 250000) / 250000.0::DOUBLE AS a, (o_custkey * 7919 % 2001 - 1000) / 1000.0::DOUBLE AS b, (3 - substr(o_orderpriority, 1, 1)::INT) / 2.0::DOUBLE AS c FROM orders),
mapped AS (SELECT s.*, session FROM scored s JOIN cal ON day >= prev AND day < session)"""


def _panel_sql(agg: str = "avg") -> str:
    cols = ", ".join(f"{agg}({s}) AS s_{s}, CASE WHEN count(m.day) >= 5 THEN stddev_samp({s}) END AS d_{s}" for s in SCORERS)
    leads = ", ".join([*[f"lead(ret, {h}) OVER o AS ret_lead{h}" for h in fits.HORIZONS], "lead(range_var) OVER o AS range_var_lead1", "lead(log_volume) OVER o AS log_volume_lead1"])
    return f"""{Q.CAL}, {SCORED}, daily AS (SELECT cal.session, pos, count(m.day) AS n, {cols} FROM cal LEFT JOIN mapped m ON m.session = cal.session GROUP BY 1, 2),
bars AS (SELECT l_shipdate::DATE AS session, avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1),
market AS (SELECT cal.session, ln(close) - lag(ln(close)) OVER (ORDER BY cal.session) AS ret, pow(ln(high / low), 2) / (4 * ln(2.0::DOUBLE)) AS range_var, ln(nullif(volume, 0)) AS log_volume FROM cal LEFT JOIN bars USING (session)),
panel AS MATERIALIZED (SELECT daily.*, ret, range_var, log_volume, CASE WHEN count(log_volume) OVER t = 63 THEN log_volume - avg(log_volume) OVER t END AS volume_gap, {leads}
  FROM daily JOIN market m USING (session) WINDOW o AS (ORDER BY session), t AS (ORDER BY session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""


PANEL = _panel_sql()


def panel(spark, sf_dir, agg: str = "mean") -> DataFrame:
    """The panel of all scorers; kept, for a fit reads it a few times and it has a row a session."""
    orders = Q.read(spark, sf_dir, "orders").select(
        "o_orderdate", ((F.col("o_totalprice") - 250000) / 250000.0).alias("a"), ((F.col("o_custkey") * 7919 % 2001 - 1000) / 1000.0).alias("b"),
        ((3 - F.substring("o_orderpriority", 1, 1).cast("int")) / 2.0).alias("c"),
    )
    days = Q.calendar(spark)
    mapped = sessions.map_dates(orders, days, "o_orderdate").where("session IS NOT NULL")
    one = F.median if agg == "median" else F.avg
    least = F.count(F.lit(1)) >= sessions.LEAST_FOR_SD
    by = mapped.groupBy("session").agg(F.count(F.lit(1)).alias("n"), *[x for s in SCORERS for x in (one(s).alias(f"s_{s}"), F.when(least, F.stddev_samp(s)).alias(f"d_{s}"))])
    day = days.select("session", "pos").join(by, "session", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    trades = Q.read(spark, sf_dir, "lineitem")
    market = sessions.market(sessions.bars(trades, "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), "l_quantity"), days)
    return sessions.panel(day, market).persist()


def _missing(scorer: str, h: int) -> dict[str, str]:
    return {
        "no_lead_return": f"ret_lead{h} IS NULL", "zero_news": "n < 1", "missing_tone": f"s_{scorer} IS NULL",
        "missing_control": "(ret IS NULL OR range_var IS NULL OR volume_gap IS NULL)",
    }


def _kept(scorers: tuple[str, ...], h: int = 1, source: str = "panel", name: str = "kept") -> str:
    """Eligible rows with z-scores."""
    where = " AND ".join(f"NOT ({c})" for s in scorers for c in _missing(s, h).values())
    z = ", ".join(f"(s_{s} - avg(s_{s}) OVER ()) / stddev_samp(s_{s}) OVER () AS z_{s}" for s in scorers)
    return f"{name} AS MATERIALIZED (SELECT *, {z} FROM {source} WHERE {where})"


def _design(*zs: str) -> dict[str, str]:
    return {**{z: z for z in zs}, **{c: c for c in fits.CONTROLS}}


TERMS = ("const", "z_s", *fits.CONTROLS)


def _all_terms(prefix: str, source: str, y: str, xs: dict[str, str]) -> str:
    return ",\n".join(A.chain(f"{prefix}_{t}", source, y, xs, t) for t in ("one", *xs))


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, places) for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in keep})


def _ledger_sql(flags: dict[str, str], source: str = "panel") -> str:
    none = " OR ".join(flags.values())
    first, before = [], []
    for r, f in flags.items():
        ahead = f" AND NOT ({' OR '.join(before)})" if before else ""
        first.append(f"SELECT '{r}' AS reason, count(*) FILTER ({f}{ahead}) AS first, count(*) FILTER ({f}) AS \"any\" FROM {source}")
        before.append(f)
    return f"SELECT 'eligible' AS reason, count(*) FILTER (NOT ({none})) AS first, count(*) FILTER (NOT ({none})) AS \"any\" FROM {source} UNION ALL " + " UNION ALL ".join(first)


@query("eligibility_ledger", f"WITH {PANEL} {_ledger_sql(_missing('a', 1))}")
def eligibility_ledger(spark, sf_dir):
    return fits.ledger(panel(spark, sf_dir))


_OK = {s: "NOT (" + " OR ".join(_missing(s, 1).values()) + ")" for s in SCORERS}


@query("common_eligibility", f"WITH {PANEL} " + " UNION ALL ".join(
    f"SELECT '{s}' AS scorer, count(*) FILTER ({_OK[s]}) AS eligible, count(*) FILTER ({' AND '.join(_OK.values())}) AS common, count(*) FILTER ({_OK[s]}) - count(*) FILTER ({' AND '.join(_OK.values())}) AS lost FROM panel" for s in SCORERS))
def common_eligibility(spark, sf_dir):
    return fits.common_ledger(panel(spark, sf_dir), SCORERS)


@query("calendar_breaks", f"""WITH {PANEL}, thin AS (SELECT * FROM panel WHERE pos % 50 <> 7), x AS (SELECT session, ret_lead1 AS stored, lead(ret) OVER (ORDER BY pos) AS found FROM thin)
SELECT session::VARCHAR AS session, round(stored, 7) AS stored, round(found, 7) AS found FROM x WHERE (stored IS NULL) <> (found IS NULL) OR abs(stored - found) > 1e-8 + 1e-5 * abs(found)""")
def calendar_breaks(spark, sf_dir):
    """What a panel without every fiftieth session gives itself away by."""
    return rounded(fits.calendar_breaks(panel(spark, sf_dir).where("pos % 50 <> 7")), 7).withColumn("session", F.col("session").cast("string"))


_PRIMARY = f"{PANEL}, {_kept(('a',))}, {_all_terms('f', 'kept', 'ret_lead1', _design('z_a'))}"
_NAMES = {"one": "const", "z_a": "z_s", **{c: c for c in fits.CONTROLS}}


def _term_row(t: str, lags: int = 5) -> str:
    b, e = A.coefficient(f"f_{t}"), A.error(f"f_{t}", lags)
    return f"SELECT '{_NAMES[t]}' AS term, {b} AS coef, {e} AS se, {A.error(f'f_{t}', lags, 'rn')} AS se_row"


@query("hac_primary", f"""WITH {_PRIMARY}, r AS ({' UNION ALL '.join(map(_term_row, _NAMES))})
SELECT term, round(coef, 8) AS coef, round(se, 8) AS se_session, round(se_row, 8) AS se_row, round(coef / se, 6) AS z, round({A.normal_p('coef / se')}, 6) AS p,
round(coef * 10000, 4) AS bps, round((coef - {fits.QUANTILE} * se) * 10000, 4) AS bps_low, round((coef + {fits.QUANTILE} * se) * 10000, 4) AS bps_high FROM r""")
def hac_primary(spark, sf_dir):
    rows = spark.createDataFrame(fits.primary(panel(spark, sf_dir)).rows(), fits.FIT_ROWS)
    places = {"z": 6, "p": 6, "bps": 4, "bps_low": 4, "bps_high": 4}
    return rows.withColumns({c: F.round(c, places.get(c, 8)) for c in rows.columns if c != "term"})


def _bands() -> str:
    n = "(SELECT any_value(n) FROM f_z_a)"
    plug = f"floor(4 * pow({n} / 100.0::DOUBLE, 2.0::DOUBLE / 9))::INT"
    out = [f"SELECT '{label}' AS label, {lags} AS lags, {A.coefficient('f_z_a')} AS b, {A.error('f_z_a', lags)} AS e" for label, lags in (("0", 0), ("1", 1), ("5 (primary)", 5), ("10", 10))]
    weight = "(1 - (x.pos - y.pos) / (m + 1.0::DOUBLE))"
    out.append(f"SELECT 'plug-in' AS label, m AS lags, {A.coefficient('f_z_a')} AS b, (SELECT sqrt(sum(CASE WHEN x.pos = y.pos THEN x.g * y.g ELSE 2 * {weight} * x.g * y.g END)) FROM f_z_a x JOIN f_z_a y ON x.pos - y.pos BETWEEN 0 AND m) AS e FROM (SELECT {plug} AS m)")
    return " UNION ALL ".join(out)


_TONE = f"{PANEL}, {_kept(('a',))}, {A.chain('f_z_a', 'kept', 'ret_lead1', _design('z_a'), 'z_a')}"
_BPS = f"round(b * 10000, 4) AS bps, round((b - {fits.QUANTILE} * e) * 10000, 4) AS bps_low, round((b + {fits.QUANTILE} * e) * 10000, 4) AS bps_high, round({A.normal_p('b / e')}, 6) AS p"


def _bps_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6 if c == "p" else 4) for c in df.columns if c.startswith(("bps", "se_bps")) or c == "p"})


@query("bandwidth_sensitivity", f"WITH {_TONE}, r AS ({_bands()}) SELECT label, lags, (SELECT any_value(n) FROM f_z_a) AS n, {_BPS} FROM r")
def bandwidth_sensitivity(spark, sf_dir):
    return _bps_rounded(spark.createDataFrame(fits.bandwidths(panel(spark, sf_dir)), fits.BAND_ROWS))


@query("effect_classes", f"""WITH {_TONE}, r AS ({_bands()}), i AS (SELECT label, (b - {fits.QUANTILE} * e) * 10000 AS lo, (b + {fits.QUANTILE} * e) * 10000 AS hi FROM r),
c AS (SELECT label, round_even(lo, 1) > 0 OR round_even(hi, 1) < 0 AS association, round_even(lo, 1) >= -5 AND round_even(hi, 1) <= 5 AS small,
  least(abs(lo + 5), abs(lo), abs(lo - 5), abs(hi + 5), abs(hi), abs(hi - 5)) <= 0.1 + 1e-12 AS boundary FROM i)
SELECT *, CASE WHEN association AND small THEN 'Association detected, and small against the 5 bps yardstick' WHEN association THEN 'Association detected; magnitude not established as small'
  WHEN small THEN 'No association detected, and precise enough to exclude effects beyond +/-5 bps' ELSE 'Inconclusive' END AS conclusion FROM c""")
def effect_classes(spark, sf_dir):
    rows = spark.createDataFrame(fits.bandwidths(panel(spark, sf_dir)), fits.BAND_ROWS)
    return fits.classified(rows).select("label", "association", "small", "boundary", "conclusion")


def _family_sql() -> str:
    parts, rows = [], []
    for s in SCORERS:
        for h in fits.HORIZONS:
            k = f"k_{s}{h}"
            parts += [_kept((s,), h, "panel", k), A.chain(f"t_{s}{h}", k, f"ret_lead{h}", _design(f"z_{s}"), f"z_{s}")]
            rows.append(f"SELECT '{s}' AS scorer, {h} AS horizon, {A.coefficient(f't_{s}{h}')} AS coef, {A.error(f't_{s}{h}', 5)} AS se, (SELECT any_value(n) FROM t_{s}{h})::INT AS n")
    return f"{PANEL}, " + ",\n".join(parts) + f",\nfamily AS MATERIALIZED (SELECT *, {A.normal_p('coef / se')} AS p FROM ({' UNION ALL '.join(rows)}))"


_FAMILY = _family_sql()


def _family(spark, sf_dir) -> DataFrame:
    own = panel(spark, sf_dir)
    return spark.createDataFrame([r for s in SCORERS for r in fits.lag_family(own, s)], fits.FAMILY_ROWS)


@query("lag_family", f"WITH {_FAMILY} SELECT scorer, horizon, round(coef, 8) AS coef, round(se, 8) AS se, round(coef / se, 6) AS z, round(p, 6) AS p, n FROM family")
def lag_family(spark, sf_dir):
    rows = _family(spark, sf_dir)
    return rows.withColumns({c: F.round(c, 8 if c in ("coef", "se") else 6) for c in ("coef", "se", "z", "p")})


@query("return_families", f"""WITH {_FAMILY}, s AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM family WHERE NOT (scorer = 'a' AND horizon = 1)), h AS (SELECT sum(1.0::DOUBLE / i) AS h FROM range(1, 15) q(i)),
a AS (SELECT scorer, horizon, p, least(1.0, min(p * 14 / r) OVER w) AS bh, least(1.0, min(p * 14 / r * h) OVER w) AS "by" FROM s, h WINDOW w AS (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT scorer, horizon, 'secondary_return' AS family, round(p, 6) AS p, round(bh, 6) AS bh, round("by", 6) AS "by", "by" <= 0.05 AS claim FROM a
UNION ALL SELECT scorer, horizon, 'primary_return', round(p, 6), NULL, NULL, p <= 0.05 FROM family WHERE scorer = 'a' AND horizon = 1""")
def return_families(spark, sf_dir):
    return rounded(fits.return_families(_family(spark, sf_dir)).select("scorer", "horizon", "family", "p", "bh", "by", "claim"))


_PAIR = f"""{PANEL}, {_kept(('a', 'b'))}, {A.chain('ca', 'kept', 'ret_lead1', _design('z_a'), 'z_a')}, {A.chain('cb', 'kept', 'ret_lead1', _design('z_b'), 'z_b')},
va AS (SELECT sum(y * y) AS s FROM (SELECT q AS y FROM ca_q)), vb AS (SELECT sum(y * y) AS s FROM (SELECT q AS y FROM cb_q)), diff AS MATERIALIZED (SELECT ca.pos, ca.rn, ca.g - cb.g AS g FROM ca JOIN cb USING (pos))"""


@query("paired_contrast", f"""WITH {_PAIR}, r AS (SELECT (SELECT any_value(n) FROM ca) AS n, {A.coefficient('ca')} AS x, {A.coefficient('cb')} AS y, {A.error('diff', 5)} AS e, {A.error('diff', 5, 'rn')} AS e_row)
SELECT n, round(x, 8) AS beta_first, round(y, 8) AS beta_second, round(x - y, 8) AS delta, round(e, 8) AS se, round(e_row, 8) AS se_row, round((x - y) / e, 6) AS z, round({A.normal_p('(x - y) / e')}, 6) AS p,
(SELECT round(corr(z_a, z_b), 8) FROM kept) AS corr, round((n - 1) / (SELECT s FROM va), 8) AS vif_first, round((n - 1) / (SELECT s FROM vb), 8) AS vif_second FROM r""")
def paired_contrast(spark, sf_dir):
    found = fits.contrast(panel(spark, sf_dir))
    found.pop("degenerate")
    rows = spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in found))
    return rows.withColumns({c: F.round(c, 6 if c in ("z", "p") else 8) for c in rows.columns if c != "n"})


_BOTH = {"z_a": "z_a", "z_b": "z_b", **{c: c for c in fits.CONTROLS}}


@query("incremental", f"""WITH {PANEL}, {_kept(('a', 'b'))}, {A.chain('ia', 'kept', 'ret_lead1', _BOTH, 'z_a')}, {A.chain('ib', 'kept', 'ret_lead1', _BOTH, 'z_b')}
SELECT 'z_a' AS term, round({A.coefficient('ia')}, 8) AS coef, round({A.error('ia', 5)}, 8) AS se_session, round({A.error('ia', 5, 'rn')}, 8) AS se_row
UNION ALL SELECT 'z_b', round({A.coefficient('ib')}, 8), round({A.error('ib', 5)}, 8), round({A.error('ib', 5, 'rn')}, 8)""")
def incremental(spark, sf_dir):
    rows = [r[:4] for r in fits.incremental(panel(spark, sf_dir)).rows() if r[0].startswith("z_")]
    return rounded(spark.createDataFrame(rows, "term string, coef double, se_session double, se_row double"), 8)


OUTCOMES = ("range_var_lead1", "log_volume_lead1")


def _joint_flags(s: str, y: str) -> dict[str, str]:
    control = "range_var IS NULL" if y.startswith("range_var") else "(volume_gap IS NULL OR ret IS NULL)"
    return {"no_outcome": f"{y} IS NULL", "zero_news": "n < 1", "missing_tone": f"s_{s} IS NULL", "dispersion_undefined": f"d_{s} IS NULL", "missing_control": control}


def _joint(s: str, y: str, k: str) -> str:
    own = {"range_var": "range_var"} if y.startswith("range_var") else {"volume_gap": "volume_gap", "abs_ret": "abs(ret)"}
    z = lambda e, name: f"({e} - avg({e}) OVER ()) / stddev_samp({e}) OVER () AS {name}"
    rows = f"{k} AS MATERIALIZED (SELECT pos, {y}, ret, range_var, volume_gap, {z(f's_{s}', 'z_s')}, {z(f'abs(s_{s})', 'z_abs_s')}, {z(f'd_{s}', 'z_d')} FROM panel WHERE {' AND '.join(f'NOT ({f})' for f in _joint_flags(s, y).values())})"
    xs = {t: t for t in fits.JOINT_TERMS} | own
    return rows + ",\n" + ",\n".join(A.chain(f"{k}_{t}", k, y, xs, t) for t in fits.JOINT_TERMS)


def _wald(k: str) -> str:
    """The quadratic form of three coefficients, by the inverse of a symmetric matrix written out."""
    t = fits.JOINT_TERMS
    cells = ", ".join(f"{A.covariance(f'{k}_{t[i]}', f'{k}_{t[j]}', 5)} AS v{i}{j}" for i in range(3) for j in range(i, 3))
    betas = ", ".join(f"{A.coefficient(f'{k}_{t[i]}')} AS b{i}" for i in range(3))
    adj = {"00": "v11 * v22 - v12 * v12", "01": "v02 * v12 - v01 * v22", "02": "v01 * v12 - v02 * v11", "11": "v00 * v22 - v02 * v02", "12": "v01 * v02 - v00 * v12", "22": "v00 * v11 - v01 * v01"}
    form = " + ".join(f"{1 if i == j else 2} * b{i} * b{j} * ({adj[f'{i}{j}']})" for i in range(3) for j in range(i, 3))
    return f"(SELECT ({form}) / (v00 * ({adj['00']}) + v01 * ({adj['01']}) + v02 * ({adj['02']})) FROM (SELECT {cells}, {betas}))"


_JOINT = [(s, y, f"j_{s}{i}") for s in ("a", "b") for i, y in enumerate(OUTCOMES)]


@query("joint_family", f"""WITH {PANEL}, {', '.join(_joint(*x) for x in _JOINT)}, w AS ({' UNION ALL '.join(f"SELECT '{s}' AS scorer, '{y}' AS outcome, {_wald(k)} AS w, (SELECT any_value(n) FROM {k}_z_s)::INT AS n" for s, y, k in _JOINT)}),
t AS (SELECT *, {A.chi_square_3('w')} AS p FROM w), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM t)
SELECT scorer, outcome, round(w, 6) AS wald, 3 AS df, round(p, 6) AS p, n, round(least(1.0, min(p * 4 / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def joint_family(spark, sf_dir):
    from tidepanel.operators import stats

    own, rows = panel(spark, sf_dir), []
    for s, y, _ in _JOINT:
        found = fits.joint_fit(own, s, y)
        w, df, p = fits.wald(found)
        rows.append((s, y, w, df, p, found.n))
    tests = spark.createDataFrame(rows, "scorer string, outcome string, wald double, df int, p double, n int")
    return rounded(stats.adjusted(tests, "p").drop("by"))


@query("joint_coefficients", f"WITH {PANEL}, {', '.join(_joint(*x) for x in _JOINT)} " + " UNION ALL ".join(
    f"SELECT '{s}' AS scorer, '{y}' AS outcome, '{t}' AS term, round({A.coefficient(f'{k}_{t}')}, 8) AS coef, round({A.error(f'{k}_{t}', 5)}, 8) AS se FROM (SELECT 1)" for s, y, k in _JOINT for t in fits.JOINT_TERMS))
def joint_coefficients(spark, sf_dir):
    own, rows = panel(spark, sf_dir), []
    for s, y, _ in _JOINT:
        rows += [(s, y, *r[:3]) for r in fits.joint_fit(own, s, y).rows() if r[0] in fits.JOINT_TERMS]
    return rounded(spark.createDataFrame(rows, "scorer string, outcome string, term string, coef double, se double"), 8)


@query("joint_ledger", f"WITH {PANEL} {_ledger_sql(_joint_flags('a', 'log_volume_lead1'))}")
def joint_ledger(spark, sf_dir):
    return fits.joint_ledger(panel(spark, sf_dir), "a", "log_volume_lead1")


def _half(name: str, cond: str) -> str:
    k = f"h_{name}"
    return f"p_{k} AS (SELECT * FROM panel WHERE {cond}), {_kept(('a',), 1, f'p_{k}', k)}, {A.chain(f'f_{k}', k, 'ret_lead1', _design('z_a'), 'z_a')}"


_CUT = "(SELECT pos FROM kept ORDER BY pos OFFSET (SELECT count(*) // 2 FROM kept) LIMIT 1)"
_HALF = {"full": "TRUE", "first": f"pos < {_CUT}", "second": f"pos >= {_CUT}"}


@query("halves", f"""WITH {PANEL}, {_kept(('a',))}, {', '.join(_half(n, c) for n, c in _HALF.items())},
r AS ({' UNION ALL '.join(f"SELECT '{n}' AS part, (SELECT any_value(n) FROM f_h_{n})::INT AS n, {A.coefficient(f'f_h_{n}')} AS b, {A.error(f'f_h_{n}', 5)} AS e" for n in _HALF)}),
d AS (SELECT 'difference' AS part, x.n + y.n AS n, x.b - y.b AS b, sqrt(x.e * x.e + y.e * y.e) AS e FROM r x, r y WHERE x.part = 'first' AND y.part = 'second')
SELECT part, n, {_BPS.replace(', round((b -', ', round(e * 10000, 4) AS se_bps, round((b -', 1)} FROM (FROM r UNION ALL FROM d)""")
def halves(spark, sf_dir):
    return _bps_rounded(spark.createDataFrame(fits.halves(panel(spark, sf_dir)), fits.HALF_ROWS))


@query("dispersion_floor", f"""WITH {PANEL}, thin AS (SELECT * FROM panel WHERE n >= 5), {_kept(('a',))}, {_kept(('a',), 1, 'thin', 'kept5')},
{A.chain('f1', 'kept', 'ret_lead1', _design('z_a'), 'z_a')}, {A.chain('f5', 'kept5', 'ret_lead1', _design('z_a'), 'z_a')},
r AS (SELECT 'none (primary)' AS label, (SELECT any_value(n) FROM f1)::INT AS n, (SELECT count(*) FROM panel WHERE n < 1) AS blanked, {A.coefficient('f1')} AS b, {A.error('f1', 5)} AS e
  UNION ALL SELECT 'n >= 5', (SELECT any_value(n) FROM f5)::INT, (SELECT count(*) FROM panel WHERE n < 5), {A.coefficient('f5')}, {A.error('f5', 5)})
SELECT label, n, blanked, {_BPS} FROM r""")
def dispersion_floor(spark, sf_dir):
    return _bps_rounded(spark.createDataFrame(fits.floors(panel(spark, sf_dir)), fits.FLOOR_ROWS))


@query("aggregation_sensitivity", f"""WITH {_panel_sql('median')}, {_kept(('a',))}, {A.chain('f', 'kept', 'ret_lead1', _design('z_a'), 'z_a')}, r AS (SELECT {A.coefficient('f')} AS b, {A.error('f', 5)} AS e)
SELECT 'median' AS aggregation, (SELECT any_value(n) FROM f)::INT AS n, (SELECT round(stddev_samp(s_a), 8) FROM kept) AS tone_sd, {_BPS} FROM r""")
def aggregation_sensitivity(spark, sf_dir):
    """The primary fit on a panel built again with daily medians (hac_primary has that of means)."""
    found = fits.primary(panel(spark, sf_dir, "median"))
    b, e = found.coef("z_s"), found.error("z_s")
    rows = spark.createDataFrame([("median", found.n, found.tone_sd, *fits.bps_interval(b, e), inference.normal_p(b / e))], "aggregation string, n int, tone_sd double, bps double, bps_low double, bps_high double, p double")
    return _bps_rounded(rows).withColumn("tone_sd", F.round("tone_sd", 8))


@query("residual_acf", f"""WITH {_TONE}, x AS MATERIALIZED (SELECT rn, u - avg(u) OVER () AS u, z_a - avg(z_a) OVER () AS z FROM f_z_a JOIN kept USING (pos)), d AS (SELECT sum(u * u) AS u, sum(z * z) AS z, {fits.QUANTILE} / sqrt(count(*)) AS band FROM x)
SELECT (x.rn - y.rn)::INT AS lag, round(sum(x.u * y.u) / any_value(d.u), 7) AS residual_acf, round(sum(x.z * y.z) / any_value(d.z), 7) AS tone_acf, round(any_value(band), 7) AS band, abs(sum(x.u * y.u) / any_value(d.u)) > any_value(band) AS outside
FROM x JOIN x y ON x.rn - y.rn BETWEEN 1 AND 20, d GROUP BY 1""")
def residual_acf(spark, sf_dir):
    return rounded(fits.residual_acf(panel(spark, sf_dir)), 7)


@query("sensitivity_summary")
def sensitivity_summary(spark, sf_dir):
    found = fits.summary(panel(spark, sf_dir))
    found["conclusions"] = " / ".join(found["conclusions"])
    return spark.createDataFrame([tuple(found.values())], "primary_conclusion string, conclusions string, changes boolean, boundary_cases int, sensitivities int, halves_overlap boolean")


_SHIFT = f"""{PANEL}, {_kept(('a',))}, {A.chain('f_z_a', 'kept', 'ret_lead1', _design('z_a'), 'z_a')},
basis AS MATERIALIZED (SELECT rn - 1 AS r, e0 / sqrt(sum(e0 * e0) OVER ()) AS e0, e1 / sqrt(sum(e1 * e1) OVER ()) AS e1, e2 / sqrt(sum(e2 * e2) OVER ()) AS e2, e3 / sqrt(sum(e3 * e3) OVER ()) AS e3, z_a AS z,
  y - e0 * sum(y * e0) OVER () / sum(e0 * e0) OVER () - e1 * sum(y * e1) OVER () / sum(e1 * e1) OVER () - e2 * sum(y * e2) OVER () / sum(e2 * e2) OVER () - e3 * sum(y * e3) OVER () / sum(e3 * e3) OVER () AS y FROM f_z_a_4),
m AS (SELECT count(*) AS n FROM basis),
shifted AS MATERIALIZED (SELECT k, sum(z * y) / (sum(z * z) - pow(sum(z * e0), 2) - pow(sum(z * e1), 2) - pow(sum(z * e2), 2) - pow(sum(z * e3), 2)) AS coefficient
  FROM (SELECT k.k, b.z, a.y, a.e0, a.e1, a.e2, a.e3 FROM range((SELECT n FROM m)) k(k) JOIN basis a ON TRUE JOIN m ON TRUE JOIN basis b ON b.r = (a.r + k.k) % m.n) GROUP BY 1)"""


@query("circular_shift", f"WITH {_SHIFT} SELECT k, round(coefficient, 9) AS coefficient FROM shifted")
def circular_shift(spark, sf_dir):
    rows, _ = fits.design(panel(spark, sf_dir))
    return inference.shift_coefficients(rows, "z_s", "ret_lead1", list(fits.CONTROLS)).select("k", F.round("coefficient", 9).alias("coefficient"))


@query("timing_percentile", f"""WITH {_SHIFT}, o AS (SELECT coefficient AS c, round_even(coefficient / 0.00001, 0) AS r FROM shifted WHERE k = 0), s AS (SELECT coefficient, round_even(coefficient / 0.00001, 0) AS r FROM shifted WHERE k > 0),
d AS (SELECT pos - lag(pos) OVER (ORDER BY pos) AS d FROM kept), a AS (SELECT count(*) + 1 AS n, count(*) FILTER (s.r < o.r) AS below, count(*) FILTER (s.r = o.r) AS ties, quantile_cont(coefficient, 0.05) * 10000 AS p05, quantile_cont(coefficient, 0.95) * 10000 AS p95, any_value(c) * 10000 AS own FROM s, o)
SELECT n, round(own, 4) AS observed_bps, round((below + 0.5 * ties) / n, 6) AS percentile, below, ties, round(p05, 4) AS p05_bps, round(p95, 4) AS p95_bps, (SELECT count(*) FILTER (d > 1) FROM d) AS gaps, (SELECT coalesce(max(d) - 1, 0) FROM d) AS largest_gap FROM a""")
def timing_percentile(spark, sf_dir):
    f = fits.timing(panel(spark, sf_dir))
    row = (f["n"], f["observed_bps"], f["percentile"], f["below"], f["ties"], f["p05_bps"], f["p95_bps"], f["gaps"], f["largest_gap"])
    rows = spark.createDataFrame([row], "n long, observed_bps double, percentile double, below long, ties long, p05_bps double, p95_bps double, gaps long, largest_gap long")
    return rows.withColumns({c: F.round(c, 6 if c == "percentile" else 4) for c in ("observed_bps", "percentile", "p05_bps", "p95_bps")})


_LEFT = A.chain("fy", "kept", "ret_lead1", {c: c for c in fits.CONTROLS}, "volume_gap")
_TONED = A.chain("fv", "kept", "z_a", {c: c for c in fits.CONTROLS}, "volume_gap")


@query("precision_plan", f"""WITH {PANEL}, {_kept(('a',))}, {_LEFT}, {_TONED}, u AS MATERIALIZED (SELECT pos, rn, u AS g FROM fy),
s AS (SELECT count(*) AS n, stddev_samp(ret_lead1) AS sd_r FROM kept), v AS (SELECT sqrt(sum(u * u) / (count(*) - 1)) AS sd_u FROM fy), w AS (SELECT sqrt(sum(u * u) / (count(*) - 1)) AS sd_v FROM fv),
k AS (SELECT {A.error('u', 5)} AS e, {A.error('u', 5, 'rn')} AS e_row)
SELECT n, round(sd_r, 8) AS sd_r, round(sd_u, 8) AS sd_u, round(sd_v, 8) AS sd_v, round(1 - sd_v * sd_v, 8) AS r_squared, round(e / n / (sd_u / sqrt(n)), 7) AS kappa_session, round(e_row / n / (sd_u / sqrt(n)), 7) AS kappa_row,
round(1.96 * 10000 / sqrt(n) * sd_r, 4) AS h1_bps, round(1.96 * 10000 / sqrt(n) * sd_u / sd_v * e / n / (sd_u / sqrt(n)), 4) AS h2_bps FROM s, v, w, k""")
def precision_plan(spark, sf_dir):
    f = fits.precision(panel(spark, sf_dir))
    rows = spark.createDataFrame([tuple(f.values())], ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in f))
    return rows.withColumns({c: F.round(c, 4 if c.endswith("bps") else 7 if c.startswith("kappa") else 8) for c in rows.columns if c != "n"})


_RAW = f"""{PANEL}, whole AS (SELECT * FROM panel WHERE s_a IS NOT NULL AND ret IS NOT NULL AND range_var IS NOT NULL AND log_volume IS NOT NULL AND ret_lead1 IS NOT NULL),
{A.chain('lr', 'whole', 'ret_lead1', {'s_a': 's_a', 'ret': 'ret', 'range_var': 'range_var', 'log_volume': 'log_volume'}, 's_a')}"""


@query("predictive_raw", f"WITH {_RAW} SELECT (SELECT any_value(n) FROM lr)::INT AS n, round({A.coefficient('lr')}, 8) AS coef, round({A.error('lr', 5, 'rn')}, 8) AS se_row, round({A.coefficient('lr')} * (SELECT stddev_samp(s_a) FROM whole) * 10000, 4) AS bps")
def predictive_raw(spark, sf_dir):
    own = panel(spark, sf_dir)
    found = fits.predictive(own)
    sd = own.dropna(subset=["s_a", "ret", "range_var", "log_volume", "ret_lead1"]).agg(F.stddev_samp("s_a")).first()[0]
    row = (found.n, found.coef("s_a"), found.error("s_a", spacing="row"), fits.effect_size(found.coef("s_a"), found.error("s_a", spacing="row"), sd)[0])
    return spark.createDataFrame([row], "n int, coef double, se_row double, bps double").withColumns({"coef": F.round("coef", 8), "se_row": F.round("se_row", 8), "bps": F.round("bps", 4)})


_SAME = f"""{PANEL}, lagged AS (SELECT *, lag(ret) OVER (ORDER BY session) AS ret_lag1, lag(range_var) OVER (ORDER BY session) AS range_var_lag1, lag(log_volume) OVER (ORDER BY session) AS log_volume_lag1 FROM panel),
whole AS (SELECT * FROM lagged WHERE s_a IS NOT NULL AND ret IS NOT NULL AND ret_lag1 IS NOT NULL AND range_var_lag1 IS NOT NULL AND log_volume_lag1 IS NOT NULL),
{A.chain('sd', 'whole', 'ret', {'s_a': 's_a', 'ret_lag1': 'ret_lag1', 'range_var_lag1': 'range_var_lag1', 'log_volume_lag1': 'log_volume_lag1'}, 's_a')}"""


@query("same_day", f"WITH {_SAME} SELECT (SELECT any_value(n) FROM sd)::INT AS n, round({A.coefficient('sd')}, 8) AS coef, round({A.error('sd', 5, 'rn')}, 8) AS se_row")
def same_day(spark, sf_dir):
    found = fits.contemporaneous(panel(spark, sf_dir), admissible=True)
    return spark.createDataFrame([(found.n, found.coef("s_a"), found.error("s_a", spacing="row"))], "n int, coef double, se_row double").withColumns({"coef": F.round("coef", 8), "se_row": F.round("se_row", 8)})


@query("analysis_sample", f"WITH {PANEL} SELECT count(*) AS sessions, count(*) FILTER (n < 1) AS without_events, count(*) FILTER (n > 0) AS kept FROM panel")
def analysis_sample(spark, sf_dir):
    return fits.analysis_sample(panel(spark, sf_dir))
