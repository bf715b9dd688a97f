"""SQL counterparts of the queries, for the same tables."""

from __future__ import annotations

IDX = {
    "Y": "year({c})::BIGINT",
    "Q": "(year({c})*4 + quarter({c}) - 1)::BIGINT",
    "M": "(year({c})*12 + month({c}) - 1)::BIGINT",
    "D": "date_diff('day', DATE '1970-01-01', {c}::DATE)::BIGINT",
}
LABEL = {
    "Y": "period_idx::VARCHAR",
    "Q": "(period_idx // 4)::VARCHAR || 'Q' || (period_idx % 4 + 1)::VARCHAR",
    "M": "(period_idx // 12)::VARCHAR || '-' || lpad((period_idx % 12 + 1)::VARCHAR, 2, '0')",
    "D": "strftime(DATE '1970-01-01' + period_idx::INTEGER, '%Y-%m-%d')",
}
MEASURES = ("l_quantity", "l_discount", "l_extendedprice")


def endog(freq: str = "M", key: str = "o_orderpriority") -> str:
    return (
        f"endog AS (SELECT {key}::VARCHAR AS series_id, {IDX[freq].format(c='o_orderdate')} AS period_idx,"
        " avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)"
    )


EVENTS = (
    f"endog AS (SELECT event_type AS series_id, {IDX['D'].format(c='ts')} AS period_idx,"
    " avg(value) AS y FROM events GROUP BY 1, 2)"
)


def exog(freq: str = "M") -> str:
    avgs = ", ".join(f"avg({m}) AS {m}" for m in MEASURES)
    return f"exog AS (SELECT {IDX[freq].format(c='l_shipdate')} AS period_idx, {avgs} FROM lineitem GROUP BY 1)"


def aligned(freq: str = "M", key: str = "o_orderpriority") -> str:
    """CTE ``rows``: realized and future rows with the three measures."""
    return f"""{endog(freq, key)}, {exog(freq)},
xb AS (SELECT min(period_idx) AS x_lo, max(period_idx) AS x_hi FROM exog),
spans AS (SELECT series_id, greatest(min(period_idx), any_value(x_lo)) AS start_idx,
  least(max(period_idx), any_value(x_hi)) AS current_idx, any_value(x_hi) AS last_idx
  FROM endog, xb GROUP BY 1),
base AS (
  SELECT e.series_id, e.period_idx, false AS is_future, e.y FROM endog e, xb WHERE e.period_idx BETWEEN x_lo AND x_hi
  UNION ALL
  SELECT s.series_id, g.period_idx, true, NULL FROM spans s,
    LATERAL (SELECT unnest(generate_series(greatest(s.current_idx + 1, s.start_idx), s.last_idx)) AS period_idx) g),
rows AS (SELECT b.series_id, b.period_idx, b.is_future, b.y, x.l_quantity, x.l_discount, x.l_extendedprice
  FROM base b LEFT JOIN exog x USING (period_idx))"""


def numbered(freq: str = "M") -> str:
    """CTE ``s``: plain series with time 1..n and length n."""
    return f"""{endog(freq)},
s AS (SELECT series_id, period_idx, y,
  (period_idx - min(period_idx) OVER (PARTITION BY series_id) + 1)::DOUBLE AS t,
  count(*) OVER (PARTITION BY series_id) AS n FROM endog)"""


def rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = " ".join(sql.split())


# --- alignment -----------------------------------------------------------------------------

for name, freq, src, digits in (
    ("resample_mean_month", "M", endog("M"), 4),
    ("resample_mean_quarter", "Q", endog("Q"), 4),
    ("resample_mean_year", "Y", endog("Y", "o_custkey"), 4),
    ("resample_mean_day", "D", EVENTS, 6),
):
    oracle(name, f"WITH {src} SELECT series_id, period_idx, {LABEL[freq]} AS period, round(y, {digits}) AS y FROM endog")

oracle("resample_exog_wide", f"WITH {exog()} SELECT period_idx, {rounded(*MEASURES)} FROM exog")
oracle(
    "resample_exog_long",
    f"""WITH p AS (SELECT {IDX['D'].format(c='ts')} AS period_idx, event_type, value FROM events
    WHERE event_type IN ('click', 'error', 'purchase'))
    SELECT period_idx, {', '.join(f"round(avg(value) FILTER (WHERE event_type = '{v}'), 6) AS {v}" for v in ('click', 'error', 'purchase'))}
    FROM p GROUP BY 1""",
)
oracle("overlap", f"WITH {aligned()} SELECT series_id, start_idx, current_idx, last_idx FROM spans")
oracle(
    "aligned_dataset",
    f"WITH {aligned()} SELECT series_id, period_idx, is_future, round(y, 4) AS y, {rounded(*MEASURES)} FROM rows",
)
oracle(
    "aligned_without_exog",
    f"WITH {endog('Q')} SELECT series_id, period_idx, false AS is_future, round(y, 4) AS y FROM endog",
)
oracle(
    "realized_future_split",
    f"""WITH {aligned()} SELECT series_id, is_future, count(*) AS n, min(period_idx) AS first_idx,
    max(period_idx) AS last_idx FROM rows GROUP BY 1, 2""",
)
oracle("endogenous_data", f"WITH {aligned('Q')} SELECT series_id, period_idx, round(y, 4) AS y FROM rows WHERE NOT is_future")
oracle("exogenous_data", f"WITH {aligned('Q')} SELECT series_id, period_idx, {rounded(*MEASURES)} FROM rows WHERE NOT is_future")
oracle("future_exogenous_data", f"WITH {aligned()} SELECT series_id, period_idx, {rounded(*MEASURES)} FROM rows WHERE is_future")
oracle(
    "future_exog_horizon",
    f"""WITH {aligned()}, f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_idx) AS k
    FROM rows WHERE is_future) SELECT series_id, period_idx, {rounded('l_discount', 'l_quantity')} FROM f WHERE k <= 2""",
)
oracle(
    "column_subset",
    f"WITH {aligned()} SELECT series_id, period_idx, {rounded('l_extendedprice', 'l_quantity')} FROM rows WHERE NOT is_future",
)
oracle(
    "frequency_check",
    f"""WITH {aligned('D')}, c AS (SELECT series_id, count(*) FILTER (WHERE NOT is_future) >= 1 AS ok_overlap,
    count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL OR l_extendedprice IS NULL) = 0
      AND max(period_idx) - min(period_idx) + 1 = count(*) AS ok_frequency FROM rows GROUP BY 1)
    SELECT series_id, 'overlaps' AS rule, ok_overlap AS ok FROM c
    UNION ALL SELECT series_id, 'frequency', ok_frequency FROM c""",
)
oracle(
    "gap_and_dup_check",
    f"""WITH {endog('M', 'o_custkey')}, c AS (SELECT series_id, count(*) FILTER (WHERE y IS NULL) = 0 AS no_null,
    count(*) = count(DISTINCT period_idx) AS no_dup, count(*) = max(period_idx) - min(period_idx) + 1 AS no_gap
    FROM endog GROUP BY 1)
    SELECT series_id, 'no_null' AS rule, no_null AS ok FROM c
    UNION ALL SELECT series_id, 'no_duplicate_period', no_dup FROM c
    UNION ALL SELECT series_id, 'no_gap', no_gap FROM c""",
)
oracle(
    "dataset_rule_table",
    f"""WITH {aligned('Q', 'o_custkey')}, c AS (SELECT series_id,
    count(*) = count(DISTINCT period_idx) AS r1,
    coalesce(max(period_idx) FILTER (WHERE NOT is_future) - min(period_idx) FILTER (WHERE NOT is_future) + 1
      = count(*) FILTER (WHERE NOT is_future), true) AS r2,
    coalesce(max(period_idx) FILTER (WHERE is_future) - min(period_idx) FILTER (WHERE is_future) + 1
      = count(*) FILTER (WHERE is_future), true) AS r3,
    coalesce(min(period_idx) FILTER (WHERE is_future) - coalesce(max(period_idx) FILTER (WHERE NOT is_future), -1) = 1, true) AS r4,
    count(*) FILTER (WHERE NOT is_future AND y IS NULL) = 0 AS r5,
    count(*) FILTER (WHERE is_future AND y IS NOT NULL) = 0 AS r6,
    count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL OR l_extendedprice IS NULL) = 0 AS r7,
    count(*) FILTER (WHERE NOT is_future) >= 1 AS r8 FROM rows GROUP BY 1)
    SELECT series_id, 'no_duplicate_period' AS rule, r1 AS ok FROM c
    UNION ALL SELECT series_id, 'no_gap_realized', r2 FROM c UNION ALL SELECT series_id, 'no_gap_future', r3 FROM c
    UNION ALL SELECT series_id, 'future_follows_realized', r4 FROM c UNION ALL SELECT series_id, 'endog_finite', r5 FROM c
    UNION ALL SELECT series_id, 'endog_only_realized', r6 FROM c
    UNION ALL SELECT series_id, 'exog_finite_and_complete', r7 FROM c
    UNION ALL SELECT series_id, 'one_realized_row', r8 FROM c""",
)
oracle(
    "quarantined_dataset",
    f"""WITH {aligned('Y', 'o_custkey')} SELECT series_id, count(*) AS n, round(sum(y), 4) AS y_sum FROM rows GROUP BY 1
    HAVING count(*) FILTER (WHERE l_quantity IS NULL OR l_discount IS NULL OR l_extendedprice IS NULL) = 0
    AND count(*) FILTER (WHERE NOT is_future) > 0 AND max(period_idx) - min(period_idx) + 1 = count(*)""",
)
oracle(
    "next_periods",
    f"""WITH {endog('M', 'o_custkey')}, l AS (SELECT series_id, max(period_idx) AS last_idx FROM endog GROUP BY 1)
    SELECT series_id, h::BIGINT AS h, (last_idx + h)::BIGINT AS period_idx FROM l, generate_series(1, 3) g(h)""",
)

# --- import layouts ------------------------------------------------------------------------

ORACLES["sink_round_trip"] = ORACLES["aligned_dataset"]
oracle(
    "quarantine_ledger",
    f"""WITH e AS (SELECT o_custkey::VARCHAR || ' ' || o_orderpriority AS series_id, {IDX['Y'].format(c='o_orderdate')} AS period_idx,
    CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL WHEN o_totalprice > 400000 THEN 'inf'::DOUBLE ELSE o_totalprice END AS y
    FROM orders),
    xb AS (SELECT min(year(l_shipdate)) AS x_lo, max(year(l_shipdate)) AS x_hi FROM lineitem),
    s AS (SELECT series_id, bool_and(y IS NOT NULL) AS no_null, count(*) = count(DISTINCT period_idx) AS no_duplicate_period,
      count(DISTINCT period_idx) = max(period_idx) - min(period_idx) + 1 AS no_gap,
      count(*) FILTER (WHERE period_idx BETWEEN x_lo AND x_hi) AS n,
      count(*) FILTER (WHERE period_idx BETWEEN x_lo AND x_hi AND isinf(y)) = 0 AS finite FROM e, xb GROUP BY 1),
    sound AS (SELECT * FROM s WHERE no_null AND no_duplicate_period AND no_gap)
    SELECT series_id, 'series' AS stage, 'no_null' AS reason FROM s WHERE NOT no_null
    UNION ALL SELECT series_id, 'series', 'no_duplicate_period' FROM s WHERE NOT no_duplicate_period
    UNION ALL SELECT series_id, 'series', 'no_gap' FROM s WHERE NOT no_gap
    UNION ALL SELECT series_id, 'align', 'overlaps' FROM sound WHERE n = 0
    UNION ALL SELECT series_id, 'dataset', 'endog_finite' FROM sound WHERE n > 0 AND NOT finite
    UNION ALL SELECT series_id, 'model', 'enough_rows_for_terms' FROM sound WHERE n > 0 AND finite AND n < 3""",
)
oracle(
    "year_month_unpivot",
    f"""WITH e AS (SELECT {IDX['M'].format(c='o_orderdate')} AS period_idx, avg(o_totalprice) AS y FROM orders GROUP BY 1)
    SELECT 'price' AS series_id, period_idx, {LABEL['M']} AS period, round(y, 4) AS y FROM e""",
)

_STATEMENT = f"""l AS (SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus AS series_id FROM orders),
p AS (SELECT unnest(generate_series(1995 * 4, 2001 * 4 + 3))::BIGINT AS period_idx),
v AS (SELECT o_orderpriority || ' ' || o_orderstatus AS series_id, {IDX['Q'].format(c='o_orderdate')} AS period_idx,
  avg(o_totalprice) AS y FROM orders GROUP BY 1, 2),
st AS (SELECT l.series_id, p.period_idx, CASE WHEN v.y >= 200000 THEN v.y ELSE 0.0 END AS y
  FROM l CROSS JOIN p LEFT JOIN v USING (series_id, period_idx))"""
oracle("statement_import", f"WITH {_STATEMENT} SELECT series_id, period_idx, {LABEL['Q']} AS period, round(y, 4) AS y FROM st")
oracle(
    "statement_one_label",
    f"WITH {_STATEMENT} SELECT series_id, period_idx, {LABEL['Q']} AS period, round(y, 4) AS y FROM st WHERE series_id = '2-HIGH O'",
)
ORACLES["statement_scan"] = ORACLES["statement_one_label"]
ORACLES["year_month_scan"] = ORACLES["year_month_unpivot"]
oracle(
    "dated_sheet_scan",
    f"""WITH d AS (SELECT l_shipdate::DATE AS day, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in MEASURES)} FROM lineitem GROUP BY 1),
    u AS ({' UNION ALL '.join(f"SELECT '{m}' AS var, day, CASE WHEN (n + {i}) % 3 <> 0 THEN {m} END AS v FROM d" for i, m in enumerate(MEASURES))})
    SELECT var, day, round(coalesce(
      first_value(v IGNORE NULLS) OVER (PARTITION BY var ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      last_value(v IGNORE NULLS) OVER (PARTITION BY var ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value FROM u""",
)
oracle(
    "quarter_label_parse",
    """WITH l AS (SELECT 'Q' || quarter(o_orderdate) || ' ' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS label FROM orders),
    n AS (SELECT label, regexp_extract(label, '^Q([1-4]) (\\d\\d)$', 2)::INTEGER AS yy, regexp_extract(label, '^Q([1-4])', 1)::INTEGER AS q FROM l)
    SELECT label, ((CASE WHEN yy + 2000 > 2000 THEN 1900 + yy ELSE 2000 + yy END) * 4 + q - 1)::BIGINT AS period_idx,
    count(*) AS n FROM n GROUP BY 1, 2""",
)


def _filled(var: str, ts: str, tie: str, value: str, src: str) -> str:
    return f"""r AS (SELECT {var} AS var, {ts} AS ts, {tie}, {value} AS value FROM {src}),
    f AS (SELECT var, {tie}, coalesce(
      first_value(value IGNORE NULLS) OVER (PARTITION BY var ORDER BY ts, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      last_value(value IGNORE NULLS) OVER (PARTITION BY var ORDER BY ts, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ) AS value FROM r)"""


oracle(
    "backfill_forward_fill_instants",
    f"WITH {_filled('event_type', 'ts', 'event_id', 'CASE WHEN value >= 20 THEN value END', 'events')} SELECT var, event_id, value FROM f",
)
_LINE_KEY = "l_orderkey, l_partkey, l_suppkey"
oracle(
    "backfill_forward_fill_days",
    f"""WITH {_filled('l_returnflag', 'l_shipdate', _LINE_KEY, 'CASE WHEN l_discount > 0.05 THEN l_extendedprice END', 'lineitem')}
    SELECT var, {_LINE_KEY}, value FROM f""",
)
_ONLY_OPEN = "CASE WHEN l_linestatus = 'O' AND l_tax > 0.04 THEN l_quantity END"
oracle(
    "drop_empty_variables",
    f"""WITH {_filled('l_returnflag || l_linestatus', 'l_shipdate', _LINE_KEY, _ONLY_OPEN, 'lineitem')}
    SELECT var, count(*) AS n, round(avg(value), 6) AS mean_value FROM f WHERE value IS NOT NULL GROUP BY 1""",
)

# --- reduction and statistics --------------------------------------------------------------


def _z(m: str, over: str = "OVER (PARTITION BY series_id)") -> str:
    return f"CASE WHEN stddev_pop({m}) {over} > 0 THEN ({m} - avg({m}) {over}) / stddev_pop({m}) {over} ELSE 0.0 END"


oracle(
    "standardized",
    f"""WITH {aligned()} SELECT series_id, period_idx, {', '.join(f'round({_z(m)}, 6) AS z_{m}' for m in MEASURES)}
    FROM rows WHERE NOT is_future""",
)
# correlation matrix of two variables: shares (1 +- |rho|) / 2, loadings +-1/sqrt(2)
_PCA2 = f"""{aligned()},
zz AS (SELECT series_id, period_idx, {_z('l_quantity')} AS z1, {_z('l_discount')} AS z2 FROM rows WHERE NOT is_future),
rho AS (SELECT series_id, corr(l_quantity, l_discount) AS rho FROM rows WHERE NOT is_future GROUP BY 1),
sc AS (SELECT series_id, period_idx, (z1 + sign(rho) * z2) / sqrt(2) AS s0, (z1 - sign(rho) * z2) / sqrt(2) AS s1
  FROM zz JOIN rho USING (series_id)),
sg AS (SELECT series_id, arg_max(s0, abs(s0)) AS t0, arg_max(s1, abs(s1)) AS t1 FROM sc GROUP BY 1),
ld AS (SELECT series_id, sign(t0) / sqrt(2) AS a0, sign(t0) * sign(rho) / sqrt(2) AS b0,
  sign(t1) / sqrt(2) AS a1, -sign(t1) * sign(rho) / sqrt(2) AS b1 FROM sg JOIN rho USING (series_id))"""
oracle(
    "pca_loadings_2var",
    f"""WITH {_PCA2}
    SELECT series_id, 0::BIGINT AS component, 'PCA0_correlated_w_l_quantity' AS component_name, 'l_quantity' AS var, round(a0, 6) AS loading FROM ld
    UNION ALL SELECT series_id, 0, 'PCA0_correlated_w_l_quantity', 'l_discount', round(b0, 6) FROM ld
    UNION ALL SELECT series_id, 1, 'PCA1_correlated_w_l_quantity', 'l_quantity', round(a1, 6) FROM ld
    UNION ALL SELECT series_id, 1, 'PCA1_correlated_w_l_quantity', 'l_discount', round(b1, 6) FROM ld""",
)
oracle(
    "pca_scores_2var",
    f"""WITH {_PCA2} SELECT r.series_id, r.period_idx, r.is_future, round(l_quantity * a0 + l_discount * b0, 6) AS pca0,
    round(l_quantity * a1 + l_discount * b1, 6) AS pca1 FROM rows r JOIN ld USING (series_id)""",
)
oracle(
    "pca_components_kept",
    f"""WITH {_PCA2} SELECT series_id, (CASE WHEN (1 + abs(rho)) / 2 > 0.6 THEN 1 ELSE 2 END)::BIGINT AS n_components,
    round((1 + abs(rho)) / 2, 6) AS first_ratio FROM rho""",
)


# three correlations a, b, c: eigenvalues by the trigonometric formula, vectors by a cross product
_PCA3 = f"""{aligned()},
cr AS (SELECT series_id, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_extendedprice) AS b,
  corr(l_discount, l_extendedprice) AS c FROM rows WHERE NOT is_future GROUP BY 1),
ev AS (SELECT *, k, 1 + 2 * sqrt((a*a + b*b + c*c) / 3)
  * cos((acos(a * b * c / ((a*a + b*b + c*c) / 3) ** 1.5) + [0, 4, 2][k + 1] * pi()) / 3) AS ev FROM cr, generate_series(0, 2) g(k)),
vc AS (SELECT series_id, k, ev / 3 AS ratio, a * c - b * (1 - ev) AS v1, a * b - (1 - ev) * c AS v2, (1 - ev) ** 2 - a * a AS v3 FROM ev),
un AS (SELECT series_id, k, ratio, v1 / s AS v1, v2 / s AS v2, v3 / s AS v3 FROM (SELECT *, sqrt(v1*v1 + v2*v2 + v3*v3) AS s FROM vc)),
kp AS (SELECT *, coalesce(sum(ratio) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.9 AS keep FROM un),
z3 AS (SELECT series_id, {_z('l_quantity')} AS z1, {_z('l_discount')} AS z2, {_z('l_extendedprice')} AS z3 FROM rows WHERE NOT is_future),
sn AS (SELECT k.series_id, k.k, sign(arg_max(v1*z1 + v2*z2 + v3*z3, abs(v1*z1 + v2*z2 + v3*z3))) AS sg
  FROM kp k JOIN z3 USING (series_id) GROUP BY 1, 2),
nm AS (SELECT series_id, k, sg * v1 AS v1, sg * v2 AS v2, sg * v3 AS v3, 'PCA' || k || '_correlated_w_' ||
  CASE WHEN abs(v1) >= greatest(abs(v2), abs(v3)) THEN 'l_quantity' WHEN abs(v2) >= abs(v3) THEN 'l_discount' ELSE 'l_extendedprice' END AS nm
  FROM kp JOIN sn USING (series_id, k) WHERE keep)"""
oracle(
    "pca_nvar",
    f"""WITH {_PCA3} SELECT series_id, k::BIGINT AS component, nm AS component_name, 'l_quantity' AS var, round(v1, 6) AS loading FROM nm
    UNION ALL SELECT series_id, k, nm, 'l_discount', round(v2, 6) FROM nm
    UNION ALL SELECT series_id, k, nm, 'l_extendedprice', round(v3, 6) FROM nm""",
)


def _acf(src: str, limit: str) -> str:
    return f"""WITH {src}, e AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY period_idx) AS i,
    y - avg(y) OVER (PARTITION BY series_id) AS e, count(*) OVER (PARTITION BY series_id) AS n FROM endog),
    c0 AS (SELECT series_id, any_value(n) AS n, sum(e * e) AS c0 FROM e GROUP BY 1),
    p AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.e * b.e) AS c FROM e a JOIN e b
      ON a.series_id = b.series_id AND b.i > a.i GROUP BY 1, 2),
    g AS (SELECT series_id, n, c0, unnest(generate_series(1, n)) AS lag FROM c0)
    SELECT g.series_id, g.lag::BIGINT AS lag, round(coalesce(c, 0.0) / c0, 6) AS r,
    round(1.959963984540054 / sqrt(n), 6) AS band95, round(2.5758293035489004 / sqrt(n), 6) AS band99
    FROM g LEFT JOIN p USING (series_id, lag) WHERE {limit}"""


oracle("acf_table", _acf(endog(), "true"))
oracle("acf_daily_events", _acf(EVENTS, "g.lag <= 10"))


def _kpss(src: str, out: str) -> str:
    """KPSS statistic of ``src(series_id, i, y)`` as CTE ``out``."""
    return f"""{out}_e AS (SELECT series_id, i, y, y - avg(y) OVER (PARTITION BY series_id) AS e, count(*) OVER (PARTITION BY series_id) AS n FROM {src}),
    {out}_s AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cs, trunc(3 * sqrt(n) / 13) AS l FROM {out}_e),
    {out}_c AS (SELECT a.series_id, sum((1 - (b.i - a.i) / (a.l + 1)) * a.e * b.e) AS c FROM {out}_s a JOIN {out}_s b
      ON a.series_id = b.series_id AND b.i > a.i AND b.i - a.i <= a.l GROUP BY 1),
    {out} AS (SELECT s.series_id, any_value(n) AS n, max(y) = min(y) AS const,
      sum(cs * cs) / any_value(n)::DOUBLE / any_value(n) / (sum(e * e) / any_value(n) + 2.0 / any_value(n) * coalesce(any_value(c), 0)) AS kpss
      FROM {out}_s s LEFT JOIN {out}_c USING (series_id) GROUP BY 1)"""


_P = """CASE WHEN kpss <= 0.347 THEN 0.10 WHEN kpss < 0.463 THEN 0.10 + (kpss - 0.347) * (0.05 - 0.10) / (0.463 - 0.347)
 WHEN kpss < 0.574 THEN 0.05 + (kpss - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
 WHEN kpss < 0.739 THEN 0.025 + (kpss - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END"""
_I = "y0 AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY period_idx) AS i, y FROM endog)"
_D1 = "y1 AS (SELECT * FROM (SELECT series_id, i, y - lag(y) OVER (PARTITION BY series_id ORDER BY i) AS y FROM y0) WHERE y IS NOT NULL)"
oracle("kpss_statistic", f"WITH {endog()}, {_I}, {_kpss('y0', 'k0')} SELECT series_id, n, round(kpss, 6) AS kpss, round({_P}, 6) AS p_value FROM k0")
oracle(
    "kpss_differencing",
    f"""WITH {endog()}, {_I}, {_D1}, {_kpss('y0', 'k0')}, {_kpss('y1', 'k1')}
    SELECT k0.series_id, (CASE WHEN k0.const OR k0.kpss <= 0.463 THEN 0 WHEN k1.const OR k1.kpss <= 0.463 THEN 1 ELSE 2 END)::BIGINT AS ndiffs
    FROM k0 JOIN k1 USING (series_id)""",
)
def _orthogonal(src: str, cols: list[str], target: str, out: str, keep: tuple[str, ...] = ()) -> str:
    """CTEs that take out of ``target`` and the later columns what each earlier column explains.

    ``out`` then holds the last column and the target, both orthogonal to all the others, and the columns of ``keep``.
    """
    kept = "".join(f", {c}" for c in keep)
    steps, prev = [], src
    for i, c in enumerate(cols[:-1]):
        rest = cols[i + 1 :] + [target]
        less = ", ".join(f"{r} - {c} * sum({r} * {c}) OVER s / nullif(sum({c} * {c}) OVER s, 0) AS {r}" for r in rest)
        steps.append(f"{out}_{i} AS (SELECT series_id{kept}, {less} FROM {prev} WINDOW s AS (PARTITION BY series_id))")
        prev = f"{out}_{i}"
    steps.append(f"{out} AS (SELECT * FROM {prev})")
    return ", ".join(steps)


# Dickey-Fuller rows with four lagged differences, the number that 66 to 126 periods ask for
_DF_LAGS = 4
_DF_COLS = ["one", "tt"] + [f"d{i}" for i in range(1, _DF_LAGS + 1)] + ["lv"]


def _adf(src: str, out: str) -> str:
    w = "OVER (PARTITION BY series_id ORDER BY i)"
    lags = ", ".join(f"lag(dy, {j}) {w} AS d{j}" for j in range(1, _DF_LAGS + 1))
    at = ", ".join(
        f"s1 + (nd - n1) * (s2 - s1) / (n2 - n1) AS q{j}".replace("s1", str(a)).replace("s2", str(b))
        for j, (a, b) in enumerate(zip(_DF_50, _DF_100))
    )
    p = " ".join(
        f"WHEN st < q{j + 1} THEN {_DF_P[j]} + (st - q{j}) * ({_DF_P[j + 1]} - {_DF_P[j]}) / (q{j + 1} - q{j})" for j in range(7)
    )
    return f"""{out}_d AS (SELECT series_id, i, lag(y) {w} AS lv, y - lag(y) {w} AS dy, count(*) OVER (PARTITION BY series_id) AS n FROM {src}),
    {out}_l AS (SELECT series_id, n, i::DOUBLE AS tt, 1.0::DOUBLE AS one, lv, dy, {lags} FROM {out}_d WHERE lv IS NOT NULL),
    {out}_r AS (SELECT * FROM {out}_l WHERE d{_DF_LAGS} IS NOT NULL),
    {_orthogonal(out + '_r', _DF_COLS, 'dy', out + '_o')},
    {out}_c AS (SELECT series_id, count(*) AS r, sum(dy * lv) / sum(lv * lv) AS b, sum(lv * lv) AS ll, sum(dy * dy) AS zz FROM {out}_o GROUP BY 1),
    {out}_s AS (SELECT series_id, b / sqrt((zz - b * b * ll) / (r - {len(_DF_COLS)}) / ll) AS st, r + {_DF_LAGS} AS nd, 50.0 AS n1, 100.0 AS n2 FROM {out}_c),
    {out}_q AS (SELECT series_id, st, {at} FROM {out}_s),
    {out} AS (SELECT series_id, st, CASE WHEN st <= q0 THEN 0.01 {p} ELSE 0.99 END AS p FROM {out}_q)"""


# rows of the Dickey-Fuller table for 50 and 100 observations (fixed values)
_DF_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
_DF_50 = (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24)
_DF_100 = (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28)
oracle(
    "adf_differencing",
    f"""WITH {endog()}, {_I}, {_D1}, {_adf('y0', 'a0')}, {_adf('y1', 'a1')}
    SELECT a0.series_id, round(a0.st, 4) AS adf_stat, round(a0.p, 4) AS p_value,
    (CASE WHEN a0.p <= 0.05 THEN 0 WHEN a1.p <= 0.05 THEN 1 ELSE 2 END)::BIGINT AS ndiffs FROM a0 JOIN a1 USING (series_id)""",
)
_W = "OVER (PARTITION BY series_id ORDER BY period_idx)"
oracle(
    "ordinary_difference",
    f"""WITH {endog()}, d AS (SELECT series_id, period_idx, y - 2 * lag(y, 1) {_W} + lag(y, 2) {_W} AS z FROM endog)
    SELECT series_id, period_idx, round(z, 4) AS z FROM d WHERE z IS NOT NULL""",
)
oracle(
    "seasonal_difference",
    f"""WITH {endog()}, d AS (SELECT series_id, period_idx, y - lag(y, 12) {_W} - lag(y, 1) {_W} + lag(y, 13) {_W} AS z FROM endog)
    SELECT series_id, period_idx, round(z, 4) AS z FROM d WHERE z IS NOT NULL""",
)

# --- models --------------------------------------------------------------------------------

_TREND = f"""{numbered()},
co AS (SELECT series_id, any_value(n) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(t) AS tm,
  sum(t * t) - sum(t) * sum(t) / count(*) AS sxx FROM s GROUP BY 1),
re AS (SELECT s.series_id, s.period_idx, s.t, s.y - a - b * s.t AS e, co.n, tm, sxx FROM s JOIN co USING (series_id)),
va AS (SELECT series_id, sum(e * e) AS sse, sqrt(sum(((t - tm) / sxx * e) ** 2)) AS se_b,
  sqrt(sum(((1.0 / n - tm * (t - tm) / sxx) * e) ** 2)) AS se_a FROM re GROUP BY 1)"""
oracle(
    "fit_trend",
    f"""WITH {_TREND}, l AS (
      SELECT series_id, 'intercept' AS param, a AS estimate, se_a AS std_err FROM co JOIN va USING (series_id)
      UNION ALL SELECT series_id, 'drift', b, se_b FROM co JOIN va USING (series_id))
    SELECT series_id, param, round(estimate, 4) AS estimate, round(std_err, 4) AS std_err, round(estimate / std_err, 4) AS z,
    round(estimate - 1.959963984540054 * std_err, 4) AS ci_lo, round(estimate + 1.959963984540054 * std_err, 4) AS ci_hi FROM l""",
)
oracle(
    "fit_info",
    f"""WITH {_TREND}, i AS (SELECT series_id, n AS n_obs, sse / n AS sigma2, -n / 2.0 * (ln(2 * pi() * sse / n) + 1) AS llf
      FROM co JOIN va USING (series_id))
    SELECT series_id, n_obs, round(sigma2, 4) AS sigma2, round(llf, 4) AS llf, round(6 - 2 * llf, 4) AS aic,
    round(3 * ln(n_obs) - 2 * llf, 4) AS bic, round(6 * ln(ln(n_obs)) - 2 * llf, 4) AS hqic FROM i""",
)
oracle(
    "fit_diagnostics",
    f"""WITH {_TREND},
    d AS (SELECT series_id, e, n, e - avg(e) OVER (PARTITION BY series_id) AS c,
      row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, greatest(round_even(n / 3.0, 0), 1) AS h FROM re),
    g AS (SELECT *, lag(c) OVER (PARTITION BY series_id ORDER BY i) AS c1 FROM d),
    m AS (SELECT series_id, any_value(n) AS n, sum(c * c1) / sum(c * c) AS r1, avg(c * c) AS m2, avg(c ** 3) AS m3, avg(c ** 4) AS m4,
      sum(CASE WHEN i > n - h THEN e * e END) / sum(CASE WHEN i <= h THEN e * e END) AS het FROM g GROUP BY 1),
    q AS (SELECT series_id, n, n * (n + 2) * r1 * r1 / (n - 1) AS lb, m3 / m2 ** 1.5 AS sk, m4 / (m2 * m2) AS ku, het FROM m),
    j AS (SELECT *, n / 6.0 * (sk * sk + (ku - 3) ** 2 / 4) AS jb FROM q)
    SELECT series_id, round(lb, 6) AS ljung_box, round(jb, 6) AS jarque_bera, round(exp(-jb / 2), 6) AS jarque_bera_p,
    round(sk, 6) AS skew, round(ku, 6) AS kurtosis, round(het, 6) AS heteroskedasticity FROM j""",
)
oracle(
    "fit_residuals",
    f"""WITH {numbered()}, z AS (SELECT series_id, period_idx, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS z FROM s),
    c AS (SELECT series_id, regr_slope(z, t) AS b, regr_intercept(z, t) AS a FROM z GROUP BY 1)
    SELECT series_id, period_idx, round(z - a - b * t, 4) AS resid FROM z JOIN c USING (series_id) WHERE z IS NOT NULL""",
)


def _two(z: str, u: str, over: str = "") -> str:
    """Least squares of ``z`` on 1, t and ``u`` from centred moments."""
    c = lambda a, b: f"covar_pop({a}, {b}) {over}"
    phi = (
        f"({c(u, z)} * {c('t', 't')} - {c('t', u)} * {c('t', z)})"
        f" / ({c(u, u)} * {c('t', 't')} - {c('t', u)} * {c('t', u)})"
    )
    return f"{phi} AS k, {c('t', z)} AS stz, {c('t', u)} AS stu, {c('t', 't')} AS stt, avg({z}) {over} AS mz, avg(t) {over} AS mt, avg({u}) {over} AS mu"


_LINE = "k, (stz - k * stu) / stt AS b, mz - (stz - k * stu) / stt * mt - k * mu AS a"
_AR1 = f"""{numbered()}, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS l FROM s),
w AS (SELECT series_id, {_two('y', 'l')} FROM l WHERE l IS NOT NULL GROUP BY 1),
co AS (SELECT series_id, {_LINE} FROM w)"""
oracle(
    "fit_ar1_trend",
    f"""WITH {_AR1} SELECT series_id, 'intercept' AS param, round(a, 4) AS estimate FROM co
    UNION ALL SELECT series_id, 'drift', round(b, 4) FROM co UNION ALL SELECT series_id, 'ar.L1', round(k, 4) FROM co""",
)
_EX1 = f"""{aligned()}, s AS (SELECT *, (period_idx - min(period_idx) OVER (PARTITION BY series_id) + 1)::DOUBLE AS t FROM rows),
w AS (SELECT series_id, {_two('y', 'l_discount')} FROM s WHERE NOT is_future GROUP BY 1),
co AS (SELECT series_id, {_LINE} FROM w)"""
oracle(
    "fit_trend_exog1",
    f"""WITH {_EX1} SELECT series_id, 'intercept' AS param, round(a, 4) AS estimate FROM co
    UNION ALL SELECT series_id, 'drift', round(b, 4) FROM co UNION ALL SELECT series_id, 'l_discount', round(k, 4) FROM co""",
)
oracle(
    "forecast_trend",
    f"""WITH {_TREND}, l AS (SELECT series_id, max(period_idx) AS last_idx FROM s GROUP BY 1)
    SELECT series_id, h::BIGINT AS h, (last_idx + h)::BIGINT AS period_idx, round(a + b * (n + h), 4) AS prediction
    FROM co JOIN l USING (series_id), generate_series(1, 6) g(h)""",
)
oracle(
    "forecast_trend_exog1",
    f"""WITH {_EX1}, f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period_idx) AS h FROM s WHERE is_future)
    SELECT series_id, h::BIGINT AS h, period_idx, round(a + b * t + k * l_discount, 4) AS prediction
    FROM f JOIN co USING (series_id) WHERE h <= 3
    AND series_id IN (SELECT series_id FROM f GROUP BY 1 HAVING count(*) >= 1)""",
)
oracle(
    "forecast_ar1",
    f"""WITH RECURSIVE {_AR1}, z AS (SELECT series_id, max(period_idx) AS last_idx, max(n) AS n, arg_max(y, t) AS y FROM s GROUP BY 1),
    f(series_id, h, period_idx, v) AS (
      SELECT z.series_id, 1, z.last_idx + 1, a + b * (n + 1) + k * y FROM z JOIN co USING (series_id)
      UNION ALL SELECT f.series_id, h + 1, f.period_idx + 1, a + b * (n + h + 1) + k * v
      FROM f JOIN z ON z.series_id = f.series_id JOIN co ON co.series_id = f.series_id WHERE h < 4)
    SELECT series_id, h::BIGINT AS h, period_idx::BIGINT AS period_idx, round(v, 4) AS prediction FROM f""",
)
oracle(
    "forecast_differenced",
    f"""WITH {numbered()}, z AS (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS z FROM s),
    c AS (SELECT series_id, regr_slope(z, t) AS b, regr_intercept(z, t) AS a, max(n) AS n, max(period_idx) AS last_idx, arg_max(y, t) AS y FROM z GROUP BY 1)
    SELECT series_id, h::BIGINT AS h, (last_idx + h)::BIGINT AS period_idx,
    round(y + a * h + b * (n * h + h * (h + 1) / 2.0), 4) AS prediction FROM c, generate_series(1, 4) g(h)""",
)

_ROLL = """p AS (SELECT *, ceil(0.8 * n) AS w FROM s), f AS (SELECT series_id, period_idx, t, w, y,
  regr_slope(y, t) OVER v AS b, regr_intercept(y, t) OVER v AS a FROM p
  WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN w::INTEGER PRECEDING AND 1 PRECEDING))"""
oracle(
    "rolling_forecast_trend",
    f"WITH {numbered()}, {_ROLL} SELECT series_id, period_idx, round(a + b * t, 4) AS prediction, round(y, 4) AS actual FROM f WHERE t > w",
)
oracle(
    "rolling_rmse",
    f"WITH {numbered()}, {_ROLL} SELECT series_id, round(sqrt(avg((a + b * t - y) ** 2)), 4) AS rmse FROM f WHERE t > w GROUP BY 1",
)
oracle(
    "quarterly_trend_backtest",
    f"WITH {numbered('Q')}, {_ROLL} SELECT series_id, period_idx, round(a + b * t, 4) AS prediction, round(y, 4) AS actual FROM f WHERE t > w",
)
oracle(
    "rolling_forecast_exog1",
    f"""WITH {aligned()}, s AS (SELECT *, (period_idx - min(period_idx) OVER (PARTITION BY series_id) + 1)::DOUBLE AS t FROM rows WHERE NOT is_future),
    f AS (SELECT series_id, period_idx, t, y, l_discount, {_two('y', 'l_discount', 'OVER v')} FROM s
      WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT series_id, period_idx, t, y, l_discount, {_LINE} FROM f)
    SELECT series_id, period_idx, round(a + b * t + k * l_discount, 4) AS prediction, round(y, 4) AS actual FROM g WHERE t > 48""",
)
oracle(
    "rolling_forecast_ar1",
    f"""WITH {numbered()}, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS l FROM s),
    f AS (SELECT series_id, period_idx, t, y, l, {_two('y', 'l', 'OVER v')} FROM l
      WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 39 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT series_id, period_idx, t, y, l, {_LINE} FROM f)
    SELECT series_id, period_idx, round(a + b * t + k * l, 4) AS prediction, round(y, 4) AS actual FROM g WHERE t > 40""",
)

# orders (d, D) of the zero-lag grid, in grid order, with the rows differencing uses up
_ZERO_LAG = ((0, 0, 0, "y"), (0, 1, 12, "y - lag(y, 12) OVER o"), (1, 0, 1, "y - lag(y, 1) OVER o"),
             (1, 1, 13, "y - lag(y, 1) OVER o - lag(y, 12) OVER o + lag(y, 13) OVER o"))
_SCORES = " UNION ALL ".join(
    f"""SELECT series_id, {i}::BIGINT AS order_id, {d}::BIGINT AS d, {sd}::BIGINT AS sd, sqrt(avg((z - a - b * t) ** 2)) AS rmse
    FROM (SELECT series_id, t, w, z, regr_slope(z, t) OVER v AS b, regr_intercept(z, t) OVER v AS a
      FROM (SELECT series_id, t, w, {z} AS z FROM p WINDOW o AS (PARTITION BY series_id ORDER BY t))
      WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN (w - {lost})::INTEGER PRECEDING AND 1 PRECEDING))
    WHERE t > w GROUP BY 1"""
    for i, (d, sd, lost, z) in enumerate(_ZERO_LAG)
)
oracle(
    "brute_best_order",
    f"""WITH {numbered()}, p AS (SELECT *, least(greatest(ceil(0.8 * n), 1), n - 1) AS w FROM s), r AS ({_SCORES})
    SELECT series_id, order_id, d, sd, round(rmse, 4) AS rmse FROM r
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, order_id) = 1""",
)


def _grid(ranges: tuple[range, ...]) -> str:
    names = ("p", "d", "q", "sp", "sd", "sq", "m")
    froms = ", ".join(
        f"(SELECT unnest(generate_series({r.start}, {r.stop - 1}, {r.step}))::INTEGER AS {n}) r_{n}" for n, r in zip(names, ranges)
    )
    return f"""g AS (SELECT row_number() OVER (ORDER BY {', '.join(names)}) - 1 AS order_id, {', '.join(names)} FROM {froms}),
    o AS (SELECT *, len(list_intersect(generate_series(1, p), list_transform(generate_series(1, sp), lambda i: i * m))) > 0
      OR len(list_intersect(generate_series(1, q), list_transform(generate_series(1, sq), lambda i: i * m))) > 0 AS repeated_lags FROM g)"""


oracle(
    "order_grid_valid",
    f"""WITH {endog('Q', 'o_custkey')}, c AS (SELECT series_id, count(*) AS n FROM endog GROUP BY 1),
    {_grid((range(0, 3), range(0, 2), range(0, 3), range(0, 2), range(0, 2), range(0, 2), range(2, 5, 2)))}
    SELECT order_id, count(*) AS n_series FROM o, c WHERE NOT repeated_lags AND p + q + sp + sq + 1 < n GROUP BY 1""",
)
oracle(
    "overspecified_flags",
    f"""WITH {endog('Y', 'o_custkey')}, c AS (SELECT series_id, count(*) AS n FROM endog GROUP BY 1),
    {_grid((range(2), range(1), range(2), range(2), range(1), range(1), range(2, 3)))}
    SELECT series_id, order_id, n, repeated_lags, NOT (1 + p + q + sp + sq + 1 < n) AS overspecified FROM o, c""",
)


# one Gram matrix of z, t and the lags that orders up to (2, 0, 0)(1, 0, 0)4 need, in thousands and about the mean
_PRODUCT_LAGS = (1, 2, 4, 5, 6)
_GRAM = ["1.0", "t", *[f"lag(z, {j}) OVER o" for j in _PRODUCT_LAGS], "z"]
oracle(
    "autoregression_gram",
    f"""WITH {numbered()}, c AS (SELECT series_id, t, (y - avg(y) OVER (PARTITION BY series_id)) / 1000 AS z FROM s),
    l AS (SELECT series_id, t, [{', '.join(f'({c})::DOUBLE' for c in _GRAM)}] AS v FROM c WINDOW o AS (PARTITION BY series_id ORDER BY t))
    SELECT series_id, i::BIGINT AS i, j::BIGINT AS j, round(sum(v[i + 1] * v[j + 1]), 4) AS value
    FROM l, generate_series(0, {len(_GRAM) - 1}) a(i), generate_series(0, {len(_GRAM) - 1}) b(j) WHERE i <= j AND t > 6 GROUP BY ALL""",
)

# orders (p, d) of the grid p, d in 0..1, in grid order; a window of w rows holds w - d - p rows with all lags
_AR_SCORES = " UNION ALL ".join(
    f"""SELECT series_id, {i}::BIGINT AS order_id, {p_}::BIGINT AS p, {d}::BIGINT AS d, sqrt(avg((z - a - b * t{' - k * l' if p_ else ''}) ** 2)) AS rmse
    FROM (SELECT *, {_LINE if p_ else '(stz / stt) AS b, mz - stz / stt * mt AS a'} FROM (
      SELECT series_id, t, w, z, l, {_two('z', 'l', 'OVER v')} FROM (
        SELECT series_id, t, w, z, lag(z) OVER (PARTITION BY series_id ORDER BY t) AS l FROM (
          SELECT series_id, t, w, {'y - lag(y) OVER (PARTITION BY series_id ORDER BY t)' if d else 'y'} AS z FROM p))
      WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN (w - {p_ + d})::INTEGER PRECEDING AND 1 PRECEDING)))
    WHERE t > w GROUP BY 1"""
    for i, (p_, d) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))
)
oracle(
    "brute_autoregression_grid",
    f"""WITH {numbered()}, p AS (SELECT *, least(greatest(ceil(0.8 * n), 1), n - 1) AS w FROM s), r AS ({_AR_SCORES})
    SELECT series_id, order_id, p, d, round(rmse, 4) AS rmse FROM r""",
)

# first pass: four lags and the trend; its residuals lagged once beside the trend
_LONG = ["one", "tt", "l1", "l2", "l3", "l4", "spare"]
oracle(
    "fit_ma_two_stage",
    f"""WITH {numbered()}, b AS (SELECT series_id, t, 1.0::DOUBLE AS one, t AS tt, y AS y0, y,
      {', '.join(f'lag(y, {j}) OVER (PARTITION BY series_id ORDER BY t) AS l{j}' for j in range(1, 5))} FROM s),
    f AS (SELECT series_id, one, tt, l1, l2, l3, l4, l1 AS spare, t AS pos, y0, y FROM b WHERE l4 IS NOT NULL),
    {_orthogonal('f', _LONG, 'y', 'q', ("pos", "y0"))},
    e AS (SELECT series_id, pos AS t, y0 AS y, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS e1 FROM q),
    w AS (SELECT series_id, {_two('y', 'e1')} FROM e WHERE e1 IS NOT NULL GROUP BY 1),
    co AS (SELECT series_id, {_LINE} FROM w)
    SELECT series_id, 'intercept' AS param, round(a, 4) AS estimate FROM co
    UNION ALL SELECT series_id, 'drift', round(b, 4) FROM co UNION ALL SELECT series_id, 'ma.L1', round(k, 4) FROM co""",
)

oracle(
    "fit_autoregressive_errors",
    f"""WITH {aligned()}, s AS (SELECT series_id, (period_idx - min(period_idx) OVER (PARTITION BY series_id) + 1)::DOUBLE AS t, y, l_discount AS x FROM rows WHERE NOT is_future),
    w0 AS (SELECT series_id, {_two('y', 'x')} FROM s GROUP BY 1), c0 AS (SELECT series_id, k AS beta FROM w0),
    u AS (SELECT s.*, s.y - beta * x AS u FROM s JOIN c0 USING (series_id)),
    l AS (SELECT *, lag(u) OVER o AS u1, lag(y) OVER o AS y1, lag(x) OVER o AS x1 FROM u WINDOW o AS (PARTITION BY series_id ORDER BY t)),
    w1 AS (SELECT series_id, {_two('u', 'u1')} FROM l WHERE u1 IS NOT NULL GROUP BY 1), c1 AS (SELECT series_id, k AS phi FROM w1),
    f AS (SELECT series_id, t, phi, y - phi * y1 AS ys, x - phi * x1 AS xs FROM l JOIN c1 USING (series_id) WHERE u1 IS NOT NULL),
    w2 AS (SELECT series_id, any_value(phi) AS phi, {_two('ys', 'xs')} FROM f GROUP BY 1), co AS (SELECT series_id, phi, {_LINE} FROM w2),
    r AS (SELECT series_id, 'intercept' AS param, a AS estimate FROM co UNION ALL SELECT series_id, 'drift', b FROM co
      UNION ALL SELECT series_id, 'l_discount', k FROM co UNION ALL SELECT series_id, 'ar.L1', phi FROM co)
    SELECT series_id, param, round(estimate, 3) AS estimate, false AS converged FROM r""",
)
