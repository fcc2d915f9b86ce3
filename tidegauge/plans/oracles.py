"""SQL for the queries whose texts are long or share parts; adds to ``queries.SQL``."""

from __future__ import annotations

from ..operators.seasonality import HENDERSON_13
from .queries import _IQR, _SEV, _XY, _Z, EVENTS, FLAGS, HOLED, ORDERS, SQL


def _horner(k: tuple[str, ...], x: str) -> str:
    out = k[0]
    for v in k[1:]:
        out = f"({out} * {x} + {v})"
    return out


def _quantile(p: str) -> str:
    """The inverse of the normal distribution by Acklam's rational approximations."""
    # fixed values of the approximation
    a = ("-3.969683028665376e01", "2.209460984245205e02", "-2.759285104469687e02", "1.383577518672690e02", "-3.066479806614716e01", "2.506628277459239e00")
    b = ("-5.447609879822406e01", "1.615858368580409e02", "-1.556989798598866e02", "6.680131188771972e01", "-1.328068155288572e01", "1e0")
    c = ("-7.784894002430293e-03", "-3.223964580411365e-01", "-2.400758277161838e00", "-2.549732539343734e00", "4.374664141464968e00", "2.938163982698783e00")
    d = ("7.784695709041462e-03", "3.224671290700398e-01", "2.445134137142996e00", "3.754408661907416e00", "1e0")
    q2, low, high = f"(({p} - .5) ** 2)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < .02425 THEN {_horner(c, low)} / {_horner(d, low)} WHEN {p} > .97575 THEN -{_horner(c, high)} / {_horner(d, high)} ELSE {_horner(a, q2)} * ({p} - .5) / {_horner(b, q2)} END"


def _cdf(z: str) -> str:
    """The normal distribution by the approximation 26.2.17 of Abramowitz and Stegun."""
    t = f"(1 / (1 + 0.2316419e0 * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def _p(z: str) -> str:
    return f"(2 * (1 - ({_cdf(f'abs({z})')})))"


def _found(rows: str, method: str, score: str, graded: str, where: str, expected: str = "NULL::DOUBLE") -> str:
    return f"SELECT series_id, idx, ts, round(value, 6) AS value, round({score}, 6) AS score, {graded} AS severity, round({expected}, 6) AS expected, '{method}' AS method FROM {rows} WHERE {where}"


def _frame(lo: str, hi: str) -> str:
    return f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN {lo} AND {hi})"


# --- distributions

SQL["session_windows"] = """WITH n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 6) AS total FROM r GROUP BY user_id, run"""
SQL["histogram_auto"] = f"""WITH {EVENTS}, t0 AS (SELECT series_id, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_pop(value) AS s FROM e GROUP BY 1),
t AS (SELECT *, greatest(5, least(ceil(log2(n) + 1), ceil((hi - lo) / (3.5 * s / n ** (1 / 3))), 50))::BIGINT AS k FROM t0), b AS (SELECT series_id, lo, n, (hi - lo) / k AS w, unnest(range(k)) AS bin FROM t),
c AS (SELECT e.series_id, least(floor((value - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS c FROM e JOIN t USING (series_id) GROUP BY 1, 2)
SELECT b.series_id, b.bin, round(lo + b.bin * w, 6) AS left_edge, coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * w), 6) AS density FROM b LEFT JOIN c ON b.series_id = c.series_id AND b.bin = c.bin"""
_PLACED = f"{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, idx) AS i FROM e), t AS (SELECT series_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM e GROUP BY 1)"
SQL["qq_points"] = f"WITH {_PLACED}, p AS (SELECT *, (i - .5::DOUBLE) / n AS p FROM r JOIN t USING (series_id)), z AS (SELECT *, {_quantile('p')} AS z FROM p) SELECT series_id, i::INT AS i, round(z, 6) AS theoretical, round(value, 6) AS sample, round(mean + s * z, 6) AS line FROM z"
_TABLE = "CASE WHEN {c} > .95 THEN .5 + 2 * ({c} - .95) WHEN {c} > .9 THEN .1 + 8 * ({c} - .9) ELSE .01 + .09 * {c} END"
SQL["shapiro_wilk"] = f"""WITH {_PLACED}, p AS (SELECT *, (i - .375::DOUBLE) / (n + .25) AS p FROM r JOIN t USING (series_id) WHERE n >= 8), z AS (SELECT *, {_quantile('p')} AS z FROM p),
w AS (SELECT series_id, sum(z * value) ** 2 / (var_pop(value) * count(*)) AS raw, sum(z * z) AS mm FROM z GROUP BY 1)
SELECT series_id, round(raw / mm, 6) AS w, round({_TABLE.format(c='raw / mm')}, 6) AS p_value, round(raw, 6) AS w_ref, round({_TABLE.format(c='raw')}, 6) AS p_value_ref FROM w"""
SQL["kolmogorov_smirnov"] = f"""WITH {_PLACED}, z AS (SELECT *, (value - mean) / s AS z FROM r JOIN t USING (series_id)), c AS (SELECT *, {_cdf('z')} AS c FROM z), d AS (SELECT series_id, n, max(greatest(abs(i / n - c), abs((i - 1) / n - c))) AS d FROM c GROUP BY 1, 2)
SELECT series_id, round(d, 6) AS statistic, round(1.36 / sqrt(n), 6) AS critical, round(greatest(0, least(1, 2 * ({' + '.join(f"{1 if k % 2 else -1} * exp(-2 * n * d * d * {k * k})" for k in range(1, 11))}))), 6) AS p_value FROM d"""
SQL["kernel_density"] = f"""WITH {EVENTS}, t AS (SELECT series_id, min(value) AS lo, max(value) - min(value) AS r, stddev_samp(value) * count(*) ** -.2 AS h FROM e GROUP BY 1), g AS (SELECT series_id, h, i, lo - .1 * r + 1.2 * r * i / 49 AS x FROM t, (SELECT unnest(range(50))::INT AS i))
SELECT g.series_id, i, round(x, 6) AS x, round(avg(exp(-.5 * ((x - value) / h) ** 2)) / (h * sqrt(2 * pi())), 6) AS density FROM g JOIN e USING (series_id) GROUP BY g.series_id, i, x, h"""

# --- anomalies

SQL["anomaly_trend_deviation"] = f"""WITH {EVENTS}, w AS (SELECT *, regr_slope(value, idx) OVER b AS b0, regr_intercept(value, idx) OVER b AS a0, stddev_pop(value) OVER b AS s0, regr_slope(value, idx) OVER a AS b1, count(*) OVER b AS n0, count(*) OVER a AS n1 FROM e
WINDOW b AS {_frame('10 PRECEDING', '1 PRECEDING')}, a AS {_frame('1 FOLLOWING', '10 FOLLOWING')}), z AS (SELECT *, greatest(abs(value - a0 - b0 * idx), abs(b1 - b0)) / nullif(s0, 0) AS z FROM w WHERE n0 = 10 AND n1 = 10)
{_found('z', 'trend_deviation', 'z', _SEV.format(r='z', m=1.5, h=2.5, c=4.0), 'z > 2', 'a0 + b0 * idx')}"""
SQL["anomaly_volatility"] = f"""WITH {EVENTS}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY idx)) AS d FROM e), w AS (SELECT *, stddev_pop(d) OVER {_frame('5 PRECEDING', '5 FOLLOWING')} / stddev_pop(d) OVER {_frame('UNBOUNDED PRECEDING', '10 PRECEDING')} AS q FROM d)
{_found('w', 'volatility', 'greatest(q, 1 / q)', _SEV.format(r='greatest(q, 1 / q)', m=1.5, h=2.0, c=3.0), 'idx >= 20 AND (q > 2 OR q < .5)')}"""
SQL["anomaly_seasonal"] = f"""WITH {EVENTS}, t AS (SELECT *, avg(value) OVER {_frame('12 PRECEDING', '12 FOLLOWING')} AS trend, idx % 24 AS phase FROM e), m AS (SELECT series_id, phase, avg(value) AS sm FROM t GROUP BY 1, 2), g AS (SELECT series_id, avg(sm) AS gm FROM m GROUP BY 1),
x AS (SELECT t.*, trend + sm - gm AS x, abs(value - trend - sm + gm) AS r FROM t JOIN m USING (series_id, phase) JOIN g USING (series_id)), z AS (SELECT x.*, (r - rm) / nullif(rs, 0) AS z FROM x JOIN (SELECT series_id, avg(r) AS rm, stddev_pop(r) AS rs FROM x GROUP BY 1) USING (series_id))
{_found('z', 'seasonal', 'z', _SEV.format(r='z', m=1.5, h=2.0, c=3.0), 'z > 2', 'x')}"""
_SLOT = "SELECT e.*, m, abs(value - m) / s AS z FROM e JOIN (SELECT series_id, idx % {p} AS slot, avg(value) AS m, greatest(stddev_pop(value), .1) AS s FROM e GROUP BY 1, 2) u ON u.series_id = e.series_id AND idx % {p} = slot WHERE idx >= {p} AND abs(value - m) / s > 3"
SQL["anomaly_seasonal_context"] = f"""WITH {EVENTS}, b AS ({_SLOT.format(p=7)} UNION ALL {_SLOT.format(p=24)}), z AS (SELECT *, row_number() OVER (PARTITION BY series_id, idx ORDER BY z DESC) AS place FROM b)
{_found('z', 'seasonal_context', 'z', _SEV.format(r='z / 3', m=1.5, h=2.0, c=2.5), 'place = 1', 'm')}"""
SQL["anomaly_temporal_iqr"] = f"""WITH {EVENTS}, p AS (SELECT *, list_sort(list(value) OVER {_frame('20 PRECEDING', '1 PRECEDING')}) AS l FROM e), q AS (SELECT *, l[6] AS q1, l[16] AS q3 FROM p WHERE idx >= 20), z AS (SELECT *, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) AS off FROM q)
{_found('z', 'temporal_iqr', 'off / nullif(q3 - q1, 0)', _SEV.format(r='off / nullif(q3 - q1, 0) / 1.5', m=1.5, h=2.0, c=3.0), 'off > 0')}"""
SQL["anomaly_multivariate"] = f"""WITH {ORDERS}, p AS (SELECT a.ts, a.value AS x, b.value AS y FROM o a JOIN o b ON a.ts = b.ts AND a.series_id = '1-URGENT' AND b.series_id = '2-HIGH'),
l AS (SELECT *, covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) AS l FROM p WINDOW w AS (ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), z AS (SELECT *, abs(l - r) AS s FROM l, (SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS r FROM p))
SELECT ts, round(x, 6) AS x, round(y, 6) AS y, round(l, 6) AS local, round(r, 6) AS r, round(s, 6) AS score, {_SEV.format(r='s', m=.4, h=.6, c=.8)} AS severity FROM z WHERE s > .5"""
_MOD = "md AS (SELECT series_id, quantile_cont(value, .5) AS med FROM e GROUP BY 1), d AS (SELECT e.*, med, abs(value - med) AS dev FROM e JOIN md USING (series_id)), ad AS (SELECT series_id, quantile_cont(dev, .5) AS mad FROM d GROUP BY 1), mz AS (SELECT *, .6745 * dev / mad AS score FROM d JOIN ad USING (series_id))"
SQL["ensemble_vote"] = f"""WITH {EVENTS}, {_Z.format(t=3.0)}, zz AS (SELECT series_id, idx, ts, value, score, {_SEV.format(r='score / 3', m=1.2, h=1.5, c=2.0)} AS severity, m AS expected, 'zscore' AS method FROM z), {_IQR.replace('z AS', 'y AS')}, {_MOD},
b AS (SELECT * FROM zz UNION ALL SELECT series_id, idx, ts, value, score, {_SEV.format(r='score / 1.5', m=1.5, h=2.0, c=3.0)}, (q1 + q3) / 2, 'iqr' FROM y WHERE score > 0 UNION ALL SELECT series_id, idx, ts, value, score, {_SEV.format(r='score / 3.5', m=1.2, h=1.5, c=2.0)}, med, 'modified_zscore' FROM mz WHERE score > 3.5)
SELECT series_id, idx, any_value(ts) AS ts, round(any_value(value), 6) AS value, round(avg(score), 6) AS score, arg_min(severity, method) AS severity, round(arg_min(expected, method), 6) AS expected, min(method) AS method, count(*) AS n_methods FROM b GROUP BY 1, 2 HAVING count(*) >= 2"""
SQL["outliers_replace"] = f"WITH {EVENTS}, {_IQR}, m AS (SELECT series_id, quantile_cont(value, .5) AS med FROM e GROUP BY 1) SELECT series_id, idx, round(CASE WHEN score > 0 THEN med ELSE value END, 6) AS cleaned FROM z JOIN m USING (series_id)"
SQL["outliers_smooth"] = f"WITH {EVENTS}, {_IQR} SELECT series_id, idx, round(CASE WHEN score > 0 THEN avg(CASE WHEN score > 0 THEN NULL ELSE value END) OVER {_frame('1 PRECEDING', '1 FOLLOWING')} ELSE value END, 6) AS cleaned FROM z"

# --- trend

SQL["trend_summary"] = f"""WITH {ORDERS}, l AS (SELECT series_id, count(*) AS n, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, regr_r2(value, idx) AS r2, stddev_pop(value) / abs(avg(value)) AS cv, arg_min(value, idx) AS f, arg_max(value, idx) AS z FROM o GROUP BY 1),
r AS (SELECT series_id, idx, value - a - b * idx AS r FROM o JOIN l USING (series_id)), d AS (SELECT *, r - lag(r) OVER (PARTITION BY series_id ORDER BY idx) AS dr FROM r), x AS (SELECT series_id, sqrt(avg(r ** 2)) AS rmse, avg(abs(r)) AS mae, sum(dr ** 2) / sum(r ** 2) AS dw FROM d GROUP BY 1),
c AS (SELECT series_id, count(*) FILTER (d > 0)::DOUBLE AS p, count(*) FILTER (d < 0)::DOUBLE AS q FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM o) GROUP BY 1), k AS (SELECT series_id, (p * (p - 1) + q * (q - 1)) / ((p + q) * (p + q - 1)) AS k FROM c)
SELECT series_id, n, round(b, 6) AS slope, round(a, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN r2 < .1 THEN 'inconclusive' WHEN b > 0 AND r2 > .95 AND b > .5 THEN 'strongly_increasing' WHEN b > 0 THEN 'increasing' WHEN b < 0 AND r2 > .95 AND b < -.5 THEN 'strongly_decreasing' WHEN b < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
round(r2 * k / (1 + .5 * cv), 6) AS strength, round(k, 6) AS consistency, round((z / f) ** (1 / (n - 1)) - 1, 6) AS growth_rate, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(dw, 6) AS durbin_watson, round(n * ln(rmse ** 2) + 4, 6) AS aic, round(n * ln(rmse ** 2) + 2 * ln(n), 6) AS bic FROM l JOIN x USING (series_id) JOIN k USING (series_id)"""
SQL["breakpoints"] = f"""WITH {EVENTS}, k AS (SELECT *, greatest(5, least(20, count(*) OVER (PARTITION BY series_id) // 10)) AS w, count(*) OVER (PARTITION BY series_id) AS n FROM e),
w AS (SELECT k.series_id, k.idx, any_value(k.ts) AS ts, any_value(k.value) AS value, any_value(k.w) AS w, avg(x.value) FILTER (WHERE x.idx < k.idx) AS m0, var_pop(x.value) FILTER (WHERE x.idx < k.idx) AS v0, avg(x.value) FILTER (WHERE x.idx >= k.idx + 0) AS m1, var_pop(x.value) FILTER (WHERE x.idx >= k.idx + 0) AS v1
FROM k JOIN e x ON x.series_id = k.series_id AND x.idx >= k.idx - k.w AND x.idx < k.idx + 0 + k.w WHERE k.idx >= k.w AND k.idx < k.n - k.w GROUP BY 1, 2)
SELECT series_id, idx, ts, round(value, 6) AS value, round(abs(m1 - m0) / sqrt((v0 + v1) / w) / 3, 6) AS score, CASE WHEN v1 > 1.5 * v0 THEN 'variance' ELSE 'level' END AS kind FROM w WHERE abs(m1 - m0) / sqrt((v0 + v1) / w) / 3 > 1"""
SQL["mann_kendall"] = f"""WITH {FLAGS}, s AS (SELECT a.series_id, sum(sign(b.value - a.value))::DOUBLE AS s FROM f a JOIN f b ON a.series_id = b.series_id AND a.idx < b.idx GROUP BY 1), z AS (SELECT series_id, n, s, (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM s JOIN (SELECT series_id, count(*) AS n FROM f GROUP BY 1) USING (series_id))
SELECT series_id, n, s, round(z, 6) AS z, round({_p('z')}, 6) AS p_value, round(2 * s / (n * (n - 1)), 6) AS tau FROM z"""
SQL["pettitt"] = f"""WITH {EVENTS}, r AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM e),
u AS (SELECT *, abs((idx + 1) * (n + 1) - 2 * sum(r) OVER (PARTITION BY series_id ORDER BY idx)) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY k DESC, idx) AS place FROM u)
SELECT series_id, idx, ts, round(k, 6) AS k, round(least(1, 2 * exp(-6 * k * k / (n ** 3 + n ** 2))), 6) AS p_value FROM b WHERE place = 1"""


def _parts(period: int, multiplicative: bool = False) -> str:
    """``x``: the classical decomposition of the daily orders."""
    h = period // 2
    if period % 2:
        centre = f"CASE WHEN count(*) OVER w = {period} THEN avg(value) OVER w END"
    else:
        centre = f"CASE WHEN count(*) OVER w = {period + 1} THEN (sum(value) OVER v + (lag(value, {h}) OVER i + lead(value, {h}) OVER i) / 2) / {period} END"
    line = "{p}.t0 + (c.idx - {p}.idx) * ({q}.t0 - {p}.t0) / ({q}.idx - {p}.idx)"
    off, mean, seasonal, rest = ("value / trend", "avg(ln(off))", "exp(m - gm)", "value / (trend * seasonal)") if multiplicative else ("value - trend", "avg(off)", "m - gm", "value - trend - seasonal")
    return f"""{ORDERS}, c AS (SELECT *, {centre} AS t0 FROM o WINDOW w AS {_frame(f'{h} PRECEDING', f'{h} FOLLOWING')}, v AS {_frame(f'{max(h - 1, 0)} PRECEDING', f'{max(h - 1, 0)} FOLLOWING')}, i AS (PARTITION BY series_id ORDER BY idx)),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS up, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS down FROM c WHERE t0 IS NOT NULL),
tr AS (SELECT c.series_id, c.idx, c.ts, c.value, c.idx % {period} AS phase, coalesce(c.t0, CASE WHEN c.idx < p.idx THEN {line.format(p='p', q='q')} ELSE {line.format(p='r', q='s')} END) AS trend
FROM c JOIN k p ON p.series_id = c.series_id AND p.up = 1 JOIN k q ON q.series_id = c.series_id AND q.up = 2 JOIN k r ON r.series_id = c.series_id AND r.down = 2 JOIN k s ON s.series_id = c.series_id AND s.down = 1),
ph AS (SELECT series_id, phase, {mean} AS m FROM (SELECT series_id, phase, {off} AS off FROM tr) GROUP BY 1, 2), x0 AS (SELECT tr.*, {seasonal} AS seasonal FROM tr JOIN ph USING (series_id, phase) JOIN (SELECT series_id, avg(m) AS gm FROM ph GROUP BY 1) USING (series_id)), x AS (SELECT *, {rest} AS residual FROM x0)"""


_ROW = "series_id, idx, ts, round(value, 3) AS value, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(residual, 3) AS residual"
SQL["decompose_additive"] = f"WITH {_parts(7)} SELECT {_ROW} FROM x"
SQL["decompose_multiplicative"] = f"WITH {_parts(12, True)} SELECT {_ROW.replace(', 3)', ', 5)')} FROM x"
SQL["adjust_additive"] = f"WITH {_parts(7)} SELECT {_ROW}, round(value - seasonal, 3) AS adjusted FROM x"
SQL["adjust_multiplicative"] = f"WITH {_parts(7, True)} SELECT {_ROW}, round(value / seasonal, 3) AS adjusted FROM x"
SQL["decomposition_strength"] = f"WITH {_parts(7)} SELECT series_id, round(greatest(0, 1 - var_pop(residual) / var_pop(seasonal + residual)), 6) AS seasonal_strength, round(greatest(0, 1 - var_pop(residual) / var_pop(trend + residual)), 6) AS trend_strength, round(stddev_samp(residual), 6) AS residual_std FROM x GROUP BY 1"
_WEEK = _frame("3 PRECEDING", "3 FOLLOWING")
_ROUND = "r{k} AS (SELECT *, avg(value - t{j}) OVER (PARTITION BY series_id, idx % 7 ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS raw{k} FROM s{j}), q{k} AS (SELECT *, raw{k} - avg(raw{k}) OVER {w} AS sea{k} FROM r{k}), s{k} AS (SELECT *, avg(value - sea{k}) OVER {w} AS t{k} FROM q{k})"
SQL["stl"] = f"WITH {ORDERS}, s0 AS (SELECT *, 0 AS t0 FROM o), {_ROUND.format(k=1, j=0, w=_WEEK)}, {_ROUND.format(k=2, j=1, w=_WEEK)} SELECT series_id, idx, ts, round(value, 3) AS value, round(t2, 3) AS trend, round(sea2, 3) AS seasonal, round(value - t2 - sea2, 3) AS residual FROM s2"

# --- correlation

_ACF = SQL["autocorrelation"]
SQL["significant_lags"] = f"SELECT * FROM ({_ACF.replace('range(11)', 'range(21)')}) WHERE lag > 0 AND abs(acf) > bound"
_ORDERS_ACF = _ACF.replace(EVENTS, ORDERS).replace("FROM e GROUP", "FROM o GROUP").replace("FROM e JOIN", "FROM o e JOIN")
SQL["acf_periods"] = f"""WITH r AS ({_ORDERS_ACF.replace('range(11)', 'range(61)').replace('round(acf, 6)', 'acf')}), w AS (SELECT *, lag(acf) OVER i AS p, lead(acf) OVER i AS q FROM r WINDOW i AS (PARTITION BY series_id ORDER BY lag))
SELECT series_id, lag AS period, round(acf, 6) AS strength FROM w WHERE lag >= 2 AND lag <= n // 3 AND acf > 1.96 / sqrt(n) AND acf > p AND acf > q"""
SQL["auto_period"] = f"SELECT series_id, arg_max(lag, acf) AS period FROM ({_ORDERS_ACF.replace('range(11)', 'range(53)').replace('round(acf, 6)', 'acf')}) WHERE lag >= 2 AND lag <= least(n // 3, 52) GROUP BY 1"
SQL["lead_lag"] = f"SELECT lag, ccf, CASE WHEN lag > 0 THEN 'first_leads' WHEN lag < 0 THEN 'second_leads' ELSE 'simultaneous' END AS relation FROM ({SQL['cross_correlation']}) ORDER BY abs(ccf) DESC, abs(lag), lag DESC LIMIT 1"
SQL["correlation_tests"] = f"""WITH {ORDERS}, p AS (SELECT a.series_id AS var1, b.series_id AS var2, count(*) AS n, corr(a.value, b.value) AS r FROM o a JOIN o b ON a.idx = b.idx AND a.series_id < b.series_id GROUP BY 1, 2), t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM p)
SELECT var1, var2, n, round(r, 6) AS r, round(t, 6) AS t, round({_p('t')}, 6) AS p_value, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM t"""
SQL["strong_pairs"] = SQL["correlation_tests"]
SQL["rolling_spearman"] = f"""WITH {_XY}, w AS (SELECT a.idx AS here, b.idx, row_number() OVER (PARTITION BY a.idx ORDER BY b.x, b.idx) AS kx, row_number() OVER (PARTITION BY a.idx ORDER BY b.y, b.idx) AS ky FROM xy a JOIN xy b ON b.idx BETWEEN a.idx - 19 AND a.idx WHERE a.idx >= 19)
SELECT here AS idx, round(1 - 6 * sum((kx - ky) ** 2) / (20 * 399), 6) AS r FROM w GROUP BY 1"""
SQL["rolling_kendall"] = f"WITH {_XY} SELECT a.idx, round(sum(sign(b.x - c.x) * sign(b.y - c.y)) / 380, 6) AS r FROM xy a JOIN xy b ON b.idx BETWEEN a.idx - 19 AND a.idx JOIN xy c ON c.idx BETWEEN a.idx - 19 AND a.idx WHERE a.idx >= 19 GROUP BY 1"
_ROLLED = SQL["rolling_correlation"].replace("round(r, 6) AS r", "r")
SQL["rolling_summary"] = f"SELECT 'pair' AS key, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max, round(quantile_cont(r, .5), 6) AS median, round(1 - stddev_pop(r) / abs(avg(r)), 6) AS stability FROM ({_ROLLED})"
SQL["correlation_changes"] = f"SELECT idx, round(r, 6) AS r, round(d, 6) AS change FROM (SELECT idx, r, r - lag(r) OVER (ORDER BY idx) AS d FROM ({_ROLLED})) WHERE abs(d) >= .05"
SQL["nearest_series"] = f"""WITH d AS ({SQL['distance_euclidean'].replace('round(sqrt(sum((x - y) ** 2)), 6)', 'sqrt(sum((x - y) ** 2))')}), b AS (SELECT var1 AS series_id, var2 AS other, distance FROM d UNION ALL SELECT var2, var1, distance FROM d)
SELECT series_id, other, round(distance, 6) AS distance, round(1 - distance / max(distance) OVER (PARTITION BY series_id), 6) AS similarity, (row_number() OVER (PARTITION BY series_id ORDER BY distance, other))::INT AS rank FROM b QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY distance, other) <= 2"""

# --- seasonality and calendar

SQL["pattern_consistency"] = f"""WITH {ORDERS}, c AS (SELECT series_id, idx // 7 AS c, idx % 7 AS p, value FROM o JOIN (SELECT series_id, count(*) AS n FROM o GROUP BY 1) USING (series_id) WHERE idx // 7 < n // 7), m AS (SELECT series_id, c, avg(value) AS m, stddev_pop(value) * sqrt(7) AS s FROM c GROUP BY 1, 2 HAVING stddev_pop(value) > 0),
k AS (SELECT series_id, count(*) AS k FROM m GROUP BY 1), z AS (SELECT series_id, p, sum((value - m) / s) AS z FROM c JOIN m USING (series_id, c) GROUP BY 1, 2) SELECT series_id, round((sum(z * z) - k) / (k * (k - 1)), 6) AS consistency, (k * (k - 1) // 2)::BIGINT AS n_pairs FROM z JOIN k USING (series_id) GROUP BY series_id, k"""
SQL["evolving_strength"] = f"""WITH {ORDERS}, n AS (SELECT series_id, count(*) AS n FROM o GROUP BY 1), w AS (SELECT series_id, n, unnest(range(n // 56)) AS w FROM n), x AS (SELECT o.series_id, w, idx % 7 AS p, value FROM o JOIN w ON o.series_id = w.series_id AND idx >= w * 56 AND idx < w * 56 + 112 AND w * 56 + 112 <= n),
g AS (SELECT series_id, w, avg(value) AS gm, var_pop(value) * count(*) AS total FROM x GROUP BY 1, 2), b AS (SELECT series_id, w, count(*) * (avg(value) - any_value(gm)) ** 2 AS b FROM x JOIN g USING (series_id, w) GROUP BY series_id, w, p), s AS (SELECT series_id, w, sum(b) / any_value(total) AS s FROM b JOIN g USING (series_id, w) GROUP BY 1, 2)
SELECT series_id, w, round(s, 6) AS strength, round(slope, 6) AS slope FROM s JOIN (SELECT series_id, regr_slope(s, w) AS slope FROM s GROUP BY 1) USING (series_id)"""
SQL["effect_trading_days"] = f"""WITH {ORDERS}, m AS (SELECT series_id, date_trunc('month', ts) AS m, sum(value) AS total FROM o GROUP BY 1, 2), d AS (SELECT m, count(*) FILTER (isodow(d) < 6) AS days FROM (SELECT m, unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT m FROM m)) GROUP BY 1)
SELECT series_id, round(regr_slope(total, days), 4) AS per_day, round(regr_r2(total, days), 4) AS r2, count(*) AS n_months FROM m JOIN d USING (m) GROUP BY 1"""
SQL["effect_easter"] = f"""WITH {ORDERS}, y AS (SELECT DISTINCT year(ts) AS y FROM o), a AS (SELECT y, y % 19 AS g, y // 100 AS c, y % 100 AS r FROM y), b AS (SELECT *, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS m FROM a), d AS (SELECT *, (32 + 2 * (c % 4) + 2 * (r // 4) - m - r % 4) % 7 AS d FROM b),
t AS (SELECT y, m + d - 7 * ((g + 11 * m + 22 * d) // 451) + 114 AS t FROM d), z AS (SELECT y, make_date(y, t // 31, t % 31 + 1) AS easter FROM t), f AS (SELECT series_id, value, ts::DATE - easter AS off FROM o JOIN z ON y = year(ts))
SELECT series_id, CASE WHEN off = -2 THEN 'good_friday' WHEN abs(off) <= 3 THEN 'easter' WHEN off = -7 THEN 'palm_sunday' ELSE 'other' END AS slot, count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY 1, 2"""
SQL["effect_holidays"] = f"""WITH {ORDERS}, h AS (SELECT make_date(y, 12, 25) + k AS day, k::INT AS k FROM (SELECT unnest(range(1992, 2001)) AS y), (SELECT unnest(range(-14, 15))::INT AS k)), c AS (SELECT series_id, value, k FROM o JOIN h ON ts::DATE = day),
b AS (SELECT series_id, (s - cs) / (n - cn) AS baseline FROM (SELECT series_id, sum(value) AS s, count(*) AS n FROM o GROUP BY 1) JOIN (SELECT series_id, sum(value) AS cs, count(*) AS cn FROM c GROUP BY 1) USING (series_id))
SELECT series_id, 'christmas' AS name, k AS "offset", count(*) AS n, round(avg(value), 5) AS mean, round(any_value(baseline), 5) AS baseline, round(avg(value) - any_value(baseline), 5) AS impact FROM c JOIN b USING (series_id) WHERE abs(k) <= 7 GROUP BY 1, 3"""
_SHARE = "SELECT series_id, '{name}' AS effect_of, round(sum(b) / any_value(total), 6) AS strength FROM (SELECT series_id, count(*) * (avg(value) - any_value(gm)) ** 2 AS b FROM o JOIN g USING (series_id) GROUP BY series_id, {slot}) JOIN g USING (series_id) GROUP BY 1"
SQL["calendar_strength"] = f"WITH {ORDERS}, g AS (SELECT series_id, avg(value) AS gm, var_pop(value) * count(*) AS total FROM o GROUP BY 1) {_SHARE.format(name='day_of_week', slot='isodow(ts)')} UNION ALL {_SHARE.format(name='month', slot='month(ts)')}"
for _name, _left, _c in (("kpss", "m", (0.739, 0.463, 0.347)), ("kpss_trend", "a + b * idx", (0.216, 0.146, 0.119))):
    SQL[_name] = f"""WITH {ORDERS}, f AS (SELECT series_id, count(*) AS n, avg(value) AS m, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, floor(4 * (count(*) / 100) ** (2 / 9))::BIGINT AS q FROM o GROUP BY 1 HAVING count(*) >= 20), r AS (SELECT series_id, idx, n, q, value - ({_left}) AS r FROM o JOIN f USING (series_id)),
s AS (SELECT *, sum(r) OVER (PARTITION BY series_id ORDER BY idx) AS s FROM r), g AS (SELECT a.series_id, sum((1 - (b.idx - a.idx) / (a.q + 1)) * a.r * b.r) AS g FROM r a JOIN r b ON a.series_id = b.series_id AND b.idx > a.idx AND b.idx <= a.idx + a.q GROUP BY 1),
t AS (SELECT series_id, sum(s * s) / n / n / ((sum(r * r) + 2 * any_value(g)) / n) AS t FROM s JOIN g USING (series_id) GROUP BY series_id, n)
SELECT series_id, round(t, 6) AS statistic, CASE WHEN t >= {_c[0]} THEN .01 WHEN t >= {_c[1]} THEN .025 WHEN t >= {_c[2]} THEN .075 ELSE .15 END::DOUBLE AS p_value, t < {_c[1]} AS is_stationary FROM t"""

# --- quality and streams

_HISTORY = f"{EVENTS}, {_IQR}, h AS (SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, 100 * avg(CASE WHEN score > 0 THEN 0 ELSE 1 END) AS score, count(*) AS n FROM z GROUP BY 1, 2)"
SQL["quality_history"] = f"WITH {_HISTORY} SELECT series_id, ts, round(score, 6) AS score, n FROM h"
SQL["quality_monitor"] = f"""WITH {_HISTORY}, d AS (SELECT *, lag(score) OVER (PARTITION BY series_id ORDER BY ts) - score AS fall FROM h)
SELECT series_id, ts, round(score, 6) AS score, n, round(fall, 6) AS fall, CASE WHEN score < 60 THEN 'critical' WHEN fall > 20 THEN 'sudden_drop' WHEN score < 75 THEN 'warning' END AS alert FROM d"""
SQL["quality_trend"] = f"""WITH {_HISTORY}, t AS (SELECT series_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, regr_slope(score, epoch(ts) / 86400) AS b, regr_intercept(score, epoch(ts) / 86400) AS a, max(epoch(ts) / 86400) AS z FROM h GROUP BY 1)
SELECT series_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(b, 6) AS slope, round(greatest(0, least(100, a + b * (z + 7))), 6) AS in_seven_days, b < -5 AS is_declining FROM t"""
_GAPPED = f"""{EVENTS}, gp AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY idx))) / 1e6 AS g FROM e),
p0 AS (SELECT series_id, count(*) AS n, count(*) - count(value) AS n_missing, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, avg(g) AS gm, stddev_pop(g) AS gs, quantile_cont(g, .5) AS gq FROM gp GROUP BY 1),
pg AS (SELECT series_id, count(*) FILTER (g > 2 * gq) AS n_gaps, max(g) AS largest FROM gp JOIN p0 USING (series_id) GROUP BY 1), pf AS (SELECT *, gs / gm AS cv, floor(span / gq + .5)::BIGINT + 1 AS expected FROM p0 JOIN pg USING (series_id))"""
SQL["quality_profile"] = f"""WITH {_GAPPED} SELECT series_id, n, n_missing, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, round(span, 6) AS span_s, round(gm, 6) AS interval_mean, round(gs, 6) AS interval_std, round(gq, 6) AS interval_median, round(gq, 6) AS interval, round(cv, 6) AS interval_cv,
n_gaps, round(largest, 6) AS largest_gap_s, expected, cv < .1 AS is_regular, round(least(1, (n - n_missing) / expected), 6) AS completeness FROM pf"""
_SCORES = f"""{_GAPPED}, {_IQR}, oc AS (SELECT series_id, 100 * count(*) FILTER (score > 0) / count(*) AS op FROM z GROUP BY 1),
d0 AS (SELECT *, 100 * least(1, (n - n_missing) / expected) AS cp, greatest(0, 100 - 10 * least(5, std / abs(mean))) AS rs, CASE WHEN cv < .1 THEN 100 ELSE greatest(0, 100 - 100 * n_gaps / n) END AS te FROM pf JOIN oc USING (series_id)),
dm AS (SELECT series_id, CASE WHEN cp >= 100 THEN 100 WHEN cp >= 85 THEN cp WHEN cp >= 70 THEN 70 + .8 * (cp - 70) ELSE .7 * cp END AS completeness,
.5 * te + .3 * greatest(0, 100 - 2 * op) + .2 * (100 * (cp / 100 + 1 - least(1, cv) + rs / 100) / 3) AS consistency, .4 * CASE WHEN hi > lo THEN 100 ELSE 50 END + 30 + .3 * rs AS validity,
.6 * CASE WHEN abs(gm - gq) <= .01 * gq THEN 100 ELSE 70 END + .4 * greatest(0, 100 - least(100, 100 * cv)) AS timeliness,
CASE WHEN op < 1 THEN 100 - op WHEN op < 3 THEN 97 - 2 * (op - 1) WHEN op < 7 THEN 92 - 1.75 * (op - 3) WHEN op < 15 THEN 77 - .875 * (op - 7) ELSE greatest(0, 70 - .5 * (op - 15)) END AS accuracy FROM d0),
sc AS (SELECT *, .25 * completeness + .2 * consistency + .25 * validity + .15 * timeliness + .15 * accuracy AS overall FROM dm)"""
SQL["quality_scores"] = f"""WITH {_SCORES} SELECT series_id, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(validity, 6) AS validity, round(timeliness, 6) AS timeliness, round(accuracy, 6) AS accuracy, round(overall, 6) AS overall,
CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'poor' END AS grade, overall >= 70 AS passes FROM sc"""
_ADVICE = {"completeness": "fill gaps and look for lost points", "consistency": "align points to a regular interval", "validity": "check the range and spread of the values", "timeliness": "check the arrival interval", "accuracy": "review and correct outliers"}
SQL["quality_recommendations"] = f"""WITH {_SCORES}, a AS ({' UNION ALL '.join(f"SELECT series_id, '{d}' AS dimension, {d} AS score, '{t}' AS advice FROM sc" for d, t in _ADVICE.items())})
SELECT series_id, dimension, round(score, 6) AS score, advice, CASE WHEN score < 40 THEN 'critical' WHEN score < 60 THEN 'high' ELSE 'medium' END AS priority FROM a WHERE score < 80"""
_LAST = _frame("49 PRECEDING", "CURRENT ROW")
_HIT = "SELECT series_id, ts, round(value, 6) AS value, round(score, 6) AS score, {sev} AS severity, round(mean, 6) AS expected, {t}::DOUBLE AS threshold FROM {rows} WHERE idx > 0 AND score > {t}"
SQL["stream_zscore"] = f"WITH {EVENTS}, w AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS s FROM e WINDOW w AS {_LAST}), z AS (SELECT *, abs(value - mean) / s AS score FROM w WHERE s > 0) {_HIT.format(rows='z', t=2.5, sev=_SEV.format(r='score / 2.5', m=1.5, h=2.0, c=2.5))}"
SQL["stream_modified_zscore"] = f"""WITH {EVENTS}, w AS (SELECT *, avg(value) OVER w AS mean, quantile_cont(value, .5) OVER w AS med, list(value) OVER w AS l FROM e WINDOW w AS {_LAST}), m AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM w),
z AS (SELECT *, .6745 * abs(value - med) / mad AS score FROM m WHERE mad > 0 AND med <> 0) {_HIT.format(rows='z', t=2.5, sev=_SEV.format(r='score / 2.5', m=1.5, h=2.0, c=2.5))}"""
SQL["stream_iqr"] = f"""WITH {EVENTS}, w AS (SELECT *, avg(value) OVER w AS mean, quantile_cont(value, .25) OVER w AS q1, quantile_cont(value, .75) OVER w AS q3 FROM e WINDOW w AS {_LAST}), z AS (SELECT *, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1) AS score FROM w WHERE q3 > q1)
{_HIT.format(rows='z', t=.5, sev=_SEV.format(r='score / .5', m=1.5, h=2.0, c=2.5))}"""
SQL["stream_volatility"] = f"""WITH {EVENTS}, d AS (SELECT *, avg(value) OVER {_LAST} AS mean, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM e), z AS (SELECT *, stddev_pop(d) OVER {_frame('8 PRECEDING', 'CURRENT ROW')} / nullif(stddev_pop(d) OVER {_frame('48 PRECEDING', 'CURRENT ROW')}, 0) AS score FROM d)
{_HIT.format(rows='z', t=1.5, sev=_SEV.format(r='score / 1.5', m=1.5, h=2.0, c=2.5)).replace('idx > 0', 'idx >= 9')}"""

# --- recurrences, a row at a time

SQL["ewma"] = f"""WITH RECURSIVE {HOLED}, w AS (SELECT series_id, idx, value, value AS level FROM h WHERE idx = 0 UNION ALL SELECT h.series_id, h.idx, h.value, CASE WHEN w.level IS NULL THEN h.value WHEN h.value IS NULL THEN w.level ELSE .3 * h.value + .7 * w.level END FROM w JOIN h ON h.series_id = w.series_id AND h.idx = w.idx + 1)
SELECT series_id, idx, round(value, 6) AS value, round(level, 6) AS smooth FROM w"""
SQL["exponential_fill"] = SQL["ewma"].replace("round(value, 6) AS value, round(level, 6) AS smooth", "round(coalesce(value, level), 6) AS filled")
SQL["forecast_ses"] = f"WITH {ORDERS}, l AS (SELECT series_id, list_reduce(list(value ORDER BY idx), lambda a, x: .3 * x + .7 * a) AS l FROM o GROUP BY 1) SELECT series_id, unnest(range(1, 11))::INT AS step, round(l, 4) AS forecast FROM l"
SQL["merge_nearby"] = f"""WITH RECURSIVE {EVENTS}, {_Z.format(t=1.5)}, c AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS r FROM z), m AS (SELECT series_id, r, 1 AS grp, idx AS held, score FROM c WHERE r = 1
UNION ALL SELECT c.series_id, c.r, CASE WHEN c.idx <= held + 3 THEN grp ELSE grp + 1 END, CASE WHEN c.idx <= held + 3 AND c.score <= m.score THEN held ELSE c.idx END, CASE WHEN c.idx <= held + 3 AND c.score <= m.score THEN m.score ELSE c.score END FROM m JOIN c ON c.series_id = m.series_id AND c.r = m.r + 1),
k AS (SELECT series_id, arg_max(held, r) AS idx FROM m GROUP BY series_id, grp)
SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / 1.5', m=1.2, h=1.5, c=2.0)} AS severity, round(m, 6) AS expected, 'zscore' AS method FROM c JOIN k USING (series_id, idx)"""
SQL["variance_changes"] = f"""WITH RECURSIVE {EVENTS}, w AS (SELECT *, var_samp(value) OVER b AS v0, count(*) OVER b AS n0, var_samp(value) OVER a AS v1, count(*) OVER a AS n1 FROM e WINDOW b AS {_frame('10 PRECEDING', '1 PRECEDING')}, a AS {_frame('CURRENT ROW', '9 FOLLOWING')}),
c AS (SELECT *, greatest(v0, v1) / nullif(least(v0, v1), 0) AS f FROM w WHERE n0 = 10 AND n1 = 10 AND greatest(v0, v1) / nullif(least(v0, v1), 0) > 4),
k AS (SELECT series_id, min(idx) AS idx FROM c GROUP BY 1 UNION ALL SELECT series_id, idx FROM (SELECT k.series_id, (SELECT min(c.idx) FROM c WHERE c.series_id = k.series_id AND c.idx >= k.idx + 10) AS idx FROM k) WHERE idx IS NOT NULL)
SELECT series_id, idx, ts, round(value, 6) AS value, round(f, 6) AS f FROM c JOIN k USING (series_id, idx)"""
SQL["cusum_changepoints"] = f"""WITH RECURSIVE {EVENTS}, d AS (SELECT series_id, idx, value - m AS d, s FROM e JOIN (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1) USING (series_id)),
c AS (SELECT DISTINCT series_id, -1::BIGINT AS idx, 0::DOUBLE AS up, 0::DOUBLE AS down, -10::BIGINT AS last, false AS hit, 0::DOUBLE AS score FROM d
UNION ALL SELECT series_id, idx, CASE WHEN top > 4 * s THEN 0 ELSE u END, CASE WHEN top > 4 * s THEN 0 ELSE w END, CASE WHEN top > 4 * s AND idx - last >= 10 THEN idx ELSE last END, top > 4 * s AND idx - last >= 10, top / s
FROM (SELECT *, greatest(u, w) AS top FROM (SELECT d.series_id, d.idx, s, last, greatest(0, up + d - .5 * s) AS u, greatest(0, down - d - .5 * s) AS w FROM c JOIN d ON d.series_id = c.series_id AND d.idx = c.idx + 1)))
SELECT series_id, idx, round(score, 6) AS score FROM c WHERE hit"""

# --- forecasts

_LAST_GAP = f"{ORDERS}, en AS (SELECT series_id, max(ts) AS last, arg_max(g, idx) AS gap, max(idx) + 1 AS n FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY idx) AS g FROM o) GROUP BY 1)"
SQL["forecast_dates"] = f"WITH {_LAST_GAP}, m AS (SELECT series_id, avg(value) AS f FROM o JOIN en USING (series_id) WHERE idx >= n - 5 GROUP BY 1) SELECT series_id, step, last + step * gap AS ts, round(f, 6) AS forecast, 'moving_average' AS method FROM en JOIN m USING (series_id), (SELECT unnest(range(1, 4))::INT AS step)"


def _members(source: str, horizon: int) -> str:
    """Rows (series_id, step, method, forecast) of three forecasters on ``source``."""
    steps = f"(SELECT unnest(range(1, {horizon + 1}))::INT AS step)"
    return f"""SELECT series_id, step, 'moving_average' AS method, f AS forecast FROM (SELECT series_id, avg(value) AS f FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) <= 5) GROUP BY 1), {steps}
UNION ALL SELECT series_id, step, 'linear', a + b * (n - 1 + step) FROM (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(*) AS n FROM {source} GROUP BY 1), {steps}
UNION ALL SELECT l.series_id, step, 'seasonal_naive', value FROM (SELECT *, 7 - row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS phase FROM {source} QUALIFY phase >= 0) l JOIN {steps} ON (step - 1) % 7 = phase"""


_OF = f"{ORDERS}, os AS (SELECT o.*, n FROM o JOIN (SELECT series_id, count(*) AS n FROM o GROUP BY 1) USING (series_id)), fc AS ({_members('o', 10)})"
_TRAIN = f", tn AS (SELECT * FROM os WHERE idx < n - 10), ho AS ({_members('tn', 10)}), er AS (SELECT ho.series_id, method, avg((value - forecast) ** 2) AS mse FROM ho JOIN os ON os.series_id = ho.series_id AND idx - n + 11 = step GROUP BY 1, 2)"
SQL["ensemble_average"] = f"WITH {_OF} SELECT series_id, step, round(avg(forecast), 4) AS forecast, 'ensemble_average' AS method FROM fc GROUP BY 1, 2"
SQL["ensemble_median"] = f"WITH {_OF} SELECT series_id, step, round(quantile_cont(forecast, .5), 4) AS forecast, 'ensemble_median' AS method FROM fc GROUP BY 1, 2"
SQL["ensemble_weighted"] = f"WITH {_OF} SELECT series_id, step, round(sum(forecast * CASE method WHEN 'moving_average' THEN .5 WHEN 'linear' THEN .3 ELSE .2 END), 4) AS forecast, 'ensemble_weighted' AS method FROM fc GROUP BY 1, 2"
SQL["ensemble_optimal"] = f"WITH {_OF}{_TRAIN} SELECT series_id, step, round(sum(forecast / mse) / sum(1 / mse), 4) AS forecast, 'ensemble_optimal' AS method FROM fc JOIN er USING (series_id, method) GROUP BY 1, 2"
SQL["ensemble_best"] = f"WITH {_OF}{_TRAIN} SELECT series_id, step, round(forecast, 4) AS forecast, 'ensemble_best' AS method FROM fc JOIN (SELECT series_id, arg_min(method, mse) AS method FROM er GROUP BY 1) USING (series_id, method)"
SQL["forecast_intervals"] = f"""WITH {_OF}, l AS (SELECT * FROM fc WHERE method = 'linear'), s AS (SELECT series_id, 1.96 * greatest(stddev_pop(forecast), .1 * abs(avg(forecast))) AS half FROM l GROUP BY 1)
SELECT series_id, step, method, round(forecast, 4) AS forecast, round(forecast - half * sqrt(1 + (step - 1) * .1::DOUBLE), 4) AS lower, round(forecast + half * sqrt(1 + (step - 1) * .1::DOUBLE), 4) AS upper FROM l JOIN s USING (series_id)"""
SQL["ensemble_diversity"] = f"""WITH {_OF} SELECT 'linear' AS model1, 'seasonal_naive' AS model2, round(corr(a.forecast, b.forecast), 6) AS correlation, round(avg(abs(a.forecast - b.forecast)), 6) AS disagreement FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.step = b.step AND a.method = 'linear' AND b.method = 'seasonal_naive'"""
_ERRORS = "count(*) AS n, round(avg(abs(a - f)), 4) AS mae, round(sqrt(avg((a - f) ** 2)), 4) AS rmse, round(100 * avg(abs((a - f) / a)), 4) AS mape, round(100 * avg(2 * abs(a - f) / (abs(a) + abs(f))), 4) AS smape, round(1 - sum((a - f) ** 2) / (var_pop(a) * count(*)), 4) AS r2"
SQL["forecast_metrics"] = f"""WITH {_OF}, tn AS (SELECT * FROM os WHERE idx < n - 14), ho AS ({_members('tn', 14)}), p AS (SELECT ho.series_id, value AS a, forecast AS f FROM ho JOIN os ON os.series_id = ho.series_id AND idx - n + 15 = step AND method = 'seasonal_naive'),
nv AS (SELECT series_id, avg(d) AS d FROM (SELECT series_id, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY idx)) AS d FROM o) GROUP BY 1) SELECT series_id, {_ERRORS}, round(avg(abs(a - f)) / any_value(d), 4) AS mase FROM p JOIN nv USING (series_id) GROUP BY 1"""
SQL["walk_forward"] = f"""WITH {_OF}, b AS (SELECT *, n - 7 * (3 - fold) AS split FROM os, (SELECT unnest(range(3))::INT AS fold)), t AS (SELECT series_id, fold, avg(value) AS f FROM b WHERE idx < split AND idx >= split - 5 GROUP BY 1, 2),
p AS (SELECT series_id, fold, value AS a, f FROM b JOIN t USING (series_id, fold) WHERE idx >= split AND idx < split + 7) SELECT series_id, fold, {_ERRORS} FROM p GROUP BY 1, 2"""
SQL["adjust_x13"] = f"""WITH {ORDERS}, t AS (SELECT *, idx % 12 AS phase, ({' + '.join(f"({w}) * lag(value, {6 - j}) OVER i" for j, w in enumerate(HENDERSON_13))}) / {sum(HENDERSON_13)!r} AS trend FROM o WINDOW i AS (PARTITION BY series_id ORDER BY idx)),
f AS (SELECT series_id, phase, avg(value / trend) AS f FROM t WHERE trend IS NOT NULL GROUP BY 1, 2), g AS (SELECT series_id, avg(f) AS g FROM f GROUP BY 1)
SELECT series_id, idx, ts, round(value, 4) AS value, round(trend, 4) AS trend, round(f / g, 4) AS factor, round(f - g, 4) AS factor_ref, round(value / (f / g), 4) AS adjusted FROM t JOIN f USING (series_id, phase) JOIN g USING (series_id)"""
SQL["residual_statistics"] = f"""WITH {_OF}, tn AS (SELECT * FROM os WHERE idx < n - 60), ho AS ({_members('tn', 60)}), r AS (SELECT ho.series_id, step AS i, value - forecast AS r FROM ho JOIN os ON os.series_id = ho.series_id AND idx - n + 61 = step AND method = 'linear'),
t AS (SELECT series_id, count(*) AS n, avg(r) AS m, stddev_pop(r) AS s, skewness(r) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS g1, kurtosis_pop(r) AS g2 FROM r GROUP BY 1), a AS (SELECT a.series_id, n, b.i - a.i AS k, sum((a.r - m) * (b.r - m)) / n / s ** 2 AS acf FROM r a JOIN r b ON a.series_id = b.series_id AND b.i - a.i BETWEEN 1 AND 5 JOIN t ON t.series_id = a.series_id GROUP BY a.series_id, n, s, b.i - a.i)
SELECT t.series_id, round(m, 4) AS mean, round(s, 4) AS std, round(g1, 4) AS skewness, round(g2, 4) AS kurtosis, round(q, 4) AS ljung_box FROM t JOIN (SELECT series_id, any_value(n * (n + 2)) * sum(acf ** 2 / (n - k)) AS q FROM a GROUP BY 1) USING (series_id)"""
_O_SCORES = _SCORES.replace(EVENTS, ORDERS).replace("FROM e)", "FROM o)").replace("FROM e GROUP", "FROM o GROUP").replace("FROM e JOIN", "FROM o JOIN")
_RULES = {"overall < 60": "low data quality", "k > 1": "high variability", "k < .1": "stable values", "abs(sk) > 1": "skewed distribution", "direction LIKE '%increasing'": "rising trend", "direction LIKE '%decreasing'": "falling trend", "dn < 30": "few points"}
SQL["insights"] = f"""WITH {_O_SCORES}, ds AS (SELECT series_id, count(*) AS dn, stddev_pop(value) / abs(avg(value)) AS k, skewness(value) AS sk FROM o GROUP BY 1), tr AS ({SQL['trend_summary']}), al AS (SELECT * FROM ds JOIN sc USING (series_id) JOIN (SELECT series_id, direction FROM tr) USING (series_id))
{' UNION ALL '.join(f"SELECT series_id, '{t}' AS finding FROM al WHERE {c}" for c, t in _RULES.items())}"""
_I, _W7 = "OVER (PARTITION BY series_id ORDER BY idx)", f"OVER {_frame('6 PRECEDING', 'CURRENT ROW')}"
_FULL = ", ".join(f"CASE WHEN idx >= 6 THEN round({f}(value) {_W7}, 3) END AS rolling_7_{n}" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
_CYCLES = ", ".join(f"round({f}(2 * pi() * ({c}) / {n}), 3) + 0 AS {k}_{f}" for k, c, n in (("dow", "isodow(ts) - 1", 7), ("month", "month(ts) - 1", 12), ("hour", "hour(ts)", 24)) for f in ("sin", "cos"))
SQL["forecast_features"] = f"""WITH {ORDERS} SELECT series_id, round(value, 3) AS value, idx, idx AS vidx, {', '.join(f'round(lag(value, {k}) {_I}, 3) AS lag_{k}' for k in (1, 2, 7, 14, 21))}, {_FULL}, idx AS trend, idx * idx AS trend_squared, round(value - lag(value) {_I}, 3) AS first_diff, round(value - 2 * lag(value) {_I} + lag(value, 2) {_I}, 3) AS second_diff,
(isodow(ts) - 1)::INT AS dow, month(ts)::INT AS month, quarter(ts)::INT AS quarter, year(ts)::INT AS year, dayofyear(ts)::INT AS day_of_year, week(ts)::INT AS iso_week, hour(ts)::INT AS hour, isodow(ts) > 5 AS is_weekend, {_CYCLES}, (month(ts) = 1 AND day(ts) = 1) OR (month(ts) = 12 AND day(ts) = 25) AS is_holiday,
idx % 7 AS season, round(sin(2 * pi() * (idx % 7) / 7), 3) AS season_sin, round(cos(2 * pi() * (idx % 7) / 7), 3) AS season_cos FROM o"""

SQL["standardized_moments"] = f"""WITH {EVENTS}, t AS (SELECT series_id, count(*)::DOUBLE AS n, avg(value) AS m, stddev_pop(value) AS sd FROM e WHERE value IS NOT NULL GROUP BY 1),
z AS (SELECT series_id, n, sum(((value - m) / nullif(sd, 0)) ** 3) AS z3, sum(((value - m) / nullif(sd, 0)) ** 4) AS z4 FROM e JOIN t USING (series_id) WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT series_id, coalesce(round(CASE WHEN n > 2 THEN n / ((n - 1) * (n - 2)) * z3 END, 6), 0) AS skewness,
coalesce(round(CASE WHEN n > 3 THEN n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * z4 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)) END, 6), 0) AS kurtosis FROM z"""

SQL["seasonal_patterns"] = f"""SELECT series_id, lag AS period, round(abs(acf), 6) AS strength, CASE WHEN abs(acf) > .3 THEN .8::DOUBLE ELSE .5::DOUBLE END AS confidence
FROM ({_ACF.replace(EVENTS, FLAGS + ", e AS (SELECT * FROM f)").replace("range(11)", "range(53)")}) WHERE lag IN (7, 12, 24, 48, 52) AND abs(acf) > .1 AND abs(acf) > bound"""
SQL["stationarity_kpss"] = f"SELECT series_id, 'kpss' AS test, statistic, p_value, is_stationary FROM ({SQL['kpss']})"
_COUNTED = SQL["mann_kendall"].replace(FLAGS, EVENTS).replace("FROM f ", "FROM e ").replace("JOIN f ", "JOIN e ")
SQL["mann_kendall_counted"] = f"SELECT * REPLACE (round(p_value, 4) AS p_value) FROM ({_COUNTED})"
_N = "n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1)"
SQL["normality"] = f"""WITH {EVENTS}, {_N} SELECT series_id, 'shapiro_wilk' AS test, round(w, 4) AS statistic, round(p_value, 4) AS p_value, n, p_value > .05 AS is_normal FROM ({SQL['shapiro_wilk']}) JOIN n USING (series_id) WHERE n <= 2000
UNION ALL SELECT series_id, 'kolmogorov_smirnov', round(statistic, 4), round(p_value, 4), n, p_value > .05 FROM ({SQL['kolmogorov_smirnov']}) JOIN n USING (series_id) WHERE n > 2000"""
_ENDS = "n AS (SELECT series_id, count(*) AS n, arg_min(value, idx) AS first, arg_max(value, idx) AS last FROM o GROUP BY 1), st AS (SELECT unnest(range(1, 11))::INT AS step)"
SQL["forecast_ets"] = f"""WITH RECURSIVE {ORDERS}, {_ENDS}, r(series_id, i, base, slope, e) AS (SELECT a.series_id, 0::BIGINT, a.value + (b.value - a.value), b.value - a.value, a.value - (a.value + (b.value - a.value)) FROM o a JOIN o b ON b.series_id = a.series_id AND a.idx = 0 AND b.idx = 1
UNION ALL SELECT r.series_id, o.idx, r.base + .3e0 * r.e + r.slope + .3e0 * .1e0 * r.e, r.slope + .3e0 * .1e0 * r.e, o.value - (r.base + .3e0 * r.e + r.slope + .3e0 * .1e0 * r.e) FROM r JOIN o ON o.series_id = r.series_id AND o.idx = r.i + 1)
SELECT series_id, step, round(base + .3e0 * e + step * (slope + .3e0 * .1e0 * e), 4) AS forecast FROM r JOIN n USING (series_id), st WHERE i = n - 1"""
SQL["forecast_theta"] = f"""WITH RECURSIVE {ORDERS}, {_ENDS}, d AS (SELECT a.series_id, b.idx, b.value - a.value AS d FROM o a JOIN o b ON b.series_id = a.series_id AND b.idx = a.idx + 1),
l AS (SELECT series_id, regr_slope(d, idx) AS b, regr_intercept(d, idx) AS a FROM d GROUP BY 1), t AS (SELECT o.series_id, idx, n, 2 * value - (first + a * idx + b * idx * (idx + 1) / 2) AS v FROM o JOIN l USING (series_id) JOIN n USING (series_id)),
r(series_id, i, level) AS (SELECT series_id, 0::BIGINT, v FROM t WHERE idx = 0 UNION ALL SELECT r.series_id, t.idx, 2 / (t.n + 1) * t.v + (1 - 2 / (t.n + 1)) * r.level FROM r JOIN t ON t.series_id = r.series_id AND t.idx = r.i + 1)
SELECT series_id, step, round(level + step * (last - first) / (n - 1), 4) AS forecast FROM r JOIN n USING (series_id), st WHERE i = n - 1"""
SQL["forecast_holt_winters"] = f"""WITH RECURSIVE {ORDERS}, {_ENDS}, h AS (SELECT series_id, avg(value) FILTER (WHERE idx < 7) AS level, (avg(value) FILTER (WHERE idx >= 7) - avg(value) FILTER (WHERE idx < 7)) / 7 AS trend, list(value ORDER BY idx) FILTER (WHERE idx < 7) AS x FROM o WHERE idx < 14 GROUP BY 1),
r(series_id, i, level, trend, q) AS (SELECT series_id, 0::BIGINT, level, trend, list_transform(list_concat(x[2:7], x[1:1]), lambda v: v - level) FROM h
UNION ALL SELECT u.series_id, u.i, u.l, .1e0 * (u.l - u.level) + .9e0 * u.trend, list_concat(u.q[2:7], [.1e0 * (u.value - u.l) + .9e0 * u.q[1]]) FROM (SELECT r.series_id, o.idx AS i, o.value, r.level, r.trend, r.q, .3e0 * (o.value - r.q[1]) + .7e0 * (r.level + r.trend) AS l FROM r JOIN o ON o.series_id = r.series_id AND o.idx = r.i + 1) u)
SELECT series_id, step, round(level + step * trend + q[(step - 1) % 7 + 1], 4) AS forecast FROM r JOIN n USING (series_id), st WHERE i = n - 1"""
SQL["partial_autocorrelation"] = f"""WITH RECURSIVE {EVENTS}, t AS (SELECT series_id, count(*) AS n, avg(value) AS m, sum((value - avg_value) ** 2) AS ss FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS avg_value FROM e) GROUP BY 1 HAVING count(*) >= 10),
a AS (SELECT series_id, n, k, sum((x.value - m) * (y.value - m)) / any_value(ss) AS r FROM (SELECT *, unnest(range(1, least(20, n // 4) + 1)) AS k FROM t) JOIN e x USING (series_id) JOIN e y ON y.series_id = x.series_id AND y.idx = x.idx + k GROUP BY 1, 2, 3),
l AS (SELECT series_id, n, list(r ORDER BY k) AS r FROM a GROUP BY 1, 2),
p(series_id, n, r, k, phi, a) AS (SELECT series_id, n, r, 1::BIGINT, [r[1]], r[1] FROM l
UNION ALL SELECT series_id, n, r, k, list_append(list_transform(range(1, k), lambda j: phi[j] - a * phi[k - j]), a), a FROM (SELECT series_id, n, r, k + 1 AS k, phi, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS a FROM p WHERE k < len(r)))
SELECT series_id, k::INT AS lag, round(a, 6) AS pacf, abs(a) > 1.96 / sqrt(n) AS significant FROM p"""
SQL["optimal_lag"] = f"SELECT series_id, min(lag) FILTER (WHERE significant) AS optimal_lag FROM ({SQL['partial_autocorrelation']}) GROUP BY 1"
SQL["dbscan"] = f"""WITH {EVENTS}, c AS (SELECT a.series_id, a.idx, a.value FROM e a JOIN e b ON a.series_id = b.series_id AND b.value BETWEEN a.value - .5 AND a.value + .5 GROUP BY 1, 2, 3 HAVING count(*) - 1 >= 3),
g AS (SELECT e.series_id, e.idx, min(abs(e.value - c.value)) AS score FROM e JOIN c USING (series_id) GROUP BY 1, 2) SELECT series_id, idx, round(score, 6) AS score FROM g WHERE score > .5"""
SQL["trend_test"] = f"""WITH {FLAGS}, t AS (SELECT series_id, count(*) AS n, regr_slope(value, idx) AS b, regr_r2(value, idx) AS r2 FROM f GROUP BY 1), l AS (SELECT series_id, 'linear' AS test, sign(b) * sqrt(r2 * (n - 2) / (1 - r2)) AS s FROM t),
u AS (SELECT series_id, 'mann_kendall' AS test, z AS s, p_value AS p FROM ({SQL['mann_kendall']}) UNION ALL SELECT series_id, test, s, {_p('s')} FROM l)
SELECT series_id, test, round(s, 4) AS statistic, round(p, 4) AS p_value, CASE WHEN p >= .05 THEN 'none' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM u"""
SQL["engle_granger"] = f"""WITH {ORDERS}, p AS (SELECT a.series_id AS var1, b.series_id AS var2, a.idx, a.value AS x, b.value AS y FROM o a JOIN o b ON a.idx = b.idx AND a.series_id < b.series_id),
l AS (SELECT var1, var2, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p GROUP BY 1, 2 HAVING count(*) >= 20), r AS (SELECT var1, var2, idx, y - a - b * x AS r FROM p JOIN l USING (var1, var2)),
d AS (SELECT *, lag(r) OVER w AS level, r - lag(r) OVER w AS d FROM r WINDOW w AS (PARTITION BY var1, var2 ORDER BY idx)), e AS (SELECT *, lag(d) OVER (PARTITION BY var1, var2 ORDER BY idx) AS z FROM d), f AS (SELECT * FROM e WHERE z IS NOT NULL),
m AS (SELECT var1, var2, count(*) AS k, regr_slope(d, z) AS bd, regr_intercept(d, z) AS ad, regr_slope(level, z) AS bl, regr_intercept(level, z) AS al FROM f GROUP BY 1, 2),
g AS (SELECT var1, var2, k, d - ad - bd * z AS u, level - al - bl * z AS v FROM f JOIN m USING (var1, var2)), h AS (SELECT var1, var2, k, sum(u * v) / sum(v * v) AS t, sum(v * v) AS vv, sum(u * u) AS uu FROM g GROUP BY 1, 2, 3),
q AS (SELECT var1, var2, t / sqrt((uu - t * t * vv) / (k - 3) / vv) AS stat FROM h) SELECT var1, var2, round(b, 6) AS beta, round(a, 6) AS intercept, round(stat, 6) AS statistic, stat < -3.34 AS is_cointegrated FROM q JOIN l USING (var1, var2)"""
