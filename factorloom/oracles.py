"""DuckDB SQL for the engine's queries. FORMULAS pairs a formula with an expression over the same bars."""

from __future__ import annotations


def bars_sql(period: str) -> str:
    return f"""bars0 AS (
  SELECT l_suppkey AS symbol, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS trading_date,
    avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount, CAST(count(*) AS DOUBLE) AS y
  FROM lineitem GROUP BY 1, 2),
bars AS (SELECT *, CASE WHEN vol % 7 <> 0 THEN vol END AS x, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) AS rn FROM bars0)"""


INTRADAY = """ibars AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS trading_date, CAST(floor((extract(hour FROM ts) * 60 + extract(minute FROM ts)) / 5) AS INTEGER) AS bar,
    avg(value) AS close, min(value) AS low, max(value) AS high, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS vol
  FROM events GROUP BY 1, 2, 3)"""


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


S = "OVER (PARTITION BY symbol ORDER BY trading_date)"
D = "OVER (PARTITION BY trading_date)"


def corr(n: int) -> str:
    a, b = "(CASE WHEN y IS NOT NULL THEN x END)", "(CASE WHEN x IS NOT NULL THEN y END)"
    den = f"count({a}) {w(n)} * sqrt(var_pop({a}) {w(n)} * var_pop({b}) {w(n)})"
    return f"CASE WHEN count({a}) {w(n)} >= 2 AND {den} > 1e-10 THEN covar_pop({a}, {b}) {w(n)} * count({a}) {w(n)} / ({den}) END"


RANK0 = "CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY trading_date ORDER BY x NULLS LAST) - 1 + (count(*) OVER (PARTITION BY trading_date, x) - 1) / 2.0 END"
#: name -> (formula, SQL over bars; {l} stands for the list of the window's x)
FORMULAS: dict[str, tuple[str, str]] = {
    "el_div": ("(x - y) / (y - 3)", "CASE WHEN abs(y - 3) >= 1e-10 THEN (x - y) / (y - 3) END"),
    "el_arith": ("-(x + 2 * y - 7) * 0.5", "-(x + 2 * y - 7) * 0.5"),
    "el_log": ("log(x - 20) + log10(y)", "CASE WHEN x - 20 > 0 THEN ln(x - 20) END + log10(y)"),
    "el_power": ("power(y, 0.5) + power(y, -1) + sqrt(x - 30)", "pow(y, 0.5) + pow(y, -1) + CASE WHEN x - 30 >= 0 THEN sqrt(x - 30) END"),
    "el_abs_sign": ("abs(x - 40) * sign(x - 40) + sign(x)", "abs(x - 40) * sign(x - 40) + CASE WHEN x > 0 THEN 1 ELSE 0 END"),
    "el_minmax": ("min(x, y) + max(x, 50)", "least(x, y) + greatest(x, 50)"),
    "el_cond": ("if(x - 40, x, y) + quesval(45, x, 1, 2) + quesval2(x, y, 3, 4)", "CASE WHEN x - 40 > 0 THEN x ELSE y END + CASE WHEN x > 45 THEN 1 ELSE 2 END + CASE WHEN x > y THEN 3 ELSE 4 END"),
    "el_compare": (
        "gt(x, 40) + 2 * lt(x, 40) + 4 * ge(x, y) + 8 * le(x, y)",
        "CASE WHEN x > 40 THEN 1 ELSE 0 END + CASE WHEN x < 40 THEN 2 ELSE 0 END + CASE WHEN x >= y THEN 4 ELSE 0 END + CASE WHEN x <= y THEN 8 ELSE 0 END",
    ),
    "el_eq": ("eq(y, 3) + 2 * ne(x, 40)", "CASE WHEN abs(y - 3) < 1e-10 THEN 1 ELSE 0 END + CASE WHEN abs(x - 40) >= 1e-10 THEN 2 ELSE 0 END"),
    "el_logic": ("and(x, y - 3) + 2 * or(y - 3, 0) + 4 * not(y - 3) + mod(y, 4)", "CASE WHEN x <> 0 AND y - 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN y - 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN y - 3 = 0 THEN 4 ELSE 0 END + y % 4"),
    "el_exp": ("exp(-y / 10)", "exp(-y / 10)"),
    "total": ("total(x)", "sum(x) OVER ()"),
    "returns": ("returns(y)", f"CASE WHEN lag(y) {S} = 0 THEN 0 ELSE y / lag(y) {S} - 1 END"),
    "ts_mean": ("ts_mean(x, 5)", f"avg(x) {w(5)}"),
    "ts_sum": ("ts_sum(x, 4)", f"coalesce(sum(x) {w(4)}, 0)"),
    "ts_cumsum": ("ts_sum(x, 0)", f"coalesce(sum(x) OVER (PARTITION BY symbol ORDER BY trading_date ROWS UNBOUNDED PRECEDING), 0)"),  # noqa: F541
    "ts_count": ("ts_count(x, 6)", f"count(x) {w(6)}"),
    "ts_max": ("ts_max(x, 5)", f"max(x) {w(5)}"),
    "ts_min": ("ts_min(x, 5)", f"min(x) {w(5)}"),
    "ts_std": ("ts_std(x, 5)", f"CASE WHEN count(x) {w(5)} >= 2 THEN stddev_pop(x) {w(5)} END"),
    "ts_rank": ("ts_rank(x, 5)", "CASE WHEN x IS NOT NULL THEN CAST(len(list_filter({l}, lambda v: v < x)) AS DOUBLE) / len({l}) ELSE 0 END"),
    "ts_argmax": ("ts_argmax(x, 5)", "CASE WHEN list_max({l}) IS NOT NULL THEN len({l}) - list_position({l}, list_max({l})) + 1 END"),
    "ts_argmin": ("ts_argmin(x, 5)", "CASE WHEN list_min({l}) IS NOT NULL THEN len({l}) - list_position({l}, list_min({l})) + 1 END"),
    "ts_lowday": ("lowday(x, 5)", "CASE WHEN list_min({l}) IS NOT NULL THEN len({l}) - list_position({l}, list_min({l})) END"),
    "ts_highday": ("highday(x, 5)", "CASE WHEN list_max({l}) IS NOT NULL THEN list_position(list_reverse({l}), list_max({l})) - 1 END"),
    "ts_corr": ("corr(x, y, 6)", corr(6)),
    "ts_cov": ("cov(x, y, 6)", f"CASE WHEN count(CASE WHEN y IS NOT NULL THEN x END) {w(6)} >= 2 THEN covar_samp(x, y) {w(6)} END"),
    "ts_wma": ("wma(x, 5)", "list_sum(list_transform({l}, lambda v, i: v * pow(0.9, len({l}) - i))) / list_sum(list_transform({l}, lambda v, i: CASE WHEN v IS NOT NULL THEN pow(0.9, len({l}) - i) END))"),
    "ts_product": ("ts_product(y, 4)", f"product(y) {w(4)}"),
    "ts_decay": ("decay_linear(x, 5)", "list_sum(list_transform({l}, lambda v, i: v * i)) / list_sum(list_transform({l}, lambda v, i: CASE WHEN v IS NOT NULL THEN i END))"),
    "ts_delay": ("delay(x, 2)", f"lag(x, 2) {S}"),
    "ts_delta": ("delta(x, 3)", f"x - lag(x, 3) {S}"),
    "ts_quantile": ("ts_quantile(x, 5, 0.3)", f"quantile_cont(x, 0.3) {w(5)}"),
    "ts_slope": ("ts_slope(x, 5)", f"CASE WHEN count(x) {w(5)} >= 2 THEN regr_slope(x, rn) {w(5)} END"),
    "ts_rsq": (
        "ts_rsquare(x, 5)",
        f"CASE WHEN count(*) {w(5)} < 2 THEN 0 WHEN count(x) {w(5)} = count(*) {w(5)} AND count(x) {w(5)} * var_pop(x) {w(5)} > 1e-12 THEN regr_r2(x, rn) {w(5)} END",
    ),
    "ts_resi": ("ts_resi(x, 5)", f"CASE WHEN x IS NOT NULL AND count(x) {w(5)} >= 2 THEN x - regr_intercept(x, rn) {w(5)} - regr_slope(x, rn) {w(5)} * rn END"),
    "ts_nested": ("ts_mean(ts_delta(y, 1), 4) - ts_max(ts_mean(y, 3), 5)", "NESTED"),
    "ts_ema": ("ema(x, 5, 2)", "EMA"),
    "cs_rank": ("cs_rank(x)", f"({RANK0}) / count(x) {D}"),
    "cs_scale": ("cs_scale(x)", f"CASE WHEN count(x) {D} >= 2 AND stddev_pop(x) {D} >= 1e-10 THEN (x - avg(x) {D}) / stddev_pop(x) {D} END"),
    "cs_winsor": ("winsor(x)", f"CASE WHEN x IS NOT NULL THEN least(greatest(x, avg(x) {D} - 3 * coalesce(stddev_samp(x) {D}, 0)), avg(x) {D} + 3 * coalesce(stddev_samp(x) {D}, 0)) END"),
    "cs_zscore": ("zscore(x)", f"CASE WHEN stddev_samp(x) {D} >= 1e-10 THEN (x - avg(x) {D}) / stddev_samp(x) {D} END"),
    "cs_qcut": ("qcut(x, 5)", f"CASE WHEN x IS NOT NULL THEN least(4, floor(({RANK0}) / count(x) {D} * 5)) END"),
    "cs_percentile": ("to_percentiles(x)", f"CASE WHEN count(x) {D} > 1 THEN ({RANK0}) / (count(x) {D} - 1) WHEN x IS NOT NULL THEN 0 END"),
    "cs_zrows": ("zscore_rows(x)", f"CASE WHEN x IS NOT NULL AND count(x) {D} >= 2 THEN CASE WHEN stddev_samp(x) {D} < 1e-15 THEN 0 ELSE (x - avg(x) {D}) / stddev_samp(x) {D} END END"),
    "cs_capneu": ("cap_neu(x, y)", "CAPNEU"),
}
INTRADAY_FORMULAS: dict[str, tuple[str, str]] = {
    "grp_sum": ("1d:sum(5m:vol)", "sum(vol)"),
    "grp_mean": ("1d:mean(5m:vol)", "avg(vol)"),
    "grp_count": ("1d:count(5m:vol)", "count(*)"),
    "grp_minmax": ("1d:max(5m:vol) - 1d:min(5m:vol)", "max(vol) - min(vol)"),
    "grp_std": ("1d:std(5m:vol)", "CASE WHEN count(vol) >= 2 THEN stddev_samp(vol) END"),
    "grp_var": ("1d:var(5m:vol)", "CASE WHEN count(vol) >= 2 THEN var_samp(vol) END"),
    "grp_product": ("log(1d:product(5m:vol + 1))", "ln(product(vol + 1))"),
    "grp_wcr": ("1d:sum(5m:vol * 5m:close) / 1d:sum(5m:vol) / 1d:mean(5m:close)", "CASE WHEN abs(sum(vol)) >= 1e-10 AND abs(avg(close)) >= 1e-10 THEN sum(vol * close) / sum(vol) / avg(close) END"),
}


def rnd(c: str, digits: int = 8) -> str:
    return f"round(CAST({c} AS DOUBLE), {digits}) + 0.0"


def formula_sql(expression: str) -> str:
    head = f"WITH {bars_sql('week')}"
    if expression == "EMA":
        return f"""WITH RECURSIVE {bars_sql('week')},
e AS (
  SELECT symbol, trading_date, rn, x AS v FROM bars WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.trading_date, b.rn, CASE WHEN b.x IS NULL THEN e.v WHEN e.v IS NULL THEN b.x ELSE 0.4 * b.x + 0.6 * e.v END FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT symbol, trading_date, {rnd('v')} AS value FROM e"""
    if expression == "NESTED":
        return f"""{head},
a AS (SELECT *, y - lag(y) {S} AS d, avg(y) {w(3)} AS m FROM bars)
SELECT symbol, trading_date, {rnd(f'avg(d) {w(4)} - max(m) {w(5)}')} AS value FROM a"""
    if expression == "CAPNEU":
        return f"""{head},
{capneu_sql('bars', 'x', 'y')}
SELECT symbol, trading_date, {rnd('neu')} AS value FROM neu"""
    if "{l}" in expression:
        return f"""{head},
l AS (SELECT *, list(x) {w(5)} AS lst FROM bars)
SELECT symbol, trading_date, {rnd(expression.replace('{l}', 'lst'))} AS value FROM l"""
    return f"{head}\nSELECT symbol, trading_date, {rnd(expression)} AS value FROM bars"


def capneu_sql(table: str, x: str, cap: str) -> str:
    return f"""n1 AS (SELECT *, CASE WHEN {cap} > 0 THEN {x} END AS nx, CASE WHEN {cap} > 0 AND {x} IS NOT NULL THEN ln({cap}) END AS nl FROM {table}),
n2 AS (SELECT *, nx - avg(nx) {D} - CASE WHEN var_pop(nl) {D} > 1e-10 THEN covar_pop(nx, nl) {D} / var_pop(nl) {D} ELSE 0 END * (nl - avg(nl) {D}) AS ne, count(nl) {D} AS nn FROM n1),
neu AS (SELECT *, CASE WHEN nn < 10 OR stddev_pop(ne) {D} <= 1e-10 OR stddev_pop(ne) {D} IS NULL THEN {x} ELSE (ne - avg(ne) {D}) / stddev_pop(ne) {D} END AS neu FROM n2)"""


def intraday_sql(expression: str) -> str:
    return f"WITH {INTRADAY}\nSELECT symbol, trading_date, {rnd(expression)} AS value FROM ibars GROUP BY symbol, trading_date"


WEEK, MONTH = bars_sql("week"), bars_sql("month")
GRID = """dates AS (SELECT DISTINCT trading_date FROM bars),
grid0 AS (SELECT s.symbol, d.trading_date, b.y, b.vol, b.rn FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN dates d LEFT JOIN bars b USING (symbol, trading_date)),
grid1 AS (SELECT *, first_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM grid0),
grid AS (SELECT symbol, trading_date, close, rn IS NOT NULL AS present, coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY trading_date) / close - 1, 0) AS fwd_ret FROM grid1)"""
PANEL = """panel AS (SELECT 'vol' AS factor, trading_date, symbol, x AS value FROM bars UNION ALL SELECT 'trades', trading_date, symbol, y FROM bars),
ranked AS (SELECT *, count(value) OVER (PARTITION BY factor, trading_date) AS n,
  rank() OVER (PARTITION BY factor, trading_date ORDER BY value NULLS LAST) - 1 + (count(*) OVER (PARTITION BY factor, trading_date, value) - 1) / 2.0 AS r0 FROM panel),
labelled AS (SELECT factor, trading_date, symbol, value, CAST(CASE WHEN value IS NOT NULL AND n >= 5 THEN least(5, floor(r0 * 5 / n) + 1) ELSE 0 END AS INTEGER) AS label FROM ranked)"""
BASE = f"WITH {MONTH},\n{GRID},\n{PANEL},\njoined AS (SELECT l.*, g.fwd_ret, g.present AS tradable FROM labelled l JOIN grid g USING (trading_date, symbol))"
WIDE = f"WITH {MONTH},\n{GRID},\nwide AS (SELECT b.symbol, b.trading_date, b.x AS a, b.y AS b, g.fwd_ret FROM bars b JOIN grid g USING (symbol, trading_date)),\nsig AS (SELECT *, a - 40 AS signal FROM wide)"


def pear(a: str, b: str, least: int = 2, flat: str = "0") -> str:
    ok = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    x, y = f"(CASE WHEN {ok} THEN {a} END)", f"(CASE WHEN {ok} THEN {b} END)"
    return f"CASE WHEN count({x}) >= {least} THEN CASE WHEN sqrt(var_pop({x}) * var_pop({y})) > 1e-15 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) ELSE {flat} END END"


IC = f"ic AS (SELECT factor, trading_date, {pear('value', 'fwd_ret')} AS ic FROM joined GROUP BY 1, 2 HAVING trading_date < (SELECT max(trading_date) FROM joined))"
PASSIVE = "passive AS (SELECT trading_date, coalesce(avg(CASE WHEN present THEN fwd_ret END), 0) AS passive_ret FROM grid GROUP BY 1),\nser AS (SELECT trading_date, passive_ret / 10 AS ret FROM passive)"
SER = f"WITH {MONTH},\n{GRID},\n{PASSIVE}"
def each(expr: str) -> str:
    """A list over the places of a portfolio's symbols."""
    return f"list_transform(range(1, len(sh) + 1), lambda i: {expr})"


#: Net asset values by recursion over dates: shares of each group as a list in the order of symbols.
NAVS = f"""days AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS k FROM dates),
wt AS (SELECT factor, trading_date, symbol, label, CASE WHEN label > 0 THEN 0.2 / count(*) OVER (PARTITION BY factor, trading_date, label) ELSE 0 END AS weight FROM labelled),
cells AS (
  SELECT f.factor, d.k, d.trading_date, list(coalesce(w.label, 0) ORDER BY g.symbol) AS lab, list(CAST(coalesce(w.weight, 0) AS DOUBLE) ORDER BY g.symbol) AS wei, list(g.rn IS NOT NULL ORDER BY g.symbol) AS can,
    list(CAST(coalesce(g.y, 0) AS DOUBLE) ORDER BY g.symbol) AS op, list(CAST(coalesce(g.close, 0) AS DOUBLE) ORDER BY g.symbol) AS cl, list(CASE WHEN g.vol > 0 THEN CAST(coalesce(g.y, 0) AS DOUBLE) ELSE 0 END ORDER BY g.symbol) AS vw
  FROM grid1 g JOIN days d USING (trading_date) CROSS JOIN (SELECT DISTINCT factor FROM panel) f LEFT JOIN wt w ON w.factor = f.factor AND w.trading_date = g.trading_date AND w.symbol = g.symbol
  GROUP BY f.factor, d.k, d.trading_date),
st AS (
  SELECT factor, grp, k, list_transform(lab, lambda x: CAST(0 AS DOUBLE)) AS sh, CAST(1 AS DOUBLE) AS nv, CAST(NULL AS DOUBLE) AS ret FROM cells, (SELECT unnest(range(1, 6)) AS grp) WHERE k = 1
  UNION ALL
  SELECT factor, grp, k, held, now, now / nv - 1 FROM (
    SELECT factor, grp, k, held, nv, CASE WHEN cnt = 0 AND list_sum({each('abs(sh[i])')}) = 0 THEN nv ELSE greatest(list_sum({each('held[i] * cl[i]')}) - fee, 0) END AS now FROM (
      SELECT *, CASE WHEN cnt = 0 THEN sh ELSE bought END AS held,
        CASE WHEN cnt = 0 THEN 0 ELSE list_sum({each('CASE WHEN abs(bought[i] - sh[i]) > 1e-15 THEN abs(bought[i] - sh[i]) * CASE WHEN bought[i] > sh[i] THEN 0.0015 ELSE 0.0025 END * vw[i] ELSE 0 END')}) END AS fee FROM (
        SELECT *, {each('CASE WHEN pool[i] THEN CASE WHEN op[i] > 0 THEN CASE WHEN wei[i] > 0 THEN wei[i] / total ELSE 1.0 / cnt END * cash / op[i] ELSE 0 END WHEN can[i] THEN 0 ELSE sh[i] END')} AS bought FROM (
          SELECT *, CASE WHEN sold <= 0 THEN nv ELSE sold END AS cash, CASE WHEN told = 0 THEN cnt ELSE told END AS total FROM (
            SELECT *, list_sum({each('CASE WHEN pool[i] THEN 1 ELSE 0 END')}) AS cnt, list_sum({each('CASE WHEN can[i] AND sh[i] <> 0 THEN sh[i] * op[i] ELSE 0 END')}) AS sold, list_sum({each('CASE WHEN pool[i] THEN wei[i] ELSE 0 END')}) AS told FROM (
              SELECT s.factor, s.grp, t.k, s.sh, s.nv, t.can, t.op, t.cl, t.vw, b.wei, list_transform(range(1, len(s.sh) + 1), lambda i: t.can[i] AND b.lab[i] = s.grp) AS pool
              FROM st s JOIN cells t ON t.factor = s.factor AND t.k = s.k + 1 JOIN cells b ON b.factor = s.factor AND b.k = s.k))))))),
navs AS (SELECT st.factor, d.trading_date, CAST(st.grp AS INTEGER) AS grp, st.ret, st.nv FROM st JOIN days d USING (k) WHERE st.k > 1),
ls AS (SELECT factor, trading_date, sum(CASE WHEN grp > 4 THEN ret END) AS long_ret, -sum(CASE WHEN grp <= 1 THEN ret END) AS short_ret, sum(CASE WHEN grp > 4 THEN ret END) - sum(CASE WHEN grp <= 1 THEN ret END) AS ls_ret FROM navs GROUP BY 1, 2)"""
TRADED = f"{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{NAVS}"
NV = "nv AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS nv FROM ser)"
PEAK = f"{NV},\npk AS (SELECT *, greatest(1.0, max(nv) OVER (ORDER BY trading_date ROWS UNBOUNDED PRECEDING)) AS peak FROM nv),\ndd AS (SELECT *, (peak - nv) / peak AS drawdown FROM pk)"
LOGSUM = "sum(CASE WHEN ret > -1 THEN ln(1 + ret) ELSE 0 END)"
Z = "CASE WHEN {c} IS NOT NULL AND count({c}) OVER d >= 2 THEN CASE WHEN stddev_samp({c}) OVER d < 1e-15 THEN 0 ELSE ({c} - avg({c}) OVER d) / stddev_samp({c}) OVER d END END"


def pct(c: str) -> str:
    r0 = f"(rank() OVER (PARTITION BY trading_date ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY trading_date, {c}) - 1) / 2.0)"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER d > 1 THEN {r0} / (count({c}) OVER d - 1) ELSE 0 END"


def mean_of(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE (coalesce({a}, 0) + coalesce({b}, 0)) / (CASE WHEN {a} IS NULL THEN 0 ELSE 1 END + CASE WHEN {b} IS NULL THEN 0 ELSE 1 END) END"


ZS = f"zs AS (SELECT *, {Z.format(c='a')} AS za, {Z.format(c='b')} AS zb FROM wide WINDOW d AS (PARTITION BY trading_date))"


def ic_weighted_sql(ratio: bool) -> str:
    m = [f"avg(i{k}){f' / nullif(stddev_samp(i{k}), 0)' if ratio else ''}" for k in "ab"]
    return f"""{WIDE},
ics AS (SELECT trading_date, {pear('a', 'fwd_ret')} AS ia, {pear('b', 'fwd_ret')} AS ib FROM wide GROUP BY 1),
m AS (SELECT greatest(coalesce({m[0]}, 0), 0) AS ma, greatest(coalesce({m[1]}, 0), 0) AS mb FROM ics),
wt AS (SELECT CASE WHEN ma + mb > 1e-12 THEN ma / (ma + mb) ELSE 0.5 END AS wa, CASE WHEN ma + mb > 1e-12 THEN mb / (ma + mb) ELSE 0.5 END AS wb FROM m),
{ZS},
q AS (SELECT *, coalesce(za * wa, 0) + coalesce(zb * wb, 0) AS top, CASE WHEN za IS NOT NULL THEN wa ELSE 0 END + CASE WHEN zb IS NOT NULL THEN wb ELSE 0 END AS den FROM zs, wt)
SELECT symbol, trading_date, {rnd('CASE WHEN abs(den) > 1e-12 THEN top / den END')} AS signal FROM q"""


def brinson_sql(total: bool) -> str:
    return f"""{WIDE},
hold AS (SELECT symbol, sum(b) AS hold, avg(fwd_ret) AS ret FROM wide GROUP BY 1),
sec AS (SELECT s_suppkey AS symbol, r_name AS sector, greatest(s_acctbal, 0) / (SELECT sum(greatest(s_acctbal, 0)) FROM supplier) AS wb FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rows_ AS (SELECT sector, hold / (SELECT sum(hold) FROM hold JOIN sec USING (symbol)) AS wp, wb, ret FROM hold JOIN sec USING (symbol)),
s0 AS (SELECT sector, sum(wp) AS wp, sum(wb) AS wb, sum(wp * ret) AS p, sum(wb * ret) AS q FROM rows_ GROUP BY 1),
s AS (SELECT *, CASE WHEN wp <> 0 THEN p / wp ELSE 0 END AS rp, CASE WHEN wb <> 0 THEN q / wb ELSE 0 END AS rb, {'sum(q) OVER ()' if total else '0'} AS base FROM s0)
SELECT sector, {rnd('(wp - wb) * (rb - base)')} AS allocation, {rnd('wb * (rp - rb)')} AS selection, {rnd('(wp - wb) * (rp - rb)')} AS interaction FROM s"""


R0SIG = "(rank() OVER (PARTITION BY trading_date ORDER BY signal NULLS LAST) - 1 + (count(*) OVER (PARTITION BY trading_date, signal) - 1) / 2.0)"
PROP = "prop AS (SELECT *, CASE WHEN sum(greatest(signal, 0)) OVER d <> 0 THEN CASE WHEN signal IS NOT NULL THEN greatest(signal, 0) ELSE 0 END / sum(CASE WHEN signal IS NOT NULL THEN greatest(signal, 0) END) OVER d END AS weight FROM sig WINDOW d AS (PARTITION BY trading_date))"
TOP = "row_number() OVER (PARTITION BY trading_date ORDER BY signal DESC NULLS LAST, symbol)"
LOW = "row_number() OVER (PARTITION BY trading_date ORDER BY signal ASC NULLS LAST, symbol)"
N = "count(signal) OVER (PARTITION BY trading_date)"

ORACLES: dict[str, str] = {k: formula_sql(e) for k, (_, e) in FORMULAS.items()} | {k: intraday_sql(e) for k, (_, e) in INTRADAY_FORMULAS.items()}
ORACLES |= {
    "slice_momentum_quantiles": f"""WITH {WEEK},
{GRID},
m AS (SELECT *, CASE WHEN abs(lag(y) {S}) >= 1e-10 THEN y / lag(y) {S} - 1 END AS mom FROM bars),
z AS (SELECT symbol, trading_date, CASE WHEN stddev_samp(mom) {D} >= 1e-10 THEN (mom - avg(mom) {D}) / stddev_samp(mom) {D} END AS x FROM m),
q AS (SELECT symbol, trading_date, CASE WHEN x IS NOT NULL THEN CAST(least(4, floor(({RANK0}) / count(x) {D} * 5)) AS INTEGER) END AS q FROM z)
SELECT trading_date, q, count(*) AS n, {rnd('avg(fwd_ret)', 4)} AS mean_ret FROM q JOIN grid USING (symbol, trading_date) WHERE q IS NOT NULL GROUP BY 1, 2""",
    "cs_pipeline": f"""WITH {WEEK},
c AS (SELECT symbol, trading_date, x, y * 100 AS cap, count(*) {D} AS nrows FROM bars),
wi AS (SELECT *, CASE WHEN nrows >= 2 AND x IS NOT NULL THEN least(greatest(x, avg(x) {D} - 3 * coalesce(stddev_samp(x) {D}, 0)), avg(x) {D} + 3 * coalesce(stddev_samp(x) {D}, 0)) END AS winsored FROM c),
zs AS (SELECT *, CASE WHEN nrows >= 2 AND stddev_samp(winsored) {D} >= 1e-10 THEN (winsored - avg(winsored) {D}) / stddev_samp(winsored) {D} END AS zscored FROM wi),
{capneu_sql('zs', 'zscored', 'cap')}
SELECT symbol, trading_date, {rnd('winsored')} AS winsored, {rnd('zscored')} AS zscored, {rnd('CASE WHEN nrows >= 2 THEN neu END', 4)} AS cap_neued FROM neu""",
    "price_matrix": f"""WITH {WEEK},
{GRID}
SELECT g.symbol, g.trading_date, g.close, {rnd('g.fwd_ret')} AS fwd_ret, coalesce(b.high > b.low, false) AS tradable FROM grid g LEFT JOIN bars b USING (symbol, trading_date)""",
    "flt_prefilter": f"WITH {MONTH} SELECT symbol, trading_date, vol, y FROM bars WHERE trading_date BETWEEN '1996-01-01' AND '1997-12-31' AND CAST(symbol AS VARCHAR) LIKE '1%' AND CAST(symbol AS VARCHAR) NOT LIKE '%7' AND vol > 100 AND y >= 3",
    "flt_query": f"WITH {MONTH} SELECT symbol, trading_date, vol, y FROM bars WHERE symbol IN (1, 2, 3, 5) AND trading_date BETWEEN '1996-01-01' AND '1997-12-31' AND (vol > 200 OR y < 5)",
    "meta_symbols": f"WITH {WEEK} SELECT DISTINCT symbol FROM bars",
    "meta_date_range": f"WITH {WEEK} SELECT min(trading_date) AS first_date, max(trading_date) AS last_date, count(*) AS n_rows FROM bars",
    "ohlcv_rollup": f"WITH {INTRADAY} SELECT symbol, trading_date, {rnd('arg_min(close, bar)')} AS open, {rnd('max(high)')} AS high, {rnd('min(low)')} AS low, {rnd('arg_max(close, bar)')} AS close, {rnd('sum(vol)')} AS vol FROM ibars GROUP BY 1, 2",
    "grp_expand": f"""WITH {INTRADAY}
SELECT symbol, trading_date, bar, {rnd('sum(vol) OVER g')} AS vol_sum, {rnd('avg(vol) OVER g')} AS vol_mean, {rnd('count(*) OVER g')} AS vol_count, {rnd('min(vol) OVER g')} AS vol_min, {rnd('max(vol) OVER g')} AS vol_max,
  {rnd('CASE WHEN count(vol) OVER g >= 2 THEN stddev_samp(vol) OVER g END')} AS vol_std, {rnd('CASE WHEN count(vol) OVER g >= 2 THEN var_samp(vol) OVER g END')} AS vol_var
FROM ibars WINDOW g AS (PARTITION BY symbol, trading_date)""",
    "cap_join": f"WITH {MONTH} SELECT symbol, trading_date, x, CASE WHEN y > 3 THEN y * 100 END AS cap FROM bars",
    "bt_groups": f"{BASE} SELECT factor, trading_date, symbol, label FROM labelled",
    "bt_weights": f"""{BASE}
SELECT factor, trading_date, symbol, {rnd('CASE WHEN label > 0 THEN 0.2 / count(*) OVER g ELSE 0 END')} AS equal,
  {rnd('CASE WHEN label > 0 THEN CASE WHEN sum(value) OVER g <> 0 THEN value / sum(value) OVER g ELSE 0 END ELSE 0 END')} AS weighted
FROM labelled WINDOW g AS (PARTITION BY factor, trading_date, label)""",
    "bt_nav": f"{TRADED} SELECT factor, trading_date, grp, {rnd('ret')} AS ret, {rnd('nv')} AS nv FROM navs",
    "bt_longshort": f"{TRADED} SELECT factor, trading_date, {rnd('long_ret')} AS long_ret, {rnd('short_ret')} AS short_ret, {rnd('ls_ret')} AS ls_ret FROM ls",
    "bt_passive": f"{SER} SELECT trading_date, {rnd('passive_ret')} AS passive_ret FROM passive",
    "bt_ic": f"{BASE},\n{IC} SELECT factor, trading_date, {rnd('ic')} AS ic FROM ic",
    "bt_ic_next": f"""{BASE},
nx AS (SELECT *, lead(fwd_ret) OVER (PARTITION BY factor, symbol ORDER BY trading_date) AS nret FROM joined)
SELECT factor, trading_date, {rnd(pear('value', 'nret'))} AS ic FROM nx GROUP BY 1, 2""",
    "bt_group_ic": f"""{BASE}
SELECT factor, trading_date, {rnd(pear('CASE WHEN label > 4 THEN value END', 'fwd_ret'))} AS long_ic, {rnd(pear('CASE WHEN label = 1 THEN value END', 'fwd_ret'))} AS short_ic, {rnd(pear('CASE WHEN label > 4 OR label = 1 THEN value END', 'fwd_ret'))} AS both_ic
FROM joined GROUP BY 1, 2""",
    "bt_ic_stats": f"{BASE},\n{IC} SELECT factor, {rnd('avg(ic)')} AS ic_mean, {rnd('stddev_samp(ic)')} AS ic_std, {rnd('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ic_ir, count(ic) AS n_days FROM ic GROUP BY 1",
    "bt_turnover": f"""{BASE},
l AS (SELECT *, lag(label) OVER s AS b, CASE WHEN label > 0 THEN 0.2 / count(*) OVER (PARTITION BY factor, trading_date, label) ELSE 0 END AS weight FROM labelled WINDOW s AS (PARTITION BY factor, symbol ORDER BY trading_date)),
l2 AS (SELECT *, lag(weight) OVER (PARTITION BY factor, symbol ORDER BY trading_date) AS wb FROM l),
t AS (SELECT factor, avg(CASE WHEN label <> b THEN 1.0 ELSE 0.0 END) AS turnover FROM l WHERE b IS NOT NULL GROUP BY 1),
d AS (SELECT factor, trading_date, sum(abs(weight - wb)) / 2 AS t FROM l2 WHERE wb IS NOT NULL GROUP BY 1, 2)
SELECT t.factor, {rnd('any_value(turnover)')} AS turnover, {rnd('avg(d.t)')} AS weight_turnover FROM t JOIN d ON t.factor = d.factor GROUP BY 1""",
    "bt_metrics": f"""{TRADED},
lr AS (SELECT factor, trading_date, round(ls_ret, 10) AS ls_ret FROM ls),
nv AS (SELECT factor, trading_date, ls_ret AS ret, product(1 + coalesce(ls_ret, 0)) OVER (PARTITION BY factor ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS nv FROM lr),
pk AS (SELECT *, greatest(1.0, max(nv) OVER (PARTITION BY factor ORDER BY trading_date ROWS UNBOUNDED PRECEDING)) AS peak FROM nv),
a AS (SELECT factor, exp({LOGSUM}) - 1 AS total, count(*) AS n, stddev_samp(ret) AS s, avg(ret) AS m, max((peak - nv) / peak) AS mdd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win FROM pk GROUP BY factor)
SELECT factor, {rnd('total')} AS total_return, {rnd('pow(1 + total, 252.0 / n) - 1')} AS annual_return, {rnd('s * sqrt(252)')} AS volatility, {rnd('CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END')} AS sharpe,
  {rnd('mdd')} AS max_drawdown, {rnd('win')} AS win_rate, {rnd('CASE WHEN mdd > 0 THEN (pow(1 + total, 252.0 / n) - 1) / mdd END')} AS calmar FROM a""",
    "bt_cumulative": f"""{SER},
{NV}
SELECT trading_date, {rnd('exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) ELSE 0 END) OVER (ORDER BY trading_date ROWS UNBOUNDED PRECEDING)) - 1')} AS cum, {rnd('nv')} AS nv FROM nv""",
    "bt_positions": f"{BASE} SELECT factor, trading_date, symbol, CASE WHEN label > 4 THEN 1.0 WHEN label = 1 THEN -1.0 ELSE 0.0 END AS position FROM labelled",
    "bt_multi": f"{BASE} SELECT trading_date, symbol, {rnd('sum(coalesce(value, 0)) / 2')} AS value FROM panel GROUP BY 1, 2",
    "st_equal": f"{WIDE} SELECT symbol, trading_date, {rnd(mean_of('a', 'b'))} AS signal FROM wide",
    "st_rankavg": f"{WIDE},\np AS (SELECT *, {pct('a')} AS pa, {pct('b')} AS pb FROM wide WINDOW d AS (PARTITION BY trading_date)) SELECT symbol, trading_date, {rnd(mean_of('pa', 'pb') + ' - 0.5')} AS signal FROM p",
    "st_signal": f"""{WIDE},
{ZS}
SELECT symbol, trading_date, {rnd('CASE WHEN coalesce(abs(za), 0) + coalesce(abs(zb), 0) > 1e-12 THEN (coalesce(za * abs(za), 0) + coalesce(zb * abs(zb), 0)) / (coalesce(abs(za), 0) + coalesce(abs(zb), 0)) WHEN za IS NOT NULL OR zb IS NOT NULL THEN 0 END')} AS signal FROM zs""",
    "st_icw": ic_weighted_sql(False),
    "st_icir": ic_weighted_sql(True),
    "st_ridge": f"""{WIDE},
m AS (SELECT sum(a * a) + 1.0 + 1e-10 AS aa, sum(a * b) AS ab, sum(b * b) + 1.0 + 1e-10 AS bb, sum(a * fwd_ret) AS ay, sum(b * fwd_ret) AS bw FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND fwd_ret IS NOT NULL)
SELECT symbol, trading_date, {rnd('a * (bb * ay - ab * bw) / (aa * bb - ab * ab) + b * (aa * bw - ab * ay) / (aa * bb - ab * ab)')} AS signal FROM wide, m""",
    "opt_topk": f"{WIDE} SELECT symbol, trading_date, {rnd(f'CASE WHEN signal IS NOT NULL AND {TOP} <= least(10, {N}) THEN 1.0 / least(10, {N}) ELSE 0 END')} AS weight FROM sig",
    "opt_topk_neutral": f"{WIDE} SELECT symbol, trading_date, {rnd(f'CASE WHEN signal IS NULL THEN 0 WHEN {TOP} <= 5 THEN 0.2 WHEN {LOW} <= 5 THEN -0.2 ELSE 0 END')} AS weight FROM sig",
    "opt_signal": f"{WIDE},\n{PROP} SELECT symbol, trading_date, {rnd('weight')} AS weight FROM prop",
    "opt_invvol": f"""{WIDE},
v AS (SELECT *, stddev_samp(fwd_ret) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS v FROM sig),
i AS (SELECT *, CASE WHEN v > 1e-12 THEN 1.0 / v END AS i FROM v)
SELECT symbol, trading_date, {rnd('coalesce(i / sum(i) OVER (PARTITION BY trading_date), 0)')} AS weight FROM i""",
    "alpha_linear": f"{WIDE} SELECT symbol, trading_date, {rnd('signal')} AS alpha FROM sig",
    "alpha_rank": f"{WIDE} SELECT symbol, trading_date, {rnd(f'CASE WHEN signal IS NOT NULL AND {N} > 1 THEN {R0SIG} / ({N} - 1) - 0.5 END')} AS alpha FROM sig",
    "alpha_quantile": f"{WIDE} SELECT symbol, trading_date, {rnd(f'CASE WHEN signal IS NOT NULL THEN least(floor({R0SIG} * 5 / {N}), 4) / 4 * 2 - 1 END')} AS alpha FROM sig",
    "alpha_zscore": f"{WIDE},\nz AS (SELECT *, (signal - avg(signal) {D}) / nullif(stddev_samp(signal) {D}, 0) AS z FROM sig) SELECT symbol, trading_date, {rnd('CASE WHEN z IS NOT NULL THEN greatest(least(z, 3), -3) END')} AS alpha FROM z",
    "alpha_boxcox": f"{WIDE} SELECT symbol, trading_date, {rnd('sign(signal) * (pow(1 + abs(signal), 0.5) - 1) / 0.5')} AS alpha FROM sig",
    "cost_models": f"""{WIDE},
{PROP},
d AS (SELECT *, weight - lag(weight, 1, 0.0) OVER (PARTITION BY symbol ORDER BY trading_date) AS d FROM prop),
c AS (SELECT *, 0.001 * abs(d) AS lin, CASE WHEN b > 0 THEN 0.1 * sqrt(abs(d) / b) * abs(d) ELSE 0 END AS imp FROM d)
SELECT symbol, trading_date, {rnd('0', 9)} AS none, {rnd('lin', 9)} AS linear, {rnd('imp', 9)} AS quadratic, {rnd('lin + imp', 9)} AS composite FROM c""",
    "risk_portfolio": f"{WIDE},\n{PROP} SELECT trading_date, {rnd('sum(weight * fwd_ret)')} AS ret FROM prop GROUP BY 1",
    "risk_vol": f"{SER} SELECT {rnd('stddev_samp(ret) * sqrt(252)')} AS volatility FROM ser",
    "risk_var": f"{SER} SELECT {rnd('-list_sort(list(ret))[CAST(least(floor(0.05 * count(ret)), count(ret) - 1) AS INTEGER) + 1]')} AS historical, {rnd('-(avg(ret) - 1.6448536269514722 * stddev_samp(ret))')} AS normal FROM ser",
    "risk_cvar": f"""{SER},
v AS (SELECT -list_sort(list(ret))[CAST(least(floor(0.05 * count(ret)), count(ret) - 1) AS INTEGER) + 1] AS var FROM ser)
SELECT {rnd('any_value(var)')} AS var, {rnd('coalesce(-avg(CASE WHEN ret < -var THEN ret END), any_value(var))')} AS cvar FROM ser, v""",
    "risk_dd": f"{SER},\n{PEAK} SELECT trading_date, {rnd('drawdown')} AS drawdown FROM dd",
    "risk_rolling": f"""{SER},
n AS (SELECT *, row_number() OVER (ORDER BY trading_date) - 1 AS i FROM ser),
e AS (SELECT n.*, k AS win FROM n JOIN (SELECT unnest(range(0, 100)) AS k) ON i BETWEEN 3 * k AND 3 * k + 11)
SELECT min(trading_date) AS start, max(trading_date) AS end_date, count(*) AS n, {rnd('stddev_samp(ret) * sqrt(252)')} AS volatility, {rnd('-list_sort(list(ret))[1]')} AS var, {rnd('avg(ret)')} AS mean FROM e GROUP BY win HAVING count(*) = 12""",
    "brinson": brinson_sql(True),
    "brinson_plain": brinson_sql(False),
    "sector_weights": f"SELECT s_suppkey AS symbol, r_name AS sector, {rnd('greatest(s_acctbal, 0) / (SELECT sum(greatest(s_acctbal, 0)) FROM supplier)')} AS bench_weight FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cs_to_percentiles_cols": f"WITH {MONTH} SELECT symbol, trading_date, {rnd('CASE WHEN x IS NOT NULL AND count(x) OVER s >= 2 THEN CASE WHEN stddev_samp(x) OVER s < 1e-15 THEN 0 ELSE (x - avg(x) OVER s) / stddev_samp(x) OVER s END END')} AS value FROM bars WINDOW s AS (PARTITION BY symbol)",
}

#: Student's t with 5 degrees of freedom at 0.05, scaled to the sample's deviation; and the normal density ratio there.
T5, NORMAL_TAIL = -2.015048373333024 * (3 / 5) ** 0.5, 2.0627128075074257
RANKED = """ok AS (SELECT * FROM joined WHERE value IS NOT NULL AND fwd_ret IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY factor, trading_date ORDER BY value) - 1 + (count(*) OVER (PARTITION BY factor, trading_date, value) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY factor, trading_date ORDER BY fwd_ret) - 1 + (count(*) OVER (PARTITION BY factor, trading_date, fwd_ret) - 1) / 2.0 AS rb FROM ok)"""
LAGS = range(1, 5)
ORACLES |= {
    "risk_student": f"{SER} SELECT {rnd(f'-(avg(ret) + {T5!r} * stddev_samp(ret))', 6)} AS student, {rnd(f'-(avg(ret) - {NORMAL_TAIL!r} * stddev_samp(ret))', 6)} AS cvar_normal FROM ser",
    "risk_worst": f"""{SER},
{PEAK},
t AS (SELECT trading_date AS td, peak AS tp, drawdown AS tdd FROM dd ORDER BY drawdown DESC, trading_date LIMIT 1)
SELECT {rnd('any_value(tdd)')} AS max_drawdown, CAST(max(CASE WHEN nv >= tp AND trading_date <= td THEN trading_date END) AS VARCHAR) AS peak_date, CAST(any_value(td) AS VARCHAR) AS trough_date, CAST(min(CASE WHEN nv >= tp AND trading_date > td THEN trading_date END) AS VARCHAR) AS recovery_date FROM dd, t""",
    "risk_barra": f"""{WIDE},
m AS (SELECT trading_date, count(*) AS n, sum(a * a) + 1e-10 AS aa, sum(a * b) AS ab, sum(b * b) + 1e-10 AS bb, sum(a * fwd_ret) AS ay, sum(b * fwd_ret) AS bw, avg(fwd_ret) AS my FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
f AS (SELECT *, (bb * ay - ab * bw) / (aa * bb - ab * ab) AS fa, (aa * bw - ab * ay) / (aa * bb - ab * ab) AS fb FROM m),
e AS (SELECT trading_date, sum(pow(fwd_ret - a * fa - b * fb, 2)) AS rest, sum(pow(fwd_ret - my, 2)) AS total FROM wide JOIN f USING (trading_date) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT trading_date, {rnd('fa', 6)} AS a, {rnd('fb', 6)} AS b, {rnd('CASE WHEN total > 1e-15 THEN 1 - rest / total ELSE 0 END', 6)} AS r2, n FROM f JOIN e USING (trading_date)""",
    "ic_statistics": f"""{BASE},
{RANKED},
daily AS (SELECT factor, trading_date, {pear('ra', 'rb', 3, 'NULL')} AS ric, {pear('value', 'fwd_ret', 3, 'NULL')} AS ic FROM rk GROUP BY 1, 2),
lagged AS (SELECT *, {', '.join(f'lag(ric, {k}) OVER s AS l{k}' for k in LAGS)} FROM daily WHERE ric IS NOT NULL WINDOW s AS (PARTITION BY factor ORDER BY trading_date))
SELECT factor, {rnd('avg(ric)')} AS rank_ic_mean, {rnd('avg(ric) / nullif(stddev_samp(ric), 0)')} AS rank_ic_ir, {rnd('avg(ic)')} AS ic_mean, {rnd('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ic_ir,
  {rnd('avg(ric) / nullif(stddev_samp(ric), 0) * sqrt(count(ric))')} AS t_stat, {rnd('avg(CASE WHEN ric > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ratio, {', '.join(f"{rnd(pear('ric', f'l{k}', 3, 'NULL'))} AS autocorr_{k}" for k in LAGS)}
FROM lagged GROUP BY factor""",
}
