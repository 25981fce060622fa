"""A corpus of formulas of the usual kinds, made from rules: it exercises every function of the language in one plan."""

from __future__ import annotations

from itertools import product

WINDOWS = (3, 6, 12)
_BY_WINDOW = {
    "mom": "close / ts_delay(close, {w}) - 1",
    "ma_gap": "close / ts_mean(close, {w}) - 1",
    "vol_gap": "vol / ts_mean(vol, {w}) - 1",
    "std": "ts_std(close, {w}) / close",
    "hi": "ts_max(high, {w}) / close - 1",
    "lo": "ts_min(low, {w}) / close - 1",
    "rank": "ts_rank(close, {w})",
    "argmax": "ts_argmax(high, {w}) / {w}",
    "argmin": "ts_argmin(low, {w}) / {w}",
    "lowday": "lowday(low, {w}) / {w}",
    "highday": "highday(high, {w}) / {w}",
    "pvcorr": "corr(close, log(vol), {w})",
    "pvcov": "cov(close, vol, {w}) / (close * vol)",
    "wma": "wma(close, {w}) / close - 1",
    "decay": "decay_linear(close, {w}) / close - 1",
    "quant": "ts_quantile(close, {w}, 0.8) / close - 1",
    "slope": "ts_slope(close, {w}) / close",
    "rsq": "ts_rsquare(close, {w})",
    "resi": "ts_resi(close, {w}) / close",
    "prod": "ts_product(1 + min(max(returns(close), -0.5), 0.5), {w})",
    "csmom": "-cs_rank(ts_delta(close, {w})) * cs_rank(ts_std(vol, {w}))",
    "cond": "if(close - ts_mean(close, {w}), ts_sum(vol, {w}), -ts_count(vol, {w}))",
    "corr_rank": "-corr(cs_rank(close), cs_rank(vol), {w})",
}
_PLAIN = {
    "body": "(close - open) / (high - low)",
    "spread": "(high - low) / close",
    "vwap_gap": "vwap / close - 1",
    "sign_move": "sign(ts_delta(vol, 1)) * -ts_delta(close, 1)",
    "pow": "power(close / vwap, 2) - sqrt(abs(open / close))",
    "ema_gap": "close / ema(close, 12, 2) - 1",
    "ques": "quesval(0.1, returns(close), 1, -1) + quesval2(close, open, 1, 0)",
    "compare": "gt(close, open) + ge(high, close) - lt(low, open) - le(low, close) + eq(close, open) + ne(close, vwap)",
    "neutral": "cap_neu(zscore(winsor(close / ts_mean(close, 6))), cap)",
    "scaled": "cs_scale(log10(vol)) - to_percentiles(amount)",
    "cut": "qcut(vol, 5) + zscore_rows(vol) + zscore_cols(vol)",
    "cum": "cumsum(vol) / ts_sum(vol, 0)",
}
FORMULAS = {f"{k}_{w}": f.format(w=w) for (k, f), w in product(_BY_WINDOW.items(), WINDOWS)} | _PLAIN
