"""Queries that once ran on a few symbols: all symbols and dates of the table take part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom import queries
from factorloom.operators import covariance, optimize, search


@pytest.mark.parametrize("limit", [1000, 4])
@pytest.mark.parametrize("kind", ["risk_parity", "turnover_aware"])
def test_optimisers(spark, sf_dir, monkeypatch, kind, limit):
    monkeypatch.setattr(queries, "PORTFOLIO", limit)
    rows = queries._sig(spark, sf_dir).select("symbol", "trading_date", (F.col("signal") / 1000).alias("signal"), "fwd_ret").toPandas()
    got = queries.QUERIES[f"opt_{kind}"](spark, sf_dir).toPandas()
    of = got.groupby("portfolio")["symbol"].unique()
    assert max(map(len, of)) <= limit and sorted(s for x in of for s in x) == sorted(rows["symbol"].unique())
    for p, symbols in of.items():
        own = rows[rows["symbol"].isin(symbols)]
        s, x = (own.pivot(index="trading_date", columns="symbol", values=c).astype(float) for c in ("signal", "fwd_ret"))
        w = got[got["portfolio"] == p].pivot(index="trading_date", columns="symbol", values="weight")
        assert list(w.index) == list(s.index) and list(w.columns) == list(s.columns)
        before = None
        for day in range(len(s)):
            past = x.to_numpy()[max(0, day - 24) : day]
            cov = covariance.sample(past) if len(past) >= 2 else np.eye(s.shape[1])
            before = optimize.optimise_date(kind, np.nan_to_num(s.to_numpy()[day]), cov + 1e-10 * np.eye(len(cov)), before)
            assert np.allclose(w.to_numpy()[day], before, atol=1e-4)


def test_search(spark, monkeypatch):
    """On a table of more than 40 symbols."""
    sf_dir, seen = "/root/testdata/sf0.01", []

    def spy(bars, returns, *_):
        seen.extend(df.select("symbol").distinct().count() for df in (bars, returns))
        return search.SearchResult(None, [])

    monkeypatch.setattr(search, "search", spy)
    monkeypatch.setattr(spark, "createDataFrame", lambda *_: None, raising=False)
    queries.gp_search(spark, sf_dir)
    all_ = queries.monthly(spark, sf_dir).select("symbol").distinct().count()
    assert seen == [all_, all_] and all_ > 40
