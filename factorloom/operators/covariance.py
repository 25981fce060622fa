"""Covariance estimators on day x asset (or day x factor) matrices; NaN is missing."""

from __future__ import annotations

import numpy as np


def sample(x: np.ndarray, least: int = 2) -> np.ndarray:
    """Pairwise-complete sample covariance; 0 for pairs of fewer than `least` days."""
    ok = np.isfinite(x)
    v, o = np.where(ok, x, 0.0), ok.astype(float)
    n = o.T @ o
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = (v.T @ o) / n  # mean of i over the days of the pair
        cov = ((v.T @ v) - n * mi * mi.T) / (n - 1)
    return np.where(n >= max(least, 2), cov, 0.0)


def ledoit_wolf(x: np.ndarray, target: str = "identity") -> tuple[np.ndarray, float]:
    """Shrinkage towards identity, constant correlation or a single factor, and its intensity in [0, 1]."""
    x = np.where(np.isfinite(x), x, 0.0)
    t, p = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    if target == "identity":
        f = np.eye(p) * np.trace(s) / p
    elif target == "constant_correlation":
        d = np.sqrt(np.maximum(np.diag(s), 1e-300))
        r = s / np.outer(d, d)
        mean = (r.sum() - p) / max(p * (p - 1), 1)
        f = mean * np.outer(d, d)
        np.fill_diagonal(f, np.diag(s))
    elif target == "single_factor":
        val, vec = np.linalg.eigh(s)
        b = vec[:, -1] * np.sqrt(max(val[-1], 0.0))
        f = np.outer(b, b)
        np.fill_diagonal(f, np.diag(s))
    else:
        raise ValueError(f"unknown target {target}")
    pi = ((c**2).T @ c**2 / t - s**2).sum()
    gamma = ((s - f) ** 2).sum()
    delta = min(1.0, max(0.0, pi / gamma / t)) if gamma > 1e-300 else 0.0
    return delta * f + (1 - delta) * s, delta


def ewma(x: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Recursive: the first outer product, then decay times the last plus the rest of the next."""
    x = np.where(np.isfinite(x), x, 0.0)
    out = np.outer(x[0], x[0])
    for r in x[1:]:
        out = decay * out + (1 - decay) * np.outer(r, r)
    return out


def newey_west(x: np.ndarray, lags: int = 5) -> np.ndarray:
    """Bartlett-weighted autocovariances; negative eigenvalues become 0."""
    x = np.where(np.isfinite(x), x, 0.0)
    t = len(x)
    c = x - x.mean(axis=0)
    out = c.T @ c / max(t - 1, 1)
    for k in range(1, min(lags, t - 1) + 1):
        g = c[k:].T @ c[:-k] / max(t - 1, 1)
        out += (1 - k / (lags + 1)) * (g + g.T)
    val, vec = np.linalg.eigh((out + out.T) / 2)
    return (vec * np.maximum(val, 0.0)) @ vec.T


def factor_model(x: np.ndarray, factors: int = 3) -> np.ndarray:
    """Principal components plus diagonal rest."""
    s = sample(x)
    val, vec = np.linalg.eigh(s)
    k = min(factors, len(val))
    b = vec[:, -k:] * np.sqrt(np.maximum(val[-k:], 0.0))
    common = b @ b.T
    return common + np.diag(np.maximum(np.diag(s) - np.diag(common), 1e-12))


ESTIMATORS = {"sample": sample, "ledoit_wolf": lambda x: ledoit_wolf(x)[0], "ewma": ewma, "newey_west": newey_west, "factor_model": factor_model}
