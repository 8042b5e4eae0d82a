"""Unpenalised logistic regression on counts of covariate patterns.

Spark counts the patterns and brings those of a model together; a task runs Newton's method to its end, for every
model in one job.  A model's patterns are bounded by its covariates' values, never by people.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from cohortide.sources.workspace import shuffles_removed

# tasks carry the functions of this module, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Models that a task gets together, as each has some hundred rows only.
PACK = 32
#: What a task returns for each model; ``beta`` and ``cov`` (by rows) are empty unless it has converged.
FITTED = "model_id int, n double, status string, steps int, loglik double, beta array<double>, cov array<double>"


@dataclass
class Fit:
    """Coefficients by term, their covariance, the log likelihood and the row count.

    ``status`` is "converged", "separated" (a covariate splits outcomes from the rest, so the estimate is
    infinite), "singular" (a term is a combination of others) or "no data"; ``steps`` counts
    passes.
    """

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: float
    status: str
    steps: int = 0

    @property
    def converged(self) -> bool:
        return self.status == "converged"

    def contrast(self, weights: dict[str, float]) -> tuple[float, float]:
        """Value and standard error of a weighted sum of coefficients."""
        c = np.array([weights.get(t, 0.0) for t in self.terms])
        return float(c @ self.beta), float(math.sqrt(max(c @ self.cov @ c, 0.0)))

    def wald(self, terms: list[str]) -> float:
        """Wald chi-square that the given coefficients are all zero."""
        at = [self.terms.index(t) for t in terms]
        b = self.beta[at]
        return float(b @ np.linalg.solve(self.cov[np.ix_(at, at)], b))

    def bic(self) -> float:
        return -2 * self.loglik + len(self.terms) * math.log(self.n)


def newton(x: np.ndarray, n: np.ndarray, y: np.ndarray, first: dict[int, float] | None = None) -> tuple:
    """Fit counts ``y`` of ``n`` to the columns of ``x``, the first of which is all ones, by Newton's method.

    Returns (n, status, steps, log likelihood, coefficients, covariance by rows).  ``first`` may give first
    values by column, for example from a smaller model.  Counts of a pattern may be spread over several
    rows, negative corrections among them: every sum is linear in them.

    It goes on until the model is decided, however many passes that takes.  It has converged
    when no coefficient moves any more.  It is singular when a pivot of its information matrix,
    scaled to a unit diagonal and so free of the columns' units, vanishes.  It is separated when its
    likelihood has stopped rising while coefficients still run away.
    """
    total, cases = float(n.sum()), float(y.sum())
    if not 0 < cases < total:
        return total, "no data", 0, math.nan, [], []
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(cases / (total - cases))
    for i, value in (first or {}).items():
        beta[i] = value
    last, best, scale, steps, halved, flat = beta, -math.inf, None, 0, 0, 0
    while True:
        eta = x @ beta
        # log p and log(1 - p) without overflow for large |eta|
        tail = np.exp(-np.abs(eta))
        loglik = float(np.sum(y * np.minimum(eta, 0) + (n - y) * np.minimum(-eta, 0) - n * np.log1p(tail)))
        steps += 1
        # a step that overshoots is halved until it is too short to be one
        if loglik < best - 1e-9 * (1 + abs(best)) and halved < 50:
            beta, halved = (beta + last) / 2, halved + 1
            continue
        p = np.where(eta >= 0, 1, tail) / (1 + tail)
        info = x.T @ (x * (n * p * (1 - p))[:, None])
        cov = scaled_inverse(info)
        if cov is None:  # only a model that runs away loses pivots on its way
            return total, "singular" if steps == 1 else "separated", steps, math.nan, [], []
        step = cov @ (x.T @ (y - n * p))
        if scale is None:
            scale = np.sqrt(np.diag(info) / info[0, 0])
        move = np.max(np.abs(step) * scale)  # on the linear predictor, whatever the columns' units
        flat = flat + 1 if loglik - best < 1e-9 * (1 + abs(loglik)) else 0
        if move < 1e-9 or (flat >= 3 and move < 1e-5):
            return total, "converged", steps, loglik, beta.tolist(), cov.ravel().tolist()
        if flat >= 3:
            return total, "separated", steps, math.nan, [], []
        last, best, halved, beta = beta, loglik, 0, beta + step


def fits_of(fitted: DataFrame, terms: dict[int, list[str]]) -> dict[int, Fit]:
    """Bring the fits, a few numbers for each model, to the driver; models without any row have no data."""
    with shuffles_removed(fitted.sparkSession):
        found = {r["model_id"]: r for r in fitted.select("*").collect()}
    fits = {}
    for m, names in terms.items():
        k, r = len(names), found.get(m)
        if r is not None and r["status"] == "converged":
            beta, cov = np.array(r["beta"]), np.array(r["cov"]).reshape(k, k)
            fits[m] = Fit(names, beta, cov, r["loglik"], r["n"], "converged", r["steps"])
            continue
        n, status, steps = (r["n"], r["status"], r["steps"]) if r is not None else (0, "no data", 0)
        fits[m] = Fit(names, np.full(k, np.nan), np.full((k, k), np.nan), math.nan, n, status, steps)
    return fits


def fit_models(
    patterns: DataFrame,
    terms: dict[int, list[str]],
    slots: list[str],
    start: dict[int, dict[str, float]] | None = None,
) -> dict[int, Fit]:
    """Fit every model in ``patterns`` (model_id, x0.., n, y), ``PACK`` models at a time in a task.

    ``slots`` names the columns x0.., ``terms`` the slots each model uses, a column of ones first; ``start``
    may give first values.  All rows of a model meet in one task, so they should be counts.
    """
    places = {m: [slots.index(t) for t in names] for m, names in terms.items()}
    first = {m: {terms[m].index(t): v for t, v in given.items()} for m, given in (start or {}).items()}
    width = len(slots)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        out, rows = [], rows.sort_values("model_id", kind="stable")
        models, starts = np.unique(rows["model_id"].to_numpy(), return_index=True)
        x = rows[[f"x{i}" for i in range(width)]].to_numpy(float)
        n, y = rows["n"].to_numpy(float), rows["y"].to_numpy(float)
        for m, low, high in zip(models.tolist(), starts, [*starts[1:], len(rows)], strict=True):
            out.append((m, *newton(x[low:high, places[m]], n[low:high], y[low:high], first.get(m))))
        return pd.DataFrame(out, columns=["model_id", "n", "status", "steps", "loglik", "beta", "cov"])

    pack = F.expr(f"model_id div {PACK}")
    return fits_of(patterns.groupBy(pack).applyInPandas(fit, FITTED), terms)


def scaled_inverse(info: np.ndarray, least: float = 1e-10) -> np.ndarray | None:
    """Inverse of an information matrix, or None when a pivot of it vanishes.

    Rows and columns are divided by the roots of the diagonal first: what is left of a term once the
    others explain it is then a share of its own spread, whatever its unit.
    """
    spread = np.sqrt(np.diag(info))
    if not np.all(np.isfinite(spread)) or np.min(spread) <= 0:
        return None
    scaled = info / np.outer(spread, spread)
    left = scaled.copy()
    for i in range(len(left)):
        if left[i, i] < least:
            return None
        left[i + 1 :, i + 1 :] -= np.outer(left[i + 1 :, i], left[i, i + 1 :]) / left[i, i]
    return np.linalg.inv(scaled) / np.outer(spread, spread)


def spline_sql(age: str, k1: str, k2: str, k3: str) -> str:
    """Nonlinear term of a restricted cubic spline with three knots."""

    def cube(knot: str) -> str:
        return f"pow(greatest({age} - {knot}, 0D), 3D)"

    return (
        f"({cube(k1)} - {cube(k2)} * ({k3} - {k1}) / ({k3} - {k2}) + {cube(k3)} * ({k2} - {k1}) / ({k3} - {k2}))"
        f" / pow({k3} - {k1}, 2D)"
    )


def spline_value(age, knots: tuple[float, float, float]):
    """The same term for a number or an array."""
    k1, k2, k3 = knots
    cube = [np.maximum(age - k, 0.0) ** 3 for k in knots]
    return (cube[0] - cube[1] * (k3 - k1) / (k3 - k2) + cube[2] * (k2 - k1) / (k3 - k2)) / (k3 - k1) ** 2
