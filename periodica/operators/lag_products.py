"""Autoregressions with products of lag polynomials and with variables, solved on cross products alone.

``phi(B) Phi(B^m) (z_t - x_t beta) = trend + e_t`` is linear in the lagged values of z and x once the coefficients of the
product are known, so its sum of squares is a quadratic form of one Gram matrix over the columns ``[trend, x, lags of z,
lags of x, lagged errors, z]``. That matrix is summed by Spark once; everything here works on a stack of such small
matrices, one per series or window: the trend is projected out, beta, phi and Phi are solved in turn on sub-matrices, and
Gauss-Newton steps on the same matrix finish. No data row is read again.

Lagged errors are columns like any other: whoever has estimates of the errors (see :mod:`periodica.operators.two_stage`) gets
moving-average terms, products of theta and Theta included, from the same solve. Without such terms there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from periodica.functions.css import Order, pull_inside

ALTERNATIONS = 6
MAX_STEPS = 100
TOLERANCE = 1e-12
SHARES = (1.0, 0.5, 0.25, 0.0625, 0.015625)
#: A column whose sum of squares falls below this share once the trend is taken out is part of the trend.
TREND_SHARE = 1e-11


def product_lags(order: Order) -> list[int]:
    """Lags with a coefficient in ``phi(B) Phi(B^m)``, ascending."""
    return sorted({i + order.m * j for i in range(order.p + 1) for j in range(order.sp + 1)} - {0})


def error_lags(order: Order) -> list[int]:
    """Lags with a coefficient in ``theta(B) Theta(B^m)``, ascending."""
    return sorted({i + order.m * j for i in range(order.q + 1) for j in range(order.sq + 1)} - {0})


def design_width(order: Order, n_exog: int) -> int:
    return order.trend_cols + n_exog + len(product_lags(order)) * (1 + n_exog)


def unpack(upper: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from rows of their upper triangles."""
    i, j = np.triu_indices(k)
    out = np.zeros((len(upper), k, k))
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


def scaled_pinv(g: np.ndarray, rcond: float) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0.0))
    scale[scale == 0] = 1.0
    outer = scale[:, :, None] * scale[:, None, :]
    broken = ~np.isfinite(g).all(axis=(1, 2))
    safe = np.where(broken[:, None, None], np.eye(g.shape[1]), g / outer)
    out = np.linalg.pinv(safe, rcond=rcond, hermitian=True) / outer
    out[broken] = np.nan
    return out


@dataclass
class Solution:
    par: np.ndarray  # trend, beta, phi, Phi, theta, Theta
    coef: np.ndarray  # of the design columns, products of lag terms multiplied out
    sse: np.ndarray
    adjusted: np.ndarray  # lag terms pushed back inside the stationary or invertible region
    converged: np.ndarray


class LagProduct:
    """Where the parameters of one order stand among the coefficients of its design columns."""

    def __init__(self, order: Order, n_exog: int):
        self.order, self.nv, self.g = order, n_exog, order.trend_cols
        self.lags, self.shocks = product_lags(order), error_lags(order)
        self.ar_terms = order.p + order.sp
        self.terms = self.ar_terms + order.q + order.sq
        self.width = n_exog + len(self.lags) * (1 + n_exog) + len(self.shocks)

    def _product(self, c: np.ndarray, first: int, lags: list[int], sign: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients at ``lags`` of the product of an ordinary and a seasonal polynomial, and their derivatives.

        The first ``first`` columns of ``c`` belong to the ordinary one; cross terms carry ``sign``.
        """
        at, m, seasonal = {lag: b for b, lag in enumerate(lags)}, self.order.m, c.shape[1] - first
        a, da = np.zeros((len(c), len(lags))), np.zeros((len(c), len(lags), c.shape[1]))
        for i in range(first):
            a[:, at[i + 1]] += c[:, i]
            da[:, at[i + 1], i] += 1.0
        for j in range(seasonal):
            s = first + j
            a[:, at[m * (j + 1)]] += c[:, s]
            da[:, at[m * (j + 1)], s] += 1.0
            for i in range(first):
                b = at[i + 1 + m * (j + 1)]
                a[:, b] += sign * c[:, i] * c[:, s]
                da[:, b, i] += sign * c[:, s]
                da[:, b, s] += sign * c[:, i]
        return a, da

    def polynomial(self, nl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the lags of z and their derivatives by phi and Phi."""
        return self._product(nl[:, : self.ar_terms], self.order.p, self.lags, -1.0)

    def shock_polynomial(self, nl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the lagged errors and their derivatives by theta and Theta."""
        return self._product(nl[:, self.ar_terms :], self.order.q, self.shocks, 1.0)

    def residual_weights(self, beta: np.ndarray, nl: np.ndarray) -> np.ndarray:
        """The residual as weights of the columns ``[x, lags of z, lags of x, lagged errors, z]``."""
        a = self.polynomial(nl)[0]
        cross = (a[:, :, None] * beta[:, None, :]).reshape(len(a), -1)
        return np.concatenate([-beta, -a, cross, -self.shock_polynomial(nl)[0], np.ones((len(a), 1))], axis=1)

    def derivatives(self, beta: np.ndarray, nl: np.ndarray) -> np.ndarray:
        """Those weights' derivatives by beta, phi, Phi, theta and Theta."""
        (a, da), (_, db) = self.polynomial(nl), self.shock_polynomial(nl)
        lags, nv, ar = len(self.lags), self.nv, self.ar_terms
        d = np.zeros((len(a), self.width + 1, nv + self.terms))
        d[:, nv : nv + lags, nv : nv + ar] = -da
        d[:, self.width - len(self.shocks) : self.width, nv + ar :] = -db
        for j in range(nv):
            d[:, j, j] = -1.0
            rows = nv + lags + np.arange(lags) * nv + j
            d[:, rows, j] = a
            d[:, rows, nv : nv + ar] = da * beta[:, j, None, None]
        return d

    def project(self, nl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = self.order
        blocks = np.split(nl, np.cumsum([o.p, o.sp, o.q]), axis=1)
        parts, hits = zip(*[pull_inside(c, sign) for c, sign in zip(blocks, (1.0, 1.0, -1.0, -1.0), strict=True)])
        return np.concatenate(parts, axis=1), np.any(hits, axis=0)

    def _step(self, s: np.ndarray, d: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step along ``d`` that lowers the quadratic form most, and by how much."""
        sd = np.einsum("bij,bjk->bik", s, d)
        slope = np.einsum("bik,bi->bk", sd, theta)
        step = -np.einsum("bkl,bl->bk", scaled_pinv(np.einsum("bik,bil->bkl", d, sd), TREND_SHARE), slope)
        return step, -(step * slope).sum(axis=1)

    def _profile(self, s: np.ndarray, nl: np.ndarray):
        """beta for given lag terms, with the weights and the sum of squares."""
        beta = np.zeros((len(nl), self.nv))
        theta = self.residual_weights(beta, nl)
        if self.nv:
            beta = self._step(s, self.derivatives(beta, nl)[:, :, : self.nv], theta)[0]
            theta = self.residual_weights(beta, nl)
        return beta, theta, np.maximum(np.einsum("bi,bij,bj->b", theta, s, theta), 0.0)

    def solve(self, gram: np.ndarray) -> Solution:
        """``gram`` (units, columns, columns) over ``[trend, x, lags of z, lags of x, z]``."""
        g, nv, size = self.g, self.nv, len(gram)
        broken = ~np.isfinite(gram).all(axis=(1, 2))
        if broken.any():
            gram = np.where(broken[:, None, None], np.eye(gram.shape[1]), gram)
        to_trend = scaled_pinv(gram[:, :g, :g], 1e-13) @ gram[:, :g, g:]
        s = gram[:, g:, g:] - np.swapaxes(gram[:, :g, g:], 1, 2) @ to_trend
        gone = np.diagonal(s, axis1=1, axis2=2) <= TREND_SHARE * np.diagonal(gram[:, g:, g:], axis1=1, axis2=2)
        gone[:, -1] = False
        s = np.where(gone[:, :, None] | gone[:, None, :], 0.0, s)
        nl, adjusted, converged = np.zeros((size, self.terms)), np.zeros(size, bool), np.ones(size, bool)
        beta, theta, sse = self._profile(s, nl)
        if self.terms:
            cuts = nv + np.cumsum([0, self.order.p, self.order.sp, self.order.q, self.order.sq])
            blocks = [range(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi > lo]
            for _ in range(ALTERNATIONS if len(blocks) > 1 or nv else 1):
                for block in blocks:
                    step, _ = self._step(s, self.derivatives(beta, nl)[:, :, list(block)], theta)
                    trial = nl.copy()
                    trial[:, [c - nv for c in block]] += step
                    nl, adjusted, beta, theta, sse = self._keep(s, nl, adjusted, beta, theta, sse, trial)
            converged[:] = False
            for _ in range(MAX_STEPS):
                step, gain = self._step(s, self.derivatives(beta, nl), theta)
                converged |= ~(gain > TOLERANCE * sse)
                if converged.all():
                    break
                before = sse.copy()
                for share in SHARES:
                    open_units = ~converged & (sse >= before)
                    if not open_units.any():
                        break
                    trial = np.where(open_units[:, None], nl + share * step[:, nv:], nl)
                    nl, adjusted, beta, theta, sse = self._keep(s, nl, adjusted, beta, theta, sse, trial)
                converged |= sse >= before  # no share of the step helps: the edge of the region, or the end of precision
        trend = np.einsum("bgi,bi->bg", to_trend, theta)
        par = np.concatenate([trend, beta, nl], axis=1)
        coef = np.concatenate([trend, -theta[:, :-1]], axis=1)
        par[broken], coef[broken], sse[broken] = np.nan, np.nan, np.nan
        return Solution(par, coef, sse, adjusted, converged)

    def _keep(self, s, nl, adjusted, beta, theta, sse, trial):
        """``trial`` where it lowers the sum of squares, once pulled inside the allowed region."""
        inside, hit = self.project(trial)
        new_beta, new_theta, new_sse = self._profile(s, inside)
        better = new_sse < sse
        row = better[:, None]
        return (
            np.where(row, inside, nl), np.where(better, hit, adjusted), np.where(row, new_beta, beta),
            np.where(row, new_theta, theta), np.where(better, new_sse, sse),
        )

    def jacobian(self, par: np.ndarray) -> np.ndarray:
        """Derivatives of the fitted value's design coefficients by all parameters."""
        g, nv = self.g, self.nv
        inner = -self.derivatives(par[:, g : g + nv], par[:, g + nv :])[:, :-1]
        out = np.zeros((len(par), g + self.width, g + nv + self.terms))
        out[:, range(g), range(g)] = 1.0
        out[:, g:, g:] = inner
        return out
