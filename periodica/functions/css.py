"""Batched conditional least squares for one model order.

The small numeric step inside an Arrow batch: ``B`` equally long blocks of one
order are fitted together. Spark decides which (series, order, window) blocks
exist and where they run; nothing here knows about more than one batch.

Model: ``u = y - x beta``, ``z = (1-B)^d (1-B^m)^D u`` and
``phi(B) Phi(B^m) z_t = c + delta t + theta(B) Theta(B^m) e_t``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_ITER = 100
MAX_MODULUS = 0.999
RIDGE = 1e-11
STEPS = (1.0, 0.5, 0.25, 0.0625, 0.015625)


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    sp: int
    sd: int
    sq: int
    m: int
    trend: str = "ct"

    @property
    def lost(self) -> int:
        """Rows used up by differencing."""
        return self.d + self.m * self.sd

    @property
    def ar_span(self) -> int:
        return self.p + self.m * self.sp

    @property
    def trend_cols(self) -> int:
        return len(self.trend)

    def names(self, exog: list[str]) -> list[str]:
        trend = {"ct": ["intercept", "drift"], "t": ["drift"]}[self.trend]
        return (
            trend
            + list(exog)
            + [f"ar.L{i}" for i in range(1, self.p + 1)]
            + [f"ar.S.L{i * self.m}" for i in range(1, self.sp + 1)]
            + [f"ma.L{i}" for i in range(1, self.q + 1)]
            + [f"ma.S.L{i * self.m}" for i in range(1, self.sq + 1)]
        )


@dataclass
class Fit:
    est: np.ndarray  # (B, K) in the order of Order.names
    se: np.ndarray  # (B, K) robust standard errors
    resid: np.ndarray  # (B, R)
    sse: np.ndarray  # (B,)
    adjusted: np.ndarray  # (B,) pushed back inside the stationary / invertible region
    first: int  # block row of the first residual


def difference(a: np.ndarray, order: Order) -> np.ndarray:
    for step in [order.m] * order.sd + [1] * order.d:
        a = a[:, step:] - a[:, :-step]
    return a


def _poly(coef: np.ndarray, step: int, sign: float) -> np.ndarray:
    out = np.zeros((len(coef), coef.shape[1] * step + 1))
    out[:, 0] = 1.0
    if coef.shape[1]:
        out[:, step::step] = sign * coef
    return out


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for j in range(b.shape[1]):
        if np.any(b[:, j]):
            out[:, j : j + a.shape[1]] += a * b[:, j : j + 1]
    return out


def _lagged(poly: np.ndarray, s: np.ndarray, start: int, shift: int = 0) -> np.ndarray:
    """sum_j poly_j s_{t-shift-j} for t = start.."""
    stop = s.shape[1]
    out = np.zeros((len(s), stop - start))
    for j in range(poly.shape[1]):
        if np.any(poly[:, j]):
            k = shift + j
            out += poly[:, j : j + 1] * s[:, start - k : stop - k]
    return out


def _impulse(b: np.ndarray, rows: int) -> np.ndarray | None:
    """Transform of the first ``rows`` terms of 1 / b(B); None when b is 1."""
    lags = [k for k in range(1, b.shape[1]) if np.any(b[:, k])]
    if not lags:
        return None
    h = np.zeros((rows, len(b)))
    h[0] = 1.0
    weights = np.ascontiguousarray(b.T)
    for t in range(lags[0], rows):
        for k in lags:
            if k > t:
                break
            h[t] -= weights[k] * h[t - k]
    return np.fft.rfft(h.T, _fft_size(rows), axis=1)


def _fft_size(rows: int) -> int:
    return 1 << (2 * rows - 1).bit_length()


def _invert_ma(f: np.ndarray | None, a: np.ndarray) -> np.ndarray:
    """b(B)^-1 a along axis 1 with zero values before the block."""
    if f is None:
        return a
    rows = a.shape[1]
    f = f.reshape(f.shape + (1,) * (a.ndim - 2))
    return np.fft.irfft(f * np.fft.rfft(a, _fft_size(rows), axis=1), _fft_size(rows), axis=1)[:, :rows]


def _solve(j: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Least squares of r on j, batched, on scaled columns.

    A tiny ridge keeps rank-deficient blocks solvable (their solution is the
    minimum-norm one); two refinements take its effect out of the others.
    """
    scale = np.sqrt(np.einsum("brk,brk->bk", j, j))
    scale[scale == 0] = 1.0
    js = j / scale[:, None, :]
    jt = np.swapaxes(js, 1, 2)
    g = jt @ js
    rhs = (jt @ r[:, :, None])[:, :, 0]
    inv = np.linalg.inv(g + RIDGE * np.eye(j.shape[2]))
    x = np.einsum("bkl,bl->bk", inv, rhs)
    for _ in range(2):
        x += np.einsum("bkl,bl->bk", inv, rhs - np.einsum("bkl,bl->bk", g, x))
    return x / scale


def pull_inside(coef: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale coefficients whose largest inverse root lies beyond the allowed modulus."""
    k = coef.shape[1]
    hit = np.zeros(len(coef), dtype=bool)
    if not k:
        return coef, hit
    # coefficients whose absolute values sum to less than the limit are inside already
    open_rows = np.flatnonzero(np.abs(coef).sum(axis=1) > MAX_MODULUS**k)
    if not len(open_rows):
        return coef, hit
    companion = np.zeros((len(open_rows), k, k))
    companion[:, 0, :] = sign * coef[open_rows]
    for i in range(1, k):
        companion[:, i, i - 1] = 1.0
    mod = np.abs(np.linalg.eigvals(companion)).max(axis=1)
    outside = mod > MAX_MODULUS
    hit[open_rows] = outside
    rho = np.ones(len(coef))
    rho[open_rows[outside]] = MAX_MODULUS / mod[outside]
    return coef * rho[:, None] ** np.arange(1, k + 1), hit


class _Block:
    def __init__(self, y: np.ndarray, x: np.ndarray, order: Order, whole: bool = False):
        n = y.shape[1]
        self.order, self.n, self.k = order, n, x.shape[2]
        z, zx = difference(y, order), difference(x, order)
        t = np.arange(1, n + 1, dtype=float)[order.lost :]
        pad = order.ar_span if whole or z.shape[1] <= order.ar_span else 0
        if pad:  # a block too short to condition on its own rows starts from its mean
            z = np.concatenate([np.repeat(z.mean(axis=1, keepdims=True), pad, 1), z], 1)
            zx = np.concatenate([np.repeat(zx.mean(axis=1, keepdims=True), pad, 1), zx], 1)
            t = np.concatenate([np.zeros(pad), t])
        self.z, self.zx = z, zx
        self.start = order.ar_span
        self.first = order.lost + order.ar_span - pad
        t = t[self.start :]
        self.g = np.column_stack([np.ones_like(t), t] if order.trend == "ct" else [t])

    def split(self, nl: np.ndarray):
        o = self.order
        cuts = np.cumsum([o.p, o.sp, o.q])
        return np.split(nl, cuts, axis=1)

    def polys(self, nl: np.ndarray):
        phi, sphi, theta, stheta = self.split(nl)
        m = self.order.m
        return _poly(phi, 1, -1.0), _poly(sphi, m, -1.0), _poly(theta, 1, 1.0), _poly(stheta, m, 1.0)

    def project(self, nl: np.ndarray):
        phi, sphi, theta, stheta = self.split(nl)
        parts, hits = zip(*[pull_inside(c, s) for c, s in ((phi, 1.0), (sphi, 1.0), (theta, -1.0), (stheta, -1.0))])
        return np.concatenate(parts, axis=1), np.any(hits, axis=0)

    def start_values(self) -> np.ndarray:
        """Two-step start: residuals of a long autoregression stand in for the errors."""
        o, rows = self.order, self.z.shape[1]
        most = max(o.p + o.m * o.sp, o.q + o.m * o.sq)
        long = min(max(most, int(2 * rows ** 0.5)), (rows - 4) // 3)
        if long < 1 or rows - long <= 2 * most + 4:
            return np.zeros((len(self.z), o.p + o.sp + o.q + o.sq))
        t = np.arange(rows, dtype=float)
        det = np.concatenate(
            [np.broadcast_to(np.column_stack([np.ones(rows), t]), (len(self.z), rows, 2)), self.zx], axis=2
        )

        def lags(s, ks, start):
            return np.stack([s[:, start - k : rows - k] for k in ks], axis=2) if ks else np.empty((len(s), rows - start, 0))

        own = np.concatenate([det[:, long:], lags(self.z, range(1, long + 1), long)], axis=2)
        e = np.zeros_like(self.z)
        e[:, long:] = self.z[:, long:] - np.einsum("brk,bk->br", own, _solve(own, self.z[:, long:]))
        first = long + most if rows - long - most > most + 4 else long
        ar = list(range(1, o.p + 1)) + [o.m * i for i in range(1, o.sp + 1)]
        ma = list(range(1, o.q + 1)) + [o.m * i for i in range(1, o.sq + 1)]
        cols = np.concatenate([det[:, first:], lags(self.z, ar, first), lags(e, ma, first)], axis=2)
        return self.project(_solve(cols, self.z[:, first:])[:, det.shape[2] :])[0]

    def linear_columns(self, a: np.ndarray) -> np.ndarray:
        cols = np.empty((len(self.z), self.z.shape[1] - self.start, self.g.shape[1] + self.k))
        cols[:, :, : self.g.shape[1]] = -self.g
        for j in range(self.k):
            cols[:, :, self.g.shape[1] + j] = -_lagged(a, self.zx[:, :, j], self.start)
        return cols

    def evaluate(self, nl: np.ndarray):
        """Residuals with the trend and exogenous part solved exactly for given lag terms."""
        pa, psa, pb, psb = self.polys(nl)
        a, b = _mul(pa, psa), _mul(pb, psb)
        both = np.concatenate([_lagged(a, self.z, self.start)[:, :, None], self.linear_columns(a)], axis=2)
        both = _invert_ma(_impulse(b, both.shape[1]), both)
        e0, jl = both[:, :, 0], both[:, :, 1:]
        lin = -_solve(jl, e0)
        return lin, e0 + (jl @ lin[:, :, None])[:, :, 0], jl

    def jacobian(self, nl: np.ndarray, lin: np.ndarray, e: np.ndarray, jl: np.ndarray) -> np.ndarray:
        o = self.order
        pa, psa, pb, psb = self.polys(nl)
        b = _mul(pb, psb)
        u = self.z
        if self.k:
            u = u - (self.zx @ lin[:, self.g.shape[1] :, None])[:, :, 0]
        cols = [-_lagged(psa, u, self.start, i) for i in range(1, o.p + 1)]
        cols += [-_lagged(pa, u, self.start, i * o.m) for i in range(1, o.sp + 1)]
        before = o.q + o.m * o.sq
        ep = np.concatenate([np.zeros((len(e), before)), e], axis=1)
        cols += [-_lagged(psb, ep, before, i) for i in range(1, o.q + 1)]
        cols += [-_lagged(pb, ep, before, i * o.m) for i in range(1, o.sq + 1)]
        if not cols:
            return jl
        stacked = _invert_ma(_impulse(b, e.shape[1]), np.stack(cols, axis=2))
        return np.concatenate([jl, stacked], axis=2)


def fit(
    y: np.ndarray, x: np.ndarray, order: Order, robust: bool = True, tol: float = 1e-10, max_iter: int = MAX_ITER, whole: bool = False
) -> Fit | None:
    """Fit ``y (B, n)`` on ``x (B, n, k)``; None when differencing leaves no row.

    ``whole`` starts every block from its mean, so that each row left by differencing has a residual.
    """
    if y.shape[1] <= order.lost:
        return None
    shift_y, shift_x = np.zeros(len(y)), np.zeros((len(y), x.shape[2]))
    if order.trend == "ct" and order.lost == 0:  # same model, better conditioned
        shift_y, shift_x = y.mean(axis=1), x.mean(axis=1)
    blk = _Block(y - shift_y[:, None], x - shift_x[:, None, :], order, whole)
    size = len(y)
    nl = np.zeros((size, order.p + order.sp + order.q + order.sq))
    lin, e, jl = blk.evaluate(nl)
    sse = (e * e).sum(axis=1)
    adjusted = np.zeros(size, dtype=bool)
    if order.q + order.sq:
        nl0 = blk.start_values()
        lin0, e0, jl0 = blk.evaluate(nl0)
        better = (e0 * e0).sum(axis=1) < sse
        nl[better], lin[better], e[better], jl[better] = nl0[better], lin0[better], e0[better], jl0[better]
        sse = (e * e).sum(axis=1)
    if nl.shape[1]:
        live = np.arange(size)
        for _ in range(max_iter):
            sub = _take(blk, live)
            j = sub.jacobian(nl[live], lin[live], e[live], jl[live])
            full = -_solve(j, e[live])
            gain = ((j @ full[:, :, None])[:, :, 0] ** 2).sum(axis=1)
            worth = gain > tol * sse[live]
            live, step = live[worth], full[worth][:, lin.shape[1] :]
            if not len(live):
                break
            open_rows = np.arange(len(live))
            moved = np.zeros(len(live), dtype=bool)
            for s in STEPS:
                rows = live[open_rows]
                cand, hit = blk.project(nl[rows] + s * step[open_rows])
                clin, ce, cjl = _take(blk, rows).evaluate(cand)
                csse = (ce * ce).sum(axis=1)
                good = csse < sse[rows] * (1 - 1e-12)
                won = rows[good]
                moved[open_rows[good]] = csse[good] < sse[won] * (1 - tol)
                nl[won], lin[won], e[won], jl[won] = cand[good], clin[good], ce[good], cjl[good]
                sse[won], adjusted[won] = csse[good], hit[good]
                open_rows = open_rows[~good]
                if not len(open_rows):
                    break
            live = live[moved]
            if not len(live):
                break
    pa, psa, _, _ = blk.polys(nl)
    gain = _mul(pa, psa).sum(axis=1)
    beta = lin[:, blk.g.shape[1] :]
    if order.trend == "ct" and order.lost == 0:
        lin[:, 0] += gain * (shift_y - (beta * shift_x).sum(axis=1))
    est = np.concatenate([lin, nl], axis=1)
    se = np.full_like(est, np.nan)
    if robust:
        raw = _Block(y, x, order, whole)
        a, b = _mul(pa, psa), _mul(*raw.polys(nl)[2:])
        jl = _invert_ma(_impulse(b, e.shape[1]), raw.linear_columns(a))
        j = raw.jacobian(nl, lin, e, jl)
        se = sandwich(j, e)
    return Fit(est, se, e, sse, adjusted, blk.first)


def sandwich(j: np.ndarray, e: np.ndarray) -> np.ndarray:
    scale = np.sqrt((j * j).sum(axis=1))
    scale[scale == 0] = 1.0
    js = j / scale[:, None, :]
    g = np.swapaxes(js, 1, 2) @ js
    broken = ~np.isfinite(g).all(axis=(1, 2))
    g[broken] = np.eye(g.shape[1])
    bread = np.linalg.pinv(g, rcond=1e-13, hermitian=True)
    je = js * e[:, :, None]
    cov = bread @ (np.swapaxes(je, 1, 2) @ je) @ bread
    se = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)) / scale
    se[broken] = np.nan
    return se


def _take(blk: _Block, rows: np.ndarray) -> _Block:
    if len(rows) == len(blk.z):
        return blk
    sub = object.__new__(_Block)
    sub.__dict__ = {**blk.__dict__, "z": blk.z[rows], "zx": blk.zx[rows]}
    return sub


def forecast(y: np.ndarray, x: np.ndarray, future_x: np.ndarray, f: Fit, order: Order, steps: int) -> np.ndarray:
    """``steps`` values after each block, back on the level of ``y``."""
    g, k = order.trend_cols, x.shape[2]
    lin, nl = f.est[:, : g + k], f.est[:, g + k :]
    cuts = np.cumsum([order.p, order.sp, order.q])
    phi, sphi, theta, stheta = np.split(nl, cuts, axis=1)
    a = _mul(_poly(phi, 1, -1.0), _poly(sphi, order.m, -1.0))
    one = np.ones((len(y), 1))
    for step in [order.m] * order.sd + [1] * order.d:
        a = _mul(a, _poly(one, step, -1.0))
    b = _mul(_poly(theta, 1, 1.0), _poly(stheta, order.m, 1.0))
    beta, n, span, tail = lin[:, g:], y.shape[1], a.shape[1] - 1, b.shape[1] - 1
    u = y - np.einsum("bnk,bk->bn", x, beta)
    u = np.concatenate([np.repeat(u.mean(axis=1, keepdims=True), max(span - n, 0), 1), u], 1)[:, u.shape[1] + max(span - n, 0) - span :]
    u = np.concatenate([u, np.zeros((len(y), steps))], axis=1)
    e = np.concatenate([np.zeros((len(y), max(tail - f.resid.shape[1], 0))), f.resid], axis=1)
    e = np.concatenate([e[:, e.shape[1] - tail :], np.zeros((len(y), steps))], axis=1)
    out = np.empty((len(y), steps))
    for h in range(steps):
        t = n + h + 1.0
        drift = lin[:, 0] + lin[:, 1] * t if order.trend == "ct" else lin[:, 0] * t
        ar = (a[:, 1:] * u[:, h : h + span][:, ::-1]).sum(axis=1) if span else 0.0
        ma = (b[:, 1:] * e[:, h : h + tail][:, ::-1]).sum(axis=1) if tail else 0.0
        u[:, span + h] = drift - ar + ma
        out[:, h] = u[:, span + h] + np.einsum("bk,bk->b", future_x[:, h], beta)
    return out


def rolling_forecast(y: np.ndarray, x: np.ndarray, window: int, order: Order, budget: int = 4_000_000) -> np.ndarray:
    """One-step forecasts of rows ``window..n-1``, each from its own refit on the window before it."""
    size, n = y.shape
    count = n - window
    if count <= 0:
        return np.empty((size, 0))
    blocks = np.lib.stride_tricks.sliding_window_view(y, window, axis=1)[:, :count].reshape(size * count, window)
    xb = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, :count]
    xb = np.swapaxes(xb, 2, 3).reshape(size * count, window, x.shape[2])
    nx = x[:, window:].reshape(size * count, 1, x.shape[2])
    width = order.trend_cols + x.shape[2] + order.p + order.sp + order.q + order.sq + 1
    chunk = max(1, budget // (window * width))
    out = np.full(size * count, np.nan)
    for lo in range(0, len(blocks), chunk):
        part = slice(lo, lo + chunk)
        f = fit(blocks[part], xb[part], order, robust=False)
        if f is not None:
            out[part] = forecast(blocks[part], xb[part], nx[part], f, order, 1)[:, 0]
    return out.reshape(size, count)
