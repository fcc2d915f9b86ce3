"""Seasonal ARIMA by maximum likelihood, many series at a time.

A series is gathered into one row; a task takes its rows in lots of ``LOT`` series and fits all of a lot at once,
as arrays over (series, parameters tried, state). The likelihood is the exact one of
the innovations that a Kalman filter gives from the stationary start; once the filter's variance no longer changes
the innovations follow a plain recursion, which gives the same numbers in far less time. Partial
autocorrelations are what the optimiser (BFGS with central differences) moves, so
every model that it tries is stationary and invertible.

Defined results: missing and infinite values are left out, the rest follow one another. A
series has a model when at least ``LEAST`` values more than parameters stay after differencing; others give no rows. A series that is
constant after differencing has zero variance: it forecasts its mean, and its likelihood and criteria are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import KEY, valid

#: Series that are fitted at once, and values that a series needs beyond its parameters.
LOT, LEAST = 32, 8
#: Steps of the optimiser at most, and the change of the log likelihood at which it ends.
STEPS, TOLERANCE = 80, 1e-7
#: Relative change of the filter's variance at which it counts as steady, and times that the steady filter takes at once.
STEADY, BLOCK = 1e-9, 64


@dataclass(frozen=True)
class Order:
    """(p, d, q)(P, D, Q) with a period; ``mean``: a constant, which is fitted where nothing is differenced."""

    p: int = 0
    d: int = 0
    q: int = 0
    sp: int = 0
    sd: int = 0
    sq: int = 0
    period: int = 1

    @property
    def size(self) -> int:
        return self.p + self.q + self.sp + self.sq

    @property
    def lost(self) -> int:
        return self.d + self.sd * self.period

    def named(self) -> str:
        plain = f"({self.p},{self.d},{self.q})"
        return plain + (f"({self.sp},{self.sd},{self.sq}){self.period}" if self.sp or self.sd or self.sq else "")


def differenced(x: np.ndarray, order: Order) -> np.ndarray:
    for _ in range(order.d):
        x = np.diff(x)
    for _ in range(order.sd):
        x = x[order.period :] - x[: -order.period]
    return x


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients (last axis) of the stationary autoregression with these partial autocorrelations."""
    out = np.zeros_like(r)
    for k in range(r.shape[-1]):
        before = out[..., :k].copy()
        out[..., :k] = before - r[..., k : k + 1] * before[..., ::-1]
        out[..., k] = r[..., k]
    return out


def to_partial(phi: np.ndarray) -> np.ndarray | None:
    """The reverse of :func:`from_partial`; none for coefficients that aren't stationary."""
    phi, out = np.array(phi, float), np.zeros(len(phi))
    for k in range(len(phi) - 1, -1, -1):
        r = out[k] = phi[k]
        if abs(r) >= 1:
            return None
        phi = (phi[:k] + r * phi[:k][::-1]) / (1 - r * r)
    return out


def _product(a: np.ndarray, b: np.ndarray, period: int) -> np.ndarray:
    """Coefficients c of 1 - sum c B^k = (1 - sum a B^k)(1 - sum b B^(period k))."""
    p, s = a.shape[-1], b.shape[-1]
    full = np.zeros((*a.shape[:-1], p + s * period + 1))
    left = np.concatenate([np.ones((*a.shape[:-1], 1)), -a], -1)
    full[..., : p + 1] = left
    for k in range(s):
        full[..., (k + 1) * period : (k + 1) * period + p + 1] -= b[..., k : k + 1] * left
    return -full[..., 1:]


def unpacked(moved: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """AR and MA coefficients of the whole polynomials, and the four parts (phi, theta, seasonal phi, seasonal theta)."""
    ends = np.cumsum([0, order.p, order.q, order.sp, order.sq])
    r = np.tanh(moved)
    parts = [from_partial(r[..., a:b]) for a, b in itertools.pairwise(ends)]
    phi, theta, sphi, stheta = parts[0], -parts[1], parts[2], -parts[3]
    ar = _product(phi, sphi, order.period)
    ma = -_product(-theta, -stheta, order.period)
    return ar, ma, [phi, theta, sphi, stheta]


def _start(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, noise loading and stationary variance of the state, for each model of a batch."""
    size = max(ar.shape[-1], ma.shape[-1] + 1)
    t = np.zeros((len(ar), size, size))
    t[:, : ar.shape[-1], 0] = ar
    t[:, np.arange(size - 1), np.arange(1, size)] = 1
    load = np.zeros((len(ar), size))
    load[:, 0] = 1
    load[:, 1 : ma.shape[-1] + 1] = ma
    noise = load[:, :, None] * load[:, None, :]
    v, a = noise.copy(), t
    for _ in range(60):  # sum of T^k RR' T'^k by doubling
        more = a @ v @ a.transpose(0, 2, 1)
        v = v + more
        if np.abs(more).max() <= 1e-14 * np.abs(v).max():
            break
        a = a @ a
    return t, load, v


class Filtered:
    """Innovations and their relative variances of models (rows) on series of several lengths.

    ``w``: models x times, what lies beyond a series' ``length`` is zero and has no innovation. ``exact``: from the
    stationary start, else as though zeros lay before the series. ``to_the_end``: also the last ``state``.
    """

    def __init__(self, w: np.ndarray, length: np.ndarray, ar: np.ndarray, ma: np.ndarray, to_the_end: bool = False, exact: bool = True):
        m, n = w.shape
        if not exact:
            self.errors, self.spread = np.zeros((m, n)), np.ones((m, n))
            self._go_on(w, ar, ma, 0)
            self._summed(length)
            return
        t, load, v = _start(ar, ma)
        noise, size = load[:, :, None] * load[:, None, :], t.shape[1]
        a = np.zeros((m, size))
        self.errors, self.spread = np.zeros((m, n)), np.ones((m, n))
        self.state = np.zeros((m, size))
        k = 0
        while k < n:
            f = np.maximum(v[:, 0, 0], 1e-300)
            e = w[:, k] - a[:, 0]
            gain = np.einsum("bij,bj->bi", t, v[:, :, 0]) / f[:, None]
            a = np.einsum("bij,bj->bi", t, a) + gain * e[:, None]
            after = t @ v @ t.transpose(0, 2, 1) + noise - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
            self.errors[:, k], self.spread[:, k] = e, f
            ended = length == k + 1
            self.state[ended] = a[ended]
            k += 1
            steady = np.abs(after - v).max() <= STEADY * max(1.0, np.abs(v).max())
            v = after
            if steady and not to_the_end and k >= max(ar.shape[1], ma.shape[1]):
                break
        if k < n:
            self._go_on(w, ar, ma, k)
        self._summed(length)

    def _summed(self, length: np.ndarray) -> None:
        live = np.arange(self.errors.shape[1])[None, :] < length[:, None]
        self.errors *= live
        self.spread = np.where(live, self.spread, 1.0)
        s2 = (self.errors**2 / self.spread).sum(1) / length
        self.sigma2 = s2
        with np.errstate(divide="ignore"):
            self.loglik = -0.5 * (length * (np.log(2 * math.pi * s2) + 1) + np.log(self.spread).sum(1))

    def _go_on(self, w: np.ndarray, ar: np.ndarray, ma: np.ndarray, k: int) -> None:
        """The steady filter from time ``k`` on: e_t = w_t - sum ar w - sum ma e, with variance one; nothing lies before time 0.

        Errors are taken a block at a time: the block's own part for all blocks at once, and what the errors before it add one block after another.
        """
        n, u = w.shape[1], w[:, k:].copy()
        for j in range(1, min(ar.shape[1], n - 1) + 1):
            if (c := ar[:, j - 1 : j]).any():
                at = max(k, j)
                u[:, at - k :] -= c * w[:, at - j : n - j]
        q = int(np.flatnonzero(ma.any(0)).max(initial=-1)) + 1
        if not q:
            self.errors[:, k:] = u
            return
        m, size = len(ma), max(BLOCK, q)
        blocks = -(-(n - k) // size)
        response = np.zeros((m, size + q))  # of an error to its past, after q zeros
        response[:, q] = 1
        back = np.ascontiguousarray(ma[:, :q][:, ::-1])
        for i in range(1, size):
            response[:, q + i] = -(back * response[:, i : i + q]).sum(1)
        gap = np.arange(size)[:, None] - np.arange(size)[None, :]
        own = np.where(gap >= 0, response[:, q + np.maximum(gap, 0)], 0.0)
        lag = np.arange(size)[:, None] + np.arange(q, 0, -1)[None, :]  # of the q errors before the block, the oldest first
        add = own @ np.where(lag <= q, -ma[:, np.minimum(lag, q) - 1], 0.0)
        padded = np.zeros((m, blocks * size))
        padded[:, : n - k] = u
        parts = own @ padded.reshape(m, blocks, size).transpose(0, 2, 1)
        tail = np.zeros((m, q))
        tail[:, max(0, q - k) :] = self.errors[:, max(0, k - q) : k]
        for b in range(blocks):
            parts[:, :, b] += np.einsum("miq,mq->mi", add, tail)
            tail = parts[:, size - q :, b]
        self.errors[:, k:] = parts.transpose(0, 2, 1).reshape(m, -1)[:, : n - k]


class Fit:
    """The models of one order for a lot of series, fitted together."""

    def __init__(self, xs: list[np.ndarray], order: Order, exact: bool = True):
        self.order, self.exact = order, exact
        ws = [differenced(x, order) for x in xs]
        self.length = np.array([len(w) for w in ws])
        self.mean = np.array([w.mean() if order.lost == 0 else 0.0 for w in ws])
        self.scale = np.array([max(float(np.sqrt(np.mean((w - m) ** 2))), 1e-300) for w, m in zip(ws, self.mean, strict=True)])
        self.flat = np.array([np.ptp(w) <= 1e-12 * max(1.0, np.abs(w).max()) for w in ws])
        self.w = np.zeros((len(ws), self.length.max()))
        for row, w, m, s, flat in zip(self.w, ws, self.mean, self.scale, self.flat, strict=True):
            row[: len(w)] = 0 if flat else (w - m) / s
        self.moved = np.array([_first_guess(row[:n], order) for row, n in zip(self.w, self.length, strict=True)]).reshape(len(ws), order.size)
        if order.size:
            self._climb()
        ar, ma, self.parts = unpacked(self.moved, order)
        self.ar, self.ma = ar, ma
        self.filtered = Filtered(self.w, self.length, ar, ma, True, exact)
        self.sigma2 = np.where(self.flat, 0.0, self.filtered.sigma2 * self.scale**2)
        self.loglik = np.where(self.flat, np.nan, self.filtered.loglik - self.length * np.log(self.scale))
        k = order.size + 1 + (order.lost == 0)
        n = self.length
        self.aic = 2 * k - 2 * self.loglik
        self.aicc = self.aic + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)
        self.bic = k * np.log(n) - 2 * self.loglik
        self.hqic = 2 * k * np.log(np.log(np.maximum(n, 3))) - 2 * self.loglik

    def _value(self, moved: np.ndarray) -> np.ndarray:
        """Mean negative log likelihoods of series x tries x parameters."""
        s, tries, k = moved.shape
        ar, ma, _ = unpacked(moved.reshape(-1, k), self.order)
        f = Filtered(np.repeat(self.w, tries, 0), np.repeat(self.length, tries), ar, ma, exact=self.exact)
        out = (-f.loglik / np.repeat(self.length, tries)).reshape(s, tries)
        return np.where(np.isfinite(out), out, np.inf)

    def _climb(self) -> None:
        s, k = self.moved.shape
        x, h = self.moved.clip(-3, 3), 1e-4
        inverse = np.tile(np.eye(k), (s, 1, 1))
        lengths = np.array([1.0, 0.5, 0.2, 0.05, 0.01, 2.0])
        eye = np.concatenate([np.zeros((1, k)), np.eye(k) * h, -np.eye(k) * h])

        def slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v = self._value(x[:, None, :] + eye[None])
            with np.errstate(invalid="ignore"):
                g = (v[:, 1 : k + 1] - v[:, k + 1 :]) / (2 * h)
            return v[:, 0], np.nan_to_num(g, nan=0.0, posinf=0.0, neginf=0.0)

        value, g = slope(x)
        self.converged = self.flat.copy()
        for _ in range(STEPS):
            way = -np.einsum("sij,sj->si", inverse, g)
            bad = (way * g).sum(1) >= 0
            way[bad], inverse[bad] = -g[bad], np.eye(k)
            way *= np.minimum(1, 1 / np.maximum(np.abs(way).max(1, keepdims=True), 1e-300))  # of one at most
            tries = np.clip(x[:, None, :] + lengths[None, :, None] * way[:, None, :], -4, 4)
            v = self._value(tries)
            best = v.argmin(1)
            rows = np.arange(s)
            better = (v[rows, best] < value) & ~self.converged
            gained = np.where(better, np.minimum(value, 1e300) - np.minimum(v[rows, best], 1e300), 0)
            moved = np.where(better[:, None], tries[rows, best], x)
            fresh, now = slope(moved)
            step, change = moved - x, now - g
            sy = (step * change).sum(1)
            ok = better & (sy > 1e-12)
            for i in np.flatnonzero(ok):
                rho, y, d = 1 / sy[i], change[i], step[i]
                left = np.eye(k) - rho * np.outer(d, y)
                inverse[i] = left @ inverse[i] @ left.T + rho * np.outer(d, d)
            stuck = ~better & ~self.converged
            first_time = stuck & (np.abs(inverse - np.eye(k)).max((1, 2)) > 0)
            inverse[first_time] = np.eye(k)  # once more along the slope
            self.converged |= (stuck & ~first_time) | (better & (gained * self.length < TOLERANCE))
            x, value, g = moved, fresh, now
            if self.converged.all():
                break
        self.moved = x

    def forecast(self, xs: list[np.ndarray], horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Forecasts of the series themselves and their standard errors: series x horizon."""
        o, s = self.order, len(xs)
        state, t = self.filtered.state, _start(self.ar, self.ma)[0]
        ahead = np.zeros((s, horizon))
        for h in range(horizon):
            ahead[:, h] = state[:, 0]
            state = np.einsum("bij,bj->bi", t, state)
        ahead = ahead * np.where(self.flat, 0, self.scale)[:, None] + np.array([differenced(x, o).mean() if f and o.lost else m for x, f, m in zip(xs, self.flat, self.mean, strict=True)])[:, None]
        lift = np.array([1.0])  # (1 - B)^d (1 - B^period)^D
        for _ in range(o.d):
            lift = np.convolve(lift, [1.0, -1.0])
        for _ in range(o.sd):
            lift = np.convolve(lift, np.concatenate([[1.0], np.zeros(o.period - 1), [-1.0]]))
        out, error = np.zeros((s, horizon)), np.zeros((s, horizon))
        for i, x in enumerate(xs):
            past = list(x[len(x) - len(lift) + 1 :]) if len(lift) > 1 else []
            for h in range(horizon):
                v = ahead[i, h] - sum(c * past[-j] for j, c in enumerate(lift[1:], 1))
                past.append(v)
                out[i, h] = v
            full = np.convolve(np.concatenate([[1.0], -self.ar[i]]), lift)
            psi = np.zeros(horizon)
            for h in range(horizon):
                psi[h] = (1.0 if h == 0 else self.ma[i, h - 1] if h <= self.ma.shape[1] else 0.0) - sum(full[j] * psi[h - j] for j in range(1, min(h, len(full) - 1) + 1))
            error[i] = np.sqrt(self.sigma2[i] * np.cumsum(psi**2))
        return out, error

    def residuals(self, i: int) -> np.ndarray:
        """One-step errors of the differenced series, on the scale of the series."""
        return self.filtered.errors[i, : self.length[i]] * (0 if self.flat[i] else self.scale[i])


def _first_guess(w: np.ndarray, order: Order) -> np.ndarray:
    """Hannan-Rissanen: residuals of a long autoregression stand in for the errors; lags of both explain the series."""
    lags = [*range(1, order.p + 1), *(k * order.period for k in range(1, order.sp + 1))]
    past = [*range(1, order.q + 1), *(k * order.period for k in range(1, order.sq + 1))]
    long = min(max([*lags, *past, 1]) + int(10 * math.log10(max(len(w), 10)) // 2), len(w) // 4)
    guess = np.zeros(len(lags) + len(past))
    if not len(guess):
        return guess
    back = max([*lags, *past, 1])
    if long >= 1 and len(w) - long - back > 2 * len(guess) + 2 and w.any():
        stack = lambda x, at, frm: np.column_stack([x[frm - j : len(x) - j] for j in at])
        coefficients = np.linalg.lstsq(stack(w, range(1, long + 1), long), w[long:], rcond=None)[0]
        e = np.concatenate([np.zeros(long), w[long:] - stack(w, range(1, long + 1), long) @ coefficients])
        frm = long + back
        design = np.column_stack([x for x in ([stack(w, lags, frm)] if lags else []) + ([stack(e, past, frm)] if past else [])])
        guess = np.linalg.lstsq(design, w[frm:], rcond=None)[0]
    a, b, c = order.p, order.p + order.sp, order.p + order.sp + order.q
    out = []
    for part in (guess[:a], -guess[b:c], guess[a:b], -guess[c:]):
        r = to_partial(part)
        while r is None:
            part = part * 0.7
            r = to_partial(part)
        out.append(np.arctanh(np.clip(r, -0.95, 0.95)))
    return np.concatenate(out)


def differences_needed(x: np.ndarray, most: int = 2) -> int:
    """Differences until the level KPSS statistic is below its 5 % value."""
    for d in range(most):
        n = len(x)
        if n < 12 or np.ptp(x) == 0:
            return d
        e = x - x.mean()
        lag = int(4 * (n / 100) ** 0.25)
        spread = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / n
        if spread <= 0 or (np.cumsum(e) ** 2).sum() / (n * n * spread) < 0.463:
            return d
        x = np.diff(x)
    return most


def seasonal_differences_needed(x: np.ndarray, period: int) -> int:
    """One where the season's share of what the trend leaves is over 0.64."""
    if period < 2 or len(x) < 3 * period:
        return 0
    weights = np.ones(period) / period if period % 2 else np.concatenate([[0.5], np.ones(period - 1), [0.5]]) / period
    half = len(weights) // 2
    rest = x[half : len(x) - half] - np.convolve(x, weights, "valid")
    phase = np.arange(len(rest)) % period
    means = np.bincount(phase, rest) / np.bincount(phase)
    left, all_of_it = (rest - means[phase]).var(), rest.var()
    return int(all_of_it > 0 and 1 - left / all_of_it > 0.64)


def search(x: np.ndarray, period: int = 1, most: tuple[int, int, int, int] = (3, 3, 1, 1), most_d: int = 2) -> tuple[Fit, int]:
    """The model of least AICc: both differences by tests, then steps to neighbours from four models on. Also how many were tried.

    On the way models are compared by the likelihood given zeros before the series; the four that
    come first and the one without coefficients are then fitted exactly, which decides.
    """
    sd = seasonal_differences_needed(x, period)
    base = Order(sd=sd, period=period)
    base = replace(base, d=differences_needed(differenced(x, base), most_d - sd if sd else most_d))
    seen: dict[Order, Fit] = {}

    def score(o: Order) -> float:
        if o not in seen:
            seen[o] = Fit([x], o, exact=False)
        a = seen[o].aicc[0]
        return float(a) if np.isfinite(a) else math.inf

    def allowed(o: Order) -> bool:
        return all(0 <= v <= m for v, m in zip((o.p, o.q, o.sp, o.sq), most, strict=True)) and (period > 1 or not (o.sp or o.sq)) and len(x) - o.lost >= o.size + LEAST

    season = {"sp": 1, "sq": 1} if period > 1 else {}
    starts = [replace(base, p=2, q=2, **season), base, replace(base, p=1, **({"sp": 1} if season else {})), replace(base, q=1, **({"sq": 1} if season else {}))]
    best = min((o for o in starts if allowed(o)), key=score, default=base)
    while True:
        moves = [{k: getattr(best, k) + v} for k in ("p", "q", "sp", "sq") for v in (-1, 1)] + [{"p": best.p + v, "q": best.q + v} for v in (-1, 1)]
        near = [o for o in (replace(best, **m) for m in moves) if allowed(o)]
        found = min([best, *near], key=score)
        if found == best:
            last = {*sorted(seen, key=score)[:4], base}
            exact = sorted((Fit([x], o) for o in last if o == base or allowed(o)), key=lambda f: (math.inf if np.isnan(f.aicc[0]) else f.aicc[0], f.order.size))
            return exact[0], len(seen)
        best = found


MODEL = "series_id string, model string, n int, ar array<double>, ma array<double>, seasonal_ar array<double>, seasonal_ma array<double>, mean double, sigma2 double, loglik double, aic double, aicc double, bic double, hqic double, tried int, forecast array<double>, error array<double>, idx array<long>, fitted array<double>, residual array<double>"


def _row(key: str, x: np.ndarray, idx: np.ndarray, fit: Fit, i: int, tried: int, ahead: np.ndarray, error: np.ndarray, with_residuals: bool) -> dict:
    number = lambda v: float(v) if np.isfinite(v) else None
    out = {"series_id": key, "model": fit.order.named(), "n": int(fit.length[i]), "mean": float(fit.mean[i]), "sigma2": float(fit.sigma2[i]), "tried": tried}
    out |= {name: part[i].tolist() for name, part in zip(("ar", "ma", "seasonal_ar", "seasonal_ma"), fit.parts, strict=True)}
    out |= {name: number(getattr(fit, name)[i]) for name in ("loglik", "aic", "aicc", "bic", "hqic")}
    out |= {"forecast": ahead[i].tolist(), "error": error[i].tolist(), "idx": [], "fitted": [], "residual": []}
    if with_residuals:
        e = fit.residuals(i)
        out |= {"idx": idx[fit.order.lost :].tolist(), "fitted": (x[fit.order.lost :] - e).tolist(), "residual": e.tolist()}
    return out


def models(series: DataFrame, order: Order | None, horizon: int = 10, period: int = 1, with_residuals: bool = False, most: tuple[int, int, int, int] = (3, 3, 1, 1)) -> DataFrame:
    """One row for each series: the fitted model of ``order`` (or the one that :func:`search` finds), its criteria and its forecasts."""
    spark = series.sparkSession
    points = F.array_sort(F.collect_list(F.struct("idx", "value")))
    wide = valid(series).groupBy(KEY).agg(points.alias("p")).select(KEY, F.transform("p", lambda r: r["idx"]).alias("idx"), F.transform("p", lambda r: r["value"]).alias("value"))
    # fits are long and rows few, so each series is dealt to a task of its own where there are enough
    wide = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEY)
    names = [c.split()[0] for c in MODEL.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), LOT):
                lot = [(k, np.asarray(x, float), np.asarray(i, np.int64)) for k, x, i in zip(*(frame[c].iloc[at : at + LOT] for c in (KEY, "value", "idx")), strict=True)]
                rows = []
                if order is None:
                    for k, x, idx in lot:
                        if len(x) >= 2 * LEAST + period:
                            fit, tried = search(x, period, most)
                            rows.append(_row(k, x, idx, fit, 0, tried, *fit.forecast([x], horizon), with_residuals))
                else:
                    lot = [t for t in lot if len(t[1]) - order.lost >= order.size + LEAST]
                    if lot:
                        fit = Fit([x for _, x, _ in lot], order)
                        ahead, error = fit.forecast([x for _, x, _ in lot], horizon)
                        rows = [_row(k, x, idx, fit, i, 1, ahead, error, with_residuals) for i, (k, x, idx) in enumerate(lot)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return wide.mapInPandas(run, MODEL)


def coefficients(fitted: DataFrame) -> DataFrame:
    """One row for each coefficient of the models: ``part``, ``lag`` (of its own part) and ``coefficient``."""

    def part(c: str) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(c).alias("part"), (i + 1).alias("lag"), x.alias("coefficient")))

    parts = [part(c) for c in ("ar", "ma", "seasonal_ar", "seasonal_ma")]
    return fitted.select(KEY, "model", F.explode(F.concat(*parts)).alias("c")).select(KEY, "model", "c.*")


def criteria(fitted: DataFrame) -> DataFrame:
    return fitted.select(KEY, "model", "n", "mean", "sigma2", "loglik", "aic", "aicc", "bic", "hqic", "tried")


def steps(fitted: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """``step``, ``forecast``, its standard ``error`` and the interval of ``z`` errors."""
    s = fitted.select(KEY, F.posexplode(F.arrays_zip("forecast", "error")).alias("k", "v"))
    return s.select(KEY, (F.col("k") + 1).alias("step"), F.col("v.forecast").alias("forecast"), F.col("v.error").alias("error"), (F.col("v.forecast") - z * F.col("v.error")).alias("lower"), (F.col("v.forecast") + z * F.col("v.error")).alias("upper"))


def residuals(fitted: DataFrame) -> DataFrame:
    """``idx``, ``fitted`` and ``residual`` of each point that has one (``with_residuals``)."""
    return fitted.select(KEY, F.explode(F.arrays_zip("idx", "fitted", "residual")).alias("r")).select(KEY, "r.*")
