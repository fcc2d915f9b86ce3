"""Nearest series under time warping by lower bounds, and how good an alignment is.

Series become arrays, one row each, dealt to blocks of ``BLOCK``. Two blocks meet in one group, and a pair of series meets
once, as its distance is the same both ways. There the candidates of a series are taken in the order of a lower bound: a series' distance from the
envelope of the other within the band (Keogh), both ways, and that of their first and last points (Kim). Once the bound
passes the k-th distance found so far for both series, the pair is left out; a warping that passes it is
abandoned. The first k of each group hold the first k of all. Bounds and warpings of a group are computed for many pairs of one band at once, so
that a step is one operation on arrays.

Defined results: missing and infinite values are left out, the rest follow one another; a series without values takes no part.
The band is as wide as the difference of two lengths at least. Distances are sums of absolute differences along the path. Equal distances are ordered by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, valid

#: Series of a block and values of all of them at most; candidates of each series that are tried first; values that the longer series of the pairs warped at once hold, and how many pairs these are at most.
BLOCK, POINTS, AT_ONCE, LONG, PAIRS = 512, 1 << 22, 16, 1 << 18, 1024


def arrays_of(series: DataFrame) -> DataFrame:
    """One row for each series: its values ``x`` in order."""
    points = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return valid(series).groupBy(KEY).agg(F.transform(points, lambda r: r["value"]).alias("x"))


def envelope(y: np.ndarray, size: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of ``y`` within ``band`` places of each of ``size`` places; some place of y is within reach of each."""
    pad = np.full(band, np.nan)
    wide = np.concatenate([pad, y, np.full(max(0, size - len(y)) + band, np.nan)])[: size + 2 * band]
    if band * size > 4_000_000 or 2 * band + 1 >= 2 * len(y):
        s = pd.Series(wide)
        roll = s.rolling(2 * band + 1, min_periods=1)
        return roll.min().to_numpy()[2 * band :], roll.max().to_numpy()[2 * band :]
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1)
    return np.nanmin(windows, 1), np.nanmax(windows, 1)


def lower_bound(x: np.ndarray, y: np.ndarray, band: int) -> float:
    """No warping within the band is shorter."""
    best = abs(x[0] - y[0]) + (abs(x[-1] - y[-1]) if len(x) > 1 or len(y) > 1 else 0.0)
    for a, b in ((x, y), (y, x)):
        low, high = envelope(b, len(a), band)
        best = max(best, float((np.maximum(a - high, 0) + np.maximum(low - a, 0)).sum()))
    return best


def banded(x: np.ndarray, y: np.ndarray, band: int, limit: float = np.inf) -> float:
    """The warping distance within the band, infinite as soon as it is sure to pass ``limit``; an anti-diagonal at a time."""
    n, m = len(x), len(y)
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1, -(-(k - band) // 2)), min(n, k + 1, (k + band) // 2 + 1)
        new = np.full(n + 1, np.inf)
        if lo < hi:
            new[lo + 1 : hi + 1] = np.abs(x[lo:hi] - y[k - hi + 1 : k - lo + 1][::-1]) + np.minimum(np.minimum(older[lo:hi], old[lo:hi]), old[lo + 1 : hi + 1])
        if k and min(new.min(), old.min()) > limit:  # every path crosses one of two neighbouring diagonals
            return float("inf")
        older, old = old, new
    return float(old[n])


def _columns(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as columns of one array, filled up with NaN, and their lengths."""
    n = np.array([len(x) for x in xs])
    out = np.full((n.max(), len(xs)), np.nan)
    for i, x in enumerate(xs):
        out[: len(x), i] = x
    return out, n


def _warped(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, band: int, limit: np.ndarray) -> np.ndarray:
    """The warping distances of the columns of ``x`` and ``y`` within one band, infinite where they are sure to pass ``limit``; an anti-diagonal of all pairs at a time.

    What is filled up comes after the end of a series, and no path to the end leads there.
    """
    rows, cols, pairs = len(x), len(y), np.arange(x.shape[1])
    back, last = y[::-1], n + m - 2
    out = np.full(len(pairs), np.inf)
    older, old, new = (np.full((rows + 1, len(pairs)), np.inf) for _ in range(3))
    older[0] = 0
    away = np.empty((min(rows, band + 1), len(pairs)))
    for k in range(rows + cols - 1):
        lo, hi = max(0, k - cols + 1, -(-(k - band) // 2)), min(rows, k + 1, (k + band) // 2 + 1)
        new[lo] = np.inf
        if lo < hi:
            way, cost = new[lo + 1 : hi + 1], away[: hi - lo]
            np.abs(np.subtract(x[lo:hi], back[cols - 1 - k + lo : cols - 1 - k + hi], out=cost), out=cost)
            np.minimum(np.minimum(older[lo:hi], old[lo:hi], out=way), old[lo + 1 : hi + 1], out=way)
            np.add(way, cost, out=way)
        new[hi + 1 : hi + 2] = np.inf
        ended = np.flatnonzero(last == k)
        out[pairs[ended]] = new[n[ended], ended]
        older, old, new = old, new, older
        if k % 32 == 31 and np.isfinite(limit).any():  # every path crosses one of two neighbouring diagonals
            around = slice(max(0, lo - 1), hi + 2)
            keep = (last > k) & ~(np.fmin(np.fmin.reduce(older[around]), np.fmin.reduce(old[around])) > limit)
            if not keep.any():
                break
            if keep.mean() < 0.7:
                x, back, older, old, new = (a[:, keep] for a in (x, back, older, old, new))
                pairs, n, m, last, limit, away = pairs[keep], n[keep], m[keep], last[keep], limit[keep], away[:, keep]
    return out


def _lots(bands: np.ndarray, size: np.ndarray):  # noqa: ANN202
    """Bands and places of equal ones, as many at once as may be warped together."""
    order = np.lexsort((size, bands))
    for lot in np.split(order, np.flatnonzero(np.diff(bands[order])) + 1):
        while len(lot):
            few = size[lot[:PAIRS]]
            at_once = max(1, int((few * np.arange(1, len(few) + 1) <= LONG).sum()))
            yield int(bands[lot[0]]), lot[:at_once]
            lot = lot[at_once:]


def _distances(xs: list[np.ndarray], x: np.ndarray | None, n: np.ndarray, a: np.ndarray, b: np.ndarray, bands: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The warping distances of pairs of series, which ``x`` holds as columns unless that would be too large."""
    out = np.full(len(a), np.inf)
    if len(a):
        for band, lot in _lots(bands, np.maximum(n[a], n[b])):
            p, q = (_columns([xs[t] for t in i])[0] if x is None else x[: n[i].max(), i] for i in (a[lot], b[lot]))
            out[lot] = _warped(p, q, n[a[lot]], n[b[lot]], band, limit[lot])
    return out


def _bounds(xs: list[np.ndarray], x: np.ndarray | None, n: np.ndarray, a: np.ndarray, b: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """:func:`lower_bound` of pairs of series, that of their ends alone without ``x``; the envelopes of all columns grow with the band."""
    first, ends = (np.array([v[i] for v in xs]) for i in (0, -1))
    out = np.abs(first[a] - first[b]) + np.where((n[a] > 1) | (n[b] > 1), np.abs(ends[a] - ends[b]), 0.0)
    if x is None:
        return out
    low, high, reached = x.copy(), x.copy(), 0
    for band, lot in _lots(bands, np.maximum(n[a], n[b])):
        if band >= len(x) - 1 > reached:
            low, high, reached = np.broadcast_to(np.fmin.reduce(x), x.shape), np.broadcast_to(np.fmax.reduce(x), x.shape), band
        while reached < min(band, len(x) - 1):
            reached += 1
            for near, pick in ((low, np.fmin), (high, np.fmax)):
                pick(near[reached:], x[:-reached], out=near[reached:])
                pick(near[:-reached], x[reached:], out=near[:-reached])
        for i, j in ((a[lot], b[lot]), (b[lot], a[lot])):
            top = n[i].max()
            at = x[:top, i]
            off = np.fmax(at - high[:top, j], low[:top, j] - at)
            out[lot] = np.maximum(out[lot], np.fmax(off, 0).sum(0))
    return out


def banded_many(x: np.ndarray, ys: list[np.ndarray], bands: list[int]) -> np.ndarray:
    """The warping distances of ``x`` and each of ``ys``."""
    n = np.array([len(x), *map(len, ys)])
    return _distances([x, *ys], None, n, np.zeros(len(ys), int), np.arange(1, len(n)), np.array(bands), np.full(len(ys), np.inf))


def path_of(x: np.ndarray, y: np.ndarray, band: int) -> tuple[float, np.ndarray]:
    """Distance and path (rows of two places) within the band; of equal ways the diagonal one, then the one along y."""
    n, m = len(x), len(y)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1, -(-(k - band) // 2)), min(n, k + 1, (k + band) // 2 + 1)
        i = np.arange(lo, hi)
        j = k - i
        cost[i + 1, j + 1] = np.abs(x[i] - y[j]) + np.minimum(np.minimum(cost[i, j], cost[i + 1, j]), cost[i, j + 1])
    at, path = (n, m), []
    while at != (0, 0):
        path.append((at[0] - 1, at[1] - 1))
        i, j = at
        at = min(((i - 1, j - 1), (i, j - 1), (i - 1, j)), key=lambda p: cost[p] if p[0] >= 0 and p[1] >= 0 else np.inf)
    return float(cost[n, m]), np.array(path[::-1])


def quality(path: np.ndarray, n: int, m: int) -> dict[str, float]:
    """Efficiency (the longer series over the path), distortion (mean departure of steps from the diagonal's slope), share of diagonal steps, and a score of 100 at most."""
    step = np.diff(path, axis=0)
    efficiency = max(n, m) / len(path)
    slope = n / m
    actual = np.where(step[:, 1] > 0, step[:, 0] / np.maximum(step[:, 1], 1), slope)
    distortion = float(np.abs(actual - slope).sum() / len(path))
    diagonal = float(((step > 0).all(1)).mean()) if len(step) else 1.0
    return {"path_length": len(path), "efficiency": efficiency, "distortion": distortion, "diagonal": diagonal, "score": min(100.0, 40 * efficiency + 30 * (1 - min(1.0, distortion)) + 30 * diagonal)}


def _kth(far: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row, infinite where there are fewer."""
    return np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] >= k else np.full(len(far), np.inf)


def _nearest(table: pa.Table, k: int, window: int | None) -> pa.Table:
    """The ``k`` nearest among the other side of each series of two blocks; a block that meets itself comes as one side."""
    names, xs = np.array(table[KEY].to_pylist(), object), [np.asarray(v.values, float) for v in table["x"]]
    n = np.array([len(v) for v in xs])
    x = _columns(xs)[0] if n.max() * len(n) <= 2 * POINTS else None
    side = np.asarray(table["asks"])
    asks, held = np.flatnonzero(side), np.flatnonzero(~side)
    alone = len(set(table["q"].to_pylist()) | set(table["c"].to_pylist())) == 1
    if alone:
        held = asks
    p, q = np.triu_indices(len(asks), 1) if alone else (i.ravel() for i in np.indices((len(asks), len(held))))
    a, b = asks[p], held[q]
    bands = np.maximum(np.abs(n[a] - n[b]), n.max() if window is None else window)
    bound = np.full((len(asks), len(held)), np.inf)
    far = np.full((len(asks), len(held)), np.inf)
    rest = np.arange(len(a))
    if len(a):
        bound[p, q] = _bounds(xs, x, n, a, b, bands)
    if alone:
        bound = np.minimum(bound, bound.T)
    place = np.minimum(bound.argsort(1, kind="stable").argsort(1, kind="stable"), bound.argsort(0, kind="stable").argsort(0, kind="stable"))
    tried = np.zeros(len(names), np.int64)
    upto = AT_ONCE
    while len(rest):
        limit = np.maximum(_kth(far, k)[p[rest]], _kth(far.T, k)[q[rest]]) * (1 + 1e-12)
        chosen = bound[p[rest], q[rest]] <= limit
        rest, limit = rest[chosen], limit[chosen]
        now = place[p[rest], q[rest]] < upto
        lot, rest = rest[now], rest[~now]
        far[p[lot], q[lot]] = _distances(xs, x, n, a[lot], b[lot], bands[lot], limit[now])
        if alone:
            far[q[lot], p[lot]] = far[p[lot], q[lot]]
        tried += np.bincount(a[lot], minlength=len(names)) + np.bincount(b[lot], minlength=len(names))
        upto *= 4
    rows = []
    for own, others, d in ((asks, held, far),) if alone else ((asks, held, far), (held, asks, far.T)):
        meets = len(others) - alone
        for s, row, last in zip(own, d, _kth(d, k), strict=True):
            first = sorted((row[o], names[others[o]]) for o in np.flatnonzero((row <= last) & np.isfinite(row)))[:k]
            rows += [(names[s], name, far_off, tried[s] if i == 0 else 0, meets - tried[s] if i == 0 else 0) for i, (far_off, name) in enumerate(first)]
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(((KEY, pa.string()), ("other", pa.string()), ("distance", pa.float64()), ("tried", pa.int64()), ("pruned", pa.int64())))})


def nearest(series: DataFrame, k: int = 3, window: int | None = None) -> DataFrame:
    """The ``k`` nearest other series of each: ``rank``, ``other``, ``distance``, and how many warpings were ``tried`` and ``pruned`` for it."""
    x = arrays_of(series)
    n, points = x.agg(F.count("*"), F.sum(F.size("x"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(points or 0) // POINTS), min(8, n // 64))  # a few dozen groups where there are series enough
    groups = blocks * (blocks + 1) // 2
    own = F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int")
    x = x.withColumn("own", own)
    asks = x.select(KEY, "x", F.lit(True).alias("asks"), F.col("own").alias("q"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("c"))
    held = x.where(F.col("own") > 0).select(KEY, "x", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("q"), F.col("own").alias("c"))
    both = asks.unionByName(held).repartition(min(groups, 4096), "q", "c")
    found = both.groupBy("q", "c").applyInArrow(lambda t: _nearest(t, k, window), f"{KEY} string, other string, distance double, tried long, pruned long")
    order = Window.partitionBy(KEY).orderBy("distance", "other")
    of = Window.partitionBy(KEY)
    t = found.withColumns({"rank": F.row_number().over(order), "all_tried": F.sum("tried").over(of), "all_pruned": F.sum("pruned").over(of)})
    return t.where(F.col("rank") <= k).select(KEY, "rank", "other", "distance", F.col("all_tried").alias("tried"), F.col("all_pruned").alias("pruned"))


def ranking(series: DataFrame, query: str, window: int | None = None) -> DataFrame:
    """All other series by their distance from ``query``, each with its alignment quality; ``confidence`` of the first: how far it is from the mean in deviations, times 20, within 0 and 100."""
    x = arrays_of(series)
    asked = x.where(F.col(KEY) == query).select(F.col("x").alias("q"))  # one row at most

    def run(frames):
        for f in frames:
            rows = []
            for name, a, b in zip(f[KEY], f["q"], f["x"], strict=True):
                a, b = np.asarray(a, float), np.asarray(b, float)
                d, path = path_of(a, b, max(window if window is not None else max(len(a), len(b)), abs(len(a) - len(b))))
                rows.append({KEY: name, "distance": d, **quality(path, len(a), len(b))})
            yield pd.DataFrame(rows, columns=[KEY, "distance", "path_length", "efficiency", "distortion", "diagonal", "score"])

    others = x.where(F.col(KEY) != query).withColumn("q", asked.scalar())
    d = others.where(F.col("q").isNotNull()).mapInPandas(run, f"{KEY} string, distance double, path_length long, efficiency double, distortion double, diagonal double, score double")
    t = d.agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"))
    first = F.row_number().over(Window.orderBy("distance", KEY))
    out = d.withColumn("m", t.select("m").scalar()).withColumn("s", t.select("s").scalar()).withColumn("rank", first)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 20 * (F.col("m") - F.col("distance")) / F.nullif(F.col("s"), F.lit(0.0))))
    return out.select(KEY, "rank", "distance", "path_length", "efficiency", "distortion", "diagonal", "score", F.when(F.col("rank") == 1, sure).alias("confidence"))
