"""NumPy kernels for what SQL expresses badly: non-negative Lasso, p-values."""

from __future__ import annotations

import math

import numpy as np


def nn_lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, max_iter: int = 10_000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Coordinate descent for min 1/(2n) |y - xw - b|^2 + alpha |w|_1 with w >= 0. Returns (w, b)."""
    mean_x, mean_y = x.mean(axis=0), y.mean()
    a, r = x - mean_x, y - mean_y
    w, scale, n = np.zeros(x.shape[1]), (a * a).sum(axis=0), len(y)
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            new = max(0.0, (a[:, j] @ r + w[j] * scale[j] - n * alpha) / scale[j])
            if new != w[j]:
                r = r - a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tol:
            break
    return w, float(mean_y - mean_x @ w)


def nn_lassos(a: np.ndarray, r: np.ndarray, n: np.ndarray, alpha: float = 0.1, max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """w (columns, problems) of `nn_lasso` for many problems: a (columns, rows, problems) and r (rows, problems) are centred and filled up with zeros, n is the number of rows. Each stops by its own steps."""
    w, scale = np.zeros((a.shape[0], a.shape[2])), (a * a).sum(axis=1)
    out, left, going = np.zeros_like(w), np.arange(a.shape[2]), np.ones(a.shape[2], dtype=bool)
    r, limit = r.copy(), n * alpha
    over = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)
    for _ in range(max_iter):
        moved = np.zeros(len(left))
        for j in range(len(a)):
            step = (a[j] * r).sum(axis=0)
            step += w[j] * scale[j]
            step -= limit
            step *= over[j]
            np.maximum(step, 0.0, out=step)
            step -= w[j]
            if step.any():
                r -= a[j] * step
                w[j] += step
                np.maximum(moved, np.abs(step, out=step), out=moved)
        ended = going & (moved <= tol)
        if ended.any():
            out[:, left[ended]] = w[:, ended]
            going &= ~ended
            if not going.any():
                return out
            if going.sum() < 0.7 * len(going):  # the others are left behind
                a, r, w, scale, over, limit, left = np.ascontiguousarray(a[:, :, going]), r[:, going].copy(), w[:, going].copy(), scale[:, going].copy(), over[:, going].copy(), limit[going], left[going]
                going = np.ones(len(left), dtype=bool)
    out[:, left[going]] = w[:, going]
    return out


def pair_correlations(e: np.ndarray, t: np.ndarray, x: np.ndarray, missing: np.ndarray, piece: np.ndarray | None = None, keep: str = "all") -> tuple[np.ndarray, ...]:
    """(a, b, r, n) of pairs of members a < b: entry k is x[k] of member e[k] at place t[k], or missing.

    n is the number of places that both have and `keep` takes, negative where r is undefined; pairs without one go. An
    entry that comes several times meets each of the other's. With `piece`, only members of different pieces meet.
    """
    size, width = int(e.max()) + 1, int(t.max()) + 1
    order = np.lexsort((t, e))
    spot = e[order] * width + t[order]
    first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
    copy = np.empty(len(e), dtype=int)
    copy[order] = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
    copies = int(copy.max()) + 1
    v, there, known = np.zeros((size, width, copies)), np.zeros((size, width, copies), dtype=bool), np.zeros((size, width, copies), dtype=bool)
    v[e, t, copy], there[e, t, copy], known[e, t, copy] = x, True, ~missing

    def left(m: np.ndarray) -> np.ndarray:
        return np.repeat(m, copies, axis=2).reshape(size, -1)

    def right(m: np.ndarray) -> np.ndarray:
        return np.tile(m, (1, 1, copies)).reshape(size, -1)

    if keep == "all" and copies == 1 and known.all() and np.isfinite(v).all():
        v = v[:, :, 0]
        mean = v.mean(axis=1)
        centred = v - mean[:, None]
        std = np.sqrt((centred * centred).mean(axis=1))
        flat = std <= 1e-9 * (1.0 + np.abs(mean))
        unit = centred / np.where(flat, 1.0, std * np.sqrt(width))[:, None]
        a, b = np.triu_indices(size, 1)
        if piece is not None:
            met = piece[a] != piece[b]
            a, b = a[met], b[met]
        return a, b, (unit @ unit.T)[a, b], np.where(flat[a] | flat[b], -width, width)
    va, vb, ta, tb, ka, kb = left(v), right(v), left(there), right(there), left(known), right(known)
    na, nb = ka & (va != 0), kb & (vb != 0)
    found = []
    for i in range(size - 1):
        j = np.arange(i + 1, size) if piece is None else i + 1 + np.flatnonzero(piece[i + 1 :] != piece[i])
        met = ta[i] & tb[j]
        met &= {"all": True, "both": na[i] & nb[j], "any": na[i] | nb[j]}[keep]
        n = met.sum(axis=1)
        both = met & ka[i] & kb[j]
        count = np.maximum(both.sum(axis=1), 1)[:, None]
        p, q = np.where(both, va[i], 0.0), np.where(both, vb[j], 0.0)
        mp, mq = p.sum(axis=1, keepdims=True) / count, q.sum(axis=1, keepdims=True) / count
        p, q = np.where(both, p - mp, 0.0), np.where(both, q - mq, 0.0)
        sp, sq = np.sqrt((p * p).sum(axis=1) / count[:, 0]), np.sqrt((q * q).sum(axis=1) / count[:, 0])
        flat = (sp <= 1e-9 * (1.0 + np.abs(mp[:, 0]))) | (sq <= 1e-9 * (1.0 + np.abs(mq[:, 0]))) | ~both.any(axis=1)
        r = (p * q).sum(axis=1) / count[:, 0] / np.where(flat, 1.0, sp * sq)
        some = n > 0
        found.append((np.full(some.sum(), i), j[some], r[some], np.where(flat, -n, n)[some]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    return tuple(np.concatenate(c) for c in zip(*found))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows centred and scaled to length 1, which of them vary); those that do not vary are 0."""
    if not x.size:
        return x, np.zeros(len(x), dtype=bool)
    mean = x.mean(axis=1, keepdims=True)
    centred = x - mean
    length = np.sqrt((centred * centred).sum(axis=1))
    varies = ~(length <= np.sqrt(x.shape[1]) * 1e-9 * (1 + np.abs(mean[:, 0])))
    return np.where(varies[:, None], centred / np.where(varies, length, 1.0)[:, None], 0.0), varies


def squared_pairs(unit: np.ndarray) -> np.ndarray:
    """Ascending squares of the products of all pairs of different rows, each pair in both orders."""
    square = (unit @ unit.T)[np.tril_indices(len(unit), -1)] ** 2
    return np.repeat(np.sort(square), 2)


def matrix_features(x: np.ndarray, p: np.ndarray, observed: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, ...]:
    """(squared correlations of rows, of observed columns, each row's correlation with p, its number of entries but 0); the last two without `pairs`."""
    unit, varies = unit_rows(x)
    own, known = unit_rows(p[None, :])
    c, n = unit @ own[0] if known[0] else np.zeros(len(x)), (x != 0).sum(axis=1).astype(float)
    if not pairs:
        return c, n
    across, across_varies = unit_rows(x.T[observed])
    return squared_pairs(unit[varies]), squared_pairs(across[across_varies]), c, n


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz, for arrays."""
    tiny, c = 1e-300, np.ones_like(x)
    guarded = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    d = 1.0 / guarded(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / guarded(1.0 + term * d)
            c = guarded(1.0 + term / c)
            out *= c * d
        if (np.abs(c * d - 1.0) < 1e-15).all():
            break
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays with 0 < x < 1."""
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
    part = front * _beta_fraction(p, q, y) / p
    return np.where(low, part, 1 - part)


def pearson_pvalue(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-tailed p of Pearson correlations; NaN for n <= 2, 0 at r = 1 or -1."""
    r, n = np.broadcast_arrays(np.asarray(r, dtype=float), np.asarray(n, dtype=float))
    out = np.full(r.shape, np.nan)
    out[(n > 2) & (np.abs(r) >= 1)] = 0.0
    out[(n > 2) & (r == 0)] = 1.0
    some = (n > 2) & (np.abs(r) < 1) & (r != 0)
    df = n[some] - 2
    if some.any():
        out[some] = incomplete_beta(df / 2, np.full(len(df), 0.5), 1 - r[some] ** 2)
    return out
