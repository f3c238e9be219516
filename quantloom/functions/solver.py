"""A primal-dual interior-point method for convex quadratic programs, and the portfolio problems put in its form.

    minimize x'Qx / 2 + c'x   subject to   A x = b,  G x <= h
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Solution:
    x: np.ndarray
    converged: bool
    iterations: int


def quadratic_program(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, tol: float = 1e-10, most: int = 100) -> Solution:
    """Mehrotra's predictor-corrector steps on the optimality conditions; infeasible problems do not converge."""
    n, m, p = len(c), len(h), len(b)
    if m == 0:
        kkt = np.block([[q, a.T], [a, np.zeros((p, p))]])
        z = np.linalg.lstsq(kkt, np.concatenate((-c, b)), rcond=None)[0]
        return Solution(z[:n], bool(np.allclose(a @ z[:n], b, atol=1e-8)), 1)
    x = np.linalg.lstsq(np.vstack((a, 1e-3 * np.eye(n))), np.concatenate((b, np.zeros(n))), rcond=None)[0]
    s = np.maximum(h - g @ x, 1.0)
    lam, y = np.ones(m), np.zeros(p)
    scale = 1 + max(np.abs(c).max(initial=0), np.abs(h).max(initial=0), np.abs(b).max(initial=0))
    ridge = 1e-13 * (1 + np.abs(np.diag(q)).max(initial=0))
    for it in range(1, most + 1):
        rd = q @ x + c + a.T @ y + g.T @ lam
        rp, ri = a @ x - b, g @ x + s - h
        mu = s @ lam / m
        if max(np.abs(rd).max(), np.abs(rp).max(initial=0), np.abs(ri).max()) < tol * scale and mu < tol * scale:
            return Solution(x, True, it)
        w = lam / s
        hess = q + (g.T * w) @ g + ridge * np.eye(n)
        kkt = np.block([[hess, a.T], [a, -1e-13 * np.eye(p)]])

        def step(rc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            rhs = np.concatenate((-rd - g.T @ ((-rc + lam * ri) / s), -rp))  # noqa: B023
            try:
                d = np.linalg.solve(kkt, rhs)  # noqa: B023
            except np.linalg.LinAlgError:
                d = np.linalg.lstsq(kkt, rhs, rcond=None)[0]  # noqa: B023
            dx = d[:n]
            ds = -ri - g @ dx  # noqa: B023
            return dx, d[n:], ds, (-rc - lam * ds) / s  # noqa: B023

        def reach(v: np.ndarray, dv: np.ndarray) -> float:
            back = dv < 0
            return min(1.0, float((-v[back] / dv[back]).min())) if back.any() else 1.0

        dx, dy, ds, dl = step(s * lam)
        ap, ad = reach(s, ds), reach(lam, dl)
        sigma = (((s + ap * ds) @ (lam + ad * dl)) / m / mu) ** 3 if mu > 0 else 0.0
        dx, dy, ds, dl = step(s * lam + ds * dl - sigma * mu)
        alpha = min(1.0, 0.995 * min(reach(s, ds), reach(lam, dl)))
        x, y, s, lam = x + alpha * dx, y + alpha * dy, s + alpha * ds, lam + alpha * dl
        if not np.isfinite(x).all() or np.abs(x).max() > 1e12:
            return Solution(np.nan_to_num(x), False, it)
    ok = np.abs(a @ x - b).max(initial=0) < 1e-7 * scale and (g @ x - h).max() < 1e-7 * scale and mu < 1e-6 * scale
    return Solution(x, bool(ok), most)


@dataclass
class Limits:
    """What a portfolio must keep to. Caps are numbers or one per asset; a soft cap costs ``penalty`` times the squared excess."""

    cap: float | np.ndarray | None = None
    soft: bool = False
    penalty: float = 0.001
    groups: np.ndarray | None = None  # assets x groups, hard
    group_cap: float = 0.20
    neutral: np.ndarray | None = None  # assets x exposures that must be zero
    soft_group: np.ndarray | None = None  # membership of one group
    soft_group_cap: float = 0.20
    soft_group_penalty: float = 0.01
    leverage: float | None = None  # gross exposure; None: long only


def _problem(sigma: np.ndarray, mu: np.ndarray | None, target: float | None, lim: Limits, linear: np.ndarray | None):
    """Variables: weights (long, then short if allowed), excesses over soft caps, excess over the soft group cap."""
    n = len(sigma)
    sides = 1 if lim.leverage is None else 2
    signs = np.hstack([np.eye(n)] + ([-np.eye(n)] if sides == 2 else []))  # weights of the variables
    cap = None if lim.cap is None else np.broadcast_to(np.asarray(lim.cap, float), (n,))
    n_soft = n * (1 if sides == 1 else 2) if cap is not None and lim.soft else 0
    n_group = 1 if lim.soft_group is not None else 0
    total = sides * n + n_soft + n_group

    def wide(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), total))
        out[:, : sides * n] = rows
        return out

    w = wide(signs)
    q = np.zeros((total, total))
    q[: sides * n, : sides * n] = 2 * signs.T @ sigma @ signs
    c = np.zeros(total)
    if linear is not None:
        q[:] = 0
        c[: sides * n] = signs.T @ linear
    eq, rhs = [np.ones((1, n)) @ signs], [np.ones(1)]
    if target is not None:
        eq.append(mu[None, :] @ signs)
        rhs.append(np.array([target]))
    if lim.neutral is not None:
        eq.append(np.atleast_2d(lim.neutral.T) @ signs)
        rhs.append(np.zeros(np.atleast_2d(lim.neutral.T).shape[0]))
    a, b = wide(np.vstack(eq)), np.concatenate(rhs)
    g, h = [-np.eye(total)], [np.zeros(total)]
    if cap is not None:
        for side, rows in enumerate([np.eye(n)] if sides == 1 else [np.eye(n), -np.eye(n)]):
            r = wide(rows @ signs)
            if lim.soft:
                at = sides * n + side * n
                r[np.arange(n), at + np.arange(n)] = -1
                q[at + np.arange(n), at + np.arange(n)] += 2 * lim.penalty
            g.append(r)
            h.append(cap)
    if lim.groups is not None:
        for rows in [lim.groups.T] if sides == 1 else [lim.groups.T, -lim.groups.T]:
            g.append(wide(rows @ signs))
            h.append(np.full(len(rows), lim.group_cap))
    if n_group:
        r = wide(lim.soft_group[None, :] @ signs)
        r[0, -1] = -1
        q[-1, -1] += 2 * lim.soft_group_penalty
        g.append(r)
        h.append(np.array([lim.soft_group_cap]))
    if sides == 2:
        r = np.zeros((1, total))
        r[0, : 2 * n] = 1
        g.append(r)
        h.append(np.array([lim.leverage]))
    return q, c, a, b, np.vstack(g), np.concatenate(h), w


def minimum_variance(sigma: np.ndarray, lim: Limits | None = None, mu: np.ndarray | None = None, target: float | None = None) -> tuple[np.ndarray, bool]:
    """Weights of least variance that sum to one within the limits, and whether a solution was found."""
    lim = lim or Limits()
    unit = float(np.diag(sigma).mean()) or 1.0
    scaled = Limits(**{**lim.__dict__, "penalty": lim.penalty / unit, "soft_group_penalty": lim.soft_group_penalty / unit})
    up = 1.0 / max(np.abs(mu).max(), 1e-12) if mu is not None else 1.0
    q, c, a, b, g, h, w = _problem(sigma / unit, None if mu is None else mu * up, None if target is None else target * up, scaled, None)
    found = quadratic_program(q, c, a, b, g, h)
    return _clean(w @ found.x, lim), found.converged


def maximum_return(mu: np.ndarray, lim: Limits | None = None) -> tuple[np.ndarray, bool]:
    """Weights of the greatest return within the limits; soft caps count as hard here."""
    lim = lim or Limits()
    up = 1.0 / max(np.abs(mu).max(), 1e-12)
    hard = Limits(**{**lim.__dict__, "soft": False, "soft_group": None})
    q, c, a, b, g, h, w = _problem(np.eye(len(mu)), None, None, hard, -mu * up)
    found = quadratic_program(q, c, a, b, g, h)
    return _clean(w @ found.x, lim), found.converged


def _clean(w: np.ndarray, lim: Limits) -> np.ndarray:
    if lim.leverage is None:
        w = np.clip(w, 0, None)
        return w / w.sum() if w.sum() > 0 else w
    return w


def frontier_targets(sigma: np.ndarray, mu: np.ndarray, points: int, lim: Limits | None = None) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Equal steps of return from the least-variance portfolio to the greatest return within the limits; that portfolio,
    and whether either end was found."""
    low, ok = minimum_variance(sigma, lim)
    high, ok_high = maximum_return(mu, lim)
    first, last = float(mu @ low), float(mu @ high)
    return np.linspace(first, last if last > first else first + 1e-8, points), low, ok, ok_high


def frontier_point(sigma: np.ndarray, mu: np.ndarray, k: int, target: float, found: tuple[np.ndarray, bool]) -> dict:
    """The figures of the weights ``found`` (weights, converged) for a target."""
    w, good = found
    vol, ret = float(np.sqrt(max(0.0, w @ sigma @ w))), float(mu @ w)
    return {"point": k, "target": float(target), "expected_return": ret, "volatility": vol, "sharpe": ret / vol if vol > 0 else None, "converged": bool(good), "weights": w}


def frontier(sigma: np.ndarray, mu: np.ndarray, points: int, lim: Limits | None = None) -> list[dict]:
    """All points of an efficient frontier, one after another."""
    targets, low, ok, ok_high = frontier_targets(sigma, mu, points, lim)
    solved = [(low, ok) if k == 0 else minimum_variance(sigma, lim, mu, float(t)) for k, t in enumerate(targets)]
    return [frontier_point(sigma, mu, k, t, (w, good and ok_high)) for k, (t, (w, good)) in enumerate(zip(targets, solved, strict=True))]
