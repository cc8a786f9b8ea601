"""Points of a surface that stand off the plane of their neighbours."""

from __future__ import annotations

import numpy as np

NEIGHBOURS, THRESHOLD, TRIALS = 12, 0.75, 25


def neighbours(x: np.ndarray, y: np.ndarray, k: int, least: float = 0.0, at_once: int = 256) -> np.ndarray:
    """The ``k`` nearest other points of each that are farther than ``least``, nearest first; -1 where there are fewer."""
    n = len(x)
    out = np.full((n, k), -1)
    order = np.argsort(x, kind="stable")
    xs = x[order]
    reach0 = 1.5 * np.sqrt((k + 4) * max(np.ptp(x), 1e-9) * max(np.ptp(y), 1e-9) / max(n, 1) / np.pi) + least if n else 0.0
    for at in range(0, n, at_once):
        left, reach = order[at : at + at_once], reach0
        while len(left):
            lo, hi = np.searchsorted(xs, [x[left].min() - reach, x[left].max() + reach], side="left")
            near = order[lo : hi + 1]
            d2 = (x[left][:, None] - x[near]) ** 2 + (y[left][:, None] - y[near]) ** 2
            d2[(left[:, None] == near) | (d2 <= least * least)] = np.inf
            some = min(k, len(near))
            best = np.argsort(d2, axis=1, kind="stable")[:, :some]
            dist = np.take_along_axis(d2, best, 1)
            whole = len(near) == n
            done = (dist[:, -1] <= reach * reach) & (some == k) if not whole else np.ones(len(left), bool)
            out[left[done], :some] = np.where(np.isfinite(dist), near[best], -1)[done]
            left, reach = left[~done], 2 * reach + 1e-9
    return out


def trials(k: int) -> np.ndarray:
    """Triples of neighbours that planes are tried on, the same for each point."""
    rng = np.random.default_rng(k)
    return np.array([rng.choice(k, 3, replace=False) for _ in range(TRIALS)])


def off_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int = NEIGHBOURS, threshold: float = THRESHOLD, least: float = 0.0, at_once: int = 4000) -> np.ndarray:
    """Which points lie more than ``threshold`` off the plane that most of their neighbours lie on.

    Of planes through three neighbours the one within three quarters of the
    threshold of most neighbours counts, the first of equals.
    """
    spike = np.zeros(len(x), bool)
    if len(x) < 4:
        return spike
    p, near, triples = np.stack([x, y, z], axis=1), neighbours(x, y, k, least), trials(k)
    for at in range(0, len(x), at_once):
        own = near[at : at + at_once]
        there = own >= 0
        q = p[np.maximum(own, 0)]  # points, neighbours, axes
        a, b, c = (q[:, triples[:, j]] for j in range(3))
        normal = np.cross(b - a, c - a)
        length = np.linalg.norm(normal, axis=2)
        usable = there[:, triples].all(axis=2) & (length > 1e-9)
        normal = normal / np.where(usable, length, 1.0)[..., None]
        offset = (normal * a).sum(axis=2)
        from_plane = np.abs(np.einsum("ptd,pkd->ptk", normal, q) - offset[..., None])
        fit = ((from_plane < 0.75 * threshold) & there[:, None, :]).sum(axis=2)
        best = np.where(usable, fit, -1).argmax(axis=1)
        rows = np.arange(len(own))
        away = np.abs((normal[rows, best] * p[at : at + at_once]).sum(axis=1) - offset[rows, best])
        spike[at : at + at_once] = usable[rows, best] & (away > threshold)
    return spike


def without_spikes(x: np.ndarray, y: np.ndarray, z: np.ndarray, passes: int = 2, **how) -> np.ndarray:
    """Which points stay, after passes in which those found before are no neighbours any more."""
    kept = np.arange(len(x))
    for _ in range(passes):
        kept = kept[~off_plane(x[kept], y[kept], z[kept], **how)]
    out = np.zeros(len(x), bool)
    out[kept] = True
    return out
