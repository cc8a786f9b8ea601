"""Spikes off the plane of their neighbours, against a plain version and on known ground."""

import numpy as np

from arbora.operators import ground, spikes


def plain(x, y, z, k, threshold, least):
    out = []
    for i in range(len(x)):
        d = [(float((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2), j) for j in range(len(x)) if j != i]
        near = [j for s, j in sorted(d) if s > least * least][:k]
        best, away = -1, 0.0
        for t in spikes.trials(k):
            if max(t) >= len(near):
                continue
            a, b, c = (np.array([x[j], y[j], z[j]]) for j in (near[v] for v in t))
            n = np.cross(b - a, c - a)
            if np.linalg.norm(n) <= 1e-9:
                continue
            n = n / np.linalg.norm(n)
            fit = sum(abs(n @ (np.array([x[j], y[j], z[j]]) - a)) < 0.75 * threshold for j in near)
            if fit > best:
                best, away = fit, abs(n @ (np.array([x[i], y[i], z[i]]) - a))
        out.append(best >= 0 and away > threshold)
    return np.array(out)


def test_like_the_plain_version():
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 20, (2, 220))
    z = 0.4 * x + np.where(rng.random(220) < 0.08, rng.uniform(-4, 4, 220), rng.normal(0, 0.1, 220))
    for least in (0.0, 1.0):
        got = spikes.off_plane(x, y, z, least=least)
        assert (got == plain(x, y, z, spikes.NEIGHBOURS, spikes.THRESHOLD, least)).all() and 5 < got.sum() < 40
    few = spikes.off_plane(x[:5], y[:5], z[:5])
    assert (few == plain(x[:5], y[:5], z[:5], spikes.NEIGHBOURS, spikes.THRESHOLD, 0.0)).all()
    assert not spikes.off_plane(x[:3], y[:3], z[:3]).any() and len(spikes.without_spikes(x[:0], y[:0], z[:0])) == 0


def test_neighbours_are_the_nearest():
    rng = np.random.default_rng(5)
    x, y = np.r_[rng.uniform(0, 100, 150), rng.normal(20, 0.5, 300)], np.r_[rng.uniform(0, 5, 150), rng.normal(2, 0.5, 300)]
    got = spikes.neighbours(x, y, 7, 0.3, at_once=64)
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    d[d <= 0.3] = np.inf
    assert np.allclose(np.take_along_axis(d, got, 1), np.sort(d, axis=1)[:, :7])


def test_planted_spikes_leave_and_slopes_stay():
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 60, (2, 1500))
    z = 0.7 * x + 2 * np.sin(y / 9) + rng.normal(0, 0.05, 1500)
    planted = rng.random(1500) < 0.03
    z = z + planted * rng.choice([-3.0, 3.0], 1500)
    kept = spikes.without_spikes(x, y, z)
    assert kept[planted].mean() < 0.05 and kept[~planted].mean() > 0.99


def test_ground_by_triangulation_has_no_spikes():
    rng = np.random.default_rng(7)
    x, y = rng.uniform(0, 60, (2, 2500))
    z = 0.2 * x + rng.normal(0, 0.03, 2500)
    low = np.zeros(2500, bool)
    low[rng.choice(2500, 12, replace=False)] = True
    z = z - 2.5 * low  # low outliers are seeds, as the lowest of their cells
    found = ground.ptd()(x, y, z)
    assert not found[low].any() and found[~low].mean() > 0.9


def test_ground_is_triangulated_as_it_grows(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.uniform(0, 30, (2, 1500)), 2)
    z = x / 16 + np.where(rng.random(1500) < 0.4, 0, np.round(rng.uniform(0, 20, 1500), 2))
    added, plain = [], ground.Mesh.insert
    monkeypatch.setattr(ground.Mesh, "insert", lambda *a: added.append(a[1]) or plain(*a))
    found = ground.ptd()(x, y, z)
    assert found.any() and len(added) <= 2 * found.sum() + 100  # each once, and once more for the last test
