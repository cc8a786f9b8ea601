"""Outliers by neighbours in space against all pairs; crowded points are settled without pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import filters, near

SCHEMA = "id long, X double, Y double, Z double"


def cloud(seed: int, n: int, repeats: int = 1) -> np.ndarray:
    """Points of uneven density with strays, some positions several times."""
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.uniform(0, 30, (n, 3)), rng.normal(10, 0.5, (n // 2, 3)), [[300.0, 0, 0], [301.0, 0, 0], [0, -500.0, 90.0]]])
    return np.repeat(np.round(p, 2), repeats, axis=0)


def frame(spark, p):
    rows = [(k, *map(float, v)) for k, v in enumerate(p)]
    return spark.createDataFrame([*rows, (-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)], SCHEMA)


def distances(p):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)


@pytest.mark.parametrize(("n", "repeats", "k"), [(500, 1, 8), (150, 6, 8), (4, 1, 20)])
def test_mean_distances_equal_all_pairs(spark, n, repeats, k):
    p = cloud(n, n, repeats)
    found = {r["__key"]: r["__d"] for r in near.mean_distances(frame(spark, p), "id", k).collect()}
    want = np.where(np.isfinite(d := distances(p)[:, :k]), d, np.nan)
    assert sorted(found) == list(range(len(p)))
    assert np.allclose([found[i] for i in range(len(p))], np.nanmean(want, axis=1), rtol=1e-12, atol=1e-12)


def test_mean_distances_of_few(spark):
    assert near.mean_distances(frame(spark, np.zeros((0, 3))), "id", 8).count() == 0
    assert near.mean_distances(frame(spark, np.zeros((1, 3))), "id", 8).count() == 0
    assert [r["__d"] for r in near.mean_distances(frame(spark, np.array([[0, 0, 0], [3.0, 4.0, 0]])), "id", 8).collect()] == [5.0, 5.0]


@pytest.mark.parametrize(("radius", "least"), [(1.0, 2), (3.0, 5)])
def test_lonely_points_equal_all_pairs(spark, radius, least):
    p = cloud(3, 400)
    found = {r["id"] for r in filters.radius_outliers(frame(spark, p), "id", radius, least).collect()}
    lonely = set(np.flatnonzero((distances(p) <= radius).sum(axis=1) < least).tolist())
    assert found == lonely | {-1, -2} and 5 < len(lonely) < len(p)


def test_crowded_points_meet_none(spark, monkeypatch):
    met, plain = [], filters.written

    def watched(df):
        out = plain(df)
        met.append(out.count())
        return out

    monkeypatch.setattr(filters, "written", watched)
    crowd = spark.range(5000).select("id", *[(F.rand(k) + 0.0).alias(c) for k, c in enumerate("XYZ")])
    assert filters.radius_outliers(crowd, "id", 2.0, 2).count() == 0 and met[1] == 0
