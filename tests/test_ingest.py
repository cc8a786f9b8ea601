"""Stages of ingestion: classes across file borders, context files, systems."""

import numpy as np
import pandas as pd
import pytest

from arbora import cli
from arbora.sources.catalog import PointTable
from arbora.sources.ingest import Stages, ingest_las, lattice
from arbora.sources.las import encode_las


def scene(seed: int = 0) -> pd.DataFrame:
    """Rolling ground every 0.8 m, tufts over it, a bird, and a low outlier; all class 1."""
    rng = np.random.default_rng(seed)
    gx, gy = (v.ravel() + 0.5 for v in np.meshgrid(np.arange(0, 99, 0.8), np.arange(0, 59, 0.8)))
    gz = 100 + 3 * np.sin(gx / 20) + 2 * np.cos(gy / 15)
    vx, vy, up = (np.repeat(rng.uniform(*span, 300), 3) for span in ((1, 99), (1, 59), (1.0, 12.0)))
    vx, vy = vx + np.tile([0.0, 0.2, 0.1], 300), vy + np.tile([0.0, 0.1, 0.2], 300)
    vz = 100 + 3 * np.sin(vx / 20) + 2 * np.cos(vy / 15) + up
    x, y, z = np.r_[gx, vx, 50.2, 20.3], np.r_[gy, vy, 30.1, 20.2], np.r_[gz, vz, 160.0, 60.0]
    return pd.DataFrame({"X": (500_000 + x).round(2), "Y": (4_600_000 + y).round(2), "Z": z.round(2), "Classification": 1, "ReturnNumber": 1, "NumberOfReturns": 1, "Intensity": np.arange(len(x))})


def classes(table: PointTable) -> dict[int, int]:
    return {r["Intensity"]: r["Classification"] for r in table.points().select("Intensity", "Classification").collect()}


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    at, whole = tmp_path_factory.mktemp("split"), scene()
    left = whole.X < 500_050
    (at / "merged_2021.las").write_bytes(encode_las(whole, epsg=25831))
    (at / "a_2021.las").write_bytes(encode_las(whole[left], epsg=25831))
    (at / "b_2021.las").write_bytes(encode_las(whole[~left], epsg=25831))
    return at


STAGES = Stages(ground="smrf", denoise=True, tile=40.0, buffer=15.0)


def test_classes_at_file_borders(spark, split, tmp_path):
    merged, both, later, alone = (PointTable(spark, str(tmp_path / n)) for n in ("m", "b", "l", "s"))
    assert list(ingest_las(spark, merged, [str(split / "merged_2021.las")], STAGES).values()) == [len(scene())]
    want = classes(merged)
    assert {1, 2, 3, 4, 5, 7} >= set(want.values()) >= {2, 4, 5, 7} and want[len(want) - 1] == 7 and want[len(want) - 2] == 7
    two = [str(split / "a_2021.las"), str(split / "b_2021.las")]
    assert sum(ingest_las(spark, both, two, STAGES).values()) == len(scene())
    assert classes(both) == want
    # a file that comes later has its neighbour as context, which isn't stored twice
    assert ingest_las(spark, later, two[:1], STAGES)[two[0]] > 0
    assert ingest_las(spark, later, two, STAGES)[two[0]] == 0
    assert later.points().count() == len(scene())
    x = {r["Intensity"]: r["X"] for r in later.points().select("Intensity", "X").collect()}
    got = classes(later)
    assert all(got[k] == want[k] for k in want if x[k] >= 500_050)
    ingest_las(spark, alone, two[1:], STAGES)
    assert any(c != want[k] for k, c in classes(alone).items())  # without it some would differ
    assert ingest_las(spark, later, two, Stages(ground="pmf")) == dict.fromkeys(two, -1)  # other settings


def test_noise_alone_and_classes(spark, split, tmp_path):
    table = PointTable(spark, str(tmp_path / "t"))
    ingest_las(spark, table, [str(split / "merged_2021.las")], Stages(denoise=True))
    got = classes(table)
    assert set(got.values()) == {1, 7} and got[len(got) - 1] == got[len(got) - 2] == 7
    ground_only = PointTable(spark, str(tmp_path / "g"))
    ingest_las(spark, ground_only, [str(split / "merged_2021.las")], Stages(ground="csf", tile=100.0, classes=(2,)))
    assert set(classes(ground_only).values()) == {2}
    for bad in ({"bounds": (2.0, 1.0, 5.0)}, {"buffer": -1.0}, {"source": ()}, {"source": (256,)}, {"ground": "none"}):
        with pytest.raises(ValueError):
            Stages(**bad)
    assert Stages().fingerprint == Stages().fingerprint != Stages(buffer=1.0).fingerprint
    assert lattice(table.points().limit(0), 10.0) is None


def test_systems(spark, tmp_path):
    whole = scene()
    for name, epsg in (("none", 0), ("own", 25831), ("other", 25830)):
        (tmp_path / f"{name}_2017.las").write_bytes(encode_las(whole.head(100), epsg=epsg))
    names = {n: str(tmp_path / f"{n}_2017.las") for n in ("none", "own", "other")}
    table = PointTable(spark, str(tmp_path / "t")).create(25831)
    assert ingest_las(spark, table, [names["none"], names["other"]]) == {names["none"]: 100, names["other"]: -1}
    entry = {r["file"]: r for r in table.manifest().collect()}
    assert entry[names["none"]]["status"] == "ok" and "25830" in entry[names["other"]]["message"] and table.epsg == 25831
    ingest_las(spark, table, [names["none"]], overwrite=True)
    assert table.epsg == 25831 and table.points().count() == 100
    moved = PointTable(spark, str(tmp_path / "moved"))
    assert ingest_las(spark, moved, [names["own"], names["other"]], Stages(reproject=25831)) == {names["own"]: 100, names["other"]: 100}
    assert moved.epsg == 25831
    low = moved.points().selectExpr("X < 400000 AS moved").groupBy("moved").count().collect()
    assert sorted(r["count"] for r in low) == [100, 100]


def test_command_line(spark, split, tmp_path, capsys):
    table = str(tmp_path / "t")
    assert cli.main(["ingest", table, str(split / "[ab]_2021.las"), "--ground", "smrf", "--denoise", "--tile", "40", "--buffer", "15"]) == 0
    assert "failed" not in capsys.readouterr().out
    assert PointTable(spark, table).points().where("Classification = 2").count() > 500
