"""Point tables, manifests, LAS files, streams and the command line."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora import cli
from arbora.grid import Grid
from arbora.schema import domain, point_schema
from arbora.sources.catalog import PointTable, query_tile, with_attributes
from arbora.sources.las import encode_las, read_header, read_headers, read_las
from arbora.sources.tiles import epsg_of, parse_names, survey_year
from arbora.streaming.ingest import ingest_stream, merge_cells, mergeable_cells, stream_points, windowed_counts


def frame(n=300, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"X": rng.uniform(308000, 310000, n).round(2), "Y": rng.uniform(4688000, 4690000, n).round(2), "Z": rng.uniform(800, 850, n).round(2), "Classification": rng.integers(2, 6, n), "ReturnNumber": np.ones(n, int), "NumberOfReturns": np.ones(n, int) * 2, "Intensity": rng.integers(0, 900, n), "GpsTime": rng.random(n)})


def test_point_table(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    table.create(25830)
    with pytest.raises(ValueError):
        table.create()
    pdf = frame()
    points = spark.createDataFrame(pdf).withColumn("unknown", F.lit(1))
    assert table.ingest("a", points, 2021, 25830, "s") == 300
    assert table.ingest("a", points, 2021, 25830, "s") == 0
    with pytest.raises(ValueError):
        table.ingest("a", points, 2021, 25830, "other")
    with pytest.raises(ValueError):
        table.write(points, 2021, 2154)
    assert table.ingest_many({"b": points.select("X"), "c": points}, 2022) == {"b": -1, "c": 300}
    assert {r["file"]: r["status"] for r in table.manifest().collect()} == {"a": "ok", "b": "failed", "c": "ok"}
    assert [r["file"] for r in table.list_ingested().collect()] == ["a", "c"]
    assert table.available_years() == [2021, 2022] and table.points().count() == 600
    box = (308100.0, 4688200.0, 309000.0, 4689000.0)
    inside = pdf[pdf.X.between(box[0], box[2]) & pdf.Y.between(box[1], box[3])]
    assert table.query_bbox(*box, year=2021).count() == len(inside)
    got = table.query_bbox(*box, attributes=["Z", "Red"], year=2021).collect()
    assert {r["Red"] for r in got} == {0} and got[0].__fields__ == ["X", "Y", "Z", "Red"]
    assert query_tile(table.points(), 308, 4690).count() == 600
    before, revision = sorted(map(tuple, table.points().collect())), table.revision()
    table.optimize()
    assert sorted(map(tuple, table.points().collect())) == before and table.revision() != revision
    table.create(overwrite=True)
    assert table.points().count() == 0 and table.manifest().count() == 0


def test_schema(spark):
    assert domain(28992)[0] == -7000 and domain(1) == domain(2)
    with pytest.raises(ValueError):
        point_schema(("Intensity",))
    with pytest.raises(ValueError):
        point_schema(("Z", "Nope"))
    few = with_attributes(spark.createDataFrame([(1.0, 2.0, 3.0)], "X double, Y double, Z double"), ["Z", "Red"])
    assert few.first()["Red"] == 0
    with pytest.raises(ValueError):
        with_attributes(few, ["Nope"])


def test_las(spark, tmp_path):
    pdf = frame()
    (tmp_path / "PNOA_2021_ARA_308-4690_ORT.las").write_bytes(encode_las(pdf, year=2019, epsg=25830))
    (tmp_path / "empty.las").write_bytes(encode_las(pdf.head(0)))
    head = {r["file"].rsplit("/", 1)[1]: r for r in read_headers(spark, str(tmp_path)).collect()}
    one = head["PNOA_2021_ARA_308-4690_ORT.las"]
    assert (one["n_points"], one["epsg"], one["year"]) == (300, 25830, 2019) and abs(one["max_x"] - pdf.X.max()) < 1e-9
    got = read_las(spark, str(tmp_path), chunk=70).orderBy("X").toPandas()
    want = pdf.sort_values("X", ignore_index=True)
    for c in ("X", "Y", "Z"):
        assert np.allclose(got[c], want[c], atol=1e-6)
    for c in ("Classification", "ReturnNumber", "NumberOfReturns", "Intensity"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all()
    with pytest.raises(ValueError):
        read_header(b"no")
    names = parse_names(read_headers(spark, str(tmp_path)).select("file"), "file").collect()
    box = next(r for r in names if r["year"] == 2021)
    assert (box["min_x"], box["max_y"], box["min_y"], box["region"]) == (308000.0, 4690000.0, 4688000.0, "ARA")
    years = survey_year(spark.createDataFrame([("a_2014_b.las", 2019), ("none.las", 2019), ("none.las", 0)], "f string, h int"), "f", "h").collect()
    assert [r["year"] for r in years] == [2014, 2019, 0]
    assert epsg_of('PROJCS["x",AUTHORITY["EPSG","25830"]]') == 25830 and epsg_of(None) == 0


def test_command_line(spark, tmp_path, capsys):
    file = tmp_path / "a.las"
    file.write_bytes(encode_las(frame(), epsg=25830))
    table = str(tmp_path / "t")
    assert cli.main(["ingest", table, str(file), "-c", "2", "-c", "3"]) == 0
    assert cli.main(["info", table]) == 0
    said = capsys.readouterr().out
    assert "EPSG:25830" in said and PointTable(spark, table).points().where("Classification > 3").count() == 0


def test_one_job_for_many_files(spark, tmp_path, monkeypatch):
    whole, folder = frame(), tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.las").write_bytes(encode_las(whole.iloc[100 * k : 100 * k + 100], epsg=25830))
    (folder / "bad.las").write_bytes(b"no las")
    (folder / "cut.las").write_bytes(encode_las(whole, epsg=25830)[:-10])
    (folder / "other.las").write_bytes(encode_las(whole, epsg=28992))
    table = PointTable(spark, str(tmp_path / "t"))
    out = {k.rsplit("/", 1)[1]: n for k, n in cli.ingest(spark, table, [str(folder)], [], False).items()}
    assert out == {"0.las": 100, "1.las": 100, "2.las": 100, "bad.las": -1, "cut.las": -1, "other.las": -1}
    assert table.points().count() == 300 and table.manifest().where("status = 'failed'").count() == 3
    assert cli.ingest(spark, table, [str(folder)], [], False) and table.points().count() == 300
    # what a job wrote before it was killed isn't read, and a retry adds the points once
    more = table.points().limit(10).withColumn("file", F.lit("late"))
    kept = PointTable._append
    monkeypatch.setattr(PointTable, "_append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.ingest_files(more, ["late"])
    monkeypatch.setattr(PointTable, "_append", kept)
    assert table.points().count() == 300
    assert table.ingest_files(more, ["late", "none"]) == {"late": 10, "none": 0} and table.ingest_files(more, ["late"]) == {"late": 0}
    assert table.points().count() == 310 and table.ingest_files(more, ["late"], fingerprint="x") == {"late": -1}
    table.optimize()
    table.write(more, 2021)
    assert table.points().count() == 320 and table.ingest_files(more, ["late"]) == {"late": 0}
    assert table.vacuum() == 3 and table.points().count() == 320 and table.vacuum() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "t")).create()
    source = str(tmp_path / "in")
    cols = [f"CAST(0 AS {f.dataType.simpleString()}) AS {f.name}" for f in point_schema().fields if f.name not in ("X", "Y", "Z", "Year")]
    rows = spark.range(50).selectExpr("id * 1.0D AS X", "id * 2.0D AS Y", "2021 AS Year", "id * 0.5D AS Z", *cols).select([f.name for f in point_schema().fields])
    for k in range(2):
        rows.coalesce(1).write.mode("append").parquet(source)
        ingest_stream(stream_points(spark, source), table, str(tmp_path / f"c{k}")).awaitTermination()
        assert table.points().count() == 50 * (k + 1)
    grid = Grid.from_bbox(0.0, 0.0, 50.0, 100.0, 10.0)
    whole = mergeable_cells(table.points(), grid)
    parts = mergeable_cells(table.points().where("X < 20"), grid).union(mergeable_cells(table.points().where("X >= 20"), grid))
    assert sorted(map(tuple, merge_cells(parts).collect())) == sorted(map(tuple, merge_cells(whole).collect()))


def test_windows_over_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert out.agg(F.sum("n")).first()[0] == events.count()
