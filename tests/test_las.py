"""LAS files by ranges: partitions, pruning, pushed filters, large offsets, the sink."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.sources import las
from arbora.sources.files import Ranges, listed


def frame(n: int, x0: float, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(x0, x0 + 1000, n)).round(2)
    return pd.DataFrame({"X": x, "Y": rng.uniform(0, 100, n).round(2), "Z": rng.uniform(0, 9, n).round(2), "Classification": np.where(np.arange(n) < n // 2, 2, 5), "ReturnNumber": 1, "NumberOfReturns": 2, "Intensity": rng.integers(0, 900, n), "GpsTime": rng.random(n)})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("las")
    for k in range(3):
        (at / f"t{k}.las").write_bytes(las.encode_las(frame(5000, 1000.0 * k, k), epsg=25830))
    (at / "notes.txt").write_text("no points")
    return at


def test_a_file_is_many_partitions(spark, folder):
    las.register(spark)
    whole = spark.read.format("las").option("chunk", 700).load(str(folder / "t0.las"))
    assert whole.rdd.getNumPartitions() == 8 and whole.count() == 5000
    other = las.read_las(spark, str(folder / "t0.las"), chunk=700)
    assert sorted(map(tuple, other.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    sizes = other.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) > 3


def test_headers_read_little(spark, folder):
    for path, _ in listed([str(folder)], las.SUFFIXES):
        with Ranges(path) as read:
            head = las.header_by(read)
            assert head["n_points"] == 5000 and head["epsg"] == 25830 and read.bytes_read < 1024
    assert [r["n_points"] for r in las.read_headers(spark, str(folder)).collect()] == [5000] * 3
    assert len(listed([str(folder / "t[01].las"), str(folder / "t1.las")], las.SUFFIXES)) == 2
    with pytest.raises(FileNotFoundError):
        listed([str(folder / "none.las")], las.SUFFIXES)


def test_box_and_classes_prune(spark, folder):
    box = (1100.0, 0.0, 1200.0, 50.0)
    every = pd.concat([frame(5000, 1000.0 * k, k) for k in range(3)])
    want = every[every.X.between(box[0], box[2]) & every.Y.between(box[1], box[3])]
    las.register(spark)
    source = spark.read.format("las").option("chunk", 700).option("box", ",".join(map(str, box))).option("columns", "X,Y,Classification").load(str(folder))
    assert source.rdd.getNumPartitions() == 8  # the other two files miss the box
    assert source.columns == ["X", "Y", "Classification"] and source.count() == len(want)
    index = las.index_las(spark, str(folder), chunk=500).cache()
    assert index.count() == 30 and index.agg(F.sum("n")).first()[0] == 15000
    assert {tuple(r["classes"]) for r in index.collect()} == {(2,), (5,)}
    got = las.read_las(spark, index=index, box=box, columns=("X", "Y", "file"))
    assert got.count() == len(want)
    met = index.where((F.col("max_x") >= box[0]) & (F.col("min_x") <= box[2])).count()
    assert met <= 3
    few = las.read_las(spark, index=index, box=(0.0, 0.0, 3000.0, 100.0), classes=(5,), columns=("X", "Classification"))
    assert few.count() == 7500 and few.where("Classification != 5").count() == 0
    assert las.read_las(spark, index=index, classes=()).count() == 0


def test_pushed_comparisons(spark, folder):
    las.register(spark)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("las").option("pushdown", "true").option("chunk", 1000).load(str(folder))
        some = df.where("X >= 2100 AND X < 2200 AND Classification IN (2, 3)")
        assert some.rdd.getNumPartitions() == 5
        want = frame(5000, 2000.0, 2)
        assert some.count() == len(want[(want.X >= 2100) & (want.X < 2200) & (want.Classification == 2)])
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_points_beyond_two_gigabytes(spark, tmp_path):
    data = las.encode_las(frame(10, 0.0))
    far = 3_000_000_000
    with open(tmp_path / "far.las", "wb") as f:
        head = bytearray(data[:375])
        struct.pack_into("<I", head, 96, far)
        f.write(head)
        f.seek(far)
        f.write(data[375:])
    assert las.read_las(spark, str(tmp_path / "far.las")).count() == 10


def test_damaged_files_are_named(spark, tmp_path):
    (tmp_path / "cut.las").write_bytes(las.encode_las(frame(100, 0.0))[:-9])
    whole = las.encode_las(frame(100, 0.0))
    (tmp_path / "packed.laz").write_bytes(whole[:104] + bytes([whole[104] | 128]) + whole[105:])
    (tmp_path / "none.las").write_bytes(b"")
    heads = {r["file"].rsplit("/", 1)[1]: r["error"] for r in las.read_headers(spark, str(tmp_path)).collect()}
    assert heads["cut.las"] == "cut short" and heads["none.las"] == "no LAS file" and heads["packed.laz"] == "compressed"
    with pytest.raises(Exception, match="cut short"):
        las.read_las(spark, str(tmp_path / "cut.las")).count()


def test_written_files_come_back(spark, tmp_path):
    pdf = frame(3000, 308000.0, 4).assign(Red=7, Withheld=1, Overlap=1, ScanAngleRank=-12, EdgeOfFlightLine=1, PointSourceId=900, UserData=3)
    df = spark.createDataFrame(pdf).repartition(3)
    las.write_las(df, str(tmp_path / "out"), epsg=25830, scale=0.001, year=2017)
    heads = las.read_headers(spark, str(tmp_path / "out")).collect()
    assert len(heads) == 3 and {h["epsg"] for h in heads} == {25830} and {h["version"] for h in heads} == {"1.4"} and sum(h["n_points"] for h in heads) == 3000
    back = las.read_las(spark, str(tmp_path / "out")).orderBy("X", "Y").toPandas()
    want = pdf.sort_values(["X", "Y"], ignore_index=True)
    assert (back.Year == 2017).all() and np.allclose(back[["X", "Y", "Z"]], want[["X", "Y", "Z"]], atol=1e-6)
    for c in ("Classification", "Intensity", "GpsTime", "Red", "Withheld", "Overlap", "ScanAngleRank", "EdgeOfFlightLine", "PointSourceId", "UserData"):
        assert (back[c].to_numpy() == want[c].to_numpy()).all(), c
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".p") and p.suffix == ".las"]
    with pytest.raises(Exception, match="missing"):
        las.write_las(df.drop("Z"), str(tmp_path / "bad"))
