"""Archives as a data source, and streams of runs that are cut and started again."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from explorium.plans import models as M
from explorium.sources import archive_source as S
from explorium.sources import archives as R
from explorium.streaming import consumers as C

KINDS = {"s": "ScalarOutcome", "t": "TimeSeriesOutcome", "a": "ArrayOutcome"}
SCHEMA = "experiment_id long, x double, y long, z boolean, q string, s double, t array<double>, a array<array<double>>"


def rows(n):
    return [(i, i / 7, i, i % 2 == 0, f"text, {i}\nmore", i / 3, [float(i), i / 9], [[float(i), 1.0], [2.0, i / 11]]) for i in range(n)]


@pytest.fixture
def source(spark):
    spark.dataSource.register(S.ArchiveSource)
    return spark


def test_round_trip(source, tmp_path, monkeypatch):
    df = source.createDataFrame(rows(2500), SCHEMA).repartition(3)
    path = str(tmp_path / "runs")
    df.write.format("run_archives").option("outcomes", json.dumps(KINDS)).mode("append").save(path)
    assert len(os.listdir(path)) == 4 and not os.listdir(path + "/_temporary")  # three archives, and the emptied scratch
    for parts in (1, 3):
        back = source.read.format("run_archives").option("parts", parts).load(path)
        assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == rows(2500)
    df.limit(5).write.format("run_archives").option("outcomes", json.dumps(KINDS)).mode("overwrite").save(path)
    assert source.read.format("run_archives").load(path).count() == 5


def test_archives_of_others_and_missing_values(source, tmp_path):
    some = [(i, None if i == 1 else 0.5 * i, None if i == 2 else f"q{i}", None if i == 1 else 1.5 * i, [float(i), float(i + 1)]) for i in range(4)]
    df = source.createDataFrame(some, "experiment_id long, x double, q string, s double, t array<double>")
    one = str(tmp_path / "one.tar.gz")
    R.save_archive(df, {"s": "ScalarOutcome", "t": "TimeSeriesOutcome"}, one)
    assert sorted(map(tuple, source.read.format("run_archives").option("parts", 2).load(one).collect())) == some
    two = str(tmp_path / "two")
    df.coalesce(1).write.format("run_archives").option("outcomes", '{"s": "ScalarOutcome"}').mode("append").save(two)
    assert sorted(map(tuple, source.read.format("run_archives").load(two).collect())) == some
    os.mkdir(tmp_path / "both")
    for k in "ab":
        os.link(one, tmp_path / "both" / f"{k}.tar.gz")
    with pytest.raises(Exception, match="experiment_id of their own"):
        source.read.format("run_archives").load(str(tmp_path / "both")).collect()
    df.where("false").write.format("run_archives").mode("append").save(str(tmp_path / "none"))
    with pytest.raises(Exception, match="no archive"):
        source.read.format("run_archives").load(str(tmp_path / "none")).collect()


def test_a_failed_write_leaves_nothing(source, tmp_path):
    path = str(tmp_path / "runs")
    bad = source.createDataFrame(rows(100), SCHEMA).repartition(4).withColumn("s", F.when(F.col("y") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("run_archives").option("outcomes", json.dumps(KINDS)).mode("append").save(path)
    assert [f for f in os.listdir(path) if f.endswith(".tar.gz")] == [] and os.listdir(path + "/_temporary") == []


def test_pieces_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 40)
    writer = S.ArchiveWriter(str(tmp_path), _schema(), KINDS, False)
    done = writer.write(iter(rows(100)))
    writer.commit([done, None])
    assert len(done.names) == 3
    got = []
    for name in done.names:
        with S.Archive(f"{tmp_path}/{name}") as a:
            got += a.rows(a.schema(a.metadata()), 0, 1)
    assert got == rows(100)
    with pytest.raises(Exception, match="share an archive"):
        writer.write(iter([rows(1)[0], (*rows(1)[0][:6], [1.0], [[1.0]])]))
    assert np.isnan(S._shaped([None, [1.0]], 1)[0]).all()


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMA)


def _model(folder):
    def f(x):
        with open(f"{folder}/calls", "a") as out:
            out.write(f"{int(x)}\n")
        return {"y": 2 * x}

    return M.Model("twice", [M.Outcome("y")], f)


def test_a_cut_stream_goes_on(spark, tmp_path):
    model, root, seen = _model(tmp_path), str(tmp_path / "root"), []
    design = spark.range(100).select(F.col("id").alias("experiment_id"), F.col("id").cast("double").alias("x"))

    def breaks(df, k):
        if k == 1 and "cut" not in seen:
            seen.append("cut")
            raise RuntimeError("killed")
        seen.append((k, df.count()))

    with pytest.raises(StreamingQueryException):
        C.run_whole(model, design, root, consumer=breaks)
    assert [k for k, _ in [s for s in seen if s != "cut"]] == [0]
    runs = C.run_whole(model, design, root, consumer=breaks)
    assert sorted((r.experiment_id, r.y) for r in runs.collect()) == [(i, 2.0 * i) for i in range(100)]
    handed = [s for s in seen if s != "cut"]
    assert [k for k, _ in handed] == [0, 1, 2, 3] and sum(n for _, n in handed) == 100
    assert sorted(map(int, open(tmp_path / "calls").read().split())) == list(range(100))  # once a design
    again = C.run_whole(model, design, root, consumer=breaks)
    assert again.count() == 100 and len([s for s in seen if s != "cut"]) == 4


def test_a_batch_cut_while_it_was_written(spark, tmp_path):
    """Runs without the mark of a whole batch are written over; a whole batch isn't run again."""
    model, root = _model(tmp_path), str(tmp_path / "root")
    design = spark.range(10).select(F.col("id").cast("double").alias("x"))
    C.run_whole(model, design, root, files=1)
    os.remove(f"{root}/checkpoint/commits/0")
    os.remove(f"{root}/checkpoint/commits/.0.crc")
    C.run_whole(model, design, root, files=1)
    assert len(open(tmp_path / "calls").read().split()) == 10
    os.remove(f"{root}/checkpoint/commits/0")
    os.remove(f"{root}/checkpoint/commits/.0.crc")
    os.remove(f"{root}/runs/batch=0/_SUCCESS")
    assert C.run_whole(model, design, root, files=1).count() == 10
    assert len(open(tmp_path / "calls").read().split()) == 20


def test_progress_is_told(spark, tmp_path):
    told = []
    listener = C.Progress(lambda k, n: told.append((k, n)))
    spark.streams.addListener(listener)
    try:
        C.run_whole(_model(tmp_path), spark.range(30).select(F.col("id").cast("double").alias("x")), str(tmp_path / "root"), files=2)
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [k for k, _ in told] == sorted({k for k, _ in told}) and told[-1][1] == 30
