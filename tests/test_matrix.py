import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.session import new_path
from newsgauge.sources import matrix
from newsgauge.sources.files import open_place

SCHEMA = "article_id long, embedding array<float>"


def vectors(spark, n, width=5, start=0, parts=4):
    rng = np.random.default_rng(start)
    rows = [(start + i, [float(np.float32(v)) for v in rng.normal(size=width)]) for i in range(n)]
    order = rng.permutation(n)
    return rows, spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(parts)


def read(spark, path, **options):
    return [tuple(r) for r in matrix.scan_matrix(spark, path, **options).orderBy("row").collect()]


def test_round_trip_by_row_ranges(spark):
    rows, df = vectors(spark, 203)
    path = new_path(spark, "matrix")
    matrix.sink_matrix(df, path)
    assert matrix.matrix_shape(path) == (203, 5)
    assert read(spark, path) == [(i, k, v) for i, (k, v) in enumerate(rows)]
    small = matrix.scan_matrix(spark, path, task_bytes=7 * 20)
    assert small.rdd.getNumPartitions() >= 203 // 7
    counts = small.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("row") - F.min("row"))
    assert all(r.n <= 7 and r[2] == r.n - 1 for r in counts.collect())
    assert read(spark, path, task_bytes=7 * 20) == read(spark, path)


def test_files_open_as_memory_maps(spark):
    rows, df = vectors(spark, 50)
    path = new_path(spark, "matrix")
    matrix.sink_matrix(df, path)
    _, place = open_place(path)
    held = json.load(open(f"{place}/manifest.json"))
    parts = [np.memmap(f"{place}/{p}.f32", dtype="<f4", mode="r", shape=(n, 5)) for p, n in held["parts"]]
    assert np.concatenate(parts).tolist() == [v for _, v in rows]


def test_append_and_overwrite(spark):
    first, a = vectors(spark, 20)
    second, b = vectors(spark, 30, start=100)
    path = new_path(spark, "matrix")
    matrix.sink_matrix(a, path, "append")
    matrix.sink_matrix(b, path, "append")
    assert [(k, v) for _, k, v in read(spark, path)] == first + second
    _, wide = vectors(spark, 3, width=6)
    with pytest.raises(Exception, match="rows of 5 numbers, not 6"):
        matrix.sink_matrix(wide, path, "append")
    matrix.sink_matrix(b, path)
    assert [(k, v) for _, k, v in read(spark, path)] == second


def test_nulls_repeats_and_empty_tables(spark):
    path = new_path(spark, "matrix")
    rows = [(3, [1.0, 2.0]), (1, None), (3, [1.0, 2.0]), (2, [float("nan"), 4.0])]
    matrix.sink_matrix(spark.createDataFrame(rows, SCHEMA), path)
    got = read(spark, path)
    assert [(r, k) for r, k, _ in got] == [(0, 1), (1, 2), (2, 3), (3, 3)]
    assert got[0][2] is None and np.isnan(got[1][2][0]) and got[2][2] == got[3][2] == [1.0, 2.0]
    matrix.sink_matrix(spark.createDataFrame([(1, None), (2, None)], SCHEMA), path)
    assert read(spark, path) == [(0, 1, None), (1, 2, None)]
    matrix.sink_matrix(spark.createDataFrame([], SCHEMA), path)
    assert matrix.matrix_shape(path) == (0, 0) and read(spark, path) == []


@pytest.mark.parametrize("bad", [(2, [1.0]), (None, [1.0, 2.0]), (2, [1.0, None])])
def test_faulty_rows_leave_the_matrix_as_it_was(spark, bad):
    rows, df = vectors(spark, 4, width=2)
    path = new_path(spark, "matrix")
    matrix.sink_matrix(df, path)
    with pytest.raises(Exception, match="numbers|no key"):
        matrix.sink_matrix(spark.createDataFrame([(1, [1.0, 2.0]), bad], SCHEMA), path)
    assert [(k, v) for _, k, v in read(spark, path)] == rows


def test_no_matrix_is_a_clear_error(spark):
    with pytest.raises(FileNotFoundError, match="no matrix"):
        matrix.matrix_shape(new_path(spark, "matrix"))


def test_names_of_the_object_store(tmp_path, monkeypatch):
    asked = []

    class Systems:
        class FileSystem:
            from_uri = staticmethod(asked.append)

    monkeypatch.setattr("newsgauge.sources.files.fs", Systems)
    for uri in ("s3a://b/x", "s3n://b/x", "s3://b/x", "hdfs://n/x", "file:/x", f"{tmp_path}/a"):
        open_place(uri)
    assert asked == ["s3://b/x", "s3://b/x", "s3://b/x", "hdfs://n/x", "file:/x", f"{tmp_path}/a"]
