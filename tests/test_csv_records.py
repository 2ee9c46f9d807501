"""Quoted CSV cut by many tasks, against Python's own reader and Spark's multi-line reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from newsgauge.sources import tables
from newsgauge.sources.csv_records import csv_records

COLUMNS = ["id", "title", "text", "authors"]


def write(path, rows, header=COLUMNS):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator="\n", doublequote=True)
        writer.writerow(header)
        writer.writerows(rows)


def odd_rows(n, seed=1):
    rnd = random.Random(seed)
    parts = ["word", "\n", '"', ",", "\n\n", "é😀", " ", "'", '""', "x" * 40, "'\"\n"]
    cell = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
    rows = [[str(i), cell(), cell(), cell()] for i in range(n)]
    # One cell over many ranges, full of line breaks and quotes.
    rows[n // 2][2] = 'a "quoted"\nline, ' * 600
    return rows


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_file_is_cut_by_many_tasks(spark, tmp_path, small_ranges):
    path, rows = str(tmp_path / "a.csv"), odd_rows(400)
    write(path, rows)
    records = csv_records(spark, path)
    assert records.rdd.getNumPartitions() > 10
    cells = tables.scan_csv_strings(spark, path, tables.ARTICLE_SCHEMA).select(COLUMNS)
    got = sorted(map(tuple, cells.collect()))
    assert got == sorted(map(tuple, rows))
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    assert got == sorted(map(tuple, whole.select(COLUMNS).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_files_with_different_headers(spark, tmp_path, small_ranges, seed):
    want = []
    for n, header in enumerate([COLUMNS, ["text", "id"], ["authors", "title", "id", "other", "text"], COLUMNS]):
        rows = odd_rows(60, 10 * seed + n)
        write(tmp_path / f"f{n}.csv", [[dict(zip(COLUMNS, r)).get(c, "o") for c in header] for r in rows], header)
        want += [tuple(v if c in header else None for c, v in zip(COLUMNS, r)) for r in rows]
    cells = tables.scan_csv_strings(spark, str(tmp_path), tables.ARTICLE_SCHEMA).select(COLUMNS)
    key = lambda r: tuple(v or "" for v in r)
    assert sorted(map(tuple, cells.collect()), key=key) == sorted(want, key=key)


def test_line_ends_and_empty_lines(spark, tmp_path):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'id,title\r\n1,"a\r\nb"\r\n\r\n2,\r\n3,last')
    cells = tables.scan_csv_strings(spark, str(path), tables.ARTICLE_SCHEMA).select("id", "title")
    assert sorted(map(tuple, cells.collect())) == [("1", "a\nb"), ("2", None), ("3", "last")]
    plain = tables.scan_csv_strings(
        spark, str(path), tables.T.StructType(tables.ARTICLE_SCHEMA.fields[:2]), header=False
    )
    assert ("id", "title") in set(map(tuple, plain.collect())) and plain.count() == 4


def test_odd_number_of_quotes_is_an_error(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('id,title\n1,a "b\n2,c\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        tables.scan_csv_strings(spark, str(path), tables.ARTICLE_SCHEMA).collect()


def test_headers_are_read_by_one_job(spark, tmp_path):
    for n in range(12):
        write(tmp_path / f"f{n}.csv", [[str(n), "t", "x", "y"]])
    spark.sparkContext.setJobGroup("headers", "headers")
    cells = tables.scan_csv_strings(spark, str(tmp_path), tables.ARTICLE_SCHEMA)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    assert jobs < 8 and cells.agg(F.sum("id")).first()[0] == 66
