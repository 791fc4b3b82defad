"""Numbered files: names, order, folders, failed tasks and failed jobs."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import numbered as N, records as R


def listing(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def text_rows(spark, n, seed=1):
    data = [(i * 7, f"line {i}") for i in range(n)]
    random.Random(seed).shuffle(data)
    return spark.createDataFrame(data, "o long, line string").repartition(5)


@pytest.mark.parametrize("n, lines, width", [(103, 10, 50), (100, 10, 1 << 20), (7, 1, 3), (5, 100, 8)])
def test_names_and_order(spark, tmp_path, n, lines, width):
    path = str(tmp_path / "out")
    N.write_numbered(text_rows(spark, n), path, "o", lines, "part-{}.txt", width=width)
    files = -(-n // lines)
    assert listing(path) == ["_SUCCESS"] + [f"part-{i:04d}.txt" for i in range(files)]
    for i in range(files):
        with open(f"{path}/part-{i:04d}.txt") as f:
            assert f.read() == "".join(f"line {j}\n" for j in range(i * lines, min(n, (i + 1) * lines)))


def test_folders_and_codec(spark, tmp_path):
    path = str(tmp_path / "out")
    N.write_numbered(text_rows(spark, 25), f"file:{path}", "o", 4, "x", files_per_folder=3, codec="gzip")
    assert listing(path) == [f"{i // 3:04d}/x{i:04d}.gz" for i in range(7)] + ["_SUCCESS"]
    assert gzip.open(f"{path}/0002/x0006.gz").read() == b"line 24\n"
    with pytest.raises(Exception, match="not empty"):
        N.write_numbered(text_rows(spark, 5), path, "o", 4)


def test_nulls_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    N.write_numbered(text_rows(spark, 5).where("o < 0"), path, "o", 4)
    assert listing(path) == ["_SUCCESS"]
    some = spark.createDataFrame([(2, None), (1, "é")], "o long, line string")
    N.write_numbered(some, str(tmp_path / "some"), "o", 9)
    assert open(tmp_path / "some" / "0000.txt", encoding="utf-8").read() == "é\n\n"
    bad = spark.createDataFrame([(None, "x")], "o long, line string")
    with pytest.raises(Exception, match="o is NULL"):
        N.write_numbered(bad, str(tmp_path / "bad"), "o", 9)


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = text_rows(spark, 60).withColumn("line", F.when(F.col("o") == 7 * 41, F.raise_error(F.lit("broken row"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken row"):
        N.write_numbered(rows, path, "o", 10)
    assert not os.path.exists(path) or listing(path) == []


def test_files_of_a_lost_attempt_are_not_published(tmp_path):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"number": [0, 0, 1], "line": ["a", "b", "c"]})

    def broken():
        yield batch
        raise RuntimeError("executor lost")

    writer = N.NumberedWriter({"path": str(tmp_path), "name": "{}", "perfolder": "0", "job": "j"})
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert len(listing(tmp_path)) == 2
    writer.commit([writer.write(iter([batch])), None])
    assert listing(tmp_path) == ["0000", "0001", "_SUCCESS"]
    assert open(tmp_path / "0000").read() == "a\nb\n"
    aborted = N.NumberedWriter({"path": str(tmp_path / "x"), "name": "{}", "perfolder": "0", "job": "j"})
    aborted.abort([aborted.write(iter([batch]))])
    assert listing(tmp_path / "x") == []


def test_written_files_read_back_in_order(spark, tmp_path):
    reads = spark.createDataFrame([(i, f"@r{i}\nacgt\n+\nIIII") for i in range(50)], "o long, line string")
    N.write_numbered(reads, str(tmp_path / "fq"), "o", 8, "s_{}.fastq", codec="gzip")
    got = R.read_fastq(spark, str(tmp_path / "fq"), "*.fastq.gz").orderBy("file", "record").select("name").collect()
    assert [r.name for r in got] == [f"r{i}" for i in range(50)]
