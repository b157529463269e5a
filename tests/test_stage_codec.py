"""Stages hold whole texts: they are written with the denser codec."""

import os

from notedrift.sources import io


def test_stage_is_written_with_zstd(spark, tmp_path):
    path = io.write_stage(spark.createDataFrame([(1, "text"), (2, None)], "id long, note string"), str(tmp_path / "stage"))
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "text"), (2, None)]
