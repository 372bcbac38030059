"""Stream queries read a table that is a folder of files as they read one file."""

import __spark_entry__ as entry
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_late_rows", "stream_dedup_urls", "stream_match_window", "stream_fan_out"])
def test_folder_of_files(spark, tmp_path, name):
    for table in ("documents", "pages", "customer"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    want = sorted(map(tuple, entry.queries()[name](spark, FOLDER).collect()))
    assert want and sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == want
