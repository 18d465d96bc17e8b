from __future__ import annotations

from wrenchlight.session import INITIAL_PARTITIONS, folder_bytes, initial_partitions, prepare, shared_folder


def test_scratch_data_goes_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(base + "/x-") and first != second


def test_folder_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"12345")
    assert folder_bytes(spark, str(tmp_path)) == 5 and folder_bytes(spark, str(tmp_path / "none")) == 0


def test_large_clusters_start_with_many_partitions(spark):
    assert initial_partitions(4000, 200) == 12_000
    assert initial_partitions(8, 200) is None
    # 100 TB: partitions of 256 MB, whatever the number of cores.
    assert initial_partitions(1000, 200, 100 << 40) == 409_600
    assert initial_partitions(8, 200, 10 << 30) is None
    prepare(spark)
    assert spark.conf.get(INITIAL_PARTITIONS, None) is None
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
