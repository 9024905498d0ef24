"""Many small image files are listed in a bounded number of tasks."""

from pyspark.sql import functions as F

from quillspark.operators import images
from quillspark.sources import readers

PNG = bytes.fromhex("89504E470D0A1A0A0000000D494844520000002800000014080200000000000000")


def test_many_small_files_are_listed_by_few_tasks(spark, tmp_path):
    for h in range(4):
        (tmp_path / f"House {h}").mkdir()
        for i in range(50):
            (tmp_path / f"House {h}" / f"a b%{i}.png").write_bytes(PNG)
        (tmp_path / f"House {h}" / ".hidden.png").write_bytes(PNG)
    (tmp_path / "loose.png").write_bytes(PNG)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    found = readers.image_folders(spark, str(tmp_path), content=False)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.path for r in found.collect()) == sorted(r.path for r in readers.image_folders(spark, str(tmp_path)).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sized = images.sized(found)
    assert sized.where((F.col("w") == 40) & (F.col("h") == 20)).count() == 200
