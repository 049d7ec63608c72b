from pyspark.sql import functions as F

from cohortspan.runtime import checkpointed, scratch_path
from cohortspan.sources import schemas
from cohortspan.sources.tables import conform, read_table, write_table


def test_write_read_and_conform(spark):
    path = scratch_path(spark, "out")
    df = spark.range(5).select(F.col("id").cast("string").alias("feature"), (F.col("id") / 2).alias("importance"), F.lit(1).alias("extra"))
    write_table(df, f"{path}/t.parquet")
    write_table(df, f"{path}/t.parquet")
    back = conform(read_table(spark, path, "t"), schemas.IMPORTANCE)
    assert back.schema == schemas.IMPORTANCE and back.count() == 5


def test_checkpoint_layout_keeps_columns_and_rows(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("fold"), "id")
    out = checkpointed(df, ["fold"])
    assert out.columns == ["fold", "id"] and out.schema["fold"].dataType.simpleString() == "int"
    assert out.filter("fold = 1").count() == 33 and out.count() == 100
