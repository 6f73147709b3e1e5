"""Files that a write makes."""

from mnemora.sources.catalog import Catalog
from pyspark.sql import functions as F


def test_o14_a_file_per_tenant(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("e"), "id").alias("experience_id"), F.concat(F.lit("user"), F.col("id") % 5).alias("agent_name"))
    catalog = Catalog(spark, str(tmp_path / "m"))
    catalog.save("experiences", rows)
    assert catalog.load("experiences").count() == 400
    assert len(list((tmp_path / "m" / "experiences").rglob("*.parquet"))) == 5
