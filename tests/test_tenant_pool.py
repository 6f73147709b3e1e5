"""Writes of many tenants at once, and a quota that is an agent's."""

import pytest
from mnemora.sources import catalog as catalogs
from mnemora.sources.catalog import Catalog, MemoryCatalogError
from pyspark.sql import functions as F


def rows(spark, n, agents, first=0):
    return spark.range(first, first + n, 1, 8).select(
        F.concat(F.lit("e"), "id").alias("experience_id"), F.concat(F.lit("user"), F.col("id") % agents).alias("agent_name"), F.sha2(F.col("id").cast("string"), 512).alias("context")
    )


def held(df):
    return sorted((r.experience_id, r.agent_name, r.context) for r in df.collect())


def test_o14_many_tenants_share_buckets(spark, tmp_path):
    everyone = Catalog(spark, str(tmp_path / "m"))
    many = rows(spark, 1200, 400)
    everyone.save("experiences", many)
    folder = tmp_path / "m" / "experiences"
    assert len(list(folder.rglob("*.parquet"))) <= 2 * catalogs.BUCKETS and not list(folder.glob("agent_name=*"))
    everyone.save("experiences", rows(spark, 10, 2, 5000))  # few tenants: folders
    assert len(list(folder.glob("agent_name=*"))) == 2
    whole = many.unionByName(rows(spark, 10, 2, 5000))
    assert held(everyone.load("experiences").select(*many.columns)) == held(whole)
    one = Catalog(spark, str(tmp_path / "m"), agent="user1")
    assert held(one.load("experiences").select(*many.columns)) == held(whole.where("agent_name = 'user1'"))
    assert "tenant_bucket" not in one.load("experiences").columns
    assert 0 < one.size_bytes() < everyone.size_bytes() / 20
    copy = Catalog(spark, str(tmp_path / "copy"))
    assert everyone.salvage(copy, ["experiences"]) == {"experiences": 1210}
    copy.save("experiences", rows(spark, 4, 4), mode="overwrite")
    assert copy.load("experiences").count() == 4


def test_o14_replacing_agents_of_the_pool(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "FOLDERS", 5)
    everyone, one = Catalog(spark, str(tmp_path / "m")), Catalog(spark, str(tmp_path / "m"), agent="user1")
    old, columns = rows(spark, 60, 12), ["experience_id", "agent_name", "context"]
    everyone.save("experiences", old)
    everyone.save("experiences", rows(spark, 4, 2, 100))  # user0 and user1 have folders as well
    one.replace("experiences", rows(spark, 1, 1, 300).withColumn("agent_name", F.lit("user1")))
    others = [r for r in held(old.unionByName(rows(spark, 4, 2, 100))) if r[1] != "user1"]
    assert [r[0] for r in held(one.load("experiences"))] == ["e300"]
    assert [r for r in held(everyone.load("experiences").select(*columns)) if r[1] != "user1"] == others
    one.replace("experiences", one.load("experiences").limit(0))
    assert one.load("experiences").count() == 0 and held(everyone.load("experiences").select(*columns)) == others
    few, many = rows(spark, 2, 2, 400), rows(spark, 8, 8, 800)
    everyone.replace_agents("experiences", few)  # user0, user1: to folders
    assert held(everyone.load("experiences").select(*columns)) == sorted([r for r in others if r[1] != "user0"] + held(few))
    everyone.replace_agents("experiences", many)  # user0 to user7: to the pool, their folders go
    assert held(everyone.load("experiences").select(*columns)) == sorted([r for r in others if int(r[1][4:]) > 7] + held(many))


def test_o14_the_quota_is_an_agents(spark, tmp_path):
    everyone = Catalog(spark, str(tmp_path / "m"), max_memory_mb=1)
    everyone.save("experiences", rows(spark, 30_000, 400))
    assert everyone.size_bytes() > 1 << 20  # the store of all agents may exceed what one of them may hold
    assert everyone.load("experiences").count() == 30_000
    with pytest.raises(MemoryCatalogError, match="user0 exceeds"):
        everyone.save("experiences", rows(spark, 30_000, 1, 100_000))
    everyone.save("experiences", rows(spark, 400, 400, 200_000))
    assert everyone.load("experiences").count() == 30_400


def test_o14_rows_set_aside_count_once(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "m"), max_memory_mb=1)
    catalog.save("things", rows(spark, 5_500, 1).drop("agent_name"))  # over half a quota
    assert 1 << 19 < catalog.size_bytes() < 1 << 20
