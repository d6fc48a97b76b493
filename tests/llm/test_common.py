import os

from flowmill.llm import common


def _there(df):
    return os.path.exists(df._written_at.removeprefix("file://"))


def test_scratch_deletes_what_is_not_kept(spark):
    rows = spark.range(10)
    with common.scratch() as outer:
        a = common.materialize(rows, "a")
        with common.scratch() as inner:
            b, c = common.materialize(a, "b"), inner(common.materialize(a.limit(0), "c"))
        assert _there(a) and not _there(b) and _there(c)
        outer(a)
    assert _there(a) and not _there(c) and a.count() == 10
    outside = common.materialize(rows, "d")
    assert _there(outside) and common.few_or_shuffled(outside).count() == 10


def test_shuffle_files_go_and_the_plan_still_runs(spark):
    counted = spark.range(1000).groupBy((common.F.col("id") % 7).alias("k")).count()
    written = common.materialize(counted, "counted")
    assert written.count() == 7 and len(counted.collect()) == 7 == len(common.materialize(counted, "again").collect())


def test_join_groups(spark):
    rows = spark.range(500).select(common.F.when(common.F.col("id") < 300, 0).otherwise(common.F.col("id")).alias("key"), common.F.col("id").alias("rid"))
    groups = common.materialize(spark.createDataFrame([(0, "hot"), (400, "one"), (900, "none")], "key long, name string"), "groups")
    for limit in (0, 10):
        assert common.join_groups(rows, groups, "key", limit=limit).count() == 301
        left = common.join_groups(rows, groups, "key", how="left", limit=limit)
        assert left.count() == 500 and left.where("name is null").count() == 199 and left.columns == ["key", "rid", "name"]


def test_free_names(spark):
    assert common.free(spark.range(1).selectExpr("id as __RID", "id as __rid_"), "__rid") == "__rid__" and common.free(spark.range(1), "x") == "x"
