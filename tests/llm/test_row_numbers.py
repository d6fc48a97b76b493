import pytest

from flowmill.llm import bagminhash, exact_dedup


@pytest.mark.parametrize("module, drop", [(exact_dedup, exact_dedup.drop_copies), (bagminhash, bagminhash.drop_near_copies)])
def test_other_splits_in_a_later_scan(spark, tmp_path, monkeypatch, module, drop):
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(30))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/docs")
    key, plain = "spark.sql.files.maxPartitionBytes", module.few_or_shuffled

    def then_other_splits(ids, label="ids", **more):
        out = plain(ids, label, **more)
        spark.conf.set(key, "3k")  # as if an executor was lost between the scans
        return out

    monkeypatch.setattr(module, "few_or_shuffled", then_other_splits)
    try:
        kept = [tuple(r) for r in drop(spark.read.parquet(f"{tmp_path}/docs")).collect()]
    finally:
        spark.conf.unset(key)
    assert len(kept) == 200 and len({t for _, t in kept}) == 200
