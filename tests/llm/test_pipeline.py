from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    base = [f"w{i} " * 3 + " ".join(f"t{i}x{j}" for j in range(60)) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[i]) for i in range(20)]  # exact copies
    rows += [(300 + i, base[30 + i] + " end") for i in range(20)]  # near copies
    rows += [(400 + i, f"idiot {base[60 + i]} extra{i}") for i in range(50)]  # toxic
    rows += [(500, None), (501, "")]
    spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 500)) for i, _ in rows], "doc_id long, quality long, toxic long").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        seen.append(Counter(r.doc_id for r in docs.collect()))
    toxic, exact, near, mixed = seen
    assert not any(400 <= i < 500 for i in toxic) and len(toxic) == 162
    assert 500 not in exact and 501 in exact and not any(i in exact for i in range(20)) and all(200 + i in exact for i in range(20))
    assert len(exact) == 141 and len(near) == 121 and all((30 + i in near) != (300 + i in near) for i in range(20))
    assert max(mixed.values()) <= 2 and set(mixed) <= set(near)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == mixed


def test_clashing_columns_nulls_and_repeats(spark, tmp_path):
    """Columns named like the stages' own helpers go through all stages but the last; repeated rows and null ids are as any row."""
    extra = ["rid", "__rid", "id", "body", "size", "label", "terms", "part", "n", "root"]
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", 1, *range(len(extra))) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[5], None, None, None, *range(len(extra))), (None, None, "en", "s1", 0, *range(len(extra)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(30)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[:3] == [34, 31, 31]  # two repeats and one copy of a text without an id go
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
