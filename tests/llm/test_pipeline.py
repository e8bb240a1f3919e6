"""The pipeline's stages: columns, what each removes, and that clean documents pass."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        out.append((name, docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][2]
    return out


def test_stages(spark, outputs):
    assert [n for n, _, _ in outputs] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        assert after.join(before, "doc_id", "left_anti").count() == 0
    counts = [after.count() for _, _, after in outputs[:-1]]
    assert counts[0] == counts[1] >= counts[2] >= counts[3] > 0


def test_near_stage(outputs):
    from test_llm_operators import shingles, smallest

    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in outputs[2][1:])
    sets = {d: shingles(t, 5) for d, t in before.items()}
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(links, sets)
    assert set(after) == {d for d in sets if root[d] == d}


def test_decontamination_stage(spark, outputs):
    from test_llm_operators import contaminated

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = outputs[3][1:]
    bad = {k[0] for k in contaminated([(r["doc_id"], r["text"]) for r in before.collect()], items) if k[-1]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad


def test_lines_stage(outputs):
    before, after = outputs[1][1:]
    changed = before.alias("b").join(after.alias("a"), "doc_id").where(~F.col("a.text").eqNullSafe(F.col("b.text")))
    assert changed.count() > 0 and changed.where("length(a.text) >= length(b.text) or a.n_chars <> length(a.text)").count() == 0


def test_run_covers_all_documents_of_the_last_stage(spark, outputs):
    out = cp.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in outputs[3][2].select("doc_id").collect()}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "word", "en", "b", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).count() == 4, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
