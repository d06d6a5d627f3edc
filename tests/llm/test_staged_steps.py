"""What operators leave in the shared folder."""

import re

import pytest

import corpus_pipeline
from hushgate.llm import jaccard
from hushgate.llm.common import stage, stage_alone
from hushgate.sources.store import matching, staging


def names(spark, folder):
    return sorted(re.sub("-[0-9a-f]{32}$", "", p.rsplit("/", 1)[1]) for p in matching(spark, f"{folder}/*"))


def test_only_the_result_of_a_step_stays(spark):
    def inner():
        return stage(spark.range(3), "b").join(stage(spark.range(2, 5), "c"), "id")

    def outer():
        return stage_alone(spark, "d", inner).unionByName(stage(spark.range(7, 8), "e"))

    def broken():
        stage(spark.range(3), "f")
        raise KeyError("f")

    with staging(spark) as folder:
        kept = stage(spark.range(1), "a")
        out = stage_alone(spark, "g", outer)
        with pytest.raises(KeyError):
            stage_alone(spark, "h", broken)
        assert names(spark, folder) == ["a", "g"]
        assert {r.id for r in out.collect()} == {2, 7} and kept.count() == 1
        stage(spark.range(1), "i")
        assert names(spark, folder) == ["a", "g", "i"]


def test_near_duplicates_and_decontamination_leave_no_tables_of_their_steps(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "one two"), (4, None)], "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as int) n_chars")
    spark.createDataFrame([("i", "one two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with staging(spark) as folder:
        got = jaccard.jaccard_components(docs, n=5, percent=80)
        assert names(spark, folder) == ["set-components"]
        assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    with staging(spark) as folder:
        first = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
        assert names(spark, folder) == ["corpus-rows", "set-components"]
        assert {r.doc_id for r in first.collect()} == {1, 3, 4}
    with staging(spark) as folder:
        clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        assert names(spark, folder) == ["corpus-contaminated"]
        assert {r.doc_id for r in clean.collect()} == {1, 2, 4}
