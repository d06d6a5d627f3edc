"""The registered queries of this package against their SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hushgate.llm import decontaminate, jaccard, queries, secretscan, toxicity
from hushgate.llm.common import table
from hushgate.sources.store import stage
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_result_as_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(queries.SQL[name]).df()) is None


def test_pipeline_stage_by_stage(spark):
    """Each stage on its own input, against its operator or plain Python on the collected rows."""
    kept, tables = table(spark, SF, "documents"), []
    for name, work in corpus_pipeline.STAGES:
        tables.append((name, kept))
        kept = stage(work(spark, kept, SF), f"test-{name}")
    names = [n for n, _ in tables]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    rows = {n: {r.doc_id: r for r in t.collect()} for n, t in tables}
    model = toxicity.train(tables[0][1], table(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    assert set(rows["near_duplicates"]) == {k for k, r in rows["toxicity"].items() if scorer.score(r.text or "") < toxicity.THRESHOLD}
    groups = jaccard.jaccard_components(tables[1][1], n=5, percent=80).collect()
    assert set(rows["decontamination"]) == {g.component_id for g in groups}
    hit = {r.doc_id for r in decontaminate.decontaminate(tables[2][1], table(spark, SF, "benchmark")).filter("n_hit > 0").collect()}
    assert hit and set(rows["secrets"]) == set(rows["decontamination"]) - hit
    assert set(rows["packing"]) == set(rows["secrets"])
    novelty = secretscan.Novelty(secretscan.identifier_dictionary(tables[3][1]))
    for k, r in rows["packing"].items():
        found = secretscan.all_spans(rows["secrets"][k].text or "", novelty)
        assert (r.text != rows["secrets"][k].text) == bool(found) and r.n_chars == len(r.text)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(rows["packing"])
    for name, t in tables[1:]:
        assert t.columns == corpus_pipeline.COLUMNS


def test_one_of_each_group_stays_whatever_the_ids(spark):
    text = lambda k: " ".join(f"w{'abcdefghij'[k]}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60))
    rows = [(None, text(0)), (None, text(0)), (None, text(0) + " more"), (7, text(1)), (None, text(1)), (9, text(1) + " more"),
            (3, text(2)), (5, text(2)), (5, text(3)), (5, text(3)), (None, ""), (None, ""), (4, None), (4, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, (r.text or "")[:3]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, "waa"), (7, "wba"), (3, "wca"), (5, "wda"), (None, ""), (None, ""), (4, ""), (6, "")], key=str)


def test_all_stages_on_odd_rows_and_an_empty_table(spark):
    """Null, empty, blank and long texts, repeated rows, null and shared ids, null columns go through every stage."""
    long = " ".join(f"v{i * 7919 % 10007}" for i in range(30_000))
    rows = [(0, None, "en", "x"), (1, "", None, None), (2, " \n\t", "en", None), (3, long, None, "x"), (3, long, None, "x"), (4, long + " end", "en", "x"),
            (5, "short", "en", "x"), (None, None, None, None), (None, "é ß 日本 </s>", "en", "x"), (6, "token = 'abcdef123456'", "en", "x")]
    docs = spark.createDataFrame([(i, t, a, b, len(t) if t else None) for i, t, a, b in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for some in (docs, docs.filter("false")):
        kept, last = some, corpus_pipeline.STAGES[-1][0]
        for name, work in corpus_pipeline.STAGES:
            kept = stage(work(spark, kept, SF), f"test-{name}")
            if name == "secrets":
                texts = {(r.doc_id, r.text) for r in kept.collect()}
            assert name == last or kept.columns == corpus_pipeline.COLUMNS
        want = {(0, None), (1, ""), (2, " \n\t"), (3, long), (5, "short"), (None, None), (None, "é ß 日本 </s>"), (6, "[SECRET]'")}
        full = some is docs
        assert texts == (want if full else set())
        assert {r.doc_id for r in kept.collect()} == ({i for i, _ in want} if full else set())
