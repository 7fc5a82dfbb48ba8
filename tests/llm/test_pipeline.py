import re
from collections import Counter

import corpus_pipeline
import pytest
from compare import assert_same, connect
from plotwise.llm import mixing, queries, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_keep_the_columns_and_work_on_what_is_left(spark, stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] and ids[4] == ids[5]


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(stages[0], labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect()} - bad


def test_near_dedup_stage(stages):
    from llm_plain import components, shingled

    want = components({r.doc_id: shingled(r.text or "", 5) for r in stages[1].collect()})
    assert {r.doc_id for r in stages[2].collect()} == {i for i, c in want.items() if i == c}


def test_substring_stage_leaves_no_passage_twice(stages):
    seen = Counter()
    for r in stages[3].collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        seen.update({tuple(ws[k : k + 50]) for k in range(len(ws) - 49)})
    assert max(seen.values(), default=1) == 1


def test_mixing_stage(stages):
    plan = dict(mixing.mix_plan(stages[3]).where("epochs > 0").select("doc_id", "epochs").collect())
    assert Counter(r.doc_id for r in stages[4].collect()) == plan


def test_encoding_stage_and_run(spark, stages):
    assert stages[5].count() == stages[4].count() and stages[5].where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").exceptAll(stages[5]).count() == 0


def test_substring_stage_keeps_documents_without_text(spark):
    passage = " ".join(f"Sentence {k} of this passage has quite a few words in it." for k in range(6))
    docs = spark.createDataFrame([(1, passage, 9), (2, passage, 9), (3, None, None), (4, "", 0), (5, " ", 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, None).collect()}
    assert got == {1: passage, 3: None, 4: "", 5: " "}


def test_stages_take_odd_rows_and_columns_of_any_name(spark):
    sf, long = "/root/testdata/sf0.001", "Ein langer Satz, der sich wiederholt. " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", "a", 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (5, long, "de", "b", len(long)), (None, "no id here", "en", "b", 10)]
    names = ["size", "weight", "target", "epoch", "n_removed", "n_sentences", "found", "gone", "runs", "doc", "key", "place", "turn", "class", "rep", "component", "label", "score", "ids", "n_ids"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in names})
    for start in (docs, docs.where("false")):
        at = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.columns == docs.columns, name
            assert all(r[c] == "own" for r in at.collect() for c in names), name
            if name != "mixing":
                assert at.where("doc_id = 4").count() == (2 if start is docs else 0)
        encoded = corpus_pipeline.encode(spark, at, sf)
        assert encoded.columns == ["doc_id", "source", "ids", "n_ids", "round_trip"] and encoded.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf).toPandas(), connect(sf).sql(queries.oracle_sql()[name]).df())
