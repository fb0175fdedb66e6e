from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.fixtures import EDGE, docs, words

SF = "/root/testdata/sf0.001"


def test_stages_on_edge_rows(spark):
    t = words(1, 80)
    d = docs(spark, [*EDGE, t, t + " more", words(2, 90), words(2, 90)])
    d = d.union(d)
    for name, stage in C.STAGES:
        out = stage(spark, d, SF)
        if name != "sentencepiece":
            assert out.columns == d.columns, name
        rows = out.collect()
        assert len(rows) > 0, name
        assert stage(spark, d.limit(0), SF).count() == 0, name


def test_near_dedup_keeps_one(spark):
    t = words(1, 80)
    d = docs(spark, [(1, t), (2, t), (3, words(2, 80)), (3, words(2, 80)), (None, t), (4, None), (None, words(3, 80)), (None, words(3, 80)), (5, words(4, 80)), (5, words(5, 80))])
    rows = [(r["doc_id"], r["text"]) for r in C.near_dedup(spark, d, SF).collect()]
    # texts of one id are judged each alone; a row without id stays where no row of its class has one
    assert sorted((i for i, _ in rows), key=str) == [1, 3, 4, 5, 5, None]
    assert {t for i, t in rows if i is None} == {words(3, 80)} and {t for i, t in rows if i == 5} == {words(4, 80), words(5, 80)}


CLASHES = "gone __id kept_id kept_key text_key key d kept found ids n_words decoded lang_pred lang_score print root component id".split()


def test_columns_of_any_name(spark):
    t = words(1, 80)
    d = docs(spark, [t, t + " more", words(2, 90), words(2, 90), None])
    d = d.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    for name, stage in C.STAGES:
        out = stage(spark, d, SF)
        if name != "sentencepiece":
            assert out.columns == d.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHES)), name
        assert out.count() > 0


def test_language_id_rejects_letterless(spark):
    d = docs(spark, ["?!", "12", None, "", words(3, 40)])
    assert [r["doc_id"] for r in C.language_id(spark, d, SF).collect()] == [4]


def test_run(spark):
    out = C.run(spark, SF)
    rows = out.collect()
    assert 100 < len(rows) <= 200 and all(r["round_trip"] for r in rows)
