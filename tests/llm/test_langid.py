import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import EDGE, docs
from volspark.llm import langid


def _labelled(spark):
    en = ["the cat and the dog went home", "this is what they have seen with them", "there was nothing of the kind"]
    de = ["der hund und die katze sind nicht hier", "das ist nicht schön für mich", "ich bin über die straße gegangen"]
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_and_predicts(spark):
    model = langid.fit(_labelled(spark), F.lit(True))
    assert model.languages == ["de", "en"]
    names, scores = model.predict(["they went with the dog", "ich bin nicht hier", None, "12 ?!", ""])
    assert names == ["en", "de", "und", "und", "und"]
    assert all(0 <= s <= 1 for s in scores) and scores[2:] == [0.0] * 3


def test_edge_rows(spark):
    model = langid.fit(_labelled(spark), F.lit(True))
    d = docs(spark, EDGE + EDGE)
    out, lang, score = langid.identify(d, model)
    rows = out.collect()
    assert len(rows) == 2 * len(EDGE) and lang not in d.columns
    und = {i for i, t in enumerate(EDGE + EDGE) if t is None or not any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in rows if r[lang] == "und"} == und


def test_nothing_to_learn_from(spark):
    empty = _labelled(spark).limit(0)
    model = langid.fit(empty, F.lit(True))
    assert model.predict(["abc"]) == (["und"], [0.0])
    assert langid.identify(empty, model)[0].count() == 0
    nulls = _labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(nulls, F.lit(True)).languages == []


def test_bound_and_held_out(spark):
    rows = _labelled(spark)
    picked = langid._bounded(rows.select("doc_id", "lang"), "doc_id", "lang", 2)
    assert {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()} == {"de": 2, "en": 2}
    import zlib

    got = {r[0]: r[1] for r in spark.range(40).select(F.col("id").alias("doc_id"), langid.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("i"), "lang")
    out = langid.op1_language_id(spark, sf)
    hit = out.where("held_out").join(truth, F.col("doc_id") == F.col("i")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hit > 0.97


def grams(text):
    """n-grams of a text as strings: letters in lower case, every run of other characters a space, one at each end."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_and_model_equal_brute_force(spark):
    langs = {"aa": "abcde", "bb": "defgh", "cc": "ijkla"}
    r = random.Random(4)
    make = lambda k: " ".join("".join(r.choice(k) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12)))
    rows = [(i, make(k), lang) for i, (lang, k) in enumerate(sorted(langs.items()) * 12)]
    dim = 1 << 20
    found = [(x, s) for _, x, s in langid.blocks([t for _, t, _ in rows], dim)]
    x, sizes = np.concatenate([a for a, _ in found]).astype(float), np.concatenate([b for _, b in found])
    sets = [grams(t) for _, t, _ in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert sizes.tolist() == [len(a) for a in sets] and np.allclose(x @ x.T, kernel, atol=1e-5)

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d, F.lit(True), per_language=10, landmarks=4, dim=1 << 16)
    # the same sample: the smallest hashes of the id
    order = [r["doc_id"] for r in d.orderBy(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 31)), "doc_id").collect()]
    used = {k: [i for i in order if rows[i][2] == k][:10] for k in langs}
    marks = [i for k in sorted(langs) for i in used[k][:4]]
    train = [i for k in sorted(langs) for i in used[k]]
    w, v = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    half = v / np.sqrt(np.maximum(w, 0) + 1e-3) @ v.T
    phi = kernel[np.ix_(train, marks)] @ half
    y = np.array([[1.0 if rows[i][2] == k else -1.0 for k in sorted(langs)] for i in train])
    weights = np.linalg.solve(phi.T @ phi / len(train) + 1e-2 / len(marks) * np.eye(len(marks)), phi.T @ y / len(train))
    z = kernel[:, marks] @ half @ weights
    names, scores = model.predict([t for _, t, _ in rows])
    assert names == [sorted(langs)[j] for j in z.argmax(axis=1)]
    e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
    assert np.allclose(scores, (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=2e-3)


def test_pieces_of_a_long_text(monkeypatch):
    text = "  ".join(["abc1def", "x" * 70, "ÄÖ;;", " ", "end."] * 9)
    def one():
        row = np.zeros(1 << 16, bool)
        return langid.presence(text, 1 << 16, row), np.flatnonzero(row).tolist()
    whole = one()
    for n in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "_PIECE", n)
        assert one() == whole


def test_more_languages_than_rows_of_each(spark):
    """600 languages of one letter each, some of them on repeated ids of two languages: all are learned."""
    rows = [(i, chr(0x4E00 + i) * 3 + f" {chr(0x4E00 + i)}", f"l{i:03}") for i in range(600)] + [(5, "abc", "l005"), (7, "xyz", "l900")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d, F.lit(True), most_rows=601)
    assert len(model.languages) == 601
    names, _ = model.predict([t for _, t, _ in rows[:300]])
    assert sum(n == r[2] for n, r in zip(names, rows, strict=False)) > 250
    few = langid.fit(d, F.lit(True), most_rows=1)  # beyond the bound: the most frequent language, of an id that has other rows as well
    assert few.languages == ["l005"]
