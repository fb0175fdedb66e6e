"""The registered queries over whole tables of the smallest scale, against SQL or brute force."""

import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from tests.llm import test_decontaminate, test_licenses, test_minhash, test_suffix_dedup
from volspark.llm import pieces
from volspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect(config={"threads": 2})
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(str([r[c] for c in names]) for r in df.collect())
    assert rows == sorted(str(list(r)) for r in cur.fetchall())


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path())
    for r in QUERIES["op2_pieces"](spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]])
        assert r["n_pieces"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_license_base(spark, texts):
    for r in QUERIES["op6_license_scan"](spark, SF).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == test_licenses.brute(texts[r["doc_id"]])


def test_language_columns(spark, texts):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "de", "fr", "es", "und"} for r in rows)


def test_pipeline_equals_brute_force(spark, texts):
    import sentencepiece

    # every document of this table has letters and a clear language
    docs = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    groups = test_minhash.brute(sorted(docs.items()), 5, 80)
    docs = {i: t for i, t in sorted(docs.items()) if groups[i][1] == i}
    cut = test_suffix_dedup.brute(list(docs.values()))
    docs = {i: k.decode("utf-8", "ignore") for i, (_, _, k) in zip(docs, cut, strict=True)}
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = set()
    for _, t in bench:
        w = test_decontaminate.norm(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    want = {}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path())
    for i, t in docs.items():
        raw = t.encode()
        places = [m.span() for m in test_decontaminate.PATTERN.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode())]
        low = test_decontaminate.norm(t)
        hit = np.zeros(len(low) + 1, bool)
        for size in {len(w) for w in windows}:
            for k in range(len(low) - size + 1):
                if tuple(low[k : k + size]) in windows:
                    hit[k : k + size] = True
        if hit.sum() > len(low) / 2:
            continue
        keep, k = bytearray(), 0
        at = 0
        while k < len(low):
            if hit[k]:
                end = k
                while hit[end]:
                    end += 1
                keep += raw[at : places[k][0]]
                at = places[end - 1][1]
                k = end
            else:
                k += 1
        keep += raw[at:]
        want[i] = lib.encode(keep.decode())
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<i4").tolist() for r in C.run(spark, SF).collect()}
    assert got == want
