import random
from collections import Counter

import numpy as np

from tests.llm.fixtures import EDGE, docs, words
from volspark.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(np.int8)))) == 1).sum())
        out.append((int(cover.sum()), runs, np.frombuffer(b, np.uint8)[~cover].tobytes()))
    return out


def _texts():
    p, q = words(1, 60), words(2, 90)
    return [
        *EDGE[:6], EDGE[7], f"{words(3, 50)} {p} {words(4, 50)}", f"{words(5, 20)}{p}é{words(6, 20)}", p[:199], p[:200], p[1:200] + "!", q, q, words(7, 40) + q[:250] + words(8, 10) + q[:250], words(9, 45) * 2,
        "ab" * 400, "日本" * 200, "x" + "日本" * 200,
    ]


def check(spark, texts, **more):
    d = docs(spark, texts)
    copies, cut = S.cut_texts(d, **more)
    whole = {bytes(r["d"]) for r in copies.collect()}
    rest = {bytes(r["d"]): (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in cut.collect()}
    import hashlib

    for t, want in zip(texts, brute(texts), strict=True):
        b = (t or "").encode()
        k = hashlib.sha256(b).digest()[:16]
        got = (len(b), 1, b"") if k in whole else rest.get(k, (0, 0, b))
        assert got == want, (t or "")[:40]


def test_equals_brute_force(spark):
    check(spark, _texts())


def test_small_buckets_and_hot_groups(spark):
    check(spark, _texts(), hot=1, bucket_anchors=3)


def test_random_edits(spark):
    r = random.Random(1)
    base = words(11, 300)
    texts = []
    for _ in range(12):
        t = list(base)
        for _ in range(r.randint(1, 12)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    check(spark, texts, bucket_anchors=5)


def test_stage_keeps_rows_and_columns(spark):
    t = words(1, 60)
    d = docs(spark, [None, "", t, t + "!", (7, words(2, 5)), (None, words(3, 5))])
    out = S.remove_repeats(d)
    assert out.columns == d.columns
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None} == {0: None, 1: "", 2: "", 3: "!", 7: words(2, 5)}
    assert S.remove_repeats(d.limit(0)).count() == 0


def test_merge_equals_sorting():
    r = random.Random(5)
    for _ in range(50):
        runs = []
        for _ in range(r.randint(1, 6)):
            strings = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 8)))
            if strings:
                code = S.front_code(strings, 9)
                assert S.front_decode(*code) == strings
                runs.append((strings, code[0]))
        if not runs:
            continue
        order, shared = S.merge_runs(runs)
        got = [runs[k][0][i] for k, i in order]
        assert got == sorted(x for s, _ in runs for x in s)
        for a, b, n in zip(got, got[1:], shared[1:], strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_anchors_in_chunks(monkeypatch):
    raw = words(3, 3000).encode()
    whole = S.anchors(raw)
    monkeypatch.setattr(S, "_CHUNK", 1000)
    monkeypatch.setattr(S, "_state", None)
    parts = S.anchors(raw)
    assert np.array_equal(whole[0], np.unique(parts[0]))
