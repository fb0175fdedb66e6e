"""Buckets of every size are compared in the same way."""

import numpy as np

from tests.llm.fixtures import docs, words
from volspark.llm import minhash as M


def _texts(n):
    """Texts that share half of their words with a common one."""
    base = words(1, 80).split()
    return [" ".join(base[i : i + 40] + words(100 + i, 30).split()) for i in range(n)]


def _bands(text):
    sig = M.signature(M.shingle_set(text, 1)).reshape(M.BANDS, M.ROWS)
    return [bytes(r) for r in sig]


def test_pairs_do_not_depend_on_a_buckets_size(spark, monkeypatch):
    texts = _texts(14)
    found = {}
    real, none = M.confirm, None

    def confirm(pairs, *rest):
        nonlocal none
        got = {(bytes(r["a"]), bytes(r["b"])) for r in pairs.collect()}
        found.setdefault(wide, []).append(got)
        return real(pairs, *rest).where("false")  # nothing is linked, so every pair that meets stays to be seen

    monkeypatch.setattr(M, "confirm", confirm)
    for wide in (0, 5_000):
        M.classes(docs(spark, list(enumerate(texts))), "doc_id", "text", 1, 30, wide)
    prints = [M._print(M.shingle_set(t, 1)) for t in texts]
    bands = [_bands(t) for t in texts]
    shared = {tuple(sorted((prints[i], prints[j]))): sum(p == q for p, q in zip(bands[i], bands[j], strict=True)) for i in range(len(texts)) for j in range(i)}
    jaccard = {tuple(sorted((prints[i], prints[j]))): len(np.intersect1d(M.shingle_set(texts[i], 1), M.shingle_set(texts[j], 1))) / len(np.union1d(M.shingle_set(texts[i], 1), M.shingle_set(texts[j], 1))) for i in range(len(texts)) for j in range(i)}
    met = {w: set().union(*x) for w, x in found.items()}
    want = {p for p, n in shared.items() if n and jaccard[p] >= 0.3}
    assert sum(shared[p] == 1 for p in want) > 3
    assert want <= met[0] and met[0] == met[5_000]
