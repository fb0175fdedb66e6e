import random

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import EDGE, docs, words
from volspark.llm import minhash as M


def brute(texts, k, percent):
    """Component of each (id, text) by comparing all pairs of word-tuple sets."""

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(x if r.random() > share else x + "q" for x in text.split(" "))


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    base = [words(s, 150) for s in range(4)]
    texts = [*EDGE, "", "a", "A", "one two", "ONE\ttwo", words(1, 20_000) + " end"]
    for s, b in enumerate(base):
        texts += [b, b.upper(), *[changed(b, share, 10 * s + i) for i, share in enumerate((0.01, 0.02, 0.03, 0.05, 0.05, 0.1, 0.3))]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == brute(rows, k, 80)


def test_chain_of_links(spark):
    w = words(5, 100).split(" ")
    rows = [(i, " ".join(w[3 * i : 3 * i + 60])) for i in range(10)]  # neighbours are alike, ends are not
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs(spark, rows), k=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 80).items()}


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = words(7, 30)
    d = docs(spark, [(1, t), (1, t), (None, t), (2, "")])
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(d).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True)], key=str)
    assert M.near_duplicates(d.limit(0)).count() == 0


def test_odd_sketch_bounds_the_difference():
    a, b = M.shingle_set(words(1, 400), 4), M.shingle_set(changed(words(1, 400), 0.05, 3), 4)
    differ = sum(int(x).bit_count() for x in (M.odd_sketch(a) ^ M.odd_sketch(b)).view("uint64"))
    assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in M.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}


def test_an_id_with_several_texts(spark):
    a, b = words(11, 120), words(12, 120)
    d = docs(spark, [(5, a), (5, b), (7, changed(a, 0.01, 1)), (8, changed(b, 0.01, 2)), (9, words(13, 120))])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(d, k=4).collect()}
    assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)}


def test_ids_of_any_type(spark):
    t = words(3, 60)
    d = docs(spark, [(2, t), (10, t), (1, words(4, 60))]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r["doc_id"], r["component_id"]) for r in M.near_duplicates(d).collect()} == {("d2", "d10"), ("d10", "d10"), ("d1", "d1")}


def test_wide_buckets_are_cut(spark):
    rows = [(i, changed(words(i % 6, 60), 0.02, i)) for i in range(60)]
    found = []
    for wide in (0, 5_000):
        r, labels = M.classes(docs(spark, rows), "doc_id", "text", 4, 80, wide)
        of = {(x["id"], bytes(x["root"])) for x in r.join(labels, "print").collect()}
        groups = {}
        for i, root in of:
            groups.setdefault(root, set()).add(i)
        found.append({frozenset(g) for g in groups.values()})
    want = {}
    for i, (_, c) in brute(rows, 4, 80).items():
        want.setdefault(c, set()).add(i)
    assert found[0] == found[1] == {frozenset(g) for g in want.values()}


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join([words(1, 500), "x" * 900, words(2, 300), "y" * 256, "z"])
    whole = M.word_hashes(text)
    for n in (64, 101, 1000):
        monkeypatch.setattr(M, "_PIECE", n)
        monkeypatch.setattr(M, "_tables", None)
        assert M.word_hashes(text).tolist() == whole.tolist() and len(whole) == 803
    monkeypatch.undo()
    M._tables = None


def test_components_with_a_hub(spark):
    links = spark.createDataFrame([(5000 + i, 7) for i in range(400)] + [(3, 5000), (9000, 9001)], "a long, b long")
    got = {r["node"]: r["component"] for r in M.components(links).collect()}
    assert got == {**{5000 + i: 3 for i in range(400)}, 3: 3, 7: 3, 9000: 9000, 9001: 9000}


def test_few_links_take_no_rounds(spark):
    """A chain, a hub and pairs of binary nodes: the same components in one task as by rounds, in few jobs."""
    node = lambda i: i.to_bytes(3, "big")
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5000 + i, 7) for i in range(400)] + [(3, 5000), (200, 200), (9000, 9001), (9001, 9000)]
    links = spark.createDataFrame([(node(a), node(b)) for a, b in pairs], "a binary, b binary").cache()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    one = {bytes(r["node"]): bytes(r["component"]) for r in M.components(links).collect()}
    assert jobs() - before < 8
    assert one == {bytes(r["node"]): bytes(r["component"]) for r in M.components(links, few=0).collect()}
    assert one == {**{node(i): node(100) for i in range(100, 161)}, **{node(i): node(3) for i in (3, 7, *range(5000, 5400))}, node(9000): node(9000), node(9001): node(9000)}
