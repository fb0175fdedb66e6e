import random
import re

from tests.llm.fixtures import EDGE, docs, words
from volspark.llm import decontaminate as D

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(t):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())


def brute(text, items, n=10):
    w, hit, found = norm(text), set(), set()
    for i, t in items:
        x = norm(t)
        if not x:
            continue
        for k in range(max(1, len(x) - n + 1)):
            win = x[k : k + n]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(found, key=str)


def _case(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "é", "7"]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9, 10, 12, 30])))) for i in range(8)]
    items += [("n", ""), ("z", "?!")]
    texts = [" ".join(r.choice([*vocab, "x"]) for _ in range(60)) for _ in range(6)]
    texts += [f"x {items[k][1].upper()}, y" for k in range(8)]
    return items, texts


def test_matcher_equals_brute_force():
    for seed in range(40):
        items, texts = _case(seed)
        m = D.Matcher([(i, norm(t)) for i, t in items])
        for t in texts:
            spans, found = m.find(norm(t))
            assert (len(norm(t)), sum(b - a for a, b in spans), sorted(found)) == brute(t, items)
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_dataframe_and_shards(spark):
    items, texts = _case(3)
    bench = spark.createDataFrame([*items, (None, "a b"), ("q", None)], "item_id string, text string")
    rows = list(enumerate([*EDGE, *texts]))
    d = docs(spark, rows)
    for shard_words in (2_000_000, 60):
        out, found = D.find_contamination(d, bench, shard_words=shard_words)
        assert found not in d.columns
        got = {r["doc_id"]: (r[found]["n_words"], sum(b - a for a, b in r[found]["spans"]), sorted(r[found]["items"], key=str)) for r in out.collect()}
        assert got == {i: brute(t, [*items, (None, "a b")]) for i, t in rows}


def test_cut_and_coverage(spark):
    item = words(1, 12)
    long_, short = words(2, 40), words(3, 2)
    d = docs(spark, [f"{long_}. {item}! {long_}", f"{short} {item}", None, "", long_])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(d, bench).collect()}
    assert got == {0: f"{long_}. ! {long_}", 2: None, 3: "", 4: long_}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, ["a b"])
    assert D.find_contamination(d, bench)[0].count() == 1
    assert D.find_contamination(d.limit(0), bench)[0].count() == 0


def test_large_benchmark_in_one_automaton():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    items = [(str(k), [r.choice(vocab).encode() for _ in range(1000)]) for k in range(30)]
    m = D.Matcher(items)
    doc = [b"x"] + items[3][1][5:40] + [b"w1", b"w2"] + items[7][1][:9] + [b"x"]
    assert m.find(doc) == ([(1, 36)], {"3"})
    again = D.Matcher.opened(D.compiled(items))
    assert again.find(items[9][1]) == ([(0, 1000)], {"9"})
