import hashlib
import random
from functools import cache

import numpy as np
import pytest

from tests.llm.fixtures import EDGE, docs
from volspark.llm import bpe
from volspark.llm.pieces import tokenizer_path


@cache
def model():
    return bpe.read_model(tokenizer_path("byte_bpe_50k.json"))


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def _ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


def _texts():
    r = random.Random(3)
    out = ["a" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endof", "  \n\n\t a  b ", "it's we'll I'M 'sx", "日本語のテキスト。" * 50, "ß\x1c\x85　x", "abc" * 900, "😀👩‍👩‍👧", "\U0001e5d0Ᲊ9", "x" * 191, "x" * 193]
    out += ["".join(r.choice("abcdefgh  \n\t'stlre1234.,;!?äöüßéñ日本́😀ABC") for _ in range(r.randint(1, 60))) for _ in range(500)]
    return out + ["".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0x80, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(200)) for _ in range(60)]


def test_equals_the_library():
    texts = _texts()
    for encoder in (bpe.Encoder(model()), bpe.Encoder(model(), keep=20)):
        for t, packed in zip(texts, encoder.encode(texts), strict=True):
            assert _ids(packed) == library().encode(t, add_special_tokens=False).ids
            assert encoder.decode(packed) == library().decode(_ids(packed), skip_special_tokens=False) == t


def test_every_character_is_of_the_librarys_class():
    pre, pattern = library().pre_tokenizer, bpe.word_pattern()
    for a in range(0, 0x110000, 0x1000):
        text = "".join(f"a{c} 1{c}!{c}" for c in map(chr, range(a, a + 0x1000)) if not 0xD800 <= ord(c) < 0xE000)
        assert pattern.findall(text) == [text[i:j] for _, (i, j) in pre.pre_tokenize_str(text)]
        if text and a < 0x10000:
            assert bpe.word_pattern(0xFFFF).findall(text) == pattern.findall(text)


def _merged(word, merges):
    """Merges one by one, the lowest rank first, the leftmost of equals."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = min(((merges[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_learned_merges_of_few_letters_equal_merging(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    corpus = [[c.encode() for c in "".join(r.choice(letters) for _ in range(12))] for _ in range(20)]
    merges: list[tuple[bytes, bytes]] = []
    while len(merges) < 60:  # merges as a trainer would choose them
        pairs = [p for w in corpus for p in zip(w, w[1:], strict=False) if p[0] + p[1] not in {a + b for a, b in merges}]
        if not pairs:
            break
        best = max(sorted(set(pairs)), key=pairs.count)
        merges.append(best)
        corpus = [_merged(b"".join(w), {m: i for i, m in enumerate(merges)}) for w in corpus]
    vocabulary = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    m = bpe.build_model(vocabulary, merges, {})
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))).encode() for _ in range(300)]
    ranks = {p: i for i, p in enumerate(merges)}
    want = [[vocabulary[p] for p in _merged(w, ranks)] for w in words]
    solver = bpe.Solver(m)
    assert [_ids(x) for x in solver.encode(words)] == want
    assert [_ids(solver.encode_alone(w)) for w in words] == want


def test_defined_cases(spark):
    rows = [*EDGE, EDGE[4], "a b<|endoftext|>", "abc " * 40_000]
    out, n_tokens, ids, decoded = bpe.encode(docs(spark, rows).repartition(2), model())
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = library().encode(t or "", add_special_tokens=False).ids
        assert (got[i][n_tokens], _ids(got[i][ids]), got[i][decoded], got[i]["ids"]) == (len(want), want, t or "", "y")
    assert bpe.encode(docs(spark, rows).where("false"), model())[0].count() == 0


def test_unfit_models_are_refused():
    one = {bytes([b]): b for b in range(256)}
    for vocabulary, merges in (({b"a": 0}, []), (one | {b"ab": 256, b"abc": 257}, [(b"ab", b"c"), (b"a", b"b")])):
        with pytest.raises(ValueError):
            bpe.build_model(vocabulary, merges, {})


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op11_bpe(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = library().encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        back = library().decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
