import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import EDGE, docs
from volspark.llm import pieces as P


@pytest.fixture(scope="module")
def bpe():
    return P.read_model(P.tokenizer_path())


def _ids(spark, model, d, **more):
    out, n_words, ids, decoded = P.encode(d, model, **more)
    rows = out.select("doc_id", F.col(ids).alias("b"), P.unpacked(F.col(ids)).alias("i"), F.col(decoded).alias("t")).collect()
    return {r["doc_id"]: (r["i"], r["t"], r["b"]) for r in rows}


HARD = [*EDGE, "  a  b", "x▁y", "日本語 é́ 🙂🙂", "=" * 500 + " " + "ab" * 200, " ", "<s> <0x41>\n\t", "the cat the cat"]


def test_equals_the_library(spark, bpe):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.tokenizer_path())
    for bound in (150_000, 0):  # with the lattice, and by the rare words' way alone
        got = _ids(spark, bpe, docs(spark, HARD), lattice_words=bound)
        for i, t in enumerate(HARD):
            if t is None:
                assert got[i] == (None, None, None)
            else:
                want = lib.encode(t)
                assert got[i][0] == want and got[i][1] == lib.decode(want)


def test_decode_in_dataframe_functions(spark, bpe):
    out, _, ids, decoded = P.encode(docs(spark, HARD), bpe)
    assert out.where(~P.decode(P.unpacked(F.col(ids)), bpe).eqNullSafe(F.col(decoded))).count() == 0


def test_empty_table_and_repeated_rows(spark, bpe):
    assert P.encode(docs(spark, ["a"]).limit(0), bpe)[0].count() == 0
    d = docs(spark, ["a b", "a b"])
    assert P.encode(d.union(d), bpe)[0].count() == 4


def test_unigram_viterbi(spark):
    rows = [(0, "<unk>", 0.0, 2), (1, "▁", -2.0, 1), (2, "▁a", -2.5, 1), (3, "a", -3.0, 1), (4, "b", -3.5, 1), (5, "ab", -3.2, 1), (6, "▁ab", -7.0, 1), (7, "ba", -3.1, 1), (8, "bab", -4.0, 1)]
    model = P.PieceTable(rows, is_bpe=False)
    texts = ["ab", "abab", "bab ab", "aab", "ababab b", "xab", "a x"]
    lattice = _ids(spark, model, docs(spark, texts))
    plain = _ids(spark, model, docs(spark, texts), lattice_words=0)
    score = {p: s for _, p, s in model.pieces}

    def brute(word):
        best = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            options = []
            for i in range(j):
                p = word[i:j]
                if p in score:
                    options.append((best[i][0] + score[p], best[i][1] + [p]))
                elif j - i == 1:
                    options.append((best[i][0] + model.worst, best[i][1] + [p]))
            best[j] = max(options, key=lambda o: o[0])
        return best[len(word)][0]

    by_id = {i: p for i, p, _ in model.pieces}
    for i, t in enumerate(texts):
        assert lattice[i][0] == plain[i][0]
        got = sum(score[by_id[k]] if k in by_id else model.worst for k in lattice[i][0])
        want = sum(brute("▁" + w) for w in t.split(" "))
        assert np.isclose(got, want)


def _merged(spark, model, words):
    from volspark.llm.pieces import WordEncoder, encode_words

    encode = WordEncoder(model)
    got = {r["word"]: r["ids"] for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert set(got) == set(words)
    for w, ids in got.items():
        assert ids == np.frombuffer(encode(w), "<i4").tolist(), w


def test_merges_by_bits_and_one_by_one(spark, bpe):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abeinrst\n日▁"), int(n))) for n in rng.integers(1, 96, 300)}
    _merged(spark, bpe, sorted({w for w in words if set(w) & set("abeinrst")} | {"a" * n for n in (1, 2, 60, 61, 62, 63, 64, 95, 96)}))


def test_merges_whose_parts_come_late(spark):
    """Unions that score better than the pieces they are made of: the pass over the edges meets them too early."""
    rng = np.random.default_rng(7)
    pieces = list("abc") + sorted({"".join(rng.choice(list("abc"), int(n))) for n in rng.integers(2, 6, 60)})
    rows = [(0, "<unk>", 0.0, 2), *((i + 1, p, -float(s), 1) for i, (p, s) in enumerate(zip(pieces, rng.permutation(len(pieces)), strict=True)))]
    _merged(spark, P.PieceTable(rows, is_bpe=True), sorted({"".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 40, 400)}))


def test_every_word_goes_through_the_lattice(spark, bpe, monkeypatch):
    """Rare words, too, come from the join with the pieces and the folds, whatever number of encodings is broadcast."""
    seen = []
    for name in ("encode_words", "encode_long_words"):
        plain = getattr(P, name)
        monkeypatch.setattr(P, name, lambda words, model, plain=plain: seen.extend(r[0] for r in words.select("word").collect()) or plain(words, model))
    texts = ["one two two two", "three two", "x" * 200 + " two", "日 rare" + " long text" * 20_000]
    split = P._Splitter(bpe)
    _ids(spark, bpe, docs(spark, texts), lattice_words=2)
    assert sorted(seen) == sorted({w for t in texts for w in split(t)})


def test_long_words_by_windows(spark, bpe):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoin日▁="), n)) for n in (97, 150, 1030, 5000)] + ["a" * 3000]
    encode = P.WordEncoder(bpe)
    got = P.encode_long_words(spark.createDataFrame([(w,) for w in words], "word string"), bpe, window=64).collect()
    assert {r["word"]: r["ids"] for r in got} == {w: np.frombuffer(encode(w), "<i4").tolist() for w in words}


def test_words_are_cut_where_no_piece_crosses(spark, bpe):
    """Parts that no merge joins are distinct words of the lattice, each once, and their ids in a row are the word's."""
    pairs = {p[i : i + 2] for _, p, _ in bpe.pieces for i in range(len(p))}
    words = ["▁ansh.\nTithble&&&", "▁ñêço日\n\n本", "▁the", "▁▁日", "x" * 70]
    parts, per = P._Cutter(bpe)(words)
    assert "".join(parts) == "".join(words) and len(per) == len(words) and per[0] > 1 and per.tolist()[2] == 1
    at = 0
    for w, k in zip(words, per.tolist(), strict=True):
        own = parts[at : at + k]
        assert "".join(own) == w and all(a[-1] + b[0] not in pairs for a, b in zip(own, own[1:], strict=False))
        encode = P.WordEncoder(bpe)
        assert b"".join(map(encode, own)) == encode(w)
        at += k


def test_dictionaries_leave_room_before_they_read(tmp_path):
    """While a group's dictionary is read, others are held up to half of the bound alone."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for g in range(3):
        (tmp_path / f"group={g}").mkdir()
        pq.write_table(pa.table({"word": [f"w{g}-{k}" for k in range(60)], "ids": pa.array([[k] for k in range(60)], pa.list_(pa.int32()))}), tmp_path / f"group={g}" / "a.parquet")
    held = P._Dictionaries(str(tmp_path), most=100)
    for g in (0, 1, 2, 0):
        assert len(held(g)) == 60 and list(held.held) == [g]


def test_words_of_a_batch_are_those_of_each_text(bpe):
    """Texts cut together and texts that are cut alone, in any order, also of a slice."""
    split = P._Splitter(bpe)
    texts = ["a b", "", " a", "a ", "two  spaces", "\u2581", "c\u2581d e", " ", "\t\n", "é ü \U0001f600", "x" * 50, "last one"]
    want = [split(t) for t in texts]
    assert split.lists(pa.array(texts)).to_pylist() == want
    assert split.lists(pa.array(texts).slice(3, 5)).to_pylist() == want[3:8]
    for some in (["a b", "c"], ["", " "], []):
        assert split.lists(pa.array(some, pa.string())).to_pylist() == [split(t) for t in some]


def test_a_word_of_a_batch_is_looked_up_once(bpe):
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

    words = [f"\u2581{w}" for w in ("one", "two", "three")] * 1000
    common = Counting({w: w.encode() for w in words[:2]})
    pack = P._Packer(bpe, common, lambda group: {u: u.encode() for u in P._Cutter(bpe)(words[2:3])[0]})
    assert pack(1, pa.array(words)).to_pylist() == [w.encode() for w in words]
    assert Counting.asked <= 10


def test_light_batches_hold_all_rows():
    b = pa.record_batch({"t": pa.array(["abc", None, "x" * 100, "y" * 5, "z", ""] * 3)})
    got = [x.column(0).to_pylist() for x in P._light([b], 0, rows=7, most=8)]
    assert [t for x in got for t in x] == b.column(0).to_pylist()
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= 8 for x in got)
