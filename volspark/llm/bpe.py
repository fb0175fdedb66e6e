"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-pair encoding has, for every prefix of a word, one encoding only, and so one last token. It is found without running
the merges: a suffix automaton of all tokens gives, for each prefix, the tokens that end it, longest first; the first of them that is
compatible with the last token of the prefix before it is the prefix's last token. Two tokens are compatible if encoding their
bytes gives just these two, which is read from the merges along their common border. Following the last tokens back from
the word's end gives its ids.

Texts never leave their task: it cuts them into words by the tokenizer's pattern, takes the words it doesn't know yet, all of a batch
together, and solves them side by side, a byte position of all words a step, in NumPy; words of over ``LONG_BYTES`` bytes are
solved alone, by the same rule. Known words are kept in two generations of bounded size. Tables have a checked size and are broadcast.

Defined cases: null and empty texts have no ids and decode to empty text; an added token's string in a text is that token, as in the library;
repeated rows are encoded each; a very long text is cut into words bit by bit, its ids alone are held whole; an empty table gives one.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import free_name, slices, table
from volspark.llm.decontaminate import SuffixAutomaton
from volspark.llm.pieces import tokenizer_path

LONG_BYTES = 192
MAX_TOKENS = 1_000_000
#: Cells (words x bytes) of the table of last tokens that is filled at a time.
_CELLS = 2_000_000

# Letters and numbers of Unicode 16 that Python's tables (15.1) do not have yet.
_NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
_NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
_SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def _ranges(kind: str, more: str, last: int) -> str:
    """The inside of a character class: all characters of a general category, and more (in hex), up to the last one."""
    spans = [[int(x, 16) for x in r.split("-")] for r in more.split()]
    points = {c for s in spans for c in range(s[0], s[-1] + 1) if c <= last}
    points |= {c for c in range(last + 1) if kind and unicodedata.category(chr(c))[0] == kind}
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def word_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """The published pattern of byte-level BPE: contractions, letters, numbers, other characters, each with a space before, white space.
    last: the last character of the texts; classes without characters beyond U+FFFF are looked up at once and not searched."""
    letter, number, space = _ranges("L", _NEW_LETTERS, last), _ranges("N", _NEW_NUMBERS, last), _ranges("", _SPACES, last)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the files: itself where it shows, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class BpeModel:
    """Tables by token id. Merged tokens have two parts and the rank of their merge, bytes the rank -1."""

    surface: list[bytes]
    added: dict[str, int]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # left * number of ids + right, sorted
    pair_rank: np.ndarray
    moves: np.ndarray  # of the automaton: state * 256 + byte, sorted
    to: np.ndarray
    length: np.ndarray
    link: np.ndarray
    token: np.ndarray  # that is the state's longest string, or -1
    up: np.ndarray  # the nearest state with a token on the suffix links, the state itself left out

    @property
    def size(self) -> np.ndarray:
        return np.array([len(s) for s in self.surface], np.int32)


def read_model(path: str) -> BpeModel:
    """A byte-level BPE file of the tokenizers library (a local path: vocabulary files lie on every machine or with the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bpe, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
    if not plain or bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("only byte-level BPE without normaliser, prefix space, dropout and affixes is supported")
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that stand for their very string are supported")
    byte_of = _byte_chars()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    return build_model({bytes(byte_of[c] for c in k): i for k, i in bpe["vocab"].items()}, [tuple(bytes(byte_of[c] for c in p) for p in m) for m in merges], {t["content"]: t["id"] for t in added})


def build_model(vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]) -> BpeModel:
    n = max([*vocabulary.values(), *added.values()]) + 1
    if n > MAX_TOKENS:
        raise ValueError(f"a vocabulary of more than {MAX_TOKENS} tokens is not broadcast")
    if any(bytes([b]) not in vocabulary for b in range(256)):
        raise ValueError("each byte needs a token")
    surface = [b""] * n
    for s, i in [*vocabulary.items(), *((k.encode(), i) for k, i in added.items())]:
        surface[i] = s
    rank, left, right = (np.full(n, -1, np.int64) for _ in range(3))
    for r, (a, b) in enumerate(merges):
        i, x, y = vocabulary[a + b], vocabulary[a], vocabulary[b]
        if rank[i] >= 0 or max(rank[x], rank[y]) >= r or (len(a) > 1 and rank[x] < 0) or (len(b) > 1 and rank[y] < 0):
            raise ValueError("a token has one merge, and its parts are merged before it")
        rank[i], left[i], right[i] = r, x, y
    made = np.flatnonzero(rank >= 0)
    keys = left[made] * n + right[made]
    order = np.argsort(keys)
    auto = SuffixAutomaton()
    usable = [i for s, i in vocabulary.items() if len(s) == 1 or rank[i] >= 0]
    for i in usable:
        auto.add(list(surface[i]))
    moves = np.fromiter((s * 256 + b for s, m in enumerate(auto.moves) for b in m), np.int64)
    to = np.fromiter((q for m in auto.moves for q in m.values()), np.int32, len(moves))
    at = np.argsort(moves)
    model = BpeModel(surface, added, rank, left, right, keys[order], rank[made][order], moves[at], to[at], np.array(auto.length, np.int32), np.array(auto.link, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))
    _mark(model, usable, auto)
    return model


def _mark(model: BpeModel, usable: list[int], auto: SuffixAutomaton) -> None:
    """Sets token and up. A token counts if its own bytes encode to it: its parts' do, and nothing merges across them before it."""
    made = np.flatnonzero(model.rank >= 0)
    made = made[np.argsort(model.rank[made])]
    clean = Solver(model).compatible(model.left[made], model.right[made], model.rank[made])
    whole = model.rank < 0
    for i, ok in zip(made.tolist(), clean.tolist(), strict=True):
        whole[i] = ok and whole[model.left[i]] and whole[model.right[i]]
    model.token = np.full(len(auto.length), -1, np.int32)
    for i in usable:
        if whole[i]:
            s = 0
            for b in model.surface[i]:
                s = auto.moves[s][b]
            model.token[s] = i
    model.up = np.full(len(auto.length), -1, np.int32)
    for s in np.argsort(model.length, kind="stable").tolist()[1:]:
        p = auto.link[s]
        model.up[s] = p if model.token[p] >= 0 else model.up[p]


class _Lookup:
    """Values of whole numbers, for many at once: a hash table with open addressing, an eighth full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 8).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, at = np.unique(slot[free], return_index=True)
            put = free[at]
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], values[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key has none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        more = np.flatnonzero((there != keys) & (there != -1))
        while len(more):
            slot = (slot if len(slot) == len(more) else slot[more]) + 1 & self.mask
            there = self.keys[slot]
            hit = there == keys[more]
            out[more[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            more, slot = more[go], slot[go]
        return out


class Solver:
    def __init__(self, model: BpeModel):
        self.m, self.n, self.size = model, len(model.surface), model.size
        self.pair, self.move = _Lookup(model.pairs, model.pair_rank), _Lookup(model.moves, model.to)
        self.lists: tuple | None = None

    def compatible(self, a: np.ndarray, b: np.ndarray, cap: np.ndarray | None = None) -> np.ndarray:
        """Whether the bytes of tokens a and b, side by side, encode to just a and b (cap: by merges of a lower rank alone).
        The merges are undone, latest first, at the border; a pair there that merges before either side grows on breaks the two."""
        m = self.m
        out = np.ones(len(a), bool)
        rows, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        never = np.iinfo(np.int64).max
        grows_a = np.full(len(a), never) if cap is None else cap.astype(np.int64)  # rank at which the left neighbour of the border is merged further
        grows_b = np.full(len(a), never)
        while len(rows):
            r = self.pair(a * self.n + b)
            broken = (r >= 0) & (r < grows_a) & (r <= grows_b)
            out[rows[broken]] = False
            ra, rb = m.rank[a], m.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            rows, a, b, grows_a, grows_b, ra, rb = (x[go] for x in (rows, a, b, grows_a, grows_b, ra, rb))
            later = ra > rb
            a, b = np.where(later, m.right[a], a), np.where(later, b, m.left[b])
            grows_a, grows_b = np.where(later, ra, grows_a), np.where(later, grows_b, rb)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as 4-byte little-endian integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        k = int((sizes > LONG_BYTES).sum())
        for i in order[:k].tolist():
            out[i] = self.encode_alone(words[i])
        while k < len(order) and sizes[order[k]]:
            some = order[k : k + max(1, _CELLS // int(sizes[order[k]]))]
            some = some[sizes[some] > 0]
            for i, ids in zip(some.tolist(), self._side_by_side([words[i] for i in some.tolist()], sizes[some]), strict=True):
                out[i] = ids
            k += len(some)
        return out

    def _side_by_side(self, words: list[bytes], sizes: np.ndarray) -> Iterator[bytes]:
        """words: longest first."""
        m, size = self.m, self.size
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        last = np.zeros((len(words), int(sizes[0])), np.int32)
        state, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for i in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -i))  # words of more than i bytes
            byte = text[first[:k] + i].astype(np.int64)
            todo = np.arange(k)
            while len(todo):
                to = self.move(state[todo] * 256 + byte[todo])
                hit = to >= 0
                state[todo[hit]] = to[hit]
                n[todo[hit]] += 1
                todo = todo[~hit]
                state[todo] = m.link[state[todo]]
                n[todo] = m.length[state[todo]]
            s = state[:k]
            node = np.where((m.length[s] == n[:k]) & (m.token[s] >= 0), s, m.up[s])
            todo = np.arange(k)
            while len(todo):
                t = m.token[node[todo]]
                before = i - size[t]
                fits = before < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible(last[todo[inner], before[inner]], t[inner])
                last[todo[fits], i] = t[fits]
                todo = todo[~fits]
                node[todo] = m.up[node[todo]]
        ids, used = np.zeros(last.shape, "<i4"), np.zeros(len(words), np.int64)
        end, rows = sizes.copy(), np.arange(len(words))
        while len(rows):
            t = last[rows, end[rows] - 1]
            used[rows] += 1
            ids[rows, last.shape[1] - used[rows]] = t
            end[rows] -= size[t]
            rows = rows[end[rows] > 0]
        for row, k in zip(ids, (last.shape[1] - used).tolist(), strict=True):
            yield row[k:].tobytes()

    def encode_alone(self, word: bytes) -> bytes:
        """The same for one word, a byte a step."""
        m = self.m
        if self.lists is None:
            pairs = dict(zip(m.pairs.tolist(), m.pair_rank.tolist(), strict=True))
            self.lists = (memoryview(m.moves), memoryview(m.to), *(memoryview(np.ascontiguousarray(x)) for x in (m.length, m.link, m.token, m.up, self.size)), *(x.tolist() for x in (m.rank, m.left, m.right)), pairs)
        moves, to, length, link, token, up, size, rank, left, right, pairs = self.lists
        known: dict[int, bool] = {}
        never = len(pairs)

        def fits(a: int, b: int) -> bool:
            grows_a = grows_b = never
            while True:
                r = pairs.get(a * self.n + b)
                if r is not None and r < grows_a and r <= grows_b:
                    return False
                if rank[a] > rank[b]:
                    grows_a, a = rank[a], right[a]
                elif rank[b] >= 0:
                    grows_b, b = rank[b], left[b]
                else:
                    return True

        last = np.zeros(len(word), np.int32)
        state = n = 0
        for i, byte in enumerate(word):
            while True:
                key = state * 256 + byte
                at = bisect_left(moves, key)
                if at < len(moves) and moves[at] == key:
                    state, n = to[at], n + 1
                    break
                state = link[state]
                n = length[state]
            node = state if length[state] == n and token[state] >= 0 else up[state]
            while True:
                t = token[node]
                before = i - size[t]
                if before < 0:
                    break
                key = int(last[before]) * self.n + t
                ok = known.get(key)
                if ok is None:
                    if len(known) > 100_000:
                        known.clear()
                    ok = known[key] = fits(int(last[before]), t)
                if ok:
                    break
                node = up[node]
            last[i] = t
        ids, end = [], len(word)
        while end:
            ids.append(int(last[end - 1]))
            end -= size[ids[-1]]
        return np.array(ids[::-1], "<i4").tobytes()


class Encoder:
    """Encodes and decodes texts; knows the words of late, twice ``keep`` at most."""

    def __init__(self, model: BpeModel, keep: int = 150_000):
        self.solver, self.words, self.near, self.keep = Solver(model), word_pattern(), word_pattern(0xFFFF), keep
        self.added = {s: np.array([i], "<i4").tobytes() for s, i in model.added.items() if s}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.surface = model.surface
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.keep:
            self.old, self.young, new = self.young, {}, words
        unknown = list(new.difference(self.old))
        self.young.update({w: self.old[w] for w in new.intersection(self.old)})
        self.young.update(zip(unknown, self.solver.encode([w.encode() for w in unknown]), strict=True))

    def _parts(self, text: str, most: int = 20_000) -> Iterator[list[str] | bytes]:
        """Lists of words, at most ``most`` each, and ids of added tokens."""
        words = self.words if _ASTRAL.search(text) else self.near
        for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if k % 2:
                yield self.added[part]
            elif len(part) < 1 << 16:
                yield words.findall(part)
            else:
                found = words.finditer(part)
                while some := [w.group() for w in islice(found, most)]:
                    yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) < 1 << 20:  # all new words of the texts together
            parts = [list(self._parts(t)) for t in texts]
            self._learn({w for p in parts for x in p if isinstance(x, list) for w in x})
        else:
            parts = [self._parts(t) for t in texts]
        return [b"".join(x if isinstance(x, bytes) else self._join(x) for x in p) for p in parts]

    def _join(self, words: list[str]) -> bytes:
        try:
            return b"".join([self.young[w] for w in words])
        except KeyError:
            self._learn(set(words))
            return b"".join([self.young[w] for w in words])

    def decode(self, packed: bytes) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in memoryview(packed).cast("i")]).decode("utf-8", "replace")


def encode(docs: DataFrame, model: BpeModel, text_col: str = "text") -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, whose names are returned: number of tokens, ids (4-byte little-endian integers), the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = n_tokens, ids, decoded = tuple(free_name(docs, n) for n in ("n_tokens", "ids", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in slices(batches, 128):
            packed = coder.encode([t.as_py() or "" for t in b.column(text_col)])
            back = [coder.decode(x) for x in packed]
            more = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(run, schema), n_tokens, ids, decoded


def op11_bpe(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    model = read_model(model_path or tokenizer_path("byte_bpe_50k.json"))
    out, n_tokens, ids, decoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", F.col(n_tokens).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))
