"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers of the items (each item added after a reset to the root), and document
words stream through it: state and longest matching length are updated by each word. Where the length reaches the
window (10 words), the last 10 words are a window of some item, and the state on the suffix links that stands for that length
names the items that have it; items of fewer words are marked at the state of the whole item, and found from
any state by the next marked one on its suffix links. Only runs of words that all occur in the items are streamed, since any
other word resets the automaton. The set of hit words is exact: the vocabulary compares whole words, states whole sequences.

The automaton is built on the driver, once for each shard of the items of about ``shard_words`` words, and broadcast as arrays; a Python
worker opens them once. A larger benchmark takes one pass per shard over the documents, whose spans are written between passes, so
memory in a task stays bounded.

Defined cases: null or wordless texts have no words, no hits and no items; wordless items are never found;
items with equal words are found together; the words of an item without an id are hit like others, and such items count as
one item without a name; a repeated document row gives a row each; a very long text is streamed like others, at some 100 bytes a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import WORD_TABLE, ascii_words, free_name, materialise, slices, table

WINDOW = 10


@dataclass
class SuffixAutomaton:
    """Of sequences of numbers: length, suffix link and moves of each state; state 0 is the root."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.moves.append(moves)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the strings that end p's plus word; redirects the moves of p and its links."""
        clone = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            q = self.moves[last].get(w)
            if q is not None:  # seen already, after an earlier item
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p != -1 and w not in self.moves[p]:
                self.moves[p][w] = new
                p = self.link[p]
            if p != -1:
                q = self.moves[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
            last = new


class Matcher:
    """Finds windows of items in documents. items: (id as string or None, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self._open(*compiled(items, window))

    @classmethod
    def opened(cls, arrays: tuple) -> Matcher:
        """From the arrays of compiled()."""
        out = cls.__new__(cls)
        out._open(*arrays)
        return out

    def _open(self, vocabulary: list[bytes], length: np.ndarray, link: np.ndarray, keys: np.ndarray, to: np.ndarray, windows: dict[int, list], short: dict[int, list], window: int) -> None:
        self.window, self.windows, self.short = window, windows, short
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        self.length, self.link = length.tolist(), link.tolist()
        self.moves = dict(zip(keys.tolist(), to.tolist(), strict=True))
        # the nearest state with short items on the suffix links, the state itself included
        self.marked = [-1] * len(self.length)
        if short:
            for s in np.argsort(length, kind="stable").tolist():
                self.marked[s] = s if s in short else self.marked[self.link[s]] if s else -1
        self.least = min([window] * bool(windows) + [n for held in short.values() for n, _ in held], default=0)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal runs [start, end) of hit words, and the ids of items with windows that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        least, window = self.least, self.window
        if not least or len(words) < least:
            return spans, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        moves, length, link, base, short = self.moves, self.length, self.link, self.base, self.short
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < least:
                continue
            state = n = 0
            for i, w in enumerate(ids[a:b].tolist(), start=a + 1):
                to = moves.get(state * base + w)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = moves.get(state * base + w)
                if to is None:
                    state = n = 0
                    continue
                state, n = to, n + 1
                size = 0
                if n >= window:
                    at = state
                    while length[link[at]] >= window:
                        at = link[at]
                    items.update(self.windows[at])
                    size = window
                if short and n >= least:
                    at = self.marked[state]
                    while at >= 0:
                        for m, held in short[at]:
                            if m <= n:
                                items.update(held)
                                size = max(size, m)
                        at = self.marked[link[at]] if at else -1
                if size:
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


def compiled(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> tuple:
    """What Matcher opens, of items (id as string or None, words): the automaton as arrays, the items of each window's state, and for each
    state of whole short items their lengths and ids."""
    automaton, vocabulary = SuffixAutomaton(), {}
    numbered = []
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        if ids:
            automaton.add(ids)
            numbered.append((item, ids))
    windows: dict[int, set] = {}
    short: dict[int, dict[int, set]] = {}
    length, link, moves = automaton.length, automaton.link, automaton.moves
    for item, ids in numbered:
        state, size = 0, min(window, len(ids))
        for i, w in enumerate(ids, start=1):
            state = moves[state][w]  # each prefix of an item is in the automaton
            if i >= size:
                at = state
                while length[link[at]] >= size:
                    at = link[at]
                if size == window:
                    windows.setdefault(at, set()).add(item)
                else:
                    short.setdefault(at, {}).setdefault(size, set()).add(item)
    base = len(vocabulary) + 1
    count = sum(map(len, moves))
    keys = np.fromiter((s * base + w for s, m in enumerate(moves) for w in m), np.int64, count)
    to = np.fromiter((t for m in moves for t in m.values()), np.int32, count)
    named = lambda held: list(held)
    return list(vocabulary), np.array(length, np.int32), np.array(link, np.int32), keys, to, {s: named(h) for s, h in windows.items()}, {s: [(n, named(h)) for n, h in by.items()] for s, by in short.items()}, window


_opened: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    """The matcher of a broadcast, made once per Python worker; that of an earlier shard is given up."""
    token, compiled_items = shared.value
    if token not in _opened:
        _opened.clear()
        _opened[token] = Matcher.opened(compiled_items)
    return _opened[token]


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def _pass(shared, text_col: str, found_col: str, max_coverage: float | None):
    """Adds or extends found_col; with max_coverage it cuts the texts instead, and drops rows covered by more than that."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for b in slices(batches):
            before = b.column(found_col).to_pylist() if found_col in b.schema.names else [None] * b.num_rows
            out = []
            for text, old in zip(b.column(text_col), before, strict=True):
                words = ascii_words(text.as_py())
                spans, items = matcher.find(words)
                if old and (old["spans"] or old["items"]):
                    spans, items = _union([*map(tuple, old["spans"]), *spans]), items | set(old["items"])
                out.append({"n_words": len(words), "spans": spans, "items": sorted(items, key=lambda i: (i is None, i or ""))})
            cols = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != found_col]
            if max_coverage is not None:
                covered = [sum(y - x for x, y in r["spans"]) for r in out]
                texts = pa.array([cut_text(t.as_py(), r["spans"]) if r["spans"] else t.as_py() for t, r in zip(b.column(text_col), out, strict=True)], pa.string())
                done = pa.RecordBatch.from_arrays([texts if n == text_col else c for n, c in cols], names=[n for n, _ in cols])
                yield done.filter(pa.array([n <= max_coverage * r["n_words"] for n, r in zip(covered, out, strict=True)], pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays([c for _, c in cols] + [pa.array(out, kind)], names=[n for n, _ in cols] + [found_col])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, shard_words: int, max_coverage: float | None) -> tuple[DataFrame, str]:
    spark, found = docs.sparkSession, free_name(docs, "found")
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    words = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"] // 2 + 1  # a word takes two characters at least
    shards = -(-words // shard_words)
    schema = T.StructType([*docs.schema.fields, T.StructField(found, _FOUND)])
    out = docs
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) if shards > 1 else items
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, compiled([(r["i"], ascii_words(r["t"])) for r in part.toLocalIterator()], window)))
        last = k + 1 == shards
        limit = max_coverage if last else None
        out = out.mapInArrow(_pass(shared, text_col, found, limit), docs.schema if limit is not None else schema)
        if not last:
            out = materialise(out, "decontaminate")
    return out, found


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = 400_000) -> tuple[DataFrame, str]:
    """docs with one more column (its name is returned too): struct n_words, spans ([start, end) of hit words), items (sorted ids)."""
    return _passes(docs, benchmark, text_col, item_col, item_text, window, shard_words, None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = 400_000) -> DataFrame:
    """docs with hit spans cut out of the texts (from the first character of a span's first word to the end of its last); documents of
    which more than max_coverage of the words are hit go. Wordless and null texts stay as they are."""
    return _passes(docs, benchmark, text_col, item_col, item_text, window, shard_words, max_coverage)[0]


def cut_text(text: str, spans) -> str:
    """text without the words of each [start, end)."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word, [0])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    items = F.col(f"{found}.items")
    return out.select("doc_id", F.col(f"{found}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win, least(len(w), {WINDOW}) AS size
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
