"""SentencePiece encoding and decoding with a relational lattice.

Text is normalised as the model says (spaces become U+2581, one is put in front) and cut into words before every
U+2581 that follows another character, which no piece crosses. Words are exploded into substrings of at most the
longest piece's length and equi-joined to the piece table; matching edges are grouped by word and folded with Spark's
higher-order aggregate:

* unigram tables: Viterbi over the word's positions, then a fold back along the best edges;
* BPE tables: words are first cut where no piece has the two characters side by side (no merge crosses such a place), which makes far fewer distinct ones. The fold applies merges - of neighbouring pieces whose union is an edge, the best score first, the leftmost of
  equals. Scores of such tables are merge ranks, and their best-scoring path is not what SentencePiece returns,
  so Viterbi would give wrong pieces here; the lattice is the same.

Characters that no piece covers become byte pieces (or the unknown piece where a table has none).

Which words: all of them, each distinct one once. Words are counted exactly, by group of documents (rows near each other in a file, some 8 MB of
text). Encodings of the most frequent ones, ``lattice_words`` at most, are broadcast; those of all others are shuffled to the groups that
hold the word and written as a dictionary for each, which the tasks that meet the group's documents read. Texts are never shuffled; results
do not depend on the bound. Words over ``LONG`` characters go through the same lattice by windows; as an array fold takes time quadratic in a
word, the pieces that the join found in such a word are folded with a heap.

Defined cases: null text encodes to null and decodes to null, empty text to no pieces; U+2581 in a text is a space, as in
SentencePiece itself; repeated rows are encoded each; a very long text is split into words at once, some 60 bytes a word; an empty table gives one.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import discard, free_name, fresh_path, materialise, slices, table, write_table

SPACE = "▁"
LONG = 96
#: Words of a task of the lattice.
WORDS = 30_000
#: Shares of the rarer words that are encoded one after the other, so that shuffle files of one share alone are on disk.
PARTS = 4
#: Characters of a word whose boundaries fit the bits of a long, one bit being a flag.
BITS = 61
MAX_PIECES = 1_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints of varints, bytes of the other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class PieceTable:
    rows: list[tuple[int, str, float, int]]  # id, piece, score, type
    is_bpe: bool = False
    dummy_prefix: bool = True
    strip_spaces: bool = False

    def __post_init__(self):
        if len(self.rows) > MAX_PIECES:
            raise ValueError(f"a piece table of more than {MAX_PIECES} rows is not broadcast")
        if any(r[3] == _USER for r in self.rows):
            raise ValueError("user-defined pieces are not supported")
        self.pieces = [(i, p, s) for i, p, s, kind in self.rows if kind == _NORMAL]
        self.unknown = next((i for i, _, _, kind in self.rows if kind == _UNKNOWN), 0)
        by_byte = {int(p[3:5], 16): i for i, p, _, kind in self.rows if kind == _BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.longest = max((len(p) for _, p, _ in self.pieces), default=1)
        self.worst = min((s for _, _, s in self.pieces), default=0.0) - 10.0

    def surfaces(self) -> list[str]:
        """Hex of the bytes that each id stands for; nothing for control pieces."""
        out = {}
        for i, p, _, kind in self.rows:
            out[i] = p[3:5] if kind == _BYTE else "" if kind == _CONTROL else (" ⁇ " if kind == _UNKNOWN else p).encode().hex()
        return [out.get(i, "") for i in range(max(out, default=-1) + 1)]

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


def read_model(path: str) -> PieceTable:
    """A SentencePiece model file (a local path: vocabulary files lie on every machine or with the driver)."""
    rows, spec = [], {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                p = dict(_fields(value))
                rows.append((len(rows), p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, _NORMAL)))
            elif number in (2, 3):
                spec[number] = dict(_fields(value))
    norm = spec.get(3, {})
    if norm.get(2):
        raise ValueError("only models with the identity normaliser are supported")
    return PieceTable(rows, spec.get(2, {}).get(3, 1) == 2, bool(norm.get(3, 1)), bool(norm.get(4, 1)))


def _ranked(model: PieceTable, spark: SparkSession) -> DataFrame:
    """piece, code: the rank of its score (0: the best; equals share one) in the high bits and the id in the 20 low ones. A last row without
    characters keeps words that hold no piece."""
    rank = {s: k for k, s in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    return spark.createDataFrame([*[(p, (rank[s] << 34) + i) for i, p, s in model.pieces], ("", 0)], "piece string, code long")


def lattice(words: DataFrame, model: PieceTable) -> DataFrame:
    """words: distinct word of at most LONG characters, other columns. Returns these and packed: an edge for every piece in the word, the best
    score first, then by start and n. An edge is a long, so that groups are small: they are held by tasks in hash tables of bounded size (see WORDS), as
    a sort would write every edge to disk."""
    more = [c for c in words.columns if c != "word"]
    starts = words.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    least = F.when(F.col("start") == 1, 0).otherwise(1)
    cut = starts.select("*", F.explode(F.sequence(least, F.least(F.lit(model.longest), F.length("word") - F.col("start") + 1))).alias("n"))
    cut = cut.withColumn("sub", F.substr(F.col("word"), F.col("start"), F.col("n")))
    edges = cut.join(F.broadcast(_ranked(model, words.sparkSession)), F.col("sub") == F.col("piece"))
    packed = F.expr("code + shiftleft(cast(start as long), 27) + shiftleft(cast(n as long), 20)")
    found = edges.groupBy("word").agg(*[F.first(c).alias(c) for c in more], F.sort_array(F.collect_list(packed)).alias("packed"))
    return found.select("word", *more, F.slice("packed", F.lit(2), F.size("packed")).alias("packed"))  # the row without characters is the least


def _edges(model: PieceTable) -> Column:
    """struct start, n, id, score of each packed edge, in their order; of BPE tables the score is the negated rank."""
    scores = ", ".join(f"{x!r}d" for x in sorted({s for _, _, s in model.pieces}, reverse=True))
    score = "-cast(shiftright(e, 34) as double)" if model.is_bpe else f"array({scores or '0d'})[cast(shiftright(e, 34) as int)]"
    return F.expr(f"""transform(packed, e -> struct(cast(shiftright(e, 27) & 127 as int) as start, cast(shiftright(e, 20) & 127 as int) as n,
        cast(e & {(1 << 20) - 1} as int) as id, {score} as score))""")


def _folded_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids by the single pass of _fold_merges() over packed edges, of all words of a batch side by side: the edges from one boundary left to the next are the pieces. Null
    for words whose merges must be taken one by one, and those with a character that no piece covers; these alone keep their edges."""
    one = np.uint64(1)
    for b in slices(batches, 4096):
        if not b.num_rows:
            continue
        size, lists = b.column("size_").to_numpy().astype(np.int64), b.column("packed")
        ends_of = lists.offsets.to_numpy().astype(np.int64)
        first, count = ends_of[:-1], np.diff(ends_of)
        e = lists.values.to_numpy(zero_copy_only=False)
        at, n = ((e >> 27) & 127) - 1, (e >> 20) & 127
        small = size <= BITS
        shift = lambda x: one << np.where(x < 64, x, 63).astype(np.uint64)
        ends = shift(at) | shift(at + n)
        inside = ends - (shift(at) << one)  # the bits between the two ends, and the higher end
        inside &= ~ends
        m = np.where(small, shift(np.where(small, size, 0) + 1) - one, 0)
        late = ~small
        for k in range(int(count[small].max(initial=0))):
            rows = np.flatnonzero(small & (count > k))
            j = first[rows] + k
            held = (m[rows] & ends[j]) == ends[j]
            rows, j = rows[held], j[held]
            more = np.bitwise_count(m[rows] & inside[j]) > 1
            late[rows[more]] = True
            m[rows[~more]] &= ~inside[j[~more]]
        word = np.repeat(np.arange(len(size)), count)
        e, at, ends, inside = (x[first[0] : ends_of[-1]] for x in (e, at, ends, inside))
        kept = np.flatnonzero(((m[word] & ends) == ends) & ((m[word] & inside) == 0) & ~late[word])
        kept = kept[np.lexsort((at[kept], word[kept]))]
        pieces = np.bincount(word[kept], minlength=len(size))
        bad = late | (pieces != np.bitwise_count(m).astype(np.int64) - 1)
        kept = kept[~bad[word[kept]]]
        pieces = np.where(bad, 0, pieces)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pieces)]), pa.int32(), mask=np.append(bad, False)), pa.array((e[kept] & ((1 << 20) - 1)).astype(np.int32)))
        packed = pc.if_else(pa.array(bad), lists, pa.scalar(None, lists.type))
        names = [c for c in b.schema.names if c != "packed"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], packed, ids], names=[*names, "packed", "folded"])


def _fold_merges() -> Column:
    """Boundaries of the pieces left when no two neighbours make an edge. Of words up to BITS characters the boundaries are the bits of a
    long, and a single pass over the edges, best first, merges each that has one boundary left inside. That is the order of merges
    unless an edge came up before its parts were there (two boundaries inside); such words, and longer ones, take the merges one by one."""
    by_score = """transform(filter(edges, e -> e.n > 1), e -> struct(
        shiftleft(1L, e.start - 1) | shiftleft(1L, e.start + e.n - 1) as ends, shiftleft(shiftleft(1L, e.n - 1) - 1, e.start) as inside))"""
    passed = f"""aggregate({by_score}, shiftleft(1L, size_ + 1) - 1,
        (m, e) -> if((m & e.ends) <> e.ends, m, if(bit_count(m & e.inside) > 1, m | shiftleft(1L, 63), m & ~e.inside)))"""
    bits = "filter(sequence(1, size_ + 1), i -> (m & shiftleft(1L, i - 1)) <> 0)"
    return F.expr(f"if(size_ <= {BITS}, transform(array({passed}), m -> if(m < 0, null, {bits}))[0], null)")


def _fold_merges_one_by_one() -> Column:
    """The same, a merge a step, the best score of all neighbours first, the leftmost of equals."""
    best = "array_max(transform(sequence(0, size(b) - 3), i -> struct(element_at(by_span, b[i] * 256 + b[i + 2] - b[i]) as score, -i as at)))"
    steps = f"""aggregate(sequence(2, greatest(size_, 2)), struct(sequence(1, size_ + 1) as b, false as done),
        (acc, k) -> if(acc.done or size(acc.b) < 3, acc, transform(array(acc.b), b -> transform(array({best}), m ->
            if(m.score is null, struct(b as b, true as done), struct(filter(b, (x, j) -> j <> 1 - m.at) as b, false as done)))[0])[0]),
        acc -> acc.b)"""
    pairs = "map_from_entries(transform(filter(edges, e -> e.n > 1), e -> struct(e.start * 256 + e.n, e.score)))"
    return F.expr(f"transform(array({pairs}), by_span -> {steps})[0]")


def _fold_viterbi() -> Column:
    """Boundaries of the best-scoring path; of equal scores the longer last piece."""
    best = """aggregate(sequence(1, size_), array(struct(cast(0 as double) as score, 0 as n)),
        (acc, j) -> concat(acc, array(coalesce(array_max(transform(filter(all_edges, e -> e.start + e.n - 1 = j), e -> struct(acc[e.start - 1].score + e.score as score, e.n as n))), struct(cast(-1e300 as double) as score, 1 as n)))))"""
    return F.expr(f"""transform(array({best}), best -> aggregate(sequence(1, size_), struct(array(size_ + 1) as b), (acc, k) ->
        if(acc.b[0] = 1, acc, struct(concat(array(acc.b[0] - best[acc.b[0] - 1].n), acc.b) as b)), acc -> acc.b))[0]""")


def encode_words(words: DataFrame, model: PieceTable) -> DataFrame:
    """words (distinct, non-empty, of at most LONG characters, with other columns) and their ids."""
    more = [c for c in words.columns if c != "word"]
    whole = lattice(words, model).withColumn("size_", F.length("word"))
    span = lambda e: e["start"] * 256 + e["n"]
    if model.is_bpe:
        fields = [*words.select("word", *more).schema.fields, T.StructField("size_", T.IntegerType()), T.StructField("packed", T.ArrayType(T.LongType()))]
        whole = whole.select(*[f.name for f in fields]).mapInArrow(_folded_bits, T.StructType([*fields, T.StructField("folded", T.ArrayType(T.IntegerType()))]))
    else:
        whole = whole.withColumn("folded", F.expr("cast(null as array<int>)"))
    whole = whole.withColumn("edges", F.when(F.col("folded").isNull(), _edges(model)))
    if model.is_bpe:
        cut = whole.withColumn("b", F.when(F.col("folded").isNull(), F.coalesce(_fold_merges(), _fold_merges_one_by_one())))
    else:
        covered = F.transform(F.filter("edges", lambda e: e["n"] == 1), lambda e: e["start"])
        bare = F.transform(F.array_except(F.sequence(F.lit(1), F.col("size_")), covered), lambda i: F.struct(i.alias("start"), F.lit(1).alias("n"), F.lit(-1).alias("id"), F.lit(model.worst).alias("score")))
        cut = whole.withColumn("all_edges", F.concat("edges", bare)).withColumn("b", _fold_viterbi())
    at = F.transform(F.sequence(F.lit(1), F.when(F.col("b").isNotNull(), F.size("b") - 1)), lambda i: F.struct(F.element_at("b", i).alias("start"), (F.element_at("b", i + 1) - F.element_at("b", i)).alias("n")))
    ids = F.map_from_entries(F.transform("edges", lambda e: F.struct(span(e), e["id"])))
    found = cut.select("word", *more, "folded", at.alias("at"), ids.alias("by_span"))
    picked = F.transform("at", lambda s: F.coalesce(F.nullif(F.array(F.element_at("by_span", span(s))), F.array(F.lit(None).cast("int"))), _spelled(F.substr(F.col("word"), s["start"], s["n"]), model)))
    return found.select("word", *more, F.coalesce("folded", F.flatten(picked)).alias("ids"))


def encode_long_words(words: DataFrame, model: PieceTable, window: int = 1024) -> DataFrame:
    """The same for words of more than LONG characters: windows that overlap by the longest piece are cut into substrings and joined, and the
    word's distinct pieces (no more than the table has) go to its fold, a heap of merges or the best path."""
    pieces = words.sparkSession.createDataFrame(model.pieces, "id int, piece string, score double")
    keyed = words.withColumn("key", F.sha2("word", 256))
    part = F.transform(F.sequence(F.lit(1), F.length("word"), F.lit(window)), lambda i: F.substr(F.col("word"), i, F.lit(window + model.longest - 1)))
    starts = keyed.select("key", F.explode(F.array_distinct(part)).alias("part")).select("key", "part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("start"))
    cut = starts.select("key", F.substr(F.col("part"), F.col("start"), F.lit(model.longest)).alias("part")).distinct()
    cut = cut.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda n: F.substr(F.col("part"), F.lit(1), n))).alias("sub"))
    edges = cut.join(F.broadcast(pieces), F.col("sub") == F.col("piece"))
    found = edges.groupBy("key").agg(F.collect_set(F.struct("piece", "id", "score")).alias("edges"))
    out = keyed.join(found, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            ids = []
            for word, edges in zip(b.column("word").to_pylist(), b.column("edges").to_pylist(), strict=True):
                encode = WordEncoder(model, [(e["id"], e["piece"], e["score"]) for e in edges or []])
                ids.append(np.frombuffer(encode(word), np.int32))
            kept = [c for c in b.schema.names if c != "edges"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "ids"])

    return out.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _spelled(char: Column, model: PieceTable) -> Column:
    """Byte pieces of a character, or the unknown piece."""
    if not model.bytes:
        return F.array(F.lit(model.unknown))
    table_ = F.split(F.lit(",".join(map(str, model.bytes))), ",")
    hex_ = F.hex(F.encode(char, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.length(hex_), F.lit(2)), lambda i: F.element_at(table_, (F.conv(F.substr(hex_, i, F.lit(2)), 16, 10).cast("int") + 1)).cast("int"))


class WordEncoder:
    """The ids of one word by the rules of the lattice's folds, from pieces (id, piece, score): the whole table, or those in the word."""

    def __init__(self, model: PieceTable, pieces: list[tuple[int, str, float]] | None = None):
        pieces = model.pieces if pieces is None else pieces
        self.model = model
        self.score = {p: s for _, p, s in pieces}
        self.id = {p: i for i, p, _ in pieces}

    def __call__(self, word: str) -> bytes:
        if not self.model.is_bpe:
            parts = _best_path(word, self.model, self.score)
        else:
            parts = _merge_short(word, self.score.get) if len(word) <= 64 else _merge_long(word, self.score)
        try:
            return array("i", [self.id[p] for p in parts]).tobytes()
        except KeyError:
            return array("i", [i for p in parts for i in ([self.id[p]] if p in self.id else self.model.spell(p))]).tobytes()


def _merge_short(word: str, get) -> list[str]:
    none = float("-inf")
    parts = list(word)
    scores = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
    while scores:
        best = max(scores)
        if best == none:
            break
        at = scores.index(best)
        both = parts[at] + parts[at + 1]
        parts[at : at + 2] = [both]
        del scores[at]
        if at:
            scores[at - 1] = get(parts[at - 1] + both, none)
        if at < len(scores):
            scores[at] = get(both + parts[at + 1], none)
    return parts


def _merge_long(word: str, score: dict[str, float]) -> list[str]:
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here
    start_of = list(range(n))  # of the piece that ends at i + 1
    alive = [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (s := score.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-s, a, b, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == c):
            continue
        alive[b] = False
        end[a] = c
        start_of[c - 1] = a
        offer(a)
        if a:
            offer(start_of[a - 1])
    parts, at = [], 0
    while at < n:
        parts.append(word[at : end[at]])
        at = end[at]
    return parts


def _best_path(word: str, model: PieceTable, score: dict[str, float]) -> list[str]:
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = [(best[j - m][0] + score[word[j - m : j]], m) for m in range(1, min(j, model.longest) + 1) if word[j - m : j] in score]
        if word[j - 1] not in score:
            options.append((best[j - 1][0] + model.worst, 1))
        best.append(max(options))
    parts, at = [], len(word)
    while at:
        parts.append(word[at - best[at][1] : at])
        at -= best[at][1]
    return parts[::-1]


class _Splitter:
    """Normalises a text and cuts it into words."""

    def __init__(self, model: PieceTable):
        self.prefix, self.strip = model.dummy_prefix, model.strip_spaces
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __call__(self, text: str) -> list[str]:
        if self.prefix and text and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        t = text.replace(" ", SPACE)
        if self.strip:
            t = re.sub(f"{SPACE}+", SPACE, t.strip(SPACE))
        if not t:
            return []
        return self.cut.findall(SPACE + t if self.prefix else t)

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The words of each of texts, none of them null. Those with single spaces inside only are cut together, the others one by one."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False) | (not self.prefix)
        own = pa.array([self(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        if odd.all():
            return own
        plain = pc.binary_join_element_wise(SPACE, texts.filter(pa.array(~odd)), "")
        plain = pc.split_pattern(pc.replace_substring(plain, " ", f" {SPACE}"), " ")
        if not odd.any():
            return plain
        return pa.concat_arrays([plain, own]).take(pa.array(np.where(odd, len(plain) + np.cumsum(odd), np.cumsum(~odd)) - 1))


def _light(batches: Iterator[pa.RecordBatch], column: int | str, rows: int = 2048, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts are of at most so many bytes together, or a row each."""
    for b in slices(batches, rows):
        total, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, most + (total[at - 1] if at else 0), "right")))
            yield b.slice(at, end - at)
            at = end


def _by_group(b: pa.RecordBatch, text: int | str, group: int | str) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Each group, its rows that have a text, and these texts."""
    there, of = b.column(text).is_valid().to_numpy(zero_copy_only=False), b.column(group).to_numpy()
    for g in np.unique(of[there]).tolist():
        rows = np.flatnonzero(there & (of == g))
        yield g, rows, b.column(text).take(pa.array(rows))


class _Cutter:
    """Cuts words where no piece of a BPE table has the two characters side by side: no merge crosses such a place, so the ids of the parts, in a row, are
    the word's. U+2581 stays with what follows. Pairs are held as bits by a hash; an equal hash leaves a place uncut, which changes no ids. Words of other
    tables are left whole, as sums of their scores would be rounded otherwise."""

    def __init__(self, model: PieceTable):
        self.bits = None
        if model.is_bpe:
            self.bits = np.zeros(1 << 22, bool)
            text = "".join(f"{p}\0" for _, p, _ in model.pieces)
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            self.bits[self._place(code[:-1], code[1:])] = True

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(10)

    def __call__(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all words, and how many each word has."""
        if self.bits is None or not words:
            return words, np.ones(len(words), np.int64)
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.bits[self._place(code[:-1], code[1:])] & (code[:-1] != ord(SPACE))
        cut[first] = True
        at = np.flatnonzero(cut).tolist()
        return [text[i:j] for i, j in zip(at, [*at[1:], len(text)], strict=True)], np.add.reduceat(cut, first, dtype=np.int64)


#: Rows of a group of documents, for texts of under 2 LENGTH characters; each doubling of the length halves it, so that a group's words are bounded.
ROWS, LENGTH = 4096, 4096


def grouped(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with a column that names each row's group, and its name: by the row's place in its file and its text's length, so that each pass over docs
    finds the same. Tables that are no files are written first."""
    place = ["_metadata.file_path", "_metadata.row_index"]
    try:
        docs.select(*place)
    except AnalysisException:
        docs = materialise(docs, "docs")
    name = free_name(docs, "group")
    halvings = F.floor(F.log2(F.greatest(F.coalesce(F.length(text_col), F.lit(0)) / LENGTH, F.lit(1)))).cast("int")
    halvings = F.least(halvings, F.lit(ROWS.bit_length() - 1))
    return docs.select("*", F.xxhash64(F.col(place[0]), halvings, F.floor(F.col(place[1]) * F.pow(F.lit(2.0), halvings) / ROWS)).alias(name)), name


def count_words(docs: DataFrame, model: PieceTable, text_col: str, group: str, flush: int = 200_000) -> DataFrame:
    """word, n, groups: how often each word occurs in all texts, and in which groups; words are the parts that _Cutter makes. A task that holds many words hands
    on its counts and starts anew, so the counts are exact and its memory bounded."""
    split, cut = _Splitter(model), _Cutter(model)

    def together(counts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

    def handed_on(counts: dict[int, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for g, c in counts.items():
            whole = together(c)
            parts, per = cut(whole.column("word").to_numpy().tolist())
            own = together([pa.table({"word": pa.array(parts, pa.string()), "n": np.repeat(whole.column("n").to_numpy(), per)})])
            for b in own.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(np.full(b.num_rows, g, np.int64)), b.column("n")], names=["word", "g", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[pa.Table]] = defaultdict(list)
        size = lambda: sum(t.num_rows for c in counts.values() for t in c)
        for b in _light(batches, 0):
            for g, _, texts in _by_group(b, 0, 1):
                words = split.lists(texts).flatten().dictionary_encode()
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
                counts[g].append(pa.table({"word": words.dictionary, "n": n}))
            if size() > 2 * flush:
                counts = defaultdict(list, {g: [together(c)] for g, c in counts.items()})
                if size() > flush:
                    yield from handed_on(counts)
                    counts = defaultdict(list)
        yield from handed_on(counts)

    rows = docs.select(text_col, group).mapInArrow(run, "word string, g long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.collect_set("g").alias("groups"))


def least_count(counts: DataFrame, bound: int) -> int:
    """The count from which on words are at most bound, all of equal count or none."""
    sizes = counts.where(F.length("word") <= LONG).groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(bound + 1).collect()
    least, total = 1_000_001, 0
    for r in sizes:
        total += r["k"]
        if total > bound:
            break
        least = r["n"]
    return least


class _Dictionaries:
    """Reads the dictionaries of groups from the shared folder, and holds some: at most that many words, and no more than half of that while it reads another."""

    def __init__(self, folder: str, most: int = 200_000):
        self.folder, self.most, self.held = folder, most, {}
        self.store, self.base = None, None

    def __call__(self, group: int) -> dict[str, bytes]:
        if group in self.held:
            return self.held[group]
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        if self.store is None:
            self.store, self.base = pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        self._leave(self.most // 2)
        out: dict[str, bytes] = {}
        for f in self.store.get_file_info(pafs.FileSelector(f"{self.base}/group={group}", allow_not_found=True)):
            if f.base_name.startswith(("_", ".")):
                continue
            with self.store.open_input_file(f.path) as file:
                for b in pq.ParquetFile(file).iter_batches(columns=["word", "ids"]):
                    ids = b.column("ids")
                    raw, ends = ids.values.to_numpy().astype(np.int32).tobytes(), (ids.offsets.to_numpy() * 4).tolist()
                    out.update(zip(b.column("word").to_pylist(), [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        self._leave(self.most - len(out))
        self.held[group] = out
        return out

    def _leave(self, words: int) -> None:
        while self.held and sum(map(len, self.held.values())) > words:
            self.held.pop(next(iter(self.held)))


class _Packer:
    """The packed ids of words: frequent ones by the table that all share, others by their parts, for each of which its group's dictionary has ids. It
    remembers some words of the group that it met last."""

    def __init__(self, model: PieceTable, common: dict[str, bytes], dictionaries: _Dictionaries, most: int = 50_000):
        self.common, self.dictionaries, self.most, self.cut = common, dictionaries, most, _Cutter(model)
        self.group, self.known = None, {}

    def __call__(self, group: int, words: pa.Array) -> pa.Array:
        """Of each of the words, a distinct one being looked up once."""
        if group != self.group or len(self.known) > self.most:
            self.group, self.known = group, {}
        common, known = self.common, self.known
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = [common.get(w) or known.get(w) for w in distinct]
        if new := [w for w, x in zip(distinct, packed, strict=True) if x is None]:
            parts, per = self.cut(new)
            rare = self.dictionaries(group)
            ids = [common.get(u) or rare[u] for u in parts]
            end = np.cumsum(per).tolist()
            known.update(zip(new, [ids[j - 1] if k == 1 else b"".join(ids[j - k : j]) for j, k in zip(end, per.tolist(), strict=True)], strict=True))
            packed = [x or known[w] for w, x in zip(distinct, packed, strict=True)]
        return pa.array(packed, pa.binary()).take(coded.indices)


def encode(docs: DataFrame, model: PieceTable, text_col: str = "text", lattice_words: int = 120_000) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, whose names are returned: number of words, ids of pieces (as 4-byte little-endian integers; see
    unpacked()), and the text decoded from these ids. lattice_words: how many words' encodings are broadcast; the others come by group."""
    spark = docs.sparkSession
    n_words, ids, decoded = (free_name(docs, n) for n in ("n_words", "ids", "decoded"))
    out = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    docs, group = grouped(docs, text_col)
    counts = materialise(count_words(docs, model, text_col, group), "words")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = least_count(counts, lattice_words)
    short = F.length("word") <= LONG
    found = encode_words(counts.where(short & (F.col("n") >= least)).select("word").repartition(tasks, "word"), model).toArrow()  # lattice_words rows at most
    known = {w: np.array(i, np.int32).tobytes() for b in found.to_batches() for w, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    folder = fresh_path(spark, "encodings")
    others = counts.where(short & (F.col("n") < least)).select("word", "groups")
    some = others.count() // WORDS // PARTS + 1
    made = [encode_words(others.where(F.pmod(F.hash("word"), PARTS) == k).repartition(some, "word"), model) for k in range(PARTS)]
    for rare in [*made, encode_long_words(counts.where(~short).select("word", "groups"), model)]:
        write_table(rare.select("word", "ids", F.explode("groups").alias("group")).repartition("group"), folder, "group", groups_held=4 * WORDS)
    discard(counts)
    shared = spark.sparkContext.broadcast((model, known))
    split = _Splitter(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, common = shared.value
        decoder, pack = Decoder(m), _Packer(m, common, _Dictionaries(folder))
        for b in _light(batches, text_col):
            packed, words = [None] * b.num_rows, [0] * b.num_rows
            for g, rows, texts in _by_group(b, text_col, group):
                lists = split.lists(texts)
                n = pc.list_value_length(lists).to_numpy()
                _, ends, raw = pack(g, lists.flatten()).buffers()
                at = np.frombuffer(ends, np.int32)[np.concatenate([[0], np.cumsum(n)])].tolist() if raw else [0] * (len(n) + 1)
                raw = memoryview(raw or b"")
                for k, w, i, j in zip(rows.tolist(), n.tolist(), at[:-1], at[1:], strict=True):
                    packed[k], words[k] = bytes(raw[i:j]), w
            back = pa.array([None if x is None else decoder(x) for x in packed], pa.string())
            kept = [c for c in b.schema.names if c != group]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(words, pa.int64()), pa.array(packed, pa.binary()), back], names=[*kept, n_words, ids, decoded])

    return docs.mapInArrow(run, out), n_words, ids, decoded


class Decoder:
    """The text of packed ids."""

    def __init__(self, model: PieceTable):
        self.surfaces = pa.array([bytes.fromhex(x) for x in model.surfaces()], pa.binary())
        self.prefix = model.dummy_prefix

    def __call__(self, packed: bytes) -> str:
        _, ends, raw = self.surfaces.take(pa.array(np.frombuffer(packed, np.int32))).buffers()
        size = int(np.frombuffer(ends, np.int32)[len(packed) // 4]) if raw else 0
        text = str(memoryview(raw)[:size], "utf-8", "replace").replace(SPACE, " ") if size else ""
        return text[1:] if self.prefix and text.startswith(" ") else text


def unpacked(ids: Column) -> Column:
    """array<int> of packed ids. Cut from the bytes, where a place is found without walking there, so time is linear in the text."""
    four = lambda i: F.hex(F.substring(ids, i * 4 + 1, F.lit(4)))
    at = lambda i, k: F.substring(four(i), k, 2)
    word = lambda i: F.conv(F.concat(at(i, 7), at(i, 5), at(i, 3), at(i, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), word)).when(ids.isNotNull(), F.expr("cast(array() as array<int>)"))


def decode(ids: Column, model: PieceTable) -> Column:
    """The text that ids (array<int>) stand for, in DataFrame functions: for ids from elsewhere."""
    surfaces = F.split(F.lit(",".join(model.surfaces())), ",", -1)
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(surfaces, i + 1)), ""))
    text = F.replace(F.decode(raw, "utf-8"), F.lit(SPACE), F.lit(" "))
    return F.when(F.startswith(text, F.lit(" ")), F.substr(text, F.lit(2))).otherwise(text) if model.dummy_prefix else text


def tokenizer_path(name: str = "piece_bpe_32k.model", folder: str | None = None) -> str:
    return f"{folder or os.environ.get('VOLSPARK_TOKENIZERS', '/opt/tokenizers')}/{name}"


def op2_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, ids_sha256 (of the ids as 4-byte little-endian integers), text_sha256 (of the text decoded from them)."""
    model = read_model(model_path or tokenizer_path())
    out, n_words, ids, decoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", F.col(n_words).alias("n_words"), F.coalesce(F.octet_length(ids) / 4, F.lit(0)).cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("text_sha256"))
