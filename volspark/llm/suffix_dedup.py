"""Removal of byte strings of 200 bytes that occur more than once, by a distributed merge sort of sampled suffixes.

Which suffixes: of all 64-byte strings that start at 137 successive places, the place of the least hash (the leftmost of
equals) is an anchor. Any two equal 200-byte strings therefore hold an anchor at the same offset, so only suffixes at
anchors, about one place in 69, are sorted, and only those whose 64 bytes are those of another anchor.

An anchor has a right context (200 bytes from the anchor on, fewer at the end of the text) and a left context (the 136
bytes before it, reversed). The 200-byte string that starts l bytes before the anchor is repeated iff another anchor agrees with it on
l left and on 200 - l right bytes. Both orders come from the same merge sort:

* a map task sorts its contexts and front-codes the run: for each string the length it shares with the one before it, and the
  remaining bytes; runs are exchanged by a hash of the anchor's 64 bytes, so equal anchors meet in one bucket;
* a reduce task merges the runs with a loser tree whose players carry the length they share with the last output: players of
  different known lengths are decided by these alone, equal ones compare bytes from the known length on. No known
  prefix is compared again, and the merge yields the shared length of neighbours along with the order.

In each order, cutting between neighbours that share less than a depth numbers the classes of that depth; anchors of equal
class in both orders (left depth l, right depth 200 - l) are occurrences of one 200-byte string, counted for each l over a whole bucket.

Skew: texts that are equal as a whole are one text for the sort (each is repeated throughout if it has 200 bytes).
Anchors of one task that agree in both contexts are decided there; one of them, marked, stands for them in the bucket, and
their spans travel in buckets chosen at random. Anchors whose 64 bytes occur more than ``hot`` times skip the sort: their 137
strings are hashed (128 bits) and counted with partial aggregation, so no bucket holds an unbounded group.

Defined cases: null is empty; texts under 200 bytes lose nothing; overlapping repeats inside one text count;
repeated rows are copies of each other; ids may be null, repeated and of any type; very long texts are searched in chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import discard, free_name, materialise, mix64, slices, table

LENGTH, GRAM = 200, 64
WIDTH = LENGTH - GRAM + 1  # places of 64-byte strings inside a 200-byte string
LEFT = LENGTH - GRAM
_CHUNK = 1 << 18
_BASE = 0xD1342543DE82EF95

_state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse for a chunk; made once per Python worker."""
    global _state
    if _state is None:
        rng = np.random.Generator(np.random.PCG64(7))
        values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = _CHUNK + LENGTH + 1

        def series(base: int) -> np.ndarray:
            x = np.full(n, base, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        _state = (values, series(_BASE), series(pow(_BASE, -1, 1 << 64)))
    return _state


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in raw, ascending, and the hashes of their 64 bytes. In chunks, so memory does not follow the text."""
    values, power, inverse = _powers()
    data = np.frombuffer(raw, np.uint8)
    windows = len(data) - LENGTH + 1
    places, hashes = [], []
    for a in range(0, max(windows, 0), _CHUNK):
        count = min(_CHUNK, windows - a)
        part = data[a : a + count + LENGTH - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=total[1:])
        n = len(part) - GRAM + 1
        h = mix64((total[GRAM:] - total[:n]) * inverse[:n])
        key = (h & np.uint64(0xFFFFFFFFFFF80000)) | np.arange(n, dtype=np.uint64)  # leftmost of equals; a chunk has under 2^19 places
        padded = np.full(-(-n // WIDTH) * WIDTH, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = key
        grid = padded.reshape(-1, WIDTH)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[WIDTH - 1 : WIDTH - 1 + count])
        at = (least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64(0x7FFFF)).astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    keep = np.concatenate(([True], p[1:] > p[:-1])) if len(p) else np.zeros(0, bool)
    return p[keep], h[keep]


# --- sorted runs -------------------------------------------------------------------------------------------------


def shared_lengths(strings: list[bytes], width: int) -> np.ndarray:
    """For sorted strings of at most width bytes, the length each shares with the one before it (0 for the first)."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    out = np.zeros(n, np.int64)
    for a in range(1, n, 8192):
        b = min(n, a + 8192)
        differ = grid[a:b] != grid[a - 1 : b - 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[a:b] = np.minimum(first, np.minimum(sizes[a:b], sizes[a - 1 : b - 1]))
    return out


def front_code(strings: list[bytes], width: int) -> tuple[bytes, bytes, bytes]:
    """Sorted strings as shared lengths, whole lengths (a byte each) and the remaining bytes, compressed."""
    shared = shared_lengths(strings, width)
    rest = b"".join(s[k:] for s, k in zip(strings, shared.tolist(), strict=True))
    return shared.astype(np.uint8).tobytes(), np.fromiter(map(len, strings), np.uint8, len(strings)).tobytes(), zlib.compress(rest, 1)


def front_decode(shared: bytes, sizes: bytes, rest: bytes) -> list[bytes]:
    rest = zlib.decompress(rest)
    out, last, at = [], b"", 0
    for k, n in zip(shared, sizes, strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (strings, shared lengths within the run). Returns (run, index) in order, and the length
    each shares with the one before it. A loser tree: every inner node keeps the loser of its match, with the length it
    shares with the winner that passed."""
    k = len(runs)
    at = [0] * k
    known = [0] * k  # length shared with the last output; of a loser, with the winner it lost to
    heads = [r[0][0] if r[0] else None for r in runs]
    order: list[tuple[int, int]] = []
    lengths: list[int] = []

    def beats(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of players a and b; the loser's known length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = min(len(x), len(y))
        if p < n:
            d = int.from_bytes(x[p:n], "big") ^ int.from_bytes(y[p:n], "big")
            if d:
                same = n - (d.bit_length() + 7) // 8
                if x[same] < y[same]:
                    known[b] = same
                    return a, b
                known[a] = same
                return b, a
        if len(x) < len(y) or len(x) == len(y) and a < b:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    size = 1
    while size < k:
        size *= 2
    heads += [None] * (size - k)
    known += [0] * (size - k)
    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, loser = beats(build(2 * node), build(2 * node + 1))
        losers[node] = loser
        return w

    winner = build(1) if size > 1 else 0
    while heads[winner] is not None:
        strings, shared = runs[winner]
        i = at[winner]
        order.append((winner, i))
        lengths.append(known[winner])
        i += 1
        at[winner] = i
        if i < len(strings):
            heads[winner] = strings[i]
            known[winner] = shared[i]
        else:
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            w, loser = beats(winner, losers[node])
            losers[node], winner = loser, w
            node >>= 1
    return order, lengths


def repeated_offsets(left_rank: np.ndarray, left_shared: np.ndarray, right_rank: np.ndarray, right_shared: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each l, the anchors whose string from l bytes before is repeated. Ranks place an anchor in an order, many marks those that
    stand for several."""
    n = len(left_rank)
    for l in range(WIDTH):  # noqa: E741
        left = np.cumsum(left_shared < l)[left_rank]
        right = np.cumsum(right_shared < LENGTH - l)[right_rank]
        key = left * np.int64(n + 1) + right
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(n, bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        yield l, hit | many


def _intervals(hits: np.ndarray, places: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """hits: (anchors x offsets). Bytes covered: (anchor, start, end) for each run of offsets that stay inside the text."""
    l = np.arange(WIDTH)  # noqa: E741
    hits = hits & (l[None, :] <= before[:, None]) & (LENGTH - l[None, :] <= after[:, None])
    edges = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    for i, a, b in zip(rows.tolist(), first.tolist(), stop.tolist(), strict=True):
        yield i, int(places[i]) - (b - 1), int(places[i]) - a + LENGTH


# --- map and reduce ----------------------------------------------------------------------------------------------

_RUN = "bucket int, text binary, place binary, before binary, after binary, many binary, l_shared binary, l_sizes binary, l_rest binary, l_order binary, r_shared binary, r_sizes binary, r_rest binary, spans binary"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_SPANS = "text binary, spans binary"


def _pack_spans(found: dict[bytes, list[tuple[int, int]]]) -> tuple[list[bytes], list[bytes]]:
    return list(found), [np.array(v, np.int64).tobytes() for v in found.values()]


def _run_maker(buckets: int):
    def flush(members: list[tuple[bytes, bytes, bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        """members: (right, left, text, place, bytes before, bytes after)."""
        dealt: dict[int, list] = {}
        for m in members:
            dealt.setdefault(xxhash.xxh32_intdigest(m[0][:GRAM], 11) % buckets, []).append(m)
        out, spare = [], {}
        for bucket, ms in dealt.items():
            ms.sort(key=lambda m: (m[0], m[1]))
            kept, many = [], []
            for m in ms:
                if kept and kept[-1][0] == m[0] and kept[-1][1] == m[1]:
                    if not many[-1]:
                        many[-1] = 1
                    spare.setdefault(m[2], []).append(m)
                else:
                    kept.append(m)
                    many.append(0)
            lefts = sorted(range(len(kept)), key=lambda i: kept[i][1])
            r = front_code([m[0] for m in kept], LENGTH)
            left = front_code([kept[i][1] for i in lefts], LEFT)
            numbers = [np.array([m[j] for m in kept], np.int64).tobytes() for j in (3, 4, 5)]
            out.append((bucket, b"".join(m[2] for m in kept), *numbers, bytes(many), *left, np.array(lefts, np.int32).tobytes(), *r, None))
        for text, ms in spare.items():
            found = {text: []}
            places, before, after = (np.array([m[j] for m in ms]) for j in (3, 4, 5))
            for _, a, b in _intervals(np.ones((len(ms), WIDTH), bool), places, before, after):
                found[text].append((a, b))
            _, packed = _pack_spans(found)
            out.append((xxhash.xxh32_intdigest(text, 5) % buckets, text, *[None] * 11, packed[0]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names=_RUN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = []
        for b in batches:
            for text, raw, places in zip(*(b.column(n) for n in ("d", "raw", "places")), strict=True):
                text, raw = text.as_py(), raw.as_py()
                for p in places.as_py():
                    if 0 <= p <= len(raw) - GRAM:
                        members.append((raw[p : p + LENGTH], raw[max(0, p - LEFT) : p][::-1], text, p, p, len(raw) - p))
                if len(members) >= 60_000:  # a run per so many anchors bounds the task's memory
                    yield from flush(members)
                    members = []
        yield from flush(members)

    return run


def _merge_bucket(batches: pa.Table) -> pa.Table:
    runs, texts, spans = [], [], []
    columns = {n: batches.column(n).to_pylist() for n in _RUN_NAMES}
    for i, packed in enumerate(columns["spans"]):
        if packed is not None:
            texts.append(columns["text"][i])
            spans.append(packed)
        else:
            runs.append({n: columns[n][i] for n in _RUN_NAMES})
    del columns
    if runs:
        sizes = [len(r["many"]) for r in runs]
        base = np.concatenate(([0], np.cumsum(sizes)))
        owner = [r["text"][j : j + 16] for r in runs for j in range(0, len(r["text"]), 16)]
        place, before, after = (np.concatenate([np.frombuffer(r[n], np.int64) for r in runs]) for n in ("place", "before", "after"))
        many = np.concatenate([np.frombuffer(r["many"], np.uint8) for r in runs]) > 0
        ranks = []
        for side in "lr":
            order, shared = merge_runs([(front_decode(r[f"{side}_shared"], r[f"{side}_sizes"], r[f"{side}_rest"]), r[f"{side}_shared"]) for r in runs])
            own = [np.frombuffer(r["l_order"], np.int32) for r in runs] if side == "l" else None
            rank = np.empty(len(owner), np.int64)
            which = np.fromiter((base[k] + (own[k][i] if own else i) for k, i in order), np.int64, len(order))
            rank[which] = np.arange(len(order))
            ranks += [rank, np.array(shared, np.int64)]
        hits = np.zeros((len(owner), WIDTH), bool)
        for l, hit in repeated_offsets(*ranks, many):  # noqa: E741
            hits[:, l] = hit
        found: dict[bytes, list[tuple[int, int]]] = {}
        for i, a, b in _intervals(hits, place, before, after):
            found.setdefault(owner[i], []).append((a, b))
        more, packed = _pack_spans({k: merged(v) for k, v in found.items()})
        texts += more
        spans += packed
    return pa.table({"text": pa.array(texts, pa.binary()), "spans": pa.array(spans, pa.binary())})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, ascending; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each 200-byte string around the hot anchors, with its text and start."""
    for b in batches:
        for text, raw, places in zip(*(b.column(n) for n in ("d", "raw", "hot")), strict=True):
            text, raw = text.as_py(), raw.as_py()
            starts = sorted({s for p in places.as_py() for s in range(max(0, p - LEFT), min(p, len(raw) - LENGTH) + 1)})
            if starts:
                keys = [hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([text] * len(starts), pa.binary()), pa.array(starts, pa.int64())], names=["k", "text", "start"])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        removed, count, kept, text = [], [], [], []
        for raw, packed in zip(b.column("raw"), b.column("spans"), strict=True):
            raw = raw.as_py()
            spans = merged([tuple(x) for p in packed.as_py() for x in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()])
            at, out = 0, []
            for x, y in spans:
                out.append(raw[at:x])
                at = y
            kept.append(b"".join([*out, raw[at:]]))
            text.append(kept[-1].decode("utf-8", "ignore"))
            removed.append(sum(y - x for x, y in spans))
            count.append(len(spans))
        yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(text, pa.string())], names=["d", "n_removed", "n_spans", "kept", "text"])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hs, owners, ps = [], [], []
        for raw, short in zip(b.column("raw"), b.column("d64"), strict=True):
            p, h = anchors(raw.as_py())
            hs.append(h.view(np.int64))
            ps.append(p.astype(np.int32))
            owners.append(np.full(len(p), short.as_py(), np.int64))
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, owners, ps)], names=["h", "d64", "place"])


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 100_000, bucket_anchors: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(copies, cut). copies: d (16 bytes of the SHA-256 of a text that several rows have). cut: d, n_removed, n_spans, kept (bytes), text (what is valid of them) of texts
    that lose something and have no copy; at most a row per text."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).alias("id"), raw.alias("raw"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("d"))
    d64 = F.xxhash64("d")
    rows = rows.select("d", "raw", d64.alias("d64"), F.coalesce("id", d64).alias("key")).where(F.octet_length("raw") >= LENGTH)

    found = materialise(rows.select("d64", "raw").mapInArrow(_find_anchors, "h long, d64 long, place int"), "anchors")
    spot = F.xxhash64("d64", "place")
    again = found.groupBy("h").agg(F.min(spot).alias("least"), F.max(spot).alias("most"), F.count("*").alias("n")).where("least <> most")
    again = materialise(again.select(F.col("h").alias("again"), (F.col("n") > hot).alias("is_hot")), "repeated-anchors")
    texts = materialise(rows.groupBy("d").agg(F.min("d64").alias("d64"), F.min("key").alias("key"), F.count("*").alias("n")), "texts")
    sought = found.join(again, F.col("h") == F.col("again")).groupBy("d64").agg(F.collect_set(F.when(~F.col("is_hot"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("is_hot"), F.col("place"))).alias("hot"))
    wanted = texts.join(sought, "d64").select(F.col("key").alias("w_key"), F.col("d").alias("w_d"), F.col("n").alias("copies"), "places", "hot")
    held = rows.join(wanted, (F.col("key") == F.col("w_key")) & (F.col("d") == F.col("w_d"))).select("d", "raw", "copies", "places", "hot")
    held = materialise(held, "sought-texts")
    discard(found)

    total, any_hot = held.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)), F.coalesce(F.max(F.size("hot")), F.lit(0))).first()
    runs = held.select("d", "raw", "places").mapInArrow(_run_maker(max(1, -(-total // bucket_anchors))), _RUN)
    spans = materialise(runs.groupBy("bucket").applyInArrow(_merge_bucket, _SPANS), "spans")
    if any_hot:
        strings = held.where(F.size("hot") > 0).select("d", "raw", "hot").mapInArrow(_hot_strings, "k binary, text binary, start long")
        strings = materialise(strings, "hot-strings")
        place = F.xxhash64("text", "start")
        twice = strings.groupBy("k").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select(F.col("k").alias("k2"))
        twice = materialise(twice, "repeated-strings")  # a join of two plain exchanges, which adaptive execution can split at a hot string
        packed = F.unhex(F.concat(*[_little_endian(c) for c in (F.col("start"), F.col("start") + LENGTH)]))
        spans = spans.unionByName(strings.join(twice, F.col("k") == F.col("k2")).select("text", packed.alias("spans")))
    by_text = spans.groupBy("text").agg(F.collect_list("spans").alias("spans"))
    single = held.where("copies = 1").dropDuplicates(["d"]).select("d", "raw")
    cut = single.join(by_text, F.col("d") == F.col("text")).select("d", "raw", "spans").mapInArrow(_cutter, "d binary, n_removed long, n_spans long, kept binary, text string")
    return texts.where("n > 1").select("d"), cut


def _little_endian(c):
    """The 16 hex digits of a long's bytes, lowest first."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated bytes cut out of the texts (what a cut leaves of a character goes, too); null texts stay null."""
    copies, cut = cut_texts(docs, id_col, text_col)
    info = copies.select("d", F.lit("").alias("kept")).unionByName(cut.select("d", F.col("text").alias("kept")))
    d, kept, key = (free_name(docs, n) for n in ("d", "kept", "key"))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumn(key, F.when(F.octet_length(raw) >= LENGTH, F.unhex(F.substring(F.sha2(raw, 256), 1, 32))))
    out = keyed.join(info.toDF(d, kept), F.col(key) == F.col(d), "left")
    return out.select(*[F.coalesce(kept, text_col).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    copies, cut = cut_texts(docs)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    mine = docs.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("own_sha"))
    info = copies.select("d", F.lit(True).alias("is_copy")).unionByName(cut.select("d", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), allowMissingColumns=True)
    key = F.when(F.col("n_bytes") >= LENGTH, F.unhex(F.substring("own_sha", 1, 32)))
    out = mine.withColumn("key", key).join(info, F.col("key") == F.col("d"), "left")
    whole = F.col("is_copy").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
    )


#: Texts as hex digits, two a byte; a 200-byte string is 400 digits.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w WHERE k IN (SELECT k FROM twice)),
run AS (SELECT r, i, sum(CASE WHEN p IS NULL OR p + 200 < i THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit),
span AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, g),
gap AS (SELECT r, b AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000) AS b FROM span UNION ALL SELECT r, 0, min(a) FROM span GROUP BY r),
kept AS (SELECT gap.r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gap JOIN d USING (r) GROUP BY gap.r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
