"""Near-duplicate classes: circulant MinHash candidates, exact Jaccard, connected components.

Words are maximal runs of bytes other than ASCII white space after A-Z are lower-cased; a document's set holds the
64-bit hashes of its distinct k-word shingles (the whole sequence where there are fewer words).

Circulant MinHash: a first permutation (a bijective mixer) sends shingles into a universe of 2^20 places; a second,
stored permutation p of that universe gives coordinate j as min p[(x + j) mod 2^20], so one permutation, circularly
shifted, generates all coordinates. Bands of ``rows`` coordinates hash to buckets; at similarity 0.8 all of 32 bands
of 4 miss with probability 5e-8.

Odd sketch: 2048 parity bits, each shingle flips one. Two odd sketches differ in at most as many bits as the sets
differ in shingles, and similarity 0.8 allows (n + m) / 9 of these, so "odd sketches differ in more" refutes a pair without any
error; so does a ratio of sizes under 0.8. What neither refutes is confirmed on full sets.

Links, without ever listing the pairs of a bucket:
1. a node is a set (its print: 128 bits and the size), however many documents, ids or null ids have it; the texts that
   confirm a link are found by the print, so every text of a repeated id counts;
2. round 1: within each band, nodes are range-sorted by (bucket, signature digest, print) and neighbours in that order are
   refuted or confirmed: n - 1 pairs for a bucket of n, whatever its size, and no task holds a bucket;
3. components of the confirmed links;
4. round 2: in each bucket that still holds several components, members outside its largest component meet
   the members of other components, refuted by both tests inside the join. So every candidate pair is confirmed,
   refuted, or already in one component. Buckets of any size are joined by cells of set size, outer members with the neighbouring
   cells, too: a cut that loses no pair, as similarity bounds the ratio of sizes;
5. components of all confirmed links, by alternating large-star and small-star rounds (few links: in one task); sets that one id has are linked as well, where ids are labelled.

Hot buckets are joins that adaptive execution splits; nodes of many links (at most some thousand by their number) are broadcast;
sets travel only for nodes in candidate pairs.

Defined cases: null, empty or wordless texts have an empty set, are linked with nothing and stay; ids may be of any type that has
an order; a document without an id is linked like others, but is not the smallest id of a class that has ids, and its row is its
own null component; repeated rows are equal sets and get a row each; an id with several texts has the links of all of them. Words are hashed
in pieces of ``_PIECE`` bytes, so a very long text takes some 40 bytes a word and not many times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import discard, drop_path, free_name, fresh_path, materialise, mix64, slices, table, write_table
from volspark.operators.regions import resolve

BANDS, ROWS = 32, 4
_UNIVERSE = 1 << 20
#: Parity bits of the odd sketch.
_ODD = 2048

#: Bytes of a text that are hashed at a time.
_PIECE = 1 << 18
_BASE = 0xD1342543DE82EF95

_tables: tuple[np.ndarray, ...] | None = None


def _fixed() -> tuple[np.ndarray, ...]:
    """Byte values of the word hash, powers of its base and of the inverse, the shifted windows of the second permutation; one per Python worker."""
    global _tables
    if _tables is None:
        rng = np.random.Generator(np.random.PCG64(20240229))
        byte_values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        perm = rng.permutation(_UNIVERSE).astype(np.uint32)
        n = BANDS * ROWS
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((perm, perm[: n - 1])), n)

        def series(base: int) -> np.ndarray:
            x = np.full(_PIECE, base, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        _tables = (byte_values, series(_BASE), series(pow(_BASE, -1, 1 << 64)), windows)
    return _tables


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and unmixed hashes of the words of a piece."""
    values, power, back, _ = _fixed()
    is_word = np.zeros(len(raw) + 2, np.int8)
    is_word[1:-1] = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * power[: len(raw)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * back[starts]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the text."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, open_sum, open_length = [], 0, 0
    for a in range(0, len(raw), _PIECE):
        piece = raw[a : a + _PIECE]
        starts, ends, h = _piece_words(piece)
        h, sizes = h.copy(), ends - starts
        if open_length and len(starts) and starts[0] == 0:  # a word goes on from the piece before
            h[0] = (open_sum + pow(_BASE, open_length, 1 << 64) * int(h[0])) & 0xFFFFFFFFFFFFFFFF
            sizes[0] += open_length
        elif open_length:
            out.append(mix64(np.array([open_sum], np.uint64) + np.uint64(open_length)))
        open_sum, open_length = 0, 0
        if len(ends) and ends[-1] == len(piece) and a + _PIECE < len(raw):
            open_sum, open_length = int(h[-1]), int(sizes[-1])
            h, sizes = h[:-1], sizes[:-1]
        out.append(mix64(h + sizes.astype(np.uint64)))
    if open_length:
        out.append(mix64(np.array([open_sum], np.uint64) + np.uint64(open_length)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, (size * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        h = mix64(h * np.uint64(0x100000001B3) + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All circulant coordinates of a non-empty set."""
    windows = _fixed()[-1]
    places = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full(windows.shape[1], _UNIVERSE, np.uint32)
    for a in range(0, len(places), 4096):
        np.minimum(out, windows[places[a : a + 4096]].min(axis=0), out=out)
    return out


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    places = (mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - _ODD.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=_ODD) & 1).astype(np.uint8)).view(">i8").astype(np.int64)


def plausible(n: str, odd: str, m: str, other: str, percent: int) -> Column:
    """Neither sizes nor odd sketches refute the pair: what two sets differ in is (n + m) (100 - percent) / (100 + percent) at most."""
    differ = " + ".join(f"bit_count({odd}[{i}] ^ {other}[{i}])" for i in range(_ODD // 64))
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and ({differ}) * {100 + percent} <= ({n} + {m}) * {100 - percent}")


_SKETCH = [("n_shingles", pa.int64(), "long"), ("print", pa.binary(), "binary"), ("bands", pa.list_(pa.int64()), "array<long>"), ("bits", pa.list_(pa.int64()), "array<long>"), ("odd", pa.list_(pa.int64()), "array<long>")]


def _print(s: np.ndarray) -> bytes:
    return np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


def _sketch(k: int):
    """The last column is the text; the others are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(b.num_columns - 1):
                s = shingle_set(text.as_py(), k)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                sig = signature(s)
                h = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    h = mix64(h * np.uint64(0x100000001B3) + sig.reshape(BANDS, ROWS)[:, r].astype(np.uint64) + np.uint64(1))
                bands = (mix64(h + np.arange(BANDS, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)
                bits = np.packbits((mix64(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(">i8").astype(np.int64)
                rows.append((len(s), _print(s), bands, bits, odd_sketch(s)))
            made = [pa.array(list(c), t) for c, (_, t, _) in zip(zip(*rows, strict=True), _SKETCH, strict=True)] if rows else [pa.array([], t) for _, t, _ in _SKETCH]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *(n for n, _, _ in _SKETCH)])

    return run


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of rows that follow each other in one bucket."""
    last = None
    for b in batches:
        if last is not None:
            b = pd.concat([last, b], ignore_index=True)
        same = (b["bucket"].to_numpy()[1:] == b["bucket"].to_numpy()[:-1]) & (b["band"].to_numpy()[1:] == b["band"].to_numpy()[:-1])
        x, y = b["id"].tolist()[:-1], b["id"].tolist()[1:]
        pairs = [(min(p, q), max(p, q)) for p, q, one in zip(x, y, same, strict=True) if one]
        yield pd.DataFrame({"a": [p for p, _ in pairs], "b": [q for _, q in pairs]})
        last = b.iloc[-1:]


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ok = []
            for x, y in zip(rows.column("sa"), rows.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if 100 * small < percent * large:
                    ok.append(False)
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep)], names=["a", "b"])

    return run


def _set_reader(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], names=["id", "s"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, holders: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of prints whose sets, made anew from texts, reach percent. texts: key, text; holders: print, key
    (of one of the texts that have it)."""
    spark = pairs.sparkSession
    needed = pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct().join(holders, F.col("need") == F.col("print")).select(F.col("need").alias("id"), F.col("key").alias("h"))
    found = texts.join(needed.hint("merge"), F.col("key") == F.col("h")).select("id", "text").dropDuplicates(["id"])
    path = fresh_path(spark, "sets")
    write_table(found.mapInArrow(_set_reader(k), "id binary, s binary"), path)
    sets = spark.read.parquet(path)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = materialise(both.select("a", "b", "sa", "sb").mapInArrow(_confirmer(percent), "a binary, b binary"), "links")
    drop_path(spark, path)
    return links


#: Links that one task may resolve; more take rounds over all executors.
FEW_LINKS = 200_000


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """Connected components of links (a, b): node, component (the smallest node), for every node with a link: at most few of them in one task,
    as a round takes some seven shuffles, however few they are; else by rounds.

    A node of many links meets them where they are: nodes of more links than a thousandth of all are fewer than 2,000 and are broadcast."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last, count = None, edges.count()
    if count <= few:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInPandas(resolve, f"node {kind}, component {kind}")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"), "links")
        hub = F.col("links") > max(256, count // 1000)
        ahead = both.where("v > u")
        hubs = F.broadcast(low.where(hub).select("n", "m"))
        near = ahead.join(hubs, F.col("u") == F.col("n")).select("v", "m")
        rest = ahead.join(F.broadcast(low.where(hub).select("n")), F.col("u") == F.col("n"), "left_anti").join(low.where(~hub), F.col("u") == F.col("n")).select("v", "m")
        large = near.unionByName(rest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, F.col("u") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, materialise(small, "edges")
        discard(old)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        last, count = state, state[0]


def classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, wide: int = 5_000, by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, labels). rows, written to the shared folder: id, key (hash of the text), n_shingles, print, for each row of docs; labels: print,
    root (the print that stands for its class). by_id: the sets of one id are of one class. wide has no effect any more: buckets of all sizes are
    treated alike."""
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.substring(F.sha2(F.col(text_col).cast("binary"), 256), 1, 32)).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = materialise(texts.mapInArrow(_sketch(k), f"id {kind}, key binary, " + ", ".join(f"{n} {t}" for n, _, t in _SKETCH)), "sketches")
    whole = sketches.where("print is not null")
    nodes = whole.groupBy("print").agg(F.min("key").alias("key"), F.min_by(F.struct("n_shingles", "bands", "bits", "odd"), "key").alias("s"))
    nodes = materialise(nodes.select("print", F.col("print").alias("id"), "key", "s.*"), "nodes")
    holders = nodes.select("print", "key")
    odds = nodes.select(F.col("id").alias("i"), "n_shingles", "odd")
    marks = nodes.select(F.col("id").alias("i"), "n_shingles", "odd", "bands")

    spread = nodes.select("id", "bits", F.posexplode("bands").alias("band", "bucket"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "bucket", "bits", "id"]
    shared = spread.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1").select(F.col("band").alias("band_"), F.col("bucket").alias("bucket_"))
    crowd = materialise(spread.join(shared, (F.col("band") == F.col("band_")) & (F.col("bucket") == F.col("bucket_")), "left_semi").select(*order), "buckets")
    chain = crowd.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_neighbours, "a binary, b binary").where("a <> b").distinct()
    left = chain.join(odds.toDF("i", "na", "oa"), F.col("a") == F.col("i")).drop("i")
    both = left.join(odds.toDF("i", "nb", "ob"), F.col("b") == F.col("i")).where(plausible("na", "oa", "nb", "ob", percent))
    source = texts.select("key", "text")
    links = confirm(materialise(both.select("a", "b"), "chain"), source, holders, k, percent)

    parts = materialise(components(links), "components")
    member = materialise(crowd.join(parts, F.col("id") == F.col("node"), "left").select("band", "bucket", "id", F.coalesce("component", "id").alias("c")), "members")
    discard(crowd)
    groups = member.groupBy("band", "bucket", "c").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("band", "bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("members"), F.max(F.struct("size", "c")).alias("top")).where("parts > 1")
    mixed = mixed.select(F.col("band").alias("band_"), F.col("bucket").alias("bucket_"), F.col("top.c").alias("top"))
    inside = member.join(mixed, (F.col("band") == F.col("band_")) & (F.col("bucket") == F.col("bucket_"))).drop("band_", "bucket_").join(marks, F.col("id") == F.col("i")).drop("i")
    # every bucket is cut by size: sets whose sizes allow the similarity are of one cell or of neighbouring ones, so no pair is lost
    ratio = 100 / max(percent, 1) * 1.008
    inside = inside.withColumn("cell", F.floor(F.log("n_shingles") / float(np.log(ratio))).cast("int")).select("band", "bucket", "cell", "id", "c", "top", "n_shingles", "odd", "bands")
    keys = ["band", "bucket", "cell"]
    outer = inside.where("c <> top").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    outer = outer.select(*[F.col(x).alias(f"{x}_") for x in keys], F.col("id").alias("x"), F.col("c").alias("xc"), F.col("n_shingles").alias("xn"), F.col("odd").alias("xo"), F.col("bands").alias("xs"))
    same = (F.col("band") == F.col("band_")) & (F.col("bucket") == F.col("bucket_")) & (F.col("cell") == F.col("cell_"))
    # a pair of two outer members is found from both sides; the smaller id's side counts
    once = (F.col("c") == F.col("top")) | (F.col("x") < F.col("id"))
    # and only in the first band that the two share
    earlier = F.expr("exists(zip_with(slice(bands, 1, band), slice(xs, 1, band), (p, q) -> p = q), e -> e)")
    crossing = inside.join(outer, same & (F.col("c") != F.col("xc")) & once & plausible("n_shingles", "odd", "xn", "xo", percent) & ~earlier)
    rest = materialise(crossing.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct(), "crossing")
    discard(member)
    if not rest.isEmpty():
        links = links.unionByName(confirm(rest, source, holders, k, percent))
        parts = materialise(components(links), "components")
    if by_id:
        several = whole.where("id is not null").groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select(F.col("id").alias("one"), "a")
        own = materialise(whole.select("id", "print").join(several, F.col("id") == F.col("one")).select("a", F.col("print").alias("b")).where("a <> b").distinct(), "own-links")
        if not own.isEmpty():
            parts = materialise(components(links.unionByName(own)), "components")
    labels = nodes.join(parts, F.col("id") == F.col("node"), "left").select("print", F.coalesce("component", "id").alias("root"))
    return sketches.select("id", "key", "n_shingles", "print"), labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id, kept (it is the class's smallest id)."""
    rows, labels = classes(docs, id_col, text_col, k, percent)
    rooted = rows.where("print is not null and id is not null").join(labels, "print").groupBy("root").agg(F.min("id").alias("component"))
    # a class of one set has its own smallest id; classes meet their documents by the set
    of = labels.join(rooted, "root").select(F.col("print").alias("p"), "component")
    out = rows.join(of, F.col("print") == F.col("p"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.coalesce(component == F.col("id"), F.lit(True))).alias("kept"))


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each class of near-equal sets, that of the smallest id (one without an id only where the class has none), and every row
    whose set is empty. Several texts of one id are judged each alone: a text that none resembles stays."""
    rows, labels = classes(docs, id_col, text_col, k, percent, by_id=False)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    best = rows.where("print is not null").join(labels, "print").groupBy("root").agg(F.min(order).alias("o")).select("o.id", "o.key")
    k_id, k_key, key = (free_name(docs, n) for n in ("kept_id", "kept_key", "text_key"))
    mine = docs.withColumn(key, F.unhex(F.substring(F.sha2(F.col(text_col).cast("binary"), 256), 1, 32)))
    empty = materialise(rows.where("print is null and key is not null").select("key").distinct(), "empty-texts").toDF(k_key)
    kept = mine.join(best.toDF(k_id, k_key).hint("merge"), (F.col(key) == F.col(k_key)) & F.col(id_col).eqNullSafe(F.col(k_id)), "left_semi").dropDuplicates([key, id_col])
    blank = mine.where(F.col(key).isNull()).unionByName(mine.join(empty, F.col(key) == F.col(k_key), "left_semi"))
    return kept.unionByName(blank).select(*docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + least(len(w), 4) - 1)) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
