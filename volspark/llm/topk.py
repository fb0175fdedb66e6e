"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors become integers floor(1024 x). Shards are balls in space: the leaves of a ball tree over a bounded sample (``sample`` rows, chosen by a hash,
and SAMPLE_BYTES at most) give the cells, a vector goes to the cell of the nearest centre, and a cell of more rows than ``shard_rows`` is dealt over
several shards by a hash, so that a group of copies fills no task. A shard is one row: its vectors as a matrix in the order of the leaves of
its ball tree (recursive median splits along the direction of largest spread), the leaves' centres and radii, and its own ball. Vectors move
once, when shards are made, and never again.

Queries come in blocks of bounded size, which are broadcast; shards are read where they lie. First each query meets the one shard of the greatest upper
bound q.c + |q| r, in which its kth score is found; these scores are shared, and in a second pass a shard serves all queries whose bound
reaches their kth score. In a shard the leaves come by upper bound, the greatest first, until none that is left reaches the kth
score so far; queries that ask for the same leaf are one matrix product. So the rows moved are the queries, once an executor, and at most k results for a query and
shard, of which the shared kth score leaves few, even where nothing can be pruned.

Pruning is strict (bound < kth score), bounds are rounded up, so equal scores survive to the tie rule. Scores are exact: in double precision
where |q| |x| is under 2^53, in 64-bit integers under 2^62, beyond that in integers of any size, and what a long can't hold is its nearest long.

Defined cases: null vectors and those with null or non-finite components take no part; vectors are compared only with
those of their own dimension; ties go to the smaller id; a repeated row is a candidate of its own, a repeated
query id is searched once per distinct vector; ids may be of any type that has an order; rows with a null id take no part; an empty table gives one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.llm.common import materialise, table

_LEAF = 64
_LONG = (1 << 63) - 1
#: Bytes of the sample that the driver takes, and of the cells' centres that go to every task.
SAMPLE_BYTES, CELL_BYTES = 1 << 27, 1 << 25
#: Bytes of a block of queries.
BLOCK_BYTES = 1 << 25
#: Shards at most (beyond half a billion vectors they grow), so that the driver and every task can hold their radii.
MOST_SHARDS = 32_768
#: Leaves that queries take in their own order; the rest are taken one after the other, by all queries that they may serve.
_OWN_ORDER = 8


def exact_scores(points: np.ndarray, q: np.ndarray, bound: float) -> list[int]:
    """Inner products of vectors of whole numbers (as float64); bound is at least |q| |x| of every one."""
    if bound < 2.0**53:
        return (points @ q).astype(np.int64).tolist()
    if bound < 2.0**62 and np.abs(points).max(initial=0.0) < 2.0**62 and np.abs(q).max(initial=0.0) < 2.0**62:
        return (points.astype(np.int64) @ q.astype(np.int64)).tolist()
    whole = [int(c) for c in q]
    return [max(-_LONG - 1, min(_LONG, sum(int(c) * w for c, w in zip(p, whole, strict=True)))) for p in points]


class BallTree:
    """Over integer vectors x (n x d, float64 holding whole numbers)."""

    def __init__(self, x: np.ndarray, leaf: int = _LEAF):
        self.order = np.arange(len(x))
        self.x = x
        self.lo, self.hi, self.left, centres, radii = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:  # breadth first, so that children are neighbours
            nxt = []
            for lo, hi, parent in todo:
                at = len(self.lo)
                if parent >= 0 and self.left[parent] < 0:
                    self.left[parent] = at
                own = x[self.order[lo:hi]]
                c = own.mean(axis=0)
                centres.append(c)
                radii.append(np.sqrt(((own - c) ** 2).sum(axis=1).max()))
                self.lo.append(lo)
                self.hi.append(hi)
                self.left.append(-1)
                if hi - lo > leaf and radii[-1] > 0:
                    a = own[np.argmax(((own - c) ** 2).sum(axis=1))]
                    b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
                    mid = (hi - lo) // 2
                    part = np.argpartition(own @ (b - a), mid)
                    self.order[lo:hi] = self.order[lo:hi][part]
                    nxt += [(lo, lo + mid, at), (lo + mid, hi, at)]
            todo = nxt
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.points = x[self.order]
        self.largest = float(np.sqrt((self.points**2).sum(axis=1).max(initial=0.0)))

    def leaves(self) -> list[int]:
        return [n for n, left in enumerate(self.left) if left < 0]

def _matrix(rows: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component as double; null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    big = lambda x: F.abs(x) >= 2.0**43  # noqa: E731  a whole number already, and maybe beyond a long
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.when(big(x.cast("double")), x.cast("double") * 1024).otherwise(F.floor(x.cast("double") * 1024).cast("double"))))


def _dealt(base: DataFrame, n: int, dim: int, shard_rows: int, sample: int) -> DataFrame:
    """base with the cell of the nearest centre. Vectors of other dimensions than dim have cell -1."""
    cells = min(max(1, CELL_BYTES // (8 * max(dim, 1))), -(-n // shard_rows))
    if cells <= 1 or not dim:
        return base.withColumn("cell", F.lit(-1))
    sample = min(sample, max(cells, SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, 1.2 * sample / n)
    spot = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 31))
    some = base.where((F.col("dim") == dim) & (spot < share * float(1 << 31))).select("v").limit(sample).toArrow()
    tree = BallTree(_matrix(some.column("v").combine_chunks()), max(1, some.num_rows // cells))
    shared = base.sparkSession.sparkContext.broadcast(tree.centres[tree.leaves()][:cells])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c**2).sum(axis=1) / 2
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            own = np.flatnonzero(b.column("dim").to_numpy(zero_copy_only=False) == dim)
            for a in range(0, len(own), 1024):
                part = own[a : a + 1024]
                cell[part] = np.argmax(_matrix(b.column("v").take(pa.array(part))) @ c.T - half, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    kind = base.schema["id"].dataType.simpleString()
    return materialise(base.mapInArrow(assign, f"id {kind}, v array<double>, dim int, is_query boolean, cell int"), "topk-cells")


@dataclass
class Queries:
    """A block: ids, vectors (float64) and norms, and of each the kth score so far (None: not yet k) and the shard it has met."""

    ids: list
    v: list[np.ndarray]
    floor: list[int | None]
    met: list[int]

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Their numbers, and the matrix of those of a dimension."""
        at = np.array([i for i, v in enumerate(self.v) if len(v) == dim], int)
        return at, np.stack([self.v[i] for i in at]) if len(at) else np.zeros((0, dim))


class Shard:
    """A row of _shards()."""

    def __init__(self, row: dict):
        self.number, self.ids, d = row["shard"], row["ids"], row["dim"]
        self.points = np.frombuffer(row["points"]).reshape(len(self.ids), d)
        self.ends = row["ends"]
        self.centres, self.radii = np.frombuffer(row["centres"]).reshape(-1, d), np.array(row["radii"])
        self.centre, self.radius, self.largest = np.frombuffer(row["centre"]), row["radius"], row["largest"]
        order = sorted(range(len(self.ids)), key=lambda i: self.ids[i])
        self.rank = np.zeros(len(order), np.int64)
        for r, i in enumerate(order):  # equal ids are equal in rank
            self.rank[i] = self.rank[order[r - 1]] if r and self.ids[i] == self.ids[order[r - 1]] else r

    def bounds(self, q: np.ndarray, norm: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of q's rows with what lies in balls; rounding of centres, radii and products goes up."""
        b = q @ centres.T
        return b + norm[:, None] * radii * (1 + 1e-9) + 1e-9 * (np.abs(b) + norm[:, None] * self.largest) + 1e-3

    def search(self, q: np.ndarray, ids: list, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Of each row of q the (score, place) of its best k of the shard, those equal to its id left out, with scores of floor (-inf: any) or more."""
        norm = np.sqrt((q * q).sum(axis=1))
        most = float(norm.max(initial=0.0)) * self.largest * (1 + 1e-9)
        if most >= 2.0**53:
            return [self._alone(q[i], ids[i], floor[i], k, most) for i in range(len(q))]
        floor = floor.copy()
        bounds = self.bounds(q, norm, self.centres, self.radii)
        order = np.argsort(-bounds, axis=1, kind="stable")
        seen = np.zeros(bounds.shape, bool)
        scores, places = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        rank = np.append(self.rank, len(self.rank))  # of no place

        def meet(rows: np.ndarray, leaf: int) -> None:
            seen[rows, leaf] = True
            lo, hi = self.ends[leaf], self.ends[leaf + 1]
            s = q[rows] @ self.points[lo:hi].T
            hit = s.max(axis=1) >= floor[rows]
            rows, s = rows[hit], s[hit]
            if not len(rows):
                return
            own = np.array([[self.ids[p] == ids[r] for p in range(lo, hi)] for r in rows])
            s = np.where(own, -np.inf, s)
            both = np.concatenate([scores[rows], s], axis=1)
            at = np.concatenate([places[rows], np.broadcast_to(np.arange(lo, hi), s.shape)], axis=1)
            best = np.lexsort((rank[at], -both), axis=1)[:, :k]
            scores[rows], places[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
            floor[rows] = np.maximum(floor[rows], scores[rows, -1])

        for r in range(min(_OWN_ORDER, bounds.shape[1])):
            leaf = order[:, r]
            rows = np.flatnonzero(bounds[np.arange(len(q)), leaf] >= floor)
            for one in np.unique(leaf[rows]).tolist():
                mine = rows[leaf[rows] == one]
                meet(mine[bounds[mine, one] >= floor[mine]], one)
        for one in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable").tolist():
            rows = np.flatnonzero((bounds[:, one] >= floor) & ~seen[:, one])
            if len(rows):
                meet(rows, one)
        return [[(int(s), int(p)) for s, p in zip(x, y, strict=True) if s > -np.inf and s >= f] for x, y, f in zip(scores, places, floor, strict=True)]

    def _alone(self, q: np.ndarray, own, floor: float, k: int, most: float) -> list[tuple[int, int]]:
        scores = exact_scores(self.points, q, most)
        least = -(1 << 63) if floor == -np.inf else int(floor)
        found = [(s, p) for p, s in enumerate(scores) if self.ids[p] != own and s >= least]
        return sorted(found, key=lambda f: (-f[0], self.rank[f[1]]))[:k]


def _shards(celled: DataFrame, kind: str, shard_rows: int) -> DataFrame:
    """A row a shard, written to the shared folder."""
    sizes = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    parts = sizes.select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "v", F.lit(7)), F.col("parts")).cast("int")
    dealt = celled.join(F.broadcast(materialise(parts, "topk-sizes")), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))).select("id", "v", "dim", "cell", part.alias("part"))

    def pack(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("v").combine_chunks())
        tree = BallTree(x)
        leaves = tree.leaves()
        leaves.sort(key=lambda n: tree.lo[n])
        ids = rows.column("id").take(pa.array(tree.order)).to_pylist()
        ends = [tree.lo[n] for n in leaves] + [len(x)]
        one = {"dim": (pa.int32(), x.shape[1]), "ids": (pa.list_(rows.schema.field("id").type), ids), "points": (pa.binary(), tree.points.tobytes()), "ends": (pa.list_(pa.int32()), ends), "centres": (pa.binary(), tree.centres[leaves].tobytes()), "radii": (pa.list_(pa.float64()), tree.radii[leaves].tolist()), "centre": (pa.binary(), tree.centres[0].tobytes()), "radius": (pa.float64(), float(tree.radii[0])), "largest": (pa.float64(), tree.largest)}
        return pa.table({c: pa.array([v], t) for c, (t, v) in one.items()})

    packed = dealt.groupBy("dim", "cell", "part").applyInArrow(pack, f"dim int, ids array<{kind}>, points binary, ends array<int>, centres binary, radii array<double>, centre binary, radius double, largest double")
    return materialise(packed.withColumn("shard", F.monotonically_increasing_id()), "topk-shards")


def _searched(shards: DataFrame, block: Queries, kind: str, k: int, first: bool) -> DataFrame:
    """qno, query_id, vec_id, score: at most k of each query and shard. first: of the one shard that a query has in met, else of all others."""
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block, s = shared.value, Shard(row)
                at, q = block.of(row["dim"])
                met = np.array([block.met[i] for i in at], np.int64) == s.number
                floor = np.array([-np.inf if block.floor[i] is None else block.floor[i] for i in at], float)
                floor -= 1e-12 * np.where(np.isfinite(floor), np.abs(floor), 0)  # a floor beyond 2^53 is rounded
                keep = met if first else ~met
                if keep.any() and not first:
                    keep &= s.bounds(q, np.sqrt((q * q).sum(axis=1)), s.centre[None, :], np.array([s.radius]))[:, 0] >= floor
                at, q, floor = at[keep], q[keep], floor[keep]
                found = s.search(q, [block.ids[i] for i in at], floor, k) if len(at) else []
                rows = [(i, block.ids[i], s.ids[p], score) for i, f in zip(at.tolist(), found, strict=True) for score, p in f]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                types = [pa.int32(), b.schema.field("ids").type.value_type, b.schema.field("ids").type.value_type, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["qno", "query_id", "vec_id", "score"])

    return shards.mapInArrow(run, f"qno int, query_id {kind}, vec_id {kind}, score long")


def _best_shards(balls: list, block: Queries) -> list[int]:
    """Of each query the shard of the greatest upper bound, or -1. balls: shard, dim, centre, radius."""
    out = [-1] * len(block.v)
    for dim in {len(v) for v in block.v}:
        own = [b for b in balls if b["dim"] == dim]
        at, q = block.of(dim)
        norm, best = np.sqrt((q * q).sum(axis=1)), np.full(len(q), -np.inf)
        for a in range(0, len(own), 1024):
            some = own[a : a + 1024]
            bounds = q @ np.stack([np.frombuffer(b["centre"]) for b in some]).T + norm[:, None] * np.array([b["radius"] for b in some])
            top = bounds.argmax(axis=1)
            for i in np.flatnonzero(bounds[np.arange(len(q)), top] > best).tolist():
                out[at[i]], best[i] = some[top[i]]["shard"], bounds[i, top[i]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16_384, block_rows: int | None = None, sample: int = 50_000) -> DataFrame:
    """For each row where is_query holds (an expression of id_col): query_id, rank, vec_id, score. block_rows: queries of a block, by default as many as
    BLOCK_BYTES hold."""
    kind = vectors.schema[id_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).alias(id_col), quantised(F.col(vector_col)).alias("v")).where(F.col("v").isNotNull() & F.col(id_col).isNotNull())
    base = materialise(base.select(F.col(id_col).alias("id"), "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "topk")
    dims = base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).agg(F.sum("n"), F.sum("q"), F.max_by("dim", "n"), F.max("dim")).first()
    n, queries, dim, widest = (x or 0 for x in dims)
    shards = _shards(_dealt(base, n, dim, max(shard_rows, n // MOST_SHARDS), sample), kind, max(shard_rows, n // MOST_SHARDS))
    blocks = max(1, -(-queries // (block_rows or max(1, BLOCK_BYTES // (8 * max(widest, 1))))))
    # of a repeated id each vector once; queries are dealt over blocks by a hash
    asked = base.where("is_query").select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"))
    found = None
    for i in range(blocks):
        rows = asked.where(F.col("block") == i).select("id", "v").distinct().collect()
        block = Queries([r["id"] for r in rows], [np.array(r["v"], float) for r in rows], [None] * len(rows), [-1] * len(rows))
        block.met = _best_shards(shards.select("shard", "dim", "centre", "radius").collect(), block)  # MOST_SHARDS rows at most
        near = materialise(_searched(shards.where(F.col("shard").isin(sorted(set(block.met)))), block, kind, k, True), "topk-near")
        for r in _top(near, k).where(F.col("rank") == k).select("qno", "score").toLocalIterator():
            block.floor[r["qno"]] = r["score"]
        rest = materialise(_top(near.unionByName(_searched(shards, block, kind, k, False)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-found")
        found = rest if found is None else found.unionByName(rest)
    return found


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
