"""Vector codes by product quantisation: Lloyd rounds that move only what changed.

Vectors become integers floor(1024 x) and are cut into equal parts, each part position with a codebook of its own. A round assigns every part to its
codebook's nearest entry and replaces entries by the floored means of their parts. Between rounds a table keeps each vector with its previous
assignment, and running sums and counts of all entries are kept as integers; a round shuffles only the differences: a part whose assignment
changed is added to its new entry and taken from its old one, summed in the task first. Sums are exact whatever their size, so they
equal those of all parts.

A task holds a batch and the codebooks (entries x dimensions); the driver holds codebooks and running sums. Distances are matrix products
in double precision where these hold them exactly, in integers of any size otherwise. State tables are written to the shared folder, and the one before is deleted.

Defined cases: null vectors and those with null or non-finite components are dropped; so are those of another length than the most frequent
one (of equals the shortest) among lengths that the number of parts divides; a repeated id gives one first entry, of its smallest vector, and a row each; rows with a null
id are coded but start no entry, and are none without others; fewer vectors than entries make fewer entries; of equal entries the first is
used; errors beyond a long are the largest long; an empty table gives one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import discard, free_name, materialise, table
from volspark.llm.exact import exact_sums, nearest_longs, opened, rows_of, schema_of, total
from volspark.llm.topk import quantised

_EXACT = 1 << 52
_LONG = (1 << 63) - 1


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers (float64) as bytes: two a number where all fit, else eight."""
    narrow = bool(x.size) and x.min() >= -(1 << 15) and x.max() < 1 << 15
    return [row.tobytes() for row in x.astype("<i2" if narrow else "<f8")]


def unpacked(rows: pa.Array, d: int) -> np.ndarray:
    """The rows as float64."""
    raw = rows.to_pylist()
    if all(len(r) == 2 * d for r in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, d).astype(np.float64)
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * d else "<f8").astype(np.float64) for r in raw])


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


class Codebooks:
    """entries: parts x entries x components, Python integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = [np.array(p, object) for p in entries]
        self.most = max(abs(v) for p in self.entries for v in p.ravel())
        self.floats = [p.astype(np.float64) for p in self.entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of vectors (float64): the nearest entry of each part (uint8), ties to the lower index, and the summed squared distances."""
        s = self.entries[0].shape[1]
        far = int(np.abs(x).max(initial=0.0)) + self.most
        narrow = s * far * far < _EXACT
        codes, errors = np.zeros((len(x), len(self.entries)), np.uint8), np.zeros(len(x), np.int64 if narrow else object)
        for p in range(len(self.entries)):
            own = x[:, p * s : (p + 1) * s] if narrow else _whole(x[:, p * s : (p + 1) * s])
            c = self.floats[p] if narrow else self.entries[p]
            d = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c * c).sum(axis=1)
            codes[:, p] = best = np.argmin(d, axis=1)
            errors += d[np.arange(len(x)), best].astype(errors.dtype)
        return codes, nearest_longs(errors)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.entries for row in p.tolist() for v in row).encode()).hexdigest()


def _first_entries(base: DataFrame, id_col: str, x: str, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, each id once. A pass finds as many rows as entries are missing, all of one id at worst."""
    found: list[list[float]] = []
    rest = base.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(x).alias("x"))
    while len(found) < entries:
        rows = rest.orderBy("id", "x").limit(entries - len(found)).collect()
        found += [r["x"] for k, r in enumerate(rows) if not k or rows[k - 1]["id"] != r["id"]]
        if not rows:
            break
        rest = rest.where(F.col("id") > F.lit(rows[-1]["id"]))
    return found


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None, str, str]:
    """vectors without vector_col, with two more columns, whose names are returned: code (a byte a part) and error; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number takes a byte")
    spark = vectors.sparkSession
    kept = [f for f in vectors.schema.fields if f.name != vector_col]
    x, was, now, error = (free_name(vectors, n) for n in ("x", "was", "code", "error"))
    names = [f.name for f in kept]
    base = vectors.select(*names, quantised(F.col(vector_col)).alias(x)).where(F.col(x).isNotNull())
    size = base.groupBy(F.size(x).alias("d")).count().where((F.col("d") > 0) & (F.col("d") % parts == 0)).orderBy(F.desc("count"), "d").head()
    d = size["d"] if size else 0
    base = base.where(F.size(x) == d)
    start = _first_entries(base, id_col, x, entries) if d else []
    state_type = T.StructType([*kept, T.StructField(x, T.BinaryType()), T.StructField(was, T.BinaryType()), T.StructField(now, T.BinaryType()), T.StructField(error, T.LongType())])
    if not start:
        return spark.createDataFrame([], state_type).drop(x, was), None, now, error
    s = d // parts
    books = Codebooks([[[int(v) for v in row[p * s : (p + 1) * s]] for row in start] for p in range(parts)])
    n = len(start)
    sums = [np.zeros((n, s + 1), object) for _ in range(parts)]

    def assigned(df: DataFrame, books: Codebooks) -> DataFrame:
        """Each vector with its assignment; the one it had goes to ``was``."""
        shared = spark.sparkContext.broadcast(books)
        fresh = was not in df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                raw = b.column(x)
                m = raw.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) if fresh else unpacked(raw, d)
                codes, errors = shared.value.assign(m)
                before = pa.array([b""] * b.num_rows, pa.binary()) if fresh else b.column(now)
                columns = [*(b.column(c) for c in names), pa.array(packed(m), pa.binary()) if fresh else raw, before, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, x, was, now, error])

        return df.mapInArrow(run, state_type)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of parts that changed: sums and counts, plus for the new entry and minus for the old one."""
        held, touched = np.zeros((parts, n, s + 1), object), np.zeros((parts, n), bool)
        for b in batches:
            if not b.num_rows:
                continue
            m = unpacked(b.column(x), d)
            m = m.astype(np.int64) if np.abs(m).max() < 1 << 40 else _whole(m)
            for column, sign in ((now, 1), (was, -1)):
                at = np.array([list(c) or [-1] * parts for c in b.column(column).to_pylist()])
                other = np.array([list(c) or [-1] * parts for c in b.column(was if column == now else now).to_pylist()])
                for p in range(parts):
                    rows = np.flatnonzero((at[:, p] != other[:, p]) & (at[:, p] >= 0))
                    change = np.zeros((n, s + 1), m.dtype)
                    np.add.at(change, at[rows, p], np.concatenate([m[rows, p * s : (p + 1) * s], np.ones((len(rows), 1), m.dtype)], axis=1))
                    held[p] += sign * change.astype(object)
                    touched[p, at[rows, p]] = True
        where = np.argwhere(touched)
        if len(where):
            yield rows_of({"part": where[:, 0].tolist(), "entry": where[:, 1].tolist()}, [held[p, e] for p, e in where])

    state = None
    for _ in range(rounds):
        before, state = state, materialise(assigned(base if state is None else state, books), "codes")
        if before is not None:
            discard(before)
        moved = state.where(F.col(was) != F.col(now)).select(x, was, now).mapInArrow(differences, schema_of(["part", "entry"]))
        for r in exact_sums(moved, ["part", "entry"]).collect():  # parts * entries rows at most, in one job whatever the number of partitions
            sums[r["part"]][r["entry"]] += np.array(total(opened(r["sums"], r["limbs"])), object)
        books = Codebooks([[[v // row[s] for v in row[:s]] if row[s] else old for row, old in zip(sums[p].tolist(), books.entries[p].tolist(), strict=True)] for p in range(parts)])
    last = assigned(base if state is None else state, books).drop(x, was)
    return last, books, now, error


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error (summed over equal labels), codebooks_sha256."""
    out, books, code, error = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = materialise(out, "coded")
    total_ = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = materialise(out.groupBy(F.col("label").alias("of_label")).agg(total_.alias("label_error")), "label-errors")
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex(code)).alias("code"), F.col(error).alias("error"), "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _op13_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Vectors as lists of doubles, which hold these integers and their distances exactly."""
    near = "SELECT vec_id, p, min_by(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT v.vec_id, v.p, b.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.x) + list_dot_product(b.x, b.x) AS d FROM parts v JOIN book{r} b USING (p)) GROUP BY vec_id, p"
    sql = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < {entries})"""
    for r in range(rounds):
        sql += f""",
near{r} AS MATERIALIZED ({near.format(r=r)}),
mean{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT v.p, n.e, i, floor(sum(v.x[i]) / count(*)) AS m FROM parts v JOIN near{r} n USING (vec_id, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY v.p, n.e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, e))"""
    return sql + f""",
last AS MATERIALIZED ({near.format(r=rounds)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
held AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), held"""


OP13_SQL = _op13_sql()
