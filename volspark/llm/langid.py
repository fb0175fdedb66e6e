"""Language identification with string kernels.

Kernel: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of character n-grams (n = 1..3, the blended
spectrum) that are present in a text, over lower-case letters with every run of other characters as one space.
n-grams are hashed into ``dim`` columns. Nystroem: with m landmark texts, phi(x) = k(x, L) (k(L, L) + eps)^(-1/2).
One-versus-rest kernel ridge regression on phi solves (Phi'Phi + lambda I) W = Phi'Y with targets +-1.
Scoring is two matrix products per block of texts: presence (texts x dim) by landmarks (dim x m), then by m x languages.

Training uses at most ``per_language`` labelled texts of each language and ``most_rows`` in all (documented bounds; which ones is decided by a
hash of the id; a repeated id counts once), of which ``landmarks`` per language are landmarks. No language is left out until there are
more of them than ``most_rows``. Landmarks go to the driver; the
normal equations are summed over partitions on the executors. Every text is read whole, in training and in prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if there is nothing to
learn from; ties go to the alphabetically first language; repeated rows get a row each. Very long texts are read in pieces of ``_PIECE`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import free_name, slices, table

NGRAMS = (1, 2, 3)
#: Odd multipliers of the n-gram hash, fixed so that all tasks agree.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_BLOCK = 128
#: Landmarks of all languages together, so that the model fits the driver and every task.
MOST_LANDMARKS = 2048

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


#: Characters of a text that are looked at at a time.
_PIECE = 1 << 18


def presence(text: str | None, dim: int, row: np.ndarray) -> int:
    """Sets row (bool, zeroed) at the text's n-grams. Returns the number set; 0 for no letter."""
    if not text:
        return 0
    shift = np.uint32(32 - int(dim).bit_length() + 1)
    space = np.array([0x20], np.uint32)
    tail, any_letter = space, False  # the last kept characters, for n-grams that lie in two pieces
    for a in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[a : a + _PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letter_table()[codes]
        any_letter |= bool(letter.any())
        codes = np.where(letter, codes, np.uint32(0x20))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters the first
        keep[0] |= tail[-1] != 0x20
        codes = np.concatenate((tail, codes[keep]))
        if a + _PIECE >= len(text) and codes[-1] != 0x20:
            codes = np.concatenate((codes, space))
        h = np.zeros(len(codes), dtype=np.uint32)
        for n, by in enumerate(_MULTIPLIERS[: max(NGRAMS)], start=1):
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(by)
            h ^= h >> np.uint32(15)
            if n in NGRAMS:
                row[(h * np.uint32(0x27D4EB2F)) >> shift] = True
        tail = codes[-(max(NGRAMS) - 1) :] if len(codes) >= max(NGRAMS) - 1 else codes
    if not any_letter:
        row[:] = False
        return 0
    return int(np.count_nonzero(row))


def blocks(texts: list[str | None], dim: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the texts with their presence rows over the square roots of their sizes (float32), and their sizes."""
    for a in range(0, len(texts), _BLOCK):
        part = texts[a : a + _BLOCK]
        rows = np.zeros((len(part), dim), dtype=bool)
        sizes = np.array([presence(t, dim, rows[i]) for i, t in enumerate(part)], dtype=np.float32)
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(sizes, 1))[:, None]
        yield slice(a, a + len(part)), x, sizes


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # dim x m, scaled like the texts
    weights: np.ndarray  # m x languages
    dim: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, x, sizes in blocks(texts, self.dim):
            if self.languages:
                z = (x @ self.landmarks) @ self.weights
                e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
                p = e / e.sum(axis=1, keepdims=True)
                best = np.argmax(z, axis=1)
            for i in range(len(x)):
                known = bool(self.languages) and sizes[i] > 0
                names.append(self.languages[best[i]] if known else "und")
                scores.append(float(p[i, best[i]]) if known else 0.0)
        return names, scores


def _bounded(rows: DataFrame, id_col: str, lang_col: str, bound: int, most: int = 8192 * 16) -> DataFrame:
    """At most bound rows (id, lang, k) of each language, and ``most`` rows in all: those with the smallest hashes of their id. Of more than
    ``most`` languages the most frequent."""
    counts = rows.groupBy(F.col(lang_col).alias("of")).count().orderBy(F.desc("count"), "of").limit(most).collect()
    bound = max(1, min(bound, most // max(1, len(counts))))
    share = rows.sparkSession.createDataFrame([(r[0], (1.5 * bound + 50) / r[1]) for r in counts], T.StructType([T.StructField("of", rows.schema[lang_col].dataType), T.StructField("share", T.DoubleType())]))
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 31))
    few = rows.withColumn("u", u).join(F.broadcast(share), F.col(lang_col) == F.col("of")).where(F.col("u") < F.col("share") * float(1 << 31))
    w = Window.partitionBy(lang_col).orderBy("u", id_col)
    return few.select(id_col, lang_col, "u").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= bound).select(id_col, lang_col, "k", "u")  # a repeated id counts once


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, landmarks: int = 48, dim: int = 1 << 13, ridge: float = 1e-2, most_rows: int = 8192 * 16) -> Model:
    """Learns from text and non-null lang of the rows where usable holds."""
    spark = docs.sparkSession
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = _bounded(rows.select(id_col, lang_col), id_col, lang_col, per_language, most_rows).collect()
    if not chosen:
        return Model([], np.zeros((dim, 0), np.float32), np.zeros((0, 0), np.float32), dim)
    languages = sorted({r[1] for r in chosen})
    rank = {(r[0], r[1]): r[2] for r in chosen}
    # of every language equally many landmarks; of more languages than MOST_LANDMARKS those of the smallest hashes
    per = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    marked = {(r[0], r[1]) for r in sorted((r for r in chosen if r[2] <= per), key=lambda r: (r[3], r[1]))[: max(MOST_LANDMARKS, per)]}
    own, of = free_name(docs, "chosen"), free_name(docs, "chosen_lang")
    pairs = spark.createDataFrame([(r[0], r[1], (r[0], r[1]) in marked) for r in chosen], T.StructType([T.StructField(own, docs.schema[id_col].dataType), T.StructField(of, docs.schema[lang_col].dataType), T.StructField("is_mark", T.BooleanType())]))
    sample = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(pairs), (F.col("id") == F.col(own)) & (F.col("lang") == F.col(of)))
    sample = sample.groupBy("id", "lang").agg(F.min("text").alias("text"), F.first("is_mark").alias("is_mark"))  # of an id with many rows, one
    marks = sorted(sample.where("is_mark").collect(), key=lambda r: (r["lang"], rank[r["id"], r["lang"]], r["text"]))
    found = [(x, s) for _, x, s in blocks([r["text"] for r in marks], dim)]
    base = np.concatenate([x for x, _ in found])[np.concatenate([s for _, s in found]) > 0].T.copy()
    if not base.shape[1]:
        return Model([], np.zeros((dim, 0), np.float32), np.zeros((0, 0), np.float32), dim)
    kernel = (base.T @ base).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    half = vectors / np.sqrt(np.maximum(values, 0) + 1e-3) @ vectors.T
    shared = spark.sparkContext.broadcast(((base @ half.astype(np.float32)), languages))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_phi, names = shared.value
        m, at = to_phi.shape[1], {k: i for i, k in enumerate(names)}
        gram, cross = np.zeros((m, m)), np.zeros((m, len(names)))
        for b in batches:
            langs = b.column(1).to_pylist()
            for part, x, _ in blocks(b.column(0).to_pylist(), dim):
                phi = (x @ to_phi).astype(np.float64)
                y = np.full((len(x), len(names)), -1.0)
                y[np.arange(len(x)), [at[k] for k in langs[part]]] = 1.0
                gram += phi.T @ phi
                cross += phi.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], names=["gram", "cross"])

    parts = sample.select("text", "lang").coalesce(8).mapInArrow(sums, "gram binary, cross binary").collect()
    m = base.shape[1]
    gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in parts)
    cross = sum(np.frombuffer(r["cross"]).reshape(m, len(languages)) for r in parts)
    n = max(1.0, float(len(chosen)))
    weights = np.linalg.solve(gram / n + ridge / m * np.eye(m), cross / n)
    return Model(languages, base, (half @ weights).astype(np.float32), dim)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: predicted language and score in 0..1."""
    spark = docs.sparkSession
    lang = free_name(docs, "lang_pred")
    score = free_name(docs, "lang_score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            names, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema), lang, score


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~F.coalesce(held_out(), F.lit(False)))
    out, lang, score = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
