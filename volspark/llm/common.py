"""Shared helpers of the text operators: inputs, materialised intermediates, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of digits and of a-z, and all bytes of non-ASCII characters; A-Z count once lower-cased.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: bytes.translate table: A-Z lower-cased, whatever is no word byte becomes a space.
WORD_TABLE = bytes(x if (x := _LOWER[b]) in _WORD_BYTES else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all runs on this machine (tests), a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='volspark-')}"
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


_written: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    _written.append(f"{shared_dir(spark)}/volspark-{label}-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables and archives that this process has put into the shared folder. Results are lazy and read
    them, so call it once results are written."""
    while _written:
        drop_path(spark, _written.pop())


#: For a write: its shuffle files are deleted when it is done, as the table stands in the shared folder; rows with
#: texts or sets go to Python in batches of few, so that buffers stay small; and tasks are not merged beyond 16 MB nor tables of more
#: than 2 MB broadcast unasked, so that sorts, hash tables and the driver take the same memory whatever the size of the input.
_WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
}


def write_table(df: DataFrame, path: str, *by: str, groups_held: int = 0) -> None:
    """Writes df as Parquet, in a folder for each value of the columns by, added to what is there. groups_held: groups of lists that a task may hold before it sorts."""
    conf = df.sparkSession.conf
    wanted = _WRITE_CONF | ({"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(groups_held)} if groups_held else {})
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        (df.write.mode("append").partitionBy(*by).option("compression", "zstd") if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() once nothing lazy reads them any more."""
    for df in tables:
        drop_path(df.sparkSession, df.shared_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder that is no longer needed, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column (in any case) already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a Python worker makes of a batch of texts stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
