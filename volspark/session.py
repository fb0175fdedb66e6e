"""What the engine needs of a session: its own code on the executors, and a checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that kernels can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="volspark-ship-")) / "volspark_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='volspark-ckpt-')}")
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: For a write by cut(): tasks are not merged beyond 8 MB of shuffled (compressed) rows, and no table of more than 2 MB is broadcast unasked, so that
#: sorts and the driver take the same memory whatever the size of the input; shuffle files go when the table is written.
_WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
}
#: Plain values, so that a table's size on disk, by which Spark plans joins, is about that of its rows; groups of few rows, so that a
#: large file is read by many tasks.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again. discard() deletes the table, and so does clear()."""
    spark = df.sparkSession
    sc, folder = spark.sparkContext, shared_folder(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    path = f"{sc.getCheckpointDir().rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITE_CONF}
    for k, v in _WRITE_CONF.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**_PLAIN).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut() once nothing lazy reads them any more."""
    for df in tables:
        drop_path(df.sparkSession, df.shared_path)


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    store, p = _store(spark, path)
    return store.exists(p)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store; none where it is not there."""
    store, p = _store(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    store, p = _store(spark, path)
    store.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all checkpoints of this process, those of cut() among them, and begins a new folder for those that follow. Results are lazy and read them, so
    call it once results are written."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        root = sc.getCheckpointDir().rsplit("/", 1)[0]
        drop_path(spark, sc.getCheckpointDir())
        sc.setCheckpointDir(root)
