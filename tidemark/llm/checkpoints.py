"""Where lineage is cut: tables written to the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OURS: dict[str, str] = {}
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset and everything runs in this process, as in tests, a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _OURS.setdefault("dir", _OURS.get("dir") or tempfile.mkdtemp(prefix="tidemark-"))
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is a scratch folder
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once; a lost executor costs no recomputation. The table goes by release(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for table in tables:
        _, path = _PATHS.pop(id(table), (None, None))
        if path:
            _drop(table.sparkSession, path)
