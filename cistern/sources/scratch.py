"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; a local one only where none is set, as in tests."""
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="cistern-"))
    return _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written as a table and read back.

    For rows that several results share: they are computed once, the plan is cut, and a lost
    executor costs no recomputation. compression: the session's, if None.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: For large tables of hashes, which pack to half of what the usual codec leaves.
DENSE = "zstd"


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stage` gave, once nothing reads them any more. Other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _delete(t.sparkSession, path)
            t._scratch = None


def clean_up(spark: SparkSession) -> None:
    """Deletes everything that `stage` and `scratch_path` left below the scratch folder; for the end of a run."""
    _delete(spark, _own_folder(spark))


def _own_folder(spark: SparkSession) -> str:
    """That of this application below the scratch folder."""
    return f"{scratch_root(spark)}/cistern/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
