"""Text files that tasks write, list and read themselves, below a folder that is mounted on every machine."""

from __future__ import annotations

import bz2
import functools
import gzip
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_files(folder: str, by: str, rows) -> None:
    """The documents of a partition, laid out as Spark's writer does; each appears when it is whole."""
    for key, lines in itertools.groupby(rows, key=lambda r: r[0]):
        name = "__HIVE_DEFAULT_PARTITION__" if key in (None, "") else _ESCAPED.sub(
            lambda c: f"%{ord(c[0]):02X}", str(key)
        )
        own = os.path.join(folder, f"{by}={name}")
        os.makedirs(own, exist_ok=True)
        part = os.path.join(own, f".part-{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8", newline="") as out:
            for _, value in lines:
                out.write(f"{value or ''}\n")
        os.replace(part, os.path.join(own, "part-0.txt"))


#: Names listed, and bytes of texts, that a task hands on at once.
NAMES, TEXT_BYTES = 5_000, 8 << 20
#: Characters that a path's URI escapes; others than ASCII stay as they are.
_QUOTED = re.compile(r"[^0-9A-Za-z\-_.!~*'(),;:$&+=/@\u0080-\U0010ffff]")


def plain_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks open it, if it is one in a file system that is mounted on every machine."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        return None
    folder = where.toUri().getPath()
    return folder if os.path.isdir(folder) else None


def _left_out(name: str) -> bool:
    """Names that Spark's readers don't read."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(folder: str, deep: bool) -> Iterator[str]:
    """Files below the folder; without deep its own files and folders, the latter ending in a slash."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if _left_out(entry.name):
                continue
            if entry.is_dir():
                yield from _listed(entry.path, deep) if deep else [f"{entry.path}/"]
            elif entry.is_file() and (not deep or entry.stat().st_size):
                yield entry.path


def _names(batches: Iterable[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[str]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                if path.endswith("/"):
                    yield from _listed(path.rstrip("/") or "/", deep)
                elif os.stat(path).st_size:  # an empty file is no row
                    yield path

    names = found()
    while part := list(itertools.islice(names, NAMES)):
        yield pa.RecordBatch.from_pydict({"path": part})


def _whole(path: str) -> bytes:
    """The file's bytes, unpacked as its name says."""
    with open(path, "rb") as file:
        content = file.read()
    kind = path.rpartition(".")[2]
    if kind == "gz":
        return gzip.decompress(content)
    if kind == "bz2":
        return bz2.decompress(content)
    if kind == "deflate":
        return zlib.decompress(content)
    if kind == "zst":
        return pa.CompressedInputStream(pa.BufferReader(content), "zstd").read()
    if kind in ("snappy", "lz4"):
        raise ValueError(f"{path}: packed in a way that only Hadoop reads")
    return content


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
        uris = ["file://" + _QUOTED.sub(lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), p) for p in paths]
        return pa.RecordBatch.from_arrays([pa.array(uris), pa.array(texts, pa.binary())], names=["path", "text"])

    for batch in batches:
        paths, texts, size = [], [], 0
        for path in batch["path"].to_pylist():
            paths.append(path)
            texts.append(_whole(path))
            size += len(texts[-1])
            if size >= TEXT_BYTES:
                yield given(paths, texts)
                paths, texts, size = [], [], 0
        if paths:
            yield given(paths, texts)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file below the folder that `plain_folder` gave: its URI and its bytes.

    The names are rows of tasks and never meet in the driver, which holds nothing that grows with the files.
    One task lists the folder, others the folders in it, and the names are dealt out again to be read.
    """
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    top = spark.range(0, 1, 1, 1).select(F.lit(folder.rstrip("/") + "/").alias("path"))
    inside = top.mapInArrow(functools.partial(_names, deep=False), "path STRING").repartition(tasks, "path")
    files = inside.mapInArrow(functools.partial(_names, deep=True), "path STRING").repartition(tasks, "path")
    return files.mapInArrow(_texts, "path STRING, text BINARY")
