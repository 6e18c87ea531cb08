"""Versions of a set of tables: a manifest names the folders of every table, and is written last.

Readers follow the newest manifest, so they see all tables of a run or none. A manifest is written
beside its place and renamed to it, which fails if another run has taken the number. Folders that no
manifest names (of a run that was killed, or compacted away) are read by nobody; `vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

FOLDER, DATA = "_versions", "tables"


class Taken(Exception):
    """Another run has committed the version meanwhile."""


def _place(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _place(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Versions that are there, in order."""
    fs, folder = _store(spark, path), _place(spark, f"{path}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, number: int) -> dict[str, list[str]]:
    """Folders of each table, below the path."""
    return _content(spark, path, number)["tables"]


def schemas(spark: SparkSession, path: str, number: int) -> dict[str, StructType]:
    """Columns of each table, as its rows were written: a folder's name alone tells no type."""
    found = _content(spark, path, number)["schemas"] if number else {}
    return {name: StructType.fromJson(kind) for name, kind in found.items()}


def _content(spark: SparkSession, path: str, number: int) -> dict:
    stream = _store(spark, path).open(_place(spark, f"{path}/{FOLDER}/{number:010d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """(number, folders of each table) of the newest version; (0, {}) before the first."""
    there = numbers(spark, path)
    return (there[-1], manifest(spark, path, there[-1])) if there else (0, {})


def commit(
    spark: SparkSession, path: str, number: int, tables: dict[str, list[str]],
    kinds: dict[str, StructType] | None = None,
) -> None:
    """Makes the tables version `number`, or raises Taken."""
    told = {name: kind.jsonValue() for name, kind in (kinds or {}).items()}
    fs = _store(spark, path)
    draft = _place(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"tables": tables, "schemas": told}).encode()))
    out.close()
    final = _place(spark, f"{path}/{FOLDER}/{number:010d}.json")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        # Unlike a file system's own rename, this one never replaces a file.
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except (PySparkException, Py4JJavaError) as error:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Taken(f"version {number} of {path}") from error
        raise


def new_folder(table: str) -> str:
    return f"{DATA}/{table}/{uuid.uuid4().hex}"


def plain_tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, list[str]]:
    """Of the names, those that are plain folders of files below the path, as tables of a version."""
    fs, out = _store(spark, path), {}
    for name in names:
        folder = _place(spark, f"{path}/{name}")
        if fs.exists(folder):
            children = [s.getPath().getName() for s in fs.listStatus(folder)]
            if any(c.endswith(".parquet") or "=" in c for c in children):
                out[name] = [name]
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes folders that none of the last `keep` versions names, and older manifests; gives their names.

    Not to be run while a writer is at work: its folders are named only by its commit.
    """
    fs, there = _store(spark, path), numbers(spark, path)
    kept = {f for n in there[-keep:] for folders in manifest(spark, path, n).values() for f in folders}
    gone, top = [], _place(spark, f"{path}/{DATA}")
    for table in fs.listStatus(top) if fs.exists(top) else ():
        for s in fs.listStatus(table.getPath()):
            name = f"{DATA}/{table.getPath().getName()}/{s.getPath().getName()}"
            if name not in kept:
                fs.delete(s.getPath(), True)
                gone.append(name)
    for n in there[:-keep]:
        fs.delete(_place(spark, f"{path}/{FOLDER}/{n:010d}.json"), False)
    return gone
