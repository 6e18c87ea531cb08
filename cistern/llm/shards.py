"""Sharding by histogram sort: exact bytes below candidate key boundaries, probes refined until splitters fit, one exchange.

A row's key is a hash of its text, then its id, so equal texts lie next to each other in a shard, or in shards that
follow each other where their group is cut. Each round counts the exact bytes and rows below all probes over a narrow
table of keys and sizes. A splitter is found once the bytes below it are within TOLERANCE of a shard of its target, or no
key lies between its neighbours; otherwise its interval gets new probes. Ranges of many rows are probed further the same
way, so that the exchange and the numbering of slots have small pieces: a slot is the exact number of the shard's rows
before the piece, and the place within it. Whole rows are exchanged once, by piece.

Law: bytes. Sizes are those of the text in UTF-8 and 8 more. A null text is empty but for those; null ids come before
others and are numbered among equals in any order. Repeated rows have one key and are never cut apart. A very long text is
a size of its own: shards are even to within the largest size and the tolerance. An empty table has no shards. Other
columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from cistern.llm.frames import with_fields
from cistern.sources.scratch import scratch_path, stage

SHARDS = 24
#: Of a shard's bytes.
TOLERANCE = 0.002
#: Probes for each splitter or range that is searched on, a round.
PROBES = 48
#: Bytes of a piece, about: so many, or that share of all bytes (the driver holds the pieces' bounds).
PIECE_BYTES, PIECES = 16 << 20, 200_000
#: Bytes of a task of the exchange.
TASK_BYTES = 64 << 20
EXTRA = 8

_OFFSET = 1 << 63


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA).cast("long")


def _hash(text: Column) -> Column:
    """32 bits of a hash: few enough that a group of equal texts is isolated in a few rounds."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("long")


class Bounds:
    """Sorted keys (hash, id) as two arrays; where a row's key lies among them."""

    def __init__(self, keys: list[int]):
        self.h = np.array([k >> 64 for k in keys], np.int64)
        self.d = np.array([(k & ((1 << 64) - 1)) - _OFFSET for k in keys], np.int64)

    def before(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many bounds are at or before each key."""
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        out = lo.copy()
        for a, b in {(a, b) for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True)}:
            own = (lo == a) & (hi == b)
            out[own] = a + np.searchsorted(self.d[a:b], d[own], "right")
        return out


def _key(h: int, d: int) -> int:
    return (h << 64) + d + _OFFSET


def _below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""
    sent = keys.sparkSession.sparkContext.broadcast(Bounds(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        size, rows = np.zeros(len(bounds.h) + 1, np.int64), np.zeros(len(bounds.h) + 1, np.int64)
        for b in batches:
            at = bounds.before(b.column(0).to_numpy(), b.column(1).to_numpy())
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        own = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(size[own]), pa.array(rows[own])], ["at", "bytes", "n"])

    parts = keys.select("h", "d", "size").mapInArrow(count, "at long, bytes long, n long")
    found = {r["at"]: (r["b"], r["n"]) for r in parts.groupBy("at").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).collect()}
    out, b, n = [], 0, 0
    for k in range(len(probes)):
        x = found.get(k, (0, 0))
        b, n = b + x[0], n + x[1]
        out.append((b, n))
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], list[int]]:
    """(pieces' first keys, rows below each, shard of each). keys: (h, d, size)."""
    whole = keys.agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("d"), F.max("d")).first()
    total, rows = whole[0] or 0, whole[1]
    if not rows:
        return [], [], []
    first, last = _key(whole[2], whole[4]), _key(whole[3], whole[5]) + 1
    low_d, high_d = whole[4], whole[5] + 1
    known = {first: (0, 0), last: (total, rows)}
    targets = [total * i // shards for i in range(1, shards)]
    most = max(PIECE_BYTES, total // PIECES)
    chosen: dict[int, int] = {}

    def spread(a: int, b: int, n: int = PROBES) -> list[int]:
        """n new probes in (a, b). Ids lie between the least and the greatest, so the room between hashes is skipped."""
        width = high_d - low_d + 1
        flat = lambda k: (k >> 64) * width + min(max((k & ((1 << 64) - 1)) - _OFFSET - low_d, 0), width - 1)
        x, y = flat(a), flat(b)
        cuts = {x + (y - x) * i // (n + 1) for i in range(1, n + 1)} - {x, y}
        return [k for k in (_key(c // width, c % width + low_d) for c in cuts) if a < k < b]

    dead: set[tuple[int, int]] = set()
    while True:
        order = sorted(known)
        sizes = [known[k][0] for k in order]
        probes: set[int] = set()
        for i, t in enumerate(targets):
            if i in chosen:
                continue
            j = bisect_right(sizes, t)  # sizes[j - 1] <= t
            a, b = order[j - 1], order[min(j, len(order) - 1)]
            near = min((a, b), key=lambda k: abs(known[k][0] - t))
            new = [] if (a, b) in dead or abs(known[near][0] - t) <= tolerance * total / shards else spread(a, b)
            if new:
                probes.update(new)
            else:
                chosen[i] = near
        for a, b in zip(order, order[1:], strict=False):
            held = known[b][0] - known[a][0]
            if held > most and known[b][1] - known[a][1] > 1 and (a, b) not in dead:
                new = spread(a, b, min(PROBES, 2 * held // most + 1))
                probes.update(new)
                if not new:
                    dead.add((a, b))
        if not probes:
            break
        fresh = sorted(probes)
        known |= dict(zip(fresh, _below(keys, fresh), strict=True))
    # Of all probes, pieces keep the splitters and as few others as the limit of bytes needs.
    cuts = sorted(set(chosen.values()) | {first})
    order, pieces, base = sorted(known), [first], 0
    must = set(cuts)
    for k, after in zip(order[1:-1], order[2:], strict=True):
        if k in must or known[after][0] - base > most:
            if known[k][0] > base or k in must:
                pieces.append(k)
                base = known[k][0]
    bounds = sorted(chosen.values())
    return pieces, [known[k][1] for k in pieces], [bisect_right(bounds, k) for k in pieces]


def with_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, law, shard and slot (gapless from 0 in each shard). Bytes of shards are near equal."""
    hashed = docs.drop(*({"size", "law", "shard", "slot", "grown_shard"} - {doc_id, text}))
    id_key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    keys = stage(hashed.select(_hash(F.col(text)).alias("h"), id_key.alias("d"), size_of(F.col(text)).alias("size")), "keys")
    pieces, below, shard = splitters(keys, shards)
    total = keys.agg(F.sum("size")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(Bounds(pieces))
    starts = [below[bisect_left(shard, s)] for s in shard]

    @F.pandas_udf("long")
    def piece(h, d):  # only the keys go to Python
        import pandas as pd

        return pd.Series(sent.value.before(h.to_numpy(), d.to_numpy()) - 1)

    rows = hashed.withColumn("_h", _hash(F.col(text))).withColumn("_d", id_key).withColumn("_piece", piece("_h", "_d"))
    # One row a piece, as few as bound above: small enough to be sent along.
    known = docs.sparkSession.createDataFrame(
        [(i, s, b - a) for i, (s, b, a) in enumerate(zip(shard, below, starts, strict=True))], "_p long, shard int, _base long"
    )
    parts = max(shards, total // TASK_BYTES)
    placed = rows.repartition(parts, "_piece")
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_h", "_d"))
    placed = placed.withColumn("_n", place).join(F.broadcast(known), F.col("_piece") == F.col("_p"))
    return placed.select(
        *[c for c in hashed.columns],
        size_of(F.col(text)).alias("size"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_base") + F.col("_n") - 1).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """A folder for each shard."""
    with_shards(docs, shards, doc_id, text).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sharded_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the documents as written to shards and read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs.select("doc_id", "text"), path, shards)
    schema = with_fields(docs.select("doc_id", "text"), size=LongType(), law=StringType(), slot=LongType(), shard=IntegerType())
    out = spark.read.schema(schema).parquet(path)
    return out.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
