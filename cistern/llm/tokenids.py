"""Token ids in files of directly addressable codes.

An id is cut into levels of LEVEL_BITS bits. Level 0 has the lowest bits of every id; a bitmap says which ids go on, and
level 1 has the next bits of those alone, and so on. A rank directory counts the bits before each 512, so the place of an
id in the next level is one sum: any token is read by its place without decoding another.

A file holds the documents of a range of ids, in order: a directory of documents and where each begins, then the levels.
Ids are ranged by Spark (one exchange), encoded where they are written, and a file takes its final name only once it is
whole; the names that count are those that finished tasks returned, so a task that runs again does no harm.

The tokenizer's file is a byte-level BPE vocabulary whose ids follow its merges; encoding runs on its ranks. Null and
empty texts are the end id alone. A null id isn't allowed (it has no place in the order). Rows of equal id follow each
other by text. Very long texts are whole; a file's ids are held by its task while it is written. An empty table gives no
files and an empty result. Columns but id and text aren't read.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cistern.sources.scratch import scratch_path, stage

MAGIC = b"DAC1"
LEVEL_BITS = 8
RANK_EVERY = 512
END = 2
#: Bytes of text for a file; files are as many as that needs.
FILE_BYTES = 16 << 20

# Fixed value: the pattern that cuts texts into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@functools.lru_cache(maxsize=2)
def coder(content: str) -> Callable[[str], list[int]]:
    """An encoder for the vocabulary of a tokenizer's file, kept for the tasks of a Python worker."""
    import tiktoken

    from cistern.llm.bpe import byte_letters

    spec = json.loads(content)
    kind = spec["pre_tokenizer"]
    if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError("a tokenizer of another kind")
    back = {c: b for b, c in enumerate(byte_letters())}
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m)] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("ids don't follow the merges")
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return functools.partial(e.encode, allowed_special="all")


def _file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


# --- the format

def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap of those that go on, ranks) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32((1 << LEVEL_BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(LEVEL_BITS)
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        per = np.add.reduceat(on, np.arange(0, len(on), RANK_EVERY), dtype=np.uint64) if len(on) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per, dtype=np.uint64)])
        out.append((chunks, bits, ranks))
        rest = rest[on]
        if not len(rest):
            return out


def write_file(uri: str, doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
    levels = levels_of(ids)
    head = MAGIC + struct.pack("<QQB", len(doc_ids), len(ids), len(levels)) + b"".join(struct.pack("<Q", len(c)) for c, _, _ in levels)
    fs, path = _file(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(head)
        f.write(doc_ids.astype("<i8").tobytes())
        f.write(starts.astype("<u8").tobytes())
        for chunks, bits, ranks in levels:
            for x in (chunks, bits, ranks.astype("<u8")):
                f.write(x.tobytes())
    fs.move(part, path)


class TokenFile:
    """A file of ids. Directories and bitmaps are read when it is opened by `read_range`'s caller: only what is needed is."""

    def __init__(self, uri: str):
        fs, path = _file(uri)
        self.f = fs.open_input_file(path)
        if self._at(0, 4) != MAGIC:
            raise ValueError(f"no token file: {uri}")
        self.docs, self.ids, depth = struct.unpack("<QQB", self._at(4, 17))
        sizes = struct.unpack(f"<{depth}Q", self._at(21, 8 * depth))
        at = 21 + 8 * depth
        self.doc_ids = np.frombuffer(self._at(at, 8 * self.docs), "<i8")
        at += 8 * self.docs
        self.starts = np.frombuffer(self._at(at, 8 * (self.docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.docs + 1)
        self.levels = []
        for n in sizes:
            blocks = -(-n // RANK_EVERY) + 1
            self.levels.append((at, at + n, at + n + -(-n // 8), n))
            at += n + -(-n // 8) + 8 * blocks

    def _at(self, offset: int, size: int) -> bytes:
        return self.f.read_at(size, offset) if size else b""

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level's bitmap before a place."""
        _, bits, ranks, _ = self.levels[level]
        block = place // RANK_EVERY
        base = struct.unpack("<Q", self._at(ranks + 8 * block, 8))[0]
        first = block * RANK_EVERY
        if place == first:
            return base
        own = np.unpackbits(np.frombuffer(self._at(bits + first // 8, -(-(place - first) // 8)), np.uint8), bitorder="little")
        return base + int(own[: place - first].sum())

    def token(self, place: int) -> int:
        """The id at a place of the file."""
        return int(self.read_range(place, place + 1)[0])

    def read_range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: a run of each level, whose begin is a rank of the level above."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level, (chunks, bits, _, _) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= np.frombuffer(self._at(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(LEVEL_BITS * level)
            own = np.unpackbits(np.frombuffer(self._at(bits + a // 8, -(-b // 8) - a // 8), np.uint8), bitorder="little")
            on = own[a % 8 : a % 8 + b - a].astype(bool)
            where = where[on]
            if level + 1 < len(self.levels) and len(where):
                a = self._rank(level, a)
                b = a + len(where)
            else:
                break
        return out

    def document(self, k: int) -> np.ndarray:
        return self.read_range(int(self.starts[k]), int(self.starts[k + 1]))


# --- Spark

def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Files of the documents' ids in ascending order of doc_id. Returns (file, first_doc, docs, ids, start), a row a file."""
    spark = docs.sparkSession
    docs = docs.select(
        F.coalesce(F.col(doc_id), F.raise_error(F.lit("a document without an id")).cast("long")).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    content = vocabulary(spark, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(content.value)
        doc_ids, runs = [], []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(i)
                runs.append(np.array([*encode(t.as_py() or ""), end], np.uint32))
        if not doc_ids:
            return
        starts = np.cumsum([0, *map(len, runs)])
        uri = f"{path}/ids-{doc_ids[0]:020d}-{uuid.uuid4().hex}.dac"
        write_file(uri, np.array(doc_ids, np.int64), starts, np.concatenate(runs))
        yield pa.RecordBatch.from_pydict({"file": [uri], "first_doc": [doc_ids[0]], "docs": [len(doc_ids)], "ids": [int(starts[-1])]})

    ranged = docs.repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id", "text")
    written = stage(ranged.mapInArrow(run, "file string, first_doc long, docs long, ids long"), "token-files")
    # A row for each file: their running sum is the place of each file's first id.
    order = Window.orderBy("first_doc", "file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, each read by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                n = np.diff(f.starts)
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(f.docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids), pa.array(f.starts[:-1] + start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    # A task a file, as far as there are tasks: the rows are names.
    spread = files.select("file", "start").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, path, vocabulary_path))
