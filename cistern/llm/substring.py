"""Substring dedup: words of passages that also stand in a document of a smaller id are removed.

A window is LENGTH consecutive words. Windows that follow each other and have the same least GRAM-word hash (their key)
are a piece: its windows and nothing else. Equal windows have equal keys wherever they stand, so all that may match meets
by key. Keys of a single text are dropped in one narrow pass (two hashes, an id). Of the pieces that are left, each
distinct one is sent once, as text, to the shard of its key; the shard builds a compressed FM-index of its pieces
(`fmindex`), streams them through it backwards, and reports every place whose matching statistic reaches LENGTH with the
smallest id that its interval of rows holds. Statistics are counted up to LENGTH, where a match is decided. Documents take
their pieces' reports by (key, hash of the piece).

Equal texts are one: only the row of smallest id is searched, the others are removed as they are passages of it. Where a
key stands in more than a few of a sample of texts (HOT of about SAMPLE), windows of that key are pieces by themselves, with
the hash of the whole window as their key: a passage in a third of all documents makes no shard of their surroundings. The
sample decides how pieces are cut, not what is found. The list of these hashes is bounded by the sample's words over HOT.

Null texts have no words. A null id has no order: such a row loses nothing and removes nothing. Rows of one id are compared
with smaller ids, not with each other. Texts of less than LENGTH words lose nothing. Very long texts are whole; words may
be of any length. An empty table gives an empty result. Only id and text are read; ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cistern.llm.fmindex import Index
from cistern.llm.wordhash import WordHasher, mix, text_blocks
from cistern.sources.scratch import stage

LENGTH = 13
GRAM = 5
#: Texts of the sample that finds frequent keys, and how many of them make a key frequent.
SAMPLE, HOT = 8_192, 32
#: Windows of a piece at most; a longer run of one key, as in periodic texts, is cut.
RUN = 256
#: Bytes of all texts for each shard.
SHARD_BYTES = 8 << 20

_C = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0x8F1BBCDC)


def exact_hasher() -> WordHasher:
    """Of words as they are: no letter is changed."""
    hasher = WordHasher()
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    values[hasher.separates] = 0
    hasher.values = values
    return hasher


def _frequent(sorted_: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(of), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, of), len(sorted_) - 1)] == of


class Pieces:
    """The pieces of a block of texts: begin, n (of windows), text, key, sid; frequent: the key is known to be shared."""

    def __init__(self, hasher: WordHasher, data: np.ndarray, at: np.ndarray, keys: np.ndarray, windows: np.ndarray):
        h, self.first_byte, self.end_byte = hasher.words(data, at[:-1])
        self.cut = np.searchsorted(self.first_byte, at)
        self.words = n = len(h)
        most = max(0, n - LENGTH + 1)
        gram = mix(h)
        for k in range(1, GRAM):
            gram[: max(0, n - k)] = mix(gram[: max(0, n - k)] * _C + h[k:])
        self.least = _sliding_min(gram, LENGTH - GRAM + 1)[:most]
        text = np.repeat(np.arange(len(at) - 1), np.diff(self.cut))
        valid = text[:most] == text[LENGTH - 1 :] if most else np.zeros(0, bool)
        if n + 1 > len(hasher.up):
            hasher._grow(n + 2)
        self._up, self._down = hasher.up, hasher.down
        self._sums = [self._sum(h), None]
        self._h = h
        fresh = valid.copy()
        fresh[1:] &= (self.least[1:] != self.least[:-1]) | ~valid[:-1] | (text[1:most] != text[: most - 1])
        alone = valid & _frequent(keys, self.least)
        fresh |= alone
        run = np.flatnonzero(fresh)
        if len(run):
            since = np.arange(most) - run[np.maximum(np.searchsorted(run, np.arange(most), "right") - 1, 0)]
            fresh |= valid & (since % RUN == 0)
        self.begin = np.flatnonzero(fresh)
        ends = np.append(self.begin[1:], most)
        # A piece ends before the next one, or with its text's last window.
        self.text = text[self.begin]
        self.n = np.minimum(ends, self.cut[self.text + 1] - LENGTH + 1) - self.begin
        self.sid = mix(self._range(0, self.begin, self.begin + self.n + LENGTH - 1) + self.n.astype(np.uint64) * _C)
        self.key = self.least[self.begin]
        own = np.flatnonzero(alone[self.begin])
        self.frequent = np.zeros(len(self.begin), bool)
        if len(own):
            self.key[own] = self.window_hashes(self.begin[own])
            self.frequent[own] = _frequent(windows, self.key[own])
        self.valid = valid

    def _sum(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self._up[: len(h)], dtype=np.uint64)])

    def _range(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self._sums[which]
        return (s[b] - s[a]) * self._down[a]

    def window_hashes(self, begin: np.ndarray) -> np.ndarray:
        if self._sums[1] is None:
            self._sums[1] = self._sum(mix(self._h ^ _OTHER))
        return mix(self._range(1, begin, begin + LENGTH))

    @property
    def names(self) -> np.ndarray:
        """Key and sid in one number, for look-ups within a text."""
        return _named(self.key, self.sid)


def _named(key: np.ndarray, sid: np.ndarray) -> np.ndarray:
    return mix(key * _C + sid)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width]; what reaches over the end isn't used."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, h): the distinct keys of each text and the hashes of its whole windows."""
    hasher, none = exact_hasher(), np.zeros(0, np.uint64)
    for batch in batches:
        for _, _, data, at in text_blocks(batch.column(0)):
            p = Pieces(hasher, data, at, none, none)
            place = np.flatnonzero(p.valid)
            text = np.searchsorted(p.cut, place, "right") - 1
            for whole, h in ((0, p.least[place]), (1, p.window_hashes(place))):
                order = np.lexsort((h, text))
                h, t = h[order], text[order]
                once = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
                found = _longs(h[once])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), whole), pa.int32()), found], ["whole", "h"])


def _frequent_hashes(docs: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and hashes of whole windows, that HOT or more of about SAMPLE distinct texts have."""
    share = max(1, texts // SAMPLE)
    sample = docs.where(F.pmod("did", F.lit(share)) == 0).dropDuplicates(["did"]).select("text")
    found = sample.mapInArrow(_candidates, "whole int, h long").groupBy("whole", "h").count().where(F.col("count") >= HOT).collect()
    return tuple(np.sort(np.array([r["h"] for r in found if r["whole"] == k], np.int64).view(np.uint64)) for k in (0, 1))


NAMES = ["key", "sid", "doc", "known"]
PIECES = "key long, sid long, doc long, known int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those whose key stands in documents of several ids, and those known to be shared.

    Rows of the latest key wait while all are of one id, each piece once.
    """
    wait = [np.zeros(0, np.int64)] * 4
    shared: int | None = None  # the latest key, if it is in several documents
    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(4)]
        known = new[3] > 0
        yield from _rows([c[known] for c in new])
        key, sid, doc, _ = cols = [np.concatenate([w, c[~known]]) for w, c in zip(wait, new, strict=True)]
        if not len(key):
            continue
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(start, append=len(key))
        mixed = np.logical_or.reduceat(doc != np.repeat(doc[start], size), start)
        mixed[0] |= shared is not None and key[0] == shared
        yield from _rows([c[np.repeat(mixed, size)] for c in cols])
        shared = int(key[-1]) if mixed[-1] else None
        keep = start[-1] + np.unique(sid[start[-1] :], return_index=True)[1] if shared is None else np.zeros(0, np.int64)
        wait = [c[keep] for c in cols]


def _rows(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(cols[0]):
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32())], NAMES)


def _pieces_of(keys: np.ndarray, windows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct pieces of each text (doc_id, text)."""
        hasher = exact_hasher()
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for a, _, data, at in text_blocks(batch.column(1)):
                p = Pieces(hasher, data, at, keys, windows)
                order = np.lexsort((p.sid, p.key, p.text))
                k, s, t, f = p.key[order], p.sid[order], p.text[order], p.frequent[order]
                once = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]))[: len(k)]
                yield from _rows([k[once].view(np.int64), s[once].view(np.int64), doc[t[once] + a], f[once].astype(np.int32)])

    return run


def _contents_of(keys: np.ndarray, windows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted pieces (key, sid, doc, last, text) of each text; wanted: its lists of keys, sids and last ids."""
        hasher = exact_hasher()
        for batch in batches:
            doc = batch.column(0).to_numpy()
            lists = [batch.column(i) for i in (2, 3, 4)]
            offsets = lists[0].offsets.to_numpy()
            key, sid, last = (x.values.to_numpy() for x in lists)
            names = _named(key.view(np.uint64), sid.view(np.uint64))
            for a, _, data, at in text_blocks(batch.column(1)):
                p = Pieces(hasher, data, at, keys, windows)
                found, which = _matched(p, names, offsets, a, first_only=True)
                begin = p.first_byte[p.begin[found]]
                end = p.end_byte[p.begin[found] + p.n[found] + LENGTH - 2]
                raw = data.tobytes()
                texts = pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                for i in range(0, len(texts), 20_000):
                    own = which[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [_longs(key[own]), _longs(sid[own]), _longs(doc[a + p.text[found[i : i + 20_000]]]), _longs(last[own]), texts.slice(i, 20_000)],
                        ["key", "sid", "doc", "last", "text"],
                    )

    return run


def _matched(p: Pieces, names: np.ndarray, offsets: np.ndarray, a: int, first_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, places in `names`) of the pieces that stand in the list of their text. Row i has names[offsets[i] : offsets[i + 1]]."""
    base, texts = int(offsets[a]), len(p.cut) - 1
    held = offsets[a : a + texts + 1] - base
    listed = names[base : base + int(held[-1])]
    row = np.repeat(np.arange(texts), np.diff(held))
    # One number for row and name; lists of a block are sorted together.
    wanted = mix(listed + row.astype(np.uint64) * _C)
    order = np.argsort(wanted, kind="stable")
    have = mix(p.names + p.text.astype(np.uint64) * _C)
    if not len(order) or not len(have):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted[order], have), len(order) - 1)
    found = np.flatnonzero(wanted[order[at]] == have)
    if first_only:
        found = found[np.sort(np.unique(have[found], return_index=True)[1])]
    return found, base + order[at[found]]


def _searched(shard: pa.Table) -> pa.Table:
    """(key, sid, firsts) of the pieces of a shard: the smallest id that has each of a piece's windows.

    Pieces of which no holder has a larger id than those are left out.
    """
    shard = shard.combine_chunks()
    texts, hasher = shard["text"].combine_chunks(), exact_hasher()
    hashes, sizes = [], []
    for _, _, data, at in text_blocks(texts):
        h, begin, _ = hasher.words(data, at[:-1])
        hashes.append(h)
        sizes.append(np.diff(np.append(np.searchsorted(begin, at[:-1]), len(h))))
    size = np.concatenate(sizes)
    word, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
    end = np.cumsum(size + 1) - 1  # a 0 follows each piece
    symbols = np.zeros(int(end[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[end] = False
    symbols[inside] = symbol + 1
    begin = end - size
    index = Index(symbols, np.repeat(shard["doc"].to_numpy(), size + 1), len(word) + 1, LENGTH)
    length, least = index.statistics(symbols, begin, end)
    window = length == LENGTH
    n = np.add.reduceat(window, begin)
    firsts, offsets = least[window], np.concatenate([[0], np.cumsum(n)])
    told = np.minimum.reduceat(np.append(firsts, 0), offsets[:-1]) < shard["last"].to_numpy()
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(firsts, pa.int64()))
    return pa.table([shard["key"], shard["sid"], out], ["key", "sid", "firsts"]).filter(pa.array(told))


def _kept_of(keys: np.ndarray, windows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each text; its pieces' reports are lists of keys, sids and of places of windows to remove."""
        hasher, names = exact_hasher(), ["doc_id", "text", "n_words", "n_removed", "kept"]
        for batch in batches:
            state = batch.column(2).to_pylist()
            found = [batch.column(i) for i in (3, 4, 5)]
            rows = found[0].offsets.to_numpy()
            names_ = _named(*(x.values.to_numpy().view(np.uint64) for x in found[:2]))
            places, places_at = found[2].values.values.to_numpy(), found[2].values.offsets.to_numpy()
            for a, b, data, at in text_blocks(batch.column(1)):
                p = Pieces(hasher, data, at, keys, windows)
                own, which = _matched(p, names_, rows, a)
                n = places_at[which + 1] - places_at[which]
                start = np.repeat(p.begin[own], n) + places[np.repeat(places_at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                cover = np.zeros(p.words + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                raw, cut, bounds = data.tobytes(), p.cut.tolist(), at.tolist()
                total, removed, kept = [], [], []
                for i in range(b - a):
                    words = raw[bounds[i] : bounds[i + 1]].split()
                    off = gone[cut[i] : cut[i + 1]]
                    if state[a + i] == "copy" and len(words) >= LENGTH:
                        k = len(words)
                        left = b""
                    else:
                        k = int(off.sum())
                        left = b" ".join(compress(words, (~off).tolist()) if k else words)
                    total.append(len(words))
                    removed.append(k)
                    kept.append(left)
                out = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                for i in range(0, b - a, 256):
                    yield pa.RecordBatch.from_arrays([x.slice(i, min(256, b - a - i)) for x in (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *out)], names)

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept) of every row; kept: the words that stay, joined by one space."""
    # Names and types are touched only where they differ: a column under an alias would be another exchange of the texts.
    docs = docs.select(doc_id, text).withColumnsRenamed({c: n for c, n in ((doc_id, "doc_id"), (text, "text")) if c != n})
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.where("doc_id is not null").withColumn("did", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Equal texts by a digest of 128 bits.
    equal = named.where("text is not null").select("doc_id", "did", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("size"))
    first = equal.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("did").alias("first_did"), F.min("size").alias("size"))
    first = stage(first.drop("digest"), "texts")
    texts, size = first.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(8, size // SHARD_BYTES)
    keys, windows = _frequent_hashes(named.where("text is not null").select("did", "text"), texts)

    # The texts are exchanged by id once: each use below reads the same exchange, so all joins are by the id alone and texts
    # of one id are told apart afterwards.
    same = F.col("did").bitwiseXOR(F.col("first_did")) == 0
    distinct = named.join(first.select(F.col("doc_id").alias("id"), "first_did"), (F.col("doc_id") == F.col("id")) & same)
    pieces = distinct.select("doc_id", "text").mapInArrow(_pieces_of(keys, windows), PIECES)
    # Pieces of frequent keys are shared for sure, and are spread by document.
    dealt = pieces.repartition(F.when(F.col("known") > 0, F.xxhash64("doc", "key")).otherwise(F.col("key")))
    shared = dealt.sortWithinPartitions("key").mapInArrow(_shared, PIECES).drop("known")
    holders = shared.groupBy("key", "sid").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    wanted = holders.groupBy(F.col("doc").alias("holder")).agg(F.collect_list(F.struct("key", "sid", "last")).alias("p"))
    fetched = distinct.join(wanted, F.col("doc_id") == F.col("holder")).select("doc_id", "text", "p.key", "p.sid", "p.last")
    contents = fetched.mapInArrow(_contents_of(keys, windows), "key long, sid long, doc long, last long, text binary")
    found = contents.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(
        lambda _, t: _searched(t), "key long, sid long, firsts array<long>"
    )
    # A piece's windows go from a document if a smaller id has them, whatever text of the id they stand in.
    places = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc"), i)), lambda i: i.isNotNull())
    told = shared.join(found, ["key", "sid"]).select("key", "sid", "doc", places.alias("places")).where(F.size("places") > 0)
    told = told.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("key", "sid", "places")).alias("r"))
    marks = first.select(F.col("doc_id").alias("id"), "first_did").join(told, "id", "left")
    empty = F.array().cast("array<struct<key:long,sid:long,places:array<int>>>")
    marked = named.join(marks, (F.col("doc_id") == F.col("id")) & same, "left")
    # A text that is no first one of its kind is a copy of one; null texts have nothing to lose.
    kind = F.when(F.col("first_did").isNull() & F.col("text").isNotNull(), "copy").otherwise("text")
    marked = marked.select("doc_id", "text", kind.alias("state"), F.coalesce("r", empty).alias("r"))
    alone = docs.where("doc_id is null").select("doc_id", "text", F.lit("text").alias("state"), empty.alias("r"))
    out = marked.unionByName(alone).select("doc_id", "text", "state", "r.key", "r.sid", "r.places")
    return out.mapInArrow(_kept_of(keys, windows), "doc_id long, text string, n_words long, n_removed long, kept string")


def removed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def check_sql() -> str:
    """The same rows in SQL: every window as text, with the smallest id that has it."""
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        win AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(words[i : i + {LENGTH - 1}], ' ') AS k
            FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) AS i FROM w WHERE len(words) >= {LENGTH})),
        low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT DISTINCT r, i + d AS p FROM (SELECT r, i FROM win JOIN low USING (k) WHERE m < doc_id) CROSS JOIN range({LENGTH}) t(d)),
        each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""
