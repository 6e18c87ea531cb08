"""Near copies by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

A text is lower-cased (A-Z) and cut into words; its set is its distinct five-word shingles, as 64-bit hashes. One
permutation of the hashes is cut into BINS bins; an empty bin takes the value of the first filled one in an order of its
own. ROWS bins make a band. Texts with equal sets are one representative, so that copies never meet in a bucket. In each
bucket two centres have an edge to every other member: a bucket of m makes less than 2 * m edges, never m * m. Edges that
the texts' sketches don't rule out are confirmed on full sets.

A sketch has a bit for each place that a shingle falls on, at least eight places for each shingle of the set, whatever its
size. Each bit that only one of two texts has is a shingle at least that the other lacks, so sketches rule out no linked pair.

Two texts at a similarity of 0.75 share no bucket with a probability of about 5e-6, and ten of the 32 on average. Stars
may miss a link between two members that are both unlike their centres. In buckets whose members are of several components
all pairs of different components are therefore compared, by sketches that exclude no linked pair, and what these leave is
confirmed on full sets. So within buckets no link is lost. These comparisons grow with the square of such a bucket, as bit
counts in blocks of members that are spread over tasks; the rows shuffled for it grow with the square over BLOCK.

Null, empty and blank texts have no set and stand alone. Texts of less than five words are one shingle. Repeated rows
are copies. Rows of one id are one document, whose texts are each compared. Rows with a null id stand alone, and their
component_id is null. Very long texts are whole. An empty table gives an empty result. Columns but id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cistern.llm.wordhash import WordHasher, mix, text_blocks
from cistern.sources.scratch import discard, stage

WORDS = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
PERCENT = 75
#: Bits of a sketch: a power of two, at least so many, and so many for each shingle.
SKETCH, SKETCH_BITS = 2048, 8
BLOCK = 512

_C = np.uint64(0xD6E8FEB86659FD93)


def _shingle_sets(hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, begin, _ = hasher.words(data, at[:-1])
    cut = np.searchsorted(begin, at)
    n = len(h)
    if n >= WORDS:
        s = h[: n - WORDS + 1].copy()
        for k in range(1, WORDS):
            s = mix(s * _C + h[k : n - WORDS + 1 + k])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * _C + h[k : k + 1])
            yield x
        else:
            yield np.zeros(0, np.uint64)


class Signer:
    def __init__(self) -> None:
        step = (1 << 64) // BINS
        self.edges = np.array([i * step for i in range(BINS)], np.uint64)
        # place[i, j]: where bin j stands in the order in which an empty bin i looks for a value.
        self.place = mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS).argsort(axis=1).argsort(axis=1).astype(np.uint16)
        self.salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))

    def bands(self, s: np.ndarray) -> np.ndarray:
        """Band hashes of a sorted set that isn't empty."""
        first = np.searchsorted(s, self.edges)
        ends = np.append(first[1:], len(s))
        filled = first < ends
        value = s[np.minimum(first, len(s) - 1)]
        if not filled.all():
            have, lack = np.flatnonzero(filled), np.flatnonzero(~filled)
            value[lack] = value[have[self.place[np.ix_(lack, have)].argmin(axis=1)]]
        out = self.salt.copy()
        for row in value.reshape(BANDS, ROWS).T:
            out = mix(out * _C + row)
        return out.view(np.int64)


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketch(s: np.ndarray) -> bytes:
    size = max(SKETCH, 1 << max(0, SKETCH_BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix(s) & np.uint64(size - 1)).astype(np.int64)] = 1
    # Bit k of a sketch folded in half is bit k or bit k + size / 2 of the whole.
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they are for `size` bits."""
    while bits.shape[1] * 64 > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _may_be_linked(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """For each pair of sketches of one size: whether their sets may be linked."""
    common = np.bitwise_count(x & y).sum(1, np.int64)
    both = common + np.minimum(nx - np.bitwise_count(x).sum(1, np.int64), ny - np.bitwise_count(y).sum(1, np.int64))
    return 100 * both >= PERCENT * (nx + ny - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, signer = WordHasher(), Signer()
    for batch in batches:
        for a, b, data, at in text_blocks(batch.column(1)):
            sizes, digests, bands, bits = [], [], [], []
            for s in _shingle_sets(hasher, data, at):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(signer.bands(s) if len(s) else None)
                bits.append(_sketch(s) if len(s) else None)
            cols = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *cols, batch.column(2).slice(a, b - a)], ["doc_id", "n", "digest", "bands", "bits", "text_hash"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for a, b, data, at in text_blocks(batch.column(1)):
            sets = pa.array([s.view(np.int64) for s in _shingle_sets(hasher, data, at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["doc_id", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, and their set sizes na, nb) those that are linked, by their full sets."""
    # Each pair is checked once. Nothing above the joins needs their order, so a hot centre's rows can be split over tasks.
    x = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    x = x.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    x = x.select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("sum"))
    return x.where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b): the smallest node that each can reach.

    Rounds of two steps: every node's larger neighbours, then its smaller ones, are joined to the smallest neighbour.
    Each round is a written table; the number of rounds grows with the logarithm of the longest path.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # Large star: for u, every larger neighbour points to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: for u, itself and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = stage(small, "links")
        same = after.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        settled = same == edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        if settled:
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _like_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).distinct()


def _shared(members: DataFrame) -> DataFrame:
    """Members (key, rep, n) of buckets of two and more, with the number that each has around it in all of its buckets."""
    sizes = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = stage(members.join(sizes, "key"), "buckets")
    around = shared.groupBy("rep").agg(F.sum("m").alias("around"))
    out = stage(shared.join(around, "rep").select("key", "rep", "n", "around"), "members")
    discard(shared)
    return out


def _stars(shared: DataFrame) -> DataFrame:
    """(key, a, na, b, nb): edges from two centres of each bucket to every other member.

    One centre is the member with most others around it, which in a group of edited copies is likely the text they come
    from; the other is drawn by a hash, so that the buckets of two texts have different centres.
    """
    first = F.min(F.struct((-F.col("around")).alias("o"), "rep", "n")).alias("c1")
    drawn = F.min(F.struct(F.xxhash64("rep", "key").alias("o"), "rep", "n")).alias("c2")
    centres = shared.groupBy("key").agg(first, drawn)
    both = shared.join(centres, "key").withColumn("c", F.explode(F.array_distinct(F.array(F.struct("c1.rep", "c1.n"), F.struct("c2.rep", "c2.n")))))
    return both.where("rep <> c.rep").select("key", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))


def _pairs(stars: DataFrame) -> DataFrame:
    """Each pair of texts once, the smaller first."""
    turn = F.col("a") < F.col("b")
    cols = [F.when(turn, F.col(x)).otherwise(F.col(y)).alias(z) for z, x, y in (("a", "a", "b"), ("na", "na", "nb"), ("b", "b", "a"), ("nb", "nb", "na"))]
    return _like_sizes(stars.select(*cols))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column(1).offsets.to_numpy()
        h = batch.column(1).values.to_numpy().view(np.uint64)
        out = [_sketch(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(out, pa.binary())], ["rep", "n", "bits"])


def _words_of(bits: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(each sketch as a row of 64-bit words, their sizes in bits)."""
    rows = [np.frombuffer(b, np.uint64)[None, :] for b in bits.to_pylist()]
    return rows, np.array([64 * r.shape[1] for r in rows], np.int64)


def _not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, na, b, nb and their sketches) those whose sketches allow a link."""
    for batch in batches:
        if not len(batch):
            continue
        na, nb = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        (x, own), (y, other) = _words_of(batch.column(4)), _words_of(batch.column(5))
        size, keep = np.minimum(own, other), np.zeros(len(batch), bool)
        for z in np.unique(size).tolist():
            at = np.flatnonzero(size == z)
            left, right = (np.concatenate([_folded(rows[i], z) for i in at.tolist()]) for rows in (x, y))
            keep[at] = _may_be_linked(left, na[at], right, nb[at])
        yield batch.filter(pa.array(keep)).select([0, 1, 2, 3])


def _unlike_dropped(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    kind = sketches.schema["rep"].dataType.simpleString()
    x = pairs.join(sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), ["b", "nb"])
    x = x.join(sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), ["a", "na"])
    return x.select("a", "na", "b", "nb", "x", "y").mapInArrow(_not_ruled_out, f"a {kind}, na long, b {kind}, nb long")


def _compared(block: pa.Table) -> pa.Table:
    """Pairs of different components that may be linked, of two blocks of a bucket's members or within one."""
    block = block.combine_chunks()
    n, own = block["n"].to_numpy(), block["own"].to_numpy()
    root = block["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    rows, size = _words_of(block["bits"])
    left = np.flatnonzero(own == own.min())
    right = left if len(left) == len(n) else np.flatnonzero(own != own.min())
    if len(left) == len(n) and block["lo"][0] != block["hi"][0]:
        right = right[:0]  # the other block is empty
    first, second = [left[:0]], [left[:0]]
    # Sets of like size have sketches of one size, or one has twice the other's and is folded.
    for z in np.unique(size).tolist():
        of = np.flatnonzero((size == z) | (size == 2 * z))
        place = np.full(len(n), -1)
        place[of] = np.arange(len(of))
        bits = np.concatenate([_folded(rows[i], z) for i in of.tolist()])
        for k, a in enumerate(left.tolist()):
            if place[a] < 0:
                continue
            b = left[k + 1 :] if right is left else right
            b = b[(place[b] >= 0) & (np.minimum(size[b], size[a]) == z) & (root[b] != root[a])]
            b = b[100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])]
            b = b[_may_be_linked(bits[place[a]][None, :], n[a], bits[place[b]], n[b])]
            first.append(np.full(len(b), a))
            second.append(b)
    a, b = block.take(pa.array(np.concatenate(first))), block.take(pa.array(np.concatenate(second)))
    return pa.table([a["rep"], a["n"], b["rep"], b["n"]], ["a", "na", "b", "nb"])


def _searched_on(shared: DataFrame, roots: DataFrame, tested: DataFrame, sets: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """(node, root) after all pairs of different components in a bucket are compared.

    Members of a bucket of several components are dealt into blocks, and each two blocks are compared in a group of their
    own, so a hot bucket is spread over many tasks. Pairs that their sketches exclude are never rows.
    """
    kind = sets.schema["doc_id"].dataType.simpleString()
    if sketches is None:
        sketches = stage(sets.mapInArrow(_sketched, f"rep {kind}, n long, bits binary").distinct(), "sketches")
    own = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    own = stage(own.select("key", "rep", "n", "root"), "own")
    several = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    members = own.join(several.select("key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "key")
    dealt = members.join(sketches, ["rep", "n"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "n", "root", "bits")
    compared = dealt.groupBy("key", "lo", "hi").applyInArrow(_compared, f"a {kind}, na long, b {kind}, nb long")
    pairs = stage(_pairs(compared).join(tested, ["a", "b"], "left_anti"), "pairs")
    found = stage(_confirmed(pairs, sets), "more")
    if found.take(1):
        # A component is a star of links to its root: new links are added to those.
        roots = components(found.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    discard(own, pairs, found)
    return roots


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row. kept: the row has the smallest id of its component."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stage(docs.mapInArrow(_signed, f"doc_id {kind}, n long, digest binary, bands array<long>, bits binary, text_hash long"), "signatures")
    sets_of = signed.where("n > 0 and doc_id is not null")
    reps = sets_of.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = stage(reps, "representatives")
    chosen = sets_of.join(reps, (F.col("doc_id") == F.col("rep")) & (sets_of["digest"] == reps["digest"]), "left_semi").dropDuplicates(["doc_id", "digest"])
    # Rows of one id may have several sets; a representative is then told apart by its set.
    members = chosen.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key"))
    shared = _shared(members)
    wanted = stage(shared.select("rep").distinct(), "wanted")
    sketches = chosen.select(F.col("doc_id").alias("rep"), "n", "bits").join(wanted, "rep", "left_semi")
    sketches = stage(sketches, "sketches")
    starred = stage(_pairs(_stars(shared)), "pairs")
    pairs = stage(_unlike_dropped(starred, sketches), "pairs")
    # The same plan at every size: the texts meet the ids by a merge, not by a broadcast while the ids are few.
    found = docs.join(wanted.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi")
    sets = stage(found.select("doc_id", "text").mapInArrow(_sets, f"doc_id {kind}, shingles array<long>"), "sets")
    links = stage(_confirmed(pairs, sets), "confirmed")
    roots = components(links)
    discard(pairs, links)
    roots = _searched_on(shared, roots, starred.select("a", "b"), sets, sketches)
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    out = signed.join(named, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        "text_hash",
    )
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
    out = stage(out, "components")
    discard(signed, reps, shared, wanted, sketches, starred, sets, roots)
    return out
