"""Toxicity: bags of subwords, averaged into a linear softmax, trained jointly in numpy.

A word is its character n-grams of 3 to 5 letters, with marks at its ends; each has a vector, so that an unseen
misspelling shares most of the vectors of the word it comes from. A text is the mean of the vectors of all its n-grams,
and a softmax over two classes gives its score. Vectors and weights are trained together.

Since the softmax is linear in the mean, a trained model is one number for each n-gram bucket: (vector x difference of the
two weights). Only these are sent to tasks (BUCKETS numbers, whatever the data's size).

The sample for training is bounded: MAX_PER_LABEL rows of each label, those of smallest hash of id, of at most
MAX_TRAIN_CHARS characters each (longer ones are not learnt from, but scored whole). Everything else covers all rows.
Only the text is an input of a score. Null, empty and blank texts have the score of an empty bag. Very long texts are
scored whole, in pieces. A score depends on its text alone, so repeated rows score alike and ties don't matter; rows with
a null id or label are not learnt from. An empty table gives an empty result; without rows of both labels all scores are
that of the share of label 1. Other columns pass through `score` (a column of its result's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cistern.llm.frames import with_fields
from cistern.llm.wordhash import mix

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSION = 8
#: Rounds over the sample, and steps that small samples are trained for at least.
EPOCHS = 15
STEPS = 800
#: N-grams without a vote that are added to each text, so that the mean of a short text is no larger than it deserves.
PRIOR = 60
BATCH = 64
RATE = 0.5
#: Texts of the sample that an n-gram must be in, to have a vector.
MIN_TEXTS = 3
MAX_PER_LABEL = 2_500
MAX_TRAIN_CHARS = 50_000
THRESHOLD = 0.7
PIECE = 1 << 18
_A = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(128, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _segments(texts: Iterable[str | None]) -> Iterator[tuple[int, str]]:
    """(row, piece) of texts; pieces end behind a space where there is one."""
    for row, text in enumerate(texts):
        text = (text or "").lower()
        a, n = 0, len(text)
        while a < n:
            b = min(n, a + PIECE)
            if b < n:
                b = max(text.rfind(" ", a, b), text.rfind("\n", a, b)) + 1 or b
                b = b if b > a else min(n, a + PIECE)
            yield row, text[a:b]
            a = b


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, code points of their pieces with a mark around each, where each piece begins)."""
    rows, parts, size = [], [], 0
    for row, piece in _segments(texts):
        rows.append(row)
        parts.append(piece)
        size += len(piece)
        if size >= PIECE:
            yield _coded(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        yield _coded(rows, parts)


def _coded(rows: list[int], parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, points, starts


def _grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, whether it is an n-gram of one word) at each place, for each size."""
    mark = np.zeros(len(points), bool)
    low = points < 128
    mark[low] = ~_LETTER[points[low]]
    code = points.astype(np.uint64)
    code[mark] = 1
    n = len(code)
    h, inner = code.copy(), np.zeros(n, bool)
    for size in range(2, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            return
        h = h[:m] * _A + code[size - 1 :]
        if size > 2:
            inner = inner[:m] | mark[size - 2 : size - 2 + m]
        if size in SIZES:
            yield (mix(h + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int32), ~inner[:m]


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares of all n-grams) of each text, in order; the n-grams of one text are held at a time."""
    given, parts = 0, []
    for rows, points, starts in _blocks(texts):
        ends = np.append(starts[1:], len(points)).tolist()
        grams = list(_grams(points))
        for row, a, b in zip(rows, starts.tolist(), ends, strict=True):
            # Pieces come in the order of their rows; a row without pieces has an empty bag.
            while given < row:
                yield _bag(parts)
                given, parts = given + 1, []
            parts += [bucket[a:b][valid[a:b]] for bucket, valid in grams]
    while given < len(texts):
        yield _bag(parts)
        given, parts = given + 1, []


def _bag(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
    return own, (count / (count.sum() + PRIOR)).astype(np.float32)


class Bags:
    """Bags of a sample in long arrays, a few for many texts, without the n-grams that few texts hold."""

    def __init__(self, texts: list[str | None]) -> None:
        held, self._packs, self._at = np.zeros(BUCKETS, np.int64), [], []
        own, size = [], 0
        for bag in bags(texts):
            held[bag[0]] += 1
            own.append(bag)
            size += len(bag[0])
            if size >= PIECE:
                self._pack(own)
                own, size = [], 0
        self._pack(own)
        self.common = held >= MIN_TEXTS
        for i, (buckets, shares, ends) in enumerate(self._packs):
            keep = self.common[buckets]
            self._packs[i] = buckets[keep], shares[keep], np.append(0, np.cumsum(keep))[ends].tolist()

    def _pack(self, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if own:
            self._at += [(len(self._packs), i) for i in range(len(own))]
            buckets, shares = (np.concatenate([bag[k] for bag in own]) for k in (0, 1))
            self._packs.append((buckets, shares, np.cumsum([0, *(len(bag[0]) for bag in own)])))

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        pack, i = self._at[row]
        buckets, shares, ends = self._packs[pack]
        return buckets[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]]


def train(texts: list[str], labels: list[int], weights: list[float], seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias): the logit of a text is their mean over its n-grams, and the bias."""
    return train_on(Bags(texts), labels, weights, seed)


def train_on(data: Bags, labels: list[int], weights: list[float], seed: int = 7) -> tuple[np.ndarray, float]:
    y, w = np.array(labels, np.int64), np.array(weights, np.float64)
    if len(set(labels)) < 2:
        share = (float((y * w).sum()) + 0.5) / (float(w.sum()) + 1)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    w = w / w.mean()
    draw = np.random.default_rng(seed)
    # A mean over thousands of n-grams is short: vectors are scaled so that a few of them can decide.
    vectors = draw.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    soft = draw.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
    bias = np.log(np.array([(w * (y == 0)).sum(), (w * (y == 1)).sum()]) / w.sum()).astype(np.float32)
    scale = np.float32(30)
    seen_v, seen_s, seen_b = np.full(vectors.shape, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        order = draw.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = [r for r in order[at : at + BATCH] if len(data[r][0])]
            if not rows:
                continue
            sizes = [len(data[r][0]) for r in rows]
            buckets, shares = np.concatenate([data[r][0] for r in rows]), np.concatenate([data[r][1] for r in rows]) * scale
            hidden = np.add.reduceat(vectors[buckets] * shares[:, None], np.cumsum([0, *sizes[:-1]]))
            z = hidden @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (w[rows] / len(rows))[:, None].astype(np.float32)
            grad_s, grad_b = hidden.T @ p, p.sum(axis=0)
            back = np.repeat(p @ soft.T, sizes, axis=0) * shares[:, None]
            own, place = np.unique(buckets, return_inverse=True)
            grad_v = np.stack([np.bincount(place, back[:, k], len(own)) for k in range(DIMENSION)], axis=1).astype(np.float32)
            seen_v[own] += grad_v**2
            vectors[own] -= rate * 0.1 * grad_v / np.sqrt(seen_v[own])
            seen_s += grad_s**2
            soft -= rate * 0.1 * grad_s / np.sqrt(seen_s)
            seen_b += grad_b**2
            bias -= rate * 0.1 * grad_b / np.sqrt(seen_b)
    one = (vectors @ (soft[:, 1] - soft[:, 0])) * scale
    one[~data.common] = 0
    return one.astype(np.float32), float(bias[1] - bias[0])


def scores(texts: list[str | None], of: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, points, starts in _blocks(texts):
        for bucket, valid in _grams(points):
            own = starts[starts < len(bucket)]
            at = rows[: len(own)]
            np.add.at(total, at, np.add.reduceat(np.where(valid, of[bucket], np.float32(0)), own, dtype=np.float64))
            np.add.at(count, at, np.add.reduceat(valid, own, dtype=np.int64))
    return 1 / (1 + np.exp(-(total / (count + PRIOR) + bias)))


def sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of the bounded sample; weights restore the shares of the labels among all rows."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").distinct()
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("id").cast("string"))
    # The largest hash that is taken is enough to pick the rows where they are.
    picked = None
    for y in counts:
        first = own.where(F.col("y") == y).orderBy(order, "id").limit(MAX_PER_LABEL)
        picked = first if picked is None else picked.union(first)
    if picked is None:
        return [], [], []
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") <= MAX_TRAIN_CHARS)
    rows = found.join(F.broadcast(picked), "id").orderBy(order, "id", "t").limit(4 * MAX_PER_LABEL).collect()
    n = {y: sum(r["y"] == y for r in rows) for y in counts}
    return [r["t"] for r in rows], [int(r["y"]) for r in rows], [counts[r["y"]] / n[r["y"]] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    texts, marks, weights = sample(docs, labels, label, doc_id, text)
    data = Bags(texts)
    del texts  # the driver holds the bags or the texts, not both while it trains
    return train_on(data, marks, weights)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", result: str = "score") -> DataFrame:
    """docs with the score of each text: 0 to 1, higher where label 1 is likelier."""
    of, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(of)
    docs = docs.drop(*({result} - {text}))
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                own = scores(part.column(place).to_pylist(), sent.value, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.float64())], [*names, result])

    return docs.mapInArrow(run, with_fields(docs, **{result: DoubleType()}))
