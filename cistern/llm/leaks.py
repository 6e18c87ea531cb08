"""Benchmark decontamination: CGK embedding, repeated bit sampling over windows, exact edit verification.

Texts and items are compared as lower-case words (runs of ASCII letters and digits and of all other letters), so that
case, marks and line breaks don't matter. Places in bytes are those of the lower-cased text in UTF-8, which differ from
the text's own only behind a letter whose small form has another length.

The CGK embedding walks through a word sequence: at step t it writes the word under its head and moves on or stays, by a
random bit that depends on t and the word. Two sequences of small edit distance fall into step again soon after an edit,
so that their embeddings have a small Hamming distance. Hashes of a few sampled positions of the embedding are then
equal with good probability; WALKS embeddings with SAMPLES hashes each repeat that until a leak is found with the
probability wanted.

Windows: an item's size class is the largest of SIZES that is at most a third of its words. In a text, windows of each size
follow one upon the other; in an item, they begin at every word. So whatever the place of a leaked item in a text, two of
the text's windows (one for the shortest items) lie within it and each is compared with the window of the item that begins at the same word. Equal hashes
propose (text, item, place); the proposal is then verified on the whole item: the least number of words to insert, delete or replace in order to turn the item
into some passage of the text around that place is at most MAX_EDITS times the item's words.

Items of less than MIN_WORDS words are too short for edits: they are found where their whole word sequence stands in a text,
by a hash of so many words and a comparison. In scripts without spaces each character is a word.

The items are a stated query set: their windows' hashes are broadcast, at most MAX_WINDOWS at a time (about 512 bytes each);
larger sets are handled in as many passes over the texts as they need. Null, empty and blank texts and items match nothing. Very long texts are whole. Equal items are all reported; the passage of
least distance, then the first, is reported for each text and item, so repeated rows give repeated results only where
they have ids of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cistern.llm.wordhash import WordHasher, mix, text_blocks

#: What separates words: ASCII but letters and digits.
SPACE = bytes(b for b in range(128) if not chr(b).isalnum())
MIN_WORDS = 8
SIZES = (4, 6, 8, 12)
WALKS, SAMPLES, PICKED = 4, 8, 6
MAX_EDITS = 0.2
MAX_WINDOWS = 250_000
SEED = 20_011


def window_size(words: int) -> int:
    """The size class of an item: windows of that size, one upon the other, have two within any run of so many words, and one in runs below the least class."""
    return max((z for z in SIZES if 3 * z - 1 <= words), default=SIZES[0])


def _picks(size: int, walk: int) -> np.ndarray:
    """Sampled steps of the embedding, SAMPLES rows: one in each of PICKED equal parts, so that few fall on one word.

    As a head moves every other step, they span the window.
    """
    draw = np.random.default_rng(SEED + 100 * size + walk)
    parts = min(PICKED, size + 1)
    edges = np.linspace(0, 2 * size - 1, parts + 1)
    return np.stack([np.floor(draw.uniform(edges[:-1], edges[1:])).astype(np.int64) for _ in range(SAMPLES)])


def sketches(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """WALKS * SAMPLES hashes of each of the windows of `size` words at `starts`."""
    out = []
    for walk in range(WALKS):
        picks = _picks(size, walk)
        salts = mix(np.arange(2 * size, dtype=np.uint64) + np.uint64(SEED + 1_000 * walk)) | np.uint64(1)
        parts = [np.full(len(starts), 64 * size + len(out) + k, np.uint64) for k in range(SAMPLES)]
        head, end = starts.copy(), starts + size
        for step in range(int(picks.max()) + 1):
            # Behind the window's end the walk writes nothing.
            under = np.where(head < end, words[np.minimum(head, len(words) - 1)], np.uint64(0))
            for k in np.flatnonzero((picks == step).any(axis=1)):
                parts[k] *= np.uint64(0xD6E8FEB86659FD93)
                parts[k] += under
            # The random bit of this step and word: word hashes are mixed, so the top bit of a product is as good.
            head += ((under * salts[step]) >> np.uint64(63)).astype(np.int64)
        out += [mix(p) for p in parts]
    return out


def edit_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, first word, word behind) of the passage of a text that is nearest to an item: least distance, then the first that ends, then the shortest."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    for k in range(len(item)):
        # Cell j: item[: k + 1] against a passage that ends before word j. Deletion and replacement first, then insertions.
        swap = row[:-1] + (text != item[k])
        drop = row[1:] + 1
        cost = np.empty(n + 1, np.int64)
        cost[0] = k + 1
        cost[1:] = np.minimum(swap, drop)
        begin = np.empty(n + 1, np.int64)
        begin[0] = 0
        begin[1:] = np.where(swap <= drop, start[:-1], start[1:])
        # Insertions run to the right at one each: a running minimum of cost - j.
        level = cost - np.arange(n + 1)
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, np.arange(n + 1), 0))
        row, start = least + np.arange(n + 1), begin[source]
    j = int(row.argmin())
    return int(row[j]), int(start[j]), j


def words_of(hasher: WordHasher, text: str | None) -> np.ndarray:
    return hasher.words(np.frombuffer(pc.utf8_lower(text or "").as_py().encode(), np.uint8), np.zeros(1, np.int64))[0]


def _whole(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return out


class Items:
    """The items of one pass: their words, and their windows' hashes in order."""

    def __init__(self, rows: list[tuple]):
        hasher = WordHasher(SPACE, characters=True)
        self.rows = [(item_id, words) for item_id, text in rows if len(words := words_of(hasher, text))]
        # Short items by their number of words: sorted hashes of the whole item, and which item.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, MIN_WORDS):
            own = [i for i, (_, w) in enumerate(self.rows) if len(w) == size]
            if own:
                h = np.concatenate([_whole(self.rows[i][1], size) for i in own])
                order = np.argsort(h, kind="stable")
                self.short[size] = h[order], np.array(own)[order]
        self.tables: dict[int, list[tuple]] = {}
        for size in sorted({window_size(len(w)) for _, w in self.rows if len(w) >= MIN_WORDS}):
            own = [(i, w) for i, (_, w) in enumerate(self.rows) if len(w) >= MIN_WORDS and window_size(len(w)) == size]
            item = np.concatenate([np.full(len(w) - size + 1, i, np.int32) for i, w in own])
            offset = np.concatenate([np.arange(len(w) - size + 1, dtype=np.int32) for _, w in own])
            hashes = [np.concatenate(x) for x in zip(*(sketches(w, np.arange(len(w) - size + 1), size) for _, w in own), strict=True)]
            self.tables[size] = []
            for h in hashes:
                order = np.argsort(h, kind="stable")
                # A table of the first bits rules out nearly all windows of texts.
                first = np.zeros(1 << 18, bool)
                first[(h >> np.uint64(46)).astype(np.int64)] = True
                self.tables[size].append((first, h[order], item[order], offset[order]))

    def proposals(self, words: np.ndarray, cut: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(text, item) -> places of the item's first word in the text, which may lie before it."""
        near: dict[tuple[int, int], set[int]] = {}
        if not len(words):
            return near
        place = np.arange(len(words))
        text = np.searchsorted(cut, place, "right") - 1
        within, left = place - cut[text], cut[text + 1] - place
        for size, columns in self.tables.items():
            starts = np.flatnonzero((within % size == 0) & (left >= size))
            if not len(starts):
                continue
            for h, (first, known, item, offset) in zip(sketches(words, starts, size), columns, strict=True):
                hit = np.flatnonzero(first[(h >> np.uint64(46)).astype(np.int64)])
                lo, hi = np.searchsorted(known, h[hit]), np.searchsorted(known, h[hit], "right")
                for w, a, b in zip(starts[hit[lo < hi]].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                    for k in range(a, b):
                        near.setdefault((int(text[w]), int(item[k])), set()).add(int(within[w] - offset[k]))
        return near

    def exact(self, words: np.ndarray, cut: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first word in the text) of the first place of each short item."""
        found: dict[tuple[int, int], int] = {}
        for size, (known, item) in self.short.items():
            if len(words) < size:
                continue
            h = _whole(words, size)
            place = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            text = np.searchsorted(cut, place, "right") - 1
            for p, t in zip(place.tolist(), text.tolist(), strict=True):
                if p + size > cut[t + 1]:
                    continue
                a, b = np.searchsorted(known, h[p]), np.searchsorted(known, h[p], "right")
                for i in item[a:b].tolist():
                    if (t, i) not in found and (self.rows[i][1] == words[p : p + size]).all():
                        found[t, i] = p - int(cut[t])
        return [(t, i, p) for (t, i), p in found.items()]

    def verified(self, item: int, words: np.ndarray, places: set[int]) -> tuple[int, int, int] | None:
        """(distance, first word, word behind) of the nearest passage around the places, if it is near enough."""
        own = self.rows[item][1]
        slack = int(MAX_EDITS * len(own))
        best, done = None, -(1 << 60)
        for p in sorted(places):
            if p <= done:
                continue
            # Places at most `slack` on are those of the same passages.
            a, b = max(0, p - slack), min(len(words), p + len(own) + 3 * slack + 1)
            done = p + slack
            part = words[a:b]
            # Each edit loses one word of the item at most.
            if np.isin(own, part).sum() < len(own) - slack:
                continue
            d, s, e = edit_passage(own, part)
            if d <= slack and (best is None or (d, s + a) < best[:2]):
                best = (d, s + a, e + a)
        return best


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, word_behind, first_byte, byte_behind), a row for each text and item that it leaks."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    # The query set comes in passes of bounded size.
    passes, now, size, hasher = [], [], 0, WordHasher(SPACE, characters=True)
    for r in items.orderBy("item_id", "text").toLocalIterator():
        now.append((r["item_id"], r["text"]))
        size += len(words_of(hasher, r["text"]))
        if size >= MAX_WINDOWS:
            passes.append(now)
            now, size = [], 0
    passes.append(now)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance long, item_words long, first_word long, word_behind long, first_byte long, byte_behind long"
    found = None
    for rows in passes:
        sent = spark.sparkContext.broadcast(Items(rows))
        one = docs.mapInArrow(_search(sent, schema), schema)
        found = one if found is None else found.union(one)
    return found


def _search(sent, schema: str):
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = sent.value, WordHasher(SPACE, characters=True)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, at in text_blocks(pc.utf8_lower(batch.column(1))):
                h, begin, end = hasher.words(data, at[:-1])
                cut = np.searchsorted(begin, at)
                out = []
                near = [((k, i), own.verified(i, h[cut[k] : cut[k + 1]], places)) for (k, i), places in own.proposals(h, cut).items()]
                near += [((k, i), (0, s, s + len(own.rows[i][1]))) for k, i, s in own.exact(h, cut)]
                for (k, i), m in sorted(near, key=lambda x: x[0]):
                    lo = cut[k]
                    if m:
                        d, s, e = m
                        out.append((a + k, own.rows[i][0], d, len(own.rows[i][1]), s, e, int(begin[lo + s] - at[k]), int(end[lo + e - 1] - at[k])))
                if out:
                    rows, *rest = zip(*out, strict=True)
                    arrays = [ids.take(pa.array(rows)), *(pa.array(x) for x in rest)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """docs without those that leak an item. A null id leaks nothing."""
    leaks = find_leaks(docs, items, doc_id, item_id, text).select("doc_id").distinct()
    return docs.join(leaks.withColumnRenamed("doc_id", "_leaking"), F.col(doc_id) == F.col("_leaking"), "left_anti")
