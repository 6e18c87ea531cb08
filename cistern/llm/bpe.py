"""BPE encoding and decoding as a transducer with bounded lookahead.

A merge list has a sufficient lookahead: where more text may follow, tokens that end that many symbols before the end of
what is known can't change any more (see `lookahead`). The encoder keeps no more of a word than that, emits tokens once
they are stable, and so needs constant memory for texts and words of any length. Words that end within the piece at hand
are encoded at once and kept in a bounded cache.

The decoder is a state machine from bytes to text: it takes the bytes of one token after the other and gives out text as
soon as characters are complete.

The tokenizer's file is a parameter; it is read once on the driver, checked to be of the supported kind and broadcast
(its size is that of the vocabulary). Null and empty texts have no tokens and decode to an empty text. Very long texts
and words are streamed. Rows are encoded one by one: ties and repeated rows don't matter, an empty table gives an empty
result, and other columns pass through `encode` (columns named like its results are replaced).
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from cistern.llm.frames import with_fields

#: What the tokenizer's file means by \s; Python's has four more.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_NOT_SPACES = regex.compile(r"[\x1c-\x1f]")
# Fixed value: the pattern of words in the tokenizer's file, with its meaning of \s.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(_WORDS.replace(r"\s", SPACES))
#: What words that may go on consist of.
_RUNS = {"L": regex.compile(r"[\p{L}]*"), "S": regex.compile(rf"[^{SPACES}\p{{L}}\p{{N}}]*")}
_KINDS = [("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(rf"[^{SPACES}]"))]
PIECE = 1 << 16
#: Bytes of the words that a Python worker remembers the tokens of, about; they are forgotten when there are more.
CACHE_BYTES = 96 << 20
_BITS = 24
_LOW, _NONE = (1 << _BITS) - 1, 1 << 62


@functools.lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may be composed with one before them: second parts of decompositions, and Hangul's vowels and ends."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    jamo = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in jamo}


@functools.lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    """L, N, S or Z: letter, digit, other sign or space, as the pattern sees it once it is small. Empty for characters that
    depend on what is beside them or change into others."""
    small = "σ" if c == "Σ" else c.lower()
    if unicodedata.combining(c) or c in _seconds() or len(small) > 1 or not unicodedata.is_normalized("NFC", c):
        return ""
    return next((kind for kind, of in _KINDS if of.match(small)), "Z")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary and its merges over token ids. end: what the last symbol of a word ends with."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        letters = byte_letters()
        self.first = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + end, -1) for c in letters]
        if -1 in self.first or -1 in self.last:
            raise ValueError("the vocabulary lacks a symbol of a byte")
        # Two ids in one number -> rank and new id in one number.
        self.pairs: dict[int, int] = {}
        self.names: list[tuple[str, str]] = []
        made = {t: -1 for t in (*letters, *(c + end for c in letters))}
        for rank, (a, b) in enumerate(merges):
            # Emitted tokens are stable only if no merge needs the result of a later one.
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} uses a token that isn't made before it")
            made.setdefault(a + b, rank)
            self.pairs.setdefault(vocab[a] << _BITS | vocab[b], rank + 1 << _BITS | vocab[a + b])
            self.names.append((a, b))
        self.ahead = lookahead(self.names, end)

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of a run of symbols: always the merge of lowest rank, the leftmost of equals."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.pairs.get, _NONE
        found = [get(a << _BITS | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = best & _LOW
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << _BITS | ids[i], none)
            if i < len(found):
                found[i] = get(ids[i] << _BITS | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for long runs."""
        n, pairs = len(ids), self.pairs
        ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := pairs.get(a << _BITS | b))]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get(ids[i] << _BITS | ids[j]) != best:
                continue
            ids[i], ids[j] = best & _LOW, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := pairs.get(ids[k] << _BITS | ids[after[k]])):
                    heapq.heappush(heap, (m, k))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        b = word.encode()
        ids = [self.first[x] for x in b]
        if b:
            ids[-1] = self.last[b[-1]]
        return self.merge(ids)


def lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols before an open end within which tokens may still change.

    Let w be what is known and wz the whole. Apply merges by rank to both. At first they agree on all of w. They begin to
    disagree left of a common token border only if at some rank a token x left of the border merges with a y right of it
    in one of the two; the border then moves left by x. The y that a later merge of another rank takes across the new
    border begins with x. So the border moves at most by the sum of |x| over a chain of merges of rising rank in which the
    x of each is a prefix of the y of the next; the largest such sum is the lookahead.
    """
    def size(t: str) -> int:
        return len(t.removesuffix(end) if end else t)

    best: dict[str, int] = {}
    most = 1
    for x, y in merges:
        reach = size(x) + max((best[y[:k]] for k in range(1, len(y) + 1) if y[:k] in best), default=0)
        best[x] = max(best.get(x, 0), reach)
        most = max(most, reach)
    return most


class Vocabulary:
    """What is needed of a tokenizer's file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"]:
            raise ValueError("a tokenizer of another kind")
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _WORDS}:
            raise ValueError("a tokenizer with another pattern of words")
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.cache: dict[str, list[int]] = {}
        self.parts: dict[str, list[int]] = {}
        self.room = CACHE_BYTES
        self.decoder = (spec["decoder"] or {}).get("type")
        # Without a decoder tokens are written as they are, with spaces between.
        back = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [bytes(back[c] for c in t) if self.decoder and all(c in back for c in t) else t.encode() for t in self.names]
        self.between = b"" if self.decoder else b" "
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def keep(self, cache: dict[str, list[int]], word: str, ids: list[int]) -> None:
        """Remembers a word's tokens; the two caches share one bound."""
        if len(word) >= 64:
            return
        # The word and the list as Python objects, and their place in the table.
        self.room -= 250 + 2 * len(word) + 8 * len(ids)
        if self.room < 0:
            self.cache.clear()
            self.parts.clear()
            self.room = CACHE_BYTES
        cache[word] = ids


@functools.lru_cache(maxsize=2)
def vocabulary_of(content: str) -> Vocabulary:
    """Kept, with its caches, for the tasks of a Python worker."""
    return Vocabulary(content)


class Encoder:
    """Tokens of a text that comes in pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.m, self.cache, self.parts = vocabulary, vocabulary.merges, vocabulary.cache, vocabulary.parts
        self.held = ""  # text whose words may go on
        self.open: list[int] = []  # symbols of a word that goes on
        self.kind = ""  # what the open word consists of: "L" letters, "S" other signs
        self.guard = max(map(len, vocabulary.special), default=1)

    def feed(self, text: str) -> list[int]:
        self.held += text
        if len(self.held) < self.guard:
            return []
        # Words, compositions and special tokens don't cross a space; where there is none for long, another border that
        # can't move is as good, or a place within a word, which then stays open.
        cut, goes_on = max(self.held.rfind(" "), self.held.rfind("\n")), ""
        if cut <= 0 and len(self.held) > PIECE:
            cut, goes_on = self._late_cut()
        if cut <= 0:
            return []
        ready, self.held = self.held[:cut], self.held[cut:]
        return self._run(ready, goes_on)

    def end(self) -> list[int]:
        ready, self.held = self.held, ""
        return self._run(ready, "")

    def _late_cut(self) -> tuple[int, str]:
        """(place, kind) at which the text may be cut: between characters that stay apart whatever comes, no special token
        near, or behind a special token. kind: "L" within letters, "S" within other signs, "" between words.

        0 if there is no such place in the latest half a piece, as within a letter that has thousands of marks.
        """
        held, n, special = self.held, len(self.held) - self.guard, self.v.cut
        if special:
            ends = [m.end() for m in special.finditer(held) if m.start() <= n]
            if ends and ends[-1] > n - PIECE // 2:
                return ends[-1], ""
        for i in range(n, max(2, n - PIECE // 2), -1):
            before, a, b = (_class(c) for c in held[i - 2 : i + 1])
            if not a or not b:
                continue
            if a == b == "L":
                # A contraction may end here.
                if "'" in held[i - 3 : i]:
                    continue
            elif a == "S" and b != "N" and held[i - 1] == "'" and before != "S":
                continue
            near = held[max(0, i - self.guard) : i + self.guard]
            if not (special and special.search(near)):
                return i, a if a == b and a in "LS" else ""
        return 0, ""

    def _run(self, text: str, goes_on: str) -> list[int]:
        if not self.v.cut or "<|" not in text:
            return self._plain(text, goes_on)
        out, at = [], 0
        for m in self.v.cut.finditer(text):
            out += self._plain(text[at : m.start()], "")
            out.append(self.v.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:], goes_on)

    def _plain(self, text: str, goes_on: str) -> list[int]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Small letters one by one: no rule for a sigma at a word's end.
        text = text.replace("Σ", "σ").lower()
        out: list[int] = []
        if self.open or goes_on:
            return self._open_words(text, goes_on)
        cache, words = self.cache, [text] if _NOT_SPACES.search(text) else text.split()
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self._words(w)
                self.v.keep(cache, w, ids)
            out += ids
        return out

    def _words(self, text: str) -> list[int]:
        out: list[int] = []
        for w in WORDS.findall(text):
            ids = self.parts.get(w)
            if ids is None:
                ids = self.m.word(w)
                self.v.keep(self.parts, w, ids)
            out += ids
        return out

    def _open_words(self, text: str, goes_on: str) -> list[int]:
        out: list[int] = []
        if self.open:
            run = _RUNS[self.kind].match(text)[0]
            self.open += [self.m.first[x] for x in run.encode()]
            text = text[len(run) :]
            if text or not goes_on:
                out += self._close()
            else:
                return self._stable()
        words = list(WORDS.finditer(text))
        # A contraction before a cut within letters is a word by itself, so the last word must be of the cut's kind.
        own = goes_on and words and words[-1].end() == len(text) and _RUNS[goes_on].fullmatch(words[-1][0])
        last = words.pop() if own else None
        for w in words:
            out += self.m.word(w[0])
        if last:
            self.open, self.kind = [self.m.first[x] for x in last[0].encode()], goes_on
            out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Tokens of the open word that can't change; what is behind them stays, as bytes."""
        keep, out, at = len(self.open) - self.m.ahead, [], 0
        if keep <= 0:
            return []
        for t in self.m.merge(list(self.open)):
            n = len(self.v.names[t])
            if at + n > keep:
                break
            out.append(t)
            at += n
        self.open = self.open[at:]
        return out

    def _close(self) -> list[int]:
        ids, self.open = self.open, []
        if not ids:
            return []
        letters = self.v.names[ids[-1]]
        ids[-1] = self.m.vocab[letters + self.m.end]
        return self.m.merge(ids)


class Decoder:
    """Text of tokens that come one after the other: characters are given out once their bytes are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        run = self.v.between.join(map(self.v.bytes.__getitem__, ids))
        run, self.begun = (self.v.between + run if self.begun else run), True
        return self.state.decode(run)

    def end(self) -> str:
        return self.state.decode(b"", True)


def pieces(text: str | None) -> Iterator[str]:
    for i in range(0, len(text or ""), PIECE):
        yield text[i : i + PIECE]


def tokens(vocabulary: Vocabulary, text: str | None) -> Iterator[list[int]]:
    """Runs of tokens of a text; of bounded length."""
    e = Encoder(vocabulary)
    for p in pieces(text):
        yield e.feed(p)
    yield e.end()


def _content(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        content = f.read()
    Vocabulary(content)  # complains here rather than in tasks
    return spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with token_ids (array<int>) and n_tokens (long)."""
    content = _content(docs.sparkSession, path)
    docs = docs.drop(*({"token_ids", "n_tokens"} & set(docs.columns) - {text}))
    place, names = docs.columns.index(text), docs.columns
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(content.value)
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                ids = [np.concatenate([np.array(r, np.int32) for r in tokens(v, t.as_py())]) for t in part.column(place)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, ids_type), pa.array([len(x) for x in ids], pa.int64())], [*names, "token_ids", "n_tokens"]
                )

    schema = with_fields(docs, token_ids=ArrayType(IntegerType()), n_tokens=LongType())
    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """coded with the text of its token ids (null: empty) in the column `text`."""
    content = _content(coded.sparkSession, path)
    coded = coded.drop(text)
    place, names = coded.columns.index(ids), coded.columns

    def of(v: Vocabulary, ids: list[int] | None) -> str:
        d = Decoder(v)
        return "".join([*(d.feed(ids[i : i + PIECE]) for i in range(0, len(ids or ()), PIECE)), d.end()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(content.value)
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = pa.array([of(v, x.as_py()) for x in part.column(place)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, text])

    return coded.mapInArrow(run, with_fields(coded, **{text: StringType()}))


#: Rows and characters after which a batch of `round_trip` is given out.
_ROWS, _CHARS = 64, 1 << 20


def round_trip(docs: DataFrame, path: str, text: str = "text", decoded: str = "decoded") -> DataFrame:
    """docs with token_ids, n_tokens, their decoded text, and same_count: whether that encodes to as many tokens again.

    One pass and one vocabulary for a Python worker: a row is encoded, decoded and encoded again before the next is read.
    """
    content = _content(docs.sparkSession, path)
    docs = docs.drop(*({"token_ids", "n_tokens", decoded, "same_count"} - {text}))
    place, names = docs.columns.index(text), docs.columns
    ids_type = pa.list_(pa.int32())

    def one(v: Vocabulary, own: str | None) -> tuple[np.ndarray, int, str, bool]:
        again, d, runs, back = Encoder(v), Decoder(v), [], []
        n = same = 0
        for run in tokens(v, own):
            runs.append(np.array(run, np.int32))
            n += len(run)
            back.append(d.feed(run))
            same += len(again.feed(back[-1]))
        back.append(d.end())
        same += len(again.feed(back[-1])) + len(again.end())
        return np.concatenate(runs), n, "".join(back), same == n

    def given(batch: pa.RecordBatch, a: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, n, back, same = zip(*rows, strict=True)
        added = [pa.array(ids, ids_type), pa.array(n, pa.int64()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.slice(a, len(rows)).columns, *added], [*names, "token_ids", "n_tokens", decoded, "same_count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(content.value)
        for batch in batches:
            rows, chars, a = [], 0, 0
            for i, t in enumerate(batch.column(place)):
                rows.append(one(v, t.as_py()))
                chars += len(rows[-1][2])
                if len(rows) >= _ROWS or chars >= _CHARS or i + 1 == len(batch):
                    yield given(batch, a, rows)
                    rows, chars, a = [], 0, i + 1

    kinds = {"token_ids": ArrayType(IntegerType()), "n_tokens": LongType(), decoded: StringType(), "same_count": BooleanType()}
    return docs.mapInArrow(run, with_fields(docs, **kinds))


def transcode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: tokens are decoded and hashed as they come.

    ids_sha256: of the ids as little-endian unsigned 32-bit integers; decoded_sha256: of the decoded text in UTF-8.
    """
    content = _content(docs.sparkSession, path)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def one(v: Vocabulary, text: str | None) -> tuple[int, str, str]:
        n, ids_hash, text_hash, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
        for run in tokens(v, text):
            n += len(run)
            ids_hash.update(np.array(run, "<u4").tobytes())
            text_hash.update(d.feed(run).encode())
        text_hash.update(d.end().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(content.value)
        for batch in batches:
            rows = [one(v, t.as_py()) for t in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
