"""Cases in which text, items or rows were once lost, and bounds that once did not hold."""

import random
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("cistern.llm")

from cistern.llm import bpe, extract, leaks, near, shards, toxicity  # noqa: E402
from cistern.llm.queries import WORD_BPE  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


# --- 2

def long_texts(draw):
    n = 150_000
    han = "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(n))
    emoji = "".join(draw.choice("🙂👍🏽‍❤️🎉") for _ in range(n))
    marks = "".join(draw.choice("!?.,;'\"()-") for _ in range(n))
    return {
        "han": han, "emoji": emoji, "digits": "0123456789" * (n // 10), "marks": marks, "quotes": "'" * n, "its": "it's" * (n // 4),
        "special": "<|endoftext|>" * (n // 13), "mixed": "".join(draw.choice(["汉", "a", "'s", "é", "é", "7", "<|endoftext|>", "…", "'ll"]) for _ in range(n)),
        "hangul": "".join(chr(draw.randint(0x1100, 0x11F9)) for _ in range(n)),
    }


def test_what_the_encoder_holds_is_bounded():
    from tokenizers import Tokenizer

    library, v = Tokenizer.from_file(WORD_BPE), bpe.vocabulary_of(open(WORD_BPE).read())
    for name, text in long_texts(random.Random(5)).items():
        e, got, most = bpe.Encoder(v), [], 0
        for piece in bpe.pieces(text):
            got += e.feed(piece)
            most = max(most, len(e.held) + len(e.open))
        got += e.end()
        assert got == library.encode(text, add_special_tokens=False).ids, name
        if name != "hangul":  # runs of jamo have no border that composition can't move
            assert most <= bpe.PIECE + 2 * v.merges.ahead + 64, (name, most)


def test_caches_are_bounded_by_bytes(monkeypatch):
    v = bpe.Vocabulary(open(WORD_BPE).read())
    v.room = 5_000
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5_000)
    e = bpe.Encoder(v)
    for k in range(400):
        e.feed(f"word{k} ")
        assert len(v.cache) + len(v.parts) < 40


# --- 3

def test_sketches_tell_long_texts_apart():
    for n in (600, 3_000, 20_000):
        a, b = (np.unique(near.mix(np.arange(k * n, (k + 1) * n, dtype=np.uint64))) for k in (0, 1))
        half = np.unique(np.concatenate([a[: n // 2], b[n // 2 :]]))
        most = np.unique(np.concatenate([a[: 9 * n // 10], b[: n // 10]]))
        bits = {k: np.frombuffer(near._sketch(s), np.uint64)[None, :] for k, s in (("a", a), ("b", b), ("half", half), ("most", most))}
        linked = lambda k: bool(near._may_be_linked(bits["a"], np.array([n]), bits[k], np.array([n]))[0])
        assert linked("a") and linked("most") and not linked("b") and not linked("half"), n


def test_folded_sketches_are_those_of_the_smaller_size():
    s = near.mix(np.arange(900, dtype=np.uint64))
    whole = np.frombuffer(near._sketch(s), np.uint64)[None, :]
    size = whole.size * 64 // 2
    bits = np.zeros(size, np.uint8)
    bits[(near.mix(s) & np.uint64(size - 1)).astype(np.int64)] = 1
    assert (near._folded(whole, size) == np.packbits(bits, bitorder="little").view(np.uint64)).all()


def test_near_copies_of_long_texts(spark):
    draw = random.Random(8)
    base = [[f"w{draw.randint(0, 10**6)}" for _ in range(4_000)] for _ in range(2)]
    edited = lambda w, k: [x if i % k else "edit" for i, x in enumerate(w)]
    rows = [(1, base[0]), (2, base[1]), (3, edited(base[0], 60)), (4, edited(base[1], 400)), (5, edited(base[0], 8)), (6, base[0][:2_000] + base[1][:2_000])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 6}


# --- 5

def test_short_items_are_found_verbatim(spark):
    items = [(1, "What is the capital of France?"), (2, "42"), (3, "capital of"), (4, "the the the"), (5, "...")]
    docs = [(1, "WHAT is -- the capital\nof France, then"), (2, "what is the capital of Spain 42"), (3, "the the"), (4, "a the the the the b"), (5, "capital"), (6, None), (7, "of France what is the")]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING"))
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"], r["word_behind"]) for r in found.collect()}
    assert got == {(1, 1): (0, 0, 6), (1, 3): (0, 3, 5), (2, 2): (0, 6, 7), (2, 3): (0, 3, 5), (4, 4): (0, 1, 4)}


def test_items_in_scripts_without_spaces(spark):
    draw = random.Random(2)
    text = lambda n: "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(n))
    item, short, kana = text(40), text(4), "".join(chr(draw.randint(0x3041, 0x3096)) for _ in range(30))
    items = [(1, item), (2, short), (3, kana)]
    docs = [(1, text(100) + item + text(50)), (2, text(80) + item[:20] + "改" + item[21:] + text(9)), (3, "see " + short + "。"), (4, text(300)), (5, kana), (6, item[:18])]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING"))
    rows = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(rows) == {(1, 1), (2, 1), (3, 2), (5, 3)} and rows[1, 1]["distance"] == 0 and rows[2, 1]["distance"] == 1
    assert docs[0][1].encode()[rows[1, 1]["first_byte"] : rows[1, 1]["byte_behind"]].decode() == item


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_recall_of_edited_items(spark, share):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7)))
    items = [(k, [word() for _ in range(draw.randint(15, 60))]) for k in range(150)]
    docs = []
    for k, w in items:
        own = list(w)
        for at in draw.sample(range(len(own)), int(share * len(own))):
            own[at] = "changed"
        docs.append((k, " ".join([word() for _ in range(60)] + own + [word() for _ in range(60)])))
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id BIGINT, text STRING"))
    hits = {r["doc_id"] for r in found.collect() if r["doc_id"] == r["item_id"]}
    assert len(hits) >= (0.95 if share == 0.2 else 0.98) * len(items)


# --- 9

def runs(page):
    return [t for x in extract.parse(page) for _, t in x.own]


@pytest.mark.parametrize("page, want", [
    ('<p title="oops>Text', ["Text"]),
    ('<p title="oops>Text <b class="x">bold</b> end', ["Text bold end"]),
    ("<p title=it's>Text", ["Text"]),
    ('<p a="1>2" b=\'<x>\' c>in</p>', ["in"]),
    ('<p title="a"b>Text</p>', ["Text"]),
    ("<p>a<svg/>b<p>c<svg><path d='x'/></svg>d", ["ab", "cd"]),
    ("<p>a<svg><svg>in</svg>in</svg>b", ["ab"]),
    ("<p>a<iframe src=x />b<p>c", ["ab", "c"]),
    ("<p>a<iframe src=x>b<p>c<iframe>no</iframe>d", ["ab", "cd"]),
    ("<p>a<select><option>x<p>b", ["ax", "b"]),
    ("<p>a<script>if (x < 1) '</p>'<p>b", ["a"]),
    ("<p>a<style>p{}</style>b<textarea>c</textarea>d", ["abd"]),
])
def test_broken_markup_loses_no_text(page, want):
    assert runs(page) == want


def test_many_unclosed_elements_take_linear_time():
    page = "<p>word " + "<select><svg><noscript>x" * 20_000
    assert runs(page) and len("".join(runs(page))) > 20_000


def test_layouts_with_names_that_training_never_saw():
    draw, trees = random.Random(91), extract.model()
    names = {kind: [f"{a}{b}" for a in "qwz" for b in ("ux", "orf", "ilk")] for kind in extract.HINTS}
    right = total = 0
    for _ in range(120):
        nodes = extract.parse(extract.layout(draw, names))
        kept = extract.decode(nodes, trees.logits(extract.features(nodes)))
        for x, k in zip(nodes, kept, strict=True):
            for _, t in x.own:
                n = len(t.split())
                total += n
                right += n * (k == (t.split()[0][0] == "k"))
    assert right / total > 0.8, right / total


# --- 10

def test_pieces_and_tasks_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_BYTES", 4_000)
    df = spark.createDataFrame([(i, "x" * (i % 50) + str(i)) for i in range(3_000)], "doc_id BIGINT, text STRING")
    keys = df.select(shards._hash(df["text"]).alias("h"), df["doc_id"].alias("d"), shards.size_of(df["text"]).alias("size"))
    pieces, below, shard = shards.splitters(keys, 6)
    total = keys.agg({"size": "sum"}).first()[0]
    assert total / 4_000 <= len(pieces) <= 4 * total / 4_000 and sorted(set(shard)) == list(range(6))


# --- pipeline

def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    prose = " ".join(f"word{k % 37} and" for k in range(120))
    rows = [(1, prose, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, prose + " tail", "en", None, 1), (4, "x" * 50_000, "xx", "s", 1), (1, prose, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], DOCS + ", _score DOUBLE, kept BOOLEAN")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 <= out.count() <= len(rows) and stage(spark, docs.limit(0), SF).count() == 0, name


def test_copies_go_by_their_text(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    left = sorted(((r["doc_id"], r["text"][0]) for r in corpus_pipeline.without_copies(spark, docs, SF).collect()), key=str)
    assert left == [(1, "a"), (2, "b"), (4, "c"), (4, "c"), (None, "a")]


# --- 6

def plain_score(text, of, bias):
    """The mean of the numbers of a text's n-grams, one by one."""
    marked = [1] + [1 if ord(c) < 128 and not (c.isascii() and c.isalnum()) else ord(c) for c in (text or "").lower()] + [1]
    total, count = 0.0, 0
    for size in toxicity.SIZES:
        for at in range(len(marked) - size + 1):
            gram = marked[at : at + size]
            if at < len(marked) - 1 and 1 not in gram[1:-1]:
                h = 0
                for c in gram:
                    h = (h * int(toxicity._A) + c) % 2**64
                own = near.mix(np.array([(h + size) % 2**64], np.uint64))[0]
                total += float(of[int(own) % toxicity.BUCKETS])
                count += 1
    return 1 / (1 + np.exp(-(total / (count + toxicity.PRIOR) + bias)))


def test_scores_against_one_by_one():
    draw = np.random.default_rng(6)
    of = draw.normal(0, 40, toxicity.BUCKETS).astype(np.float32)
    texts = ["", None, " ", "a", "ab", "You ARE so-so!", "ünïcode wörds 日本語", "a b c d", "x" * 400, "tabs\tand\nlines", *("".join(draw.choice(list("ab é.!")) for _ in range(60)) for _ in range(30))]
    got = toxicity.scores(texts, of, -0.3)
    assert np.allclose(got, [plain_score(t, of, -0.3) for t in texts], rtol=1e-4, atol=1e-6)


def test_bags_hold_the_ngrams_of_one_text_at_a_time():
    draw = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) if c < 26 else " " for c in draw.integers(0, 30, 20_000).tolist()) for _ in range(200)]
    texts[7:10] = ["", None, " "]
    tracemalloc.start()
    sizes = [len(own) for own, _ in toxicity.bags(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[7:10] == [0, 0, 0] and min(sizes[:7] + sizes[10:]) > 1_000
    assert peak < 25e6  # all n-grams are 200 * 20,000 * 3 numbers of 4 bytes: 48 MB
    # The sample's bags, without rare n-grams, are those of the texts one by one.
    held = toxicity.Bags(texts)
    for row in (0, 8, 150, 199):
        own, share = next(iter(toxicity.bags([texts[row]])))
        keep = held.common[own]
        assert np.array_equal(held[row][0], own[keep]) and np.array_equal(held[row][1], share[keep])
