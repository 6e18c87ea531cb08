"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd rows."""

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("cistern.llm")

from cistern.llm import bpe, counts, extract, leaks, near, quality, shards, tokenids, toxicity, warc  # noqa: E402
from cistern.llm.queries import BYTE_BPE, QUERIES, WORD_BPE  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
ODD = ["", None, " \n\t", "one", "a b c d", "x" * 70_000, "the cat sat on the mat " * 400, "Ünïcode É é ¡ 日本語 🙂", "\x00\x01 a\x1cb", "<|endoftext|>", "a\r\nb\r\n\r\nWARC/1.1\r\n\r\n"]


def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns that clash with results."""
    rows = [(i, t, None if i % 3 == 0 else "en", None, None) for i, t in enumerate(ODD + ["a b c d e f g"] * 3)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# --- 1

def test_archives_against_brute_force(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}\nx" if i % 4 else None, t, 1) for i, t in enumerate(ODD * 2 + ["same"] * 9)], "page_id BIGINT, url STRING, html STRING, refers_to INT")
    got = {r["page_id"]: r for r in warc.archived(pages).collect()}
    first = {}
    for r in sorted(pages.collect(), key=lambda r: r["page_id"]):
        own = (r["html"] or "").encode()
        want = base64.b32encode(hashlib.sha1(own).digest()).decode()
        g = got[r["page_id"]]
        o = first.setdefault(own, r["page_id"])
        assert (g["payload_bytes"], g["payload_digest"]) == (len(own), want)
        assert (g["record_type"], g["refers_to"]) == (("response", None) if o == r["page_id"] else ("revisit", o))
    assert len(got) == pages.count()
    warc.write_archives(pages, str(tmp_path / "a"))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    again = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert again == {i: r["record_type"] for i, r in got.items()}
    assert warc.archived(pages.limit(0)).count() == 0
    least = warc.archived(pages, min_bytes=1).where("payload_bytes = 0 and record_type = 'revisit'")
    assert least.count() == 0


# --- 2

def test_transducer_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    v = bpe.vocabulary_of(open(WORD_BPE).read())
    draw = random.Random(4)
    texts = [*ODD, "the" * 70_000, "é" * 70_000, "Aa" * 70_000 + "<|endoftext|>z", "ΣΑΣ ΟΔΟΣ İ", "it's we'll ''s 4½ ⅷ", "<|START<|endoftext|"]
    texts += ["".join(draw.choice("aeth<|>' .\n1é́ΣIso—½$") for _ in range(draw.randint(1, 80))) for _ in range(100)]
    texts += ["".join(draw.choice("aethorinsd") for _ in range(150_000)) for _ in range(3)]
    for x in texts:
        want = t.encode(x or "", add_special_tokens=False).ids
        got = [i for run in bpe.tokens(v, x) for i in run]
        assert got == want, (x or "")[:60]
        d = bpe.Decoder(v)
        assert "".join([d.feed(got[:5]), d.feed(got[5:]), d.end()]) == t.decode(want, skip_special_tokens=False)


def test_lookahead_suffices():
    """Tokens that the lookahead calls stable never change, for small random merge lists and all continuations."""
    draw = random.Random(8)
    for _ in range(40):
        merges, made = [], ["a", "b", "c"]
        for _ in range(draw.randint(1, 8)):
            m = (draw.choice(made), draw.choice(made))
            if m[0] + m[1] not in made:
                merges.append(m)
                made.append(m[0] + m[1])
        ahead = bpe.lookahead(merges)

        def tokens(s, merges=merges):
            out = list(s)
            for a, b in merges:
                i, new = 0, []
                while i < len(out):
                    if out[i : i + 2] == [a, b]:
                        new.append(a + b)
                        i += 2
                    else:
                        new.append(out[i])
                        i += 1
                out = new
            return out

        for _ in range(60):
            s = "".join(draw.choice("abc") for _ in range(draw.randint(1, 24)))
            known = tokens(s)
            for _ in range(4):
                more = tokens(s + "".join(draw.choice("abc") for _ in range(draw.randint(1, 10))))
                at = 0
                for k, x in enumerate(known):
                    at += len(x)
                    if at > len(s) - ahead:
                        break
                    assert more[k] == x


def test_encoded_frames(spark):
    coded = bpe.encode(odd_docs(spark), WORD_BPE)
    rows = coded.collect()
    assert len(rows) == len(ODD) + 3 and all(len(r["token_ids"]) == r["n_tokens"] for r in rows)
    assert bpe.decode(coded, WORD_BPE).count() == len(rows)
    hashes = {r["doc_id"]: r for r in bpe.transcode(odd_docs(spark), WORD_BPE).collect()}
    for r in rows:
        assert hashes[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(r["token_ids"], "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty_docs(spark), WORD_BPE).count() == bpe.transcode(empty_docs(spark), WORD_BPE).count() == 0


# --- 3

def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    draw = random.Random(2)
    base = [[f"w{draw.randint(0, 5000)}" for _ in range(60)] for _ in range(6)]
    rows = list(enumerate(ODD + ["a b c d", "A b C d"]))
    shared = [f"s{k}" for k in range(40)]
    for n in range(120):
        w = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            w[draw.randint(0, 59)] = f"x{draw.randint(0, 9)}"
        if n % 4 == 0:  # many texts that share a passage and are no copies
            w = shared + [f"u{n}_{k}" for k in range(draw.randint(8, 40))]
        rows.append((100 + n, " ".join(w)))
    return rows


def test_near_copies_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_copies(df).collect()}
    assert got == brute_components(rows)
    assert near.near_copies(df.limit(0)).count() == 0


def edited_rows(draw):
    """A group without its original: chains of edits that drift, so most members are near only a few others."""
    base = [f"w{k}" for k in range(160)]
    rows, chain = [], [base, base, base]
    for n in range(210):
        w = list(chain[n % 3])
        at = draw.randint(0, 150)
        w[at : at + 2] = [f"x{n}", f"y{n}"]
        chain[n % 3] = w
        rows.append((n, " ".join(w)))
    keep = set(draw.sample(range(210), 150))
    return [r for r in rows if r[0] in keep]


def test_near_copies_of_drifting_edits_lose_no_link_of_a_bucket(spark, monkeypatch):
    rows = edited_rows(random.Random(3))
    # All texts share a bucket, so that every pair has to be compared; blocks are small, so that there are several.
    monkeypatch.setattr(near, "BLOCK", 16, raising=False)
    shared = spark.createDataFrame([(1, i, len(set(zip(*(t.split()[k:] for k in range(5))))), i) for i, t in rows], "key BIGINT, rep BIGINT, n BIGINT, around BIGINT")
    sets = near.stage(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").mapInArrow(near._sets, "doc_id BIGINT, shingles array<long>"), "sets")
    pairs = near.stage(near._pairs(near._stars(shared)), "pairs")
    roots = near.components(near.stage(near._confirmed(pairs, sets), "confirmed"))
    found = {r["node"]: r["root"] for r in near._searched_on(shared, roots, pairs.select("a", "b"), sets).collect()}
    want = {i: root for i, (_, root) in brute_components(rows).items()}
    assert {i: found.get(i, i) for i in want} == want
    assert len({r["root"] for r in roots.collect()}) + len(want) - roots.count() > len(set(want.values()))


def test_near_copies_hidden_behind_unlike_centres(spark):
    rows = [(i, " ".join(f"u{i}_{k}" for k in range(44))) for i in range(20)]
    rows += [(90, " ".join(f"w{k}" for k in range(44))), (91, " ".join(f"w{k}" for k in range(45)))]
    n = {i: len(t.split()) - 4 for i, t in rows}
    shared = spark.createDataFrame([(1, i, n[i], 100 - i) for i, _ in rows], "key BIGINT, rep BIGINT, n BIGINT, around BIGINT")
    sets = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").mapInArrow(near._sets, "doc_id BIGINT, shingles array<long>")
    none = spark.createDataFrame([], "node BIGINT, root BIGINT")
    tested = spark.createDataFrame([], "a BIGINT, b BIGINT")
    found = near._searched_on(shared, none, tested, sets).collect()
    assert [(r["node"], r["root"]) for r in found] == [(91, 90)]


def test_null_ids_stand_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")], "doc_id BIGINT, text STRING")
    got = near.near_copies(df).collect()
    assert sorted((str(r["component_id"]), r["kept"]) for r in got) == [("1", True), ("None", True), ("None", True)]


# --- 4

def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    docs = odd_docs(spark)
    at, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.token_file_rows(docs, BYTE_BPE).collect()}
    assert got == want
    assert tokenids.token_file_rows(docs.limit(0), BYTE_BPE).count() == 0
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    tokenids.write_file(str(tmp_path / "x.dac"), np.arange(2), np.array([0, 1234, 5000]), ids)
    f = tokenids.TokenFile(str(tmp_path / "x.dac"))
    assert [f.token(k) for k in range(0, 5000, 37)] == ids[::37].tolist()
    assert (f.document(1) == ids[1234:]).all()


# --- 5

def test_leaks_against_brute_force(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(draw.randint(8, 60)))) for k in range(30)] + [(90, None), (91, "too short")]
    docs, want = [], set()
    for n in range(120):
        w = [word() for _ in range(draw.randint(0, 200))]
        if n % 2:
            k, t = items[draw.randrange(30)]
            own = t.split()
            if n % 4 == 3 and len(own) >= 20:
                own[len(own) // 2] = "changed"
            w[draw.randint(0, len(w)) : 0] = own
            want.add((n, k))
        docs.append((n, draw.choice([" ", "\n"]).join(w).upper()))
    docs += [(500 + i, t) for i, t in enumerate(ODD)]
    d, b = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, b).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert leaks.clean(d, b).count() == len(docs) - len({i for i, _ in got})
    assert leaks.find_leaks(d.limit(0), b).count() == 0 and leaks.find_leaks(d, b.limit(0)).count() == 0


def test_edit_passage_against_brute_force():
    draw = np.random.default_rng(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    for _ in range(60):
        item, text = draw.integers(0, 4, draw.integers(1, 7)), draw.integers(0, 4, draw.integers(1, 12))
        d, s, e = leaks.edit_passage(item, text)
        assert d == min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert d == distance(item, text[s:e])


# --- 6

def test_toxicity_of_held_out_texts():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice(["an", "er", "th", "in", "on", "es"]) for _ in range(draw.randint(1, 4)))

    def text(bad):
        w = [word() for _ in range(draw.randint(40, 200))]
        if bad:
            for k in range(0, len(w), 15):
                w[k] = bad
        return " ".join(w)

    train = [(text(None), 0) for _ in range(200)] + [(text("zumpkrak"), 1) for _ in range(60)]
    of, bias = toxicity.train([t for t, _ in train], [y for _, y in train], [1.0] * len(train))
    clean = toxicity.scores([text(None) for _ in range(50)], of, bias)
    bad = toxicity.scores([text(b) for b in ("zumpkrak", "Zumpkrak!", "zumpkrakk", "xzumpkrak") for _ in range(10)], of, bias)
    assert (clean < 0.5).mean() > 0.95 and (bad > 0.5).mean() > 0.95
    odd = toxicity.scores(ODD, of, bias)
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1]
    _, none = toxicity.train([], [], [])
    assert 0 < 1 / (1 + np.exp(-none)) < 1


def test_toxicity_frames(spark):
    model = (np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    assert toxicity.score(odd_docs(spark), model, result="n_chars").count() == len(ODD) + 3
    assert toxicity.score(empty_docs(spark), model).count() == 0
    docs = odd_docs(spark)
    assert toxicity.sample(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id BIGINT, toxic INT"), "toxic", "doc_id", "text") == ([], [], [])


# --- 7

def test_token_counts_against_brute_force(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    docs = odd_docs(spark)
    own = collections.defaultdict(list)
    for r in docs.collect():
        own[r["lang"]].append(len(t.encode(r["text"] or "", add_special_tokens=False).ids))
    rows = counts.token_counts(docs, BYTE_BPE, groups=("lang",))
    for r in rows.collect():
        n, L = own[r["lang"]], r["n_tokens"]
        assert r["n_docs"] == n.count(L) and r["docs"] == len(n) and r["tokens"] == sum(n)
        assert r["docs_from"] == sum(x >= L for x in n) and r["tokens_from"] == sum(x for x in n if x >= L)
        assert r["tokens_cut"] == sum(min(x, L) for x in n) and r["tokens_lost"] == sum(n) - r["tokens_cut"]
        assert r["quantile"] == sum(x <= L for x in n) / len(n)
    assert rows.count() == sum(len(set(n)) for n in own.values())
    for r in counts.limits(rows, spark.createDataFrame([(3,), (1000,)], "max_tokens BIGINT"), ("lang",)).collect():
        assert r["tokens_left"] == sum(min(x, r["max_tokens"]) for x in own[r["lang"]])
    assert counts.token_counts(docs.limit(0), BYTE_BPE).count() == 0


def test_limits_above_the_longest_document(spark):
    rows = counts.with_suffixes(spark.createDataFrame([("en", 3, 2), ("en", 9, 1), (None, 4, 1)], "lang STRING, n_tokens BIGINT, n_docs BIGINT"), ("lang",))
    at = spark.createDataFrame([(3,), (9,), (1000,)], "max_tokens BIGINT")
    got = {(r["lang"], r["max_tokens"]): tuple(r)[2:] for r in counts.limits(rows, at, ("lang",)).collect()}
    assert got == {
        ("en", 3): (1, 9, 6), ("en", 9): (0, 15, 0), ("en", 1000): (0, 15, 0),
        (None, 3): (1, 3, 1), (None, 9): (0, 4, 0), (None, 1000): (0, 4, 0),
    }


# --- 8

def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_quality_base_against_brute_force(spark):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(["a ", "b ", "c\n", "# ", "\n"]) for _ in range(draw.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING")
    for r in quality.quality_rules(df).collect():
        want = brute_base(r["text"])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(df.limit(0)).count() == 0
    assert quality.quality_rules(odd_docs(spark).withColumnRenamed("source", "kept")).count() == len(ODD) + 3


def test_quality_distance(spark):
    def distance(a, b):
        p, q = np.array(a, float) / sum(a), np.array(b, float) / sum(b)
        m = (p + q) / 2
        kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
        return np.sqrt((kl(p) + kl(q)) / 2)

    df = spark.createDataFrame([([3.0, 0.0, 1.0],), ([0.0, 0.0, 0.0],)], "c ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(quality._distance(df["c"], [1.0, 5.0, 2.0])).collect()]
    assert got[0] == pytest.approx(distance([3, 0, 1], [1, 5, 2])) and got[1] is None


# --- 9

def test_extraction_of_held_out_layouts():
    draw, trees = random.Random(77), extract.model()
    right = 0
    for _ in range(150):
        page = extract.layout(draw)
        got = extract.main_text(page, trees).split()
        want = [w for r in extract.parse(page) for _, t in r.own for w in t.split() if w[0] == "k"]
        right += sorted(got) == sorted(want)
    assert right >= 140


def test_extraction_of_pages(spark):
    page = "<html><body><nav><a href='/'>home</a></nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p>One\n  two<br>three.<p>Four <b>five</b> &copy; six.<script>x</script></article><footer>end</footer>"
    assert extract.main_text(page, extract.model()) == "A & B\nOne two three.\nFour five © six."
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate([page, None, "", "<", "<p", "</div>" * 50, "<div>" * 3000 + "deep"])], "page_id INT, url STRING, html STRING, text STRING")
    rows = extract.extract(df).collect()
    assert len(rows) == 7 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract.extract(df.limit(0)).count() == 0


def test_decoding_is_the_likeliest():
    nodes = extract.parse("<div><p>a</p><p>b</p></div><section><p>c</p></section>")
    draw = np.random.default_rng(2)
    index = {id(x): i for i, x in enumerate(nodes)}
    up = [index[id(x.parent)] if x.parent else None for x in nodes]
    for _ in range(50):
        z = draw.normal(0, 2, len(nodes))
        best = max(
            sum(z[i] for i in range(len(nodes)) if m >> i & 1)
            for m in range(1 << len(nodes))
            if all(not m >> i & 1 or up[i] is None or m >> up[i] & 1 for i in range(len(nodes)))
        )
        assert z[extract.decode(nodes, z)].sum() == pytest.approx(best)


# --- 10

@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    draw = random.Random(5)
    rows = [(i, "copy of a text" * 3 if hot and i % 3 else "".join(draw.choice("abcdé") for _ in range(draw.randint(0, 60)))) for i in range(4000)]
    rows += [(None, "x"), (10_000, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = shards.sharded_rows(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) < 3 * max(r["size"] for r in got) + 0.01 * max(sizes)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    text = dict(rows)
    for r in got:
        own = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 8, zlib.crc32(own), "bytes", None)
    assert shards.sharded_rows(df.limit(0)).count() == 0


# --- pipeline

def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    all_rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(all_rows)
    score = dict(zip(ids, toxicity.scores([all_rows[i] for i in ids], *model), strict=True))
    left = {i for i in ids if score[i] < toxicity.THRESHOLD}
    tame = docs.where(docs["doc_id"].isin(*left))
    left = {r["doc_id"] for r in quality.quality_rules(tame).where("kept").collect()}
    comp = brute_components([(i, all_rows[i]) for i in sorted(left)])
    left = {i for i in left if comp[i][1] == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', html.unescape(t).lower()))} "
    left = {i for i in left if not any(plain(x) in plain(all_rows[i]) for x in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == left
    v = bpe.vocabulary_of(open(WORD_BPE).read())
    for r in got[:20]:
        assert r["token_ids"] == [i for run in bpe.tokens(v, r["text"]) for i in run]


def test_last_stage_decodes(spark):
    import corpus_pipeline

    got = corpus_pipeline.with_tokens(spark, odd_docs(spark), SF).collect()
    want = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd_docs(spark), WORD_BPE), WORD_BPE).collect()}
    assert {r["doc_id"]: r["decoded"] for r in got} == want
    v = bpe.vocabulary_of(open(WORD_BPE).read())
    for r in got:
        assert r["n_tokens"] == len(r["token_ids"])
        assert r["same_count"] == (sum(len(run) for run in bpe.tokens(v, r["decoded"])) == r["n_tokens"])


@pytest.mark.parametrize("name", ["op5_leaks", "op6_toxicity", "op9_extract"])
def test_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
