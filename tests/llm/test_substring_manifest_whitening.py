"""Operators 11 to 13 against brute-force versions and SQL, and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("cistern.llm")

from cistern.llm import fmindex, manifest, substring, whitening  # noqa: E402
from cistern.llm.queries import CHECKS, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11

def brute_repeats(rows):
    first, out = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def repeating_rows(draw):
    word = lambda: "".join(draw.choice("abcdeé日") for _ in range(draw.randint(1, 3)))
    passages = [[word() for _ in range(draw.randint(10, 60))] for _ in range(6)]
    rows = [(None, "n " * 30), (None, "n " * 30), (1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "x" * 70_000)]
    rows += [(6, "the cat sat " * 900), (7, "the cat sat " * 40), (8, "z " * 2_000), (9, "z " * 14), (9, "z " * 14), (9, "z " * 13 + "y")]
    rows += [(10, "q " * 12), (11, "q " * 12), (12, "q " * 13), (13, "q " * 13), (13, "Q " * 13)]
    for n in range(120):
        w = [word() for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(w))
            own = list(draw.choice(passages))
            if draw.random() < 0.5:
                own = own[draw.randint(0, len(own)) :][: draw.randint(1, 30)]
            if own and draw.random() < 0.3:
                own[draw.randrange(len(own))] = "edited"
            w[at:at] = own
        rows.append((draw.randint(20, 110), draw.choice([" ", "\n", "\x0b \t"]).join(w)))
    return rows


@pytest.mark.parametrize("hot", [None, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    rows = repeating_rows(random.Random(7))
    if hot:  # nearly all shared keys are frequent
        monkeypatch.setattr(substring, "HOT", hot)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id BIGINT, text STRING, kept INT").repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.without_repeats(df).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeats_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op11_substrings"](spark, SF).collect()), key=str)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_repeats(rows)), key=str)


def test_repeats_in_sql():
    rows = repeating_rows(random.Random(11))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_repeats(rows)]
    assert sorted(con.execute(CHECKS["op11_substrings"]).fetchall(), key=str) == sorted(want, key=str)


def test_repeats_of_no_rows(spark):
    assert substring.removed_rows(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0
    nulls = spark.createDataFrame([(None, None)], "doc_id BIGINT, text STRING")
    assert [tuple(r) for r in substring.removed_rows(nulls).collect()] == [(None, 0, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("depth", [1, 3, 5, 13])
def test_matching_statistics_against_brute_force(depth):
    draw = np.random.default_rng(depth)
    for _ in range(30):
        alphabet = int(draw.integers(2, 6))
        kept = [draw.integers(1, alphabet, draw.integers(1, 25)) for _ in range(draw.integers(1, 6))]
        marks = draw.integers(0, 50, len(kept))
        symbols = np.concatenate([np.append(k, 0) for k in kept])
        index = fmindex.Index(symbols, np.repeat(marks, [len(k) + 1 for k in kept]), alphabet + 1, depth)
        streamed = [draw.integers(1, alphabet + 1, draw.integers(1, 25)) for _ in range(4)]
        end = np.cumsum([len(x) for x in streamed])
        length, mark = index.statistics(np.concatenate(streamed), end - [len(x) for x in streamed], end)
        at = 0
        for x in streamed:
            for i in range(len(x)):
                best, least = 0, None
                for n in range(1, min(depth, len(x) - i) + 1):
                    hits = [m for k, m in zip(kept, marks, strict=True) if any((k[j : j + n] == x[i : i + n]).all() for j in range(len(k) - n + 1))]
                    if not hits:
                        break
                    best, least = n, min(hits)
                assert length[at] == best
                assert mark[at] == (least if best == depth else -1)
                at += 1


def test_ranks_of_a_wavelet():
    draw = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        x = draw.integers(0, 9, size)
        at = np.arange(size + 1)
        w = fmindex.Wavelet(x, 9)
        for c in range(9):
            assert (w.rank(np.full(size + 1, c), at) == np.concatenate([[0], np.cumsum(x == c)])).all()


# --- 12

def brute_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(r, more=0):
        values = [*r[:3], None if r[3] is None else r[3] + more, r[4]]
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes, paths):
        """(root, each node's siblings with their side) of one tree."""
        place = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(place):
                run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
                paths[k].append([(x, j < i % 2) for j, x in enumerate(run) if j != i % 2])
            place = [i // 2 for i in place]
            nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        return nodes[0]

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths = [[] for _ in own]
        trees.append((own, paths, climb([leaf(r) for r in own], paths)))
    upper = [[] for _ in trees]
    root = climb([t[2] for t in trees], upper)
    for (own, paths, subroot), up in zip(trees, upper, strict=True):
        for r, p in zip(own, paths, strict=True):
            turned = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if turned else 0)
            for step in p + up:
                node = h("".join([x for x, left in step if left] + [node] + [x for x, left in step if not left]))
            proof = h("".join(x for step in p + up for x, _ in step))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


DOCS = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


@pytest.mark.parametrize("most", [1, 2, 3, 12])
def test_manifest_against_brute_force(spark, most):
    draw = random.Random(most)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", None, ""), (3, "s", "en", None, ""), (3, "s", "en", 4, "é日")]
    rows += [(i, draw.choice(["a", "b:", None]), draw.choice(["en", "en", "en", "de", "Ä", "", None, f"x{i % 9}"]), draw.randint(0, 9), "t" * (i % 4)) for i in range(-3, 140)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("none", "leaf").repartition(3)
    got = manifest.manifest_rows(df, most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest.manifest_rows(spark.createDataFrame([], DOCS)).count() == 0
    one = [(1, None, "en", 2, "x")]
    assert [tuple(r) for r in manifest.manifest_rows(spark.createDataFrame(one, DOCS)).collect()] == brute_manifest(one)


def test_positions_in_a_log():
    for n in range(1, 70):
        leaves = [f"{i:064x}" for i in range(n)]
        log, nodes, height = manifest.append_log(leaves, manifest.height_of(n)), leaves, 0
        while True:
            for i, x in enumerate(nodes):
                assert log[manifest.position(n, height, i)] == x
            if len(nodes) == 1:
                break
            nodes, height = [manifest.hashed(nodes[i : i + 2]) for i in range(0, len(nodes), 2)], height + 1
        assert log[-1] == nodes[0]


def test_manifest_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(CHECKS["op12_manifest"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op12_manifest"](spark, SF).collect()) == want


# --- 13

def close_matrix(draw, values):
    q = np.linalg.qr(draw.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(9, 1, 30),
    [5.0, 5.0, 5.0, 2.0, 1.0],
    [5, 5 * (1 - 1e-9), 5 * (1 - 2e-9), 3, 3 * (1 - 1e-12), 1, *np.linspace(0.9, 0.1, 20)],
    [1e6, 1, 1e-6],
    [0.0, 0.0],
])
def test_refined_eigenvectors(values):
    values = np.array(values, float)
    a = close_matrix(np.random.default_rng(2), values)
    e, x = whitening.eigenvectors(a)
    size = max(abs(values).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * e).max() < 1e-14 * size
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * size


def test_refinement_beats_single_precision():
    a = close_matrix(np.random.default_rng(4), np.linspace(2, 1, 64))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    e, y = whitening.eigenvectors(a)
    assert np.abs(a @ x - x * np.diag(x.T @ a @ x)).max() > 1e-8 > 1e-13 > np.abs(a @ y - y * e).max()


def brute_whitened(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return ((n * x - s) ** 2).sum(1), c @ v[:, :components] / np.sqrt(e[:components]), e / e.sum()


def test_whitening_against_brute_force(spark):
    draw = np.random.default_rng(3)
    good = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(300)] + [(0, [0.5] * 12), (None, [0.25] * 12)]
    odd = [(900, None), (901, []), (902, [1.0] * 11), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] * 12), (905, [None] + [1.0] * 11), (906, [3e38] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id BIGINT, embedding ARRAY<FLOAT>, component INT").repartition(4)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 * len(good)
    deviation, z, shares = brute_whitened([v for _, v in good])
    have = {}
    for r in rows:
        have.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    sign = None
    for (i, _), d, own in zip(good, deviation.tolist(), z, strict=True):
        got = np.array([have[i, d][k]["whitened"] for k in range(1, 9)])
        sign = np.sign(got * own) if sign is None else sign
        assert np.abs(got - sign * own).max() < 1e-10
    for r in rows[:16]:
        assert r["n"] == len(good) and r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-10


def test_whitening_without_variance(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in flat if r["whitened"] is not None) == [(1, 1), (2, 1)]
    assert {round(abs(r["whitened"]), 12) for r in flat if r["whitened"] is not None} == {1.0}


def test_exact_sums_beyond_doubles(spark):
    rows = [(i, [float(2**30 + i), float(-(2**31) + 3 * i), 1.0 / 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    n, sums, products = whitening.moments(df)
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    assert n == 40 and sums == [sum(v[k] for v in x) for k in range(3)]
    assert products == [[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x) // n for j in range(3)] for i in range(3)]
