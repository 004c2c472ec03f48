"""Periodic runs, packing and whitening against brute force, round trips and numpy,
with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""
import collections
import hashlib
import random
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wharf.llm import charpoly, packing, periodic_runs, queries, whitening

SCHEMA = "doc_id long, text string, runs string, strongest string, length long, ids string, part int, rank long"


# --------------------------------------------------------------------------- periodic runs

def _runs(w):
    """Every maximal stretch of every period, smallest periods only."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length >= max(6, 4 * q) and not any(
                    all(w[s + i] == w[s + i + p] for i in range(length - p)) for p in range(1, q)):
                out.add((s, length, q))
            s = max(e, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(i, text):
    w = (text or "").encode().split()
    if i is None:
        return w
    h = zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
    return w


def _digests(i, text):
    w = _planted(i, text)
    runs, gone = _runs(w), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 3, 6, 10, 30, 80])
            d = [rng.choice([b"a", b"b", b"c", b"d"][:rng.randint(1, 4)]) for _ in range(n)]
            if d and rng.random() < .6:
                u = d[:rng.randint(1, 6)]
                d = d[:rng.randint(0, n)] + u * rng.randint(2, 9) + u[:rng.randint(0, len(u))] + d[rng.randint(0, n):]
            docs.append(d)
        assert periodic_runs.runs_of(docs) == [_runs(d) for d in docs], docs


def test_nested_and_touching_runs():
    fib = [b"a", b"ab"]
    for _ in range(12):
        fib.append(fib[-1] + fib[-2])
    docs = [[bytes([c]) for c in fib[-1]], [b"x"] * 500, ([b"a", b"b"] * 4 + [b"c"]) * 5, [b"a"] * 6 + [b"b"] * 6 + [b"a"] * 5]
    assert periodic_runs.runs_of(docs) == [_runs(d) for d in docs]


@pytest.mark.parametrize("chunk", [periodic_runs.CHUNK_WORDS, 50])
def test_periodic_runs_query(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", chunk)
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(30)] + ["Été", "日本"]
    made = [(i, "  ".join(rng.choices(vocab, k=rng.randint(1, 90)))) for i in range(150)]
    made += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "a " * 30), (1003, "ja\nja\tja ja  ja ja nein"),
             (1004, "p q r " * 4000), (1005, "no break no break " * 5)]
    made += made[:2] + made[-1:]
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in made], SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(_digests(*r) for r in made)
    assert sum(r.n_runs > 0 for r in got) > 8
    assert periodic_runs.find_periodic_runs(docs.limit(0)).count() == 0


# --------------------------------------------------------------------------- packing

def test_nnls_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(0, 3, (rng.integers(2, 9), rng.integers(1, 15))).astype(float)
        b = rng.integers(0, 50, len(a)).astype(float)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert x.min() >= 0 and gain.max() < 1e-6 and abs(gain[x > 1e-7]).max(initial=0) < 1e-6


def test_combinations_filling():
    lengths = [3, 4, 5, 8, 9, 12, 16]
    from itertools import combinations_with_replacement as multi
    want = {c for k in (2, 3, 4) for c in multi(lengths, k) if sum(c) == 20}
    got = packing.combinations_filling(lengths, 20)
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("max_gap", [0, 5])
def test_plan_uses_every_piece(max_gap):
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 64, 5000), rng.integers(40, 64, 300), rng.integers(1, 9, 700), rng.integers(1, 64, 3), []):
        have = collections.Counter(int(v) for v in sizes)
        patterns, loose = packing.make_plan(dict(have), 64, max_gap, 16)
        used = collections.Counter(loose)
        for lengths, n in patterns:
            assert n > 0 and 64 - max_gap <= sum(lengths) <= 64
            for v in lengths:
                used[v] += n
        assert used == have
        places = packing.Places(patterns, loose, 64)
        filled = collections.defaultdict(list)
        for v, n in have.items():
            s, o, laid = places.find(np.full(n, v), np.arange(n))
            for k in range(n):
                parts = list(places.cut(int(o[k]), v)) if laid[k] else [(0, v, int(s[k]), int(o[k]))]
                assert sum(p[1] for p in parts) == v
                for _, size, seq, off in parts:
                    filled[seq].append((off, size))
        for parts in filled.values():
            at = 0
            for off, size in sorted(parts):
                assert off == at
                at += size
            assert 64 - max_gap <= at <= 64 or at.bit_count() == 1
        assert set(filled) == set(range(places.sequences))


@pytest.mark.parametrize("window, name", [(packing.WINDOW, "word_bpe_49k.json"), (64, "word_bpe_49k.json"),
                                          (64, "byte_bpe_50k.json")])
def test_pack_round_trip(spark, window, name):
    rng = random.Random(5)
    path, by_words = public_tokenizers.path(name), name.startswith("word")
    vocab = ["word", "Été", "naïve", "日本", "it's", "<|endoftext|>", "\u0085x", "a\u001cb", "é", "́", "x1y22", "☂" * 90, "J\u030c.", "Wort!?", "<|ENDOFTEXT|>",
             "a<|startoftext|>.", "it's.", "12.", "e\u0301.", "...", "É.", "a\u00ad,", "Straße;"]
    made = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, k=rng.randint(1, 400)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, " \n"), (None, "null id"), (203, "long " * 9000)]
    made += made[:3]
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in made], SCHEMA).repartition(4)
    got = packing.pack(docs, path, window, by_words=by_words).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in made}
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in got:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, part))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in made:
        own = pieces[i, len(ids[t])]
        copies = sum((i, t) == m for m in made)
        assert sum(len(p) for _, p in own) == copies * len(ids[t])
        assert all(p == ids[t][s:s + len(p)] for s, p in own)
        cover = collections.Counter(k for s, p in own for k in range(s, s + len(p)))
        assert set(cover.values()) == {copies} and len(cover) == len(ids[t])
    for parts in sequences.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at == window or at.bit_count() == 1 and at < window
    assert packing.pack(docs.limit(0), path, window, by_words=by_words).count() == 0


# --------------------------------------------------------------------------- whitening

def _scatter(rng, d, rows, spread=50):
    y = rng.integers(-spread, spread, (rows, d)).astype(object)
    return (rows * (y.T @ y) - np.outer(y.sum(0), y.sum(0))).tolist()


def _charpoly(m):
    """Faddeev-LeVerrier in fractions, lowest degree first."""
    d = len(m)
    m = np.array([[Fraction(v) for v in row] for row in m], dtype=object)
    unit = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
    c, aux = [Fraction(1)], unit * 0
    for k in range(1, d + 1):
        aux = m @ aux + c[-1] * unit
        c.append(-sum((m @ aux)[i, i] for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(6)
    for d, rows in ((1, 5), (2, 9), (5, 3), (7, 40)):
        m = _scatter(rng, d, rows)
        assert whitening.characteristic_polynomial(spark, m) == _charpoly(m)
    block = [[5, 2, 0, 0], [2, 5, 0, 0], [0, 0, 5, 2], [0, 0, 2, 5]]                # a zero pivot, equal roots
    assert whitening.characteristic_polynomial(spark, block) == _charpoly(block)


def test_roots_and_multiplicity():
    roots = [7, 7, 7, 3, 1]
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    got = charpoly.largest_roots(c, 5, 19)
    assert [(round((lo + hi) / 2 / 2 ** s, 9), m) for lo, hi, s, m in got] == [(7, 3), (3, 1), (1, 1)]
    got = charpoly.largest_roots([1, -3, 1], 2, 3)                                   # irrational roots below and above 1
    with_root = [(Decimal(lo + hi) / (Decimal(2) ** (s + 1))) for lo, hi, s, _ in got]
    assert [float(v) for v in with_root] == pytest.approx([(3 + 5 ** .5) / 2, (3 - 5 ** .5) / 2], rel=1e-15)


def _check(spark, made, components=8):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in made], "vec_id long, embedding array<float>, n int, whitened double")
    got = whitening.whiten(table.repartition(3), components).collect()
    kept = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int) + 100_000) for i, v in made
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:components]
    rank = min(components, np.linalg.matrix_rank(centred))
    order = order[:rank]
    want = centred @ axes[:, order] / np.sqrt(e[order])
    assert len(got) == n * rank
    for k in range(rank):
        mine = {}
        for r in got:
            if r.component == k + 1:
                mine.setdefault(r.vec_id, r.whitened)
                assert r.explained == pytest.approx(e[order[k]] / e.sum(), rel=1e-8) and r.n == n
                assert r.identity_error < 1e-9
        line = np.array([mine[i] for i, _ in kept])
        sign = np.sign((line * want[:, k]).sum())
        assert line * sign == pytest.approx(want[:, k], abs=1e-7)
    deviation = {i: int(((n * v.astype(object) - s) ** 2).sum()) for i, v in kept}
    assert {r.vec_id: r.deviation for r in got} == deviation
    return got


def test_whitening(spark):
    rng = np.random.default_rng(7)
    spread = np.linspace(1, 3, 12)
    made = [(i, (rng.normal(size=12) * spread).tolist()) for i in range(200)]
    made += [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11)]
    made += made[:2] + [(None, [0.5] * 12)]
    _check(spark, made)
    got = _check(spark, [(i, [float(i % 2), float(i % 3), 1.0, 1.0]) for i in range(30)])   # two zero eigenvalues
    assert max(r.component for r in got) == 2


def test_equal_eigenvalues(spark):
    """Any orthonormal basis of the eigenspace is right: the whitened covariance tells."""
    made = [(i, [float(i == k) for k in range(5)]) for i in range(5)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    got = whitening.whiten(table).collect()
    assert len(got) == 5 * 4
    w = np.zeros((5, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(1 / 4) and r.identity_error < 1e-12
    assert w.T @ w / 5 == pytest.approx(np.eye(4), abs=1e-12)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    for made in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        out = whitening.whiten(spark.createDataFrame(made, schema))
        assert out.count() == 0 and out.columns[0] == "vec_id"
    mixed = [(i, [float(i), float(i * i)]) for i in range(9)] + [(100, [1.0, 2.0, 3.0]), (101, [2.0 ** 31, 0.0])]
    assert {r.vec_id for r in whitening.whiten(spark.createDataFrame(mixed, schema)).collect()} == set(range(9))
    wide = [(i, [float(i) * 2 ** 20, float(i % 3)]) for i in range(400)]                    # entries beyond 2^20, long overflow
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    x = np.array([[int(1024 * c) for c in v] for _, v in wide], dtype=object)
    exact = ((len(wide) * x - x.sum(0)) ** 2).sum(1)
    assert {r.vec_id: r.deviation for r in got} == {i: int(e) if e < 2 ** 63 else None for i, e in enumerate(exact)}
