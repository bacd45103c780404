"""Piece encoding, whitening and clustering against the library, NumPy and brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import centroids, exact, pieces, whitening
from crosspanel.llm.queries import QUERIES, piece_model_path

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
LETTERS = [*"aabcdehilnorst   ''..,\n\t<>0x-=", "▁", "▁▁", "é", "漢", "\U0001f600", "the", "  ", "\r\n", "\x00", "﻿", "\xa0"]


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(piece_model_path())


def odd_texts() -> list[str]:
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [c * n for c in ("a", " ", "ab", "-", "=", "é", "漢字") for n in range(70)]
    return texts + ["<s>", "</s>", "<unk>", "<0x0A>", "x" * 30000, "no spaces" * 3000, " " * 5000]


def test_backtracking_equals_the_library(coder):
    texts = odd_texts()
    assert coder.encode(texts) == coder.model.encode(texts, num_threads=1)
    # A worker that starts anew for each word gives the same.
    before, pieces.KEPT_WORDS, pieces.KEPT_PAIRS = (pieces.KEPT_WORDS, pieces.KEPT_PAIRS), 1, 3
    coder.forget()
    assert coder.encode(texts[:300]) == coder.model.encode(texts[:300], num_threads=1)
    pieces.KEPT_WORDS, pieces.KEPT_PAIRS = before


def test_backtracking_equals_merging(coder):
    """The whole word by the merge procedure, and by backtracking without the longest match always holding."""
    gave_back = 0
    for text in odd_texts()[:600]:
        text = text[:24].replace(" ", pieces.SPACE)
        got = [coder.names[p] for p in coder.pieces(text)]
        assert got == coder.merge(text)
        greedy, at = [], 0
        while at < len(text):
            n = next((n for n in range(len(text) - at, 1, -1) if text[at : at + n] in coder.scores), 1)
            greedy.append(text[at : at + n])
            at += n
        gave_back += greedy != got
    assert gave_back


def test_pieces_of_tables(spark, coder):
    texts = [None, "", " ", "two  words\n", "漢", "twice", "twice", "x" * 20000]
    rows = [(i if i != 4 else None, t, "clash", [i]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, doc string, ids array<int>")
    out = pieces.encode_texts(table, piece_model_path())
    got = out.collect()
    assert [(r.doc.doc_id, r.doc.text, r.doc.doc, r.ids) for r in got] == [
        (i, t, "clash", coder.model.encode(t or "")) for i, t, *_ in rows
    ]
    back = pieces.decode_ids(out, piece_model_path()).collect()
    assert [r.text for r in back] == [t or "" for t in texts]
    empty = pieces.decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>"), piece_model_path())
    assert [r.text for r in empty.collect()] == ["", ""]
    assert pieces.encode_texts(table.limit(0), piece_model_path()).count() == 0


def test_pieces_query(spark, coder):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = coder.model.encode(r.text or "")
        want[r.doc_id] = (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(coder.model.decode(ids).encode()).hexdigest(),
        )
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_backtracking_pieces"](spark, SF).collect()}
    assert got == want


def test_limbs():
    for v in (0, 1, -1, 2**200 + 7, -(2**200) - 7, 2**30, -(2**30)):
        assert exact.join(exact.split(v)) == v
    with pytest.raises(OverflowError):
        exact.split(2**250)


def determinant(m: list[list[Fraction]]) -> Fraction:
    m, total = [list(r) for r in m], Fraction(1)
    for k in range(len(m)):
        at = next((i for i in range(k, len(m)) if m[i][k]), None)
        if at is None:
            return Fraction(0)
        if at != k:
            m[k], m[at], total = m[at], m[k], -total
        total *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return total


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(2)
    for n, rank, size in ((1, 1, 9), (2, 1, 5), (5, 5, 2**20), (7, 4, 1000), (6, 6, 3)):
        a = rng.integers(-size, size + 1, (rank, n)).astype(object)
        m = a.T.dot(a).tolist()
        if n == 6:
            # A zero subdiagonal on the way to Hessenberg form.
            m = [[int(i == j) * (i + 1) if i < 3 or j < 3 else m[i][j] for j in range(n)] for i in range(n)]
        poly = whitening.characteristic(spark, m)
        for x in range(-2, n):
            shifted = [[Fraction(x * (i == j) - m[i][j]) for j in range(n)] for i in range(n)]
            assert sum(c * x**k for k, c in enumerate(poly)) == determinant(shifted)
        got = [r / 2**20 for r in whitening.roots(poly, n, 20)]
        assert np.allclose(got, sorted(np.linalg.eigvalsh(np.array(m, float)), reverse=True), atol=1e-5 * max(got[0], 1))


def test_roots_are_counted_with_their_multiplicity():
    # (x - 1)^2 (x - 4) (x - 5)^3 x
    poly = [1]
    for root in (1, 1, 4, 5, 5, 5, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [whitening.roots_above(poly, x) for x in (-1, 0, 1, 3, 4, 5)] == [7, 6, 4, 4, 3, 0]
    assert whitening.roots(poly, 7, 8) == [5 << 8] * 3 + [4 << 8] + [1 << 8] * 2 + [0]
    assert whitening.roots(poly, 2, 8) == [5 << 8] * 2


def whole(v) -> list[int] | None:
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(Fraction(64) * Fraction(x)) + 1_000_000 for x in v]


def check_whitening(rows, got, most):
    x = [w for _, v in rows if (w := whole(v)) is not None]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[n * v - s for v, s in zip(r, sums)] for r in x], object)
    v = (d.T.dot(d) / n**3).astype(float)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    some = [e for e in values[:most] if e > 1e-9 * values[0]]
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == n * len(some) and len({r.identity_error for r in got}) <= 1
    for (i, _), own in zip([r for r in rows if whole(r[1]) is not None], d):
        assert sorted(by[i]) == list(range(1, len(some) + 1))
        for k, r in by[i].items():
            assert r.n == n and r.deviation == sum(int(c) ** 2 for c in own)
            assert math.isclose(r.explained, some[k - 1] / values.sum(), rel_tol=1e-6) and r.identity_error < 1e-6
    white = np.array([[by[i][k].whitened for k in sorted(by[i])] for i in by])
    assert np.allclose(white.T @ white / n, np.eye(len(some)), atol=1e-6)
    return white, d.astype(float) / n, v, np.array(some)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op12_exact_whitening"](spark, SF).collect()
    white, centred, v, some = check_whitening(rows, got, 32)
    # The projections' covariance with x is V u / sqrt(e) = sqrt(e) u: unit eigenvectors come back.
    u = (centred.T @ white / len(rows)) / np.sqrt(some)
    assert np.allclose(np.linalg.norm(u, axis=0), 1, atol=1e-12)
    assert np.abs(v @ u - u * some).max() < 1e-10 * some[0]


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(4)
    plain = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [None] * 5), (103, [NAN] * 5), (104, [1.0, 2.0, INF, 0.0, 0.0])]

    def table(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash"))

    check_whitening(plain + odd, whitening.whiten(table(plain + odd)).collect(), 32)
    check_whitening(plain, whitening.whiten(table(plain), 2).collect(), 2)
    # Equal roots: the corners of a cross; a constant and a repeated entry: roots of zero.
    cross = [(2 * i + s, [float(3 * (1 - 2 * s)) if j == i else 0.0 for j in range(4)]) for i in range(4) for s in (0, 1)]
    check_whitening(cross, whitening.whiten(table(cross)).collect(), 32)
    flat = [(i, [*v[:2], 7.0, v[0]]) for i, v in plain]
    assert {r.component for r in whitening.whiten(table(flat)).collect()} == {1, 2}
    check_whitening(flat, whitening.whiten(table(flat)).collect(), 32)
    # Large entries keep exact sums; a deviation beyond a long is null, and so has no place in this check.
    large = [(i, [x * 2.0**40 for x in v]) for i, v in plain]
    got = whitening.whiten(table(large)).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9
    for rows in (plain[:1], [(1, [1.0, 2.0])] * 3, [], odd):
        assert whitening.whiten(table(rows)).collect() == []
    assert len(whitening.whiten(table(plain + plain)).collect()) == 600
    with pytest.raises(ValueError):
        whitening.whiten(table([(1, [1.0]), (2, [1.0, 2.0])]))


def brute_clusters(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**90 for x in v)]
    keyed = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept]
    cents = [v for *_, v in sorted(keyed)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        cents = [[sum(c) // len(by[k]) for c in zip(*by[k])] if k in by else old for k, old in enumerate(cents)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = defaultdict(int)
    for _, k, d in found:
        own[k] += d
    total = sum(own.values())
    fit = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, fit(d), fit(own[k]), fit(total), digest[k]) for i, k, d in found), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(8)
    spots = rng.normal(size=(5, 6))
    rows = [(i, (spots[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [rows[3]] * 5 + [(None, rows[4][1])] * 2
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [None] * 6), (404, [NAN] * 6), (405, [INF] * 6)]

    def table(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("near", F.lit("clash"))

    for data, k in (
        (rows, 8), (rows[:3], 8), (rows[:1], 8), ([(None, [1.0] * 6)], 2), ([(i, [1.0] * 6) for i in range(20)], 4),
        # Ties: corners of a square around the starts; very large components.
        ([(i, [float(i % 2), float(i // 2 % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(40)], 3),
        (rows[:50] + [(500, [1e12] * 6), (501, [-1e20] + [1.0] * 5), (502, [1e20] * 6), (503, [1e200] * 6)], 4), ([], 8), (rows[-6:], 8),
    ):
        got = centroids.cluster(table(data), k, 10, 6).collect()
        assert sorted(map(tuple, got), key=str) == brute_clusters(data, k, 10, 6)


def test_bounds_prune_and_never_err():
    rng = np.random.default_rng(1)
    spots = rng.integers(-3000, 3000, (8, 64))
    x = np.concatenate([s + rng.integers(-300, 300, (200, 64)) for s in spots])
    cents = spots.tolist()
    pivots = centroids.fixed_pivots(cents)
    pruner = centroids.Pruner(cents, pivots)
    xp = centroids.distances(x, pivots)
    true = np.stack([centroids.squared(x, np.array([c])) for c in cents], axis=1)
    assert (centroids.lower_bounds(xp, pruner.cp, pruner.pp) <= np.sqrt(true)).all()
    cluster, best, checked = pruner.nearest(x, xp)
    assert (cluster == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert len(x) <= checked < 0.6 * true.size
