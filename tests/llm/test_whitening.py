import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from lodestone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", i) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, components=16):
    """Per row: deviation, and for each component |whitened|, explained; by fractions, with the offset."""
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = [[Fraction(x[i] * n - s[i], n) for i in range(d)] for x in fit]
    v = [[sum(r[i] * r[j] for r in y) / n for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array([[float(q) for q in row] for row in v]))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(sum(v[i][i] for i in range(d)))
    out = []
    for x in xs:
        centre = np.array([float(Fraction(x[i] * n - s[i], n)) for i in range(d)])
        out.append((sum((n * x[i] - s[i]) ** 2 for i in range(d)), np.abs(centre @ axes) / np.sqrt(values), values / trace))
    return n, out


def check(spark, vectors, components):
    n, want = brute(vectors)
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert len(got) == len(vectors) * components and len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-6
    for r in got:
        deviation, white, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
        assert abs(abs(r["whitened"]) - white[k]) < 1e-6 * max(1, white[k]) and abs(r["explained"] - explained[k]) < 1e-9
    return got


def test_equals_fractions(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0.3 * j, 0.1 + 0.2 * j) for j in range(20)] for _ in range(150)]
    got = check(spark, vectors + vectors[:40] + [vectors[0]] * 60, 16)
    signs = {r["component"]: 1 if r["whitened"] > 0 else -1 for r in got if r["vec_id"] == 0}
    again = whitening.whiten(frame(spark, vectors + vectors[:40]).repartition(9)).where("vec_id = 0").collect()
    assert {r["component"]: 1 if r["whitened"] > 0 else -1 for r in again} == signs


def test_entries_of_several_limbs(spark):
    rng = random.Random(5)
    check(spark, [[rng.gauss(0, 3e5), rng.gauss(7e6, 2e6), rng.gauss(-3e9, 1e9)] for _ in range(60)], 3)


def test_gram_is_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 22, 45, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (whitening.ROWS if bits < 50 else 50, 4))
        big = y.astype(object)
        assert (whitening.gram(y) == big.T.dot(big)).all()
    y = np.full((whitening.ROWS, 2), (1 << 21) - 1)
    assert (whitening.gram(y) == whitening.ROWS * ((1 << 21) - 1) ** 2).all()


def test_keys_hold_the_vectors():
    rng = np.random.default_rng(2)
    for bits in (2, 7, 8, 15, 31, 60):
        x = np.vstack([rng.integers(-(1 << bits), 1 << bits, (20, 5)), [[-(1 << bits)] * 5, [(1 << bits) - 1] * 5]])
        ((size, got),) = whitening.unpacked(pa.array(whitening.packed(x[-1:])).cast(pa.binary()))
        assert size == 5 and (got == x[-1:]).all()
        assert sorted(map(tuple, np.vstack([g for _, g in whitening.unpacked(pa.array(whitening.packed(x), pa.binary()))]).tolist())) == sorted(map(tuple, x.tolist()))


def test_nulls_lengths_and_alike_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0], [1.0, 2.0], [3.0, 5.0], [0.5], [0.25, 0.5, 0.75], [1e38, 1.0], [2.0, -3e38]]
    got = {}
    for r in whitening.whiten(frame(spark, rows).union(spark.createDataFrame([(None, [1.0, 2.0], None, None)], SCHEMA))).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == {5, 6, 7, 8, 9, 10, 11, None}
    assert [len(got[i]) for i in (5, 7, 8, 9, None)] == [2, 2, 1, 3, 2]
    assert {r["n"] for r in got[5]} == {4} and {r["n"] for r in got[8] + got[9]} == {1}
    assert all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in got[8] + got[9])
    assert [r["whitened"] for r in sorted(got[5], key=lambda r: r["component"])] == [r["whitened"] for r in sorted(got[6], key=lambda r: r["component"])]
    assert got[10][0]["deviation"] is None


def test_fewer_directions_than_components(spark):
    got = whitening.whiten(frame(spark, [[float(i), 2.0 * i, 1.0] for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-6


def test_empty(spark):
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [None])).collect() == []
