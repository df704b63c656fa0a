"""Vector codes against exact arithmetic in Python."""

import hashlib
import math

import numpy as np
import pytest

from ravelin.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, code string, `_label` int, vector string"


def brute(rows, start, rounds=vectorcodes.ROUNDS):
    """(codebooks, {row: (code, error)}) of kept rows (id, vector), in unbounded integers; ``start``: places of the first entries."""
    whole = [[math.floor(256 * x) if abs(x) < 2**44 else int(x) * 256 for x in v] for _, v in rows]
    size = len(whole[0]) // 16
    part = [[v[k * size : (k + 1) * size] for v in whole] for k in range(16)]
    books = [[part[k][p] for p in start] for k in range(16)]

    def best(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(16):
            own = [best(k, x)[1] for x in part[k]]
            for n in range(len(books[k])):
                of = [x for x, m in zip(part[k], own) if m == n]
                if of:
                    books[k][n] = [sum(c) // len(of) for c in zip(*of)]
    found = [[best(k, part[k][r]) for k in range(16)] for r in range(len(rows))]
    return books, [("".join("%02x" % n for _, n in f), sum(d for d, _ in f)) for f in found]


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_nearest_is_exact_with_ties_and_wide_ranges():
    rng = np.random.default_rng(2)
    for most in (1, 3, 90, 5000, 2**23, 2**30, 2**52, 2**90, 2**130):
        small = rng.integers(-most, most + 1, (50, 4)) if most < 2**60 else None
        points = small if small is not None else np.array([[int(x) * most for x in r] for r in rng.integers(-3, 4, (50, 4))], object)
        entries = np.concatenate([points[:20], points[:5], points[20:30] + (1 if most > 1 else 0)])
        code, apart = vectorcodes.nearest(points, entries)
        for p, c, d in zip(points.tolist(), code.tolist(), apart.tolist()):
            assert (d, c) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)), n) for n, e in enumerate(entries.tolist()))


def test_whole_operator_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(np.float32(x)) for x in rng.normal(0, 0.3, 32)] for _ in range(150)]
    vectors[7] = list(vectors[3])
    vectors[9] = [0.0] * 32
    vectors[11] = [1e30 * x for x in vectors[11]]
    vectors[11] = [float(np.float32(x)) for x in vectors[11]]
    vectors[140] = [3.4e38] + vectors[140][1:]
    vectors[140][0] = float(np.float32(vectors[140][0]))
    rows = [(2 * k, v, k % 5 if k % 3 else None) for k, v in enumerate(vectors)]
    rows += [rows[4], rows[4], (None, vectors[50], 2)]
    bad = [(1, None, 1), (3, [], 1), (5, [None] + [0.5] * 31, 1), (7, [math.nan] + [0.5] * 31, 1), (9, [math.inf] * 32, 1), (11, [0.5] * 31, 1), (13, [0.5] * 48, 1), (15, [-math.inf] + [0.0] * 31, None)]
    docs = spark.createDataFrame([(*r, 0, "c", 0, "v") for r in rows + bad], SCHEMA).repartition(4)
    got = vectorcodes.compressed(docs).collect()
    books, found = brute([r[:2] for r in rows], range(64))
    assert len(got) == len(rows)
    assert {r.codebooks_sha256 for r in got} == {digest(books)}
    fits = lambda x: x if x < 1 << 63 else None
    want = {}
    for r, (_, e) in zip(rows, found):
        want.setdefault(r[2], []).append(e)
    label = {k: fits(sum(v)) for k, v in want.items()}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(((r[0], c, fits(e), label[r[2]]) for r, (c, e) in zip(rows, found)), key=repr)


def test_few_rows_and_no_rows(spark):
    few = spark.createDataFrame([(k, [float(k)] * 16, None) for k in range(3)], "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.compressed(few).collect()) == [(k, "%02x" % k * 16, 0, 0) for k in range(3)]
    for rows in ([], [(1, None, None)], [(None, [1.0] * 16, None)]):
        assert vectorcodes.compressed(spark.createDataFrame(rows, few.schema)).collect() == []


def test_label_sums_are_equal_by_either_way(spark):
    coded = spark.createDataFrame([(k, k % 3 or None, f"c{k}", k) for k in range(300)] + [(1, 7, "x", None)], "id long, label int, code string, error long")
    ways = [sorted(vectorcodes.with_label_error(coded, most).collect(), key=repr) for most in (0, 10)]
    assert ways[0] == ways[1] and len(ways[0]) == 301
    assert {(r.label, r.label_error) for r in ways[0]} == {(None, 14850), (1, 14950), (2, 15050), (7, None)}


@pytest.mark.parametrize("value", [0, 1, -1, 2**40, -(2**40), 2**137 + 5, -(2**137) - 5])
def test_limbs_sum_to_the_value(value):
    limbs = list(vectorcodes._limbs(value))
    assert sum(v << vectorcodes.LIMB_BITS * k for k, v in limbs) == value and all(abs(v) <= 2**40 for _, v in limbs)
