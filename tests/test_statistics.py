"""Edges of the statistics: series without counts, missing and open points, over-dispersion, and names that are written with errors."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest

from ravelin.operators import matching, profiles, statistics


def months(spark, counts, exposures):
    return spark.createDataFrame([(datetime.date(2020 + k // 12, k % 12 + 1, 1), c, e) for k, (c, e) in enumerate(zip(counts, exposures, strict=True))], "m date, hits long, total long")


def test_a_series_without_counts_has_no_limits(spark):
    for kind in "ucp":
        got = statistics.chart(months(spark, [0] * 6, [10] * 5 + [0]), "m", "hits", "total", kind).collect()
        assert len(got) == 6 and all(r.z is None and r.low is None and r.high is None and not r.out for r in got)
    got = statistics.chart(months(spark, [10] * 4, [10] * 4), "m", "hits", "total", "p").collect()
    assert all(r.rate == 1 and r.z is None and not r.out for r in got)
    assert statistics.chart(months(spark, [1, 2], [0, 0]), "m", "hits", "total").where("center is not null").isEmpty()


def test_open_points_take_part_in_nothing(spark):
    from pyspark.sql import functions as F

    closed = statistics.chart(months(spark, [5, 7, 6, 4, 8], [100] * 5), "m", "hits", "total").orderBy("m").collect()
    rows = months(spark, [5, 7, 6, 4, 8, 90, 0], [100] * 7)
    got = statistics.chart(rows, "m", "hits", "total", open_=F.col("m") >= F.lit("2020-06-01").cast("date")).orderBy("m").collect()
    assert got[:5] == closed and [(r.rate, r.z, r.low, r.out) for r in got[5:]] == [(0.9, None, None, False), (0.0, None, None, False)]


def test_runs_skip_missing_points(spark):
    z = [0.5, 0.6, 0.4, 0.5, 0.7, None, 0.3, 0.5, 0.6, 0.2, 0.5, 2.5, None, 2.6, 3.5]
    rate = [1, 2, 3, 4, 5, None, 6, 2, 3, 4, 3, 2, None, 1, 5]
    points = spark.createDataFrame([(k, a, None if b is None else float(b)) for k, (a, b) in enumerate(zip(z, rate))], "m int, z double, rate double")
    got = {r.m: [n for n in ("beyond", "same_side", "trend", "two_of_three") if r[n]] for r in statistics.runs(points, "m", "z", "rate").collect()}
    assert len(got) == 15 and got[5] == got[12] == []
    # six rising points around the missing one, nine on one side from the ninth that is there
    assert "trend" in got[6] and "same_side" not in got[8] and all("same_side" in got[k] for k in (9, 10, 11, 13, 14))
    assert "two_of_three" in got[13] and got[14] == ["beyond", "same_side", "two_of_three"]


def test_nothing_is_divided_by_nothing(spark):
    groups = spark.createDataFrame([(1, 0, 10), (2, 0, 5)], "k long, hits long, total long")
    row = statistics.concentration(groups, "k", "hits").first()
    assert row.hhi is None and row.effective is None and row.cr1 is None
    assert all(r.residual is None for r in statistics.homogeneity(groups, "k", "hits", "total").collect())
    one = spark.createDataFrame([(1, 3, 10)], "k long, hits long, total long")
    assert [tuple(r) for r in statistics.homogeneity(one, "k", "hits", "total").collect()] == [(1, 3.0, None, 0.0)]
    many = spark.createDataFrame([(k, k + 1, 1) for k in range(12)], "k long, hits long, total long")
    row, all_ = statistics.concentration(many, "k", "hits").first(), sum(range(1, 13))
    assert (row.cr1, row.cr3, row.cr5, row.cr10) == tuple(round(sum(range(13 - n, 13)) / all_, 6) for n in (1, 3, 5, 10))


def test_changes_with_dispersion_match_all_partitions():
    rng = np.random.default_rng(8)
    for phi in (1.0, 2.5, 7.0):
        counts, exposures = rng.negative_binomial(3, 0.2, 14).astype(float) + (np.arange(14) > 6) * 9, rng.uniform(0.5, 2, 14)

        def objective(starts):
            return statistics._deviance(counts, statistics.levelled(counts, exposures, list(starts))) / phi + 3.0 * len(starts)

        ways = [w for k in range(4) for w in itertools.combinations(range(3, 12), k) if all(b - a >= 3 for a, b in zip((0, *w), (*w, 14)))]
        assert objective(statistics.changes(counts, exposures, 3.0, phi=phi)) == pytest.approx(min(map(objective, ways)))


def test_scatter_isnt_taken_for_changes():
    rng = np.random.default_rng(3)
    season, found = np.arange(60) % 12, 0
    for _ in range(20):
        counts = rng.negative_binomial(4, 4 / (4 + 60), 60).astype(float)  # variance 16 times the mean
        starts, _, phi = statistics.seasonal_changes(counts, np.ones(60), season, 12, 3 * math.log(60))
        found += len(starts)
        assert phi > 3
    assert found <= 4
    plain, steady = rng.poisson(40, 60).astype(float), statistics.over_dispersion(rng.poisson(40, 400).astype(float), np.full(400, 40.0), 1)
    assert statistics.seasonal_changes(plain, np.ones(60), season, 12, 3 * math.log(60))[2] < 2.5 and steady < 1.3
    step = np.where(np.arange(60) < 36, 40, 80) * np.where(season < 6, 1.4, 0.7)
    for at in (36, 31):  # at the edge of a year and within one
        step = np.where(np.arange(60) < at, 40, 80) * np.where(season < 6, 1.4, 0.7)
        starts, _, _ = statistics.seasonal_changes(rng.poisson(step).astype(float), np.ones(60), season, 12, 3 * math.log(60))
        assert len(starts) == 1 and abs(starts[0] - at) <= 1
    assert statistics.seasonal_changes(np.zeros(0), np.zeros(0), np.zeros(0, int), 12, 3.0)[0] == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_labels_that_contain_or_misspell_a_text(spark):
    rng = random.Random(2)
    labels = ["".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(150)] + ["blue bolt", "", "é"]
    asked = dict(enumerate(["", "a", "ab", "abc", "abca", "blue bot", "bleu bolt", "c", "é", "zz"]))
    own, want = spark.createDataFrame([(x,) for x in labels] + [(None,)], "label string"), spark.createDataFrame(list(asked.items()) + [(99, None)], "id int, text string")
    got = matching.containing(want, "id", "text", own, "label").collect()
    assert sorted(map(tuple, got)) == sorted({(i, x) for i, t in asked.items() for x in labels if t and t in x})
    got = matching.misspelled(want, "id", "text", own, "label").collect()
    assert sorted(map(tuple, got)) == sorted({(i, x) for i, t in asked.items() for x in labels if edits(t, x) <= 2})


def test_several_hits_are_no_hit(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3)], "_k string, target long")
    from pyspark.sql import functions as F

    got = {r.id: (r.target, r.how) for r in matching.ladder(asked, "id", [("key", table, F.col("k"), "stop")], "target").collect()}
    assert got == {1: (None, "several"), 2: (3, "key"), 3: (None, "none")}


def test_kinds_are_narrow(spark):
    rows = spark.createDataFrame([(str(k % 2), "yes" if k % 2 else "No", f"o{k % 12}", f"o{k % 13}", " 1,234.50 ", None) for k in range(60)], "bit string, flag string, twelve string, thirteen string, money string, none string")
    got = {r.column: (r.kind, r.filled, r.distinct, r.decimals) for r in profiles.kinds(rows).collect()}
    assert got == {"bit": ("number", 60, 2, 0), "flag": ("bool", 60, 2, 0), "twelve": ("enum", 60, 12, 0), "thirteen": ("text", 60, 13, 0), "money": ("number", 60, 1, 2), "none": ("text", 0, 0, 0)}


def test_ages_of_cohorts_are_made_where_they_are_summed(spark):
    from pyspark.sql import functions as F

    from ravelin.operators import lives

    rng, month = random.Random(4), lambda n: datetime.date(2020 + n // 12, n % 12 + 1, 1)
    end, sides = 40, {}
    for side, first in (("old", 8), ("new", 0)):  # the new line has older cohorts, so ages that the old one never reached
        sides[side] = [(k, n, age, rng.random() < 0.4) for k in (1, 2, 3) for n in range(first, 42) for age in [*(rng.randrange(max(end - n, 0) + 1) for _ in range(4)), -1, None] if (side, k) != ("old", 3)]
    schema = "k long, cohort date, age int, hit boolean"
    frames = {side: spark.createDataFrame([(k, month(n), age, hit) for k, n, age, hit in rows], schema) for side, rows in sides.items()}
    last = spark.createDataFrame([(month(end),)], "e date")
    for keys in (["k"], []):
        key = lambda r: r[0] if keys else 0
        cells = {side: {} for side in sides}
        for side, rows in sides.items():
            for at in {(key(r), r[1]) for r in rows if r[1] <= end}:
                own = [r for r in rows if (key(r), r[1]) == at]
                cells[side] |= {(*at, a): (len(own), sum(r[3] for r in own if r[2] == a)) for a in range(end - at[1] + 1)}
        at_age, hits = {}, {}
        for (k, _, a), (n, h) in cells["old"].items():
            at_age[k, a], hits[k, a] = at_age.get((k, a), 0) + n, hits.get((k, a), 0) + h
        rate = {x: hits[x] / at_age[x] for x in at_age}
        want, scatter = {}, {}
        for (k, n, a), (units, h) in cells["new"].items():
            if (k, a) in rate:
                o, e = want.get((k, n + a), (0, 0.0))
                want[k, n + a] = (o + h, e + units * rate[k, a])
        for (k, n, a), (units, h) in cells["old"].items():
            o, e = scatter.get((k, n), (0, 0.0))
            scatter[k, n] = (o + h, e + units * rate[k, a])
        old, new = (lives.exposures(frames[side], last, F.col("hit"), keys) for side in ("old", "new"))
        assert old.count() == len(scatter)  # a row for a cohort, not for each of its ages
        by_age = lives.rates(old, keys)
        series = lives.expected(new, by_age, keys, keys)
        got = {(r.k if keys else 0, 12 * (r.period.year - 2020) + r.period.month - 1): (r.o, r.e) for r in series.collect()}
        assert {x: o for x, (o, _) in got.items()} == {x: o for x, (o, _) in want.items()}
        assert all(got[x][1] == pytest.approx(e) for x, (_, e) in want.items())
        phi = {r.k if keys else 0: r.phi for r in lives.dispersion(old, by_age, keys).collect()}
        for k in {k for k, _ in scatter}:
            own = [(o, e) for (x, _), (o, e) in scatter.items() if x == k and e > 0]
            assert phi[k] == pytest.approx(max(1.0, sum((o - e) ** 2 / e for o, e in own) / (len(own) - 1)))
        assert set(phi) == {k for k, _ in scatter}
        if keys:
            plan = lives.expected(new, by_age, keys, keys)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.split("Generate explode")[0]
