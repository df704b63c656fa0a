import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions import scalars
from ravelin.operators import graphs, metrics, statistics, summary
from ravelin.operators.relations import best_linked, excluded, linked_counts


def test_excluded_and_matched_add_up(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string")
    out = excluded(F.col("v") == "a")
    assert sorted(r.id for r in rows.where(out).collect()) == [2, 3]


def test_count_of_linked_keeps_zero(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    edges = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "k int, far int")
    assert {(r.k, r.n) for r in linked_counts(rows, edges, "k", "far").collect()} == {(1, 2), (2, 0)}


def test_best_linked_says_that_there_are_more(spark):
    rows = spark.createDataFrame([(1, x) for x in (4, 2, 3, 2)] + [(2, 1)], "k int, v int")
    got = {r.k: (r["values"], r.more) for r in best_linked(rows, "k", "v", 2).collect()}
    assert got == {1: ([2, 3], True), 2: ([1], False)}


def test_numbers_are_plain(spark):
    rows = spark.createDataFrame([("1e5",), ("-2.5",), ("12.",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(scalars.numeric(F.col("v"))).collect()] == [None, -2.5, None, None, None]


def test_refresh_equals_full(spark):
    rows = spark.createDataFrame([(1, "p", 2.0), (2, "p", 3.0), (3, "q", 4.0), (4, None, 5.0)], "id int, period string, v double")
    full = metrics.cells(rows, ["period"], F.col("v"))
    old = metrics.cells(rows.where("id <> 2"), ["period"], F.col("v"))
    new = metrics.refreshed(old, rows, rows.where("id = 2").select("period"), ["period"], F.col("v"))
    assert sorted(map(repr, full.select(*new.columns).collect())) == sorted(map(repr, new.collect()))


def test_cycle_is_found_and_reach_ends(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "s long, d long, q long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graphs.reach(edges, start, "s", "d").collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        graphs.explosion(edges, 1, "s", "d", "q", depth=6)


def test_split_folds_the_rest(spark):
    rows = spark.createDataFrame([("x", v) for v in "aaabbc"], "g string, v string")
    assert {(r.v, r.n) for r in summary.split(rows, "g", "v", 2).collect()} == {("a", 3), ("b", 2), ("other", 1)}


def test_numeric_kernel():
    assert statistics.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    low, high = statistics.poisson_interval(10)
    assert (low, high) == (pytest.approx(4.795389, abs=1e-5), pytest.approx(18.390356, abs=1e-5))
    assert statistics.poisson_interval(0)[0] == 0


def test_change_point():
    counts = np.array([5] * 12 + [20] * 12, float)
    assert statistics.changes(counts, np.full(24, 100.0), 2 * math.log(24)) == [12]
    assert statistics.changes(np.full(24, 7.0), np.full(24, 100.0), 2 * math.log(24)) == []


def test_weibull_is_recovered():
    rng = np.random.default_rng(3)
    units, horizon, fails = [], [], []
    for h in range(6, 30):
        life = 20 * rng.weibull(1.5, 4000)
        own = np.floor(life).astype(int)
        units.append(4000)
        horizon.append(h)
        fails.append(np.bincount(own[own < h], minlength=h)[:h].astype(float))
    shape, scale = statistics.weibull(np.array(units), np.array(horizon), fails)
    assert shape == pytest.approx(1.5, abs=0.05) and scale == pytest.approx(20, rel=0.03)


def test_tails_match_sums():
    import math
    import random

    from ravelin.operators import numeric

    rng = random.Random(4)
    for _ in range(60):
        n, p = rng.randrange(1, 60), rng.uniform(0.02, 0.98)
        k = rng.randrange(n + 1)
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert numeric.binomial_p(k, n, p) == pytest.approx(min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7))), abs=1e-9)
        assert numeric.beta_cdf(k + 1, n - k, p) == pytest.approx(sum(pmf[k + 1 :]), abs=1e-12) if k < n else True
        marked, drawn = rng.randrange(n + 1), rng.randrange(n + 1)
        tail = sum(math.comb(marked, i) * math.comb(n - marked, drawn - i) for i in range(k, drawn + 1)) / math.comb(n, drawn)
        assert numeric.hypergeometric_tail(k, n, marked, drawn) == pytest.approx(tail, abs=1e-12)
        q = rng.uniform(0.01, 0.99)
        assert numeric.beta_cdf(2.5, 7.0, numeric.beta_quantile(q, 2.5, 7.0)) == pytest.approx(q, abs=1e-9)
        assert numeric.gamma_q(3.5, 2 * numeric.gamma_quantile(q, 3.5, 2.0)) == pytest.approx(1 - q, abs=1e-9)
    assert numeric.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert numeric.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    low, high = numeric.poisson_interval(5)
    assert (low, high) == (pytest.approx(1.6235, abs=1e-4), pytest.approx(11.6683, abs=1e-4))


def test_lives_are_found_again():
    import numpy as np

    from ravelin.operators.statistics import Life, best_life

    rng = np.random.default_rng(3)
    for share in (1.0, 0.2):
        horizons = np.arange(4, 40)
        failures, left = np.zeros(40), []
        for h in horizons:
            ages = np.floor(rng.random(4000) + 13.14 * rng.weibull(1.5, 4000))
            ages = ages[(rng.random(4000) < share) & (ages <= h)].astype(int)
            failures += np.bincount(ages, minlength=40)
            left.append(4000 - len(ages))
        best, p = best_life(failures, horizons, np.array(left, float))
        shape, scale, found = Life.unpacked(best.theta)
        assert shape == pytest.approx(1.5, abs=0.1) and scale == pytest.approx(13.14, rel=0.1)
        assert best.defective == (share < 1) and found == pytest.approx(share, abs=0.02)
        low, high = best.life_interval(0.1)
        assert low < best.life(0.1) < high < 1.2 * low
        assert (best.life(0.5) is None) == (share < 0.5)


def test_change_points_match_all_partitions():
    import itertools
    import math

    import numpy as np

    from ravelin.operators.statistics import changes, seasonal_changes

    rng = np.random.default_rng(6)

    def cost(c, e):
        return -2 * c * math.log(c / e) if c > 0 else 0.0

    for _ in range(10):
        counts, exposures = rng.poisson(np.where(np.arange(13) < 6, 4, 12)).astype(float), rng.uniform(0.5, 2, 13)
        ways = [w for k in range(4) for w in itertools.combinations(range(3, 11), k) if all(b - a >= 3 for a, b in zip((0, *w), (*w, 13), strict=True))]
        total = lambda w: sum(cost(counts[a:b].sum(), exposures[a:b].sum()) for a, b in zip((0, *w), (*w, 13), strict=True)) + 5 * len(w)
        assert total(tuple(changes(counts, exposures, 5.0))) == pytest.approx(min(map(total, ways)))
    season = np.arange(72) % 12
    level = np.where(np.arange(72) < 40, 50, 100) * (1 + 0.5 * np.sin(2 * np.pi * season / 12))
    found, index, phi = seasonal_changes(rng.poisson(level).astype(float), np.ones(72), season, 12, 3 * math.log(72))
    assert len(found) == 1 and abs(found[0] - 40) <= 2 and index[3] > 1.3 > 0.8 > index[9]


def test_rows_of_one_shape_are_one_group():
    import numpy as np

    from ravelin.operators.statistics import linked_groups, ppmi

    table = np.array([[90, 5, 5], [45, 3, 2], [5, 80, 15], [4, 70, 16], [6, 10, 84.0]])
    group, score = linked_groups(ppmi(table))
    assert group[0] == group[1] and group[2] == group[3] and len(set(group)) == 3 and score > 0.5


def test_places_and_sums_over_pieces(spark):
    from pyspark.sql import functions as F

    from ravelin.operators.ordered import placed

    rows = [(k, (k * 7919) % 1000) for k in range(2500)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = placed(df, [F.desc("v"), F.asc("k")], {"run": F.col("v")}, {"low": F.col("v") * 1000 + F.col("rank")}).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.k, r.v) for r in got] == want and [r["rank"] for r in got] == list(range(1, 2501))
    run, low = 0, []
    for r in got:
        run += r.v
        assert r.run == run
    values = [r.v * 1000 + r["rank"] for r in got]
    for v in reversed(values):
        low.append(min([v, *low[-1:]]))
    assert [r.low for r in got] == low[::-1]
    assert placed(df.where("false"), [F.asc("k")]).collect() == []


def test_shared_counts_split_hot_items(spark):
    from ravelin.operators.graphs import shared_counts

    rows = [(o, 0) for o in range(60)] + [(o, 1 + o % 7) for o in range(60)] + [(3, 0)]
    df = spark.createDataFrame(rows, "o long, i long")
    got = {(r.a, r.b): r.shared for r in shared_counts(df, "o", "i", block=8).collect()}
    assert got == {(a, b): 1 + (a % 7 == b % 7) for a in range(60) for b in range(60) if a != b}


def test_shared_counts_in_more_tasks(spark):
    from ravelin.operators.graphs import shared_counts

    # one owner has all items, so it is counted in several tasks
    rows = [(o, o % 20) for o in range(1, 200)] + [(0, i) for i in range(20)] + [(o, None) for o in range(5)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "o long, i long")
    want = {(0, b): 1 for b in range(1, 200)} | {(a, b): 1 for a in range(1, 200) for b in range(a + 1, 200) if a % 20 == b % 20}
    for at_once in (50, 500, None):
        found = shared_counts(df, "o", "i", block=7, once=True, at_once=at_once)
        assert {(r.a, r.b): r.shared for r in found.collect()} == want
        both = shared_counts(df, "o", "i", at_once=at_once)
        assert {(r.a, r.b): r.shared for r in both.collect()} == want | {(b, a): n for (a, b), n in want.items()}
    # about 2200 pairs: tasks are as many as these ask for, and what is counted in a task isn't shuffled as pairs
    plan = shared_counts(df, "o", "i", at_once=500)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "_with" in plan


def test_betweenness_matches_all_paths(spark):
    import itertools

    edges = [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 5), (1, 5), (6, 0)]
    both = edges + [(b, a) for a, b in edges]
    near = {k: [b for a, b in both if a == k] for k in range(7)}

    def shortest(a, b):
        ways, found = [[a]], []
        while ways and not found:
            ways = [w + [n] for w in ways for n in near[w[-1]] if n not in w]
            found = [w for w in ways if w[-1] == b]
        return found

    want = dict.fromkeys(range(7), 0.0)
    for a, b in itertools.permutations(range(7), 2):
        ways = shortest(a, b)
        for w in ways:
            for n in w[1:-1]:
                want[n] += 1 / len(ways)
    got = graphs.betweenness(spark.createDataFrame(both, "a long, b long"), "a", "b", spark.range(7).withColumnRenamed("id", "node"))
    assert {r.node: r.score for r in got.collect()} == pytest.approx(want)


def test_groups_gain_modularity(spark):
    clique = lambda k: [(a, b) for a in range(k, k + 5) for b in range(k, k + 5) if a != b]
    pairs = clique(0) + clique(10) + clique(20) + [(0, 10), (10, 0), (11, 20), (20, 11)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w int")
    labels = graphs.parallel_groups(edges, "a", "b", "w")
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(k, k + 5)) for k in (0, 10, 20)]
    m = len(pairs)
    sums = [(20, sum(1 for a, _ in pairs if a // 10 == k)) for k in range(3)]
    assert graphs.modularity(edges, labels, "a", "b", "w").first()[0] == pytest.approx(sum(i / m - (s / m) ** 2 for i, s in sums))


def test_cycles_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 4), (1, 5), (5, 3)], "a long, b long")
    assert [r.chain for r in graphs.cycle(edges, 1, "a", "b").collect()] == [[1, 2, 3, 1]]
    assert [r.chain for r in graphs.cycle(edges, 4, "a", "b").collect()] == [[4, 4]]
    assert graphs.cycle(edges.where("b <> 1"), 1, "a", "b").collect() == []
    assert [r.chain for r in graphs.chains(edges, 1, 3, "a", "b", directed=True).collect()] == [[1, 2, 3], [1, 5, 3]]
    assert [r.chain for r in graphs.chains(edges, 1, 3, "a", "b").collect()] == [[1, 3]]
    with pytest.raises(ValueError):
        graphs.subtree_fold(edges, spark.createDataFrame([(1, 1)], "node long, v long"), "a", "b", "v")


def test_chunks_and_sections(spark):
    from ravelin.functions import texts

    paragraphs = ["a" * 900, "b" * 500, "c" * 99, "d" * 3100, "e" * 10, "f" * 1500, "g"]
    bodies = ["\n \n".join(paragraphs), " short \n\n text ", "", None, "x\ny" * 600, "é" * 1501, "\n\n \n" * 800]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: r.c for r in df.select("id", texts.chunks(df.body).alias("c")).collect()}
    assert got[0] == ["a" * 900 + "\n\n" + "b" * 500, "c" * 99, "d" * 1500, "d" * 1500, "d" * 100 + "\n\n" + "e" * 10, "f" * 1500, "g"]
    assert got[1] == [" short \n\n text "] and got[2] == [""] and got[3] is None and "".join(got[4]) == "x\ny" * 600 and [len(x) for x in got[5]] == [1500, 1] and got[6] == []
    body = "intro\n# One #\nx\n```\n# not a heading\n```\n## Two\n\n### One\ny\n#### deep\nz\n# One\nend"
    other = "## A b!\n~~~\n# c\n~~~\n# Ünï code #tag\n\n   ### C\nlast\n    # indented"
    df = spark.createDataFrame([(1, body), (2, other), (3, ""), (4, None)], "id int, body string")
    got = sorted(tuple(r) for r in texts.sections(df, "id", "body").collect())
    assert got == [
        (1, 0, "", "", "intro"),
        (1, 1, "One", "one", "x\n```\n# not a heading\n```"),
        (1, 2, "One > Two > One", "one-2", "y\n#### deep\nz"),
        (1, 3, "One", "one-3", "end"),
        (2, 0, "A b!", "a-b", "~~~\n# c\n~~~"),
        (2, 1, "Ünï code #tag > C", "c", "last\n    # indented"),
    ]


def test_cells_are_written_and_capped(spark, tmp_path):
    import datetime

    rows = spark.createDataFrame([(datetime.date(2024, m, 1), k, float(k)) for m in (1, 2, 3) for k in range(4)], "period date, k long, v double")
    path = f"file://{tmp_path}/cells"
    with pytest.raises(metrics.TooManyCells):
        metrics.write_cells(metrics.cells(rows, ["period", "k"], F.col("v")), path, most=11)
    metrics.write_cells(metrics.cells(rows, ["period", "k"], F.col("v")), path, most=12)
    left = rows.where("month(period) <> 2 and not (month(period) = 3 and k = 0)")
    metrics.rewrite_periods(path, left, rows.where("month(period) > 1").select("period"), ["period", "k"], F.col("v"))
    got = {(r.period.month, r.k) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3)}


def test_a_large_group_is_several_files(spark, tmp_path):
    from ravelin.sources.tabular import as_file, parsed, read_tabular, write_bytes

    rows = spark.createDataFrame([("a" if k % 10 else "b" if k % 20 else None, k, f"n{k}") for k in range(2000)], "g string, k long, n string")
    files = as_file(rows, "g", "items", most=100)
    found = {r.name: len(parsed(r.content.decode())) for r in files.collect()}
    assert len(found) == 20 and sum(found.values()) == 2000 and max(found.values()) < 200
    assert {"b.json", "None.json"} < set(found)
    write_bytes(files, f"file://{tmp_path}/sent")
    assert sorted(int(r.k) for r in read_tabular(spark, f"file://{tmp_path}/sent", ["k", "n"]).collect()) == list(range(2000))


def test_tables_as_they_are_sent(tmp_path):
    from ravelin.sources.tabular import decoded, parsed

    assert parsed(decoded("﻿a, b\n1,\"x,\"\"y\"\n".encode())) == [{"a": "1", "b": 'x,"y'}]
    assert parsed(decoded("a\tb\n가\t,\n".encode("cp949"))) == [{"a": "가", "b": ","}]
    assert parsed('{"items": [{"a": 1}]}') == parsed('[{"a": 1}]') == [{"a": 1}]
    with pytest.raises(ValueError):
        parsed('{"other": []}')
    with pytest.raises(ValueError):
        decoded(b"\xff\xff\xff")


def test_registries_refuse_and_explain(spark):
    from ravelin.extensions import Registry

    own = Registry()
    own.recipe("r", "k long", lambda columns: None if "v" in columns else "it needs v")(lambda frame: frame[["k"]].head(1))
    with pytest.raises(ValueError, match="already"):
        own.recipe("r", "k long")(lambda frame: frame)
    with pytest.raises(ValueError, match="it needs v"):
        own.run("r", spark.range(3).withColumnRenamed("id", "k"), ["k"])
    assert own.run("r", spark.range(3).selectExpr("id AS k", "id AS v"), ["k"]).count() == 3


def test_one_query_finds_what_many_find(spark):
    from ravelin.operators import vectors

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0")
    exact = vectors.nearest_many(rows, asked, "vec_id", "embedding", 5, -1.0)
    one = rows.where("vec_id = 0").first().embedding
    near = [r.vec_id for r in vectors.nearest(rows.where("vec_id <> 0"), "vec_id", "embedding", one, 5).collect()]
    assert near == [r.found for r in exact.where("query = 0").orderBy("rank").collect()]


def test_ladders_stop_at_the_first_rung(spark):
    from ravelin.operators import matching

    asked = spark.createDataFrame([(1, "AB_1"), (2, "ab_1"), (3, "cd"), (4, "ab"), (5, None)], "id long, text string")
    keys = spark.createDataFrame([("AB_1",), ("aB_1",), ("cd_9",), ("cd_9",)], "k string")
    got = {r.id: (r.found, r.how) for r in matching.key_match(asked, "id", "text", keys, "k").collect()}
    assert got == {1: ("AB_1", "exact"), 2: (None, "several"), 3: ("cd_9", "prefix"), 4: (None, "several"), 5: (None, "none")}


def test_cursors_belong_to_their_filters():
    text = summary.cursor([7, "a"], {"status": "F", "by": ["k"]})
    assert summary.after_cursor(text, {"by": ["k"], "status": "F"}) == [7, "a"]
    for bad, asked in ((text, {"status": "O"}), ("!!", {}), (text[:5], {})):
        with pytest.raises(ValueError):
            summary.after_cursor(bad, asked)


def test_metrics_refuse_what_isnt_a_number(spark):
    rows = spark.sql("SELECT array(1) AS a, date'2024-01-01' AS d, '1e5' AS t, 2 AS n")
    assert rows.select(metrics.value_of(rows, "t"), metrics.value_of(rows, "n")).first()[:] == (None, 2.0)
    for name in ("a", "d"):
        with pytest.raises(ValueError):
            metrics.value_of(rows, name)


def test_percentiles_match_sorting(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 4, 3000), np.round(rng.lognormal(0, 3, 3000), 2))] + [(9, 5.0), (8, 1.0), (8, 1.0), (None, 2.0), (None, 3.0), (7, None)]
    got = {r.k: (r.a, r.b, r.c) for r in summary.percentiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", {"a": 0.0, "b": 0.37, "c": 0.99}, bins=16).collect()}
    keys = {k for k, v in rows if v is not None}
    assert got == {k: tuple(pytest.approx(float(np.percentile([v for g, v in rows if g == k and v is not None], q))) for q in (0, 37, 99)) for k in keys}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_most_alike_compositions(spark, monkeypatch, kind):
    import random

    from ravelin.operators import compositions, graphs

    # strips and counts of a few rows each; a hot item, owners with a missing item only, repeated rows, equal sets and a large owner
    rng = random.Random(7)
    rows = [(o, rng.randrange(25)) for o in range(-40, 60) for _ in range(rng.randrange(1, 6))] + [(o, 99) for o in range(0, 60, 2)]
    rows += [(70 + k, x) for k in range(12) for x in (1, 2)] + [(90, i) for i in range(25)] + [(o, None) for o in (5, 91, 92)] + [(None, 3), (None, None)] + rows[:30]
    if kind == "long":
        rows += [(2**62 + k, i) for k in range(3) for i in (2**62, -(2**62), -(2**62) + 1)]
    own = {}
    for o, i in rows:
        if o is not None:
            own.setdefault(o, set()).add(i)
    want, text = [], (str if kind == "string" else lambda x: x)
    for a, x in own.items():
        scored = []
        for b, y in own.items():
            shared = len((x & y) - {None})
            if a != b and shared:
                union = len(x) + len(y) - shared
                scored.append((-((2_000_000 * shared + union) // (2 * union)), text(b), shared))
        want += [(text(a), b, n, -s / 1e6, k + 1) for k, (s, b, n) in enumerate(sorted(scored)[:4])]
    told = (lambda x: None if x is None else str(x)) if kind == "string" else lambda x: x
    df = spark.createDataFrame([(told(o), told(i)) for o, i in rows], f"o {kind}, i {kind}").repartition(3)
    for least in (2_000_000, 40):
        monkeypatch.setattr(compositions, "STRIP", least)
        found = graphs.composition_similarity(df, "o", "i", 4)
        assert dict(found.dtypes)["a"] == df.dtypes[0][1] and sorted(map(tuple, found.collect())) == sorted(want)
    if kind == "string":
        return
    # only the best of an owner are shuffled: no lists, and one join that reads both sides where they are
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "collect_list" not in plan and plan.count("Exchange ") == 1
    # the same with few places at once, in this process
    monkeypatch.setattr(compositions, "AT_ONCE", 5)
    import pandas as pd

    kept = pd.DataFrame([(o, 0 if i is None else i, i is None) for o, i in rows if o is not None], columns=["_o", "_i", "_none"])
    strips = [next(compositions.strip([kept[kept._o % 3 == k]])) for k in range(3)]
    frames = [pd.DataFrame({"id": x["id"][0], "own": [x["strip"][0]] * 3, "other": [y["strip"][0] for y in strips]}) for x in strips]
    out = pd.concat(compositions.best(frames, 4))
    got = {(r.a, r.b, r.shared) for r in out.itertuples()}
    assert got == {(a, b, n) for a, b, n, _, _ in want}
