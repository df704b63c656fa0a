"""Reachability, chains, near names, weighted tags and vectors against plain Python."""

import math
import random

import pytest

from ravelin.operators import graphs, matching, reachability, tags, vectorindex, vectors


def reached(edges, roots):
    out = {}
    for r in roots:
        seen, todo = set(), [r]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        for n in seen:
            out[n] = out.get(n, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_root_counts(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a < b}
    edges |= {(100 + k, 0) for k in range(5)} | {(k, 59) for k in range(0, 50, 5)}
    if seed:  # cycles: one behind a root, one that no root leads to
        edges |= {(59, 70), (70, 71), (71, 72), (72, 70), (72, 73), (80, 81), (81, 80), (80, 73)}
    df = spark.createDataFrame([*edges, *list(edges)[:5], (7, 7), (None, 3)], "a long, b long")
    targets = {b for _, b in edges}
    want = reached(edges, {a for a, _ in edges} - targets)
    got = reachability.root_counts(df, "a", "b").collect()
    assert {r.node: r.n for r in got} == {n: want.get(n, 0) for n in targets} and len(got) == len(targets)


def test_runs_stay_few_on_trees(spark):
    edges = spark.createDataFrame([(k, k // 3) for k in range(1, 400)], "a long, b long")
    roots = reachability.numbered_roots(graphs._cut(edges.selectExpr("a AS _s", "b AS _d"))).collect()
    place = {r.node: r.lo for r in roots}
    assert sorted(place.values()) == list(range(len(roots)))
    for top in range(1, 14):
        below = sorted(p for n, p in place.items() if any(n // 3**k == top for k in range(8)))
        assert below == list(range(below[0], below[0] + len(below)))


def test_merged_runs(spark):
    runs = spark.createDataFrame([(1, 0, 2), (1, 3, 3), (1, 5, 9), (1, 6, 7), (1, 5, 9), (2, 4, 4)], "k long, lo long, hi long")
    assert sorted(map(tuple, reachability.merged(runs, ["k"]).collect())) == [(1, 0, 3), (1, 5, 9), (2, 4, 4)]


def test_searches_meet(spark):
    # a hub with many leaves beside a chain: the side of the leaf never walks the hub's other leaves
    rows = [(0, 1), (2, 1), (2, 3), (4, 3)] + [(0, 1000 + k) for k in range(500)] + [(4, 5), (5, 6)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = sorted((r.step, r.node) for r in graphs.shortest(df, 6, 1, "a", "b").collect())
    assert got == [(0, 6), (1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]
    seen, length, _, _ = graphs.meeting(df, 6, 1, "a", "b")
    assert length == 5 and sum(s.count() for s in seen) < 12
    assert graphs.shortest(df, 6, 1, "a", "b", depth=4).collect() == [] and graphs.shortest(df, 6, 1, "a", "b", directed=True).collect() == []
    assert [tuple(r) for r in graphs.shortest(df, 3, 3, "a", "b").collect()] == [(0, 3)]
    assert [r.chain for r in graphs.chains(df, 6, 1, "a", "b").collect()] == [[6, 5, 4, 3, 2, 1]]


@pytest.mark.parametrize("seed", range(3))
def test_all_shortest_chains(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(30)}
    found, front = [], [[0]]
    for _ in range(8):
        found = [c for c in front if c[-1] == 29]
        if found:
            break
        front = [[*c, n] for c in front for n in near[c[-1]] if n not in c]
    df = spark.createDataFrame(list(edges), "a long, b long")
    assert sorted({(k, n) for c in found for k, n in enumerate(c)}) == sorted((r.step, r.node) for r in graphs.shortest(df, 0, 29, "a", "b").collect())
    assert [r.chain for r in graphs.chains(df, 0, 29, "a", "b", 8, 3).collect()] == sorted(found)[:3]


def test_depth_has_no_silent_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "s long, d long")
    top = spark.createDataFrame([(0,)], "node long")
    assert graphs.reach(chain, top, "s", "d").count() == 31
    assert graphs.reach(chain, top, "s", "d", 5).count() == 6
    values = spark.createDataFrame([(k, 1) for k in range(31)], "node long, v long")
    assert {r.node: r.n for r in graphs.subtree_fold(chain, values, "s", "d", "v").collect()}[0] == 31


@pytest.mark.parametrize("seed", range(2))
def test_betweenness_of_some_sources(spark, seed):
    # trees that hang from circles, a tree alone, a pair alone, and a circle that no source reaches
    rng = random.Random(seed)
    edges = {(k, rng.randrange(k)) for k in range(1, 40)} | {(rng.randrange(12), rng.randrange(12)) for _ in range(9)}
    edges |= {(50, 51), (51, 52), (51, 53), (60, 61), (70, 71), (71, 72), (72, 70), (80, 80)}
    sources = {k for k in (*range(40), 50, 52, 61) if rng.random() < 0.4} | {61, 99}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in range(81)}
    want = {}
    for s in sources & set(near):
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        share = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
        for x in order[1:]:
            want[x] = want.get(x, 0.0) + share[x]
    drawn = spark.createDataFrame([(s,) for s in sources], "node long")
    df = spark.createDataFrame(list(edges), "a long, b long")
    got = graphs.betweenness(df, "a", "b", drawn).collect()
    assert {r.node: r.score for r in got} == pytest.approx(want) and len(got) == len(want)
    both = df.union(df.selectExpr("b", "a"))
    assert {r.node: r.score for r in graphs.betweenness(both, "a", "b", drawn, directed=True).collect()} == pytest.approx(want)
    # what hangs is never a row of a pair: the circles hold what is walked
    step = graphs._cut(graphs._both_ways(df, "a", "b").where("_s <> _d").distinct())
    left = graphs._without_hanging(step, step.selectExpr("_s AS node", "0L AS mine", "1L AS t", "0L AS s", "0L AS a", "0L AS b").distinct())[1]
    assert left.count() < 25 and left.agg({"t": "sum"}).first()[0] == len([n for n in near if near[n] - {n}])


def grams(text):
    out = []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        p = f"  {w} "
        out += [p[i : i + 3] for i in range(len(p) - 2)]
    return out


def test_names_within_longer_names(spark):
    names = ["blue bolt", "light blue bolt of steel", "bolt", "reed", "red gear", "gear-red", "", "büro-stuhl", "aaaa", None, "blue bolt"]
    asked = {1: "blue bolt", 2: "gear red", 3: "stuhl", 4: "aaaaa", 5: "", 6: "zzz"}

    def best(q, o):
        q = set(grams(q))
        runs = [set(o)] + [set(o[a:b]) for a in range(len(o)) for b in range(a + 1, len(o) + 1)]
        return max((len(r & q) / len(r | q) for r in runs if r | q), default=0)

    want = {(i, n): best(t, grams(n)) for i, t in asked.items() for n in names if n is not None}
    want = {k: v for k, v in want.items() if v >= 0.3}
    got = matching.near_names(spark.createDataFrame(list(asked.items()), "id long, asked string"), "id", "asked", spark.createDataFrame([(n,) for n in names], "name string"), "name", 0.3)
    rows = got.collect()
    assert {(r.id, r.name): pytest.approx(r.similarity) for r in rows} == want and len(rows) == len(want)
    assert want[1, "light blue bolt of steel"] == 1.0


@pytest.mark.parametrize("rare", [1, 3, 1000])
def test_nearest_by_tags(spark, rare):
    rng = random.Random(rare)
    rows = [(k, f"t{min(int(rng.expovariate(0.25)), 30)}") for k in range(120) for _ in range(rng.randrange(1, 6))]
    rows += [(k, "hub") for k in range(0, 120, 2)] + [(k, "all") for k in range(120)] + [(200 + k, x) for k in range(15) for x in ("t1", "hub")] + [(300, "all"), (None, "t1"), (5, None)] + rows[:9]
    own = {}
    for k, t in rows:
        if k is not None and t is not None:
            own.setdefault(k, set()).add(t)
    df = {}
    for s in own.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    w = {t: round(math.log(len(own) / n) * 1e6) for t, n in df.items()}
    want = []
    for a in own:
        scored = []
        for b in own:
            shared = sum(w[t] for t in own[a] & own[b])
            if a != b and shared > 0:
                scored.append((-shared / sum(w[t] for t in own[a] | own[b]), b))
        want += [(a, b, -s, k + 1) for k, (s, b) in enumerate(sorted(scored)[:4])]
    got = tags.nearest_by_tags(spark.createDataFrame(rows, "id long, tag string"), "id", "tag", 4, rare)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_common_tags_make_no_rows_of_pairs(spark, monkeypatch):
    # 900 sets that all share tags: half a million pairs, of which a cell gives the best of each set only
    rows = [(k, f"{x}{k // m % n}") for k in range(900) for x, m, n in (("a", 1, 10), ("b", 10, 9), ("c", 90, 10))]
    met = []

    def told(*args, own=tags._met):
        met.append(own(*args))
        return met[-1]

    monkeypatch.setattr(tags, "_met", told)
    monkeypatch.setattr(tags, "BLOCK", 40)
    got = tags.nearest_by_tags(spark.createDataFrame(rows, "id long, tag string"), "id", "tag", 5, 20)
    assert got.groupBy("id").count().where("count = 5").count() == 900 and met
    assert sum(m.count() for m in met) <= 900 * 3 * 5 * 3


def test_equal_vectors_and_repeated_ids(spark):
    a, b, z = [1.0, 0.0], [0.6, 0.8], [0.0, 0.0]
    rows = spark.createDataFrame([(0, a), (1, a), (2, b), (3, a), (4, z), (5, None), (2, b)], "id long, v array<double>")
    got = vectors.nearest_many(rows, rows, "id", "v", 5, 0.1).collect()
    best = {(r.query, r.rank): (r.found, round(r.score, 6), r.same) for r in got}
    # of three equal vectors the smallest other one stands for all, and says how many there are
    assert best == {(0, 1): (1, 1.0, 3), (0, 2): (2, 0.6, 1), (1, 1): (0, 1.0, 3), (1, 2): (2, 0.6, 1), (2, 1): (0, 0.6, 3), (3, 1): (0, 1.0, 3), (3, 2): (2, 0.6, 1)}
    asked = spark.createDataFrame([(9, a), (9, b), (9, [0.0, 1.0])], "id long, v array<double>")
    small = vectors.nearest_many(rows, asked, "id", "v", 5, 0.1, block=1).collect()
    assert {(r.found, round(r.score, 6)) for r in small} == {(0, 1.0), (2, 1.0)}
    assert vectors.nearest_many(rows, asked.where("false"), "id", "v", 5).collect() == []


def test_index_reads_few_lists_of_clustered_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(k, [float(x) for x in centres[k % 12] * 4 + rng.normal(size=24)]) for k in range(1500)] + [(5000, None), (5001, [0.0] * 24)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.where("id % 25 = 0")
    index = vectorindex.Index(df, "id", "v")
    found = index.search(asked, 5)
    share = vectors.recall(found, vectors.nearest_many(df, asked, "id", "v", 5, -1.0)).first().recall
    assert share >= 0.9 and index.scored_share() < 0.1 and index.read_share() < 0.5
    assert index.rows.count() == 1500 and found.where("query = found").isEmpty()
    empty = vectorindex.Index(df.where("false"), "id", "v")
    assert empty.search(asked, 5).collect() == []


def test_index_scores_few_rows_of_scattered_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = df.where("vec_id % 50 = 0")
    index = vectorindex.Index(df, "vec_id", "embedding")
    share = vectors.recall(index.search(asked, 5), vectors.nearest_many(df, asked, "vec_id", "embedding", 5, -1.0)).first().recall
    assert share >= 0.9 and index.scored_share() < 0.1


def test_a_task_keeps_the_best_rows_whatever_reaches_the_floor():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(9)
    v, asked = rng.normal(size=(20_000, 16)), rng.normal(size=(200, 16))
    v[3000:9000] = v[0]  # copies: the smallest ids stay
    codes, units = vectorindex.Codes(vectors._unit(pd.Series(list(v[:500])))), vectors._unit(pd.Series(list(asked)))
    ids, into, floors = np.arange(200) * 50, np.ones((200, 4), bool), np.full(200, -np.inf)

    def run(n):
        frames = (pd.DataFrame({"list": np.arange(k, k + 2000) // 500 % 4, "id": np.arange(k, k + 2000), "code": [c.tobytes() for c in codes.encode(vectors._unit(pd.Series(list(v[k : k + 2000]))))], "v": list(v[k : k + 2000])}) for k in range(0, n, 2000))
        tracemalloc.start()
        out = pd.concat(vectorindex.best_rows(frames, ids, units, into, floors, codes, 5))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    _, few = run(4000)
    out, most = run(20_000)
    assert most < 1.3 * few and out.scored.sum() == 200 * 20_000 - 200
    out = out.dropna(subset=["query"])
    exact = np.round(units @ vectors._unit(pd.Series(list(v))).T, 12)
    exact[np.arange(200), ids] = -np.inf
    for q, own in out.groupby("query"):
        assert own.found.tolist() == np.lexsort((np.arange(20_000), -exact[q // 50]))[:5].tolist()


def test_floors_of_an_index_that_is_fitted_to_some_rows(spark, monkeypatch):
    monkeypatch.setattr(vectorindex, "SAMPLE", 400)
    import numpy as np

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(150, 16))
    df = spark.createDataFrame([(k, [float(x) for x in centres[k % 150] * 2 + rng.normal(size=16)]) for k in range(4000)], "id long, v array<double>")
    asked = df.where("id % 25 = 0")
    index = vectorindex.Index(df, "id", "v", short=200)
    found = index.search(asked, 5)
    share = vectors.recall(found, vectors.nearest_many(df, asked, "id", "v", 5, -1.0)).first().recall
    assert share >= 0.9 and 200 / 4000 < index.scored_share() < 0.15


@pytest.mark.parametrize("directed", [False, True])
def test_paths_of_many_sources_are_no_rows(spark, monkeypatch, directed):
    from ravelin.operators import pathcounts

    # a net without hanging trees, a hub with more links than are summed one by one, and sources in several batches
    rng = random.Random(4)
    edges = {(k, (k + 1) % 300) for k in range(300)} | {(rng.randrange(300), rng.randrange(300)) for _ in range(60)} | {(300, k) for k in range(0, 300, 4)} | {(k, 300) for k in range(0, 300, 5)}
    df = spark.createDataFrame(list(edges), "a long, b long")
    sources = spark.createDataFrame([(k,) for k in range(301)], "node long")
    cut, rows = graphs._cut, []

    def counted(frame):
        out = cut(frame)
        rows.append(out.count())
        return out

    scores = lambda: {r.node: r.score for r in graphs.betweenness(df, "a", "b", sources, directed).collect()}
    monkeypatch.setattr(graphs, "HELD", 0)
    want = scores()
    monkeypatch.undo()
    monkeypatch.setattr(graphs, "_cut", counted)
    assert scores() == pytest.approx(want) and len(want) == 301
    # pairs of sources and nodes would be 90,000
    assert max(rows) <= 2 * len(edges)
    ends = [[x for x, _ in sorted(edges)], [y for _, y in sorted(edges)]]
    size, mass = [1.0] * 301, [k % 3 for k in range(301)]
    import numpy as np

    args = (*map(np.array, ends), np.array(size), np.array(mass), np.arange(301))
    one = pathcounts.through(*args)
    monkeypatch.setattr(pathcounts, "MEMORY", 0)
    monkeypatch.setattr(pathcounts, "FEW", 3)
    monkeypatch.setattr(pathcounts, "ROWS", 7)
    for x, y in zip(one, pathcounts.through(*args), strict=True):
        assert x == pytest.approx(y)
