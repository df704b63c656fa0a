"""Graph operators as frontier loops: each round is one join of the new rows with the edges, and lineage is cut by checkpoints.

A frontier holds new nodes only, so a node is expanded once, and nothing but the number of new
rows comes back to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window


#: Steps after which what has been seen is one table again instead of a union of steps.
KEPT_STEPS = 8
#: Pairs that a task counts at about, for each of which its hash table may hold a row.
PAIRS_AT_ONCE = 4_000_000
#: Edges that a task holds at most, to count paths over them.
HELD = 4_000_000


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the folder that the session names, which survives lost executors; only a local session, as
    in tests, may do without the setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        from ravelin.sources.files import scratch

        context.setCheckpointDir(scratch(df.sparkSession).rsplit("/", 1)[0])
    return df.checkpoint()


def _merged(df: DataFrame) -> DataFrame:
    """For joins in rounds: a side that turns out small would be broadcast in every round anew, and all of that passes through the driver, so
    these joins sort both sides."""
    return df.hint("merge")


def reach(edges: DataFrame, roots: DataFrame, src: str, dst: str, depth: int | None = None) -> DataFrame:
    """(node, depth): everything that the nodes of ``roots`` (node) reach, themselves included, at its smallest depth; within ``depth`` steps,
    if given, else however far it is. A node is expanded once, so cycles end."""
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()))
    seen = _cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("_s")).select(F.col("_d").alias("node")).distinct()
        frontier = _cut(new.join(_merged(seen), "node", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if k % KEPT_STEPS == 0:
            seen = _cut(seen)
    return seen


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(root, node, depth): all pairs of a node and what it reaches over one edge or more, at the smallest depth, however far it is."""
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()))
    seen = _cut(step.select(F.col("_s").alias("root"), F.col("_d").alias("node"), F.lit(1).alias("depth")))
    frontier = seen
    for k in count(2):
        new = frontier.join(step, F.col("node") == F.col("_s")).select("root", F.col("_d").alias("node")).distinct()
        frontier = _cut(new.join(_merged(seen), ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if k % KEPT_STEPS == 0:
            seen = _cut(seen)
    return seen


def levels(edges: DataFrame, roots: DataFrame, src: str, dst: str, level: int) -> DataFrame:
    """(node, ancestor): the ancestor of each node at a level, however far below; of several paths the shortest counts, then the smallest
    ancestor."""
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()))
    start = reach(edges, roots, src, dst, level).where(F.col("depth") == level).select("node")
    seen = _cut(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("d")))
    frontier = seen
    for k in count(1):
        new = frontier.join(step, F.col("node") == F.col("_s")).groupBy(F.col("_d").alias("node")).agg(F.min("ancestor").alias("ancestor"))
        frontier = _cut(new.join(_merged(seen), "node", "left_anti").withColumn("d", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if k % KEPT_STEPS == 0:
            seen = _cut(seen)
    return seen.select("node", "ancestor")


def explosion(edges: DataFrame, root, src: str, dst: str, qty: str, depth: int = 20) -> DataFrame:
    """(node, quantity, paths, min_level, max_level): quantities multiplied along paths and summed over them.

    Paths are folded level by level (one row for each node and level), never listed. A cycle would go on to ``depth``; then it raises.
    """
    spark = edges.sparkSession
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(qty).alias("_q"))))
    level = spark.createDataFrame([(root,)], "node long").withColumn("quantity", F.lit(1).cast("long")).withColumn("paths", F.lit(1).cast("long"))
    out = None
    for k in range(1, depth + 1):
        level = _cut(level.join(step, F.col("node") == F.col("_s")).groupBy(F.col("_d").alias("node")).agg(F.sum(F.col("quantity") * F.col("_q")).alias("quantity"), F.sum("paths").alias("paths")))
        if level.isEmpty():
            break
        now = level.withColumn("level", F.lit(k))
        out = now if out is None else out.union(now)
    else:
        raise ValueError(f"the structure of {root} is deeper than {depth} levels; it may hold a cycle")
    if out is None:
        return level.select("node", "quantity", "paths", F.lit(0).alias("min_level"), F.lit(0).alias("max_level")).where("false")
    return out.groupBy("node").agg(F.sum("quantity").alias("quantity"), F.sum("paths").alias("paths"), F.min("level").alias("min_level"), F.max("level").alias("max_level"))


def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    there = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
    return there.union(there.select(F.col("_d").alias("_s"), F.col("_s").alias("_d")))


def meeting(edges: DataFrame, start, end, src: str, dst: str, depth: int = 8, directed: bool = False) -> tuple[list[DataFrame], int, DataFrame, DataFrame]:
    """([seen from the start, seen from the end], length, edges ahead, edges back): two searches of which the one with the smaller frontier
    takes the next step, until a node is seen by both or ``depth`` steps are done (then the length is -1).

    Only whole steps are taken, so the first meeting is on a shortest chain.
    """
    spark, kind = edges.sparkSession, edges.schema[src].dataType.simpleString()
    there = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")) if directed else _both_ways(edges, src, dst)
    ahead = _merged(_cut(there.where("_s is not null and _d is not null").distinct()))
    steps = [ahead, ahead.select(F.col("_d").alias("_s"), F.col("_s").alias("_d"))]
    seen = [_cut(spark.createDataFrame([(x,)], f"node {kind}").withColumn("depth", F.lit(0))) for x in (start, end)]
    frontier, size, done = list(seen), [1, 1], [0, 0]
    if start == end:
        return seen, 0, *steps
    while sum(done) < depth and min(size):
        k = 0 if size[0] <= size[1] else 1
        done[k] += 1
        new = frontier[k].join(steps[k], F.col("node") == F.col("_s")).select(F.col("_d").alias("node")).distinct()
        frontier[k] = _cut(new.join(_merged(seen[k]), "node", "left_anti").withColumn("depth", F.lit(done[k])))
        size[k] = frontier[k].count()
        seen[k] = seen[k].union(frontier[k])
        if size[k] and not frontier[k].join(_merged(seen[1 - k]), "node", "left_semi").isEmpty():
            return seen, sum(done), *steps
    return seen, -1, *steps


def shortest(edges: DataFrame, start, end, src: str, dst: str, depth: int = 8, directed: bool = False) -> DataFrame:
    """(step, node): the nodes on all shortest chains between two nodes, at most ``depth`` edges; edges count in both directions unless
    ``directed``. From where the two searches meet, each side is walked back over its own depths."""
    seen, length, ahead, back = meeting(edges, start, end, src, dst, depth, directed)
    if length < 0:
        return seen[0].select(F.col("depth").alias("step"), "node").where("false")
    met = seen[0].join(_merged(seen[1]).select("node", F.col("depth").alias("_o")), "node").where(F.col("depth") + F.col("_o") == length)
    met = _cut(met.select(F.col("depth").alias("step"), "node"))
    first = met.first()
    if first is None:
        return met
    out = met
    # all meetings are at one step, since only one side moved last
    for side, step, steps, sign in ((seen[0], first["step"], back, -1), (seen[1], length - first["step"], ahead, 1)):
        here = met.select("node")
        for k in range(step - 1, -1, -1):
            near = here.join(steps, F.col("node") == F.col("_s")).select(F.col("_d").alias("node")).distinct()
            here = _cut(side.where(F.col("depth") == k).select("node").join(_merged(near), "node", "left_semi"))
            out = out.union(here.select(F.lit(k if sign < 0 else length - k).alias("step"), "node"))
    return out


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    ends = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col(dst), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def fan_out(edges: DataFrame, src: str, dst: str, cap: int) -> DataFrame:
    """At most ``cap`` neighbours of each node, the first by id (a feature of the screen, not of the join)."""
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(src).orderBy(dst))).where(F.col("_r") <= cap).drop("_r")


def shared_counts(items: DataFrame, owner: str, item: str, block: int = 1000, once: bool = False, at_once: int | None = None) -> DataFrame:
    """(a, b, shared): the number of common items of every two owners that have one; each pair both ways, or ``once`` (a < b).

    An owner goes to a task with the lists of its items' owners, so pairs are counted where they arise and never shuffled as rows. There are
    as many tasks as pairs ask for, and an owner with more than ``at_once`` of them is counted in several. The owners of an item with more
    than ``block`` of them meet in blocks, each with all others, so no item is one task's work however many owners it has.
    """
    spark, at_once = items.sparkSession, at_once or PAIRS_AT_ONCE
    own = _cut(items.select(F.col(owner).alias("_o"), F.col(item).alias("_i")).where("_o is not null and _i is not null").distinct())
    met = own.groupBy("_i").agg(F.count("*").alias("_n"))
    own = _cut(own.join(met, "_i"))
    # every place of an owner in an item stands for as many pairs as the item has owners
    loads = _cut(own.groupBy("_o").agg(F.sum("_n").alias("_m")))
    pairs, most = loads.agg(F.sum("_m"), F.max("_m")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // at_once))
    blocks = F.ceil(F.col("_n") / F.lit(float(block))).cast("int")
    lists = own.groupBy("_i", F.pmod(F.xxhash64("_o"), blocks).cast("int").alias("_k")).agg(F.collect_list("_o").alias("_with"))
    left = own.select("_i", F.col("_o").alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_k"))
    each = left.join(lists, ["_i", "_k"]).withColumn("_with", F.filter("_with", lambda x: x > F.col("a") if once else x != F.col("a"))).where(F.size("_with") > 0)
    if (most or 0) <= at_once:
        return each.select("a", "_with").repartition(parts, "a").select("a", F.explode("_with").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    large = loads.where(F.col("_m") > at_once).select(F.col("_o").alias("a"), F.ceil(F.col("_m") / F.lit(float(at_once))).alias("_m"))
    each = each.join(large, "a", "left").withColumn("_s", F.pmod(F.xxhash64("_i", "_k"), F.coalesce("_m", F.lit(1))))
    counts = each.select("a", "_s", "_with").repartition(parts, "a", "_s").select("a", "_s", F.explode("_with").alias("b")).groupBy("a", "_s", "b").agg(F.count("*").alias("shared"))
    return counts.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def composition_similarity(items: DataFrame, owner: str, item: str, top: int) -> DataFrame:
    """(a, b, shared, similarity, rank): Jaccard similarity of owners by their distinct items, the ``top`` for each. Of owners and items that are whole
    numbers pairs are counted in strips (``compositions``), of others from lists."""
    if all(isinstance(items.schema[x].dataType, IntegralType) for x in (owner, item)):
        from ravelin.operators.compositions import nearest

        kind = items.schema[owner].dataType
        out = nearest(items, owner, item, top).withColumns({x: F.col(x).cast(kind) for x in ("a", "b")})
    else:
        sizes = items.select(owner, item).distinct().groupBy(owner).agg(F.count("*").alias("n"))
        out = shared_counts(items, owner, item).join(sizes.select(F.col(owner).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(owner).alias("b"), F.col("n").alias("nb")), "b")
    out = out.withColumn("similarity", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("a", "b", "shared", "similarity", "rank")


def modularity(edges: DataFrame, labels: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """One row: how much more weight lies within the groups of ``labels`` (node, label) than chance would put there; edges both ways."""
    own = edges.select(F.col(a).alias("node"), F.col(b).alias("_other"), F.col(weight).alias("_w")).join(labels, "node")
    own = own.join(labels.select(F.col("node").alias("_other"), F.col("label").alias("_far")), "_other")
    groups = own.groupBy("label").agg(F.sum("_w").alias("_all"), F.sum(F.when(F.col("label") == F.col("_far"), F.col("_w")).otherwise(0)).alias("_in"))
    whole = groups.agg(F.sum("_all").alias("_m"))
    return groups.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("_in") / F.col("_m") - F.pow(F.col("_all") / F.col("_m"), F.lit(2))).alias("modularity"))


def parallel_groups(edges: DataFrame, a: str, b: str, weight: str, rounds: int = 12) -> DataFrame:
    """(node, label) of groups with high modularity: every node moves to the neighbouring group that gains most, in parallel.

    Only the nodes of one half (by hash and round) move at a time, since neighbours that move together may swap for ever. Edges are given
    in both directions. Ties go to the smallest label. A round is three joins on written tables and map-side-combined sums, so a node
    with a third of all edges is split.
    """
    own = _cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col(weight).cast("double").alias("w")).where("node <> other"))
    degree = _cut(own.groupBy("node").agg(F.sum("w").alias("k")))
    labels = _cut(degree.select("node", F.col("node").alias("label")))
    mass = degree.agg(F.sum("k")).first()[0] or 1.0
    still = 0
    for turn in range(rounds):
        total = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("kc"))
        into = own.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("w").alias("w"))
        here = labels.select("node", F.col("label").alias("now"))
        moves = into.where(F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2).join(here, "node").join(degree, "node").join(total, "label")
        # the node's own weight doesn't count for the group it is in
        rest = F.col("kc") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
        moves = moves.withColumn("gain", F.col("w") - F.col("k") * rest / mass)
        best = moves.groupBy("node").agg(F.max_by(F.struct("label", "gain"), F.struct("gain", -F.col("label"))).alias("best"), F.max(F.when(F.col("label") == F.col("now"), F.col("gain"))).alias("stay"))
        # a node alone in its group gains nothing by staying
        best = best.where(F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12).select("node", F.col("best.label").alias("to"))
        labels = _cut(labels.join(best, "node", "left").select("node", F.coalesce("to", "label").alias("label"), (F.col("to").isNotNull() & (F.col("to") != F.col("label"))).alias("moved")))
        still = 0 if not labels.where("moved").isEmpty() else still + 1
        labels = labels.select("node", "label")
        if still == 2:
            break
    return labels


def _without_hanging(step: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(edges, nodes, [hanging nodes of each round]) of a graph with edges both ways, less the trees that hang from it: in rounds, what has one
    neighbour only goes to it (``up``), with its number of nodes ``t`` and sources ``s``. ``a`` and ``b`` are sums over what came to a node: of its
    sources, and of these times its size and one.

    Rounds end when fewer than a hundredth of the nodes hang, so a long chain isn't taken off link by link; the sums hold after any round.
    """
    off = []
    while True:
        ends = _cut(step.groupBy("_s").agg(F.count("*").alias("_n"), F.min("_d").alias("up")).where("_n = 1").select(F.col("_s").alias("node"), "up"))
        # of two nodes that have only each other the smaller one stays
        ends = _cut(ends.join(_merged(ends.select(F.col("up").alias("node"), F.col("node").alias("up")).where("node < up")), ["node", "up"], "left_anti"))
        if ends.count() * 100 <= nodes.count():
            return step, nodes, off
        off.append(_cut(ends.join(_merged(nodes), "node")))
        more = off[-1].groupBy(F.col("up").alias("node")).agg(F.sum("t").alias("_t"), F.sum("s").alias("_s"), F.sum(F.col("s") * (F.col("t") + 1)).alias("_b"))
        add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        nodes = _cut(nodes.join(_merged(ends), "node", "left_anti").join(_merged(more), "node", "left").select("node", "mine", add("t", "_t"), add("s", "_s"), add("a", "_s"), add("b", "_b")))
        gone = _merged(ends.select("node"))
        step = _cut(step.join(gone.withColumnRenamed("node", "_s"), "_s", "left_anti").join(gone.withColumnRenamed("node", "_d"), "_d", "left_anti").select("_s", "_d"))


def _sums_in_tasks(step: DataFrame, nodes: DataFrame, directed: bool) -> DataFrame:
    """(node, through, reached, size) as sums over the sources; every task holds all edges, which it reads from the shared folder, and walks from its
    part of the sources."""
    from ravelin.operators import pathcounts

    spark = step.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism
    edges = step.join(_merged(nodes.select(F.col("node").alias("_s"), F.col("s").alias("mass"))), "_s").join(_merged(nodes.select(F.col("node").alias("_d"), F.col("t").cast("double").alias("size"))), "_d")
    edges = _cut(edges.select("_s", "mass", "_d", "size"))
    each = spark.range(0, parts, 1, parts).withColumnRenamed("id", "part").crossJoin(edges.coalesce(1).hint("shuffle_replicate_nl"))
    found = each.mapInPandas(lambda frames: pathcounts.of_part(frames, parts), f"node {nodes.schema['node'].dataType.simpleString()}, through double, reached long, size double")
    # the size of a root is missing elsewhere, and NaN isn't null
    return found.groupBy("node").agg(F.sum("through").alias("through"), F.sum("reached").alias("reached"), F.max(F.when(~F.isnan("size"), F.col("size"))).alias("size"))


def _sums_by_joins(step: DataFrame, nodes: DataFrame, directed: bool) -> DataFrame:
    """The same for more edges than a task holds: levels of all sources at once, each a join of the one before with the edges."""
    ahead = _merged(step)
    level = _cut(nodes.where("s > 0").select(F.col("node").alias("root"), "node", F.lit(1.0).alias("paths"), F.col("s").alias("mass")))
    levels_ = []
    while not level.isEmpty():
        levels_.append(level)
        new = level.join(ahead, F.col("node") == F.col("_s")).select("root", F.col("_d").alias("node"), "paths", "mass", F.lit(False).alias("_old"))
        # both ways, what is near a level and was seen before lies in it or in the one before
        for seen in levels_ if directed else levels_[-2:]:
            new = new.union(seen.withColumn("_old", F.lit(True)))
        new = new.groupBy("root", "node").agg(F.sum("paths").alias("paths"), F.max("mass").alias("mass"), F.max("_old").alias("_old"))
        level = _cut(new.where("not _old").drop("_old"))
    if not levels_:
        return nodes.select("node", F.lit(0.0).alias("through"), F.lit(0).cast("long").alias("reached"), F.lit(0.0).alias("size")).where("false")

    back = _merged(_cut(step.join(_merged(nodes.select(F.col("node").alias("_d"), F.col("t").alias("_t"))), "_d")))
    below = levels_[-1].withColumn("share", F.lit(0.0))
    whole = below
    for upper in reversed(levels_[:-1]):
        sent = below.join(back, F.col("node") == F.col("_d")).select("root", F.col("_s").alias("node"), F.lit(None).cast("double").alias("paths"), F.lit(None).cast("long").alias("mass"), ((F.col("_t") + F.col("share")) / F.col("paths")).alias("x"))
        both = upper.withColumn("x", F.lit(0.0)).union(sent).groupBy("root", "node").agg(F.max("paths").alias("paths"), F.max("mass").alias("mass"), F.sum("x").alias("x"))
        below = _cut(both.where("paths is not null").select("root", "node", "paths", "mass", (F.col("paths") * F.col("x")).alias("share")))
        whole = whole.union(below)
    far = F.col("root") != F.col("node")
    # a root's own share is the size of all that it reaches
    return whole.groupBy("node").agg(F.sum(F.when(far, F.col("mass") * F.col("share"))).alias("through"), F.sum(F.when(far, F.col("mass"))).alias("reached"), F.max(F.when(~far, F.col("share"))).alias("size"))


def betweenness(edges: DataFrame, src: str, dst: str, sources: DataFrame, directed: bool = False) -> DataFrame:
    """(node, score): the share of shortest paths from the ``sources`` (node) to all others that a node lies on, summed over them; edges count
    in both directions unless ``directed``. Nodes that no other source reaches aren't listed.

    Path counts go out level by level, for many sources at once, and dependencies come back the same way: in tasks that hold all edges, or by
    joins if there are more than ``HELD``. Trees that hang from the rest have one way in, so what they add is counted without paths, and their
    sources start where they hang. With a sample of sources the sums are estimates, to be scaled by the share that was drawn. Pairs of sources and
    nodes are as many as there are, the square of the graph; in tasks they are never rows.
    """
    step = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")) if directed else _both_ways(edges, src, dst)
    step = _cut(step.where("_s <> _d").distinct())
    drawn = sources.select("node", F.lit(1).cast("long").alias("mine")).distinct()
    nodes = step.select(F.explode(F.array("_s", "_d")).alias("node")).distinct().join(_merged(drawn), "node", "left").withColumn("mine", F.coalesce("mine", F.lit(0)))
    nodes = _cut(nodes.select("node", "mine", F.lit(1).cast("long").alias("t"), F.col("mine").alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    step, nodes, off = (step, nodes, []) if directed else _without_hanging(step, nodes)

    sums = (_sums_in_tasks if step.count() <= HELD else _sums_by_joins)(step, nodes, directed)
    zero = lambda x: F.coalesce(x, F.lit(0))
    at = _cut(nodes.join(_merged(sums), "node", "left").withColumns({"all": zero("reached") + F.col("s"), "n": zero("size") + F.col("t"), "through": F.coalesce("through", F.lit(0.0))}).drop("reached", "size"))
    for hung in reversed(off):
        # what hung in a round may hang from what went in any later one
        at = _cut(at.unionByName(hung.join(_merged(at.select(F.col("node").alias("up"), "all", "n")), "up").drop("up").withColumn("through", F.lit(0.0))))
    hanging = F.col("a") * F.col("n") - F.col("b") + (F.col("all") - F.col("s")) * (F.col("t") - 1)
    return at.where("all > mine").select("node", (F.col("through") + hanging).alias("score"))


def indented(edges: DataFrame, root, src: str, dst: str, qty: str) -> DataFrame:
    """(path, level, node, quantity): one line for every path from the root, as a parts list shows it; quantities multiply along it.

    All lines are listed, however many and deep; a path that comes back to one of its own nodes is a cycle and raises.
    """
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(qty).alias("_q"))))
    level = _cut(edges.sparkSession.createDataFrame([(root,)], "node long").select(F.array("node").alias("path"), "node", F.lit(1).cast("long").alias("quantity")))
    out = None
    for k in count(1):
        level = level.join(step, F.col("node") == F.col("_s")).select(F.concat("path", F.array("_d")).alias("path"), F.col("_d").alias("node"), (F.col("quantity") * F.col("_q")).alias("quantity"), F.array_contains("path", F.col("_d")).alias("_again"))
        level = _cut(level)
        lines = level.agg(F.count("*").alias("n"), F.max(F.struct("_again", "node")).alias("last")).first()
        if not lines.n:
            break
        if lines.last["_again"]:
            raise ValueError(f"the parts list of {root} holds a cycle through {lines.last['node']}")
        level = level.drop("_again")
        now = level.withColumn("level", F.lit(k))
        out = now if out is None else out.union(now)
    return (level.withColumn("level", F.lit(0)) if out is None else out).select("path", "level", "node", "quantity")


def chains(edges: DataFrame, start, end, src: str, dst: str, depth: int = 8, first: int = 5, directed: bool = False) -> DataFrame:
    """(chain): the first shortest chains between two nodes, in the order of their nodes; at most ``depth`` edges, in both directions
    unless ``directed``.

    Only nodes that lie on a shortest chain are walked, so every partial chain can be finished and the first of each step are enough.
    """
    on = _cut(shortest(edges, start, end, src, dst, depth, directed))
    step = _merged(_cut((edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")) if directed else _both_ways(edges, src, dst)).distinct()))
    last = on.agg(F.max("step")).first()[0]
    kind = edges.schema[src].dataType.simpleString()
    at = edges.sparkSession.createDataFrame([(start,)], f"node {kind}").select(F.array("node").alias("chain"), "node")
    if last is None:
        return at.select("chain").where("false")
    for k in range(1, last + 1):
        next_ = on.where(F.col("step") == k).select(F.col("node").alias("_d"))
        at = at.join(step, F.col("node") == F.col("_s")).join(_merged(next_), "_d").select(F.concat("chain", F.array("_d")).alias("chain"), F.col("_d").alias("node"))
        at = _cut(at.orderBy("chain").limit(first))
    return at.select("chain")


def cycle(edges: DataFrame, start, src: str, dst: str, depth: int = 20) -> DataFrame:
    """(chain): the first shortest chain that leads from a node back to it; no row if there is none of ``depth`` edges."""
    kind = edges.schema[src].dataType
    back = edges.where(F.col(dst) == F.lit(start)).select(F.col(src), F.lit(None).cast(kind).alias(dst))
    # the way back ends in a node of its own, so that the chain may begin and end with the same one
    goal = edges.where(F.col(dst) != F.lit(start)).select(src, dst)
    ends = back.select(F.col(src).alias("node")).distinct()
    ahead = _cut(reach(goal, edges.sparkSession.createDataFrame([(start,)], f"node {kind.simpleString()}"), src, dst, depth - 1).join(ends, "node"))
    best = ahead.orderBy("depth", "node").limit(1).collect()
    if not best:
        return ahead.select(F.array("node").alias("chain")).where("false")
    return chains(goal, start, best[0].node, src, dst, depth, 1, directed=True).select(F.concat("chain", F.array(F.lit(start).cast(kind))).alias("chain")) if best[0].depth else ahead.limit(1).select(F.array(F.lit(start).cast(kind), F.lit(start).cast(kind)).alias("chain"))


def subtree_fold(edges: DataFrame, values: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """(node, n, sum, min, max, avg, log_product) of the values (node, value) of each node's whole subtree, itself included.

    Folded from the leaves up, one level a round, so a node is sent once to its parent. Edges must form trees: a node with two parents
    raises, as its values would count twice. ``log_product`` is the sum of the logarithms of positive values.
    """
    step = _merged(_cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).distinct()))
    if not step.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a node has more than one parent")
    v = F.col(value).cast("double")
    own = values.groupBy("node").agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(F.log(F.when(v > 0, v))).alias("log"))
    tops = step.select(F.col("_s").alias("node")).distinct().join(step.select("node"), "node", "left_anti")
    at = _cut(reach(step.withColumnRenamed("node", "_d"), tops.union(own.select("node").join(step.select("node"), "node", "left_anti").join(_merged(tops), "node", "left_anti")), "_s", "_d"))
    deepest = at.agg(F.max("depth")).first()[0] or 0
    placed = _cut(at.join(_merged(own), "node", "left"))
    merge = [F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("log").alias("log")]
    below, out = None, []
    for k in range(deepest, -1, -1):
        here = placed.where(F.col("depth") == k).drop("depth")
        here = _cut(here if below is None else here.unionByName(below.join(step, "node").select(F.col("_s").alias("node"), "n", "sum", "min", "max", "log")).groupBy("node").agg(*merge))
        out.append(here)
        below = here
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole.select("node", F.coalesce("n", F.lit(0)).alias("n"), "sum", "min", "max", F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("avg"), F.col("log").alias("log_product"))


def inferred(triples: DataFrame, inverse: list[tuple[str, str]], transitive: list[str], subclass: DataFrame | None = None) -> DataFrame:
    """(s, p, o) with what follows: inverse properties both ways, transitive properties closed, and types of all classes above (s, o)."""
    out = triples.select("s", "p", "o")
    for a, b in inverse:
        out = out.union(out.where(F.col("p") == a).select(F.col("o").alias("s"), F.lit(b).alias("p"), F.col("s").alias("o"))).union(out.where(F.col("p") == b).select(F.col("o").alias("s"), F.lit(a).alias("p"), F.col("s").alias("o")))
    out = _cut(out.distinct())
    for p in transitive:
        out = out.union(closure(out.where(F.col("p") == p), "s", "o").select(F.col("root").alias("s"), F.lit(p).alias("p"), F.col("node").alias("o")))
    if subclass is not None:
        above = closure(subclass, "s", "o").select(F.col("root").alias("_c"), F.col("node").alias("_u"))
        out = out.union(out.where("p = 'type'").join(above, F.col("o") == F.col("_c")).select("s", "p", F.col("_u").alias("o")))
    return out.distinct()


def gathered(edges: DataFrame, root, src: str, dst: str, depth: int, most: int) -> DataFrame:
    """(level, node, hidden): what a node reaches, level by level, the first ``most`` of each level by id (what a screen shows), and how
    many of the level are left out."""
    at = reach(edges, edges.sparkSession.createDataFrame([(root,)], f"node {edges.schema[src].dataType.simpleString()}"), src, dst, depth)
    sizes = at.groupBy("depth").agg(F.count("*").alias("_n"))
    own = at.withColumn("_r", F.row_number().over(Window.partitionBy("depth").orderBy("node"))).where(F.col("_r") <= most)
    return own.join(sizes, "depth").select(F.col("depth").alias("level"), "node", F.greatest(F.col("_n") - most, F.lit(0)).alias("hidden"))


def with_old_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, label) of a new grouping, with the old label where a new group and an old one share more than half of the nodes of each."""
    both = old.select("node", F.col("label").alias("_a")).join(new.select("node", F.col("label").alias("_b")), "node").groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    size = lambda rows, name, n: rows.groupBy(F.col("label").alias(name)).agg(F.count("*").alias(n))
    same = both.join(size(old, "_a", "_na"), "_a").join(size(new, "_b", "_nb"), "_b").where("2 * _n > _na and 2 * _n > _nb").select("_a", "_b")
    return new.join(same, F.col("label") == F.col("_b"), "left").select("node", F.coalesce("_a", "label").alias("label"))
