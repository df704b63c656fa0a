"""Questions over trees, structures and networks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators import graphs, reachability
from ravelin.plans.registry import BOM, DAG, TREE, question

c = F.col


def nodes(t, *ids, kind="long"):
    return t.spark.createDataFrame([(i,) for i in ids], f"node {kind}")


def down(edges: str, root: str) -> str:
    return f"WITH RECURSIVE s(node) AS (SELECT {root} UNION SELECT child FROM {edges} e JOIN s ON parent = node) SELECT node FROM s"


def up(edges: str, leaf: str) -> str:
    return f"WITH RECURSIVE s(node) AS (SELECT {leaf} UNION SELECT parent FROM {edges} e JOIN s ON child = node) SELECT node FROM s"


@question("graph_subtree", down(BOM, "3::BIGINT"))
def _(t):
    return graphs.reach(t.bom, nodes(t, 3), "parent", "child").select("node")


@question("graph_supertree", up(BOM, "1500::BIGINT"))
def _(t):
    return graphs.reach(t.bom, nodes(t, 1500), "child", "parent").select("node")


@question("graph_levels", "SELECT 'n:' || n_nationkey AS node, 'r:' || n_regionkey AS ancestor FROM nation UNION ALL SELECT 'c:' || c_custkey, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r:' || r_regionkey, 'r:' || r_regionkey FROM region")
def _(t):
    return graphs.levels(t.tree, t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("node")), "parent", "child", 0)


@question("graph_children", f"SELECT child FROM {TREE} WHERE parent = 'r:2'")
def _(t):
    return t.tree.where("parent = 'r:2'").select("child")


@question("graph_descendants", f"WITH RECURSIVE s(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT child, depth + 1 FROM {DAG} e JOIN s ON parent = node) SELECT node, min(depth)::INT AS depth FROM s GROUP BY 1")
def _(t):
    return graphs.reach(t.dag, nodes(t, 0), "parent", "child")


@question("graph_ancestors", f"WITH RECURSIVE s(node, depth) AS (SELECT 1995::BIGINT, 0 UNION SELECT parent, depth + 1 FROM {DAG} e JOIN s ON child = node) SELECT node, min(depth)::INT AS depth FROM s GROUP BY 1")
def _(t):
    return graphs.reach(t.dag, nodes(t, 1995), "child", "parent")


@question("graph_tree_links", f"WITH RECURSIVE s(node) AS (SELECT 7::BIGINT UNION SELECT child FROM {BOM} e JOIN s ON parent = node) SELECT parent, child FROM {BOM} WHERE parent IN (SELECT node FROM s)")
def _(t):
    return t.bom.join(graphs.reach(t.bom, nodes(t, 7), "parent", "child").select(c("node").alias("parent")), "parent", "left_semi").select("parent", "child")


@question("graph_child_counts", f"SELECT parent, count(*) AS n FROM {TREE} GROUP BY 1")
def _(t):
    return t.tree.groupBy("parent").agg(F.count("*").alias("n"))


@question("graph_roots", f"SELECT DISTINCT parent AS node FROM {TREE} WHERE parent NOT IN (SELECT child FROM {TREE})")
def _(t):
    return t.tree.select(c("parent").alias("node")).distinct().join(t.tree.select(c("child").alias("node")), "node", "left_anti")


_EXPLODED = f"WITH RECURSIVE s(node, q, level) AS (SELECT 0::BIGINT, 1::BIGINT, 0 UNION ALL SELECT child, q * qty, level + 1 FROM {BOM} e JOIN s ON parent = node)"


@question("graph_bom_fold", f"{_EXPLODED} SELECT node, sum(q)::BIGINT AS quantity, count(*) AS paths, min(level)::INT AS min_level, max(level)::INT AS max_level FROM s WHERE level > 0 GROUP BY 1")
def _(t):
    return graphs.explosion(t.bom, 0, "parent", "child", "qty")


@question("graph_bom_explode", f"{_EXPLODED} SELECT min_level, count(*) AS parts, sum(quantity)::BIGINT AS quantity FROM (SELECT node, sum(q) AS quantity, min(level)::INT AS min_level FROM s WHERE level > 0 GROUP BY 1) GROUP BY 1")
def _(t):
    return graphs.explosion(t.bom, 0, "parent", "child", "qty").groupBy("min_level").agg(F.count("*").alias("parts"), F.sum("quantity").alias("quantity"))


@question("graph_bom_indented", f"WITH RECURSIVE s(path, level, node, quantity) AS (SELECT [0::BIGINT], 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT list_append(path, child), level + 1, child, quantity * qty FROM {BOM} e JOIN s ON parent = node) SELECT path, level::INT AS level, node, quantity FROM s WHERE level > 0")
def _(t):
    return graphs.indented(t.bom, 0, "parent", "child", "qty")


@question("graph_where_used", f"WITH RECURSIVE s(node, q, level) AS (SELECT 1500::BIGINT % (SELECT count(*) FROM part), 1::BIGINT, 0 UNION ALL SELECT parent, q * qty, level + 1 FROM {BOM} e JOIN s ON child = node) SELECT node, sum(q)::BIGINT AS quantity, min(level)::INT AS min_level FROM s WHERE level > 0 GROUP BY 1")
def _(t):
    # the assemblies that a part goes into, with the number of it in one of them
    part = 1500 % t.part.count()
    return graphs.explosion(t.bom, part, "child", "parent", "qty").select("node", "quantity", "min_level")


_BELOW = f"WITH RECURSIVE s(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT root, child FROM {BOM} e JOIN s ON parent = node)"


@question("rollup_fold", f"{_BELOW} SELECT root AS node, count(*) AS n, sum(p_size)::DOUBLE AS sum, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size), 6) AS avg, round(sum(ln(p_size)), 6) AS log_product FROM s JOIN part ON node = p_partkey GROUP BY 1")
def _(t):
    values = t.part.select(c("p_partkey").alias("node"), "p_size")
    return graphs.subtree_fold(t.bom, values, "parent", "child", "p_size").withColumns({"avg": F.round("avg", 6), "log_product": F.round("log_product", 6)})


@question("rollup_weighted", f"{_EXPLODED} SELECT sum(q * p_size)::BIGINT AS weighted, sum(q)::BIGINT AS quantity, round(sum(q * p_size) / sum(q), 6) AS mean, round(sum(q * ln(p_size)), 4) AS log_power FROM s JOIN part ON node = p_partkey WHERE level > 0")
def _(t):
    own = graphs.explosion(t.bom, 0, "parent", "child", "qty").join(t.part.hint("merge"), c("node") == c("p_partkey"))
    return own.agg(F.sum(c("quantity") * c("p_size")).alias("weighted"), F.sum("quantity").alias("quantity"), F.round(F.sum(c("quantity") * c("p_size")) / F.sum("quantity"), 6).alias("mean"), F.round(F.sum(c("quantity") * F.log("p_size")), 4).alias("log_power"))


@question("graph_neighbors", f"SELECT parent, child FROM {BOM} QUALIFY row_number() OVER (PARTITION BY parent ORDER BY child) <= 2")
def _(t):
    return graphs.fan_out(t.bom, "parent", "child", 2).select("parent", "child")


@question("graph_induced", f"SELECT parent, child FROM {BOM} WHERE parent IN (SELECT p_partkey FROM part WHERE p_size > 10) AND child IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t):
    ids = t.part.where("p_size > 10")
    return t.bom.join(ids.select(c("p_partkey").alias("parent")), "parent", "left_semi").join(ids.select(c("p_partkey").alias("child")), "child", "left_semi").select("parent", "child")


@question("graph_degree", f"SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT parent AS node, 1 AS o, 0 AS i FROM {BOM} UNION ALL SELECT child, 0, 1 FROM {BOM}) GROUP BY 1")
def _(t):
    return graphs.degrees(t.bom, "parent", "child")


@question("graph_ref_edges", "SELECT o_orderkey AS src, 'customer' AS kind, o_custkey AS dst FROM orders")
def _(t):
    return t.orders.select(c("o_orderkey").alias("src"), F.lit("customer").alias("kind"), c("o_custkey").alias("dst"))


@question("graph_reach", f"WITH RECURSIVE s(node, depth) AS (SELECT 'r:0', 0 UNION SELECT child, depth + 1 FROM {TREE} e JOIN s ON parent = node WHERE depth < 1) SELECT node, depth::INT AS depth FROM s")
def _(t):
    return graphs.reach(t.tree, nodes(t, "r:0", kind="string"), "parent", "child", 1)


@question("graph_whole", f"WITH RECURSIVE s(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT child, level + 1 FROM {BOM} e JOIN s ON parent = node WHERE level < 6) SELECT level::INT AS level, node, greatest(n - 50, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY node) AS r, count(*) OVER (PARTITION BY level) AS n FROM s) WHERE r <= 50")
def _(t):
    return graphs.gathered(t.bom, 0, "parent", "child", 6, 50)


_LINKS = f"(SELECT parent AS a, child AS b FROM {DAG} UNION SELECT child, parent FROM {DAG})"
_WAYS = f"""RECURSIVE f(node, d) AS (SELECT 60::BIGINT, 0 UNION SELECT b, d + 1 FROM {_LINKS} e JOIN f ON a = node WHERE d < 8), z(node, d) AS (SELECT 196::BIGINT, 0 UNION SELECT b, d + 1 FROM {_LINKS} e JOIN z ON a = node WHERE d < 8),
 q AS (SELECT x.node, x.d, x.d + y.d AS total FROM (SELECT node, min(d) AS d FROM f GROUP BY 1) x JOIN (SELECT node, min(d) AS d FROM z GROUP BY 1) y ON x.node = y.node), p AS (SELECT d::INT AS step, node FROM q WHERE total = (SELECT min(total) FROM q))"""


@question("graph_shortest_path", f"WITH {_WAYS} SELECT step, node FROM p")
def _(t):
    # up and down: the direction of an edge doesn't matter for what lies between two parts
    return graphs.shortest(t.dag, 60, 196, "parent", "child")


@question("graph_chains", f"WITH {_WAYS}, s(chain, node, step) AS (SELECT [60::BIGINT], 60::BIGINT, 0 UNION ALL SELECT list_append(chain, b), b, s.step + 1 FROM s JOIN {_LINKS} e ON a = s.node JOIN p ON p.node = b AND p.step = s.step + 1) SELECT chain FROM s WHERE node = 196 ORDER BY chain LIMIT 5")
def _(t):
    return graphs.chains(t.dag, 60, 196, "parent", "child", 8, 5)


@question("graph_depends_count", f"WITH RECURSIVE s(root, node) AS (SELECT child, parent FROM {DAG} WHERE child NOT IN (SELECT parent FROM {DAG}) UNION SELECT root, parent FROM {DAG} e JOIN s ON child = node) SELECT node, count(*) AS n FROM s GROUP BY 1")
def _(t):
    # of each assembly, how many parts that nothing is made of go into it
    return reachability.root_counts(t.dag, "child", "parent")


_OWN = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"


@question("graph_jaccard", f"WITH s AS {_OWN}, n AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM s x JOIN s y ON x.l_partkey = y.l_partkey AND x.l_suppkey <> y.l_suppkey GROUP BY 1, 2), r AS (SELECT a, b, shared, round(shared / (u.n + v.n - shared), 6) AS similarity FROM p JOIN n u ON a = u.l_suppkey JOIN n v ON b = v.l_suppkey) SELECT a, b, shared, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b)::INT AS rank FROM r QUALIFY rank <= 10")
def _(t):
    return graphs.composition_similarity(t.lineitem, "l_suppkey", "l_partkey", 10)


@question("graph_topk_edges", "WITH p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb FROM p) SELECT a, b, n FROM r WHERE ra <= 3 OR rb <= 3")
def _(t):
    pairs = graphs.shared_counts(t.lineitem, "l_suppkey", "l_orderkey", once=True).withColumnRenamed("shared", "n")
    ranked = pairs.withColumn("ra", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).withColumn("rb", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a")))
    return ranked.where("ra <= 3 or rb <= 3").select("a", "b", "n")


@question("join_direct_edges", f"SELECT DISTINCT src, dst FROM (SELECT 'n:' || s_nationkey AS src, 's:' || s_suppkey AS dst FROM supplier UNION ALL SELECT parent, child FROM {TREE}) WHERE src LIKE 'n:%'")
def _(t):
    refs = t.supplier.select(F.concat(F.lit("n:"), "s_nationkey").alias("src"), F.concat(F.lit("s:"), "s_suppkey").alias("dst"))
    return refs.union(t.tree.select("parent", "child")).where(c("src").startswith("n:")).distinct()


@question("graph_cardinality", "SELECT o_custkey AS node, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(t):
    return t.orders.groupBy(c("o_custkey").alias("node")).agg(F.count("*").alias("n")).where("n > 15")


@question("graph_acyclic", f"WITH RECURSIVE s(node) AS (SELECT 1000::BIGINT UNION SELECT child FROM {BOM} e JOIN s ON parent = node) SELECT count(*) FILTER (node = 1) > 0 AS closes FROM s")
def _(t):
    # would an edge from 1 to 1000 close a cycle? It would if 1000 reaches 1
    return graphs.reach(t.bom, nodes(t, 1000), "parent", "child").agg((F.count_if(c("node") == 1) > 0).alias("closes"))


@question("lineage_links", f"WITH RECURSIVE s(node) AS (SELECT 5::BIGINT UNION SELECT child FROM {BOM} e JOIN s ON parent = node) SELECT parent AS source, child AS result FROM {BOM} WHERE parent IN (SELECT node FROM s)")
def _(t):
    return t.bom.join(graphs.reach(t.bom, nodes(t, 5), "parent", "child").select(c("node").alias("parent")), "parent", "left_semi").select(c("parent").alias("source"), c("child").alias("result"))


_STALE = f"WITH RECURSIVE d AS (SELECT child AS node FROM {BOM} e WHERE parent % 50 = 3), s(node) AS (SELECT node FROM d UNION SELECT child FROM {BOM} e JOIN s ON parent = node)"


@question("lineage_stale", f"{_STALE} SELECT node, node IN (SELECT node FROM d) AS direct FROM s")
def _(t):
    direct = t.bom.where("parent % 50 = 3").select(c("child").alias("node")).distinct()
    return graphs.reach(t.bom, direct, "parent", "child").select("node").join(direct.withColumn("direct", F.lit(True)), "node", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


@question("lineage_impact", f"{_STALE} SELECT count(*) AS n FROM s")
def _(t):
    direct = t.bom.where("parent % 50 = 3").select(c("child").alias("node")).distinct()
    return graphs.reach(t.bom, direct, "parent", "child").agg(F.count("*").alias("n"))


@question("rdf_inferred", f"WITH RECURSIVE b(s, p, o) AS (SELECT 'part/' || child, 'partOf', 'part/' || parent FROM {BOM} UNION ALL SELECT 'part/' || p_partkey, 'type', p_type FROM part), i AS (SELECT s, p, o FROM b UNION SELECT o, 'hasPart', s FROM b WHERE p = 'partOf'), u(s, o) AS (SELECT s, o FROM i WHERE p = 'partOf' UNION SELECT u.s, i.o FROM u JOIN i ON u.o = i.s AND i.p = 'partOf'), h(c, d) AS (SELECT * FROM (VALUES ('ECONOMY', 'cheap'), ('SMALL', 'cheap'), ('cheap', 'thing')) v(c, d) UNION SELECT h.c, v.d FROM h JOIN (VALUES ('ECONOMY', 'cheap'), ('SMALL', 'cheap'), ('cheap', 'thing')) v(c, d) ON h.d = v.c) SELECT s, p, o FROM i UNION SELECT s, 'partOf', o FROM u UNION SELECT s, 'type', d FROM i JOIN h ON o = c WHERE p = 'type'")
def _(t):
    node = lambda x: F.concat(F.lit("part/"), c(x).cast("string"))
    triples = t.bom.select(node("child").alias("s"), F.lit("partOf").alias("p"), node("parent").alias("o")).union(t.part.select(node("p_partkey"), F.lit("type"), "p_type"))
    classes = t.spark.createDataFrame([("ECONOMY", "cheap"), ("SMALL", "cheap"), ("cheap", "thing")], "s string, o string")
    return graphs.inferred(triples, [("partOf", "hasPart")], ["partOf"], classes)


@question("graph_stable_cluster", "WITH o AS (SELECT p_partkey AS id, p_size % 7 AS a FROM part), n AS (SELECT p_partkey AS id, (p_size + (p_partkey % 10 = 0)::INT) % 7 + 100 AS b FROM part), x AS (SELECT a, b, count(*) AS n FROM o JOIN n USING (id) GROUP BY 1, 2), m AS (SELECT b, a FROM x WHERE 2 * n > (SELECT count(*) FROM o WHERE o.a = x.a) AND 2 * n > (SELECT count(*) FROM n WHERE n.b = x.b)) SELECT n.id, coalesce(m.a, n.b) AS cluster FROM n LEFT JOIN m ON n.b = m.b")
def _(t):
    # groups of two runs; a new group keeps the old id where both share more than half of each
    old = t.part.select(c("p_partkey").alias("node"), (c("p_size") % 7).alias("label"))
    new = t.part.select(c("p_partkey").alias("node"), ((c("p_size") + (c("p_partkey") % 10 == 0).cast("int")) % 7 + 100).alias("label"))
    return graphs.with_old_ids(old, new).select(c("node").alias("id"), c("label").alias("cluster"))


@question("map_hash_place", "SELECT p_partkey, round(sqrt(u) * cos(2 * pi() * v), 6) AS x, round(sqrt(u) * sin(2 * pi() * v), 6) AS y FROM (SELECT p_partkey, ('0x' || md5(p_partkey::VARCHAR)[1:8])::BIGINT / 4294967296.0 AS u, ('0x' || md5(p_partkey::VARCHAR)[9:16])::BIGINT / 4294967296.0 AS v FROM part)")
def _(t):
    # a place in the unit disc that depends on the key alone and spreads evenly: the root of one number is the radius, another the angle
    h = F.md5(c("p_partkey").cast("string"))
    part = lambda k: F.conv(F.substring(h, k, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return t.part.select("p_partkey", F.round(F.sqrt(part(1)) * F.cos(2 * F.pi() * part(9)), 6).alias("x"), F.round(F.sqrt(part(1)) * F.sin(2 * F.pi() * part(9)), 6).alias("y"))


@question("map_box", "SELECT p_partkey FROM part WHERE md5(p_partkey::VARCHAR)[1:2] BETWEEN '20' AND '3f'")
def _(t):
    from ravelin.functions.scalars import map_hash

    return t.part.where((map_hash(c("p_partkey")) >= 0.125) & (map_hash(c("p_partkey")) < 0.25)).select("p_partkey")


@question("graph_cycle", f"WITH RECURSIVE up(chain, node) AS (SELECT [p_partkey, 0::BIGINT], p_partkey FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part) UNION ALL SELECT list_prepend(parent, chain), parent FROM {BOM} e JOIN up ON child = node) SELECT chain FROM up WHERE node = 0")
def _(t):
    # an edge from the last part to the first closes a cycle; its nodes are the witness
    last = t.part.agg(F.max("p_partkey")).first()[0]
    edges = t.bom.select("parent", "child").union(t.spark.createDataFrame([(last, 0)], "parent long, child long"))
    return graphs.cycle(edges, 0, "parent", "child")


@question("lineage_fold", f"{_STALE} SELECT p_partkey, p_partkey IN (SELECT node FROM s) AS stale, p_partkey IN (SELECT node FROM d) AS direct FROM part")
def _(t):
    direct = t.bom.where("parent % 50 = 3").select(c("child").alias("p_partkey")).distinct().withColumn("direct", F.lit(True))
    stale = graphs.reach(t.bom, direct.select(c("p_partkey").alias("node")), "parent", "child").select(c("node").alias("p_partkey"), F.lit(True).alias("stale"))
    return t.part.select("p_partkey").join(stale, "p_partkey", "left").join(direct, "p_partkey", "left").select("p_partkey", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("direct", F.lit(False)).alias("direct"))


@question("graph_cluster")
def _(t):
    """Groups of suppliers that share orders, by moves that gain modularity, with the modularity of all."""
    pairs = graphs._cut(graphs.shared_counts(t.lineitem, "l_suppkey", "l_orderkey").withColumnRenamed("shared", "w"))
    labels = graphs.parallel_groups(pairs, "a", "b", "w")
    return labels.crossJoin(F.broadcast(graphs.modularity(pairs, labels, "a", "b", "w"))).withColumn("modularity", F.round("modularity", 6))


#: Sources of paths are the nodes of this share of the hash range.
DRAWN = 16


@question("graph_betweenness")
def _(t):
    """Share of shortest paths through each part, estimated from a sixteenth of the parts as sources (drawn by a hash of the key)."""
    both = t.dag.select("parent", "child").union(t.dag.select("child", "parent"))
    sources = t.part.where(F.pmod(F.xxhash64("p_partkey"), F.lit(DRAWN)) == 0).select(c("p_partkey").alias("node"))
    return graphs.betweenness(both, "parent", "child", sources).withColumn("score", F.round(c("score") * DRAWN, 4))
