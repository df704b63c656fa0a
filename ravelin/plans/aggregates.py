"""Questions that group, rank, page and combine."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.scalars import bucket, folded, period_label
from ravelin.operators import graphs, summary
from ravelin.operators.relations import best_linked, fill_ratio
from ravelin.operators.ordered import placed
from ravelin.plans.registry import RECORDS, TREE, question

c = F.col


@question("agg_summary", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS value FROM lineitem GROUP BY 1")
def _(t):
    return summary.grouped(t.lineitem, {"l_returnflag": c("l_returnflag")}, c("l_quantity"), "sum")


@question("agg_avg_min_max", "SELECT l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def _(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")).where("n > 10")


@question("topk_groups", "WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT * FROM g ORDER BY n DESC, p_brand LIMIT 10) SELECT p_brand, n, 'group' AS kind FROM k UNION ALL SELECT NULL, (SELECT sum(n) FROM g)::BIGINT - (SELECT sum(n) FROM k)::BIGINT, 'other'")
def _(t):
    return summary.top_with_other(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", 10)


@question("agg_distinct_pairs", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(t):
    return summary.grouped(t.lineitem, {"l_suppkey": c("l_suppkey")}, unique=["l_orderkey"]).select("l_suppkey", "n")


@question("agg_split", "WITH k AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3) SELECT p_brand, CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE 'other' END AS p_type, count(*) AS n FROM part GROUP BY 1, 2")
def _(t):
    return summary.split(t.part, "p_brand", "p_type", 3)


@question("agg_other", "WITH k AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3) SELECT CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE 'other' END AS p_type, min(p_size) AS low, max(p_size) AS high, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def _(t):
    by = t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.sum("p_size").alias("total"))
    kept = by.orderBy(F.desc("n"), "p_type").limit(3).select(c("p_type").alias("k"))
    return by.join(kept, c("p_type") == c("k"), "left").groupBy(F.coalesce("k", F.lit("other")).alias("p_type")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


@question("agg_census", "SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer) AS total, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS groups FROM customer GROUP BY 1")
def _(t):
    return summary.census(t.customer, "c_mktsegment")


@question("agg_own_axis", "SELECT nullif(o_orderstatus, '') AS status, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(folded(c("o_orderstatus")).alias("status"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@question("agg_explode_axis", "SELECT part AS l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey AS part FROM lineitem) GROUP BY 1")
def _(t):
    many = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return many.select("l_orderkey", F.explode_outer("parts").alias("l_partkey")).groupBy("l_partkey").agg(F.count("*").alias("n"))


@question("agg_edge_axis", "SELECT l_quantity, count(*) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    return t.orders.where("o_orderstatus = 'F'").join(t.lineitem.select("l_orderkey", "l_quantity"), c("o_orderkey") == c("l_orderkey"), "left").groupBy("l_quantity").agg(F.count("*").alias("n"))


@question("agg_tree_level", "SELECT 'n:' || c_nationkey AS ancestor, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    at = graphs.levels(t.tree, t.region.select(F.concat(F.lit("r:"), "r_regionkey").alias("node")), "parent", "child", 1)
    return t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("node")).join(at, "node", "left").groupBy("ancestor").agg(F.count("*").alias("n"))


@question("agg_date_bucket", "SELECT strftime(l_shipdate, '%Y-%m') AS month, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS quarter, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy(period_label(c("l_shipdate"), "month").alias("month"), period_label(c("l_shipdate"), "quarter").alias("quarter")).agg(F.count("*").alias("n"))


@question("agg_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS high, count(*) FILTER (value > 50) AS over FROM events GROUP BY 1")
def _(t):
    points = summary.percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    rest = t.events.groupBy(c("event_type").alias("_e")).agg(F.max("value").alias("high"), F.count_if(c("value") > 50).alias("over"))
    return rest.join(points, c("_e").eqNullSafe(c("event_type"))).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "high", "over")


@question("agg_job_stats", "SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS p50 FROM orders GROUP BY 1")
def _(t):
    points = summary.percentiles(t.orders, "o_orderpriority", "o_totalprice", {"p50": 0.5})
    counts = t.orders.groupBy(c("o_orderpriority").alias("_p")).agg(F.count("*").alias("n"))
    return counts.join(points, c("_p").eqNullSafe(c("o_orderpriority"))).select("o_orderpriority", "n", F.round("p50", 6).alias("p50"))


@question("agg_count_distinct", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@question("agg_cut_shape", "SELECT regexp_replace(p_brand, '[0-9]', '9', 'g') AS shape, count(*) AS n, max(p_partkey) AS last FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(F.regexp_replace("p_brand", "[0-9]", "9").alias("shape")).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


@question("agg_fill_ratio", "SELECT 'text' AS \"column\", count(*) FILTER (text IS NOT NULL AND text NOT IN ('', 'null')) AS filled, count(*) AS total FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NOT NULL AND lang NOT IN ('', 'null')), count(*) FROM documents")
def _(t):
    return fill_ratio(t.documents, ["text", "lang"])


@question("agg_collect_conflict", "SELECT p_name, count(DISTINCT p_brand) AS brands, count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_name").agg(F.countDistinct("p_brand").alias("brands")).withColumn("conflict", c("brands") > 1)


@question("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@question("count_by_type", "SELECT 'part' AS type, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t):
    one = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    return one("part").union(one("supplier")).union(one("customer"))


@question("count_type_edges", f"SELECT parent[1:1] AS src, child[1:1] AS dst, count(*) AS n FROM {TREE} GROUP BY 1, 2")
def _(t):
    return t.tree.groupBy(F.substring("parent", 1, 1).alias("src"), F.substring("child", 1, 1).alias("dst")).agg(F.count("*").alias("n"))


@question("count_hubs", f"SELECT l_suppkey, l_returnflag, o_orderstatus, count(*) AS n FROM {RECORDS} x GROUP BY 1, 2, 3")
def _(t):
    return t.records.groupBy("l_suppkey", "l_returnflag", "o_orderstatus").agg(F.count("*").alias("n"))


@question("linked_columns", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey))[1:3] AS vals, count(DISTINCT l_suppkey) > 3 AS more FROM lineitem GROUP BY 1")
def _(t):
    return best_linked(t.lineitem, "l_orderkey", "l_suppkey", 3).select("l_orderkey", c("values").alias("vals"), "more")


@question("linked_topn", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def _(t):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return t.orders.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@question("label_lookup", "SELECT s_suppkey, coalesce(n_name, '(hidden)') AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey")
def _(t):
    return t.supplier.join(t.nation.where("n_regionkey <> 1"), c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("(hidden)")).alias("label"))


@question("rel_names", f"SELECT parent, child, n_name AS name FROM {TREE} JOIN nation ON child = 'n:' || n_nationkey")
def _(t):
    return t.tree.join(t.nation.select(F.concat(F.lit("n:"), "n_nationkey").alias("child"), c("n_name").alias("name")), "child").select("parent", "child", "name")


@question("display_label", "SELECT p_partkey, p_brand || ' ' || p_name AS label FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("label"))


@question("summary_table", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@question("points_xy", "SELECT DISTINCT p_size AS x, p_retailprice AS y, p_type AS g FROM part WHERE p_size IS NOT NULL")
def _(t):
    return t.part.where("p_size is not null").select(c("p_size").alias("x"), c("p_retailprice").alias("y"), c("p_type").alias("g")).distinct()


@question("win_group_total", "SELECT p_brand, n, sum(n) OVER ()::BIGINT AS total, count(*) OVER () AS groups FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    return summary.census(t.part, "p_brand")


@question("win_pareto_abc", "WITH g AS (SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, qty, row_number() OVER (ORDER BY qty DESC, l_suppkey)::INT AS rank, round(100 * sum(qty) OVER (ORDER BY qty DESC, l_suppkey ROWS UNBOUNDED PRECEDING) / sum(qty) OVER (), 6) AS cumulative FROM g) SELECT *, CASE WHEN cumulative <= 80 THEN 'A' WHEN cumulative <= 95 THEN 'B' ELSE 'C' END AS class FROM r")
def _(t):
    return summary.pareto(t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty")), "l_suppkey", "qty")


@question("win_fanout", "SELECT l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) WHERE r <= 2")
def _(t):
    return graphs.fan_out(t.lineitem.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", 2)


@question("win_distinct_on", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def _(t):
    # the latest order by a map-side-combined maximum, not by ranking all orders of a customer
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", -c("o_orderkey"))).alias("o_orderkey"))


@question("win_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier")
def _(t):
    return placed(t.supplier.select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", c("rank").cast("int").alias("rank"))


@question("win_moving_range", "SELECT month, n, abs(n - lag(n) OVER (ORDER BY month)) AS moved FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)")
def _(t):
    by = t.orders.groupBy(bucket(c("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    return by.withColumn("moved", F.abs(c("n") - F.lag("n").over(Window.orderBy("month"))))


@question("win_rolling_median", "SELECT month, n, median(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS level FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)")
def _(t):
    by = t.orders.groupBy(bucket(c("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    return by.withColumn("level", F.percentile("n", F.lit(0.5)).over(Window.orderBy("month").rowsBetween(-2, 2)))


@question("sort_numeric_aware", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 50")
def _(t):
    return t.part.orderBy(F.desc_nulls_last("p_size"), "p_partkey").limit(50).select("p_partkey", "p_size")


@question("page_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@question("page_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 51")
def _(t):
    return summary.keyset_page(t.orders, "o_orderkey", 1000, 51).select("o_orderkey")


@question("page_cursor", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 50")
def _(t):
    """The second page of some orders, behind the cursor that the first page ends with."""
    asked = {"status": "F", "order": ["o_orderkey"]}
    rows = t.orders.where(c("o_orderstatus") == asked["status"]).select("o_orderkey")
    first = rows.orderBy("o_orderkey").limit(50).agg(F.max("o_orderkey")).first()[0]
    last = summary.after_cursor(summary.cursor([-1 if first is None else first], asked), asked)
    return summary.keyset_page(rows, "o_orderkey", last[0], 50)


@question("sort_relevance", "SELECT p_partkey, CASE WHEN lower(p_name) = 'green' THEN 0 WHEN starts_with(lower(p_name), 'green') THEN 1 WHEN contains(lower(p_name), 'green') THEN 2 ELSE 3 END::INT AS relevance FROM part")
def _(t):
    return t.part.select("p_partkey", summary.relevance(c("p_name"), "green").alias("relevance"))


@question("sort_tree", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey)::INT AS place FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name", "n_nationkey")).alias("place"))


@question("set_union", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') UNION SELECT p_partkey FROM part WHERE contains(lower(p_type), 'o')")
def _(t):
    return t.part.where(F.lower("p_name").contains("red")).select("p_partkey").union(t.part.where(F.lower("p_type").contains("o")).select("p_partkey")).distinct()


@question("set_union_all", "SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT s_suppkey FROM supplier")
def _(t):
    return t.lineitem.select(c("l_suppkey").alias("k")).unionAll(t.supplier.select("s_suppkey"))


@question("set_except_delta", "SELECT 'add' AS change, o_orderkey AS src, dst FROM (SELECT o_orderkey, (o_custkey + o_orderkey % 3) AS dst FROM orders EXCEPT SELECT o_orderkey, o_custkey FROM orders) UNION ALL SELECT 'drop', o_orderkey, dst FROM (SELECT o_orderkey, o_custkey AS dst FROM orders EXCEPT SELECT o_orderkey, (o_custkey + o_orderkey % 3) FROM orders)")
def _(t):
    # an index of references after an update: what is new is added, what is gone is dropped, what stays isn't touched
    old = t.orders.select(c("o_orderkey").alias("src"), c("o_custkey").alias("dst"))
    new = t.orders.select(c("o_orderkey").alias("src"), (c("o_custkey") + c("o_orderkey") % 3).alias("dst"))
    return new.subtract(old).select(F.lit("add").alias("change"), "*").union(old.subtract(new).select(F.lit("drop").alias("change"), "*"))


@question("set_intersect_except", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def _(t):
    one = lambda x: t.lineitem.where(x).select("l_partkey")
    return one("l_returnflag = 'R'").intersect(one("l_returnflag = 'A'")).subtract(one("l_quantity = 50"))


@question("set_gap", "WITH w AS (SELECT DISTINCT s_nationkey AS nation, x.segment FROM supplier, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY']) AS segment) x), h AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000) SELECT 'gap' AS kind, * FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")
def _(t):
    """Combinations that are expected and missing, and those that are there unexpected. What is expected is a plan: some options for each
    nation with a supplier, exploded, not a product of two tables."""
    plan = F.explode(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "MACHINERY")])).alias("segment")
    wanted = t.supplier.select(c("s_nationkey").alias("nation")).distinct().select("nation", plan)
    there = t.customer.where("c_acctbal > 9000").select(c("c_nationkey").alias("nation"), c("c_mktsegment").alias("segment")).distinct()
    both = wanted.withColumn("w", F.lit(1)).join(there.withColumn("h", F.lit(1)), ["nation", "segment"], "full_outer")
    return both.where(c("w").isNull() | c("h").isNull()).select(F.when(c("h").isNull(), "gap").otherwise("unexpected").alias("kind"), "nation", "segment")


@question("set_snapshot_diff", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'gone' ELSE 'changed' END AS kind FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def _(t):
    print_ = lambda df: df.select(c("o_orderkey").alias("id"), F.xxhash64("o_orderstatus").alias("h"))
    old = print_(t.orders.where("o_orderkey % 7 <> 0"))
    new = print_(t.orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(c("o_orderkey") % 11 == 0, "X").otherwise(c("o_orderstatus")))).withColumnRenamed("h", "h2")
    both = old.join(new, "id", "full_outer").where(~c("h").eqNullSafe(c("h2")))
    return both.select("id", F.when(c("h").isNull(), "new").when(c("h2").isNull(), "gone").otherwise("changed").alias("kind"))
