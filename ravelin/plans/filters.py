"""Questions that filter rows, by their own values and by linked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions.scalars import missing, numeric, truth
from ravelin.operators import graphs
from ravelin.operators.relations import alive, all_of, any_element, contains, differs, excluded, left_out, linked, linked_counts, overlaps, starts
from ravelin.plans.registry import ODD_VALUES, RECORDS, TREE, VALUES, question


def plain(name: str, table: str, columns: str, where: str, condition) -> None:
    """A filter over one table, whose SQL is the same condition in words."""
    question(name, f"SELECT {columns} FROM {table} WHERE {where}")(lambda t: getattr(t, table).where(condition()).select(*columns.replace(" ", "").split(",")))


c = F.col
plain("filter_and", "orders", "o_orderkey, o_totalprice", "o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda: all_of(c("o_orderstatus") == "F", c("o_totalprice") > 1000, c("o_orderpriority").isin("1-URGENT", "2-HIGH")))
plain("filter_empty", "documents", "doc_id", "text IS NULL OR text = '' OR text = 'null'", lambda: missing(c("text")))
plain("filter_ne_null", "customer", "c_custkey, c_mktsegment", "c_mktsegment IS DISTINCT FROM 'BUILDING'", lambda: differs(c("c_mktsegment"), "BUILDING"))
plain("filter_in", "part", "p_partkey, p_size", "p_size IN (1, 7, 49)", lambda: c("p_size").isin(1, 7, 49))
plain("filter_contains", "part", "p_partkey, p_name", "contains(lower(p_name), '1')", lambda: contains(c("p_name"), "1"))
plain("filter_starts", "supplier", "s_suppkey, s_name", "starts_with(lower(s_name), 'supplier#00000001')", lambda: starts(c("s_name"), "SUPPLIER#00000001"))
plain("filter_date_range", "orders", "o_orderkey", "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-03-01'", lambda: (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (c("o_orderdate") < F.lit("1996-03-01").cast("timestamp")))
plain("filter_datetime_range", "events", "event_id", "ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 18:30:00'", lambda: (c("ts") >= F.lit("2024-01-05 06:00:00").cast("timestamp")) & (c("ts") < F.lit("2024-01-06 18:30:00").cast("timestamp")))
plain("filter_prop_eq", "customer", "c_custkey", "c_mktsegment = 'MACHINERY' AND c_nationkey = 3", lambda: (c("c_mktsegment") == "MACHINERY") & (c("c_nationkey") == 3))
plain("filter_visible", "supplier", "s_suppkey, s_nationkey", "s_nationkey IS NULL OR s_nationkey IN (1, 2, 3)", lambda: c("s_nationkey").isNull() | c("s_nationkey").isin(1, 2, 3))
plain("filter_exclude_group", "part", "p_partkey", "NOT coalesce(p_size > 25 AND p_brand = 'Brand#11', false)", lambda: excluded(c("p_size") > 25, c("p_brand") == "Brand#11"))

@question("filter_number", f"SELECT id FROM {VALUES} WHERE CASE WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN v::DOUBLE END < 10")
def _(t):
    return t.part.selectExpr("p_partkey AS id", f"{ODD_VALUES} AS v").where(numeric(c("v")) < 10).select("id")


@question("filter_bool", f"SELECT id FROM {VALUES} WHERE lower(trim(v)) IN ('true', 't', 'yes', 'y', '1', 'on')")
def _(t):
    return t.part.selectExpr("p_partkey AS id", f"{ODD_VALUES} AS v").where(truth(c("v"))).select("id")


@question("filter_array_contains", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey % 100 = 5) ")
def _(t):
    own = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(c("l_partkey") % 100).alias("parts"))
    return own.where(F.array_contains("parts", F.lit(5).cast("long"))).select("l_orderkey")


@question("filter_array_exists_like", "SELECT DISTINCT l_orderkey FROM lineitem WHERE contains(l_partkey::VARCHAR, '77')")
def _(t):
    own = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return own.where(any_element(c("parts"), "77")).select("l_orderkey")


@question("filter_ref", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t):
    return linked(t.customer, t.nation.where("n_regionkey = 2").select(c("n_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@question("filter_under", f"WITH RECURSIVE s(node) AS (SELECT 'r:1' UNION SELECT child FROM {TREE} e JOIN s ON parent = node) SELECT node FROM s")
def _(t):
    return graphs.reach(t.tree, t.spark.createDataFrame([("r:1",)], "node string"), "parent", "child").select("node")


@question("filter_above", f"WITH RECURSIVE s(node) AS (SELECT 'c:42' UNION SELECT parent FROM {TREE} e JOIN s ON child = node) SELECT node FROM s")
def _(t):
    return graphs.reach(t.tree, t.spark.createDataFrame([("c:42",)], "node string"), "child", "parent").select("node")


@question("filter_count_linked", "SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 12")
def _(t):
    edges = t.orders.withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderkey")
    return linked_counts(t.customer.select("c_custkey"), edges, "c_custkey", "o_orderkey").where("n >= 12")


@question("filter_hop_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def _(t):
    return linked(t.orders, t.lineitem.where("l_quantity >= 49").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@question("filter_chain", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')))")
def _(t):
    # from the narrow end: each step keeps keys only
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("c_nationkey"))
    customers = linked(t.customer, nations, "c_nationkey").select(c("c_custkey").alias("o_custkey"))
    orders = linked(t.orders, customers, "o_custkey").select(c("o_orderkey").alias("l_orderkey"))
    return linked(t.lineitem, orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@question("filter_related_self", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5)")
def _(t):
    return linked(t.orders, t.lineitem.where("l_partkey = 5").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", exists=False).select("o_orderkey")


@question("filter_edge_prop", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'")
def _(t):
    return linked(t.part.select(c("p_partkey").alias("l_partkey")), t.lineitem.where("l_quantity = 50 and l_returnflag = 'R'").select("l_partkey"), "l_partkey")


@question("filter_edge_period", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate::DATE <= DATE '1998-06-15' AND l_shipdate::DATE + 90 > DATE '1998-06-15'")
def _(t):
    day = F.to_date("l_shipdate")
    return t.lineitem.where(alive(day, F.date_add(day, 90), "1998-06-15")).select("l_orderkey").distinct()


_SPANS = "(SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + 90 AS b FROM lineitem)"


def spans(t):
    """Lines as links that are alive for 90 days from their shipping."""
    day = F.to_date("l_shipdate")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", day.alias("a"), F.date_add(day, 90).alias("b"))


@question("join_valid_on", f"SELECT o_orderkey, count(*) AS n FROM orders JOIN {_SPANS} s ON l_orderkey = o_orderkey AND a <= o_orderdate::DATE + 60 AND b > o_orderdate::DATE + 60 GROUP BY 1")
def _(t):
    # each order with the links that are alive on its own day, 60 days after it
    on = spans(t).join(t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 60).alias("day")), c("l_orderkey") == c("o_orderkey"))
    return on.where((c("a") <= c("day")) & (c("b") > c("day"))).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@question("join_overlap", f"SELECT x.l_orderkey, count(*) AS n FROM {_SPANS} x JOIN {_SPANS} y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.a < y.b AND x.b > y.a GROUP BY 1")
def _(t):
    # pairs of links of one order whose times overlap, half-open; the equal key bounds what is compared
    other = spans(t).select(c("l_orderkey").alias("k"), c("l_linenumber").alias("line"), c("a").alias("a2"), c("b").alias("b2"))
    return spans(t).join(other, (c("l_orderkey") == c("k")) & (c("l_linenumber") < c("line")) & (c("a") < c("b2")) & (c("b") > c("a2"))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@question("edge_crossed", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_shipdate::DATE > DATE '1998-01-01' AND l_shipdate::DATE <= DATE '1998-01-03') OR (l_shipdate::DATE + 90 > DATE '1998-01-01' AND l_shipdate::DATE + 90 <= DATE '1998-01-03')")
def _(t):
    a, b = F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 90)
    inside = lambda d: (d > F.lit("1998-01-01").cast("date")) & (d <= F.lit("1998-01-03").cast("date"))
    return t.lineitem.where(inside(a) | inside(b)).select("l_orderkey", "l_partkey", "l_linenumber")


@question("filter_same_edge", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_returnflag = 'R' AND l_discount >= 0.05)")
def _(t):
    one = t.lineitem.where(all_of(c("l_quantity") > 40, c("l_returnflag") == "R", c("l_discount") >= 0.05))
    return linked(t.orders, one.select(c("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@question("filter_matches_expr", "SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN 1 ELSE 0 END)::BIGINT AS matched FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(all_of(c("l_quantity") > 25, c("l_discount") < 0.05)).alias("matched"))


@question("filter_sublist", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("l_orderkey"))
    return linked(t.part, linked(t.lineitem, urgent, "l_orderkey").select(c("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@question("filter_year", "SELECT 'evergreen' AS policy, p_partkey AS id FROM part UNION ALL SELECT 'lifecycle', o_orderkey FROM orders WHERE year(o_orderdate) <= 1997 AND (o_orderstatus <> 'F' OR year(o_orderdate) + 1 >= 1997) UNION ALL SELECT 'yearly', event_id FROM events WHERE year(ts) = 1997 UNION ALL SELECT 'derived', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def _(t):
    """What counts for a year, by the policy of the type: always; from its begin to its end (open without one); in its own year; or
    where something linked does."""
    year = 1997
    start = F.year("o_orderdate")
    end = F.when(c("o_orderstatus") == "F", start + 1)
    lived = t.orders.where((start <= year) & (end.isNull() | (end >= year))).select(F.lit("lifecycle").alias("policy"), c("o_orderkey").alias("id"))
    own = t.events.where(F.year("ts") == year).select(F.lit("yearly").alias("policy"), c("event_id").alias("id"))
    ever = t.part.select(F.lit("evergreen").alias("policy"), c("p_partkey").alias("id"))
    derived = linked(t.customer, t.orders.where(start == year).select(c("o_custkey").alias("c_custkey")), "c_custkey").select(F.lit("derived").alias("policy"), c("c_custkey").alias("id"))
    return ever.union(lived).union(own).union(derived)


@question("diagnose_zero", "SELECT count(*) FILTER (p_size > 25 AND p_brand = 'none' AND p_retailprice > 0) AS total, count(*) FILTER (p_brand = 'none' AND p_retailprice > 0) AS without_size, count(*) FILTER (p_size > 25 AND p_retailprice > 0) AS without_brand, count(*) FILTER (p_size > 25 AND p_brand = 'none') AS without_price FROM part")
def _(t):
    return left_out(t.part, {"size": c("p_size") > 25, "brand": c("p_brand") == "none", "price": c("p_retailprice") > 0})


@question("enum_near", "SELECT DISTINCT c_mktsegment AS option, levenshtein(c_mktsegment, 'BILDING')::INT AS d FROM customer WHERE levenshtein(c_mktsegment, 'BILDING') <= 3")
def _(t):
    return t.customer.select(c("c_mktsegment").alias("option")).distinct().withColumn("d", F.levenshtein("option", F.lit("BILDING"))).where("d <= 3")


@question("filter_lineage", f"WITH RECURSIVE s(node) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IN (3, 8) UNION SELECT child FROM (SELECT p_partkey // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0) e JOIN s ON parent = node) SELECT p_partkey, p_partkey IN (SELECT node FROM s) AS stale FROM part")
def _(t):
    stale = graphs.reach(t.bom, t.spark.createDataFrame([(3,), (8,)], "node long"), "parent", "child").select(c("node").alias("p_partkey"), F.lit(True).alias("stale"))
    return t.part.select("p_partkey").join(stale, "p_partkey", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


@question("scan_type", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus <> 'P'")
def _(t):
    # rows of a type without the deleted ones; an unknown mark isn't a deletion
    return t.orders.where(differs(c("o_orderstatus"), "P")).select("o_orderkey", "o_orderstatus")


@question("join_axis_left", f"SELECT r_name, count(*) AS n, sum(l_quantity) AS qty FROM {RECORDS} x LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    # small dimensions are joined first, among themselves
    place = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").join(t.region, c("n_regionkey") == c("r_regionkey"), "left").select("c_custkey", "r_name")
    return t.records.join(place, c("o_custkey") == c("c_custkey"), "left").groupBy("r_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@question("join_semi_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return linked(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey")), "c_custkey", exists=False).select("c_custkey")


@question("join_edges_undirected", f"SELECT node, count(*) AS n FROM (SELECT parent AS node FROM {TREE} UNION ALL SELECT child FROM {TREE}) GROUP BY 1")
def _(t):
    return t.tree.select(F.explode(F.array("parent", "child")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


@question("join_full_outer_paired", "SELECT coalesce(a.m, b.m) AS m, a.n AS returned, b.n AS ordered FROM (SELECT date_trunc('month', l_shipdate)::DATE AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1) b ON a.m IS NOT DISTINCT FROM b.m")
def _(t):
    a = t.lineitem.where("l_returnflag = 'R'").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("m")).agg(F.count("*").alias("returned"))
    b = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("mb")).agg(F.count("*").alias("ordered"))
    return a.join(b, c("m").eqNullSafe(c("mb")), "full_outer").select(F.coalesce("m", "mb").alias("m"), "returned", "ordered")


@question("join_coref_pairs", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def _(t):
    return graphs.shared_counts(t.lineitem, "l_suppkey", "l_orderkey", once=True).withColumnRenamed("shared", "n")


@question("join_reach", "SELECT l_orderkey, l_linenumber, l_partkey, c_nationkey AS reached FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity = 1")
def _(t):
    owner = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", c("c_nationkey").alias("reached"))
    return t.lineitem.where("l_quantity = 1").join(owner, c("l_orderkey") == c("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "reached")


@question("join_axis_apply", "SELECT n_name, o_orderpriority, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    place = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name")
    return t.orders.join(place, c("o_custkey") == c("c_custkey"), "left").groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"))


@question("path_edge_field", "SELECT o_orderkey AS key, coalesce(q, []) AS qty FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_quantity)) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    return t.schema.with_columns("order", {"qty": "out.lines~l_quantity"})


@question("path_parse", "SELECT * FROM (VALUES ('o_orderdate', 0, 'o_orderdate', 'ok'), ('ref.o_custkey.ref.c_nationkey.n_name', 2, 'n_name', 'ok'), ('out.lines', 1, NULL, 'ok'), ('out.lines~l_quantity', 1, 'l_quantity', 'ok'), ('in.lines', NULL, NULL, 'refused'), ('ref.o_custkey', NULL, NULL, 'refused'), ('ref.o_custkey.c_name.more', NULL, NULL, 'refused'), ('ref.o_custkey~l_quantity', NULL, NULL, 'refused'), ('out.lines.no_such', NULL, NULL, 'refused')) v(address, hops, ends_in, state)")
def _(t):
    """Addresses of an order: how many hops, what they end in, or that they are refused."""
    from ravelin.operators.paths import NoSuchAddress

    out = []
    for text in ("o_orderdate", "ref.o_custkey.ref.c_nationkey.n_name", "out.lines", "out.lines~l_quantity", "in.lines", "ref.o_custkey", "ref.o_custkey.c_name.more", "ref.o_custkey~l_quantity", "out.lines.no_such"):
        try:
            address, _ = t.schema.checked("order", text)
            out.append((text, len(address.hops), address.column or address.edge, "ok"))
        except NoSuchAddress:
            out.append((text, None, None, "refused"))
    return t.spark.createDataFrame(out, "address string, hops int, ends_in string, state string")


@question("path_columns", "SELECT o_orderkey AS key, c_name AS customer, n_name AS nation, r_name AS region, coalesce(brands, []) AS brands FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    return t.schema.with_columns("order", {"customer": "ref.o_custkey.c_name", "nation": "ref.o_custkey.ref.c_nationkey.n_name", "region": "ref.o_custkey.ref.c_nationkey.ref.n_regionkey.r_name", "brands": "out.lines.p_brand"})


@question("path_condition", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)")
def _(t):
    return t.schema.where("supplier", "in.supply.ref.o_custkey.c_nationkey", lambda v: v == 3).select("s_suppkey")


@question("path_group", "SELECT n_name AS value, count(DISTINCT l_partkey) AS n FROM (SELECT p_partkey AS l_partkey, n_name FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def _(t):
    return t.schema.grouped("part", "in.lines.ref.o_custkey.ref.c_nationkey.n_name")


@question("path_inverse", "SELECT c_custkey AS key, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL)), []) AS priorities, coalesce(list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus IS NOT NULL)), []) AS states FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    # all orders that refer to a customer, without a relation of that name; both lists are gathered from one join
    return t.schema.with_columns("customer", {"priorities": "in.order:o_custkey.o_orderpriority", "states": "in.order:o_custkey.o_orderstatus"})


@question("path_inverse_condition", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000)")
def _(t):
    return t.schema.where("nation", "in.customer:c_nationkey.in.order:o_custkey.o_totalprice", lambda v: v > 300000).select("n_nationkey")


@question("path_inverse_group", "SELECT value, count(*) AS n FROM (SELECT DISTINCT r_regionkey, c_mktsegment AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1")
def _(t):
    return t.schema.grouped("region", "in.nation:n_regionkey.in.customer:c_nationkey.c_mktsegment")


@question("path_shared_lists", "SELECT o_orderkey AS key, n_name AS nation, coalesce(brands, []) AS brands, coalesce(types, []) AS types, coalesce(parts, []) AS parts, coalesce(qty, []) AS qty FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_brand) FILTER (p_brand IS NOT NULL)) AS brands, list_sort(list(DISTINCT p_type) FILTER (p_type IS NOT NULL)) AS types, list_sort(list(DISTINCT l_partkey)) AS parts, list_sort(list(DISTINCT l_quantity)) AS qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    # four lists behind one relation: its rows are joined once, and its target once
    return t.schema.with_columns("order", {"nation": "ref.o_custkey.ref.c_nationkey.n_name", "brands": "out.lines.p_brand", "types": "out.lines.p_type", "parts": "out.lines", "qty": "out.lines~l_quantity"})
