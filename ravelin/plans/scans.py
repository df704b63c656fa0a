"""Questions about sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators import profiles
from ravelin.plans.registry import question
from ravelin.sources import files, tabular

c = F.col


@question("scan_interface", "SELECT 'customer' AS type, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def _(t):
    a = t.customer.select(F.lit("customer").alias("type"), c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.lit("supplier").alias("type"), c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@question("scan_system_view", "SELECT n_nationkey AS id, n_name AS label FROM nation")
def _(t):
    return t.nation.select(c("n_nationkey").alias("id"), c("n_name").alias("label"))


@question("scan_refs", "SELECT l_orderkey AS src, 'part' AS key, l_partkey AS dst FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem")
def _(t):
    ends = F.explode(F.array(F.struct(F.lit("part").alias("key"), c("l_partkey").alias("dst")), F.struct(F.lit("supplier").alias("key"), c("l_suppkey").alias("dst")))).alias("r")
    return t.lineitem.select(c("l_orderkey").alias("src"), ends).select("src", "r.key", "r.dst")


@question("scan_sample", "SELECT o_orderkey FROM orders WHERE md5(o_orderkey::VARCHAR)[1:1] < '4'")
def _(t):
    # a sample by a hash of the key: the same rows on every run
    return t.orders.where(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 1) < "4").select("o_orderkey")


_SENT = "SELECT {0} AS kind, p_partkey, p_name, p_size FROM part".format


def sent(t, name, kind, encoding):
    """Parts written as other systems send them, a file for each brand, and read again."""
    own = t.part.select("p_brand", "p_partkey", F.concat("p_name", F.lit(", 부품"), F.when(c("p_size") == 1, F.lit(' "x"')).otherwise("")).alias("p_name"), "p_size")
    folder = files.scratch(t.spark)
    tabular.write_bytes(tabular.as_file(own.withColumn("p_brand", F.translate("p_brand", "#", "_")), "p_brand", kind, encoding), folder)
    back = tabular.read_tabular(t.spark, folder, ["p_partkey", "p_name", "p_size"])
    plain = F.regexp_replace("p_name", ', 부품( "x")?$', "")
    return back.select(F.lit(name).alias("kind"), c("p_partkey").cast("long").alias("p_partkey"), plain.alias("p_name"), c("p_size").cast("int").alias("p_size"))


_KINDS = [("bom", "csv", "utf-8-sig"), ("tabs", "tsv", "utf-8"), ("rows", "rows", "utf-8")]


@question("src_csv_json", " UNION ALL ".join(_SENT(f"'{k[0]}'") for k in _KINDS))
def _(t):
    out = [sent(t, *k) for k in _KINDS]
    return out[0].union(out[1]).union(out[2])


@question("src_decode", _SENT("'cp949'"))
def _(t):
    return sent(t, "cp949", "csv", "cp949")


@question("src_file", f"{_SENT(chr(39) + 'items' + chr(39))} UNION ALL {_SENT(chr(39) + 'value' + chr(39))}")
def _(t):
    return sent(t, "items", "items", "utf-8").union(sent(t, "value", "value", "utf-8"))


@question("sink_csv", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _(t):
    return files.there_and_back(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), "csv")


@question("src_incremental", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 + 1 AS page FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def _(t):
    """Rows after a watermark, page by page behind a keyset cursor; a page begins where the last one ended, whatever came in between."""
    rows = files.changed_since(t.events, "ts", "2024-01-25 00:00:00")
    pages = files.keyset_pages(rows, ["ts", "event_id"], 100)
    return pages.select("event_id", "page")


@question("src_incremental_cursor", "WITH s AS (SELECT ts, event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'), a AS (SELECT 1 AS page, ts, event_id FROM s WHERE event_id % 2 = 0 ORDER BY ts, event_id LIMIT 100), b AS (SELECT 2 AS page, ts, event_id FROM s WHERE (ts, event_id) > (SELECT max((ts, event_id)) FROM a) ORDER BY ts, event_id LIMIT 100), c AS (SELECT 3 AS page, ts, event_id FROM s WHERE (ts, event_id) > (SELECT max((ts, event_id)) FROM b) ORDER BY ts, event_id LIMIT 100) SELECT page, event_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)")
def _(t):
    """Three pages behind a cursor: odd events come in after the first page; those that lie before the cursor aren't read any more."""
    now = files.changed_since(t.events, "ts", "2024-01-25 00:00:00").select("ts", "event_id")
    cursor, out = None, None
    for k, rows in enumerate([now.where("event_id % 2 = 0"), now, now]):
        page, cursor = files.page_behind(rows, ["ts", "event_id"], cursor, 100)
        one = page.select(F.lit(k + 1).alias("page"), "event_id")
        out = one if out is None else out.union(one)
    return out


@question("src_overlap_incremental", "SELECT DISTINCT event_id FROM events WHERE ts > TIMESTAMP '2024-01-19 23:55:00'")
def _(t):
    return files.changed_since(t.events, "ts", "2024-01-20 00:00:00", 5).select("event_id").dropDuplicates(["event_id"])


@question("src_incremental_edges", "SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS deleted FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01'")
def _(t):
    return files.changed_since(t.lineitem, "l_shipdate", "2001-01-01").select("l_orderkey", "l_partkey", (c("l_returnflag") == "R").alias("deleted"))


@question("src_drift", "SELECT 'p_size' AS \"column\", 'missing' AS kind, 0::BIGINT AS n UNION ALL SELECT 'weight', 'new', count(*) FILTER (p_partkey % 10 = 3) FROM part UNION ALL SELECT 'p_brand', 'sparse', count(p_brand) FILTER (p_partkey % 4 > 0) FROM part")
def _(t):
    # rows as a source sends them, one object each, held against the columns that its definition names
    sent = t.part.select(F.to_json(F.struct("p_partkey", "p_name", F.when(c("p_partkey") % 4 > 0, c("p_brand")).alias("p_brand"), "p_type", "p_retailprice", F.when(c("p_partkey") % 10 == 3, F.lit(1.5)).alias("weight"))).alias("row"))
    return files.row_drift(sent, "row", t.part.columns)


@question("sink_append", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation")
def _(t):
    path = files.scratch(t.spark)
    t.nation.select("n_nationkey").write.mode("append").parquet(path)
    t.nation.select((c("n_nationkey") + 100).alias("n_nationkey")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@question("sink_update", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(t):
    return files.updated(t.supplier, t.supplier.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey")


@question("sink_objects_export", "SELECT o_orderkey, c_name AS customer, suppliers FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ';' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey")
def _(t):
    many = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(c("l_suppkey").cast("string"))), ";").alias("suppliers"))
    own = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    return own.join(many, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", c("c_name").alias("customer"), "suppliers")


@question("census_pages", "SELECT (row_number() OVER (ORDER BY p_name) - 1) // 20 + 1 AS page, p_name, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    # all groups as JSON lines, one for each, and read again page by page behind a cursor
    path = files.scratch(t.spark)
    t.part.groupBy("p_name").agg(F.count("*").alias("n")).select(F.to_json(F.struct("p_name", "n")).alias("value")).write.text(path)
    lines = t.spark.read.text(path).select(F.from_json("value", "p_name string, n long").alias("r")).select("r.*")
    return files.keyset_pages(lines, ["p_name"], 20).select("page", "p_name", "n")


@question("sink_rdf_data", "SELECT '<part/' || p_partkey || '> <p_name> \"' || p_name || '\" .' AS line FROM part UNION ALL SELECT '<part/' || p_partkey || '> <p_brand> \"' || p_brand || '\" .' FROM part")
def _(t):
    path = files.scratch(t.spark)
    files.write_ntriples(files.triples(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", "part"), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@question("sink_rdf_schema", "SELECT unnest(['<nation> <type> <Class> .', '<nation/n_nationkey> <domain> <nation> .', '<nation/n_nationkey> <range> <integer> .', '<nation/n_name> <domain> <nation> .', '<nation/n_name> <range> <string> .', '<nation/n_regionkey> <domain> <nation> .', '<nation/n_regionkey> <range> <region> .', '<nation/n_regionkey> <type> <ObjectProperty> .']) AS line UNION ALL SELECT DISTINCT '<part/' || p_type || '> <subClassOf> <part> .' FROM part WHERE p_type IS NOT NULL")
def _(t):
    # a class for the type, a property for each column with its range: the target of a reference, else the kind of value
    path = files.scratch(t.spark)
    kinds = t.part.where("p_type is not null").select(F.concat(F.lit("<part/"), "p_type", F.lit("> <subClassOf> <part> .")).alias("line")).distinct()
    lines = files.schema_triples(t.nation, "nation", {"n_regionkey": "region"})
    lines.select(c(lines.columns[0]).alias("line")).union(kinds).write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@question("sink_graph_csv", "SELECT parent, child FROM (SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS child FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer)")
def _(t):
    return files.there_and_back(t.tree, "csv")


@question("src_catalog", "SELECT 'n_name' AS \"column\", 'string' AS kind, count(n_name) AS filled, count(DISTINCT n_name) AS distinct FROM nation UNION ALL SELECT 'n_nationkey', 'int', count(n_nationkey), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(n_regionkey), count(DISTINCT n_regionkey) FROM nation")
def _(t):
    # what the catalogue knows of a source, and how full its columns are
    t.nation.createOrReplaceTempView("_nation")
    known = t.spark.createDataFrame([(x.name, x.dataType) for x in t.spark.catalog.listColumns("_nation")], "column string, kind string")
    return known.join(profiles.kinds(t.nation).select("column", "filled", "distinct"), "column")


@question("src_file_fetch", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return t.spark.read.load(f"{t.folder}/region.parquet", format="parquet").select("r_regionkey", "r_name")
