"""Questions about single values: readings, keys, periods, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import scalars, sqlfunctions
from ravelin.functions import texts as keys
from ravelin.operators import matching, tags
from ravelin.plans.parts import WEIGHED, part_tags
from ravelin.plans.registry import DATES, ODD_DATES, ODD_VALUES, RECORDS, VALUES, question

c = F.col


def dates(t):
    return t.orders.selectExpr("o_orderkey AS id", f"{ODD_DATES} AS v")


def texts(t):
    return t.part.selectExpr("p_partkey AS id", f"{ODD_VALUES} AS v")


_GUARDED = "CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') OR regexp_matches(v, '^[0-9]{8}') THEN try_strptime(replace(v[1:10], '-', '')[1:8], '%Y%m%d')::DATE END"
question("fn_sp_date", f"SELECT id, {_GUARDED} AS d FROM {DATES}")(lambda t: dates(t).select("id", scalars.guarded_date(c("v")).alias("d")))


@question("udf_sp_date", f"SELECT id, {_GUARDED} AS d FROM {DATES}")
def _(t):
    sqlfunctions.register(t.spark)
    return dates(t).selectExpr("id", "sp_date(v) AS d")


@question("fn_date_guard", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS shipped, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate::DATE END AS written FROM lineitem")
def _(t):
    # a column of times is read as it is, one of texts is guarded: some lines hold a day that doesn't exist
    rows = t.lineitem.withColumn("text", F.when(c("l_linenumber") == 3, "2024-02-31").when(c("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm")))
    kinds = dict(rows.dtypes)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scalars.date_or_null(c("l_shipdate"), kinds["l_shipdate"]).alias("shipped"), scalars.date_or_null(c("text"), kinds["text"]).alias("written"))


_FREE = "coalesce(CASE WHEN regexp_matches(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})') THEN try_strptime(replace(v[1:10], '-', '')[1:8], '%Y%m%d') END, try_strptime(regexp_replace(trim(v), '[./]', '-', 'g'), ['%Y-%m-%d', '%Y-%m']))"


@question("fn_parse_date", f"SELECT id, ({_FREE})::DATE AS d FROM {DATES}")
def _(t):
    return dates(t).select("id", scalars.free_date(c("v")).alias("d"))


@question("fn_parse_datetime", f"SELECT id, coalesce(try_strptime(regexp_replace(replace(trim(v), 'T', ' '), '[./]', '-', 'g'), ['%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S']), CASE WHEN NOT contains(v, ':') THEN {_FREE.replace('v[1:10]', 'trim(v)[1:10]').replace('regexp_matches(v', 'regexp_matches(trim(v)')} END) AS at FROM {DATES}")
def _(t):
    return dates(t).select("id", scalars.free_datetime(c("v")).alias("at"))


@question("fn_numeric", f"SELECT id, CASE WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN v::DOUBLE END AS x FROM {VALUES}")
def _(t):
    return texts(t).select("id", scalars.numeric(c("v")).alias("x"))


@question("fn_convert", f"SELECT id, CASE WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN 'number' WHEN lower(v) IN ('true', 't', 'yes', 'y', 'on') THEN 'bool' WHEN v IS NULL OR v IN ('', 'null') THEN 'missing' ELSE 'text' END AS kind FROM {VALUES}")
def _(t):
    kind = F.when(scalars.missing(c("v")), "missing").when(scalars.numeric(c("v")).isNotNull(), "number").when(scalars.truth(c("v")), "bool").otherwise("text")
    return texts(t).select("id", kind.alias("kind"))


_PIECES = "SELECT p_partkey, count(DISTINCT lower(p_name)[i:i + 1]) AS n FROM part, range(1, 100) r(i) WHERE i < length(p_name) GROUP BY 1"
question("fn_bigrams", _PIECES)(lambda t: t.part.select("p_partkey", F.size(scalars.bigrams(c("p_name"))).cast("long").alias("n")))


@question("udf_bigrams", _PIECES)
def _(t):
    sqlfunctions.register(t.spark)
    return t.part.select("p_partkey", F.expr("cast(size(sp_bigrams(p_name)) AS bigint)").alias("n"))


# the second alphabet of the full-width letters of the table above
_WIDE = "translate(v, 'Ｆｕｌ　Ｗｉｄｅ１２', 'Ful Wide12')"
question("fn_norm_key", f"SELECT id, lower(regexp_replace(trim({_WIDE}), '\\s+', ' ', 'g')) AS k FROM {VALUES}")(lambda t: texts(t).select("id", keys.norm_key(c("v")).alias("k")))
question("fn_compare_key", "SELECT p_partkey, lower(p_brand || ' ' || p_name) AS k FROM part")(lambda t: t.part.select("p_partkey", keys.norm_key(F.concat_ws("\u3000", "p_brand", F.lit(""), "p_name")).alias("k")))


@question("fn_search_words", "SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) WHERE length(w) >= 2")
def _(t):
    return t.documents.select("doc_id", F.explode(keys.search_words(c("text"))).alias("w")).distinct()


@question("fn_bucket", "SELECT event_id, ts::DATE AS day, date_trunc('week', ts)::DATE AS week, date_trunc('month', ts)::DATE AS month, date_trunc('quarter', ts)::DATE AS quarter, date_trunc('year', ts)::DATE AS year FROM events")
def _(t):
    return t.events.select("event_id", *[scalars.bucket(c("ts"), g).alias(g) for g in scalars.GRAINS])


@question("fn_age", f"SELECT o_orderkey, l_linenumber, l_partkey, age, (year(l_shipdate) - year(o_orderdate))::INT AS years FROM {RECORDS} x")
def _(t):
    return t.records.select("o_orderkey", "l_linenumber", "l_partkey", "age", scalars.age(scalars.bucket(c("o_orderdate"), "year"), scalars.bucket(c("l_shipdate"), "year"), "year").alias("years"))


@question("fn_period_label", "SELECT event_id, strftime(ts, '%G-W%V') AS week, year(ts) || '-Q' || quarter(ts) AS quarter, strftime(ts, '%Y-%m') AS month FROM events")
def _(t):
    return t.events.select("event_id", *[scalars.period_label(c("ts"), g).alias(g) for g in ("week", "quarter", "month")])


@question("fn_next_period", "SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next, (date_trunc('month', o_orderdate) - INTERVAL 3 MONTH)::DATE AS before FROM orders")
def _(t):
    m = scalars.bucket(c("o_orderdate"), "month")
    return t.orders.select(m.alias("m")).distinct().select("m", scalars.shifted(c("m"), "month", 1).alias("next"), scalars.shifted(c("m"), "quarter", -1).alias("before"))


@question("fn_shift", "SELECT event_id, (date_trunc('week', ts)::DATE + 14)::DATE AS later FROM events")
def _(t):
    return t.events.select("event_id", scalars.shifted(scalars.bucket(c("ts"), "week"), "week", 2).alias("later"))


@question("fn_dense", "SELECT period, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(date_trunc('month', o_orderdate))::DATE, (max(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH)::DATE, INTERVAL 1 MONTH))::DATE AS period FROM orders) LEFT JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n FROM orders WHERE o_custkey % 50 = 7 AND o_orderstatus = 'P' GROUP BY 1) USING (period)")
def _(t):
    from ravelin.operators.metrics import dense

    month = scalars.bucket(c("o_orderdate"), "month")
    ends = t.orders.agg(F.min(month).cast("string"), F.max(month).cast("string")).first()
    few = t.orders.where("o_custkey % 50 = 7 and o_orderstatus = 'P'").groupBy(month.alias("period")).agg(F.count("*").alias("n"))
    return dense(t.spark, *ends).join(few, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


@question("fn_is_closed", "SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS q, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE <= DATE '2001-07-15' - 20 AS closed FROM orders")
def _(t):
    q = scalars.bucket(c("o_orderdate"), "quarter")
    return t.orders.select(q.alias("q")).distinct().withColumn("closed", scalars.is_closed(c("q"), "quarter", F.lit("2001-07-15").cast("date"), 20))


@question("fn_has_gap", "SELECT (max(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH)::DATE < DATE '2001-11-01' - INTERVAL 1 MONTH AS gap FROM orders")
def _(t):
    through = scalars.bucket(F.max("o_orderdate"), "month")
    return t.orders.agg((scalars.shifted(through, "month", 1) < F.add_months(F.lit("2001-11-01").cast("date"), -1)).alias("gap"))


@question("fn_mask", "SELECT p_brand, regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM part")
def _(t):
    return t.part.select("p_brand", scalars.mask(c("p_brand")).alias("shape"))


@question("fn_code_parser", "WITH x AS (SELECT p_partkey, p_type, CASE WHEN p_size = 50 THEN '' WHEN p_size % 10 = 0 THEN p_brand || '_' || p_type || '_x_y_z' WHEN p_size > 25 THEN p_brand || '_' || p_type || '_' || p_size ELSE p_brand || '_' || p_type END AS code FROM part), y AS (SELECT *, regexp_full_match(code, 'Brand#[0-9]+_[A-Z]+(_[0-9]+)?') AS ok FROM x) SELECT p_partkey, CASE WHEN ok THEN regexp_extract(code, '^Brand#([0-9]+)', 1)::INT END AS brand, CASE WHEN ok THEN split_part(code, '_', 2) END AS kind, CASE WHEN ok AND code LIKE '%\\_%\\_%' ESCAPE '\\' THEN split_part(code, '_', 3)::INT END AS size, CASE WHEN code = '' THEN 'blank' WHEN NOT ok THEN 'unreadable' WHEN p_type = 'LARGE' AND code NOT LIKE '%\\_%\\_%' ESCAPE '\\' THEN 'size_required' END AS failure FROM y")
def _(t):
    code = F.when(c("p_size") == 50, "").when(c("p_size") % 10 == 0, F.concat_ws("_", "p_brand", "p_type", F.lit("x_y_z"))).when(c("p_size") > 25, F.concat_ws("_", "p_brand", "p_type", "p_size")).otherwise(F.concat_ws("_", "p_brand", "p_type"))
    slots = [keys.Slot("brand", "Brand#[0-9]+"), keys.Slot("kind", "[A-Z]+"), keys.Slot("size", "[0-9]+", optional=True)]
    read = t.part.withColumn("code", code).select("p_partkey", "p_type", *keys.code_slots(c("code"), slots))
    read = keys.checked(read, [("size_required", (c("p_type") != "LARGE") | c("size").isNotNull())])
    return read.select("p_partkey", F.regexp_extract("brand", "[0-9]+", 0).cast("int").alias("brand"), "kind", c("size").cast("int").alias("size"), "failure")


@question("fn_validate", "SELECT p_partkey, list_filter([CASE WHEN nullif(p_name, '') IS NULL OR p_size % 9 = 0 THEN 'required' END, CASE WHEN p_size > 45 THEN 'range' END, CASE WHEN regexp_matches((p_retailprice / 4)::DECIMAL(18, 4)::VARCHAR, '[.][0-9]{2}[0-9]*[1-9]') THEN 'decimals' END, CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[0-9]') THEN 'pattern' END, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'enum' END], lambda x: x IS NOT NULL) AS faults FROM part")
def _(t):
    given, price = F.when(c("p_size") % 9 != 0, c("p_name")), (c("p_retailprice") / 4).cast("decimal(18,4)")
    rules = [
        scalars.required(given),
        scalars.in_range(c("p_size"), high=45),
        scalars.decimals(price, 2),
        scalars.shaped(c("p_brand"), "Brand#[0-9]"),
        scalars.one_of(c("p_type"), ["ECONOMY", "SMALL", "LARGE"]),
    ]
    return t.part.select("p_partkey", F.array_compact(F.array(*rules)).alias("faults"))


@question("fn_retype", f"SELECT id, CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN v::BIGINT END AS whole, v IS NOT NULL AND v <> '' AND NOT regexp_full_match(v, '-?[0-9]+') AS failed FROM {VALUES}")
def _(t):
    fits = c("v").rlike("^-?[0-9]+$")
    return texts(t).select("id", F.when(fits, c("v").try_cast("bigint")).alias("whole"), (c("v").isNotNull() & (c("v") != "") & ~fits).alias("failed"))


_CODES = "(VALUES (1, 'Part_7_red'), (2, 'PART_7_RED'), (3, 'part_12'), (4, 'part_1'), (5, 'nothing')) AS q(id, asked)"
_KEYS = "(SELECT 'Part_' || p_partkey || '_' || split_part(p_name, ' ', 1) AS k FROM part UNION SELECT 'Part_7_red' UNION SELECT 'part_1_a' UNION SELECT 'part_1_b')"


@question("fn_key_match", f"WITH k AS (SELECT k, upper(k) AS u FROM {_KEYS}), f AS (SELECT k, upper(k[1:i - 1]) AS front FROM k, range(2, 40) r(i) WHERE i <= length(k) AND k[i:i] IN ('_', '-', ' ')), s AS (SELECT id, 1 AS step, k FROM {_CODES} JOIN k ON k = asked UNION SELECT id, 2, k FROM {_CODES} JOIN k ON u = upper(asked) UNION SELECT id, 3, k FROM {_CODES} JOIN f ON front = upper(asked)), b AS (SELECT id, step, count(DISTINCT k) AS n, min(k) AS k FROM s GROUP BY 1, 2), w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY step) = 1) SELECT q.id, CASE WHEN n = 1 THEN w.k END AS found, CASE WHEN n > 1 THEN 'several' ELSE coalesce(['exact', 'case', 'prefix'][step], 'none') END AS how FROM {_CODES} LEFT JOIN w ON q.id = w.id")
def _(t):
    named = t.part.select(F.concat(F.lit("Part_"), "p_partkey", F.lit("_"), F.split("p_name", " ")[0]).alias("k"))
    named = named.union(t.spark.sql("SELECT explode(array('Part_7_red', 'part_1_a', 'part_1_b'))")).distinct()
    return matching.key_match(t.spark.sql(f"SELECT * FROM {_CODES}"), "id", "asked", named, "k")


@question("fn_map_value", "SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'SMALL' THEN 'S' END, upper(p_type)) AS code FROM part")
def _(t):
    known = F.create_map(F.lit("ECONOMY"), F.lit("E"), F.lit("SMALL"), F.lit("S"))
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(known, c("p_type")), F.upper("p_type")).alias("code"))


@question("fn_multi_array", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@question("fn_weighted_jaccard", f"WITH {WEIGHED}, s AS (SELECT y.id, sum(w) AS s FROM o x JOIN o y ON x.tag = y.tag JOIN w ON w.tag = x.tag WHERE x.id = 1 GROUP BY 1) SELECT t.id, round(coalesce(s / (total + (SELECT total FROM t WHERE id = 1) - s), 0), 9) AS similarity FROM t LEFT JOIN s ON t.id = s.id")
def _(t):
    """Similarity of every part with the first one, a rare tag weighing more."""
    own = part_tags(t).where("tag is not null").distinct()
    sets = own.join(tags.weights(own, "id", "tag"), "tag").groupBy("id").agg(F.collect_list(F.struct("tag", "w")).alias("own"))
    one = sets.where("id = 1").select(c("own").alias("asked"))
    return sets.crossJoin(F.broadcast(one)).select("id", F.round(tags.weighted_jaccard(c("own"), c("asked")), 9).alias("similarity"))


@question("fn_sections")
def _(t):
    """Sections of every whole document under the headings of its text, with those of a heading made from its language in front."""
    body = F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return keys.sections(t.documents.select("doc_id", body.alias("body")), "doc_id", "body")


@question("fn_level", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'middle' ELSE 'low' END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.rung(c("p_size"), [(20, "middle"), (40, "high")], "low").alias("level"))


@question("fn_rung", "SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'b' ELSE 'a' END AS rung FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", scalars.rung(c("s_acctbal"), [(5000, "b")], "a").alias("rung"))


@question("fn_accuracy", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


question("fn_stale", "SELECT o_orderkey, o_orderstatus IS DISTINCT FROM 'F' AS stale FROM orders")(lambda t: t.orders.select("o_orderkey", (~c("o_orderstatus").eqNullSafe("F")).alias("stale")))


@question("udf_lineage_stale", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN false ELSE p_brand <> 'Brand#' || (p_partkey % 25) END AS stale, regexp_extract(p_brand, '[0-9]+$')::INT AS revision FROM part")
def _(t):
    # a result pins the revision that it was made from; without a pin it is never stale
    sqlfunctions.register(t.spark)
    return t.part.select("p_partkey", F.expr("sp_lineage_stale(if(p_size % 5 = 0, null, 'Brand#' || (p_partkey % 25)), p_brand)").alias("stale"), F.expr("sp_revision(p_brand)").alias("revision"))


@question("udf_map_hash", "SELECT p_partkey, md5(p_partkey::VARCHAR)[1:2] < '80' AS left_half FROM part")
def _(t):
    sqlfunctions.register(t.spark)
    return t.part.select("p_partkey", F.expr("sp_map_hash(cast(p_partkey AS string)) < 0.5").alias("left_half"))


@question("src_nested_pick", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT > 50")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 50")


@question("fn_chunks")
def _(t):
    """Chunks of every whole document by paragraph, of 1500 letters at most."""
    return t.documents.where("text <> ''").select("doc_id", F.posexplode(keys.chunks(c("text"))).alias("place", "chunk"))
