"""Questions by words, letters and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import texts as keys
from ravelin.functions.scalars import bigrams
from ravelin.operators import matching, tags, vectorindex, vectors
from ravelin.operators.relations import all_of, any_of, contains
from ravelin.plans.parts import WEIGHED, part_tags
from ravelin.plans.registry import near_names_sql, question

c = F.col


def within(column: str, words: list[str]):
    """All words within one field."""
    return all_of(*[contains(c(column), w) for w in words])


def hits(t, words=("bl", "bolt")):
    """Objects of all types one of whose fields (label, key, alias) has all words."""
    fields = [(t.part, "p_partkey", "part", ["p_name", "p_brand", "p_type"]), (t.supplier, "s_suppkey", "supplier", ["s_name"]), (t.customer, "c_custkey", "customer", ["c_name", "c_mktsegment"])]
    out = None
    for rows, key, kind, names in fields:
        one = rows.where(any_of(*[F.coalesce(within(n, list(words)), F.lit(False)) for n in names])).select(F.lit(kind).alias("type"), c(key).cast("long").alias("id"))
        out = one if out is None else out.union(one)
    return out


def _within(field: str, words=("bl", "bolt")) -> str:
    return "(" + " AND ".join(f"contains(lower({field}), '{w}')" for w in words) + ")"


_HITS = f"(SELECT 'part' AS type, p_partkey AS id FROM part WHERE {_within('p_name')} OR {_within('p_brand')} OR {_within('p_type')} UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE {_within('s_name')} UNION ALL SELECT 'customer', c_custkey FROM customer WHERE {_within('c_name')} OR {_within('c_mktsegment')})"
question("search_global", f"SELECT * FROM {_HITS}")(hits)
question("search_counts", f"SELECT type, count(*) AS n FROM {_HITS} GROUP BY 1")(lambda t: hits(t).groupBy("type").agg(F.count("*").alias("n")))


@question("search_containing", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') UNION SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#1')")
def _(t):
    return t.part.where(contains(c("p_name"), "ring")).select("p_partkey").union(t.part.where(contains(c("p_brand"), "#1")).select("p_partkey")).distinct()


@question("search_fields", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '9') OR contains(lower(c_mktsegment), '9') OR contains(c_acctbal::VARCHAR, '9')")
def _(t):
    # a term is looked for in all fields of a view; one is enough
    return t.customer.where(any_of(*[F.coalesce(contains(x, "9"), F.lit(False)) for x in (c("c_name"), c("c_mktsegment"), c("c_acctbal").cast("string"))])).select("c_custkey")


_GRAMS = "(SELECT DISTINCT p_name, lower(p_name)[i:i + 1] AS g FROM part, range(1, 60) r(i) WHERE i < length(p_name))"


@question("search_bigram", f"SELECT p_name, count(*) AS shared FROM {_GRAMS} WHERE g IN ('bl', 'lu', 'ue', 'e ', ' b', 'bo', 'ol', 'lt') GROUP BY 1 HAVING count(*) >= 4")
def _(t):
    asked = bigrams(F.lit("blue bolt"))
    return t.part.select("p_name").distinct().select("p_name", F.size(F.array_intersect(bigrams(c("p_name")), asked)).cast("long").alias("shared")).where("shared >= 4")


_NEAR = "(VALUES (1, 'blue bolt'), (2, 'reed gear'), (3, 'washer grn')) AS q(id, asked)"


@question("search_trigram", f"SELECT id, p_name, round(similarity, 6) AS similarity FROM {near_names_sql(_NEAR, 'part', 'p_name', 0.3)}")
def _(t):
    # names near what was asked, as a whole or within a longer name, by three-letter pieces; only shared pieces make pairs
    asked = t.spark.sql(f"SELECT * FROM {_NEAR}")
    return matching.near_names(asked, "id", "asked", t.part, "p_name", 0.3).withColumn("similarity", F.round("similarity", 6))


#: Pieces of one object lie side by side; the given vectors are scattered, so their floor is lower than that of texts.
_PIECES_OF, _FLOOR = 2, 0.2
_SCORED = """(WITH r AS (SELECT DISTINCT vec_id // {0} AS o, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT e, count(*) AS same FROM r GROUP BY 1), q AS (SELECT vec_id, vec_id // {0} AS o, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
 p AS (SELECT q.vec_id AS query, r.e, min(r.o) AS found, any_value(list_cosine_similarity(q.e, r.e)) AS score FROM q JOIN r ON q.o <> r.o GROUP BY 1, 2)
 SELECT query, found, max(score) AS score, arg_max(same, (score, same)) AS same FROM p JOIN s ON p.e = s.e GROUP BY 1, 2)""".format


@question("vector_topk", f"SELECT query, found, round(score, 6) AS score, same, row_number() OVER (PARTITION BY query ORDER BY score DESC, found)::INT AS rank FROM {_SCORED(_PIECES_OF)} WHERE score >= {_FLOOR} QUALIFY rank <= 8")
def _(t):
    """The nearest objects of every fiftieth vector, by their best pieces and not below a floor."""
    found = vectors.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 8, _FLOOR, F.expr(f"vec_id div {_PIECES_OF}"))
    return found.select("query", "found", F.round("score", 6).alias("score"), "same", "rank")


@question("topk_similar", f"SELECT query, found, row_number() OVER (PARTITION BY query ORDER BY score DESC, found)::INT AS rank FROM {_SCORED(1)} QUALIFY rank <= 5")
def _(t):
    return vectors.nearest_many(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, -1.0).select("query", "found", "rank")


@question("vector_lsh")
def _(t):
    """Approximate search by an index: nearest five of every fiftieth vector, the recall against the exact search, and the share of the rows
    that a query scores exactly."""
    asked = t.embeddings.where("vec_id % 50 = 0")
    index = vectorindex.Index(t.embeddings, "vec_id", "embedding")
    found = index.search(asked, 5).select("query", "found", "rank")
    exact = vectors.nearest_many(t.embeddings, asked, "vec_id", "embedding", 5, -1.0)
    return found.crossJoin(F.broadcast(vectors.recall(found, exact).select("recall"))).withColumn("scored", F.lit(index.scored_share()))


@question("vector_sync", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def _(t):
    own = t.documents.select("doc_id", F.md5(c("text").cast("binary")).alias("h"))
    return own.join(own.where("doc_id % 3 = 0").select("h"), "h", "left_anti").select("doc_id")


@question("search_similar", f"WITH {WEIGHED}, p AS (SELECT x.id AS id, y.id AS found, sum(w) AS s FROM o x JOIN o y ON x.tag = y.tag AND x.id <> y.id JOIN w ON w.tag = x.tag WHERE w > 0 GROUP BY 1, 2) SELECT p.id, found, round(s / (a.total + b.total - s), 9) AS score, row_number() OVER (PARTITION BY p.id ORDER BY s / (a.total + b.total - s) DESC, found)::INT AS rank FROM p JOIN t a ON p.id = a.id JOIN t b ON found = b.id QUALIFY rank <= 5")
def _(t):
    """The five nearest parts of every part by weighted tags."""
    return tags.nearest_by_tags(part_tags(t), "id", "tag", 5).withColumn("score", F.round("score", 9))


_ASKED = "(VALUES (1, 'BLUE bolt'), (2, '17'), (3, 'Brand#3'), (4, 'nothing at all'), (5, 'blu bolt'), (6, '  red   GEAR '), (7, 'brand no 7')) AS q(id, asked)"
_KEYED = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))".format
_SIX = f"""(WITH q AS (SELECT id, asked, {_KEYED('asked')} AS k FROM {_ASKED}), a AS (SELECT p_partkey, 'brand no ' || split_part(p_brand, '#', 2) AS alias FROM part),
 r AS (SELECT id, 1 AS step, p_partkey FROM q JOIN part ON p_partkey::VARCHAR = k UNION ALL SELECT id, 2, p_partkey FROM q JOIN part ON lower(p_brand) = k UNION ALL SELECT id, 3, p_partkey FROM q JOIN a ON alias = k
 UNION ALL SELECT id, 4, p_partkey FROM q JOIN part ON {_KEYED('p_name')} = k UNION ALL SELECT id, 5, p_partkey FROM q JOIN part ON contains({_KEYED('p_name')}, k) UNION ALL SELECT id, 6, p_partkey FROM q JOIN part ON levenshtein({_KEYED('p_name')}, k) <= 2)
 SELECT q.id, CASE WHEN n = 1 THEN b.p_partkey END AS found, CASE WHEN n > 1 THEN 'several' ELSE coalesce(['id', 'key', 'alias', 'label', 'contains', 'near'][b.step], 'none') END AS how FROM q LEFT JOIN (SELECT id, step, count(DISTINCT p_partkey) AS n, min(p_partkey) AS p_partkey FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY step) = 1) b ON q.id = b.id)"""


def resolve(t):
    """Six rungs: id, key, alias, label, a label that contains the text, a label near it. The first rung that finds something decides; if it
    finds several objects, none is chosen, as it would be a guess. Only what the equal rungs leave open is held against labels, and
    only against those with equal pieces."""
    asked = t.spark.sql(f"SELECT * FROM {_ASKED}").withColumn("k", keys.norm_key(c("asked")))
    part = t.part.select("p_partkey", c("p_partkey").cast("string").alias("ident"), F.lower("p_brand").alias("brand"), F.concat(F.lit("brand no "), F.split("p_brand", "#")[1]).alias("alias"), keys.norm_key(c("p_name")).alias("label"))
    equal = [(name, part.select(c(column).alias("_k"), "p_partkey"), c("k"), "stop") for name, column in (("id", "ident"), ("key", "brand"), ("alias", "alias"), ("label", "label"))]
    first = matching.ladder(asked, "id", equal, "p_partkey")
    open_ = asked.join(first.where("how = 'none'").select("id"), "id")
    # hits by label become rungs of their own: a text is equal to itself there
    pairs = [(name, find(open_, "id", "k", part, "label").join(part.select("label", "p_partkey"), "label").select(c("id").cast("string").alias("_k"), "p_partkey"), c("id").cast("string"), "stop") for name, find in (("contains", matching.containing), ("near", matching.misspelled))]
    late = matching.ladder(open_, "id", pairs, "p_partkey").select("id", c("p_partkey").alias("late"), c("how").alias("late_how"))
    out = first.join(late, "id", "left")
    return out.select("id", F.coalesce("p_partkey", "late").alias("found"), F.when(c("how") == "none", F.coalesce("late_how", "how")).otherwise(c("how")).alias("how"))


question("fn_resolve", f"SELECT * FROM {_SIX}")(resolve)
question("resolve_many", f"SELECT id, found IS NOT NULL AS resolved FROM {_SIX}")(lambda t: resolve(t).select("id", c("found").isNotNull().alias("resolved")))


@question("alias_lookup", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON lower(replace(n_name, '_', ' ')) = 'nation ' || (p_partkey % 25)")
def _(t):
    alias = t.nation.select("n_nationkey", F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("k"))
    return t.part.withColumn("k", F.concat(F.lit("nation "), (c("p_partkey") % 25).cast("string"))).join(alias, "k").select("p_partkey", "n_nationkey")
