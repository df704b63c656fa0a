"""Parts with tags, for the questions by weighted tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.sources.tables import Tables

#: What describes a part: its words, brand, type and size class.
PART_TAGS = "(SELECT p_partkey AS id, unnest(list_concat(list_transform(string_split(p_name, ' '), lambda w: 'word ' || w), ['brand ' || p_brand, 'type ' || p_type, 'size ' || p_size // 5])) AS tag FROM part)"
WEIGHED = f"""o AS (SELECT DISTINCT id, tag FROM {PART_TAGS} WHERE tag IS NOT NULL), n AS (SELECT count(DISTINCT id) AS n FROM o), w AS (SELECT tag, round(ln(n / count(*)) * 1000000)::BIGINT AS w FROM o, n GROUP BY tag, n), t AS (SELECT id, sum(w) AS total FROM o JOIN w USING (tag) GROUP BY 1)"""


def part_tags(t: Tables) -> DataFrame:
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("word "), w))
    rest = F.array(F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("type "), "p_type"), F.concat(F.lit("size "), F.floor(F.col("p_size") / 5).cast("string")))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(F.concat(words, rest)).alias("tag"))
