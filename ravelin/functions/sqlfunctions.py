"""The engine's functions under names that SQL can use: bodies are SQL, so Catalyst puts them into the query and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments and result, body.
FUNCTIONS = [
    ("sp_date", "t STRING", "DATE", "coalesce(try_to_date(regexp_extract(t, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), 'yyyy-MM-dd'), try_to_date(regexp_extract(t, '^([0-9]{8})', 1), 'yyyyMMdd'))"),
    ("sp_bigrams", "t STRING", "ARRAY<STRING>", "if(length(t) >= 2, array_distinct(transform(sequence(1, greatest(length(t) - 1, 1)), i -> substr(lower(t), i, 2))), cast(array() AS ARRAY<STRING>))"),
    ("sp_map_hash", "t STRING", "DOUBLE", "cast(conv(substr(md5(t), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"),
    ("sp_revision", "t STRING", "INT", "try_cast(regexp_extract(t, '([0-9]+)$', 1) AS INT)"),
    ("sp_lineage_stale", "pinned STRING, now STRING", "BOOLEAN", "pinned IS NOT NULL AND NOT pinned <=> now"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and gives their names; a session that has them gets them anew."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
