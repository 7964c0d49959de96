"""Queries of the nested decision-tree records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minespark.operators import nested
from minespark.operators.rows import latest_rows
from minespark.tables import load


def tree_rows(spark: SparkSession, sf_dir: str):
    raw = load(spark, sf_dir, "tree_raw").filter(F.col("tree_key").isNotNull())
    last = latest_rows(raw, ["tree_key"], ["load_ts"], ["tree_json"])
    return nested.shred(last, "tree_key", "tree_json", envelopes=("tree", "forest"), repeated=("edges",))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from a node to its child nodes and leaves: both point to a row of ``edges``, which points to its node."""
    plan, rows = tree_rows(spark, sf_dir)
    nodes = nested.flat_table(plan, rows, "tree_key", "node", ["var"]).select("tree_key", F.col("id").alias("parent_path"), F.col("var").alias("parent_var"))
    kids = rows.filter(F.col("table_name").isin("node", "leaf") & (F.col("parent_table") == "edges")).select(
        "tree_key", F.regexp_replace("parent_id", r"\.[0-9]+$", "").alias("parent_path"), F.col("id").alias("child_path")
    )
    kids = kids.repartition("tree_key", "parent_path").distinct()  # one exchange for the distinct rows and the join
    return kids.join(nodes, ["tree_key", "parent_path"]).select("tree_key", "parent_path", "parent_var", "child_path")


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": r"""WITH RECURSIVE last AS (SELECT tree_key, arg_max(tree_json, [coalesce(epoch_us(load_ts), -9e18)]) AS t FROM tree_raw WHERE tree_key IS NOT NULL GROUP BY 1),
s0 AS (SELECT tree_key, trim(t, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS t FROM last),
s1 AS (SELECT tree_key, CASE WHEN t LIKE '"%' THEN TRY_CAST(regexp_extract(t, '^("(?:[^"\\]|\\.)*")', 1, 's') AS JSON) ->> '$' ELSE t END AS t FROM s0),
s2 AS (SELECT tree_key, CASE WHEN t LIKE '"%' THEN TRY_CAST(regexp_extract(t, '^("(?:[^"\\]|\\.)*")', 1, 's') AS JSON) ->> '$' ELSE t END AS t FROM s1),
s3 AS (SELECT tree_key, TRY_CAST(regexp_extract(t, '[{\[].*[}\]]', 0, 's') AS JSON) AS j FROM s2),
r0 AS (SELECT tree_key, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.tree') IN ('OBJECT', 'ARRAY') THEN j -> '$.tree' WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.forest') IN ('OBJECT', 'ARRAY') THEN j -> '$.forest' ELSE j END AS j FROM s3 WHERE j IS NOT NULL),
r1 AS (SELECT tree_key, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN j -> '$[*]' ELSE [j] END) AS j, unnest(range(CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j)::BIGINT ELSE 1 END)) AS no FROM r0),
r2 AS (SELECT tree_key, no, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.tree') IN ('OBJECT', 'ARRAY') THEN j -> '$.tree' ELSE j END AS j FROM r1),
walk(tree_key, path, node) AS (SELECT tree_key, CAST(no AS VARCHAR), j -> '$.node' FROM r2 WHERE json_type(j, '$.node') = 'OBJECT'
 UNION ALL SELECT tree_key, path || '.' || i, CASE WHEN json_type(e, '$.edge') = 'OBJECT' THEN e -> '$.edge.node' ELSE e -> '$.node' END
 FROM (SELECT tree_key, path, unnest(CASE json_type(node, '$.edges') WHEN 'ARRAY' THEN node -> '$.edges[*]' WHEN 'OBJECT' THEN [node -> '$.edges'] ELSE [] END) AS e, unnest(range(CASE json_type(node, '$.edges') WHEN 'ARRAY' THEN json_array_length(node, '$.edges')::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i FROM walk)
 WHERE json_type(CASE WHEN json_type(e, '$.edge') = 'OBJECT' THEN e -> '$.edge.node' ELSE e -> '$.node' END) = 'OBJECT'),
kids AS (SELECT tree_key, path, node ->> '$.var' AS var, unnest(CASE json_type(node, '$.edges') WHEN 'ARRAY' THEN node -> '$.edges[*]' WHEN 'OBJECT' THEN [node -> '$.edges'] ELSE [] END) AS e, unnest(range(CASE json_type(node, '$.edges') WHEN 'ARRAY' THEN json_array_length(node, '$.edges')::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i FROM walk)
SELECT tree_key, path AS parent_path, var AS parent_var, path || '.' || i AS child_path FROM (SELECT *, CASE WHEN json_type(e, '$.edge') = 'OBJECT' THEN e -> '$.edge' ELSE e END AS x FROM kids) WHERE json_type(x, '$.node') = 'OBJECT' OR json_type(x, '$.leaf') = 'OBJECT'"""
}
