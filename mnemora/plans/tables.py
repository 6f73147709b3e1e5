"""Memory tables seen in the driver's tables: the same text as a Spark view and as a DuckDB view.

``{str}`` and ``{days(x)}`` and the like stand for what the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2026-01-01 00:00:00"

VIEWS = {
    "facts": """
        SELECT 'd' || lpad(CAST(d.doc_id AS {str}), 9, '0') AS node_id, 'agent' || CAST(d.doc_id % 4 AS {str}) AS agent_id, d.source AS concept,
    d.text AS content,
          CAST(d.n_chars % 101 AS DOUBLE) / 100 AS confidence, 'c' || lpad(CAST(d.doc_id % 100 AS {str}), 6, '0') || '-0' AS source_id, {list}(d.lang,
    d.source){end} AS tags,
          '{{"temporal_index": ' || CAST(d.doc_id % 50 AS {str}) || CASE WHEN d.doc_id % 3 = 0 THEN ', "category": "' || d.lang || '"' ELSE '' END || '}}' AS metadata,
          TIMESTAMP '2026-01-01 00:00:00' - {hours}(d.doc_id % 2000){hend} AS created_at,
          coalesce(CAST(l.quality AS DOUBLE) * 0.5 + 0.4, CAST(d.n_chars % 101 AS DOUBLE) / 100) AS importance,
    CAST(d.doc_id % 7 AS BIGINT) AS usage_count,
          CASE WHEN d.doc_id % 6 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' - {hours}(d.doc_id % 300){hend} END AS last_accessed_at,
          CASE WHEN d.doc_id % 13 = 0 THEN TIMESTAMP '2026-02-01 00:00:00' - {hours}(d.doc_id % 1500){hend} END AS expires_at,
          d.doc_id % 11 = 0 AS archived, CASE WHEN d.doc_id % 17 = 0 THEN 'd' || lpad(CAST(d.doc_id + 1 AS {str}), 9, '0') END AS superseded_by,
          CASE WHEN d.doc_id % 5 = 0 THEN d.source || '-' || CAST(d.doc_id % 40 AS {str}) END AS dedup_key,
          CASE WHEN d.doc_id % 3 = 0 THEN lower(split_part(d.text, ' ', 1)) END AS entity_name
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "episodes": """
        SELECT 'c' || lpad(CAST(conv_id AS {str}), 6, '0') || '-' || CAST(turn AS {str}) AS node_id,
    'agent' || CAST(conv_id % 4 AS {str}) AS agent_id, text AS content, role AS source_label,
          conv_id * 100 + turn AS temporal_index, conv_id % 5 = 0 AS compressed, conv_id % 3 = 0 AS distilled,
    TIMESTAMP '2026-01-01 00:00:00' - {hours}(conv_id){hend} AS created_at
        FROM conversations""",
    "experiences": """
        SELECT 'e' || lpad(CAST(event_id AS {str}), 9, '0') AS experience_id, 'user' || CAST(user_id AS {str}) AS agent_name,
          CASE event_type WHEN 'signup' THEN 'insight' WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'pattern'
    ELSE 'success' END AS experience_type,
          event_type || ' of user number ' || CAST(user_id AS {str}) AS context, 'saw ' || props AS outcome,
    CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, CAST(ts AS TIMESTAMP) AS timestamp, event_id % 9 = 0 AS compressed
        FROM events""",
    "sensory": """
        SELECT 's' || lpad(CAST(event_id AS {str}), 9, '0') AS node_id, 'user' || CAST(user_id AS {str}) AS agent_id, event_type AS modality,
    props AS raw_data, event_id AS observation_order,
          CAST(ts AS TIMESTAMP) + {hours}(event_id % 48){hend} AS expires_at, CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
    "working": """
        SELECT 'w' || lpad(CAST(event_id AS {str}), 9, '0') AS node_id, 'agent' AS agent_id, event_type AS slot_type, props AS content,
    value AS relevance, 'u' || CAST(user_id % 50 AS {str}) AS task_id, CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
    "prospective": """
        SELECT 'p' || lpad(CAST(item_id AS {str}), 6, '0') AS node_id, 'agent' || CAST(item_id % 4 AS {str}) AS agent_id, text AS description,
    lower(split_part(text, ' ', 2)) AS trigger_condition,
          CASE WHEN item_id % 4 = 0 THEN 'resolved' ELSE 'pending' END AS status, CAST(item_id % 10 AS INT) AS priority
        FROM benchmark""",
    "procedures": """
        SELECT 'q' || lpad(CAST(p_partkey AS {str}), 6, '0') AS node_id, 'agent' AS agent_id, p_name AS name, {list}(p_type, p_brand){end} AS steps,
    p_partkey % 20 AS usage_count
        FROM part""",
    "nodes": """
        SELECT 'C' || CAST(c_custkey AS {str}) AS node_id, 'customer' AS node_type, c_name AS name, CAST(c_acctbal AS {str}) AS balance,
    c_mktsegment AS segment, CASE WHEN c_nationkey < 12 THEN 'local' ELSE 'remote' END AS graph_origin FROM customer
        UNION ALL SELECT 'S' || CAST(s_suppkey AS {str}), 'supplier', s_name, CAST(s_acctbal AS {str}), CAST(NULL AS {str}), 'local' FROM supplier
        UNION ALL SELECT 'N' || CAST(n_nationkey AS {str}), 'nation', n_name, CAST(NULL AS {str}), CAST(NULL AS {str}), CASE
    WHEN n_nationkey < 12 THEN 'local' ELSE 'remote' END FROM nation
        UNION ALL SELECT 'R' || CAST(r_regionkey AS {str}), 'region', r_name, CAST(NULL AS {str}), CAST(NULL AS {str}), 'local' FROM region""",
    "edges": """
        SELECT 'C' || CAST(c_custkey AS {str}) AS source_id, 'N' || CAST(c_nationkey AS {str}) AS target_id, 'LIVES_IN' AS edge_type FROM customer
        UNION ALL SELECT 'S' || CAST(s_suppkey AS {str}), 'N' || CAST(s_nationkey AS {str}), 'BASED_IN' FROM supplier
        UNION ALL SELECT 'N' || CAST(n_nationkey AS {str}), 'R' || CAST(n_regionkey AS {str}), 'PART_OF' FROM nation""",
    "links": """
        SELECT 'd' || lpad(CAST(doc_id AS {str}), 9, '0') AS source_id, 'd' || lpad(CAST(doc_id - 4 AS {str}), 9, '0') AS target_id,
    'SIMILAR_TO' AS edge_type, CAST(doc_id % 10 AS DOUBLE) / 10 AS weight FROM documents WHERE doc_id >= 4
        UNION ALL SELECT 'd' || lpad(CAST(doc_id AS {str}), 9, '0'), 'c' || lpad(CAST(doc_id % 100 AS {str}), 6, '0') || '-0', 'DERIVES_FROM', 1.0
    FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT 'd' || lpad(CAST(doc_id AS {str}), 9, '0'), 'd' || lpad(CAST(doc_id - 1 AS {str}), 9, '0'), 'SUPERSEDES', 1.0 FROM documents
    WHERE doc_id % 10 > 0 AND doc_id % 10 < 6""",
    "hive_agents": """
        SELECT 'S' || CAST(s_suppkey AS {str}) AS agent_id, n_name AS domain, CAST(floor(s_acctbal) AS DOUBLE) / 10000 AS trust FROM supplier
    JOIN nation ON s_nationkey = n_nationkey""",
    "discoveries": """
        SELECT 'f' || lpad(CAST(event_id AS {str}), 9, '0') AS discovery_id, event_type AS type, CASE
    WHEN event_id % 3 = 0 THEN 'k' || CAST(user_id % 10 AS {str}) END AS link_type,
          CASE WHEN event_id % 3 = 1 THEN 'tutorial_' || CAST(user_id AS {str}) || '.md' END AS file, CAST(ts AS TIMESTAMP) AS seen_at FROM events""",
}
_SPARK = {"str": "STRING", "list": "array", "end": "", "hours": "make_dt_interval(0, CAST", "hend": " AS INT))"}
_DUCK = {"str": "VARCHAR", "list": "list_value", "end": "", "hours": "to_hours(CAST", "hend": " AS INT))"}


def _spell(sql: str, words: dict[str, str]) -> str:
    sql = re.sub(r"\{hours\}(\([^{]*?\))\{hend\}", lambda m: f"{words['hours']}({m[1][1:-1]}{words['hend']}", sql)
    return sql.format(**words)


class Views:
    """The driver's tables and the memory views over them, as DataFrames by name; only what is asked for is built."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.raw(name)
        sql = _spell(VIEWS[name], _SPARK)
        needed = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
        quoted = sql.replace("{", "{{").replace("}", "}}")  # for the formatter of spark.sql
        return self.spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", r"\1 {\2}", quoted), **{t: self.raw(t) for t in needed})


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str) -> str:
    """``sql`` with the views that it names put in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = [f"{v} AS ({_spell(VIEWS[v], _DUCK)})" for v in used]
    recursive = "RECURSIVE " if "WITH RECURSIVE" in sql else ""
    body = re.sub(r"^\s*WITH (?:RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH ", sql) and views else sql
    return f"WITH {recursive}{', '.join(views)} {body}" if views else sql
