"""Signals, segments and predictions seen in the driver's relational tables.

``ctes`` gives the same views as SQL for either engine; ``frame_of`` reads one as a DataFrame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "labels", "pages", "benchmark", "conversations")
RATIOS = "CASE o_orderkey % 10 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN 2 WHEN 2 THEN CAST(1 AS DOUBLE) / 2 WHEN 3 THEN 3 WHEN 4 THEN CAST(1 AS DOUBLE) / 3 WHEN 5 THEN CAST(3 AS DOUBLE) / 2 WHEN 6 THEN CAST(2 AS DOUBLE) / 3 WHEN 7 THEN CAST(4 AS DOUBLE) / 3 WHEN 8 THEN CAST(3 AS DOUBLE) / 4 ELSE CAST(11 AS DOUBLE) / 10 END"

#: Views by name; {us:a,b} is the engine's microseconds from a to b, {explode:...} its array unnesting.
VIEWS = {
    "samples": {
        "spark": "SELECT vec_id AS track, i, CAST(v AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS i, v",
        "duckdb": "SELECT vec_id AS track, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings",
    },
    "onset": "SELECT user_id AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, value AS x FROM events",
    "segs": """SELECT track, idx, CAST({us:first_ts,ts} AS DOUBLE) / 1000000 AS start_s, CAST({us:first_ts,next_ts} AS DOUBLE) / 1000000 AS end_s, CAST(event_id % 24 AS INTEGER) AS key_idx, event_type
        FROM (SELECT user_id AS track, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, ts, lead(ts) OVER w AS next_ts, min(ts) OVER (PARTITION BY user_id) AS first_ts, event_id, event_type
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) q WHERE next_ts IS NOT NULL""",
    "preds": f"""SELECT o_orderkey AS track, o_orderpriority AS tool, CAST(o_custkey % 24 AS INTEGER) AS expected_key,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 24 AS INTEGER) END AS detected_key,
        CAST(60 + o_custkey % 141 AS DOUBLE) AS expected_bpm,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(60 + o_custkey % 141 AS DOUBLE) * ({RATIOS}) END AS detected_bpm, o_totalprice AS elapsed
        FROM orders""",
}


def _dialect(sql: str, engine: str) -> str:
    form = "timestampdiff(MICROSECOND, {}, {})" if engine == "spark" else "date_diff('microsecond', {}, {})"
    return re.sub(r"\{us:(\w+),(\w+)\}", lambda m: form.format(m[1], m[2]), sql)


def view_sql(name: str, engine: str) -> str:
    v = VIEWS[name]
    return _dialect(v if isinstance(v, str) else v[engine], engine)


def with_views(body: str, engine: str) -> str:
    """``body`` with the views that it names put before it as CTEs."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    heads = [f"{v} AS ({view_sql(v, engine)})" for v in used]
    body = _dialect(body.strip(), engine)
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*heads, body[5:]])
    return f"WITH {', '.join(heads)} {body}" if heads else body


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Runs SQL over the tables of ``sf_dir``: only those it names are read, nothing is registered in the session."""
    sql = with_views(body, "spark")
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    bound = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    for t in names:
        sql = re.sub(rf"(?<![\w.])((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", sql, flags=re.I)
    return spark.sql(sql, **bound)


def frame_of(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {view}")
