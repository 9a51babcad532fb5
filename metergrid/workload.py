"""The tables that the registered queries run on: usage events, a rate catalog and saved rules, from the driver's tables.

The same SELECT makes the events in Spark and in DuckDB; `dialect` names the few expressions that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metergrid import tables
from metergrid.operators import store

#: The clock of all queries, and the device that wins ties between copies.
NOW = "2024-01-25T15:30:00+00:00"
LOCAL_DEVICE = "dev-0"

DIALECT = {
    "spark": {"k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "ms": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})", "string": "STRING", "each": "explode({})", "list": ("array(", ")")},
    "duckdb": {"k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "ms": "(epoch_us({}) // 1000)", "string": "VARCHAR", "each": "unnest({})", "list": ("[", "]")},
}


def events_sql(dialect: str, table: str = "events") -> str:
    d = DIALECT[dialect]
    return f"""
WITH base AS (SELECT event_id, user_id, event_type, value, ts, {d["k"]} AS k FROM {table}),
orig AS (
  SELECT event_id, concat('u:', CAST(event_id AS {d["string"]})) AS id, ts,
    CASE event_type WHEN 'click' THEN 'claude' WHEN 'view' THEN 'codex' WHEN 'purchase' THEN 'grok' WHEN 'signup' THEN 'pi' ELSE 'cursor' END AS harness,
    concat('dev-', CAST(user_id % 4 AS {d["string"]})) AS device_id,
    CASE CAST((event_id + user_id) % 8 AS INT)
      WHEN 0 THEN 'gpt-6.1-sol' WHEN 1 THEN 'claude-fable-5-1-20260101' WHEN 2 THEN 'xai/grok-4.6' WHEN 3 THEN 'gemini-3-pro'
      WHEN 4 THEN 'house-alias' WHEN 5 THEN 'house-free' WHEN 6 THEN 'house-custom' ELSE 'quasar-alpha' END AS raw_model,
    concat('/work/p', CAST(user_id % 13 AS {d["string"]})) AS project,
    CASE WHEN user_id % 13 < 9 THEN concat('github.com/org/r', CAST(user_id % 9 AS {d["string"]})) END AS repository,
    CASE WHEN event_type = 'error' THEN '' ELSE concat('s', CAST(user_id AS {d["string"]}), '-', CAST(CAST(ts AS DATE) AS {d["string"]})) END AS session_id,
    CASE WHEN event_id % 7 = 0 THEN concat('Title ', CAST(event_id % 5 AS {d["string"]})) END AS session_title,
    CASE WHEN event_id % 9 = 0 THEN concat(' Name ', CAST(user_id % 3 AS {d["string"]}), ' ') WHEN event_id % 9 = 1 THEN ' ' END AS project_name,
    CASE WHEN event_id % 13 = 0 THEN concat('t', CAST(event_id % 3 AS {d["string"]})) END AS thread_id,
    CASE WHEN event_id % 26 = 0 THEN concat('https://t.example/', CAST(event_id % 3 AS {d["string"]})) END AS thread_url,
    k * 40 AS input_tokens, k * 7 + 1 AS output_tokens,
    CASE WHEN event_id % 50 = 0 THEN k * 4000 ELSE k * 25 END AS cache_read_tokens,
    CASE WHEN event_id % 3 = 0 THEN k * 5 ELSE 0 END AS cache_write_tokens,
    k * 2 AS reasoning_tokens,
    CASE WHEN event_id % 3 = 0 THEN k * 2 WHEN event_id % 11 = 1 THEN CAST(NULL AS BIGINT) ELSE 0 END AS cache_write_1h_tokens,
    CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'priority' WHEN 1 THEN 'unmapped' WHEN 2 THEN CAST(NULL AS {d["string"]}) ELSE '' END AS service_tier,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value / 100 END AS reported_cost_usd,
    CAST(CASE WHEN event_type = 'purchase' THEN 1 + event_id % 4 WHEN event_type = 'error' THEN 0 END AS INT) AS requests
  FROM base),
every AS (SELECT *, {d["each"].format("CASE WHEN event_id % 20 = 0 AND input_tokens > 0 THEN {0}0, 1{1} ELSE {0}0{1} END".format(*d["list"]))} AS copy FROM orig),
moved AS (
  SELECT event_id, id, CASE WHEN copy = 1 AND event_id % 60 = 0 THEN ts + INTERVAL '2' DAY ELSE ts END AS ts, harness, CASE WHEN copy = 1 THEN 'dev-copy' ELSE device_id END AS device_id, raw_model, project, repository,
    session_id, session_title, project_name, thread_id, thread_url, CASE WHEN copy = 1 THEN input_tokens + event_id % 3 - 1 ELSE input_tokens END AS input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
    reasoning_tokens, cache_write_1h_tokens, service_tier, reported_cost_usd, requests
  FROM every)
SELECT *, {d["ms"].format("ts")} AS ms, CAST(0 AS DOUBLE) AS cost_usd, false AS cost_known FROM moved"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(events_sql("spark", "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_stores: dict[tuple[str, str], store.Store] = {}


def usage_store(spark: SparkSession, sf_dir: str) -> store.Store:
    """The usage events as a stored table, which the dashboard queries read: made once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = store.create(spark, tables.lasting(spark).folder_of("usage"), usage_events(spark, sf_dir), buckets=8)
    return _stores[key]


#: (model, field, rate): per-token rates, with suffixes for context size and service tier.
CATALOG = [
    ("gpt-6.1-sol", "input_cost_per_token", 2e-6), ("gpt-6.1-sol", "output_cost_per_token", 8e-6),
    ("gpt-6.1-sol", "cache_read_input_token_cost", 2e-7), ("gpt-6.1-sol", "cache_creation_input_token_cost", 2.5e-6),
    ("gpt-6.1-sol", "cache_creation_input_token_cost_above_1hr", 4e-6),
    ("gpt-6.1-sol", "input_cost_per_token_priority", 4e-6), ("gpt-6.1-sol", "output_cost_per_token_priority", 1.6e-5),
    ("gpt-6.1-sol", "cache_read_input_token_cost_priority", 4e-7),
    ("gpt-6.1-sol", "input_cost_per_token_above_200k_tokens", 3e-6), ("gpt-6.1-sol", "output_cost_per_token_above_200k_tokens", 1.2e-5),
    ("claude-fable-5-1", "input_cost_per_token", 3e-6), ("claude-fable-5-1", "output_cost_per_token", 1.5e-5),
    ("claude-fable-5-1", "cache_read_input_token_cost", 3e-7), ("claude-fable-5-1", "cache_creation_input_token_cost", 3.75e-6),
    ("claude-fable-5-1", "cache_creation_input_token_cost_above_1hr", 6e-6),
    ("grok-4.6", "input_cost_per_token", 1e-6), ("grok-4.6", "output_cost_per_token", 2e-6),
    ("openai/gemini-3-pro", "input_cost_per_token", 1.25e-6), ("openai/gemini-3-pro", "output_cost_per_token", 1e-5),
    ("openai/gemini-3-pro", "cache_read_input_token_cost", 1.25e-7),
]

#: Saved rules; rates are per million tokens.
RULES = [
    {"model": "house-alias", "kind": "alias", "target": "grok-4.6"},
    {"model": "house-free", "kind": "free"},
    {"model": "house-custom", "kind": "rates", "nickname": "house-custom-v2", "rates": {"input": 2.0, "output": 8.0, "cache_read": 0.2}},
]
