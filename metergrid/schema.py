"""Types of the fact row and of what surrounds it."""

from __future__ import annotations

from pyspark.sql import types as T

HARNESSES = ("claude", "codex", "pi", "muse", "grok", "antigravity", "cursor")
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")

#: One row for each billable call. `ts` is UTC without a zone; `ms` the same in whole milliseconds since 1970.
#: A null service_tier, cache_write_1h_tokens or requests means "not reported", which differs from '' and 0.
USAGE_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ms", T.LongType()),
        T.StructField("harness", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("raw_model", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("repository", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("cache_write_tokens", T.LongType()),
        T.StructField("reasoning_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("cost_known", T.BooleanType()),
        T.StructField("reported_cost_usd", T.DoubleType()),
        T.StructField("service_tier", T.StringType()),
        T.StructField("cache_write_1h_tokens", T.LongType()),
        T.StructField("requests", T.IntegerType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("session_title", T.StringType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("thread_url", T.StringType()),
    ]
)
