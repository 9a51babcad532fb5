"""Billing exports as usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metergrid.functions.expr import log_millis

# The header of the export and the keys of its usage map.
COLUMNS = ("Product", "Charge Category", "Billing Item ID", "Event Time", "Model", "Usage")
BUCKETS = {"input_tokens": "prompt-text-tokens", "output_tokens": "completion-text-tokens", "cache_read_tokens": "cached-prompt-text-tokens", "cache_write_tokens": "cache-write-text-tokens"}


def read_billing(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the product's usage charges: billing_rows() of a CSV export."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"the export lacks {', '.join(missing)}")
    return billing_rows(raw)


def billing_rows(raw: DataFrame) -> DataFrame:
    """Usage charges as events. The whole export is refused where one has a bad id, time or usage (a map of the known
    buckets to whole numbers), where an id occurs with two contents, and where there are none."""
    kept = raw.where((F.col("Product") == "cursor") & (F.col("Charge Category") == "usage"))
    # numbers arrive as their JSON text; a text value is quoted in the variant and not in the map
    usage = F.from_json("Usage", "map<string,string>")
    kind = F.schema_of_variant(F.try_parse_json("Usage"))
    rows = kept.select(F.col("Billing Item ID").alias("item"), F.col("Event Time").alias("at"), F.col("Model").alias("raw"), usage.alias("u"), kind.startswith("OBJECT").alias("object")).withColumn("ms", log_millis(F.col("at")))
    whole = lambda v: v.isNotNull() & v.rlike("^[0-9]+$") & (v.try_cast("decimal(38,0)") <= (1 << 53) - 1)
    good = (
        F.col("item").rlike("^[A-Za-z0-9_-]{1,200}$") & F.col("at").rlike(r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:\d\d)$") & F.col("ms").isNotNull() & F.col("object") & (F.size("u") > 0)
        & F.forall(F.map_keys("u"), lambda k: k.isin(*BUCKETS.values())) & F.forall(F.map_values("u"), whole)
    )
    found = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    n, bad = found.agg(F.count("*"), F.count_if(~F.col("good"))).first()
    if bad:
        raise ValueError(f"{bad} invalid billing rows")
    if not n:
        raise ValueError("the export has no usage")
    model = F.coalesce(F.nullif(F.trim("raw"), F.lit("")), F.lit("cursor/unknown"))
    events = found.select(
        F.concat(F.lit("cursor:billing-item:"), "item").alias("id"), "ms", F.lit("cursor").alias("harness"), model.alias("raw_model"), F.lit("Cursor billing").alias("project"), *[F.coalesce(F.try_element_at("u", F.lit(k)).cast("long"), F.lit(0)).alias(c) for c, k in BUCKETS.items()],
        F.lit("").alias("session_id"), F.lit(0).alias("requests"), F.lit(0).cast("long").alias("reasoning_tokens"),
    ).distinct()
    if clash := events.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").count():
        raise ValueError(f"{clash} ids with different contents")
    return events


def residual(agents: DataFrame, runs: DataFrame) -> DataFrame:
    """(agent, tokens, of_runs, residual): what an agent's total holds beyond its runs, 0 at least."""
    summed = runs.groupBy("agent").agg(F.sum("tokens").alias("of_runs"))
    joined = agents.join(summed, "agent", "left").withColumn("of_runs", F.coalesce("of_runs", F.lit(0)))
    return joined.select("agent", "tokens", "of_runs", F.greatest(F.lit(0), F.col("tokens") - F.col("of_runs")).alias("residual"))


def refreshed(previous: DataFrame, fresh: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot of cloud usage after a refresh, and the ids to withdraw. Of agents (session_id) that were read again only
    the fresh rows stay; rows of others are kept, since their absence proves nothing."""
    again = agents.select("session_id").distinct()
    events = fresh.unionByName(previous.join(again, "session_id", "left_anti").select(*fresh.columns))
    gone = previous.join(again, "session_id", "left_semi").select("id").distinct()
    return events, gone.join(events.select("id"), "id", "left_anti")
