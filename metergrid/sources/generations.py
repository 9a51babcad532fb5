"""Calls that a conversation database records more than once, their models and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.functions.expr import canonical_repository

# Prefix of model paths, suffix of effort, and the folder of attachments.
MODEL_PATH = r"(?i)^(?:publishers/[^/]+/)?models/"
EFFORT = r"(?i)-(?:low|medium|high|xhigh)$"
ATTACHMENTS = r"(?i)[\\/]\.t3[\\/]userdata[\\/]attachments(?:[\\/]|$)"


def response_model(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), MODEL_PATH, "")


def fallback_model(name: Column) -> Column:
    return F.regexp_replace(response_model(name), EFFORT, "")


def first_model(response: Column, *fallbacks: Column) -> Column:
    """The model of the response, else the first fallback that names one, without its effort; else 'unknown'."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(response_model(response)), *[some(fallback_model(c)) for c in fallbacks], F.lit("unknown"))


def file_path(uri: Column) -> Column:
    """The absolute path of a file address or path, without slashes at its end; null for anything else."""
    plain = F.regexp_replace(uri, r"^\s+|\s+$", "")
    path = F.when(F.lower(plain).startswith("file://"), F.try_url_decode(F.replace(F.regexp_replace(plain, "(?i)^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))).when(~plain.contains("://"), plain)
    return F.when(path.startswith("/"), F.coalesce(F.nullif(F.regexp_replace(path, r"[\\/]+$", ""), F.lit("")), path))


def chosen_workspace(workspaces: Column, uris: Column) -> tuple[Column, Column]:
    """(project, repository) of a conversation. workspaces: array of (folder, git_root, remote_url, branch); the first
    under version control wins, then the first at all, then the first address. Folders of attachments don't count."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    usable = lambda path: path.isNotNull() & ~path.rlike(ATTACHMENTS)
    read = F.transform(workspaces, lambda w: F.struct(F.coalesce(file_path(w["folder"]), file_path(w["git_root"])).alias("path"), w["remote_url"].alias("remote"), (file_path(w["git_root"]).isNotNull() | some(w["branch"]) | some(w["remote_url"])).alias("versioned")))
    read = F.filter(read, lambda w: usable(w["path"]))
    best = F.coalesce(F.get(F.filter(read, lambda w: w["versioned"]), F.lit(0)), F.get(read, F.lit(0)))
    plain = F.get(F.filter(F.transform(uris, file_path), usable), F.lit(0))
    return F.when(best.isNotNull(), best["path"]).otherwise(F.coalesce(plain, F.lit(""))), F.when(some(best["remote"]), canonical_repository(best["remote"]))


def merged_copies(rows: DataFrame, order: str) -> DataFrame:
    """One row for each id: the largest total of tokens wins, of equal ones the first in `order`. Where its model is
    unknown or its tier empty, an earlier winner's stands, or else the first one that is known.

    Rows of one id lie in one window: an id is one call, with as many rows as it was recorded times.
    """
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    before = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_total", total).withColumn("_record", F.coalesce(F.col("_total") > F.max("_total").over(before), F.lit(True)))

    def kept(column: str, known: Column) -> Column:
        latest = F.max_by(column, F.when(F.col("_record") & known, F.col(order)))
        return F.coalesce(latest, F.min_by(column, F.when(known, F.col(order))), F.max_by(column, F.when(F.col("_record"), F.col(order)))).alias(column)

    others = [c for c in rows.columns if c not in ("id", "model", "tier")]
    winner = F.max_by(F.struct(*others), F.when(F.col("_record"), F.col(order))).alias("_w")
    one = marked.groupBy("id").agg(winner, kept("model", F.col("model") != "unknown"), kept("tier", F.col("tier") != ""))
    return one.select(*[F.col(f"_w.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])
